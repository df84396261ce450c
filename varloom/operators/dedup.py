"""Removal of redundant and false rows: neighbours, cancelling pairs, small signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import is_similar


def near_duplicate_neighbours(df: DataFrame, keys: list[str], order: list[str], same: Column, support: str) -> DataFrame:
    """Drop the weaker of two neighbours for which ``same`` holds; ties keep the earlier one.

    ``same`` refers to the row before by ``prev`` (a struct of all columns). A row is judged
    against both neighbours as they were, so chains lose all but their strongest ends.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("prev", F.lag(F.struct(*df.columns)).over(w))
    rows = rows.withColumn("__same", F.coalesce(same, F.lit(False)))
    loses_back = F.col("__same") & (F.col(support) <= F.col(f"prev.{support}"))
    loses_ahead = F.coalesce(F.lead(F.col("__same") & (F.col(support) > F.col(f"prev.{support}"))).over(w), F.lit(False))
    return rows.withColumn("__drop", loses_back | loses_ahead).filter(~F.col("__drop")).select(*df.columns)


def same_variant(max_distance: int = 2000, size_ratio: float = 0.98) -> Column:
    """Numeric part of the near-duplicate test, for ``near_duplicate_neighbours``.

    Same type, starts near, intervals overlapping within 30 (500 if both are 500 or longer),
    sizes alike.
    """
    a, b = F.abs(F.col("prev.sv_len")), F.abs(F.col("sv_len"))
    reach = F.when((a >= 500) & (b >= 500), 500).otherwise(30)
    overlap = (F.col("prev.start") - reach <= F.col("end") + reach) & (F.col("start") - reach <= F.col("prev.end") + reach)
    return (F.col("prev.svtype") == F.col("svtype")) & (F.abs(F.col("start") - F.col("prev.start")) <= max_distance) & overlap & (F.least(a, b) >= size_ratio * F.greatest(a, b))


def same_sequence(high: float = 0.92, low: float = 0.782, short: int = 100) -> Column:
    """Sequence part: similarity of the alternative sequences, with a lower bar for short ones."""
    size = F.least(F.length("prev.alt"), F.length("alt"))
    return is_similar(F.col("prev.alt"), F.col("alt"), high) | ((size < short) & is_similar(F.col("prev.alt"), F.col("alt"), low))


def cancel_false_neighbours(df: DataFrame, keys: list[str], max_distance: int = 200, min_ratio: float = 0.8) -> DataFrame:
    """Drop an insertion and a deletion of like size side by side in a read's signatures.

    Rows: keys, pos, op ('I' or 'D'), len. Pairs are settled from the left; a row is in one.
    """
    item = F.struct("pos", "op", "len")
    lists = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__s"))
    pair = f"size(a) > 0 and element_at(a, -1).op <> x.op and x.pos - element_at(a, -1).pos <= {max_distance} and least(x.len, element_at(a, -1).len) >= {min_ratio} * greatest(x.len, element_at(a, -1).len)"
    fold = f"aggregate(__s, slice(__s, 1, 0), (a, x) -> if(size(a) > 0, if({pair.replace('size(a) > 0 and ', '')}, slice(a, 1, size(a) - 1), concat(a, array(x))), concat(a, array(x))))"
    return lists.select(*keys, F.explode(F.expr(fold)).alias("x")).select(*keys, "x.*")


def drop_small_signatures(df: DataFrame, keys: list[str], ratio: float = 0.2, min_size: int = 100) -> DataFrame:
    """Drop signatures that are short in themselves and beside the longest of their kind."""
    most = F.max("len").over(Window.partitionBy(*keys, "op"))
    return df.withColumn("__most", most).filter((F.col("len") >= min_size) | (F.col("len") >= ratio * F.col("__most"))).drop("__most")


def not_already_known(new: DataFrame, known: DataFrame, distance: int = 10, size_ratio: float = 0.9) -> DataFrame:
    """Rows of ``new`` without a row of ``known`` at nearly the same place and of nearly the same size."""
    w = distance
    n = new.withColumn("__bin", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("start") / w).cast("long") + k))))
    k = known.select(F.col("chrom").alias("k_chrom"), F.col("start").alias("k_start"), F.abs("sv_len").alias("k_len"), F.floor(F.col("start") / w).cast("long").alias("k_bin"))
    size = F.least(F.abs("sv_len"), F.col("k_len")) > size_ratio * F.greatest(F.abs("sv_len"), F.col("k_len"))
    met = n.join(k, (F.col("chrom") == F.col("k_chrom")) & (F.col("__bin") == F.col("k_bin")) & (F.abs(F.col("start") - F.col("k_start")) < distance) & size, "left_semi")
    return new.join(met.select(*new.columns).distinct(), new.columns, "left_anti")
