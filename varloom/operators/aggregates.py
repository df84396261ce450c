"""Aggregations: votes, ratios, histogram percentiles, trimmed means, supports, genotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(df: DataFrame, keys: list[str], value: str, order: list[str] | None = None) -> DataFrame:
    """Most frequent value of each group with its count and the total.

    Ties go to the value that stands first in ``order``, or to the smallest.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col(value)) if order else F.lit(0)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("votes").desc(), place, value))
    total = F.sum("votes").over(Window.partitionBy(*keys))
    return counts.withColumn("total", total).withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def percentile_by_histogram(df: DataFrame, value: str, share: float, floor: int, overflow: int = 1000) -> DataFrame:
    """First value + 1 at which the cumulative histogram reaches ``share``, at least ``floor``.

    Values above ``overflow`` don't count. The window runs over the histogram only.
    """
    counts = df.filter(F.col(value) <= overflow).groupBy(F.col(value).cast("long").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    below = F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy())
    reached = counts.withColumn("below", below).withColumn("total", total).filter(F.col("below") / F.col("total") >= share)
    return reached.agg(F.greatest(F.coalesce(F.min("value") + 1, F.lit(floor)), F.lit(floor)).cast("long").alias("estimate"))


def trimmed_mean(df: DataFrame, keys: list[str], value: str, within: float = 3.0, deviations: float = 2.0) -> DataFrame:
    """Mean of the values below ``within`` times the mean; rows inside ``deviations`` of it.

    Result: keys, n, trimmed_mean, deviation (population), n_kept.
    """
    means = df.groupBy(*keys).agg(F.avg(value).alias("mean"))
    near = df.join(means, keys).filter(F.col(value) < within * F.col("mean"))
    stats = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("trimmed_mean"), F.stddev_pop(value).alias("deviation"))
    kept = df.join(stats, keys).filter(F.abs(F.col(value) - F.col("trimmed_mean")) <= deviations * F.col("deviation"))
    return stats.join(kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_kept")), keys, "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))


def min_support(mean_depth: Column, factor: float = 0.03) -> Column:
    """Reads that a variant needs: at least 3, more where coverage is deep."""
    return F.greatest(F.lit(3), 2 + F.floor(factor * mean_depth)).cast("int")


def supported(support: Column, depth: Column, length: Column, least: Column, min_size: int) -> Column:
    """Whether a candidate's support is enough, alone, by its share, or for a long one at low depth."""
    low = (F.abs(length) >= 2 * min_size) & (((support >= 2) & (depth <= 15)) | ((support >= 1) & (depth <= 6)))
    return (support >= least) | (support >= 0.6 * depth) | low


def genotype(support: Column, depth: Column, hom: float = 0.7, het: float = 0.2) -> Column:
    ratio = support / depth
    return F.when(depth <= 0, "./.").when(ratio >= hom, "1/1").when(ratio >= het, "0/1").otherwise("0/0")


def allele_depths(support: Column, depth: Column) -> Column:
    """Reads of the reference and of the variant, comma-joined."""
    return F.concat_ws(",", F.greatest(depth - support, F.lit(0)).cast("string"), support.cast("string"))


def compensation(span: Column, read_length: Column) -> Column:
    """Factor for reads that overhang a window: (S + 2 L) / (S + L)."""
    return (span + 2 * read_length) / (span + read_length)


def mean_depth_of_modal_group(depths: list[float], within: float = 10.0) -> float:
    """Mean of the largest group, when each depth joins the first group whose mean is near.

    Works on the depths of the sampled blocks, a hundred at most.
    """
    groups: list[list[float]] = []
    for d in depths:
        home = next((g for g in groups if abs(sum(g) / len(g) - d) <= within), None)
        if home is None:
            groups.append([d])
        else:
            home.append(d)
    best = max(groups, key=len, default=[0.0])
    return sum(best) / len(best)
