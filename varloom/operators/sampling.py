"""Deterministic sampling by a budget of bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def budget_sample(df: DataFrame, keys: list[str], size: str, budget: Column, order: list) -> DataFrame:
    """Rows in ``order`` while the sizes before them stay below the budget of their key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(w), F.lit(0))
    return df.withColumn("__before", before).filter(F.col("__before") < budget).drop("__before")


def sample_reads(reads: DataFrame, keys: list[str], max_depth: float, seed: int = 1, keep: Column | None = None) -> DataFrame:
    """All alignments of a hash-chosen set of reads, so that each key's depth is ``max_depth``.

    A read is taken whole or not at all. ``keep`` marks reads to take first. The budget is
    ``max_depth`` times the key's span.
    """
    first = F.lit(0) if keep is None else F.when(keep, 0).otherwise(1)
    named = reads.groupBy(*keys, "qname").agg(F.sum(F.col("end") - F.col("start") + 1).alias("size"), F.min(first).alias("first"), F.min("start").alias("low"), F.max("end").alias("high"))
    span = Window.partitionBy(*keys)
    named = named.withColumn("budget", max_depth * (F.max("high").over(span) - F.min("low").over(span) + 1))
    kept = budget_sample(named, keys, "size", F.col("budget"), ["first", F.xxhash64("qname", F.lit(seed)), "qname"])
    return reads.join(kept.select(*keys, "qname"), [*keys, "qname"], "left_semi")


def limit_depth(reads: DataFrame, max_depth: float, tile: int = 100_000, seed: int = 1) -> DataFrame:
    """Alignments thinned to ``max_depth`` where a tile of starts is deeper; others stay whole.

    A tile's budget is its own width times the depth, so the thinned tiles need no look at
    their neighbours, and a read's alignments in one tile stay or go together.
    """
    rows = reads.withColumn("__tile", F.floor(F.col("start") / tile))
    size = F.sum(F.col("end") - F.col("start") + 1)
    deep = rows.groupBy("chrom", "__tile").agg(size.alias("__bases")).filter(F.col("__bases") > max_depth * tile).drop("__bases")
    many = rows.join(deep, ["chrom", "__tile"], "left_semi")
    named = many.groupBy("chrom", "__tile", "qname").agg(size.alias("size"))
    kept = budget_sample(named, ["chrom", "__tile"], "size", F.lit(max_depth * tile), [F.xxhash64("qname", F.lit(seed)), "qname"]).drop("size")
    thin = many.join(kept, ["chrom", "__tile", "qname"], "left_semi")
    return rows.join(deep, ["chrom", "__tile"], "left_anti").unionByName(thin).drop("__tile")
