"""Candidate regions: estimated filters, abnormal positions, indel and clip regions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pileup as pl
from . import windows
from .aggregates import mean_depth_of_modal_group, percentile_by_histogram
from .intervals import overlap_join


@dataclass(frozen=True)
class Estimates:
    """Filters that follow from the data: sizes, counts per position, large size, support."""

    min_ins_size: int = 2
    min_del_size: int = 2
    min_ins: int = 5
    min_del: int = 5
    min_clip: int = 5
    large: int = 40
    support: int = 3


def estimate(runs: DataFrame, size_share: float = 0.95, count_share: float = 0.99995, clr: bool = False) -> Estimates:
    """Percentiles of indel sizes, then of indel and clip counts per position, and mean depths.

    Each number comes from a histogram, so what reaches the driver is a row each, and the
    depths of at most a hundred blocks.
    """
    size = lambda op: percentile_by_histogram(runs.filter(F.col("op") == op), "len", size_share, 2).first()[0]
    ins, dele = size("I"), size("D")
    ev = pl.events(runs, ins, dele)
    at = lambda op: ev.filter(F.col("op") == op).groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("n"))
    count = lambda op: percentile_by_histogram(at(op), "n", count_share, 5).first()[0]
    blocks = pl.coverage(runs).withColumn("width", F.col("end") - F.col("start") + 1).groupBy("chrom", F.floor(F.col("start") / 20_000).alias("block")).agg((F.sum(F.col("depth") * F.col("width")) / F.sum("width")).alias("mean"))
    depths = [r.mean for r in blocks.orderBy(F.xxhash64("chrom", "block")).limit(100).collect()]
    support = max(3, 2 + int(0.03 * mean_depth_of_modal_group(depths)))
    if clr:
        support = max(4, support + 1)
    return Estimates(ins, dele, count("I"), count("D"), count("clip"), 3 * max(ins, dele), support)


def zero_coverage(cover: DataFrame, contigs: DataFrame) -> DataFrame:
    """Uncovered runs of at least two positions, ends of contigs included."""
    edges = contigs.select("chrom", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit(0).alias("depth")).unionByName(contigs.select("chrom", (F.col("length") + 1).alias("start"), (F.col("length") + 1).alias("end"), F.lit(0).alias("depth")))
    order = Window.partitionBy("chrom").orderBy("start")
    rows = cover.select("chrom", "start", "end", F.col("depth").cast("int").alias("depth")).unionByName(edges)
    between = rows.select("chrom", (F.lag("end").over(order) + 1).alias("from"), (F.col("start") - 1).alias("to"))
    return between.filter(F.col("to") - F.col("from") + 1 >= 2).select("chrom", F.col("from").alias("start"), F.col("to").alias("end"))


def indel_gate(minimum: int, min_size: int) -> Column:
    """Whether a region's statistics make it a candidate."""
    low = (F.col("mean_depth") <= 0.5 * minimum) | (F.col("signatures") <= 0.5 * minimum) | (F.col("signatures") / F.greatest(F.col("mean_depth"), F.lit(1)) < 0.05)
    small = (F.col("end") - F.col("start") + 1 < min_size) & (F.col("consensus_bases") == 0) & (F.col("large_bases") == 0)
    few = ((F.col("mean_depth") < 15) & (F.col("signatures") >= 2)) | ((F.col("mean_depth") < 6) & (F.col("signatures") >= 1))
    enough = (F.col("signatures") >= minimum) | few | (F.col("zero_bases") > 0) | (F.col("high_bases") > 0) | (F.col("raised_share") >= 0.1)
    return ~low & ~small & enough


def indel_regions(pile: DataFrame, est: Estimates, min_size: int = 18, max_gap: int = 20) -> DataFrame:
    """chrom, start, end, sv_len: runs of abnormal positions that pass the gate.

    A run goes on over fewer than ``max_gap`` normal positions. It is an island in position
    order, so there are no tiles whose edges could cut or double it.
    """
    flagged = pile.filter(pl.abnormal(est.min_ins, est.min_del, est.min_clip) & ((F.col("n_ins") + F.col("n_del") + F.col("del_spread") + F.col("n_large")) > 0))
    found = windows.runs_tiled(flagged.select("chrom", "pos"), ["chrom"], "pos", 100_000, max_gap)
    stats = pl.region_statistics(pile, found.select("chrom", "start", "end"))
    big = (F.abs("sv_len") >= min_size) | (F.col("large") > 0)
    return stats.filter(indel_gate(est.support, min_size) & big).select("chrom", "start", "end", "sv_len", "mean_depth", "signatures")


def clip_gate(minimum: int, ratio: float) -> Column:
    """Whether a 200-base window's long clips are many enough, alone or for the depth."""
    r = F.col("long_clips") / F.greatest(F.col("refined"), F.lit(1))
    deep = ((r >= ratio) & (F.col("long_clips") >= minimum / 2)) | ((F.col("long_clips") >= minimum) & (r >= ratio / 2))
    thin = (F.col("long_clips") >= 0.6 * minimum) & ((r >= ratio / 2) | (F.col("span") < 30))
    return (F.col("long_clips") > 0) & (F.when(F.col("refined") >= minimum / 2, deep).otherwise(thin) | (F.col("peak") >= ratio))


def clip_regions(pile: DataFrame, minimum: int, ratio: float = 0.1, size: int = 200) -> DataFrame:
    """chrom, start, end of neighbouring windows with many long clips."""
    at = F.when(F.col("n_long_clip") > 0, F.col("pos"))
    stats = windows.bins(
        pile, ["chrom"], "pos", size,
        [F.sum("n_long_clip").alias("long_clips"), F.avg(F.col("depth") + F.coalesce("ins_bases", F.lit(0)) + F.col("del_spread")).alias("refined"), (F.max(at) - F.min(at) + 1).alias("span"), F.min(at).alias("low"), F.max(at).alias("high"), F.max(F.when(F.col("n_long_clip") >= 2, F.col("n_long_clip") / F.greatest(F.col("depth") + F.col("del_spread"), F.lit(1)))).alias("peak")],
    )
    flagged = stats.filter(F.coalesce(clip_gate(minimum, ratio), F.lit(False)))
    found = windows.runs_tiled(flagged, ["chrom"], "bin", 5_000, 1, {"low": F.min, "high": F.max, "long_clips": F.sum})
    return found.select("chrom", F.col("low").alias("start"), F.col("high").alias("end"), F.col("long_clips").alias("clips"))


def drop_inside_groups(indels: DataFrame, groups: DataFrame, slack: int = 50) -> DataFrame:
    """Indel regions that no breakpoint group's span explains."""
    spans = groups.filter("start is not null").select("chrom", F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end"))
    return overlap_join(indels, spans, 10_000, slack, slack, how="left_anti")
