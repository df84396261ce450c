"""Variants that show only as clipped reads: clipped ends of a place vote, and where the vote
goes on along the reference tells the variant.

Clipped ends are written outwards, from the last aligned base on: as they stand at a right end,
reversed (not complemented) at a left one, and the reference likewise. One search then serves
both sides. Reads whose alignments elsewhere are told by an SA tag are left to the breakpoint
groups; hard clips have no bases and do not count.
"""

from __future__ import annotations

from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alignment import consensus
from ..sources.files import fetch
from . import cigar as cg
from .breakpoints import alike
from .intervals import overlap_join
from .windows import runs_tiled

_COMPLEMENT = str.maketrans("ACGTacgt", "TGCAtgca")


def clipped_tails(rows: DataFrame, min_clip: int, longest: int) -> DataFrame:
    """qname, chrom, pos (last aligned base), side (L or R) and tail, outwards, up to ``longest`` bases.

    ``rows``: qname, chrom, start, end, cigar, seq, sa.
    """
    ops = cg.operations(F.col("cigar"))
    ends = F.array(
        *(
            F.struct(F.lit(s).alias("side"), F.col(at).alias("pos"), cg.clip(ops, name)["size"].alias("size"), cg.clip(ops, name)["hard"].alias("hard"))
            for s, at, name in (("L", "start", "left"), ("R", "end", "right"))
        )
    )
    alone = rows.filter(F.col("sa").isNull() & F.col("cigar").rlike("[0-9]S")).select("qname", "chrom", "seq", F.explode(ends).alias("e"))
    long = alone.filter((F.col("e.size") >= min_clip) & ~F.col("e.hard"))
    left = F.reverse(F.expr("substring(seq, 1, e.size)"))
    text = F.when(F.col("e.side") == "L", left).otherwise(F.expr("right(seq, e.size)"))
    return long.select("qname", "chrom", "e.pos", "e.side", F.substring(F.upper(text), 1, longest).alias("tail"))


def _diagonal(tail: str, window: str, k: int, least: int) -> tuple[int, int] | None:
    """(place in ``window`` less place in ``tail``, first place in ``tail``) of the shared run that begins first.

    Only k-mers that occur once in the window count, and a run needs ``least`` of them.
    """
    wanted: dict[str, int] = {}
    for i in range(len(tail) - k + 1):
        wanted[tail[i : i + k]] = -1
    for z in range(len(window) - k + 1):
        word = window[z : z + k]
        if word in wanted:
            wanted[word] = z if wanted[word] == -1 else -2
    runs: dict[int, list[int]] = {}
    for i in range(len(tail) - k + 1):
        z = wanted[tail[i : i + k]]
        if z >= 0:
            seen = runs.setdefault(z - i, [i, 0])
            seen[1] += 1
    kept = [(first, -n, d) for d, (first, n) in runs.items() if n >= least]
    if not kept:
        return None
    first, _, d = min(kept)
    return d, first


def settle(tail: str, side: str, pos: int, window: str, window_start: int, min_size: int, k: int = 21, least: int = 20, slack: int = 30) -> tuple[int, int, str, int, str | None] | None:
    """(start, end, type, length, inserted bases) of what a place's consensus tells, or nothing.

    The tail goes on beyond skipped bases (DEL), behind its place (DUP), at its place after
    bases of its own (INS), or turned round (INV). ``window``: the reference around the place,
    from ``window_start``; variants that reach beyond it are not found.
    """
    right = side == "R"
    outward = window if right else window[::-1]
    # Place in ``outward`` of the first base past the breakpoint.
    origin = pos + 1 - window_start if right else window_start + len(window) - pos
    at = lambda z: pos + 1 + z if right else pos - 1 - z
    span = lambda a, b: (min(a, b), max(a, b))
    straight = _diagonal(tail, outward, k, least)
    turned = _diagonal(tail, outward.translate(_COMPLEMENT)[::-1], k, least)
    if straight and (not turned or straight[1] <= turned[1]):
        shift = straight[0] - origin
        place = straight[1] + shift
        if straight[1] <= slack and shift >= min_size:
            return (*span(at(0), at(shift - 1)), "DEL", -shift, None)
        if straight[1] <= slack and -shift >= min_size:
            return (*span(at(-1), at(shift)), "DUP", -shift, None)
        if abs(place) <= slack and -shift >= min_size:
            text = tail[:-shift] if right else tail[:-shift][::-1]
            where = pos + 1 if right else pos
            return where, where, "INS", -shift, text
        return None
    if turned and turned[1] <= slack:
        z = len(outward) - 1 - turned[0] - origin  # where the tail's first base lies
        low, high = span(at(0), at(z)) if z >= 0 else span(at(-1), at(z + 1))
        return (low, high, "INV", high - low + 1, None) if high - low + 1 >= min_size else None
    return None


def clip_places(tails: DataFrame, minimum: int, gap: int = 20) -> DataFrame:
    """place_id, chrom, side, start, end of the places where at least ``minimum`` reads are clipped."""
    found = runs_tiled(tails.select("chrom", "side", "pos"), ["chrom", "side"], "pos", 100_000, gap).filter(F.col("n") >= minimum)
    return found.select(F.xxhash64("chrom", "side", "start", "end").alias("place_id"), "chrom", "side", "start", "end")


def clip_calls(rows: DataFrame, regions: DataFrame, tiles: DataFrame, tile: int, minimum: int, min_size: int, max_size: int, min_clip: int = 200, depth: int = 80, reach: int = 20_000, longest: int = 2_000) -> DataFrame:
    """chrom, start, end, svtype, sv_len, alt_seq, place_id, support, reads of variants at clip regions.

    ``rows``: alignments with start, end and sa; ``regions``: chrom, start, end of clip regions.
    Of a place's reads ``depth`` vote, chosen by hash; all of them are its support. Calls of the
    two sides that agree are one, with the reads of both. Insertions longer than ``longest``,
    and variants longer than ``reach``, stay uncalled; a place without enough reads, or whose
    consensus goes on nowhere near, gives no row, and so do empty tables.
    """
    near = overlap_join(clipped_tails(rows, min_clip, longest).withColumn("start", F.col("pos")).withColumn("end", F.col("pos")), regions, 10_000, 50, 50, how="left_semi").dropDuplicates(["qname", "chrom", "side", "pos"])
    places = clip_places(near, minimum)
    met = overlap_join(near, places, 10_000).filter("side = b_side").select(F.col("b_place_id").alias("place_id"), "chrom", "side", "pos", "qname", "tail")
    members = met.groupBy("place_id").agg(F.count_distinct("qname").cast("int").alias("support"), F.collect_set("qname").alias("reads")).filter(F.col("support") >= minimum)
    rank = F.row_number().over(Window.partitionBy("place_id").orderBy(F.xxhash64("qname"), "qname", "pos", "tail"))
    voters = met.withColumn("__r", rank).filter(F.col("__r") <= depth).drop("__r")
    wide = places.select("chrom", F.greatest(F.col("start") - reach, F.lit(1)).alias("start"), (F.col("end") + reach).alias("end"), "place_id")
    bases = fetch(tiles, wide, tile).select("place_id", F.col("start").alias("window_start"), F.upper("ref_seq").alias("window"))

    def run(key: tuple, pdf: pd.DataFrame, ref: pd.DataFrame) -> pd.DataFrame:
        columns = ["place_id", "chrom", "start", "end", "svtype", "sv_len", "alt_seq"]
        if not len(pdf) or not len(ref):
            return pd.DataFrame([], columns=columns)
        cut = int(median(len(x) for x in pdf["tail"]))
        texts = sorted(x[:cut] for x in pdf["tail"] if len(x) >= cut)
        got = settle(consensus(texts), pdf["side"].iloc[0], int(median(sorted(pdf["pos"]))), ref["window"].iloc[0], int(ref["window_start"].iloc[0]), min_size)
        return pd.DataFrame([] if got is None else [(key[0], pdf["chrom"].iloc[0], *got)], columns=columns)

    told = voters.groupBy("place_id").cogroup(bases.groupBy("place_id")).applyInPandas(run, "place_id long, chrom string, start long, end long, svtype string, sv_len int, alt_seq string")
    told = told.filter(F.abs("sv_len").between(min_size, max_size)).join(members, "place_id")
    first = F.struct("support", (-F.col("start")).alias("s"), (-F.col("place_id")).alias("p"))
    best = F.max_by(F.struct("start", "end", "sv_len", "alt_seq", "place_id"), first)
    both = alike(told, ["chrom", "svtype"], 20).groupBy("chrom", "svtype", "__alike").agg(best.alias("b"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reads")))).alias("reads"))
    return both.select("chrom", "b.start", "b.end", "svtype", "b.sv_len", "b.alt_seq", "b.place_id", F.size("reads").alias("support"), "reads")


def own_depth(calls: DataFrame, alignments: DataFrame, flank: int = 5) -> DataFrame:
    """Adds dp: a call's own reads, and the others that cover its start.

    Reads clipped at a variant's far side do not reach its start, so they count apart.
    """
    points = calls.select("chrom", F.greatest(F.col("start") - flank, F.lit(1)).alias("start"), (F.col("start") + flank).alias("end"), "region_id", "reads")
    met = overlap_join(points, alignments.select("chrom", "start", "end", "qname"), 10_000).filter(~F.array_contains("reads", F.col("b_qname")))
    others = met.groupBy("region_id").agg(F.count_distinct("b_qname").cast("int").alias("__others"))
    return calls.join(others, "region_id", "left").withColumn("dp", F.col("support") + F.coalesce("__others", F.lit(0))).drop("__others")
