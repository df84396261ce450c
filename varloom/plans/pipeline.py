"""The variant pipeline: alignments to candidates, to alleles, to genotyped variants.

Each stage is one lazily composed plan over DataFrames and returns a table that can be written
and read again (``sources.writers.save_stage``), so a run can restart between stages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import breakpoints as bp
from ..operators import call, cigar, clipcalls, cluster, detect, pileup, sampling, splitreads
from ..operators.dedup import cancel_false_neighbours, drop_small_signatures, near_duplicate_neighbours, same_sequence, same_variant
from ..operators.intervals import in_regions, overlap_join
from ..operators.refine import merge_neighbour_signatures, recount_support
from ..sources import alignments as al
from ..sources.files import fetch
from .parameters import Parameters
from .storage import staged


@dataclass
class Candidates:
    """What detection leaves: regions of indels and of clips, and breakpoint groups."""

    indels: DataFrame
    clips: DataFrame
    groups: DataFrame
    estimates: detect.Estimates
    reads: DataFrame


def prepared(reads: DataFrame, p: Parameters, limits: DataFrame | None = None) -> DataFrame:
    """Usable alignments with exact runs where the MD tag tells them, inside the user's regions."""
    rows = al.with_ends(cigar.with_exact_cigar(al.usable(reads, p.min_mapq)))
    rows = sampling.limit_depth(al.skip_ultra_deep(rows), p.max_depth)
    rows = al.drop_dense_reads(rows, p.max_density, p.internal_size)
    return rows if limits is None else in_regions(rows, limits, extend=5_000)


def read_runs(rows: DataFrame) -> DataFrame:
    return cigar.aligned_runs(rows.select("qname", "chrom", "pos", "cigar", "seq"), pos="pos")


def detect_candidates(reads: DataFrame, tiles: DataFrame | None, p: Parameters, limits: DataFrame | None = None, estimates: detect.Estimates | None = None) -> Candidates:
    rows = staged(prepared(reads, p, limits), "reads")
    runs = staged(read_runs(rows), "runs")
    est = estimates or detect.estimate(runs, p.size_percentile, p.count_percentile)
    if p.min_support:
        est = detect.Estimates(**{**est.__dict__, "support": p.min_support})
    pile = staged(pileup.pileup(runs, tiles, est.large, est.min_ins_size, est.min_del_size), "pileup")
    indels = detect.indel_regions(pile, est, p.internal_size)
    clips = detect.clip_regions(pile, est.support, p.clip_ratio)
    segs = staged(splitreads.segments(rows, p.min_mapq), "segments")
    found = bp.groups(bp.junctions(segs, p.min_clip)).withColumn("depth", F.col("support"))
    groups = staged(bp.votes(found.filter(F.col("support") >= max(1, est.support // 2)), segs, est.support), "groups")
    spans = groups.filter("svtype in ('DUP', 'INV') and chrom = chrom2").select("chrom", "start", "end")
    return Candidates(staged(detect.drop_inside_groups(indels, spans), "indels"), clips, groups, est, rows)


def region_signatures(rows: DataFrame, regions: DataFrame, p: Parameters, flank: int = 100) -> DataFrame:
    """region_id, qname, chrom, pos, op, len, seq of the reads of every region.

    Regions deeper than the consensus depth are sampled by whole reads first.
    """
    named = regions.withColumn("region_id", F.xxhash64("chrom", "start", "end"))
    wide = named.select("region_id", "chrom", F.greatest(F.col("start") - flank, F.lit(1)).alias("start"), (F.col("end") + flank).alias("end"))
    met = overlap_join(rows.select("qname", "chrom", "start", "end", "cigar", "seq", "pos"), wide, 10_000)
    met = met.select("qname", "chrom", "start", "end", "cigar", "seq", "pos", F.col("b_region_id").alias("region_id"), F.col("b_start").alias("low"), F.col("b_end").alias("high"))
    kept = sampling.sample_reads(met, ["region_id"], 2 * p.consensus_depth)
    runs = cigar.aligned_runs(kept.select("region_id", "qname", "chrom", "pos", "cigar", "seq", "low", "high"))
    sig = cigar.signatures(runs, p.internal_size, F.col("low"), F.col("high")).select("region_id", "qname", "chrom", F.col("rpos").alias("pos"), "op", "len", F.when(F.col("op") == "I", F.upper("run_seq")).alias("seq"))
    keys = ["region_id", "qname", "chrom"]
    clean = cancel_false_neighbours(sig.select(*keys, "pos", "op", "len"), keys)
    joined = merge_neighbour_signatures(clean.join(sig, [*keys, "pos", "op", "len"]).distinct(), keys).drop("members")
    return drop_small_signatures(joined, ["region_id", "qname"])


def window_sequences(rows: DataFrame, regions: DataFrame, clusters: DataFrame, tiles: DataFrame, p: Parameters, flank: int = 60, longest: int = 1_500) -> DataFrame:
    """Bases of each clustered read between a region's flanks, and the reference's.

    Only windows short enough for a full alignment table, and reads that span them.
    """
    wide = regions.select(F.xxhash64("chrom", "start", "end").alias("region_id"), "chrom", F.greatest(F.col("start") - flank, F.lit(1)).alias("start"), (F.col("end") + flank).alias("end")).filter(F.col("end") - F.col("start") <= longest)
    met = overlap_join(rows.select("qname", "chrom", "start", "end", "cigar", "seq", "pos"), wide, 10_000).filter("start <= b_start and end >= b_end")
    met = met.withColumnRenamed("b_region_id", "region_id").join(clusters.filter("cluster_id >= 0"), ["region_id", "qname"])
    runs = cigar.aligned_runs(met.select("region_id", "cluster_id", "qname", "chrom", "pos", "cigar", "seq", F.col("b_start").alias("low"), F.col("b_end").alias("high")), seq=None)
    at = lambda c: F.max(F.when(F.col("op").isin("M", "=", "X") & (F.col("rpos") <= F.col(c)) & (F.col(c) < F.col("rpos") + F.col("len")), F.col("qpos") + F.col(c) - F.col("rpos")))
    places = runs.groupBy("region_id", "cluster_id", "qname", "chrom", "low", "high").agg(at("low").alias("a"), at("high").alias("b"), F.first("seq").alias("seq")).filter("b >= a and b - a <= 2 * (high - low) + 4000")
    bases = fetch(tiles, wide.select("chrom", "start", "end").distinct(), p.tile)
    cut = places.select("region_id", "cluster_id", "qname", "chrom", F.col("low").alias("start"), F.col("high").alias("end"), F.expr("upper(substring(seq, cast(a as int), cast(b - a + 1 as int)))").alias("seq"))
    return cut.join(bases.withColumn("ref_seq", F.upper("ref_seq")), ["chrom", "start", "end"])


def call_variants(reads: DataFrame, tiles: DataFrame | None, p: Parameters, found: Candidates | None = None, limits: DataFrame | None = None) -> DataFrame:
    """Genotyped variants: indels from alleles and split reads, typed breakpoint groups, and clip regions."""
    found = found or detect_candidates(reads, tiles, p, limits)
    rows = found.reads
    minimum = found.estimates.support
    sig = staged(region_signatures(rows, found.indels, p), "signatures")
    clusters = cluster.cluster_regions(sig, minimum, cluster.Matching(similarity=p.match_similarity))
    clusters = staged(clusters, "clusters")
    # First from each cluster's consensus; what that leaves without a call, from the reads.
    aligned = None
    if tiles is not None:
        windows = window_sequences(rows, found.indels, clusters, tiles, p)
        aligned = staged(cluster.consensus_alleles(windows, p.internal_size), "aligned").withColumn("ldiscov", F.lit("ALN")).withColumnRenamed("ins_seq", "alt_seq")
    left = clusters if aligned is None else cluster.incomplete(clusters, aligned)
    near = staged(cluster.alleles(sig, left, minimum).withColumn("ldiscov", F.lit("READS")).withColumnRenamed("ins_seq", "alt_seq"), "alleles")
    if aligned is not None:
        near = near.select(*call.VARIANT).unionByName(aligned.select(*call.VARIANT))
    big = bp.large_indels(found.groups, minimum, p.min_size, p.max_size)
    split = big.select(F.col("group_id").alias("region_id"), F.lit(0).alias("cluster_id"), "chrom", "start", F.when(F.col("svtype") == "DEL", F.greatest("start", F.col("end") - 1)).otherwise(F.col("start")).alias("end"), "svtype", "sv_len", F.lit(None).cast("string").alias("alt_seq"), F.col("support").cast("int").alias("support"), "reads", F.lit("SPLIT").alias("ldiscov"))
    typed = found.groups.filter(F.col("svtype").isin("DUP", "INV") & (F.col("chrom") == F.col("chrom2")) & (F.col("support") >= minimum))
    span = (F.col("end") - F.col("start") + 1).cast("int")
    turned = typed.filter(span.between(p.min_size, p.max_size)).select(F.col("group_id").alias("region_id"), F.lit(0).alias("cluster_id"), "chrom", "start", "end", "svtype", span.alias("sv_len"), F.lit(None).cast("string").alias("alt_seq"), F.col("support").cast("int").alias("support"), "reads", F.lit("SPLIT").alias("ldiscov"), "dup_num")
    # Regions were sampled; depth is of all reads, so support is counted over all of them too.
    every = staged(cigar.signatures(read_runs(rows), p.internal_size).select("qname", "chrom", F.col("rpos").alias("pos"), "op", "len"), "every")
    near = recount_support(call.merge_alleles(near.select(*call.VARIANT), p.allele_similarity), every).withColumn("support", F.greatest("support", "recounted")).drop("recounted")
    calls = near.unionByName(split.select(*call.VARIANT)).unionByName(turned.select(*call.VARIANT, "dup_num"), allowMissingColumns=True)
    calls = calls.filter((F.abs("sv_len") >= p.min_size) & (F.abs("sv_len") <= p.max_size))
    calls = call.spanning_depth(calls, rows, 5)
    if tiles is not None:
        clipped = clipcalls.clip_calls(rows, found.clips, tiles, p.tile, minimum, p.min_size, p.max_size, p.min_clip, int(2 * p.consensus_depth), p.clip_reach)
        clipped = staged(clipped.withColumnRenamed("place_id", "region_id").withColumn("cluster_id", F.lit(0)).withColumn("ldiscov", F.lit("CLIP")).select(*call.VARIANT), "clipped")
        calls = calls.unionByName(clipcalls.own_depth(clipped, rows), allowMissingColumns=True)
    calls = call.genotyped(calls, minimum, p.min_size, p.hom, p.het)
    alike = same_variant() & F.coalesce(same_sequence(), F.lit(True))
    return near_duplicate_neighbours(calls.withColumn("alt", F.col("alt_seq")), ["chrom"], ["start", "end", "sv_len"], alike, "support").drop("alt")


def translocations(found: Candidates) -> DataFrame:
    """Groups that join two contigs, with both ends' orientations and a genotype of their own."""
    rows = found.groups.filter((F.col("svtype") == "TRA") & (F.col("support") >= found.estimates.support))
    end = lambda c: F.when(F.col(c) * 2 >= F.col("n"), "R").otherwise("L")
    return bp.strongest(rows).select("chrom", "start", end("right1").alias("end_type"), "chrom2", "end", end("right2").alias("end_type2"), F.lit("TRA").alias("svtype"), F.col("support").cast("int").alias("support"), "reads", "group_id")


def with_alleles(calls: DataFrame, tiles: DataFrame, tile: int) -> DataFrame:
    """Adds ref and alt: bases for short indels, symbolic alleles for the rest."""
    short = F.col("svtype").isin("INS", "DEL") & (F.abs("sv_len") <= 5_000)
    spots = calls.select("chrom", F.greatest(F.col("start") - 1, F.lit(1)).alias("start"), F.when(short & (F.col("svtype") == "DEL"), F.col("end")).otherwise(F.greatest(F.col("start") - 1, F.lit(1))).alias("end")).distinct()
    bases = fetch(tiles, spots, tile).select("chrom", F.col("start").alias("__s"), F.col("end").alias("__e"), F.upper("ref_seq").alias("ref"))
    keyed = calls.withColumn("__s", F.greatest(F.col("start") - 1, F.lit(1))).withColumn("__e", F.when(short & (F.col("svtype") == "DEL"), F.col("end")).otherwise(F.col("__s")))
    rows = keyed.join(bases, ["chrom", "__s", "__e"], "left").drop("__s", "__e")
    alt = F.when((F.col("svtype") == "INS") & F.col("alt_seq").isNotNull(), F.concat(F.substring("ref", 1, 1), "alt_seq")).when(short & (F.col("svtype") == "DEL"), F.substring("ref", 1, 1))
    return rows.withColumn("alt", alt)
