"""From alleles to genotyped, phased variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import is_similar
from .aggregates import allele_depths, genotype, supported
from .intervals import overlap_join

VARIANT = ["chrom", "start", "end", "svtype", "sv_len", "alt_seq", "support", "reads", "region_id", "cluster_id", "ldiscov"]


def merge_alleles(calls: DataFrame, likeness: float, distance: int = 100, size_ratio: float = 0.9) -> DataFrame:
    """Calls of a region's two clusters that are the same variant become one.

    Same type, starts near, like sizes, and similar inserted bases where both are known; the
    call of more support stays and takes the other's reads.
    """
    a = calls.alias("a")
    b = calls.alias("b")
    seq = F.col("a.alt_seq").isNull() | F.col("b.alt_seq").isNull() | is_similar(F.col("a.alt_seq"), F.col("b.alt_seq"), likeness)
    sizes = F.least(F.abs("a.sv_len"), F.abs("b.sv_len")) >= size_ratio * F.greatest(F.abs("a.sv_len"), F.abs("b.sv_len"))
    same = (F.col("a.region_id") == F.col("b.region_id")) & (F.col("a.cluster_id") < F.col("b.cluster_id")) & (F.col("a.svtype") == F.col("b.svtype")) & (F.abs(F.col("a.start") - F.col("b.start")) <= distance) & sizes & seq
    pairs = a.join(b, same).select(F.col("a.region_id").alias("region_id"), F.col("a.cluster_id").alias("c1"), F.col("a.start").alias("s1"), F.col("b.cluster_id").alias("c2"), F.col("b.start").alias("s2"), F.col("b.reads").alias("more"))
    gone = pairs.select("region_id", F.col("c2").alias("cluster_id"), F.col("s2").alias("start")).distinct()
    gains = pairs.groupBy("region_id", F.col("c1").alias("cluster_id"), F.col("s1").alias("start")).agg(F.array_distinct(F.flatten(F.collect_list("more"))).alias("more"))
    left = calls.join(gone, ["region_id", "cluster_id", "start"], "left_anti").join(gains, ["region_id", "cluster_id", "start"], "left")
    left = left.withColumn("reads", F.when(F.col("more").isNull(), F.col("reads")).otherwise(F.array_union("reads", "more")))
    return left.withColumn("support", F.size("reads")).select(*calls.columns)


def spanning_depth(calls: DataFrame, alignments: DataFrame, flank: int = 0) -> DataFrame:
    """Adds dp: distinct reads that cover a call's start."""
    points = calls.select("chrom", F.greatest(F.col("start") - flank, F.lit(1)).alias("start"), (F.col("start") + flank).alias("end"), F.col("start").alias("at")).distinct()
    met = overlap_join(points, alignments.select("chrom", "start", "end", "qname"), 10_000)
    deep = met.groupBy("chrom", "at").agg(F.count_distinct("b_qname").cast("int").alias("dp")).withColumnRenamed("at", "start")
    rows = calls.join(deep, ["chrom", "start"], "left")
    return rows.withColumn("dp", F.greatest(F.coalesce("dp", F.lit(0)), F.col("support")))


def genotyped(calls: DataFrame, minimum: int, min_size: int, hom: float, het: float) -> DataFrame:
    """Adds af, gt, ad_ref, ad_alt; drops calls without support enough and reference ones."""
    s, d = F.col("support"), F.col("dp")
    rows = calls.filter(supported(s, d, F.col("sv_len"), F.lit(minimum), min_size) | F.col("svtype").isin("DUP", "INV", "TRA"))
    rows = rows.withColumn("af", F.round(s / d, 6)).withColumn("gt", genotype(s, d, hom, het)).withColumn("ad_ref", d - s).withColumn("ad_alt", s).withColumn("ad", allele_depths(s, d))
    return rows.filter("gt in ('0/1', '1/1')")


def links_between(nodes: DataFrame, least: int = 3) -> DataFrame:
    """Neighbouring heterozygous variants of a contig and how many reads they share, and don't.

    ``nodes``: variant_id, chrom, start, reads (of the variant allele), others (of the other).
    In cis: variant with variant, other with other; in trans: variant with other.
    """
    w = Window.partitionBy("chrom").orderBy("start", "variant_id")
    rows = nodes.withColumn("p", F.lag(F.struct("variant_id", "reads", "others")).over(w))
    n = lambda a, b: F.size(F.array_intersect(a, b))
    cis = n(F.col("reads"), F.col("p.reads")) + n(F.col("others"), F.col("p.others"))
    trans = n(F.col("reads"), F.col("p.others")) + n(F.col("others"), F.col("p.reads"))
    rows = rows.withColumn("cis", F.coalesce(cis, F.lit(0))).withColumn("trans", F.coalesce(trans, F.lit(0)))
    return rows.withColumn("linked", F.greatest("cis", "trans") >= least).withColumn("flips", F.col("trans") > F.col("cis"))


def phased(calls: DataFrame, alignments: DataFrame, least: int = 3) -> DataFrame:
    """Adds ps (contig and first start of the set) and writes the genotype with a bar.

    A set goes on while neighbours are linked: a running count of breaks numbers the sets, a
    running count of flips tells the haplotype, so there is no loop over variants.
    """
    rows = calls.withColumn("variant_id", F.xxhash64("chrom", "start", "end", "svtype", "sv_len", "cluster_id"))
    het = rows.filter("gt = '0/1'").select("variant_id", "chrom", "start", "end", "reads")
    met = overlap_join(het.select("variant_id", "chrom", "start", "start", "reads").toDF("variant_id", "chrom", "start", "end", "reads"), alignments.select("chrom", "start", "end", "qname"), 10_000)
    others = met.filter(~F.array_contains("reads", F.col("b_qname"))).groupBy("variant_id").agg(F.collect_set("b_qname").alias("others"))
    nodes = het.join(others, "variant_id", "left").withColumn("others", F.coalesce("others", F.array().cast("array<string>")))
    linked = links_between(nodes, least)
    w = Window.partitionBy("chrom").orderBy("start", "variant_id").rowsBetween(Window.unboundedPreceding, 0)
    sets = linked.withColumn("set", F.sum((~F.col("linked")).cast("int")).over(w)).withColumn("turns", F.sum((F.col("linked") & F.col("flips")).cast("int")).over(w))
    of = Window.partitionBy("chrom", "set")
    first = F.min(F.struct("start", "variant_id", "turns")).over(of)
    sets = sets.withColumn("first", first).withColumn("members", F.count(F.lit(1)).over(of)).filter("members >= 2")
    sets = sets.select("variant_id", F.concat_ws(":", "chrom", F.col("first.start").cast("string")).alias("ps"), ((F.col("turns") - F.col("first.turns")) % 2).alias("side"))
    out = rows.join(sets, "variant_id", "left")
    bar = F.when(F.col("side") % 2 == 0, "1|0").otherwise("0|1")
    return out.withColumn("gt", F.when(F.col("ps").isNull(), F.col("gt")).otherwise(bar)).drop("variant_id", "side")


def phase_sets(calls: DataFrame) -> DataFrame:
    """Number of phase sets of two or more variants, and of variants in them."""
    sizes = calls.filter("ps is not null").select(F.explode(F.split("ps", ",")).alias("ps")).groupBy("ps").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return sizes.agg(F.count(F.lit(1)).alias("phase_sets"), F.coalesce(F.sum("n"), F.lit(0)).alias("phased"))


def statistics(calls: DataFrame) -> DataFrame:
    return calls.groupBy("svtype").agg(F.count(F.lit(1)).alias("n"))
