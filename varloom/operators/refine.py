"""Second looks at candidates: recounted support, merged neighbours, padded and smoothed
sequences, split alignments of consensus, consistency of breakpoint groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import fetch
from . import cigar as cg
from .breakpoints import alike
from .intervals import merge, overlap_join

# Support


def recount_support(variants: DataFrame, signatures: DataFrame, reach: int = 300, size_ratio: float = 0.75) -> DataFrame:
    """Adds recounted: reads with one signature, or with neighbouring ones in sum, of the variant's size.

    ``variants``: chrom, start, end, svtype, sv_len; ``signatures``: qname, chrom, pos, op, len.
    Per read the signatures of the variant's kind within reach are added up; the read counts if
    the largest of them, or their sum, is alike.
    """
    spots = signatures.select("qname", "chrom", F.col("pos").alias("start"), F.when(F.col("op") == "D", F.col("pos") + F.col("len") - 1).otherwise(F.col("pos")).alias("end"), "op", "len")
    keys = ["chrom", "start", "end", "svtype", "sv_len"]
    met = overlap_join(variants.select(*keys).distinct(), spots, 10_000, reach, reach)
    met = met.filter(F.col("b_op") == F.when(F.col("svtype") == "DEL", "D").otherwise("I"))
    reads = met.groupBy(*keys, "b_qname").agg(F.max("b_len").alias("most"), F.sum("b_len").alias("sum"))
    size = F.abs("sv_len")
    alike = lambda x: F.least(x, size) >= size_ratio * F.greatest(x, size)
    counted = reads.filter(alike(F.col("most")) | alike(F.col("sum"))).groupBy(*keys).agg(F.count_distinct("b_qname").cast("int").alias("recounted"))
    return variants.join(counted, keys, "left").withColumn("recounted", F.coalesce("recounted", F.lit(0)))


def sums_by_read(signatures: DataFrame, keys: list[str]) -> DataFrame:
    """Inserted and deleted bases of each read in each key."""
    of = lambda op: F.coalesce(F.sum(F.when(F.col("op") == op, F.col("len"))), F.lit(0))
    return signatures.groupBy(*keys, "qname").agg(of("I").alias("ins_sum"), of("D").alias("del_sum"))


def finished_and_failed(ledger: DataFrame) -> DataFrame:
    """How many works a ledger has as done and as failed."""
    return ledger.agg(F.count_if(F.col("status") == "DONE").alias("done"), F.count_if(F.col("status") != "DONE").alias("failed"))


# Neighbours


def merge_neighbour_signatures(signatures: DataFrame, keys: list[str], near: int = 50, far: int = 200, size_ratio: float = 0.2) -> DataFrame:
    """Signatures of one kind side by side in a read become one of their summed length.

    Always within ``near`` bases; up to ``far`` if the shorter is at least ``size_ratio`` of the
    longer. Runs of joined neighbours are islands in order, so three become one as two do.
    """
    order = Window.partitionBy(*keys, "op").orderBy("pos", "len")
    ends = F.when(F.col("op") == "D", F.col("pos") + F.col("len")).otherwise(F.col("pos"))
    rows = signatures.withColumn("__end", ends).withColumn("__gap", F.col("pos") - F.lag("__end").over(order)).withColumn("__l", F.lag("len").over(order))
    joins = (F.col("__gap") <= near) | ((F.col("__gap") <= far) & (F.least("len", "__l") >= size_ratio * F.greatest("len", "__l")))
    rows = rows.withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("__g", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("seq", F.lit("")).alias("seq"))))
    return rows.groupBy(*keys, "op", "__g").agg(F.min("pos").alias("pos"), F.sum("len").cast("int").alias("len"), F.array_join(F.transform(parts, lambda x: x["seq"]), "").alias("seq"), F.count(F.lit(1)).alias("members")).drop("__g")


def merge_neighbour_variants(calls: DataFrame, keys: list[str] = ["region_id", "cluster_id"], near: int = 100) -> DataFrame:  # noqa: B006
    """Calls of one type on one consensus within ``near`` bases become one of their summed length."""
    order = Window.partitionBy(*keys, "svtype").orderBy("start", "end")
    gap = F.col("start") - F.lag("end").over(order)
    rows = calls.withColumn("__new", F.when(F.coalesce(gap <= near, F.lit(False)), 0).otherwise(1)).withColumn("__g", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "svtype", "__g").agg(F.min("chrom").alias("chrom"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("sv_len").cast("int").alias("sv_len"), F.max("support").alias("support"), F.count(F.lit(1)).alias("members")).drop("__g")


def merge_half_translocations(rows: DataFrame, near: int = 50) -> DataFrame:
    """Records that name the same two contigs and nearly the same ends are one, of the larger support."""
    swap = F.struct("chrom2", "end") < F.struct(F.col("chrom"), F.col("start"))
    turned = rows.select(F.when(swap, F.col("chrom2")).otherwise(F.col("chrom")).alias("chrom"), F.when(swap, F.col("end")).otherwise(F.col("start")).alias("start"), F.when(swap, F.col("chrom")).otherwise(F.col("chrom2")).alias("chrom2"), F.when(swap, F.col("start")).otherwise(F.col("end")).alias("end"), "support")
    best = F.struct("support", (-F.col("start")).alias("s"), (-F.col("end")).alias("e"))
    return alike(turned, ["chrom", "chrom2"], near).groupBy("chrom", "chrom2", "__alike").agg(F.max_by("start", best).alias("start"), F.max_by("end", best).alias("end"), F.max("support").alias("support")).drop("__alike")


def extend_zero_runs(zero: DataFrame, regions: DataFrame) -> DataFrame:
    """Uncovered runs joined with the candidate regions that touch them, as one interval each."""
    met = overlap_join(zero, regions.select("chrom", "start", "end"), 10_000, 1, 1)
    wide = met.groupBy("chrom", "start", "end").agg(F.min("b_start").alias("a"), F.max("b_end").alias("b")).select("chrom", F.least("start", "a").alias("start"), F.greatest("end", "b").alias("end"))
    return merge(zero.select("chrom", "start", "end").unionByName(wide)).select("chrom", "start", "end")


# Sequences


def padded_pairs(pairs: DataFrame, tiles: DataFrame, tile: int) -> DataFrame:
    """Adds comp_a, comp_b: both inserted sequences with the reference between their places.

    ``pairs``: chrom, pos_a, seq_a, pos_b, seq_b. An insertion at the earlier place is followed
    by the reference up to the later one, the other preceded by it, so equal haplotypes compare
    equal wherever an aligner put the insertion.
    """
    low, high = F.least("pos_a", "pos_b"), F.greatest("pos_a", "pos_b")
    spots = pairs.withColumn("__low", low).withColumn("__high", high)
    between = spots.filter("__high > __low").select("chrom", F.col("__low").alias("start"), (F.col("__high") - 1).alias("end")).distinct()
    bases = fetch(tiles, between, tile).select("chrom", F.col("start").alias("__low"), (F.col("end") + 1).alias("__high"), F.upper("ref_seq").alias("__ref"))
    rows = spots.join(bases, ["chrom", "__low", "__high"], "left").withColumn("__ref", F.coalesce("__ref", F.lit("")))
    first = F.col("pos_a") <= F.col("pos_b")
    a = F.when(first, F.concat("seq_a", "__ref")).otherwise(F.concat("__ref", "seq_a"))
    b = F.when(first, F.concat("__ref", "seq_b")).otherwise(F.concat("seq_b", "__ref"))
    return rows.withColumn("comp_a", a).withColumn("comp_b", b).drop("__low", "__high", "__ref")


def smoothed(runs: DataFrame, min_size: int, keys: list[str] = ["qname", "chrom"]) -> DataFrame:  # noqa: B006
    """Each read without its small errors: mismatches as the reference has them, short indels undone.

    ``runs`` have run_seq, and ref_run (the reference under the run) for X and D runs.
    """
    text = F.when(F.col("op").isin("=", "M"), F.col("run_seq")).when(F.col("op") == "X", F.col("ref_run")).when((F.col("op") == "I") & (F.col("len") >= min_size), F.col("run_seq")).when((F.col("op") == "D") & (F.col("len") < min_size), F.col("ref_run")).otherwise("")
    parts = F.array_sort(F.collect_list(F.struct("idx", F.coalesce(text, F.lit("")).alias("t"))))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("seq"))


def clip_signatures(segs: DataFrame, min_clip: int) -> DataFrame:
    """Clip signatures of segments, and inversion marks between them, for clustering beside indels.

    op C: a clip (len its size, mate the contig that the read goes on in), op V: a turn of the
    read (len the distance to it).
    """
    w = Window.partitionBy("qname").orderBy(F.least("query_start", "query_end"), "chrom", "ref_start")
    rows = segs.withColumn("__next", F.lead(F.struct("chrom", "ref_start", "orient")).over(w)).withColumn("__prev", F.lag(F.struct("chrom", "ref_start", "orient")).over(w))
    plus = F.col("orient") == "+"
    side = lambda left: F.when(plus, F.col("__prev.chrom") if left else F.col("__next.chrom")).otherwise(F.col("__next.chrom") if left else F.col("__prev.chrom"))
    clips = [
        rows.filter(F.col(f"{s}_clip") >= min_clip).select("qname", "chrom", F.col("ref_start" if s == "left" else "ref_end").alias("pos"), F.lit("C").alias("op"), F.col(f"{s}_clip").alias("len"), F.coalesce(side(s == "left"), F.lit("")).alias("mate"))
        for s in ("left", "right")
    ]
    turns = rows.filter((F.col("__next.chrom") == F.col("chrom")) & (F.col("__next.orient") != F.col("orient"))).select("qname", "chrom", F.when(plus, F.col("ref_end")).otherwise(F.col("ref_start")).alias("pos"), F.lit("V").alias("op"), F.abs(F.col("__next.ref_start") - F.col("ref_start")).cast("int").alias("len"), F.col("__next.chrom").alias("mate"))
    return clips[0].unionByName(clips[1]).unionByName(turns)


def split_alignment_indels(paf: DataFrame, min_size: int, size_ratio: float = 0.95) -> DataFrame:
    """Indels between neighbouring alignments of one consensus: the read's gap less the reference's.

    Of calls of nearly the same size at nearly the same place the first stays, in order of start,
    consensus and size.
    """
    w = Window.partitionBy("qname", "chrom", "strand").orderBy("qstart", "qend")
    rows = paf.filter(F.coalesce(F.col("type"), F.lit("P")) != "S").withColumn("__n", F.lead(F.struct("qstart", "start", "end")).over(w)).filter("__n is not null")
    query = F.col("__n.qstart") - F.col("qend") - 1
    forward = F.col("strand") == "+"
    reference = F.when(forward, F.col("__n.start") - F.col("end") - 1).otherwise(F.col("start") - F.col("__n.end") - 1)
    at = F.when(forward, F.col("end")).otherwise(F.col("__n.end"))
    rows = rows.select("qname", "chrom", (at + 1).alias("start"), (query - reference).cast("int").alias("sv_len")).filter(F.abs("sv_len") >= min_size)
    rows = rows.withColumn("svtype", F.when(F.col("sv_len") > 0, "INS").otherwise("DEL"))
    order = Window.partitionBy("chrom", "svtype").orderBy("start", "qname", "sv_len")
    before = F.lag(F.struct("start", "sv_len")).over(order)
    same = (F.col("start") - F.col("__b.start") <= 100) & (F.least(F.abs("sv_len"), F.abs("__b.sv_len")) > size_ratio * F.greatest(F.abs("sv_len"), F.abs("__b.sv_len")))
    return rows.withColumn("__b", before).filter(~F.coalesce(same, F.lit(False))).drop("__b").withColumn("end", F.when(F.col("svtype") == "DEL", F.col("start") - F.col("sv_len") - 1).otherwise(F.col("start")))


def members_of_groups(header_members: DataFrame, clusters: DataFrame, least: int = 3) -> DataFrame:
    """Which cluster a consensus stands for: the one that shares three reads with it, or all.

    ``header_members``: cns_id, qname; ``clusters``: region_id, cluster_id, qname.
    """
    size = header_members.groupBy("cns_id").agg(F.count_distinct("qname").alias("n"))
    shared = header_members.join(clusters, "qname").groupBy("cns_id", "region_id", "cluster_id").agg(F.count_distinct("qname").alias("shared")).join(size, "cns_id")
    rank = F.row_number().over(Window.partitionBy("cns_id").orderBy(F.col("shared").desc(), "region_id", "cluster_id"))
    return shared.filter(F.col("shared") >= F.least(F.lit(least), F.col("n"))).withColumn("__r", rank).filter("__r = 1").drop("__r", "n")


def outermost(paf: DataFrame) -> DataFrame:
    """Leftmost and rightmost alignment of each consensus on the reference."""
    item = F.struct("start", "end", "qstart", "qend", "strand")
    return paf.groupBy("qname", "chrom").agg(F.min_by(item, "start").alias("left"), F.max_by(item, "end").alias("right"))


def consensus_flank(length: Column, clip_region: bool) -> Column:
    """Bases around a region that its consensus work takes in, by the size of its variants."""
    if clip_region:
        return 5_000 * F.when((length > 6_000) | (length == 0), 4).when(length > 4_000, 3).when(length > 2_000, 2).when(length > 1_000, 1.5).otherwise(1)
    return 1_000 * F.when(length > 1_000, 6).when(length > 500, 3).otherwise(1) + length


def clip_works(groups: DataFrame, joint: int = 100_000) -> DataFrame:
    """Works of breakpoint groups: one over both sides if they are near, else one a side."""
    near = (F.col("chrom") == F.col("chrom2")) & (F.col("high2") - F.col("low") <= joint)
    one = F.array(F.struct("chrom", F.col("low").alias("start"), F.col("high2").alias("end")))
    two = F.array(F.struct("chrom", F.col("low").alias("start"), F.col("high").alias("end")), F.struct(F.col("chrom2").alias("chrom"), F.col("low2").alias("start"), F.col("high2").alias("end")))
    return groups.select("group_id", F.explode(F.when(near, one).otherwise(two)).alias("w")).select("group_id", "w.*")


# Groups


def overlapping_groups(sides: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """Pairs of groups of one type of which every side of the smaller meets a side of the larger.

    ``sides``: group_id, svtype, side_id, chrom, start, end.
    """
    met = overlap_join(sides, sides if other is None else other, 10_000).filter("group_id < b_group_id and svtype = b_svtype")
    pairs = met.groupBy("group_id", "b_group_id").agg(F.count_distinct("side_id").alias("n1"), F.count_distinct("b_side_id").alias("n2"))
    count = sides.groupBy("group_id").agg(F.count_distinct("side_id").alias("n"))
    pairs = pairs.join(count, "group_id").join(count.select(F.col("group_id").alias("b_group_id"), F.col("n").alias("b_n")), "b_group_id")
    return pairs.filter(F.least("n1", "n2") >= F.least("n", "b_n")).select("group_id", "b_group_id")


def top_mates(support: DataFrame, share: float = 0.1, most: int = 2) -> DataFrame:
    """Of each side's mates the strongest two that have a tenth of its support each."""
    w = Window.partitionBy("group_id", "side_id", "end")
    rank = F.row_number().over(w.orderBy(F.col("support").desc(), "mate_side_id"))
    rows = support.withColumn("__t", F.sum("support").over(w)).withColumn("__r", rank)
    return rows.filter((F.col("__r") <= most) & (F.col("support") >= share * F.col("__t"))).drop("__t", "__r")


def consistent_links(links: DataFrame) -> DataFrame:
    """Links whose mate links back to the same side."""
    back = links.select("group_id", F.col("mate_side_id").alias("side_id"), F.col("side_id").alias("mate_side_id")).distinct()
    return links.join(back, ["group_id", "side_id", "mate_side_id"], "left_semi")


def mated_sides(sides: DataFrame, links: DataFrame) -> DataFrame:
    """Sides that some link names, from either end."""
    named = links.select("group_id", "side_id").unionByName(links.select("group_id", F.col("mate_side_id").alias("side_id"))).distinct()
    return sides.join(named, ["group_id", "side_id"], "left_semi")


def valid_clip_regions(segs: DataFrame, regions: DataFrame, share: float = 0.5) -> DataFrame:
    """Clip regions where enough own (not only told) segments are at least half their read."""
    met = overlap_join(regions, segs.select("chrom", F.col("ref_start").alias("start"), F.col("ref_end").alias("end"), "query_start", "query_end", "query_len", "from_sa"), 10_000)
    long = (F.abs(F.col("b_query_end") - F.col("b_query_start")) + 1) * 2 >= F.col("b_query_len")
    good = met.filter("not b_from_sa").groupBy(*regions.columns).agg((F.count_if(long) / F.count(F.lit(1))).alias("__s")).filter(F.col("__s") >= share)
    return good.drop("__s")


def duplication_number(reads: DataFrame) -> DataFrame:
    """Copies of a duplication: the most that a read steps back, and one."""
    return reads.groupBy("group_id", "qname").agg(F.count_if("turned_back").alias("n")).groupBy("group_id").agg(F.max("n").cast("int").alias("dup_num"))


def consistent_positions(positions: DataFrame, within: int = 1_000) -> DataFrame:
    """Clip positions near the median of their side, the side of most support kept where a read has two."""
    w = Window.partitionBy("group_id", "side_id")
    rows = positions.withColumn("__m", F.median("pos").over(w)).withColumn("__n", F.count(F.lit(1)).over(w)).filter(F.abs(F.col("pos") - F.col("__m")) <= within)
    rank = F.row_number().over(Window.partitionBy("group_id", "qname", "end").orderBy(F.col("__n").desc(), F.abs(F.col("pos") - F.col("__m")), "side_id"))
    return rows.withColumn("__r", rank).filter("__r = 1").drop("__m", "__n", "__r")


# Dormant in the surveyed pipeline


def single_base_candidates(pile: DataFrame, share: float = 0.3, least: int = 3) -> DataFrame:
    """Positions where a base other than the reference's has enough reads and no indel is near."""
    best = F.greatest(*(F.when(F.col("ref") == b, 0).otherwise(F.col(f"x_{b.lower()}")) for b in "ACGT"))
    return pile.filter((best >= least) & (best >= share * F.col("depth")) & (F.col("n_ins") + F.col("del_spread") < least)).select("chrom", "pos", "ref", best.alias("support"), "depth")


def coverage_lines(cover: DataFrame) -> DataFrame:
    """Coverage as text lines: contig, start, end, depth."""
    return cover.orderBy("chrom", "start").select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), F.col("depth").cast("string")).alias("line"))


def paf_runs(paf: DataFrame) -> DataFrame:
    """Runs of consensus alignments; on the minus strand query positions count from the other end."""
    rows = cg.aligned_runs(paf.withColumn("pos", F.col("start")), seq=None)
    flip = F.col("strand") == "-"
    return rows.withColumn("qpos", F.when(flip, F.col("qend") - F.col("qpos") - F.when(F.col("op").isin("M", "=", "X", "I"), F.col("len")).otherwise(0) + 2).otherwise(F.col("qstart") + F.col("qpos") - 1))
