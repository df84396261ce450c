"""Breakpoint groups from split reads: sides, links, types, large indels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import splitreads as sr
from . import windows


def junctions(segs: DataFrame, min_clip: int = 200) -> DataFrame:
    """Both places of every step from one segment of a read to the next.

    The place that comes first on the reference is side 1. ``end`` tells which end of its
    segment a place is (L or R); ``gap`` is the read's gap less the reference's.
    """
    rows = sr.ordered(segs).filter("prev is not null")
    plus, before = F.col("orient") == "+", F.col("prev.orient") == "+"
    leave = F.struct(F.col("prev.chrom").alias("chrom"), F.when(before, F.col("prev.ref_end")).otherwise(F.col("prev.ref_start")).alias("pos"), F.when(before, "R").otherwise("L").alias("end"))
    enter = F.struct("chrom", F.when(plus, F.col("ref_start")).otherwise(F.col("ref_end")).alias("pos"), F.when(plus, "L").otherwise("R").alias("end"))
    forward = F.when(plus, enter["pos"] - leave["pos"] - 1).otherwise(leave["pos"] - enter["pos"] - 1)
    straight = (F.col("chrom") == F.col("prev.chrom")) & (F.col("orient") == F.col("prev.orient"))
    rows = rows.select("qname", F.least(leave, enter).alias("one"), F.greatest(leave, enter).alias("two"), straight.alias("straight"), F.when(straight, F.col("query_gap") - forward).alias("gap"), F.col("query_len"))
    return rows.select("qname", F.col("one.chrom").alias("chrom"), F.col("one.pos").alias("pos"), F.col("one.end").alias("end_type"), F.col("two.chrom").alias("chrom2"), F.col("two.pos").alias("pos2"), F.col("two.end").alias("end_type2"), "straight", "gap")


def side_places(joins: DataFrame, gap: int = 300) -> DataFrame:
    """Places of either side that lie within ``gap`` of each other, as numbered runs."""
    places = joins.select("chrom", "pos").unionByName(joins.select(F.col("chrom2").alias("chrom"), F.col("pos2").alias("pos"))).distinct()
    order = Window.partitionBy("chrom").orderBy("pos")
    opens = F.when(F.col("pos") - F.lag("pos").over(order) <= gap, 0).otherwise(1)
    return places.withColumn("opens", opens).withColumn("place", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def groups(joins: DataFrame, gap: int = 300) -> DataFrame:
    """One row a pair of places that junctions link.

    Straight junctions whose gap is an indel's are kept apart from steps back and turns.
    """
    places = side_places(joins, gap)
    rows = joins.join(places.withColumnRenamed("place", "p1"), ["chrom", "pos"]).join(places.select(F.col("chrom").alias("chrom2"), F.col("pos").alias("pos2"), F.col("place").alias("p2")), ["chrom2", "pos2"])
    span = F.col("pos2") - F.col("pos")
    is_indel = F.col("straight") & ((F.col("end_type") == "R") & (F.col("end_type2") == "L") | (F.abs(span) < 50))
    kind = F.when(F.col("chrom") != F.col("chrom2"), "TRA").when(is_indel, "INDEL").when(F.col("straight"), "DUP").otherwise("INV")
    g = rows.withColumn("kind", kind).groupBy("chrom", "p1", "chrom2", "p2", "kind").agg(
        F.count_distinct("qname").alias("support"), F.round(F.avg("pos")).cast("long").alias("start"), F.round(F.avg("pos2")).cast("long").alias("end"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.min("pos2").alias("low2"), F.max("pos2").alias("high2"),
        F.expr("cast(sum(gap) / count(gap) as int)").alias("mean_gap"), F.count_if(F.col("gap") > 0).alias("n_ins"), F.count_if(F.col("gap") < 0).alias("n_del"), F.collect_set("qname").alias("reads"),
        F.count_if(F.col("end_type") == "R").alias("right1"), F.count_if(F.col("end_type2") == "R").alias("right2"), F.count(F.lit(1)).alias("n"),
    )
    # Copies of a duplication: the most steps back that a read makes, and one.
    keys = ["chrom", "p1", "chrom2", "p2", "kind"]
    steps = rows.withColumn("kind", kind).filter("kind = 'DUP'").groupBy(*keys, "qname").agg(F.count(F.lit(1)).alias("steps"))
    copies = steps.groupBy(*keys).agg((F.max("steps") + 1).cast("int").alias("dup_num"))
    return g.join(copies, keys, "left").withColumn("group_id", F.xxhash64(*keys))


def votes(group: DataFrame, segs: DataFrame, minimum: int) -> DataFrame:
    """Types of groups by the votes of their reads' features; beside what the junctions say.

    Features look at a read's segments around the group's two means. Groups of one read set are
    settled once; a group whose reads don't agree is dropped as UNC.
    """
    reads = group.select("group_id", "start", "end", F.explode("reads").alias("qname"))
    met = reads.join(segs, "qname")
    keyed = met.withColumn("__q", F.col("qname")).withColumn("qname", F.concat_ws("\t", "group_id", "__q"))
    facts = sr.features(keyed, F.col("start"), F.col("end"), ["qname", "group_id", "__q", "start", "end"])
    per = facts.withColumn("vote", sr.vote()).groupBy("group_id").agg(*(F.count_if(F.col("vote") == v).alias(v.lower()) for v in ("DUP", "INV", "TRA")))
    rows = group.join(per, "group_id", "left").fillna(0, ["dup", "inv", "tra"])
    cross = F.col("chrom") != F.col("chrom2")
    decided = sr.decide(F.col("dup"), F.col("inv"), F.col("tra"), F.lit(minimum), cross, F.abs(F.col("end") - F.col("start")))
    return rows.withColumn("svtype", F.when(F.col("kind") == "INDEL", "INDEL").when(F.col("kind") == decided, decided).when(F.col("support") >= minimum, F.col("kind")).otherwise("UNC"))


def large_indels(group: DataFrame, minimum: int, min_size: int, max_size: int) -> DataFrame:
    """Insertions and deletions that reads step over: sign by majority, mean size, whole bases."""
    rows = group.filter((F.col("kind") == "INDEL") & (F.greatest("n_ins", "n_del") >= F.floor(F.lit(minimum / 2))))
    ins = F.col("n_ins") >= F.col("n_del")
    size = F.abs("mean_gap")
    rows = rows.withColumn("svtype", F.when(ins, "INS").otherwise("DEL")).withColumn("sv_len", F.when(ins, size).otherwise(-size))
    return rows.filter((size >= min_size) & (size <= max_size))


def links(group: DataFrame) -> DataFrame:
    """Breakend links of a group's sides: which end joins which, from which orientation.

    The pieces of the link text: group, side, end, mate side, same orientation, place, support.
    """
    sides = [(0, "start", "right1", 1), (1, "end", "right2", 0)]
    out = None
    for side, pos, right, mate in sides:
        at_right = F.col(right) * 2 >= F.col("n")
        part = group.select("group_id", F.lit(side).alias("side_id"), F.when(at_right, "R").otherwise("L").alias("end"), F.lit(mate).alias("mate_side_id"), ((F.col("right1") * 2 >= F.col("n")) != (F.col("right2") * 2 >= F.col("n"))).alias("same_orient"), F.col(pos).alias("pos"), "support", F.greatest("support", F.coalesce("depth", F.lit(0))).alias("coverage"))
        out = part if out is None else out.unionByName(part)
    return out


def link_text(rows: DataFrame) -> DataFrame:
    """group_id, side_id and the text form: right-end link, left-end link; a dash for none."""
    one = F.concat(F.col("mate_side_id").cast("string"), F.when(F.col("same_orient"), "+").otherwise("-"), F.lit("|"), F.col("pos").cast("string"), F.lit("|"), F.col("support").cast("string"), F.lit("|"), F.col("coverage").cast("string"))
    of = lambda e: F.coalesce(F.array_join(F.array_sort(F.collect_list(F.when(F.col("end") == e, one))), "_"), F.lit(""))
    dash = lambda c: F.when(c == "", "-").otherwise(c)
    return rows.groupBy("group_id", "side_id").agg(F.concat_ws(",", dash(of("R")), dash(of("L"))).alias("text"))


def parse_links(rows: DataFrame) -> DataFrame:
    """The text form back into one row a link."""
    pairs = rows.select("group_id", "side_id", F.posexplode(F.split("text", ",")).alias("slot", "x")).filter("x <> '-'")
    one = pairs.select("group_id", "side_id", F.when(F.col("slot") == 0, "R").otherwise("L").alias("end"), F.explode(F.split("x", "_")).alias("y")).withColumn("f", F.split("y", "[|]"))
    return one.select("group_id", "side_id", "end", F.regexp_extract(F.col("f")[0], "^([0-9]+)", 1).cast("int").alias("mate_side_id"), F.col("f")[0].endswith("+").alias("same_orient"), F.col("f")[1].cast("long").alias("pos"), F.col("f")[2].cast("long").alias("support"), F.col("f")[3].cast("long").alias("coverage"))


def support_and_coverage(rows: DataFrame) -> DataFrame:
    """Least support over a group's linked sides (mates of a side added up) and most coverage."""
    side = rows.groupBy("group_id", "side_id", "end").agg(F.sum("support").alias("s"), F.max("coverage").alias("c"))
    return side.groupBy("group_id").agg(F.min("s").alias("support"), F.max("c").alias("coverage"))


def modal_place(positions: DataFrame, keys: list[str], gap: int = 1000) -> DataFrame:
    """Largest run of places of each key: its contig and mean place; the first of equal ones."""
    found = windows.runs(positions, [*keys, "chrom"], "pos", gap, [F.round(F.avg("pos")).cast("long").alias("mean_pos")])
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), "chrom", "start"))
    return found.withColumn("__r", rank).filter("__r = 1").drop("__r")


def balanced(n1: Column, n2: Column, ratio: float = 0.1, least: int = 1) -> Column:
    """Both sides have reads enough, alone and beside each other."""
    return (F.least(n1, n2) >= least) & (F.least(n1, n2) >= ratio * F.greatest(n1, n2))


def ultra_large(start: Column, end: Column, limit: int = 100_000) -> Column:
    return F.abs(end - start) > limit


def alike(rows: DataFrame, keys: list[str], near: int) -> DataFrame:
    """Adds __alike: one number for the rows of a key whose starts, and among these whose ends, follow each other within ``near``."""
    for k, c in enumerate(("start", "end")):
        named = [*keys, *(f"__run{i}" for i in range(k))]
        order = Window.partitionBy(*named).orderBy(c)
        rows = rows.withColumn("__opens", F.when(F.col(c) - F.lag(c).over(order) <= near, 0).otherwise(1))
        rows = rows.withColumn(f"__run{k}", F.sum("__opens").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("__alike", F.struct("__run0", "__run1")).drop("__opens", "__run0", "__run1")


def strongest(rows: DataFrame, near: int = 50) -> DataFrame:
    """Of groups with one type and nearly the same ends, the one with most support."""
    keys = ["svtype", "chrom", "chrom2"]
    rank = F.row_number().over(Window.partitionBy(*keys, "__alike").orderBy(F.col("support").desc(), "start", "end"))
    return alike(rows, keys, near).withColumn("__r", rank).filter("__r = 1").drop("__r", "__alike")
