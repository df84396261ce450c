"""More operators on generic tables: alignments, pileups, breakpoints, files and writers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions import sequence as seq
from ..operators import breakpoints as bp
from ..operators import call, cluster, detect, intervals, pileup, refine, splitreads
from ..operators import cigar as cg
from ..sources import alignments as al
from ..sources import files, writers
from .driver_queries import alignments, query, shipments, table, user_events
from .storage import written_lines

# Alignments and segments


def reads(spark: SparkSession, d: str) -> DataFrame:
    """Alignments whose bases are all A, with a flag, a quality and, for some, a tag."""
    c = F.col
    rows = alignments(spark, d)
    bases = cg.total(cg.operations(c("cigar")), cg.ON_QUERY)
    flag = F.when(c("strand") == "-", 16).otherwise(0) + F.when((c("chrom") % 2 == 0) & (c("l_linenumber") == 7), 256).otherwise(0)
    return rows.select(c("l_orderkey").cast("string").alias("qname"), "l_linenumber", flag.alias("flag"), F.concat(F.lit("c"), c("chrom") % 3).alias("chrom"), "pos", (c("l_linenumber") * 10).cast("int").alias("mapq"), "cigar", F.repeat(F.lit("A"), bases.cast("int")).alias("seq"), F.lit(0).alias("nm"), F.lit(None).cast("string").alias("md"), F.when(c("l_linenumber") == 1, "x").alias("sa"))


READS = """(SELECT l_orderkey || '' AS qname, l_linenumber, 'c' || (chrom % 3) AS chrom, pos, strand, a, b, c, d, e, f, l_linenumber * 10 AS mapq, pos + b + d + e + 2 AS "end", a + b + c + d + 3 AS bases, chrom % 2 = 0 AND l_linenumber = 7 AS secondary FROM @alignments)"""


def segs(spark: SparkSession, d: str) -> DataFrame:
    return splitreads.segments(reads(spark, d).withColumn("sa", F.lit(None).cast("string")))


@query(f"""SELECT qname, l_linenumber, pos AS start, "end" FROM {READS} WHERE mapq >= 30 AND NOT secondary""")
def usable_alignments(spark, d):
    return al.with_ends(al.usable(reads(spark, d), 30)).select("qname", "l_linenumber", "start", "end")


@query(f"""SELECT chrom, CAST(sum(bases) AS BIGINT) AS bases, count(*) AS reads, max("end") - min(pos) + 1 AS span, avg(bases) AS mean_read_len, 4.0::DOUBLE * sum(bases) / greatest(max("end") - min(pos) + 1, 1) AS coverage FROM {READS} GROUP BY chrom""")
def local_coverage(spark, d):
    return al.local_coverage(al.with_ends(reads(spark, d)), ["chrom"])


@query(f"""
WITH r AS (SELECT *, ((c >= 4)::INTEGER + (e >= 4)::INTEGER) * 1000.0::DOUBLE / greatest("end" - pos + 1, 1) AS density FROM {READS}),
q AS (SELECT qname, max(density) AS most, bool_or("end" - pos < 30 AND density > 45) AS bad, bool_and(l_linenumber <> 1) AS alone FROM r GROUP BY qname)
SELECT r.qname, l_linenumber, density FROM r JOIN q ON q.qname = r.qname WHERE NOT bad AND (most <= 45 OR (alone AND most <= 67.5))
""")
def dense_reads(spark, d):
    rows = al.with_ends(reads(spark, d))
    return al.drop_dense_reads(rows, 45.0, 4, 30).select("qname", "l_linenumber", al.signature_density(rows, 4).alias("density"))


@query(f"SELECT qname, l_linenumber FROM {READS} WHERE qname IN (SELECT o_orderkey || '' FROM orders WHERE o_orderstatus = 'F')")
def named_reads(spark, d):
    names = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("qname"))
    return al.named(reads(spark, d), names).select("qname", "l_linenumber")


@query(f"""SELECT qname, l_linenumber FROM {READS} AS r WHERE NOT EXISTS (SELECT 1 FROM (SELECT chrom, floor(pos / 100.0) AS t FROM {READS} GROUP BY 1, 2 HAVING sum("end" - pos + 1) / 100.0 > 12) AS k WHERE k.chrom = r.chrom AND k.t = floor(r.pos / 100.0))""")
def deep_tiles(spark, d):
    return al.skip_ultra_deep(al.with_ends(reads(spark, d)), 12.0, 100).select("qname", "l_linenumber")


@query(f"""
SELECT qname || '/' || l_linenumber AS qname, chrom, pos AS ref_start, "end" AS ref_end, CASE WHEN strand = '-' THEN b + c + d + 3 + f ELSE a + 1 END AS query_start, strand AS orient, FALSE AS from_sa FROM {READS} UNION ALL
SELECT qname || '/' || l_linenumber, 'd' || l_linenumber, pos + 9, "end" + 9, CASE WHEN strand = '-' THEN a + 1 ELSE b + c + d + 3 + f END, CASE WHEN strand = '-' THEN '+' ELSE '-' END, TRUE FROM {READS} WHERE mapq >= 20
""")
def split_tags(spark, d):
    """Segments of alignments, and those that only their tags tell of; a tag that repeats its own alignment adds none.

    Each row is a read of its own, also where rows repeat an order and a line.
    """
    number = F.row_number().over(Window.partitionBy("qname", "l_linenumber").orderBy("chrom", "pos", "flag", "cigar"))
    rows = reads(spark, d).withColumn("qname", F.concat_ws("/", "qname", F.col("l_linenumber").cast("string"), number.cast("string")))
    minus = F.col("flag").bitwiseAND(16) != 0
    other = F.concat_ws(",", F.concat(F.lit("d"), F.col("l_linenumber")), (F.col("pos") + 9).cast("string"), F.when(minus, "+").otherwise("-"), "cigar", F.col("mapq").cast("string"), F.lit("0"))
    own = F.concat_ws(",", "chrom", F.col("pos").cast("string"), F.when(minus, "-").otherwise("+"), "cigar", F.col("mapq").cast("string"), F.lit("0"))
    found = splitreads.segments(rows.withColumn("sa", F.concat(other, F.lit(";;"), own, F.lit(";"))), 20)
    return found.select(F.substring_index("qname", "/", 2).alias("qname"), "chrom", "ref_start", "ref_end", "query_start", "orient", "from_sa")


_ORDERED = "(SELECT *, least(query_start, query_end) AS low, greatest(query_start, query_end) AS high FROM @segments)"
_BY_READ = "(PARTITION BY qname ORDER BY low, high, chrom, ref_start)"


@query(f"""SELECT qname, chrom, ref_start, CAST(row_number() OVER w AS INTEGER) AS rank, row_number() OVER w = 1 AS leftmost, low - lag(high) OVER w - 1 AS query_gap, lag(chrom) OVER w AS before FROM {_ORDERED} WINDOW w AS {_BY_READ}""")
def segment_adjacency(spark, d):
    return splitreads.ordered(segs(spark, d)).select("qname", "chrom", "ref_start", "rank", "leftmost", "query_gap", F.col("prev.chrom").alias("before"))


@query("""SELECT qname, chrom, ref_start, query_start FROM (SELECT *, max(abs(query_end - query_start) + 1) OVER (PARTITION BY qname) AS m FROM @segments) WHERE m >= 0.98::DOUBLE * query_len OR m >= 60""")
def small_primaries(spark, d):
    return splitreads.drop_small_primaries(segs(spark, d), 0.98, 60).select("qname", "chrom", "ref_start", "query_start")


@query("""SELECT qname, chrom, ref_start, query_start FROM @segments WHERE chrom = 'c1' OR (mapq >= 30 AND ref_end - ref_start + 1 >= 40)""")
def foreign_segments(spark, d):
    return splitreads.drop_foreign(segs(spark, d), "c1", 30, 40).select("qname", "chrom", "ref_start", "query_start")


@query(f"""
WITH s AS (SELECT *, min(ref_start) OVER (PARTITION BY qname) AS p1, max(ref_end) OVER (PARTITION BY qname) AS p2 FROM {_ORDERED}),
o AS (SELECT *, row_number() OVER w AS k, lag(chrom) OVER w AS pc, lag(ref_start) OVER w AS ps, lag(ref_end) OVER w AS pe, lag(orient) OVER w AS po FROM s WINDOW w AS {_BY_READ}),
f AS (SELECT *, pc = chrom AS beside, least(ref_end, pe) - greatest(ref_start, ps) AS overlap, CASE WHEN orient = '+' THEN pe ELSE ps END AS leaves, CASE WHEN orient = '+' THEN ref_start ELSE ref_end END AS enters FROM o),
g AS (SELECT *, beside AND po = orient AND CASE WHEN orient = '+' THEN enters < leaves ELSE enters > leaves END AS back FROM f),
h AS (SELECT qname, count(DISTINCT chrom) = 1 AS same_chrom, count(DISTINCT CASE WHEN ref_end - ref_start + 1 >= 30 THEN orient END) <= 1 AS same_orient, bool_or(coalesce(beside AND overlap >= 100, FALSE) OR coalesce(back, FALSE)) AS self_overlap,
  bool_and(CASE WHEN k > 1 THEN coalesce(beside AND overlap >= 1, FALSE) ELSE TRUE END) AS same_region, bool_or(abs(ref_start - p1) <= 100 OR abs(ref_end - p1) <= 100) AND bool_or(abs(ref_start - p2) <= 100 OR abs(ref_end - p2) <= 100) AS both_ends,
  bool_or(coalesce(back AND ((abs(leaves - p2) <= 100 AND abs(enters - p1) <= 100) OR (abs(leaves - p1) <= 100 AND abs(enters - p2) <= 100)), FALSE)) AS turn_round FROM g GROUP BY qname HAVING count(DISTINCT chrom) < 3)
SELECT *, CASE WHEN same_chrom AND same_orient AND both_ends AND turn_round THEN 'DUP' WHEN same_chrom AND NOT same_orient AND both_ends THEN 'INV' WHEN NOT self_overlap AND NOT same_region AND both_ends THEN 'TRA' ELSE 'UNC' END AS vote FROM h
""")
def read_features(spark, d):
    rows = segs(spark, d)
    whole = Window.partitionBy("qname")
    rows = rows.withColumn("p1", F.min("ref_start").over(whole)).withColumn("p2", F.max("ref_end").over(whole))
    facts = splitreads.features(rows, F.col("p1"), F.col("p2"), ["qname", "p1", "p2"], 30, 100)
    return facts.select("qname", "same_chrom", "same_orient", "self_overlap", "same_region", "both_ends", "turn_round", splitreads.vote().alias("vote"))


_JUNCTIONS = f"""(
  SELECT qname, CASE WHEN f THEN lc ELSE chrom END AS chrom, CASE WHEN f THEN lp ELSE ep END AS pos, CASE WHEN f THEN le ELSE ee END AS end_type, CASE WHEN f THEN chrom ELSE lc END AS chrom2, CASE WHEN f THEN ep ELSE lp END AS pos2, CASE WHEN f THEN ee ELSE le END AS end_type2, straight,
    CASE WHEN straight THEN gap - CASE WHEN orient = '+' THEN ep - lp - 1 ELSE lp - ep - 1 END END AS gap FROM (
    SELECT *, (lc, lp, le) <= (chrom, ep, ee) AS f, chrom = lc AND orient = po AS straight FROM (
      SELECT qname, chrom, orient, low - lag(high) OVER w - 1 AS gap, lag(chrom) OVER w AS lc, lag(orient) OVER w AS po, CASE WHEN lag(orient) OVER w = '+' THEN lag(ref_end) OVER w ELSE lag(ref_start) OVER w END AS lp, CASE WHEN lag(orient) OVER w = '+' THEN 'R' ELSE 'L' END AS le,
        CASE WHEN orient = '+' THEN ref_start ELSE ref_end END AS ep, CASE WHEN orient = '+' THEN 'L' ELSE 'R' END AS ee FROM {_ORDERED} WINDOW w AS {_BY_READ}) WHERE lc IS NOT NULL))"""


@query(f"SELECT qname, chrom, pos, end_type, chrom2, pos2, end_type2, straight, gap FROM {_JUNCTIONS}")
def junction_places(spark, d):
    return bp.junctions(segs(spark, d))


_GROUPS = f"""
WITH j AS (SELECT * FROM {_JUNCTIONS}),
p AS (SELECT chrom, pos, sum(opens) OVER (PARTITION BY chrom ORDER BY pos) AS place FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) <= 1 THEN 0 ELSE 1 END AS opens FROM (SELECT chrom, pos FROM j UNION SELECT chrom2, pos2 FROM j))),
k AS (SELECT j.*, x.place AS p1, y.place AS p2, CASE WHEN j.chrom <> chrom2 THEN 'TRA' WHEN straight AND ((end_type = 'R' AND end_type2 = 'L') OR abs(pos2 - j.pos) < 50) THEN 'INDEL' WHEN straight THEN 'DUP' ELSE 'INV' END AS kind
  FROM j JOIN p AS x ON x.chrom = j.chrom AND x.pos = j.pos JOIN p AS y ON y.chrom = chrom2 AND y.pos = pos2),
c AS (SELECT chrom, p1, chrom2, p2, CAST(max(n) + 1 AS INTEGER) AS dup_num FROM (SELECT chrom, p1, chrom2, p2, qname, count(*) AS n FROM k WHERE kind = 'DUP' GROUP BY ALL) GROUP BY ALL),
g AS (SELECT chrom, p1, chrom2, p2, kind, count(DISTINCT qname) AS support, CAST(round(avg(pos)) AS BIGINT) AS start, CAST(round(avg(pos2)) AS BIGINT) AS "end", min(pos) AS low, max(pos2) AS high2, CAST(trunc(sum(gap) / count(gap)) AS INTEGER) AS mean_gap, count(*) FILTER (gap > 0) AS n_ins, count(*) FILTER (gap < 0) AS n_del,
  count(*) FILTER (end_type = 'R') AS right1, count(*) AS n FROM k GROUP BY chrom, p1, chrom2, p2, kind)
"""


@query(f'{_GROUPS} SELECT g.chrom, g.chrom2, kind, support, start, "end", low, high2, mean_gap, n_ins, n_del, right1, n, CASE WHEN kind = \'DUP\' THEN dup_num END AS dup_num FROM g LEFT JOIN c ON c.chrom = g.chrom AND c.p1 = g.p1 AND c.chrom2 = g.chrom2 AND c.p2 = g.p2')
def breakpoint_groups(spark, d):
    return bp.groups(bp.junctions(segs(spark, d)), 1).select("chrom", "chrom2", "kind", "support", "start", "end", "low", "high2", "mean_gap", "n_ins", "n_del", "right1", "n", "dup_num")


@query(f"""{_GROUPS} SELECT chrom, start, "end", CASE WHEN n_ins >= n_del THEN 'INS' ELSE 'DEL' END AS svtype, CASE WHEN n_ins >= n_del THEN abs(mean_gap) ELSE -abs(mean_gap) END AS sv_len FROM g WHERE kind = 'INDEL' AND greatest(n_ins, n_del) >= 1 AND abs(mean_gap) BETWEEN 5 AND 400""")
def large_indels(spark, d):
    return bp.large_indels(bp.groups(bp.junctions(segs(spark, d)), 1), 2, 5, 400).select("chrom", "start", "end", "svtype", "sv_len")


def _two_sided(spark, d):
    return shipments(spark, d).join(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), ["l_orderkey", "l_linenumber"]).groupBy(F.col("l_partkey").alias("group_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("right1"), F.count_if(F.col("l_linestatus") == "F").alias("right2"), F.min("start").alias("start"), F.max("end").alias("end"), F.count_distinct("l_orderkey").alias("support"),
    ).withColumn("depth", F.col("n") + 2)


_SIDES = """(SELECT group_id, r1, r1 <> r2 AS same, start, "end", support, depth FROM (SELECT s.l_partkey AS group_id, count(*) FILTER (l_returnflag = 'R') * 2 >= count(*) AS r1, count(*) FILTER (l_linestatus = 'F') * 2 >= count(*) AS r2, min(start) AS start, max("end") AS "end", count(DISTINCT s.l_orderkey) AS support, count(*) + 2 AS depth
  FROM @shipments AS s JOIN lineitem AS l ON l.l_orderkey = s.l_orderkey AND l.l_linenumber = s.l_linenumber GROUP BY s.l_partkey))"""


@query(f"""
SELECT group_id, side_id, CASE WHEN r THEN one || ',-' ELSE '-,' || one END AS text FROM (
  SELECT group_id, 0 AS side_id, r1 AS r, '1' || CASE WHEN same THEN '+' ELSE '-' END || '|' || start || '|' || support || '|' || depth AS one FROM {_SIDES} UNION ALL
  SELECT group_id, 1, CASE WHEN same THEN NOT r1 ELSE r1 END, '0' || CASE WHEN same THEN '+' ELSE '-' END || '|' || "end" || '|' || support || '|' || depth FROM {_SIDES})
""")
def link_texts(spark, d):
    """The text of links whose second side's end is read back from the first: both sides' links and their text."""
    rows = bp.links(_two_sided(spark, d))
    # ``end`` of side 1 follows right2, and same_orient tells whether the two differ.
    return bp.link_text(rows)


@query(f"SELECT group_id, support, depth AS coverage FROM {_SIDES}")
def link_support(spark, d):
    return bp.support_and_coverage(bp.parse_links(bp.link_text(bp.links(_two_sided(spark, d)))))


# Runs and pileups


@query(f"""
WITH r AS (SELECT * FROM {READS}),
v AS (SELECT chrom, pos AS p, 'C' AS op, a AS len FROM r UNION ALL SELECT chrom, pos + b, 'I', c FROM r WHERE c >= 3 UNION ALL SELECT chrom, pos + b + d, 'D', e FROM r WHERE e >= 2 UNION ALL SELECT chrom, pos + b + d + e + unnest([0, 1, 2]), 'X', 1 FROM r UNION ALL SELECT chrom, pos + b + d + e + 2, 'C', f FROM r),
w AS (SELECT chrom, p, count(*) FILTER (op = 'X') AS x_a, count(*) FILTER (op = 'I') AS n_ins, count(*) FILTER (op = 'D') AS n_del, count(*) FILTER (op = 'C') AS n_clip, count(*) FILTER (op IN ('I', 'D') AND len >= 5) AS n_large, coalesce(sum(len) FILTER (op = 'I'), 0)::BIGINT AS ins_bases FROM v GROUP BY chrom, p),
s AS (SELECT chrom, p, count(*) AS del_spread FROM (SELECT chrom, p + unnest(range(CAST(len AS BIGINT))) AS p FROM v WHERE op = 'D') GROUP BY chrom, p),
u AS (SELECT chrom, p FROM w UNION SELECT chrom, p FROM s),
q AS (SELECT chrom, p, sum(x) AS x FROM (SELECT chrom, p, 0 AS x FROM u UNION ALL SELECT chrom, pos, 1 FROM r UNION ALL SELECT chrom, pos + b + d, -1 FROM r UNION ALL SELECT chrom, pos + b + d + e, 1 FROM r UNION ALL SELECT chrom, "end" + 1, -1 FROM r) GROUP BY chrom, p),
t AS (SELECT chrom, p, CAST(sum(x) OVER (PARTITION BY chrom ORDER BY p) AS BIGINT) AS depth FROM q)
SELECT u.chrom, u.p AS pos, depth, coalesce(x_a, 0) AS x_a, coalesce(n_ins, 0) AS n_ins, coalesce(n_del, 0) AS n_del, coalesce(n_clip, 0) AS n_clip, coalesce(n_large, 0) AS n_large, coalesce(ins_bases, 0) AS ins_bases, coalesce(del_spread, 0) AS del_spread, coalesce(n_ins, 0) AS modal_ins
FROM u JOIN t ON t.chrom = u.chrom AND t.p = u.p LEFT JOIN w ON w.chrom = u.chrom AND w.p = u.p LEFT JOIN s ON s.chrom = u.chrom AND s.p = u.p
""")
def pileup_counts(spark, d):
    runs = cg.aligned_runs(reads(spark, d).select("qname", "chrom", "pos", "cigar", "seq"))
    rows = pileup.pileup(runs, None, 5, 3, 2)
    return rows.select("chrom", "pos", F.col("depth").cast("long").alias("depth"), "x_a", "n_ins", "n_del", "n_clip", "n_large", F.col("ins_bases").cast("long").alias("ins_bases"), "del_spread", F.col("modal_ins").cast("long").alias("modal_ins"))


@query("SELECT sum(c + e + 3)::DOUBLE / sum(b + c + d + e + 3) AS error_rate FROM @alignments")
def error_rates(spark, d):
    return pileup.error_rate(cg.aligned_runs(alignments(spark, d), seq=None))


_CODES = {"A": "A", "C": "C", "G": "G", "T": "T", "N": "ACGT", "R": "AG", "Y": "CT", "K": "GT"}


@query("""
WITH p AS (SELECT l_partkey, count(*) FILTER (l_returnflag = 'A') AS n_a, count(*) FILTER (l_returnflag = 'N') AS n_c, count(*) FILTER (l_returnflag = 'R') AS n_g, count(*) AS depth, substr('ACGTNRYK', CAST(l_partkey % 8 + 1 AS INTEGER), 1) AS ref, count(*) FILTER (l_linenumber = 1) AS n_ins, count(*) FILTER (l_linenumber = 2) AS del_spread,
  count(*) FILTER (l_linenumber = 3) AS n_clip, count(*) FILTER (l_linenumber = 4) AS n_large, count(*) FILTER (l_linenumber >= 6) AS n_larger FROM lineitem GROUP BY l_partkey),
m AS (SELECT *, greatest(n_a, n_c, n_g) AS most, CASE WHEN n_a = greatest(n_a, n_c, n_g) THEN 'A' WHEN n_c = greatest(n_a, n_c, n_g) THEN 'C' ELSE 'G' END AS majority, (n_ins + del_spread + n_clip)::DOUBLE / greatest(depth, 1) AS ratio, n_ins::DOUBLE / greatest(depth, 1) AS i, del_spread::DOUBLE / greatest(depth + del_spread, 1) AS x FROM p)
SELECT l_partkey, majority, most <= 0.8::DOUBLE * depth OR NOT contains(CASE ref @codes END, majority) AS disagrees, ratio, CASE WHEN l_partkey % 2 = 0 THEN ratio >= 0.6::DOUBLE ELSE ratio >= 0.4::DOUBLE END AS high, CASE WHEN i >= 0.3::DOUBLE AND i >= x THEN 'INS' WHEN x >= 0.5::DOUBLE THEN 'DEL' END AS kind,
  n_ins >= 9 OR del_spread >= 9 OR n_clip >= 9 OR n_large >= 3 OR n_larger >= 2 OR ratio >= 0.6::DOUBLE AS abnormal FROM m
""".replace("@codes", " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CODES.items())))
def pileup_rules(spark, d):
    line = lambda n: F.count_if(F.col("l_linenumber") == n)
    of = lambda f: F.count_if(F.col("l_returnflag") == f)
    rows = table(spark, d, "lineitem").groupBy("l_partkey").agg(of("A").alias("n_a"), of("N").alias("n_c"), of("R").alias("n_g"), F.lit(0).alias("n_t"), F.lit(0).alias("n_n"), F.count(F.lit(1)).alias("depth"), line(1).alias("n_ins"), line(1).alias("modal_ins"), line(2).alias("del_spread"), line(3).alias("n_clip"), line(4).alias("n_large"), F.count_if(F.col("l_linenumber") >= 6).alias("n_larger"))
    rows = rows.withColumn("ref", F.substring(F.lit("ACGTNRYK"), (F.col("l_partkey") % 8 + 1).cast("int"), F.lit(1))).withColumn("polymer", F.col("l_partkey") % 2 == 0)
    return rows.select("l_partkey", pileup.majority_base().alias("majority"), pileup.disagrees().alias("disagrees"), pileup.indel_ratio().alias("ratio"), pileup.high_indel(0.4, 0.6).alias("high"), pileup.consensus_kind().alias("kind"), pileup.abnormal(9, 9, 9).alias("abnormal"))


_PILE = """(SELECT chrom, start AS pos, count(*) * 3 AS depth, count(*) FILTER (l_linenumber = 1) AS n_ins, count(*) FILTER (l_linenumber = 2) AS n_del, count(*) FILTER (l_linenumber = 2) AS del_spread, count(*) FILTER (l_linenumber = 3) AS n_clip, count(*) FILTER (l_linenumber = 4) AS n_large, count(*) FILTER (l_linenumber = 6) AS n_larger,
  count(*) FILTER (l_linenumber >= 3) AS n_long_clip, CAST(sum(l_quantity) FILTER (l_linenumber = 1) AS BIGINT) AS ins_bases, CAST(sum(l_quantity) FILTER (l_linenumber = 2) AS BIGINT) AS del_bases FROM @shipments GROUP BY chrom, start)"""


def pile(spark, d):
    line = lambda n: F.count_if(F.col("l_linenumber") == n)
    bases = lambda n: F.sum(F.when(F.col("l_linenumber") == n, F.col("l_quantity"))).cast("long")
    return shipments(spark, d).groupBy("chrom", F.col("start").alias("pos")).agg((F.count(F.lit(1)) * 3).alias("depth"), line(1).alias("n_ins"), line(1).alias("modal_ins"), line(2).alias("n_del"), line(2).alias("del_spread"), line(3).alias("n_clip"), line(4).alias("n_large"), line(6).alias("n_larger"), F.count_if(F.col("l_linenumber") >= 3).alias("n_long_clip"), bases(1).alias("ins_bases"), bases(2).alias("del_bases"))


_STATS = """
SELECT r.chrom, r.start, r."end", avg(depth + del_spread) AS mean_depth, avg(depth + coalesce(ins_bases, 0) + n_del + del_spread) AS refined, CAST(sum(n_ins + n_del) AS BIGINT) AS signatures, CAST(sum(n_clip) AS BIGINT) AS clips, CAST(sum(n_large) AS BIGINT) AS large, count(*) FILTER (n_large > 0) AS large_bases, count(*) FILTER (q >= 0.6::DOUBLE) AS high_bases,
  avg(CASE WHEN q >= 0.1::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS raised_share, count(*) FILTER ((i >= 0.3::DOUBLE AND i >= x) OR x >= 0.5::DOUBLE) AS consensus_bases, CASE WHEN coalesce(sum(ins_bases) // nullif(sum(n_ins), 0), 0) >= coalesce(sum(del_bases) // nullif(sum(n_del), 0), 0) THEN coalesce(sum(ins_bases) // nullif(sum(n_ins), 0), 0) ELSE -coalesce(sum(del_bases) // nullif(sum(n_del), 0), 0) END::INTEGER AS sv_len
FROM regions AS r JOIN (SELECT *, (n_ins + del_spread + n_clip)::DOUBLE / greatest(depth, 1) AS q, n_ins::DOUBLE / greatest(depth, 1) AS i, del_spread::DOUBLE / greatest(depth + del_spread, 1) AS x FROM pile) AS p ON p.chrom = r.chrom AND p.pos BETWEEN r.start AND r."end" GROUP BY r.chrom, r.start, r."end"
"""


@query(f'WITH pile AS (SELECT * FROM {_PILE}), regions AS (SELECT DISTINCT chrom, start, start + 20 AS "end" FROM @shipments WHERE l_linenumber = 1 AND l_quantity >= 30) {_STATS}')
def region_statistics(spark, d):
    regions = shipments(spark, d).filter("l_linenumber = 1 and l_quantity >= 30").select("chrom", "start", (F.col("start") + 20).alias("end"))
    found = pileup.region_statistics(pile(spark, d), regions, 64)
    return found.select("chrom", "start", "end", "mean_depth", "refined", "signatures", "clips", "large", "large_bases", "high_bases", "raised_share", "consensus_bases", "sv_len")


@query(f"""
WITH pile AS (SELECT * FROM {_PILE}),
flagged AS (SELECT chrom, pos FROM pile WHERE (n_ins >= 1 OR del_spread >= 1 OR n_clip >= 1 OR n_large >= 3 OR n_larger >= 2 OR (n_ins + del_spread + n_clip)::DOUBLE / greatest(depth, 1) >= 0.6::DOUBLE) AND n_ins + n_del + del_spread + n_large > 0),
regions AS (SELECT chrom, min(pos) AS start, max(pos) AS "end" FROM (SELECT *, sum(opens) OVER (PARTITION BY chrom ORDER BY pos) AS g FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) <= 3 THEN 0 ELSE 1 END AS opens FROM flagged)) GROUP BY chrom, g),
s AS ({_STATS})
SELECT chrom, start, "end", sv_len, signatures FROM s WHERE NOT (mean_depth <= 1.0 OR signatures <= 1.0 OR signatures / greatest(mean_depth, 1) < 0.05) AND NOT ("end" - start + 1 < 10 AND consensus_bases = 0 AND large_bases = 0)
  AND (signatures >= 2 OR (mean_depth < 15 AND signatures >= 2) OR (mean_depth < 6 AND signatures >= 1) OR high_bases > 0 OR raised_share >= 0.1) AND (abs(sv_len) >= 10 OR large > 0)
""")
def indel_regions(spark, d):
    est = detect.Estimates(min_ins=1, min_del=1, min_clip=1, support=2)
    return detect.indel_regions(pile(spark, d), est, 10, 3).select("chrom", "start", "end", "sv_len", "signatures")


@query(f"""
WITH b AS (SELECT chrom, CAST(floor(pos / 10.0) AS BIGINT) AS bin, CAST(sum(n_long_clip) AS BIGINT) AS n, avg(depth + coalesce(ins_bases, 0) + del_spread) AS refined, max(CASE WHEN n_long_clip > 0 THEN pos END) AS high, min(CASE WHEN n_long_clip > 0 THEN pos END) AS low, max(CASE WHEN n_long_clip >= 2 THEN n_long_clip::DOUBLE / greatest(depth + del_spread, 1) END) AS peak FROM {_PILE} GROUP BY 1, 2),
k AS (SELECT *, n / greatest(refined, 1) AS r FROM b),
g AS (SELECT * FROM k WHERE coalesce(n > 0 AND (CASE WHEN refined >= 2 THEN (r >= 0.1::DOUBLE AND n >= 2) OR (n >= 4 AND r >= 0.05::DOUBLE) ELSE n >= 2.4::DOUBLE AND (r >= 0.05::DOUBLE OR high - low + 1 < 30) END OR peak >= 0.1::DOUBLE), FALSE))
SELECT chrom, min(low) AS start, max(high) AS "end", CAST(sum(n) AS BIGINT) AS clips FROM (SELECT *, sum(opens) OVER (PARTITION BY chrom ORDER BY bin) AS i FROM (SELECT *, CASE WHEN bin - lag(bin) OVER (PARTITION BY chrom ORDER BY bin) <= 1 THEN 0 ELSE 1 END AS opens FROM g)) GROUP BY chrom, i
""")
def clip_regions(spark, d):
    return detect.clip_regions(pile(spark, d), 4, 0.1, 10)


_DEPTH = """(SELECT chrom, start, next - 1 AS "end", depth FROM (SELECT chrom, pos AS start, sum(d) OVER w AS depth, lead(pos) OVER w AS next FROM (SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, start AS pos, 1 AS d FROM @shipments UNION ALL SELECT chrom, "end" + 1, -1 FROM @shipments) GROUP BY chrom, pos) WINDOW w AS (PARTITION BY chrom ORDER BY pos)) WHERE depth > 0)"""


@query(f"""
WITH s AS (SELECT chrom, sub, sum((least("end", sub * 10 + 9) - greatest(start, sub * 10) + 1) * depth) / 10.0::DOUBLE AS mean FROM (SELECT *, unnest(range(CAST(floor(start / 10.0) AS BIGINT), CAST(floor("end" / 10.0) AS BIGINT) + 1)) AS sub FROM {_DEPTH}) GROUP BY chrom, sub),
f AS (SELECT *, avg(mean) OVER (PARTITION BY chrom, floor(sub * 10 / 1000000.0)) AS far, avg(mean) OVER (PARTITION BY chrom, floor(sub * 10 / 1000.0)) AS near FROM s)
SELECT chrom, sub * 10 AS start, sub * 10 + 9 AS "end", round(mean, 6)::DOUBLE AS mean FROM f WHERE (mean < 0.6::DOUBLE * far OR mean > 2.0::DOUBLE * far) AND (mean < 0.6::DOUBLE * near OR mean > 2.0::DOUBLE * near)
""")
def depth_outliers(spark, d):
    return pileup.local_depth_outliers(intervals.depth(shipments(spark, d))).withColumn("mean", F.round("mean", 6))


@query(f"""
WITH k AS (SELECT chrom, start, "end" FROM {_DEPTH} UNION ALL SELECT chrom, 0, 0 FROM @shipments GROUP BY chrom UNION ALL SELECT chrom, max("end") + 11, max("end") + 11 FROM @shipments GROUP BY chrom)
SELECT chrom, f AS start, t AS "end" FROM (SELECT chrom, lag("end") OVER w + 1 AS f, start - 1 AS t FROM k WINDOW w AS (PARTITION BY chrom ORDER BY start)) WHERE t - f + 1 >= 2
""")
def zero_coverage(spark, d):
    rows = shipments(spark, d)
    return detect.zero_coverage(intervals.depth(rows), rows.groupBy("chrom").agg((F.max("end") + 10).alias("length")))


@query(f"SELECT chrom || chr(9) || start || chr(9) || \"end\" || chr(9) || depth AS line FROM {_DEPTH}")
def coverage_lines(spark, d):
    return refine.coverage_lines(intervals.depth(shipments(spark, d)))


@query(f"""SELECT chrom, pos, ref, support, depth FROM (SELECT chrom, pos, ref, greatest(CASE WHEN ref = 'A' THEN 0 ELSE n_ins END, CASE WHEN ref = 'C' THEN 0 ELSE n_del END, CASE WHEN ref = 'G' THEN 0 ELSE n_clip END, CASE WHEN ref = 'T' THEN 0 ELSE n_large END) AS support, depth, n_larger FROM (SELECT *, substr('ACGT', CAST(pos % 4 + 1 AS INTEGER), 1) AS ref FROM {_PILE})) WHERE support >= 1 AND support >= 0.3::DOUBLE * depth AND n_larger + n_larger < 1""")
def single_bases(spark, d):
    rows = pile(spark, d).select("chrom", "pos", F.substring(F.lit("ACGT"), (F.col("pos") % 4 + 1).cast("int"), F.lit(1)).alias("ref"), F.col("n_ins").alias("x_a"), F.col("n_del").alias("x_c"), F.col("n_clip").alias("x_g"), F.col("n_large").alias("x_t"), F.col("n_larger").alias("n_ins"), F.col("n_larger").alias("del_spread"), "depth")
    return refine.single_base_candidates(rows, 0.3, 1)


# CIGAR and MD


@query("""SELECT DISTINCT l_orderkey, l_linenumber, cigar, CASE WHEN b > 4 THEN a + 5 WHEN d + b > 4 THEN a + c + 5 ELSE a + b + c + d + 1 END AS query_pos FROM @alignments WHERE b + d > 4""")
def query_positions(spark, d):
    """The read's position of the fifth reference base of each alignment that begins with five matches."""
    runs = cg.aligned_runs(alignments(spark, d).withColumn("at", F.col("pos") + 4), seq=None)
    keys = ["l_orderkey", "l_linenumber", "cigar"]
    kept = cg.query_position(runs, [*keys, "pos"], F.col("at"))
    long = F.regexp_extract("cigar", "S([0-9]+)M", 1).cast("int") + F.regexp_extract("cigar", "I([0-9]+)=", 1).cast("int") > 4
    return kept.filter(long).select(*keys, "query_pos").distinct()


@query("""SELECT l_orderkey, l_linenumber, b || 'M' || c || 'I' || d || '=' || e || 'D' || '3X' AS inner_cigar, '=X' || CASE WHEN l_linenumber % 2 = 0 THEN '+MD' ELSE '' END AS flavour, CAST(3 + (b > 0)::INTEGER AS INTEGER) AS tokens FROM @alignments""")
def cigar_parts(spark, d):
    rows = alignments(spark, d).withColumn("md", F.when(F.col("l_linenumber") % 2 == 0, "5A"))
    inner = F.array_join(F.transform(cg.trim_clips(cg.operations(F.col("cigar"))), lambda x: F.concat(x["len"].cast("string"), x["op"])), "")
    md = F.concat(F.regexp_extract("cigar", "S([0-9]+)M", 1), F.lit("A0^CC7"))
    return rows.select("l_orderkey", "l_linenumber", inner.alias("inner_cigar"), cg.flavour(F.col("cigar"), F.col("md")).alias("flavour"), F.size(cg.md_tokens(md)).alias("tokens"))


@query("""SELECT l_orderkey, l_linenumber, a || 'S' || b || '=' || '1X' || d || '=' || e || 'D' || c || '=' AS cigar FROM @alignments""")
def exact_cigars(spark, d):
    """Matches divided by the MD tag, deletions passed over."""
    of = lambda p: F.regexp_extract("cigar", p, 1).cast("long")
    rows = alignments(spark, d).select("l_orderkey", "l_linenumber", *(of(p).alias(n) for n, p in (("a", "^([0-9]+)S"), ("b", "S([0-9]+)M"), ("c", "M([0-9]+)I"), ("d", "I([0-9]+)="), ("e", "=([0-9]+)D"))))
    t = lambda x: x.cast("string")
    cigar = F.concat(t(F.col("a")), F.lit("S"), t(F.col("b") + 1 + F.col("d")), F.lit("M"), t(F.col("e")), F.lit("D"), t(F.col("c")), F.lit("M"))
    md = F.concat(t(F.col("b")), F.lit("T"), t(F.col("d")), F.lit("^"), F.repeat(F.lit("G"), F.col("e").cast("int")), t(F.col("c")))
    return cg.with_exact_cigar(rows.select("l_orderkey", "l_linenumber", cigar.alias("cigar"), md.alias("md"))).select("l_orderkey", "l_linenumber", "cigar")


# Intervals


@query("""
SELECT a.l_orderkey, a.l_linenumber, a.start <= b."end" AND b.start <= a."end" AS overlaps, least(a."end", b."end") - greatest(a.start, b.start) > 0 AS adjacent, a.start BETWEEN b.start AND b."end" AS inside, greatest(abs(b.start - a.start), abs(b."end" - a."end")) BETWEEN 20 AND 400 AS sized,
  CASE WHEN a.l_linenumber % 2 = 0 THEN a.start + CAST(a.l_quantity AS BIGINT) - 1 ELSE a.start END AS run_end, abs(b.start - a.start) > 300 AS ultra_large FROM @shipments AS a JOIN @shipments AS b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
""")
def interval_predicates(spark, d):
    a = shipments(spark, d)
    b = a.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    s, e, s2, e2 = (F.col(c) for c in ("start", "end", "s2", "e2"))
    op = F.when(F.col("l_linenumber") % 2 == 0, "M").otherwise("I")
    return a.join(b, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", iv.overlaps(s, e, s2, e2).alias("overlaps"), iv.adjacent(s, e, s2, e2).alias("adjacent"), iv.position_in(s, s2, e2).alias("inside"), iv.distances_between(s2 - s, e2 - e, 20, 400).alias("sized"), iv.run_end(s, op, F.col("l_quantity").cast("long"), "MDN").alias("run_end"), bp.ultra_large(s, s2, 300).alias("ultra_large"))


@query("""SELECT n_nationkey, n_nationkey % 4 = 1 AS decoy, n_nationkey % 4 = 2 AS alternative FROM nation""")
def contig_kinds(spark, d):
    k = F.col("n_nationkey") % 4
    name = F.when(k == 1, F.concat(F.lit("hs37d"), F.col("n_nationkey"))).when(k == 2, F.concat(F.lit("chrUn_"), F.col("n_name"))).otherwise(F.concat(F.lit("chr"), F.col("n_nationkey")))
    return table(spark, d, "nation").select("n_nationkey", iv.is_decoy(name).alias("decoy"), iv.is_alternative(name).alias("alternative"))


# Refinement


@query("""
SELECT chrom, kind, min(start) AS start, max("end") AS "end", CAST(sum(size) AS INTEGER) AS sv_len, max(l_linenumber) AS support, count(*) AS members FROM (
  SELECT *, sum(opens) OVER (PARTITION BY chrom, kind ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY chrom, kind ORDER BY start, "end") <= -5 THEN 0 ELSE 1 END AS opens FROM (
      SELECT chrom, l_partkey % 5 AS kind, start, "end", "end" - start AS size, max(l_linenumber) AS l_linenumber FROM @shipments GROUP BY ALL))) GROUP BY chrom, kind, g
""")
def neighbour_merge(spark, d):
    rows = shipments(spark, d).select("chrom", (F.col("l_partkey") % 5).alias("svtype"), "start", "end", (F.col("end") - F.col("start")).alias("sv_len"), "l_linenumber", F.col("chrom").alias("key"))
    rows = rows.groupBy("chrom", "svtype", "start", "end", "sv_len", "key").agg(F.max("l_linenumber").alias("support"))
    return refine.merge_neighbour_variants(rows, ["key"], -5).select("chrom", F.col("svtype").alias("kind"), "start", "end", "sv_len", "support", "members")


@query("""
WITH s AS (SELECT l_orderkey AS q, CASE WHEN l_returnflag = 'R' THEN 'D' ELSE 'I' END AS op, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS pos, CAST(l_quantity AS INTEGER) AS len FROM lineitem),
g AS (SELECT *, pos - lag(CASE WHEN op = 'D' THEN pos + len ELSE pos END) OVER w AS gap, lag(len) OVER w AS before FROM s WINDOW w AS (PARTITION BY q, op ORDER BY pos, len)),
n AS (SELECT *, sum(CASE WHEN coalesce(gap <= 10 OR (gap <= 40 AND least(len, before) >= 0.2::DOUBLE * greatest(len, before)), FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY q, op ORDER BY pos, len ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT q AS l_orderkey, op, min(pos) AS pos, CAST(sum(len) AS INTEGER) AS len, count(*) AS members FROM n GROUP BY q, op, i
""")
def signature_merge(spark, d):
    day = F.unix_date(F.to_date("l_shipdate")).cast("long")
    rows = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "D").otherwise("I").alias("op"), day.alias("pos"), F.col("l_quantity").cast("int").alias("len"), F.lit("A").alias("seq"))
    return refine.merge_neighbour_signatures(rows, ["l_orderkey"], 10, 40).select("l_orderkey", "op", "pos", "len", "members")


@query("""SELECT l_orderkey, chrom, coalesce(sum(l_quantity) FILTER (l_linenumber % 2 = 0), 0)::BIGINT AS ins_sum, coalesce(sum(l_quantity) FILTER (l_linenumber % 2 = 1), 0)::BIGINT AS del_sum FROM @shipments GROUP BY l_orderkey, chrom""")
def signature_sums(spark, d):
    rows = shipments(spark, d).select(F.col("l_orderkey").alias("qname"), "chrom", F.when(F.col("l_linenumber") % 2 == 0, "I").otherwise("D").alias("op"), F.col("l_quantity").cast("long").alias("len"))
    return refine.sums_by_read(rows, ["chrom"]).withColumnRenamed("qname", "l_orderkey")


@query("""SELECT count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus <> 'F') AS failed FROM orders""")
def finished_works(spark, d):
    return refine.finished_and_failed(table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "DONE").otherwise("FAILED").alias("status")))


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def unfinished_works(spark, d):
    ledger = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", "DONE").otherwise("FAILED").alias("status"))
    return files.unfinished(table(spark, d, "orders"), ledger, ["o_orderkey"]).select("o_orderkey")


_HALVES = """(SELECT CASE WHEN (l_partkey % 7, pos2) < (l_suppkey % 7, pos) THEN l_partkey % 7 ELSE l_suppkey % 7 END AS c1, CASE WHEN (l_partkey % 7, pos2) < (l_suppkey % 7, pos) THEN pos2 ELSE pos END AS s1, CASE WHEN (l_partkey % 7, pos2) < (l_suppkey % 7, pos) THEN l_suppkey % 7 ELSE l_partkey % 7 END AS c2,
  CASE WHEN (l_partkey % 7, pos2) < (l_suppkey % 7, pos) THEN pos ELSE pos2 END AS s2, l_linenumber AS n FROM (SELECT *, l_orderkey * 37 AS pos, l_partkey * 53 AS pos2 FROM lineitem))"""


@query(f"""
WITH a AS (SELECT *, sum(o) OVER (PARTITION BY c1, c2 ORDER BY s1) AS r FROM (SELECT *, CASE WHEN s1 - lag(s1) OVER (PARTITION BY c1, c2 ORDER BY s1) <= 50 THEN 0 ELSE 1 END AS o FROM {_HALVES})),
b AS (SELECT *, sum(o) OVER (PARTITION BY c1, c2, r ORDER BY s2) AS t FROM (SELECT c1, s1, c2, s2, n, r, CASE WHEN s2 - lag(s2) OVER (PARTITION BY c1, c2, r ORDER BY s2) <= 50 THEN 0 ELSE 1 END AS o FROM a))
SELECT c1 AS chrom, s1 AS start, c2 AS chrom2, s2 AS "end", n AS support FROM (SELECT *, row_number() OVER (PARTITION BY c1, c2, r, t ORDER BY n DESC, s1, s2) AS k FROM b) WHERE k = 1
""")
def half_translocations(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("chrom"), (F.col("l_orderkey") * 37).alias("start"), (F.col("l_partkey") % 7).alias("chrom2"), (F.col("l_partkey") * 53).alias("end"), F.col("l_linenumber").alias("support"))
    return refine.merge_half_translocations(rows, 50)


@query("""SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem AS k WHERE k.l_orderkey = lineitem.l_orderkey AND k.l_linenumber = 1) OR l_suppkey IN (SELECT l_partkey FROM lineitem AS k WHERE k.l_orderkey = lineitem.l_orderkey AND k.l_linenumber = 1)""")
def mated_sides(spark, d):
    rows = table(spark, d, "lineitem")
    links = rows.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("group_id"), F.col("l_suppkey").alias("side_id"), F.col("l_partkey").alias("mate_side_id"))
    sides = rows.select(F.col("l_orderkey").alias("group_id"), F.col("l_suppkey").alias("side_id"))
    return refine.mated_sides(sides, links).select(F.col("group_id").alias("l_orderkey"), F.col("side_id").alias("l_suppkey"))


@query("""SELECT l_partkey AS group_id, CAST(max(n) + 0 AS INTEGER) AS dup_num FROM (SELECT l_partkey, l_suppkey, count(*) FILTER (l_linenumber >= 3) AS n FROM lineitem GROUP BY 1, 2) GROUP BY l_partkey""")
def duplication_numbers(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("group_id"), F.col("l_suppkey").alias("qname"), (F.col("l_linenumber") >= 3).alias("turned_back"))
    return refine.duplication_number(rows)


@query("""
WITH m AS (SELECT user_id, event_type, pos, event_id, median(pos) OVER w AS m, count(*) OVER w AS n FROM @events WINDOW w AS (PARTITION BY user_id, event_type)),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY n DESC, abs(pos - m), event_type) AS r FROM m WHERE abs(pos - m) <= 400000)
SELECT user_id, event_id % 5 AS qname, event_type AS side_id, abs(pos - m) AS off FROM k WHERE r = 1
""")
def consistent_positions(spark, d):
    rows = user_events(spark, d).select(F.col("user_id").alias("group_id"), F.col("event_type").alias("side_id"), "pos", (F.col("event_id") % 5).alias("qname"), F.lit("R").alias("end"))
    side = F.median("pos").over(Window.partitionBy("group_id", "side_id"))
    rows = rows.withColumn("m", side)
    return refine.consistent_positions(rows, 400_000).select(F.col("group_id").alias("user_id"), "qname", "side_id", F.abs(F.col("pos") - F.col("m")).alias("off"))


@query("""
WITH s AS (SELECT l_partkey AS g, l_partkey % 2 AS t, l_linenumber AS side, chrom, start, "end" FROM @shipments),
n AS (SELECT g, count(DISTINCT side) AS n FROM s GROUP BY g),
p AS (SELECT a.g AS x, b.g AS y, count(DISTINCT a.side) AS n1, count(DISTINCT b.side) AS n2 FROM s AS a JOIN s AS b ON a.chrom = b.chrom AND a.start <= b."end" AND b.start <= a."end" AND a.g < b.g AND a.t = b.t GROUP BY 1, 2)
SELECT x AS group_id, y AS b_group_id FROM p JOIN n AS u ON u.g = x JOIN n AS v ON v.g = y WHERE least(n1, n2) >= least(u.n, v.n)
""")
def overlapping_groups(spark, d):
    rows = shipments(spark, d).select(F.col("l_partkey").alias("group_id"), (F.col("l_partkey") % 2).alias("svtype"), F.col("l_linenumber").alias("side_id"), "chrom", "start", "end")
    return refine.overlapping_groups(rows)


@query(f"""
WITH r AS (SELECT DISTINCT 'c' || (l_suppkey % 3) AS chrom, start, start + 40 AS "end" FROM (SELECT *, chrom AS l_suppkey FROM @shipments) WHERE l_linenumber = 1 AND l_quantity >= 49)
SELECT r.chrom, r.start, r."end" FROM r JOIN @segments AS s ON s.chrom = r.chrom AND s.ref_start <= r."end" AND r.start <= s.ref_end GROUP BY r.chrom, r.start, r."end" HAVING count(*) FILTER ((abs(query_end - query_start) + 1) * 2 >= query_len + 42) >= 0.5::DOUBLE * count(*)
""")
def valid_clip_regions(spark, d):
    regions = shipments(spark, d).filter("l_linenumber = 1 and l_quantity >= 49").select(F.concat(F.lit("c"), F.col("chrom") % 3).alias("chrom"), "start", (F.col("start") + 40).alias("end")).distinct()
    return refine.valid_clip_regions(segs(spark, d).withColumn("query_len", F.col("query_len") + 42), regions)


@query("""
WITH h AS (SELECT l_suppkey AS c, l_orderkey AS q FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2), k AS (SELECT l_partkey % 40 AS r, CAST(l_linenumber % 2 AS INTEGER) AS i, l_orderkey AS q FROM lineitem GROUP BY 1, 2, 3),
n AS (SELECT c, count(*) AS n FROM h GROUP BY c), s AS (SELECT c, r, i, count(*) AS shared FROM h JOIN k USING (q) GROUP BY ALL)
SELECT c AS cns_id, r AS region_id, i AS cluster_id, shared FROM (SELECT s.*, row_number() OVER (PARTITION BY s.c ORDER BY shared DESC, r, i) AS o FROM s JOIN n ON n.c = s.c WHERE shared >= least(3, n)) WHERE o = 1
""")
def group_members(spark, d):
    rows = table(spark, d, "lineitem")
    header = rows.filter("l_linenumber <= 2").select(F.col("l_suppkey").alias("cns_id"), F.col("l_orderkey").alias("qname")).distinct()
    members = rows.select((F.col("l_partkey") % 40).alias("region_id"), (F.col("l_linenumber") % 2).cast("int").alias("cluster_id"), F.col("l_orderkey").alias("qname")).distinct()
    return refine.members_of_groups(header, members)


_PAF = "(SELECT l_orderkey || '' AS qname, 'c' AS chrom, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, l_linenumber * 100 AS qstart, l_linenumber * 100 + 60 AS qend, start, start + 60 AS \"end\" FROM (SELECT l_orderkey, l_linenumber, min(start) AS start FROM @shipments GROUP BY 1, 2))"


def paf(spark, d):
    line = F.col("l_linenumber") * 100
    rows = shipments(spark, d).groupBy("l_orderkey", "l_linenumber").agg(F.min("start").alias("start"))
    return rows.select(F.col("l_orderkey").cast("string").alias("qname"), F.lit("c").alias("chrom"), F.when(F.col("l_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"), line.alias("qstart"), (line + 60).alias("qend"), "start", (F.col("start") + 60).alias("end"), F.lit(None).cast("string").alias("type"))


@query(f"""SELECT qname, min_by(start, start) AS low, max("end") AS high FROM {_PAF} GROUP BY qname, chrom""")
def outermost_alignments(spark, d):
    return refine.outermost(paf(spark, d)).select("qname", F.col("left.start").alias("low"), F.col("right.end").alias("high"))


@query(f"""
WITH n AS (SELECT *, lead(qstart) OVER w AS nq, lead(start) OVER w AS ns, lead("end") OVER w AS ne FROM {_PAF} WINDOW w AS (PARTITION BY qname, chrom, strand ORDER BY qstart, qend)),
v AS (SELECT qname, CASE WHEN strand = '+' THEN "end" ELSE ne END + 1 AS start, CAST(nq - qend - 1 - CASE WHEN strand = '+' THEN ns - "end" - 1 ELSE start - ne - 1 END AS INTEGER) AS sv_len FROM n WHERE nq IS NOT NULL),
t AS (SELECT *, CASE WHEN sv_len > 0 THEN 'INS' ELSE 'DEL' END AS svtype FROM v WHERE abs(sv_len) >= 20),
b AS (SELECT *, lag(start) OVER w AS s, lag(sv_len) OVER w AS l FROM t WINDOW w AS (PARTITION BY svtype ORDER BY start, qname))
SELECT svtype, start, sv_len FROM b WHERE NOT coalesce(start - s <= 100 AND least(abs(sv_len), abs(l)) > 0.95::DOUBLE * greatest(abs(sv_len), abs(l)), FALSE)
""")
def split_consensus(spark, d):
    return refine.split_alignment_indels(paf(spark, d), 20).select("svtype", "start", "sv_len")


@query("""SELECT o_orderkey, CASE WHEN p > 6000 OR p = 0 THEN 20000 WHEN p > 4000 THEN 15000 WHEN p > 2000 THEN 10000 WHEN p > 1000 THEN 7500 ELSE 5000 END::DOUBLE AS wide, CASE WHEN p > 1000 THEN 6000 WHEN p > 500 THEN 3000 ELSE 1000 END + p AS flank, CASE WHEN p % 20 <= 6 THEN 1 WHEN p % 20 <= 15 THEN 2 ELSE 4 END AS least_support, least(p % 20, p % 7) >= 1 AND least(p % 20, p % 7) >= 0.1::DOUBLE * greatest(p % 20, p % 7) AS balanced
FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 50) AS BIGINT) AS p FROM orders)""")
def region_rules(spark, d):
    p = F.floor(F.col("o_totalprice") / 50)
    rows = table(spark, d, "orders").select("o_orderkey", p.cast("long").alias("p"))
    a, b = F.col("p") % 20, F.col("p") % 7
    return rows.select("o_orderkey", refine.consensus_flank(F.col("p"), True).cast("double").alias("wide"), refine.consensus_flank(F.col("p"), False).alias("flank"), cluster.low_coverage_support(4, a).cast("int").alias("least_support"), bp.balanced(a, b).alias("balanced"))


@query("""
WITH g AS (SELECT l_partkey AS group_id, min(chrom % 2) AS c1, max(chrom % 2) AS c2, min(start) AS low, min("end") AS high, max(start) AS low2, max("end") AS high2 FROM @shipments GROUP BY 1)
SELECT group_id, c1 AS chrom, low AS start, high2 AS "end" FROM g WHERE c1 = c2 AND high2 - low <= 1500 UNION ALL SELECT group_id, c1, low, high FROM g WHERE NOT (c1 = c2 AND high2 - low <= 1500) UNION ALL SELECT group_id, c2, low2, high2 FROM g WHERE NOT (c1 = c2 AND high2 - low <= 1500)
""")
def clip_works(spark, d):
    rows = shipments(spark, d).groupBy(F.col("l_partkey").alias("group_id")).agg(F.min(F.col("chrom") % 2).alias("chrom"), F.max(F.col("chrom") % 2).alias("chrom2"), F.min("start").alias("low"), F.min("end").alias("high"), F.max("start").alias("low2"), F.max("end").alias("high2"))
    return refine.clip_works(rows, 1_500)


# Calls


_DAYS = "(SELECT CAST(floor(pos / 86400.0) AS BIGINT) AS day, list(DISTINCT user_id) FILTER (event_type = 'view') AS r, list(DISTINCT user_id) FILTER (event_type <> 'view') AS o FROM @events GROUP BY 1)"


@query(f"""
WITH p AS (SELECT day, coalesce(r, []) AS r, coalesce(o, []) AS o, lag(coalesce(r, [])) OVER w AS pr, lag(coalesce(o, [])) OVER w AS po FROM {_DAYS} WINDOW w AS (ORDER BY day)),
c AS (SELECT day, coalesce(len(list_intersect(r, pr)) + len(list_intersect(o, po)), 0)::INTEGER AS cis, coalesce(len(list_intersect(r, po)) + len(list_intersect(o, pr)), 0)::INTEGER AS trans FROM p)
SELECT day, cis, trans, greatest(cis, trans) >= 30 AS linked, trans > cis AS flips FROM c
""")
def phase_links(spark, d):
    day = F.floor(F.col("pos") / 86400).cast("long")
    of = lambda c: F.collect_set(F.when(c, F.col("user_id").cast("string")))
    days = user_events(spark, d).groupBy(day.alias("start")).agg(of(F.col("event_type") == "view").alias("reads"), of(F.col("event_type") != "view").alias("others"))
    nodes = days.withColumn("variant_id", F.col("start")).withColumn("chrom", F.lit("c"))
    return call.links_between(nodes, 30).select(F.col("start").alias("day"), "cis", "trans", "linked", "flips")


@query("SELECT count(*) AS phase_sets, CAST(sum(n) AS BIGINT) AS phased FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) >= 2)")
def phase_set_counts(spark, d):
    return call.phase_sets(table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("ps")))


@query("SELECT event_type AS svtype, count(*) AS n FROM events GROUP BY event_type")
def type_statistics(spark, d):
    return call.statistics(table(spark, d, "events").withColumnRenamed("event_type", "svtype"))


@query("SELECT DISTINCT sha256(text) AS h FROM documents WHERE text IS NOT NULL")
def exact_texts(spark, d):
    return intervals.exact_distinct(table(spark, d, "documents").filter("text is not null").select("text"), ["text"]).select(F.sha2("text", 256).alias("h"))


_CALLS = "(SELECT chrom, l_partkey % 50 AS v, count(*) FILTER (l_linenumber <= 3) AS support, count(*) AS dp, CAST(max(l_quantity) AS INTEGER) AS sv_len FROM @shipments GROUP BY 1, 2)"


def calls(spark, d):
    rows = shipments(spark, d).groupBy("chrom", (F.col("l_partkey") % 50).alias("v")).agg(F.count_if(F.col("l_linenumber") <= 3).alias("support"), F.count(F.lit(1)).alias("dp"), F.max("l_quantity").cast("int").alias("sv_len"))
    return rows.withColumn("svtype", F.lit("INS"))


@query(f"""
SELECT chrom, v, round(support::DOUBLE / dp, 6) AS af, CASE WHEN support::DOUBLE / dp >= 0.7::DOUBLE THEN '1/1' ELSE '0/1' END AS gt, (dp - support) || ',' || support AS ad FROM {_CALLS}
WHERE (support >= 3 OR support >= 0.6::DOUBLE * dp OR (sv_len >= 40 AND ((support >= 2 AND dp <= 15) OR (support >= 1 AND dp <= 6)))) AND support::DOUBLE / dp >= 0.2::DOUBLE
""")
def genotyped_calls(spark, d):
    return call.genotyped(calls(spark, d), 3, 20, 0.7, 0.2).select("chrom", "v", "af", "gt", "ad")


@query("""
WITH c AS (SELECT l_partkey AS r, CAST(l_linenumber AS INTEGER) AS k, start, CAST(l_quantity AS INTEGER) AS len, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY start, l_orderkey) AS o FROM @shipments) WHERE o = 1),
p AS (SELECT a.r, a.k AS k1, b.k AS k2, b.l_orderkey AS q FROM c AS a JOIN c AS b ON a.r = b.r AND a.k < b.k AND abs(a.start - b.start) <= 400 AND least(a.len, b.len) >= 0.8::DOUBLE * greatest(a.len, b.len))
SELECT c.r AS region_id, c.k AS cluster_id, CAST(1 + count(DISTINCT CASE WHEN p.q <> c.l_orderkey THEN p.q END) AS INTEGER) AS support FROM c LEFT JOIN p ON p.r = c.r AND p.k1 = c.k WHERE NOT EXISTS (SELECT 1 FROM p AS x WHERE x.r = c.r AND x.k2 = c.k) GROUP BY c.r, c.k
""")
def merged_alleles(spark, d):
    first = F.row_number().over(Window.partitionBy("l_partkey", "l_linenumber").orderBy("start", "l_orderkey"))
    rows = shipments(spark, d).withColumn("o", first).filter("o = 1")
    rows = rows.select("chrom", "start", "end", F.lit("INS").alias("svtype"), F.col("l_quantity").cast("int").alias("sv_len"), F.lit(None).cast("string").alias("alt_seq"), F.lit(1).alias("support"), F.array(F.col("l_orderkey").cast("string")).alias("reads"), F.col("l_partkey").alias("region_id"), F.col("l_linenumber").cast("int").alias("cluster_id"), F.lit("x").alias("ldiscov"))
    return call.merge_alleles(rows, 0.9, 400, 0.8).select("region_id", "cluster_id", "support")


# Sequences


@query("""SELECT item_id, CAST(s AS INTEGER) AS s, text[s:s + 30] AS ref_seq FROM (SELECT item_id, text, unnest([1, 11, 25]) AS s FROM benchmark WHERE length(text) >= 60)""")
def reference_windows(spark, d):
    """Windows of sequences that lie in tiles of 16 bases."""
    rows = table(spark, d, "benchmark").filter("length(text) >= 60")
    tiles = files.reference_tiles(rows.select(F.col("item_id").alias("name"), F.col("text").alias("seq")), 16)
    spots = rows.select(F.col("item_id").alias("chrom"), F.explode(F.array(*(F.lit(x).cast("long") for x in (1, 11, 25)))).alias("start")).withColumn("end", F.col("start") + 30)
    return files.fetch(tiles, spots, 16).select(F.col("chrom").alias("item_id"), F.col("start").cast("int").alias("s"), "ref_seq")


@query(f"""SELECT item_id, text[5:20] AS forward, array_to_string(list_reverse(regexp_extract_all(translate(text[5:20], '{seq.CODES}{seq.CODES.lower()}', '{seq.COMPLEMENTS}{seq.COMPLEMENTS.lower()}'), '(?s).')), '') AS backward FROM benchmark""")
def subsequences(spark, d):
    part = lambda minus: seq.subsequence(F.col("text"), F.lit(5), F.lit(20), F.lit(minus))
    return table(spark, d, "benchmark").select("item_id", part(False).alias("forward"), part(True).alias("backward"))


# Files and lines


@query("""SELECT event_id, key, value FROM (SELECT event_id, unnest(['TYPE', 'USER', 'FLAG']) AS key, unnest([event_type, user_id || '', '']) AS value FROM events)""")
def info_parse(spark, d):
    text = F.concat(F.lit("TYPE="), "event_type", F.lit(";;USER="), F.col("user_id").cast("string"), F.lit(";FLAG"))
    return table(spark, d, "events").select("event_id", F.explode(files.info_map(text)))


@query("""SELECT l_orderkey || '' AS qname, l_linenumber, 'c' || (chrom % 3) AS chrom, pos, l_linenumber * 10 AS mapq, cigar, a + b + c + d + 3 AS bases FROM @alignments""")
def sam_round_trip(spark, d):
    rows = reads(spark, d)
    head = table(spark, d, "nation").select(F.concat(F.lit("@SQ\tSN:"), "n_name", F.lit("\tLN:9")).alias("line"))
    line = F.concat_ws("\t", "qname", F.col("flag").cast("string"), "chrom", F.col("pos").cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.lit("*"), F.concat(F.lit("NM:i:"), F.col("l_linenumber").cast("string")))
    back = al.read_sam(spark, written_lines(head.unionByName(rows.select(line.alias("line"))), "sam"))
    return back.select("qname", F.col("nm").alias("l_linenumber"), "chrom", "pos", "mapq", "cigar", F.length("seq").alias("bases"))


@query("SELECT n_name AS chrom, n_nationkey + 9 AS length FROM nation")
def sam_header(spark, d):
    head = table(spark, d, "nation").select(F.concat(F.lit("@SQ\tSN:"), "n_name", F.lit("\tLN:"), (F.col("n_nationkey") + 9).cast("string")).alias("line"))
    return al.read_sam_header(spark, written_lines(head, "header")).select("chrom", "length")


@query("SELECT l_orderkey || '' AS qname, l_linenumber + 1 AS qstart, l_linenumber + 60 AS qend, 'c' || chrom AS chrom, 101 + start AS s, 100 + \"end\" AS e FROM @shipments")
def paf_round_trip(spark, d):
    t = lambda c: F.col(c).cast("string")
    line = F.concat_ws("\t", t("l_orderkey"), F.lit("99"), t("l_linenumber"), (F.col("l_linenumber") + 60).cast("string"), F.lit("+"), F.concat(F.lit("c"), t("chrom"), F.lit(":101-900___l___r")), F.lit("800"), t("start"), t("end"), F.lit("1"), F.lit("1"), F.lit("60"), F.lit("tp:A:P"), F.lit("cg:Z:5M"))
    back = files.read_paf(spark, written_lines(shipments(spark, d).select(line.alias("line")), "paf"))
    return back.filter("type = 'P' and cigar = '5M'").select("qname", "qstart", "qend", "chrom", F.col("start").alias("s"), F.col("end").alias("e"))


@query("""SELECT 'c' || chrom AS chrom, start, "end", CAST(l_quantity AS INTEGER) AS sv_len, CASE WHEN l_linenumber = 1 THEN 'DEL' ELSE 'INS' END AS svtype, l_orderkey || '' AS id FROM @shipments""")
def bed_round_trip(spark, d):
    """Variants as BED rows, read back."""
    rows = shipments(spark, d).select(F.concat(F.lit("c"), "chrom").alias("chrom"), "start", "end", F.col("l_quantity").cast("int").alias("sv_len"), F.when(F.col("l_linenumber") == 1, "DEL").otherwise("INS").alias("svtype"), F.col("l_orderkey").cast("string").alias("id"), F.lit(3).alias("dp"), F.lit(0.5).alias("af"), F.lit("0/1").alias("gt"), F.lit(1).alias("ad_ref"), F.lit(2).alias("ad_alt"))
    back = files.read_calls_bed(spark, written_lines(writers.bed_lines(rows), "bed"))
    return back.select("chrom", "start", "end", "sv_len", "svtype", "id")


@query("""SELECT 'c' || chrom AS chrom, start, "end", CAST(l_quantity AS INTEGER) AS sv_len, l_orderkey || '' AS id, '0/1' AS gt, '1,' || l_linenumber AS ad, 3 AS dp, CAST(l_linenumber AS DOUBLE) / 8 AS af FROM @shipments""")
def vcf_round_trip(spark, d):
    """Variants as VCF rows, read back."""
    rows = shipments(spark, d).select(F.concat(F.lit("c"), "chrom").alias("chrom"), "start", "end", F.col("l_quantity").cast("int").alias("sv_len"), F.lit("DEL").alias("svtype"), F.col("l_orderkey").cast("string").alias("id"), F.lit(3).alias("dp"), (F.col("l_linenumber") / 8).alias("af"), F.lit("0/1").alias("gt"), F.lit(1).alias("ad_ref"), F.col("l_linenumber").alias("ad_alt"))
    return files.read_vcf(spark, written_lines(writers.vcf_lines(rows), "vcf")).select("chrom", "start", "end", "sv_len", "id", "gt", "ad", "dp", "af")


@query("""
SELECT l_orderkey || '_' || l_linenumber || '_' || side AS id, CASE WHEN side = 1 THEN a ELSE b END AS chrom, CASE WHEN side = 1 THEN start ELSE "end" END AS start, l_orderkey || '_' || l_linenumber || '_' || (3 - side) AS mate_id,
  CASE WHEN side = 1 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'N[' || b || ':' || "end" || '[' ELSE '[' || b || ':' || "end" || '[N' END ELSE CASE WHEN l_linenumber % 2 = 0 THEN ']' || a || ':' || start || ']N' ELSE '[' || a || ':' || start || '[N' END END AS alt
FROM (SELECT l_orderkey, l_linenumber, 'x' || chrom AS a, 'y' || chrom AS b, start, "end", unnest([1, 2]) AS side FROM @shipments)
""")
def breakend_rows(spark, d):
    rows = shipments(spark, d).select(F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.concat(F.lit("x"), "chrom").alias("chrom"), "start", F.when(F.col("l_linenumber") % 2 == 0, "R").otherwise("L").alias("end_type"), F.concat(F.lit("y"), "chrom").alias("chrom2"), "end", F.lit("L").alias("end_type2"), F.lit("N").alias("ref"))
    return writers.breakends(rows).select("id", "chrom", "start", "mate_id", "alt")


@query("""SELECT a || chr(9) || start || chr(9) || start || chr(9) || b || chr(9) || "end" || chr(9) || "end" || chr(9) || id || chr(9) || 'TRA' || chr(9) || '.' || chr(9) || '.' || chr(9) || b || ':' || "end" || chr(9) || '-' || chr(9) || '-' || chr(9) || '-' || chr(9) || '-' || chr(9) || 'GT:AD:DP' || chr(9) || './.:0,3:3' AS line
FROM (SELECT 'x' || chrom AS a, 'y' || chrom AS b, start, "end", l_orderkey || '_' || l_linenumber AS id FROM @shipments)""")
def bedpe_rows(spark, d):
    rows = shipments(spark, d).select(F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.concat(F.lit("x"), "chrom").alias("chrom"), "start", F.concat(F.lit("y"), "chrom").alias("chrom2"), "end", F.lit("./.").alias("gt"), F.lit(0).alias("ad_ref"), F.lit(3).alias("ad_alt"), F.lit(3).alias("dp"))
    return writers.bedpe_lines(rows)


@query("""SELECT chrom, start, "end", svtype, svtype || '.' || row_number() OVER (PARTITION BY svtype ORDER BY CAST(chrom[4:] AS INTEGER), start, "end", sv_len) AS id FROM (SELECT DISTINCT 'chr' || (chrom % 9 + 1) AS chrom, start, "end", CASE WHEN l_linenumber % 2 = 0 THEN 'INS' ELSE 'DEL' END AS svtype, CAST(l_quantity AS INTEGER) AS sv_len FROM @shipments)""")
def numbered_variants(spark, d):
    rows = shipments(spark, d).select(F.concat(F.lit("chr"), F.col("chrom") % 9 + 1).alias("chrom"), "start", "end", F.when(F.col("l_linenumber") % 2 == 0, "INS").otherwise("DEL").alias("svtype"), F.col("l_quantity").cast("int").alias("sv_len")).distinct()
    return writers.with_ids(rows).select("chrom", "start", "end", "svtype", "id")


@query("SELECT CAST(l_linenumber % 2 AS INTEGER) AS cluster_id, l_orderkey || '' AS qname FROM lineitem GROUP BY ALL")
def cluster_round_trip(spark, d):
    """Clusters written in lines of at most 1,000 names, so that no line grows with the table."""
    rows = table(spark, d, "lineitem").select((F.col("l_linenumber") % 2).cast("int").alias("c"), F.floor(F.col("l_orderkey") / 1_000).alias("p"), F.col("l_orderkey").cast("string").alias("q")).distinct()
    lines = rows.groupBy("c", "p").agg(F.collect_set("q").alias("q")).select(F.concat_ws("\t", F.col("c").cast("string"), F.size("q").cast("string"), F.array_join("q", ";")).alias("line"))
    return files.read_clusters(spark, written_lines(lines, "clusters")).select("cluster_id", "qname")


@query("""SELECT 'c' || chrom AS chrom, start, "end", CAST(l_quantity AS INTEGER) AS sv_len FROM @shipments""")
def candidate_round_trip(spark, d):
    lines = shipments(spark, d).select(F.concat_ws("\t", F.concat(F.lit("c"), "chrom"), F.col("start").cast("string"), F.col("end").cast("string"), F.col("l_quantity").cast("int").cast("string")).alias("line"))
    return files.read_indel_candidates(spark, written_lines(lines, "candidates"))


@query("""SELECT n_name AS name, n_nationkey || ' x' AS description, repeat('ACGTN', CAST(n_nationkey + 1 AS INTEGER)) AS seq FROM nation""")
def fasta_round_trip(spark, d):
    body = F.repeat(F.lit("ACG\nTN"), (F.col("n_nationkey") + 1).cast("int"))
    lines = table(spark, d, "nation").select(F.concat(F.lit(">"), "n_name", F.lit(" "), F.col("n_nationkey").cast("string"), F.lit(" x\n"), body).alias("line"))
    return files.read_fasta(spark, written_lines(lines, "fasta"))


@query("""SELECT l_orderkey, 'cns_' || l_orderkey || '_5_' || count(*) || '___' || string_agg(l_linenumber || '', ';' ORDER BY l_linenumber) AS header, count(*)::INTEGER AS members FROM lineitem GROUP BY l_orderkey""")
def consensus_headers(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("string"))).alias("reads"))
    rows = rows.withColumn("header", writers.consensus_header(F.col("l_orderkey"), F.lit("ACGTA"), F.col("reads")))
    return rows.select("l_orderkey", "header", F.size(files.consensus_members(F.col("header"))).alias("members"))


@query("""SELECT 'c' || chrom AS chrom, CASE WHEN l_linenumber > 1 THEN start END AS start, CASE WHEN l_linenumber > 1 THEN "end" END AS "end" FROM @shipments""")
def region_round_trip(spark, d):
    whole = F.when(F.col("l_linenumber") > 1, F.concat_ws("\t", F.col("start").cast("string"), F.col("end").cast("string")))
    lines = shipments(spark, d).select(F.concat_ws("\t", F.concat(F.lit("c"), "chrom"), whole).alias("line"))
    return files.read_bed_regions(spark, written_lines(lines, "regions"))
