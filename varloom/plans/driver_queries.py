"""The operators on generic tables, each with SQL that gives the same rows.

Contigs, positions and reads have stand-ins: a contig is a supplier or a user, a position a
day or a second, an interval the days from shipping on, a read an order or a conversation, a
sequence a text. Every query runs over its whole tables. A query without SQL is one whose SQL
would differ on texts that aren't ASCII; the tests hold it against plain Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions import sequence as seq
from ..operators import aggregates, breakpoints, call, detect, dedup, intervals, refine, sampling, splitreads, windows
from ..operators import cigar as cg
from ..sources import files

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SHIPMENTS = "(SELECT l_suppkey AS chrom, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS start, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS \"end\", l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem)"
EVENTS = "(SELECT event_id, user_id, event_type, value, props, CAST(floor(epoch(ts)) AS BIGINT) AS pos FROM events)"
ALIGNMENTS = """(SELECT *, a || 'S' || b || 'M' || c || 'I' || d || '=' || e || 'D' || '3X' || f || 'H' AS cigar FROM (
  SELECT l_orderkey, l_linenumber, l_suppkey AS chrom, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS pos, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand,
    l_linenumber AS a, CAST(l_quantity AS BIGINT) AS b, l_partkey % 7 + 1 AS c, l_orderkey % 11 + 1 AS d, l_suppkey % 5 + 1 AS e, l_partkey % 3 + 1 AS f FROM lineitem))"""
SEGMENTS = """(SELECT l_orderkey || '' AS qname, 'c' || (chrom % 3) AS chrom, pos AS ref_start, pos + b + d + e + 2 AS ref_end, CASE WHEN strand = '-' THEN b + c + d + 3 + f ELSE a + 1 END AS query_start,
  CASE WHEN strand = '-' THEN f + 1 ELSE a + b + c + d + 3 END AS query_end, strand AS orient, a + b + c + d + 3 + f AS query_len, a AS left_clip, f AS right_clip, l_linenumber * 10 AS mapq FROM @alignments)"""


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.replace("@segments", SEGMENTS).replace("@alignments", ALIGNMENTS).replace("@shipments", SHIPMENTS).replace("@events", EVENTS)
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def shipments(spark: SparkSession, d: str) -> DataFrame:
    start = F.unix_date(F.to_date("l_shipdate")).cast("long")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("chrom"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def user_events(spark: SparkSession, d: str) -> DataFrame:
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props", second.alias("pos"))


def alignments(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a place, a strand and a CIGAR made of the row's own numbers."""
    pos = F.unix_date(F.to_date("l_shipdate")).cast("long")
    parts = (F.col("l_linenumber"), "S", F.col("l_quantity").cast("long"), "M", F.col("l_partkey") % 7 + 1, "I", F.col("l_orderkey") % 11 + 1, "=", F.col("l_suppkey") % 5 + 1, "D3X", F.col("l_partkey") % 3 + 1, "H")
    cigar = F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("chrom"), pos.alias("pos"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"), cigar.alias("cigar"))


_MERGED = """
SELECT chrom, island, min(start) AS start, max("end") AS "end", count(*) AS n FROM (
  SELECT *, sum(opens) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM @shipments)) GROUP BY chrom, island
"""


@query(f'SELECT chrom, start, "end", n FROM ({_MERGED})')
def interval_merge(spark, d):
    return intervals.merge(shipments(spark, d).select("chrom", "start", "end")).select("chrom", "start", "end", "n")


@query(f'SELECT chrom, start, "end", n FROM ({_MERGED})')
def interval_merge_tiled(spark, d):
    return intervals.merge_tiled(shipments(spark, d).select("chrom", "start", "end"), 256).select("chrom", "start", "end", F.col("n").cast("long").alias("n"))


@query("""
SELECT chrom, start, next - 1 AS "end", CAST(depth AS BIGINT) AS depth FROM (
  SELECT chrom, pos AS start, sum(d) OVER w AS depth, lead(pos) OVER w AS next FROM (
    SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, start AS pos, 1 AS d FROM @shipments UNION ALL SELECT chrom, "end" + 1, -1 FROM @shipments) GROUP BY chrom, pos)
  WINDOW w AS (PARTITION BY chrom ORDER BY pos)) WHERE depth > 0
""")
def interval_depth(spark, d):
    return intervals.depth(shipments(spark, d))


@query(f'SELECT chrom, prev + 1 AS start, start - 1 AS "end" FROM (SELECT chrom, start, lag("end") OVER (PARTITION BY chrom ORDER BY start) AS prev FROM ({_MERGED})) WHERE start - prev - 1 >= 2')
def zero_cov_runs(spark, d):
    return intervals.gaps(shipments(spark, d).select("chrom", "start", "end"))


@query("""
SELECT a.chrom, count(*) AS pairs, CAST(sum(least(a."end", b."end") - greatest(a.start, b.start)) AS BIGINT) AS overlap
FROM @shipments AS a JOIN @shipments AS b ON a.chrom = b.chrom AND a.start <= b."end" AND b.start <= a."end" AND (a.l_orderkey < b.l_orderkey OR (a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)) GROUP BY a.chrom
""")
def interval_overlap_join(spark, d):
    rows = shipments(spark, d).select("chrom", "start", "end", "l_orderkey", "l_linenumber")
    met = intervals.overlap_join(rows, rows, 64).filter("l_orderkey < b_l_orderkey or (l_orderkey = b_l_orderkey and l_linenumber < b_l_linenumber)")
    size = iv.overlap_size(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end"))
    return met.groupBy("chrom").agg(F.count(F.lit(1)).alias("pairs"), F.sum(size).alias("overlap"))


_REGIONS = [(1, 8100, 8500), (2, 8200, 9500), (3, None, None), (7, 9000, 9100), (11, 9300, 10200)]
_REGION_SQL = "(VALUES " + ", ".join(f"({c}, {s or 1}, {e or 4611686018427387904})" for c, s, e in _REGIONS) + ") AS r(c, s, e)"


def _regions(spark):
    return spark.createDataFrame(_REGIONS, "chrom long, start long, end long")


@query(f'SELECT chrom, start, "end", l_orderkey, l_linenumber FROM @shipments, {_REGION_SQL} WHERE chrom = c AND start >= s AND "end" <= e')
def interval_contained(spark, d):
    return intervals.in_regions(shipments(spark, d), _regions(spark), "contained").select("chrom", "start", "end", "l_orderkey", "l_linenumber")


@query(f'SELECT chrom, start, "end", l_orderkey, l_linenumber FROM @shipments, {_REGION_SQL} WHERE chrom = c AND start <= e + 30 AND "end" >= s - 30')
def interval_limit_regions(spark, d):
    return intervals.in_regions(shipments(spark, d), _regions(spark), "overlap", 30).select("chrom", "start", "end", "l_orderkey", "l_linenumber")


_WINDOWS_SQL = "(SELECT o_custkey % 100 + 1 AS c, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS s FROM orders)"


def _ordered(spark, d):
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    return table(spark, d, "orders").select((F.col("o_custkey") % 100 + 1).alias("chrom"), day.alias("start"), (day + 2).alias("end"))


@query(f'SELECT chrom, start, "end", l_orderkey, l_linenumber FROM @shipments WHERE EXISTS (SELECT 1 FROM {_WINDOWS_SQL} WHERE c = chrom AND start <= s + 2 AND s <= "end")')
def interval_semi(spark, d):
    rows = shipments(spark, d).select("chrom", "start", "end", "l_orderkey", "l_linenumber")
    return intervals.overlap_join(rows, _ordered(spark, d), 64, how="left_semi")


@query(f'SELECT chrom, start, "end", l_orderkey, l_linenumber FROM @shipments WHERE NOT EXISTS (SELECT 1 FROM {_WINDOWS_SQL} WHERE c = chrom AND start <= s + 2 AND s <= "end")')
def interval_anti(spark, d):
    rows = shipments(spark, d).select("chrom", "start", "end", "l_orderkey", "l_linenumber")
    return detect.drop_inside_groups(rows, _ordered(spark, d), 0)


@query(f"""
SELECT chrom, start, "end", l_orderkey, l_linenumber, s AS window_start FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, chrom, start, "end" ORDER BY s) AS k FROM @shipments, (SELECT DISTINCT c, s FROM {_WINDOWS_SQL}) WHERE c = chrom AND start <= s + 2 AND s <= "end") WHERE k = 1
""")
def interval_first_overlap(spark, d):
    rows = shipments(spark, d).select("chrom", "start", "end", "l_orderkey", "l_linenumber").distinct()
    return intervals.first_overlap(rows, _ordered(spark, d).distinct(), 64, ["start"]).select("chrom", "start", "end", "l_orderkey", "l_linenumber", F.col("b_start").alias("window_start"))


@query("""
SELECT event_id, CASE WHEN back_id IS NOT NULL AND (ahead_id IS NULL OR pos - back <= ahead - pos) THEN back_id ELSE ahead_id END AS nearest,
  CASE WHEN back_id IS NOT NULL AND (ahead_id IS NULL OR pos - back <= ahead - pos) THEN pos - back ELSE ahead - pos END AS distance
FROM (SELECT event_id, pos, lag(pos) OVER w AS back, lag(event_id) OVER w AS back_id, lead(pos) OVER w AS ahead, lead(event_id) OVER w AS ahead_id FROM @events WINDOW w AS (PARTITION BY user_id ORDER BY pos, event_id))
WHERE back_id IS NOT NULL OR ahead_id IS NOT NULL
""")
def interval_nearest(spark, d):
    return intervals.nearest(user_events(spark, d).select("user_id", "pos", "event_id"), ["user_id"], "pos", "event_id").select("event_id", "nearest", "distance")


@query('SELECT DISTINCT chrom, start, "end" FROM @shipments')
def exact_dedup(spark, d):
    return intervals.exact_distinct(shipments(spark, d).select("chrom", "start", "end"))


@query("""
SELECT l_orderkey, l_linenumber FROM (
  SELECT *, (same AND q <= pq) OR coalesce(lead(same AND q > pq) OVER w, FALSE) AS gone FROM (
    SELECT *, coalesce(abs(start - ps) <= 3 AND pq >= 0.9 * q AND q >= 0.9 * pq, FALSE) AS same FROM (
      SELECT chrom, start, l_orderkey, l_linenumber, l_quantity AS q, lag(start) OVER w AS ps, lag(l_quantity) OVER w AS pq FROM @shipments WINDOW w AS (PARTITION BY chrom ORDER BY start, l_orderkey, l_linenumber))
    ) WINDOW w AS (PARTITION BY chrom ORDER BY start, l_orderkey, l_linenumber)) WHERE NOT gone
""")
def near_dedup_lag(spark, d):
    rows = shipments(spark, d).select("chrom", "start", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"))
    same = (F.abs(F.col("start") - F.col("prev.start")) <= 3) & (F.col("prev.q") >= 0.9 * F.col("q")) & (F.col("q") >= 0.9 * F.col("prev.q"))
    return dedup.near_duplicate_neighbours(rows, ["chrom"], ["start", "l_orderkey", "l_linenumber"], same, "q").select("l_orderkey", "l_linenumber")


@query("""
WITH c AS (SELECT chrom, max("end") AS length FROM @shipments GROUP BY chrom),
t AS (SELECT chrom, length, unnest(range(0, CAST(floor((length - 1) / 900.0) AS BIGINT) + 1)) AS tile FROM c),
k AS (SELECT chrom, length, tile, 1 + tile * 900 AS start FROM t WHERE tile = 0 OR length - tile * 900 > 500)
SELECT chrom, CAST(tile AS INTEGER) AS tile, start, CASE WHEN length - (tile + 1) * 900 <= 500 THEN length ELSE least(start + 999, length) END AS "end" FROM k
""")
def tile_assign(spark, d):
    contigs = shipments(spark, d).groupBy("chrom").agg(F.max("end").alias("length"))
    return intervals.tiles(contigs, 1000, 50)


@query("""SELECT user_id, CAST(floor(pos / 21600.0) AS BIGINT) AS bin, count(*) AS n, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS n_purchase, round(avg(value), 6)::DOUBLE AS mean_value FROM @events GROUP BY ALL""")
def sub_window_counts(spark, d):
    return windows.bins(user_events(spark, d), ["user_id"], "pos", 21600, [F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("n_purchase"), F.round(F.avg("value"), 6).alias("mean_value")])


@query("""
SELECT event_type, min(bin) AS start, max(bin) AS "end", count(*) AS n FROM (
  SELECT *, sum(opens) OVER (PARTITION BY event_type ORDER BY bin ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT event_type, bin, CASE WHEN bin - lag(bin) OVER (PARTITION BY event_type ORDER BY bin) <= 1 THEN 0 ELSE 1 END AS opens FROM (
      SELECT DISTINCT event_type, CAST(floor(pos / 3600.0) AS BIGINT) AS bin FROM @events))) GROUP BY event_type, run
""")
def sub_window_islands(spark, d):
    hours = windows.bins(user_events(spark, d), ["event_type"], "pos", 3600, [F.count(F.lit(1)).alias("k")])
    return windows.runs(hours, ["event_type"], "bin")


@query("""SELECT bin, n, n_high FROM (SELECT CAST(floor(pos / 3600.0) AS BIGINT) AS bin, count(*) AS n, CAST(count(*) FILTER (event_type IN ('purchase', 'error')) AS BIGINT) AS n_high FROM @events GROUP BY 1) WHERE n >= 3 AND n_high >= 0.3 * n""")
def high_signature_positions(spark, d):
    hours = windows.bins(user_events(spark, d), [], "pos", 3600, [F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type").isin("purchase", "error")).alias("n_high")])
    return hours.filter("n >= 3 and n_high >= 0.3 * n")


@query("""
SELECT user_id, event_type, votes, CAST(total AS BIGINT) AS total FROM (
  SELECT *, sum(votes) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS k FROM (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY 1, 2)) WHERE k = 1
""")
def majority_vote(spark, d):
    return aggregates.majority(user_events(spark, d), ["user_id"], "event_type")


@query("""
SELECT user_id, max(votes)::DOUBLE / sum(votes) AS ratio, max(votes)::DOUBLE / sum(votes) <= 0.8 AS disagrees FROM (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY 1, 2) GROUP BY user_id
""")
def consensus_ratio(spark, d):
    top = aggregates.majority(user_events(spark, d), ["user_id"], "event_type")
    return top.select("user_id", (F.col("votes") / F.col("total")).alias("ratio"), (F.col("votes") / F.col("total") <= 0.8).alias("disagrees"))


@query("""
SELECT greatest(coalesce(min(v) + 1, 2), 2)::BIGINT AS estimate FROM (SELECT v, sum(n) OVER (ORDER BY v)::DOUBLE / sum(n) OVER () AS share FROM (SELECT CAST(l_quantity AS BIGINT) AS v, count(*) AS n FROM lineitem WHERE l_quantity <= 1000 GROUP BY 1)) WHERE share >= 0.95
""")
def hist_percentile(spark, d):
    return aggregates.percentile_by_histogram(shipments(spark, d), "l_quantity", 0.95, 2)


@query("""SELECT l_orderkey, l_linenumber, "end" - start AS size FROM @shipments WHERE abs("end" - start) BETWEEN 18 AND 45""")
def size_gate(spark, d):
    return shipments(spark, d).withColumn("size", F.col("end") - F.col("start")).filter(iv.size_between(F.col("size"), 18, 45)).select("l_orderkey", "l_linenumber", "size")


@query("""
SELECT chrom, l_partkey % 50 AS variant, support, depth, mean_size FROM (
  SELECT chrom, l_partkey % 50 AS l_partkey, count(*) AS support, avg("end" - start) AS mean_size FROM @shipments GROUP BY 1, 2) JOIN (SELECT chrom AS c, count(*) AS depth FROM @shipments GROUP BY 1) ON c = chrom
WHERE support >= greatest(3, 2 + floor(0.03 * depth)) OR support >= 0.6 * depth OR (abs(mean_size) >= 36 AND ((support >= 2 AND depth <= 15) OR (support >= 1 AND depth <= 6)))
""")
def support_gate(spark, d):
    rows = shipments(spark, d)
    votes = rows.groupBy("chrom", (F.col("l_partkey") % 50).alias("variant")).agg(F.count(F.lit(1)).alias("support"), F.avg(F.col("end") - F.col("start")).alias("mean_size"))
    deep = rows.groupBy("chrom").agg(F.count(F.lit(1)).alias("depth"))
    return votes.join(deep, "chrom").filter(aggregates.supported(F.col("support"), F.col("depth"), F.col("mean_size"), aggregates.min_support(F.col("depth")), 18)).select("chrom", "variant", "support", "depth", "mean_size")


@query("""
WITH m AS (SELECT l_partkey AS p, avg(l_quantity) AS mean FROM lineitem GROUP BY 1),
s AS (SELECT p, count(*) AS n, avg(l_quantity) AS trimmed_mean, round(stddev_pop(l_quantity), 6) AS deviation, stddev_pop(l_quantity) AS sd FROM lineitem JOIN m ON p = l_partkey WHERE l_quantity < 1.5 * mean GROUP BY p)
SELECT p AS l_partkey, s.n, s.trimmed_mean, s.deviation, coalesce(k.n_kept, 0)::BIGINT AS n_kept FROM s LEFT JOIN (SELECT p AS kp, count(*) AS n_kept FROM lineitem JOIN s ON p = l_partkey WHERE abs(l_quantity - trimmed_mean) <= 2.0000001 * sd GROUP BY p) AS k ON kp = p
""")
def trimmed_mean_2sd(spark, d):
    found = aggregates.trimmed_mean(table(spark, d, "lineitem").select("l_partkey", "l_quantity"), ["l_partkey"], "l_quantity", 1.5, 2.0000001)
    return found.withColumn("deviation", F.round("deviation", 6))


@query("""
SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, coalesce(sum("end" - start) OVER (PARTITION BY chrom ORDER BY l_orderkey, l_linenumber, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM @shipments) WHERE before < 5000
""")
def budget_sampling(spark, d):
    rows = shipments(spark, d).withColumn("size", F.col("end") - F.col("start"))
    return sampling.budget_sample(rows, ["chrom"], "size", F.lit(5000), ["l_orderkey", "l_linenumber", "start"]).select("l_orderkey", "l_linenumber")


@query("""
SELECT chrom, bases::DOUBLE / span * ((span + 2 * mean_len) / (span + mean_len)) AS depth FROM (SELECT chrom, CAST(sum("end" - start + 1) AS BIGINT) AS bases, max("end") - min(start) + 1 AS span, avg("end" - start + 1) AS mean_len FROM @shipments GROUP BY chrom)
""")
def compensated_depth(spark, d):
    size = F.col("end") - F.col("start") + 1
    stats = shipments(spark, d).groupBy("chrom").agg(F.sum(size).alias("bases"), (F.max("end") - F.min("start") + 1).alias("span"), F.avg(size).alias("mean_len"))
    return stats.select("chrom", (F.col("bases") / F.col("span") * aggregates.compensation(F.col("span"), F.col("mean_len"))).alias("depth"))


@query("""
SELECT n_nationkey, c AS chrom, CAST(row_number() OVER (ORDER BY CASE WHEN num IS NULL THEN 2 WHEN contains(c, '_') THEN 1 ELSE 0 END, coalesce(num, 1000), c) AS INTEGER) AS place FROM (
  SELECT n_nationkey, c, CASE WHEN n_nationkey % 4 = 3 THEN NULL WHEN n_nationkey % 24 = 22 THEN 23 WHEN n_nationkey % 24 = 23 THEN 24 ELSE n_nationkey + 1 END AS num FROM (
    SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 3 THEN n_name WHEN n_nationkey % 24 = 22 THEN 'chrX' WHEN n_nationkey % 24 = 23 THEN 'chrY' WHEN n_nationkey % 5 = 4 THEN 'chr' || (n_nationkey + 1) || '_alt' ELSE 'chr' || (n_nationkey + 1) END AS c FROM nation))
""")
def rank_sort(spark, d):
    k = F.col("n_nationkey")
    name = F.when(k % 4 == 3, F.col("n_name")).when(k % 24 == 22, "chrX").when(k % 24 == 23, "chrY").when(k % 5 == 4, F.concat(F.lit("chr"), k + 1, F.lit("_alt"))).otherwise(F.concat(F.lit("chr"), k + 1))
    rows = table(spark, d, "nation").select("n_nationkey", name.alias("chrom"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(iv.contig_rank(F.col("chrom")))))


@query("""
SELECT lang, support, depth, support::DOUBLE / depth AS af, CASE WHEN support::DOUBLE / depth >= 0.7 THEN '1/1' WHEN support::DOUBLE / depth >= 0.2 THEN '0/1' ELSE '0/0' END AS gt, CAST(depth - support AS VARCHAR) || ',' || CAST(support AS VARCHAR) AS ad
FROM (SELECT lang, CAST(sum(quality) AS BIGINT) AS support, count(*) AS depth FROM labels JOIN documents USING (doc_id) GROUP BY lang)
""")
def genotype_af(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("quality").cast("long").alias("support"), F.count(F.lit(1)).alias("depth"))
    s, n = F.col("support"), F.col("depth")
    return rows.select("lang", "support", "depth", (s / n).alias("af"), aggregates.genotype(s, n).alias("gt"), aggregates.allele_depths(s, n).alias("ad"))


@query(f"SELECT doc_id, array_to_string(list_reverse(regexp_extract_all(translate(text, '{seq.CODES}{seq.CODES.lower()}', '{seq.COMPLEMENTS}{seq.COMPLEMENTS.lower()}'), '(?s).')), '') AS revcomp FROM documents")
def seq_revcomp(spark, d):
    return table(spark, d, "documents").select("doc_id", seq.reverse_complement(F.col("text")).alias("revcomp"))


@query("SELECT doc_id, word, n FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' AND length(replace(word, word[1], '')) = 0 AND length(word) >= 2 GROUP BY 1, 2)")
def seq_homopolymer(spark, d):
    tokens = table(spark, d, "documents").select("doc_id", F.explode(seq.split_nonempty(F.col("text"), " ")).alias("word"))
    return tokens.filter(seq.is_homopolymer(F.col("word")) & (F.length("word") >= 2)).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT item_id, word, regexp_full_match(word, '[{seq.CODES}{seq.CODES.lower()}]+') AS valid FROM (SELECT item_id, unnest(string_split(text, ' ')) AS word FROM benchmark) WHERE word <> ''")
def seq_alphabet(spark, d):
    tokens = table(spark, d, "benchmark").select("item_id", F.explode(seq.split_nonempty(F.col("text"), " ")).alias("word"))
    return tokens.select("item_id", "word", seq.is_valid_sequence(F.col("word")).alias("valid"))


@query()
def seq_similarity_pairs(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.col("text").alias("s"))
    after = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b"), F.col("s").alias("t"))
    return rows.join(after, "item_id").select(F.col("item_id").alias("a"), "b", F.round(seq.similarity(F.col("s"), F.col("t")), 9).alias("similarity"))


@query("""
WITH b AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, length(text) - 58), lambda i: text[i:i + 59]))) AS k FROM benchmark),
k AS (SELECT DISTINCT doc_id, unnest(list_distinct(list_transform(range(1, length(text) - 58), lambda i: text[i:i + 59]))) AS k FROM documents)
SELECT doc_id, item_id, count(*) AS shared FROM k JOIN b USING (k) GROUP BY 1, 2
""")
def kmer_containment(spark, d):
    size = 60
    items = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(seq.kmer_hashes(F.col("text"), size))).alias("h"))
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(seq.kmer_hashes(F.col("text"), size))).alias("h"))
    found = docs.join(items, "h")
    return found.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))


@query("""
WITH v AS (SELECT DISTINCT chrom, start, start AS "end", 'INS' AS svtype, CAST(l_quantity AS INTEGER) AS sv_len FROM @shipments WHERE l_linenumber = 1),
m AS (SELECT v.*, s.l_orderkey AS q, max(CAST(s.l_quantity AS INTEGER)) AS most, sum(CAST(s.l_quantity AS INTEGER)) AS total FROM v JOIN @shipments AS s ON v.chrom = s.chrom AND s.start BETWEEN v.start - 3 AND v.start + 3 GROUP BY ALL),
n AS (SELECT chrom, start, sv_len, count(DISTINCT q) AS k FROM m WHERE least(most, sv_len) >= 0.75 * greatest(most, sv_len) OR least(total, sv_len) >= 0.75 * greatest(total, sv_len) GROUP BY ALL)
SELECT v.chrom, v.start, v.sv_len, CAST(coalesce(k, 0) AS INTEGER) AS recounted FROM v LEFT JOIN n ON v.chrom = n.chrom AND v.start = n.start AND v.sv_len = n.sv_len
""")
def recounted_support(spark, d):
    rows = shipments(spark, d)
    size = F.col("l_quantity").cast("int")
    variants = rows.filter("l_linenumber = 1").select("chrom", "start", F.col("start").alias("end"), F.lit("INS").alias("svtype"), size.alias("sv_len")).distinct()
    spots = rows.select(F.col("l_orderkey").alias("qname"), "chrom", F.col("start").alias("pos"), F.lit("I").alias("op"), size.alias("len"))
    return refine.recount_support(variants, spots, 3).select("chrom", "start", "sv_len", "recounted")


@query("""
SELECT user_id, CAST(round(avg_pos) AS BIGINT) AS mean_pos, n FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, low) AS k FROM (
    SELECT user_id, run, count(*) AS n, min(pos) AS low, avg(pos) AS avg_pos FROM (
      SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY pos, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
        SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos, event_id) <= 20000 THEN 0 ELSE 1 END AS opens FROM @events)) GROUP BY user_id, run)) WHERE k = 1
""")
def modal_position(spark, d):
    rows = user_events(spark, d).select("user_id", F.lit("c").alias("chrom"), "pos")
    return breakpoints.modal_place(rows, ["user_id"], 20000).select("user_id", "mean_pos", "n")


@query("""
SELECT chrom, CAST(count(*) AS BIGINT) AS islands, CAST(sum("end" - start + 1) AS BIGINT) AS covered FROM (
  SELECT chrom, g, min(start) AS start, max("end") AS "end" FROM (
    SELECT *, sum(opens) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM @shipments)) GROUP BY chrom, g) GROUP BY chrom
""")
def covered_positions(spark, d):
    merged = intervals.merge(shipments(spark, d).select("chrom", "start", "end"))
    return merged.groupBy("chrom").agg(F.count(F.lit(1)).alias("islands"), F.sum(F.col("end") - F.col("start") + 1).alias("covered"))


@query("""
WITH t AS (SELECT conv_id, role AS a, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS b FROM conversations),
e AS (SELECT a, b, count(*) AS support FROM t WHERE b IS NOT NULL AND a <> b GROUP BY a, b)
SELECT a, b, support FROM e WHERE EXISTS (SELECT 1 FROM e AS x WHERE x.a = e.b AND x.b = e.a)
""")
def mutual_links(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    steps = table(spark, d, "conversations").select("conv_id", F.col("role").alias("side_id"), F.lead("role").over(w).alias("mate_side_id")).filter("mate_side_id is not null and side_id <> mate_side_id")
    links = steps.groupBy("side_id", "mate_side_id").agg(F.count(F.lit(1)).alias("support")).withColumn("group_id", F.lit(0))
    return refine.consistent_links(links).select(F.col("side_id").alias("a"), F.col("mate_side_id").alias("b"), "support")


@query("""
WITH u AS (SELECT DISTINCT CAST(floor(pos / 86400.0) AS BIGINT) AS day, user_id FROM @events),
d AS (SELECT day, lag(day) OVER (ORDER BY day) AS before FROM (SELECT DISTINCT day FROM u)),
s AS (SELECT d.day, count(x.user_id) AS shared FROM d LEFT JOIN (SELECT a.day, a.user_id, b.day AS other FROM u AS a JOIN u AS b ON a.user_id = b.user_id) AS x ON x.day = d.day AND x.other = d.before GROUP BY d.day)
SELECT day, CAST(sum(CASE WHEN shared >= 60 THEN 0 ELSE 1 END) OVER (ORDER BY day) AS BIGINT) AS phase_set FROM s
""")
def phase_blocks(spark, d):
    days = user_events(spark, d).select(F.floor(F.col("pos") / 86400).cast("long").alias("day"), "user_id").groupBy("day").agg(F.collect_set("user_id").alias("users"))
    nodes = days.select(F.col("day").alias("variant_id"), F.lit("c").alias("chrom"), F.col("day").alias("start"), "users").withColumn("reads", F.col("users").cast("array<string>")).withColumn("others", F.array().cast("array<string>"))
    linked = call.links_between(nodes.drop("users"), 60)
    run = Window.partitionBy("chrom").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return linked.select(F.col("start").alias("day"), F.sum((~F.col("linked")).cast("long")).over(run).alias("phase_set"))


@query("""
WITH RECURSIVE w AS (SELECT chrom, start, row_number() OVER (PARTITION BY chrom ORDER BY start) AS k FROM (SELECT DISTINCT chrom, start FROM @shipments)),
f AS (SELECT chrom, start, k, start AS anchor, 1 AS chunk FROM w WHERE k = 1
  UNION ALL SELECT w.chrom, w.start, w.k, CASE WHEN w.start < f.anchor + 100 OR (w.start < f.anchor + 200 AND w.start - f.start < 3) OR w.start - f.start < 1 THEN f.anchor ELSE w.start END,
    CASE WHEN w.start < f.anchor + 100 OR (w.start < f.anchor + 200 AND w.start - f.start < 3) OR w.start - f.start < 1 THEN f.chunk ELSE f.chunk + 1 END FROM f JOIN w ON w.chrom = f.chrom AND w.k = f.k + 1)
SELECT chrom, CAST(chunk AS INTEGER) AS chunk, min(start) AS start, max(start) AS "end", count(*) AS n FROM f GROUP BY chrom, chunk
""")
def work_chunks(spark, d):
    rows = shipments(spark, d).select("chrom", "start").distinct().withColumn("end", F.col("start"))
    return windows.chunks(rows, ["chrom"], 100, 200, 3, 1).groupBy("chrom", "chunk").agg(F.min("start").alias("start"), F.max("start").alias("end"), F.count(F.lit(1)).alias("n"))


@query()
def aligned_distance(spark, d):
    """The edit distance by full alignment in an Arrow function, as consensus work needs it."""
    import pyarrow as pa

    from ..functions.alignment import edit_distance

    rows = table(spark, d, "benchmark").select("item_id", F.upper("text").alias("s"))
    after = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b"), F.col("s").alias("t"))

    def run(batches):
        for x in batches:
            distance = [edit_distance(p, q) for p, q in zip(x.column("s").to_pylist(), x.column("t").to_pylist())]
            yield pa.RecordBatch.from_arrays([x.column("item_id"), x.column("b"), pa.array(distance, pa.int64())], names=["a", "b", "distance"])

    return rows.join(after, "item_id").mapInArrow(run, "a long, b long, distance long")


@query("""
SELECT l_orderkey, l_linenumber, pos + b + d + e + 3 - 1 AS ref_end, a + b + c + d + 3 + f AS query_len, CASE WHEN strand = '-' THEN b + c + d + 3 + f ELSE a + 1 END AS query_start, CASE WHEN strand = '-' THEN f + 1 ELSE a + b + c + d + 3 END AS query_end,
  CAST(a AS INTEGER) AS left_clip, CAST(f AS INTEGER) AS right_clip FROM @alignments
""")
def cigar_spans(spark, d):
    rows = alignments(spark, d).withColumn("ops", cg.operations(F.col("cigar")))
    o = F.col("ops")
    span = cg.read_span(o, F.col("strand") == "-")
    return rows.select("l_orderkey", "l_linenumber", cg.reference_end(F.col("pos"), o).alias("ref_end"), cg.query_length(o).alias("query_len"), span["start"].alias("query_start"), span["end"].alias("query_end"), cg.clip(o, "left")["size"].alias("left_clip"), cg.clip(o, "right")["size"].alias("right_clip"))


@query("""
SELECT chrom, op, CAST(sum(len) AS BIGINT) AS bases, CAST(sum(rpos) AS BIGINT) AS rpos_sum, CAST(sum(qpos) AS BIGINT) AS qpos_sum, count(*) AS n FROM (
  SELECT chrom, 'S' AS op, a AS len, pos AS rpos, 1 AS qpos FROM @alignments UNION ALL SELECT chrom, 'M', b, pos, a + 1 FROM @alignments UNION ALL SELECT chrom, 'I', c, pos + b, a + b + 1 FROM @alignments UNION ALL
  SELECT chrom, '=', d, pos + b, a + b + c + 1 FROM @alignments UNION ALL SELECT chrom, 'D', e, pos + b + d, a + b + c + d + 1 FROM @alignments UNION ALL SELECT chrom, 'X', 3, pos + b + d + e, a + b + c + d + 1 FROM @alignments UNION ALL
  SELECT chrom, 'H', f, pos + b + d + e + 3, a + b + c + d + 4 FROM @alignments) GROUP BY chrom, op
""")
def cigar_runs(spark, d):
    runs = cg.aligned_runs(alignments(spark, d), seq=None)
    return runs.groupBy("chrom", "op").agg(F.sum("len").alias("bases"), F.sum("rpos").alias("rpos_sum"), F.sum("qpos").alias("qpos_sum"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, op, pos, len FROM (SELECT l_orderkey, l_linenumber, 'I' AS op, pos + b AS pos, CAST(c AS INTEGER) AS len FROM @alignments UNION ALL SELECT l_orderkey, l_linenumber, 'D', pos + b + d, CAST(e AS INTEGER) FROM @alignments) WHERE len >= 4
""")
def signature_runs(spark, d):
    runs = cg.aligned_runs(alignments(spark, d), seq=None)
    return cg.signatures(runs, 4).select("l_orderkey", "l_linenumber", "op", F.col("rpos").alias("pos"), "len")


@query("""SELECT l_orderkey, l_linenumber, 'DEL' AS svtype, CAST(-b AS INTEGER) AS sv_len, pos + b AS "end", CAST(c AS INTEGER) AS dp, 'chr' || chrom AS mate_chrom, pos AS mate_pos, strand = '+' AS base_first FROM @alignments""")
def info_and_breakends(spark, d):
    """INFO text and breakend alleles, written and parsed back."""
    b, c = F.regexp_extract("cigar", "S([0-9]+)M", 1), F.regexp_extract("cigar", "M([0-9]+)I", 1)
    end = (F.col("pos") + b.cast("long")).cast("string")
    info = F.concat(F.lit("END="), end, F.lit(";SVTYPE=DEL;SVLEN=-"), b, F.lit(";DP="), c, F.lit(";;FLAG"))
    place = F.concat(F.lit("chr"), F.col("chrom").cast("string"), F.lit(":"), F.col("pos").cast("string"))
    alt = F.when(F.col("strand") == "+", F.concat(F.lit("N["), place, F.lit("["))).otherwise(F.concat(F.lit("]"), place, F.lit("]N")))
    rows = alignments(spark, d).select("l_orderkey", "l_linenumber", files.info_map(info).alias("info"), files.breakend(alt).alias("bnd"))
    get = lambda k: F.try_element_at("info", F.lit(k))
    return rows.select("l_orderkey", "l_linenumber", get("SVTYPE").alias("svtype"), get("SVLEN").cast("int").alias("sv_len"), get("END").cast("long").alias("end"), get("DP").cast("int").alias("dp"), "bnd.mate_chrom", "bnd.mate_pos", "bnd.base_first")


@query("""
WITH v AS (SELECT l_partkey AS g, count(*) FILTER (l_returnflag = 'A') AS dup, count(*) FILTER (l_returnflag = 'N') AS inv, count(*) FILTER (l_returnflag = 'R') AS tra, count(DISTINCT l_suppkey % 2) > 1 AS crosses, CAST(max(l_extendedprice) - min(l_extendedprice) AS BIGINT) AS dist FROM lineitem GROUP BY 1)
SELECT g, CASE WHEN greatest(dup, inv, tra) < 12 / 2.0 THEN 'UNC' WHEN crosses AND g % 3 = 0 THEN 'TRA' WHEN dup = greatest(dup, inv, tra) THEN 'DUP' WHEN inv = greatest(dup, inv, tra) THEN 'INV' WHEN dist < 5000 THEN 'UNC' ELSE 'TRA' END AS svtype FROM v
""")
def type_decision(spark, d):
    of = lambda f: F.count_if(F.col("l_returnflag") == f)
    rows = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("g")).agg(of("A").alias("dup"), of("N").alias("inv"), of("R").alias("tra"), (F.count_distinct(F.col("l_suppkey") % 2) > 1).alias("crosses"), F.round(F.max("l_extendedprice") - F.min("l_extendedprice")).cast("long").alias("dist"))
    return rows.select("g", splitreads.decide(F.col("dup"), F.col("inv"), F.col("tra"), F.lit(12), F.col("crosses") & (F.col("g") % 3 == 0), F.col("dist")).alias("svtype"))


@query("""
WITH s AS (SELECT chrom, start // 30 AS w, avg(l_quantity) AS mean_depth, count(*) AS signatures, min(start) AS start, max(start) AS "end", count(*) FILTER (l_linenumber >= 5) AS high_bases, avg(CASE WHEN l_linenumber >= 4 THEN 1.0 ELSE 0.0 END) AS raised FROM @shipments GROUP BY 1, 2)
SELECT chrom, w, signatures FROM s WHERE NOT (mean_depth <= 2.5 OR signatures <= 2.5 OR signatures / greatest(mean_depth, 1) < 0.05) AND NOT ("end" - start + 1 < 18) AND (signatures >= 5 OR (mean_depth < 15 AND signatures >= 2) OR (mean_depth < 6 AND signatures >= 1) OR high_bases > 0 OR raised >= 0.1)
""")
def region_gate(spark, d):
    rows = shipments(spark, d).groupBy("chrom", F.floor(F.col("start") / 30).cast("long").alias("w")).agg(
        F.avg("l_quantity").alias("mean_depth"), F.count(F.lit(1)).alias("signatures"), F.min("start").alias("start"), F.max("start").alias("end"), F.count_if(F.col("l_linenumber") >= 5).alias("high_bases"), F.avg(F.when(F.col("l_linenumber") >= 4, 1.0).otherwise(0.0)).alias("raised_share"),
    )
    rows = rows.withColumn("consensus_bases", F.lit(0)).withColumn("large_bases", F.lit(0)).withColumn("zero_bases", F.lit(0))
    return rows.filter(detect.indel_gate(5, 18)).select("chrom", "w", "signatures")


@query("""
WITH v AS (SELECT DISTINCT chrom, start FROM @shipments WHERE l_linenumber = 1)
SELECT v.chrom, v.start, CAST(count(DISTINCT s.l_orderkey) AS INTEGER) AS dp FROM v JOIN @shipments AS s ON v.chrom = s.chrom AND s.start <= v.start AND v.start <= s."end" GROUP BY v.chrom, v.start
""")
def spanning_depth(spark, d):
    rows = shipments(spark, d)
    calls = rows.filter("l_linenumber = 1").select("chrom", "start").distinct().withColumn("support", F.lit(0))
    return call.spanning_depth(calls, rows.withColumn("qname", F.col("l_orderkey").cast("string"))).select("chrom", "start", "dp")


@query("""
WITH n AS (SELECT chrom, start, CAST("end" - start AS INTEGER) AS size, l_orderkey, l_linenumber FROM @shipments WHERE l_linenumber > 1), k AS (SELECT chrom AS c, start AS s, CAST("end" - start AS INTEGER) AS z FROM @shipments WHERE l_linenumber = 1)
SELECT chrom, start, size, l_orderkey, l_linenumber FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE c = chrom AND abs(start - s) < 10 AND least(size, z) > 0.9 * greatest(size, z))
""")
def unknown_variants(spark, d):
    rows = shipments(spark, d).select("chrom", "start", (F.col("end") - F.col("start")).cast("int").alias("sv_len"), "l_orderkey", "l_linenumber")
    return dedup.not_already_known(rows.filter("l_linenumber > 1"), rows.filter("l_linenumber = 1")).select("chrom", "start", F.col("sv_len").alias("size"), "l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey, l_returnflag) AS most FROM lineitem) WHERE l_quantity >= 30 OR l_quantity >= 0.5 * most""")
def small_signatures(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("op"), F.col("l_quantity").alias("len"))
    return dedup.drop_small_signatures(rows, ["l_orderkey"], 0.5, 30).select("l_orderkey", "l_linenumber")


@query("""
WITH z AS (SELECT chrom, prev + 1 AS s, start - 1 AS e FROM (SELECT chrom, start, lag(top) OVER (PARTITION BY chrom ORDER BY start) AS prev FROM (
    SELECT chrom, g, min(start) AS start, max("end") AS top FROM (SELECT *, sum(opens) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM @shipments)) GROUP BY chrom, g)) WHERE start - prev - 1 >= 2),
x AS (SELECT z.chrom, least(z.s, min(l.start)) AS s, greatest(z.e, max(l."end")) AS e FROM z JOIN @shipments AS l ON l.chrom = z.chrom AND l.start <= z.e + 1 AND z.s <= l."end" + 1 GROUP BY z.chrom, z.s, z.e),
u AS (SELECT * FROM z UNION ALL SELECT * FROM x)
SELECT chrom, min(s) AS start, max(e) AS "end" FROM (SELECT *, sum(opens) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM u)) GROUP BY chrom, g
""")
def zero_cov_extended(spark, d):
    rows = shipments(spark, d).select("chrom", "start", "end")
    return refine.extend_zero_runs(intervals.gaps(rows), rows)


@query("""
SELECT l_orderkey, l_suppkey, q FROM (SELECT l_orderkey, l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY sum(l_quantity) DESC, l_suppkey) AS r, sum(sum(l_quantity)) OVER (PARTITION BY l_orderkey) AS t FROM lineitem GROUP BY 1, 2) WHERE r <= 2 AND q >= 0.1 * t
""")
def strongest_mates(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").cast("long").alias("support"))
    rows = rows.select(F.col("l_orderkey").alias("group_id"), F.lit(0).alias("side_id"), F.lit("R").alias("end"), F.col("l_suppkey").alias("mate_side_id"), "support")
    return refine.top_mates(rows).select(F.col("group_id").alias("l_orderkey"), F.col("mate_side_id").alias("l_suppkey"), F.col("support").alias("q"))


@query()
def similar_neighbours(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("k"), F.col("text").alias("s"))
    rows = rows.withColumn("p", F.lag("s").over(Window.orderBy("k"))).filter("p is not null")
    return rows.select("k", seq.is_similar(F.col("s"), F.col("p"), 0.25).alias("alike"))


@query("""SELECT item_id, i AS pos, upper(reverse(translate(text[i:i], 'ACGTacgt', 'TGCAtgca'))) AS base FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark) WHERE regexp_full_match(text[i:i], '[ACGTacgt]')""")
def complement_bases(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", "text", F.explode(F.expr("if(length(text) > 0, sequence(1, length(text)), null)")).alias("i"))
    rows = rows.withColumn("b", F.substring("text", F.col("i"), F.lit(1))).filter(F.col("b").rlike("^[ACGTacgt]$"))
    return rows.select("item_id", F.col("i").cast("long").alias("pos"), F.upper(seq.base_at(F.col("b"), F.lit(1), F.lit(True))).alias("base"))
