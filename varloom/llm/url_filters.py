"""URL filters by a sort-merge range join with a stack of nested rules.

A rule (host, path) fits its host and all subdomains where the url's path starts with the
rule's. Written as reversed host, separator, path, the urls that a rule fits under one exact
host form an interval of keys; rules of a host nest or are disjoint. A url has one key for
each suffix of its host that is as long as some rule's host, so subdomains need no interval
of their own. Keys and interval edges are range-partitioned and sorted together; a sweep over
the sorted rows hands each key the stack of rules that are open there, outermost first.

An edge carries the stack that holds after it: a rule's own ancestors and itself where its
interval opens, its ancestors alone where it closes. The ancestors are the rules whose path
is a shorter prefix, found by equality. So the sweep is a running 'last edge' inside each
range, with the last edge of earlier ranges carried in.

The longest rule (host and path together) wins, of equally long ones the one with the longer
host. Everything is a DataFrame or SQL function; keys are reduced to distinct ones first, so
a url, host or path that a third of all rows share is one row in the sweep.

Nulls and odd rows: a null url or one without '://' has an empty host and path and fits no
rule; a null page_id is kept; repeated rows give a row each; of rules given twice with
different verdicts, block wins; an empty table gives no rows; without rules everything gets
the default verdict; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, documents, materialize

RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
DEFAULT = "allow"
#: Sorts below every character of hosts and paths but controls; ends the host in a key.
_SEP = "\x01"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, "[.]")), ".")


def _labels(host: Column) -> Column:
    return F.size(F.split(host, "[.]"))


def rule_table(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    """verdict, host, path, rule, key, labels of each distinct rule."""
    table = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    table = table.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    key = F.concat(_reversed(F.col("host")), F.lit(_SEP), F.col("path")).cast("binary")
    return table.select("verdict", "host", "path", F.concat("host", "path").alias("rule"), key.alias("key"), _labels(F.col("host")).alias("labels"))


def edges(rules: DataFrame) -> DataFrame:
    """key (bytes), after (0: before equal url keys, 1: after all that start with key), depth, stack."""
    entry = F.struct(F.length("path").alias("size"), "rule", "verdict", F.length("host").alias("host_size"))
    table = rules.select("key", "host", "path", entry.alias("entry"))
    shorter = table.select("host", F.col("path").alias("prefix"), F.col("entry").alias("above"))
    prefixes = table.select("key", "host", "path", "entry", F.explode(F.expr("transform(sequence(0, length(path)), n -> substring(path, 1, n))")).alias("prefix"))
    nested = prefixes.join(shorter, ["host", "prefix"]).groupBy("key", "path").agg(F.array_sort(F.collect_list("above")).alias("stack"))
    opened = nested.select("key", F.lit(0).alias("after"), F.size("stack").alias("depth"), "stack")
    # No text holds the byte FF, so this sorts right behind everything that begins with the key.
    closed = nested.select(F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(1).alias("after"), (-F.size("stack")).alias("depth"), F.expr("slice(stack, 1, size(stack) - 1)").alias("stack"))
    return opened.unionByName(closed)


def sweep(keys: DataFrame, marks: DataFrame, partitions: int) -> DataFrame:
    """(key, stack): the rules open at each key, by one ordered pass over keys and edges.

    Rows are cut into ranges of the key; the range is fixed in a written table, so the pass
    and the carry see the same ranges.
    """
    rows = keys.select("key", F.lit(2).alias("after"), F.lit(0).alias("depth"), F.lit(None).cast(marks.schema["stack"].dataType).alias("stack"), F.lit(True).alias("url"))
    rows = rows.unionByName(marks.withColumn("url", F.lit(False)))
    ranged = materialize(rows.repartitionByRange(partitions, "key").withColumn("range", F.spark_partition_id()), "ranges")
    ordered = F.struct("key", "after", "depth").alias("o")
    last = ranged.filter("not url").groupBy("range").agg(F.max_by("stack", ordered).alias("own"))
    carried = F.last("own", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    every = ranged.select("range").distinct().join(last, "range", "left").select("range", carried.alias("carried"))
    inside = F.last("stack", ignorenulls=True).over(Window.partitionBy("range").orderBy("key", "after", "depth").rowsBetween(Window.unboundedPreceding, 0))
    swept = ranged.withColumn("inside", inside).filter("url").join(every, "range")
    return swept.select("key", F.coalesce("inside", "carried").alias("stack"))


def judge_urls(pages: DataFrame, rules: tuple = RULES, default: str = DEFAULT, partition_rows: int = 1_000_000) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    spark = pages.sparkSession
    if "page_id" not in pages.columns:
        raise ValueError("page_id is missing")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    if not rules:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    depths = sorted({len(h.split(".")) for _, h, _ in rules})
    wanted = F.array(*[F.when(_labels(F.col("host")) >= n, F.substring_index("host", ".", -n)) for n in depths])
    sites = rows.filter("host <> ''").select("host", "path").distinct()
    suffixes = sites.select("host", "path", F.explode(F.array_distinct(F.array_compact(wanted))).alias("suffix"))
    table = rule_table(spark, rules)
    suffixes = suffixes.join(table.select(F.col("host").alias("suffix")).distinct(), "suffix", "left_semi")
    keyed = materialize(suffixes.select("host", "path", F.concat(_reversed(F.col("suffix")), F.lit(_SEP), F.col("path")).cast("binary").alias("key")), "keyed")
    partitions = max(1, -(-keyed.count() // partition_rows))
    open_ = sweep(keyed.select("key").distinct(), edges(table), partitions)
    top = F.expr("element_at(stack, -1)")
    best = F.max(F.struct((F.col("top.size") + F.col("top.host_size")).alias("total"), F.col("top.host_size").alias("host_size"), F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict"))).alias("b")
    # Both grow with the urls, so neither is ever broadcast.
    fitting = keyed.join(open_.hint("merge"), "key").filter("size(stack) > 0").select("host", "path", top.alias("top"))
    judged = materialize(fitting.groupBy("host", "path").agg(best).select("host", "path", "b.rule", "b.verdict"), "judged")
    return rows.join(judged.hint("merge"), ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(documents(spark, sf_dir, "pages"))


_SQL_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
SQL = rf"""
WITH rules(verdict, rhost, rpath) AS (VALUES {_SQL_RULES}),
cut AS (SELECT page_id, CASE WHEN url IS NOT NULL AND contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
),
fits AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) AS rule, arg_max(verdict, length(rhost || rpath) * 1000 + length(rhost)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts), rules
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path
)
SELECT page_id, parts.host, parts.path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM parts LEFT JOIN fits ON parts.host = fits.host AND parts.path = fits.path
"""
