"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents fall into blocks by hash. Its target is a quota of block copies: every block
as often as the target holds the whole source, then blocks without repeats in permuted order, the
last one up to the word that meets the target. A tree deals the quotas of all sources to output
shards: it halves the shards, and at each node the left half's count of each source is drawn from
the multivariate hypergeometric distribution, so every shard has an exact quota of every source.
The quotas cut each source's block copies, in a second permutation, into disjoint runs, one a
shard; a document is taken as often as runs hold copies of its block. Within a shard rows are
ordered by hash.

Everything is a DataFrame or SQL function. Blocks hold ``BLOCK_DOCS`` documents on average, so
their number follows the corpus as that of the shards does. Running totals go in two levels, over
pieces of about the square root of their length; the tree's nodes are dealt to tasks anew every
eight levels. Windows also run over the table of sources, and over the documents of the one
block of a source that its target cuts. All draws come from hashes, so reruns agree.

Nulls and odd rows: a null source is a source of its own, last in order; a null or empty text
has size 0 and takes 0; a null doc_id is hashed as null; repeated rows are planned and taken one
by one; an empty table gives no rows; other columns are ignored, or carried by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, text_or_empty, words

#: Targets stop at this multiple of a source's size; so does what a document gives.
REPEATS = 3
BLOCK_DOCS = 256
#: Ranks of block copies that meet their runs in one key of a join.
RANKS = 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sid, source, source_size, n_docs, target: one row for each source.

    Weights repeat over the sources in code-point order, null last. Sources whose share would
    pass the cap are settled in the order of cap over weight; what is left goes to the others.
    """
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    table = table.withColumn("sid", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(REPEATS))
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    table = table.withColumn("left", F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    table = table.withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    full = F.col("cap") * F.col("weight_left") <= F.col("left") * F.col("weight")
    # The first source that stays under its cap sets the level; later ones see the same level.
    level = F.first(F.when(~full, F.col("left") / F.col("weight_left")), ignorenulls=True).over(by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return table.select("sid", "source", "source_size", "n_docs", F.when(F.col("source_size") == 0, 0.0).otherwise(target).alias("target"))


def running_total(df: DataFrame, piece: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of a source before each one, in ``order``.

    ``piece`` never falls in that order; the totals of pieces are added up first.
    """
    rows = df.withColumn("__piece", piece)
    totals = rows.groupBy("sid", "__piece").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy("sid").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("sid", "__piece", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("sid", "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(totals, ["sid", "__piece"]).withColumn(name, F.col("__before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.drop("__piece", "__before")


def _piece(order: str, count: str) -> Column:
    """About sqrt(count) equal ranges of a 64-bit hash."""
    return F.floor((F.col(order) / float(1 << 64) + 0.5) * F.ceil(F.sqrt(F.col(count)))).cast("int")


def split_tree(copies: DataFrame, shards: int, seed: int) -> DataFrame:
    """(sid, shard, quota, first, until): the run of each source's permuted copies for each shard.

    ``copies``: sid, copies. Node by node, level by level; a node holds one count a source.
    """
    root = copies.agg(F.array_sort(F.collect_list(F.struct("sid", "copies"))).alias("s")).filter("size(s) > 0")
    nodes = root.select(F.expr("transform(s, x -> x.sid)").alias("s"), F.expr("transform(s, x -> x.copies)").alias("counts"), F.lit(0).alias("low"), F.lit(shards).alias("n"))
    uniform = f"pmod(xxhash64({seed}, low, n, i, j), 4503599627370496) / 4503599627370496D"
    one = f"if({uniform} * a.total < a.room, 1L, 0L)"
    # Copy by copy, a stretch of them at a time.
    stretch = 65_536
    draw = f"aggregate(sequence(k * {stretch} + 1, least(counts[i], (k + 1) * {stretch})), b, (a, j) -> named_struct('x', a.x + {one}, 'room', a.room - {one}, 'total', a.total - 1L))"
    draws = f"if(counts[i] > 0, aggregate(sequence(0L, (counts[i] - 1) div {stretch}), named_struct('x', 0L, 'room', acc.room, 'total', acc.total), (b, k) -> {draw}), named_struct('x', 0L, 'room', acc.room, 'total', acc.total))"
    step = f"transform(array({draws}), d -> named_struct('room', d.room, 'total', d.total, 'lefts', concat(acc.lefts, array(d.x))))[0]"
    total = "aggregate(counts, 0L, (t, c) -> t + c)"
    room = f"cast(round({total} * (n div 2) / n) as bigint)"
    lefts = f"aggregate(sequence(0, size(counts) - 1), named_struct('room', {room}, 'total', {total}, 'lefts', cast(array() as array<bigint>)), (acc, i) -> {step}).lefts"
    for level in range(max(0, (shards - 1).bit_length())):
        if level and level % 8 == 0:
            nodes = nodes.repartition("low")
        split = nodes.withColumn("lefts", F.when(F.col("n") > 1, F.expr(lefts)))
        halves = F.expr(
            "if(n > 1, array(named_struct('counts', lefts, 'low', low, 'n', cast(n div 2 as int)), named_struct('counts', transform(counts, (c, i) -> c - lefts[i]), 'low', cast(low + n div 2 as int), 'n', cast(n - n div 2 as int))), array(named_struct('counts', counts, 'low', low, 'n', n)))"
        )
        nodes = split.select("s", F.explode(halves).alias("h")).select("s", "h.counts", "h.low", "h.n")
    leaves = nodes.select(F.col("low").alias("shard"), F.posexplode("s").alias("i", "sid"), "counts").select("shard", "sid", F.expr("counts[i]").alias("quota"))
    wide = max(1, round(shards**0.5))
    return running_total(leaves, F.expr(f"shard div {wide}"), ["shard"], "quota", "first").withColumn("until", F.col("first") + F.col("quota"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), shard_words: int = 500_000, seed: int = 11, row: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, shards: what the mix takes of every row.

    ``shards`` names an output shard for each copy of the document, the last one being the
    part copy if ``taken`` is no multiple of ``size``. ``row``: a column to carry.
    """
    text = text_or_empty("text").cast("string")
    carried = [F.col(row).alias("__row")] if row else []
    thin = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), F.size(words(text)).cast("long").alias("size"), F.xxhash64(F.lit(seed), docs["doc_id"].cast("long"), text).alias("h"), *carried)
    thin = materialize(thin, "sizes")
    quota = F.round("target").cast("long")
    repeats = F.when(F.col("source_size") > 0, F.least(F.lit(REPEATS), F.expr("quota div source_size"))).otherwise(0).cast("int")
    stats = source_targets(thin, weights).withColumn("quota", quota).withColumn("repeats", repeats)
    stats = stats.withColumn("rest", F.col("quota") - F.col("repeats") * F.col("source_size")).withColumn("n_blocks", F.ceil(F.col("n_docs") / BLOCK_DOCS))
    stats = materialize(stats, "sources")
    rows = thin.alias("d").join(stats.alias("s"), F.expr("d.source <=> s.source")).select("d.*", "s.sid", "s.source_size", "s.target", "s.repeats", "s.rest", "s.n_blocks").withColumn("block", F.pmod("h", "n_blocks"))
    rows = materialize(rows.drop("repeats", "rest", "n_blocks"), "rows")

    # The copies that a source's target takes of each block.
    blocks = rows.groupBy("sid", "block").agg(F.sum("size").alias("words")).join(stats.select("sid", "repeats", "rest", "n_blocks"), "sid").withColumn("o", F.xxhash64(F.lit(seed), "block"))
    blocks = running_total(blocks, _piece("o", "n_blocks"), ["o", "block"], "words", "before")
    need = F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before")))
    blocks = materialize(blocks.withColumn("need", need).withColumn("copies", F.col("repeats") + (F.col("need") > 0).cast("int")).select("sid", "block", "words", "repeats", "need", "copies", "n_blocks"), "blocks")

    # The tree's quotas, and the run of copies that each shard draws.
    total = rows.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-int(total) // shard_words))
    each = blocks.filter("copies > 0").select("sid", "block", "n_blocks", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    runs = materialize(split_tree(each.groupBy("sid").agg(F.count(F.lit(1)).alias("copies")), shards, seed), "runs")
    ranked = each.withColumn("o", F.xxhash64(F.lit(seed + 1), "block", "copy")).withColumn("one", F.lit(1))
    ranked = running_total(ranked, _piece("o", "n_blocks"), ["o", "block", "copy"], "one", "rank").withColumn("key", F.expr(f"rank div {RANKS}"))
    keyed = runs.filter("quota > 0").select("sid", "shard", "first", "until", F.explode(F.expr(f"sequence(first div {RANKS}, (until - 1) div {RANKS})")).alias("key"))
    drawn = ranked.join(keyed, ["sid", "key"]).filter("rank >= first and rank < until")
    drawn = drawn.groupBy("sid", "block").agg(F.expr("transform(array_sort(collect_list(struct(copy, shard))), x -> x.shard)").alias("shards"))
    blocks = materialize(blocks.join(drawn, ["sid", "block"], "left").select("sid", "block", "words", "repeats", "need", F.coalesce("shards", F.array().cast("array<int>")).alias("shards")), "drawn")

    # Every document is taken once for each copy of its block that a shard drew; of the block
    # that the target cuts, the last copy holds documents in hash order while there is need.
    joined = rows.join(blocks, ["sid", "block"])
    whole = joined.filter("need = 0 or need = words").withColumn("taken", F.size("shards") * F.col("size"))
    inside = Window.partitionBy("sid", "block").orderBy(F.xxhash64(F.lit(seed + 2), "h"), "h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    cut = joined.filter("need > 0 and need < words").withColumn("earlier", F.sum("size").over(inside) - F.col("size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("need") - F.col("earlier")))
    cut = cut.withColumn("part", part).withColumn("taken", (F.size("shards") - 1) * F.col("size") + F.col("part"))
    cut = cut.withColumn("shards", F.when(F.col("part") > 0, F.col("shards")).otherwise(F.slice("shards", 1, F.size("shards") - 1)))
    columns = ["doc_id", "size", "source_size", "target", "taken", "source", "shards", *(["__row"] if row else [])]
    return whole.select(columns).unionByName(cut.select(columns))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: each taken copy of a document, a part copy cut to its first words.

    Rows of a shard lie together, in hash order. ``n_chars``, where it exists, is renewed.
    """
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    plan = plan_mix(numbered, row="__row", **options).filter("taken > 0")
    plan = plan.select("__row", F.col("size").alias("__size"), F.col("taken").alias("__taken"), F.posexplode("shards").alias("__copy", "__shard"))
    length = F.least(F.col("__size"), F.col("__taken") - F.col("__copy") * F.col("__size"))
    copies = numbered.join(plan.withColumn("__length", length).filter("__length > 0"), "__row")
    parted = F.array_join(F.slice(words(text_or_empty("text")), F.lit(1), F.col("__length").cast("int")), " ")
    text = F.when(F.col("__length") < F.col("__size"), parted).otherwise(F.col("text"))
    copies = copies.withColumn("text", text)
    if "n_chars" in docs.columns:
        copies = copies.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return copies.repartition("__shard").sortWithinPartitions("__shard", F.xxhash64("doc_id", "__copy")).select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(documents(spark, sf_dir))
