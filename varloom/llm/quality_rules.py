"""Quality rules: text measures, and a hashed n-gram log-likelihood ratio with a threshold.

Words and word pairs are hashed to ``buckets`` places each, a power of two that grows with the
corpus from ``BUCKETS`` to ``MOST_BUCKETS``. Two multinomials over the places, of the trusted
target and of the raw corpus, give every place a weight log(p_target / p_raw); a document's
score is the mean weight of its n-grams, and it is kept if it passes the base rules and the score
is at least ``threshold``. The raw corpus is all documents; the target is fitted to at most
``sample`` documents labelled good, chosen by hash, so that only so many ids are ever broadcast
and no text is shuffled. Texts are in two folds by hash, and each fold is scored by the other's
target, so that documents with and without a label score alike and the cut that parts labelled
good from labelled bad ones best is ``threshold`` for all. The same text always gets the same
verdict. Only labels whose crc32(doc_id) mod 3 is not 1 teach; the others can measure. The
weights, 4 * ``MOST_BUCKETS`` doubles (8 MB) at most, are one row of a table that goes to each task.

Everything is a DataFrame or SQL function. Repeated three-word windows are found inside a row
by sorting window hashes, so no window leaves its document.

Nulls and odd rows: a null or empty text has no words, so it fails the base rules; labels
with a null id or quality are no target; with an empty target all weights are 0; where labels
or scores do not tell good from bad, ``threshold`` is ``THRESHOLD``; repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_crc32, materialize, text_bytes, text_or_empty, words

#: Places each of words and of pairs: one for so many bytes of text, between the two bounds.
BUCKETS, MOST_BUCKETS, BYTES_A_PLACE = 65_536, 262_144, 128
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Only for a corpus without labels of both kinds: a document of trusted text scores about 0.
THRESHOLD = -0.12
SMOOTHING = 1.0
CUTS = 10_000
#: Documents labelled good that the target is fitted to, at most.
SAMPLE = 20_000


def base_measures(docs: DataFrame) -> DataFrame:
    """doc_id, fold, hashes (of the words, in order), n_words and the four measures of every row."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty("text").cast("string").alias("text"))
    rows = rows.withColumn("w", words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    return rows.select(
        "doc_id",
        F.expr(_FOLD).alias("fold"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("hashes"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )


def repeated_words() -> str:
    """SQL: number of words in three-word windows that occur at least twice, from ``hashes``.

    Windows sorted by hash stand beside their equals; the starts of those that have one, in
    order, each cover three words or as many as come before the next start. Most texts have no
    such window, which their distinct hashes tell.
    """
    windows = "if(size(hashes) < 3, cast(array() as array<bigint>), transform(sequence(0, size(hashes) - 3), i -> xxhash64(hashes[i], hashes[i + 1], hashes[i + 2])))"
    by_hash = "sort_array(transform(win, (h, i) -> named_struct('h', h, 'i', i)))"
    found = "sort_array(transform(filter(pairs, (x, k) -> (k > 0 and pairs[k - 1].h = x.h) or (k < size(pairs) - 1 and pairs[k + 1].h = x.h)), x -> x.i))"
    covered = "aggregate(starts, named_struct('n', 0L, 'until', 0), (a, p) -> named_struct('n', a.n + 3 - greatest(0, a.until - p), 'until', p + 3)).n"
    # Bound by lambdas, so that each step is evaluated once.
    return f"transform(array({windows}), win -> if(size(array_distinct(win)) = size(win), 0L, transform(array({by_hash}), pairs -> transform(array({found}), starts -> {covered})[0])[0]))[0]"


def measures(docs: DataFrame) -> DataFrame:
    """base_measures with n_repeat_words and base_failed."""
    rows = base_measures(docs).withColumn("n_repeat_words", F.expr(repeated_words()))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    return rows.withColumn("base_failed", failed)


def buckets_for(n_bytes: int) -> int:
    """Places each of words and of pairs for a corpus of so many bytes of text."""
    return max(BUCKETS, min(MOST_BUCKETS, 1 << max(0, n_bytes // BYTES_A_PLACE - 1).bit_length()))


#: Half of all texts, by hash: a text is never judged by a target that holds it.
_FOLD = "cast(pmod(hash(text), 2) as int)"


def _word(buckets: int, h: str) -> str:
    return f"cast(pmod({h}, {buckets}) as int)"


def _pair(buckets: int, g: str, h: str) -> str:
    return f"{buckets} + cast(pmod(xxhash64({g}, {h}), {buckets}) as int)"


def teaching() -> Column:
    """Whether a label's document may teach."""
    return id_crc32() % 3 != 1


def trusted_sample(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """trusted_id: at most ``sample`` ids of documents labelled good, the first by hash."""
    ids = labels.filter("quality = 1 and doc_id is not null").filter(teaching()).select(labels["doc_id"].cast("long").alias("trusted_id")).distinct()
    return ids.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(sample)


def place_counts(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, sample: int = SAMPLE) -> DataFrame:
    """place, raw, target0, target1: n-grams of all documents, and of the trusted ones of each fold."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(trusted_sample(labels, sample)), F.col("doc_id") == F.col("trusted_id"), "left")
    good = [F.expr(f"cast(trusted_id is not null and {_FOLD} = {k} as int)").alias(f"good{k}") for k in (0, 1)]
    hashed = rows.select(*good, F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("h"))
    both = hashed.select("good0", "good1", F.explode(F.arrays_zip("h", F.slice("h", 2, 1 << 30).alias("next"))).alias("x"))
    # A document's last word has no pair.
    each = both.select("good0", "good1", F.expr(f"explode(array({_word(buckets, 'x.h')}, if(x.next is null, null, {_pair(buckets, 'x.h', 'x.next')})))").alias("place")).filter("place is not null")
    return each.groupBy("place").agg(F.count(F.lit(1)).alias("raw"), F.sum("good0").alias("target0"), F.sum("good1").alias("target1"))


def place_weights(counts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row (first, second): log(p_target / p_raw) of every place, for documents of fold 0 and 1.

    Words and pairs are a multinomial each. A fold's target is the trusted ones of the other
    fold; where a fold has no trusted documents, both use all of them.
    """
    table = materialize(counts.withColumn("kind", (F.col("place") >= buckets).cast("int")), "counts")
    lone = F.expr("max(sum(target0)) over () = 0 or max(sum(target1)) over () = 0")
    sums = table.groupBy("kind").agg(F.sum("raw").alias("r"), F.sum("target0").alias("t0"), F.sum("target1").alias("t1"), lone.alias("lone"))
    rows = table.join(F.broadcast(sums), "kind")  # two rows

    def weight(other: str) -> Column:
        t, total = (F.when(F.col("lone"), F.col(f"{a}0") + F.col(f"{a}1")).otherwise(F.col(f"{a}{other}")) for a in ("target", "t"))
        # The raw counts on the target's scale, so that the smoothing is the same for both.
        return F.when(total > 0, F.log((t + SMOOTHING) / (F.col("raw") * (total / F.col("r")) + SMOOTHING))).otherwise(0.0)

    each = rows.select("place", weight("1").alias("first"), weight("0").alias("second"))
    every = _places(counts, 2 * buckets).join(each, "place", "left")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce(c, F.lit(0.0)).alias("w")))), lambda x: x["w"]).alias(c)
    return materialize(every.agg(listed("first"), listed("second")), "weights")  # 2 * buckets numbers each


def _places(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("place"))


def scored(docs: DataFrame, weights: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """All measures and score (mean weight of the n-grams, 0 without words), row by row."""
    # Read once and sent with the tasks: as an expression so many literals take long to plan.
    mine = F.when(F.col("fold") == 0, weights.select("first").scalar()).otherwise(weights.select("second").scalar())
    pairs = _pair(buckets, "hashes[i - 1]", "hashes[i]")
    total = f"aggregate(sequence(0, size(hashes) - 1), 0D, (a, i) -> a + t[{_word(buckets, 'hashes[i]')}] + if(i > 0, t[{pairs}], 0D))"
    rows = measures(docs).withColumn("__t", F.array(mine))
    return rows.withColumn("score", F.expr(f"if(size(hashes) = 0, 0D, transform(__t, t -> {total})[0] / (2 * size(hashes) - 1))")).drop("hashes", "fold", "__t")


def separating(scores: DataFrame, labels: DataFrame) -> float:
    """The threshold that gives labelled documents the most right verdicts, good and bad ones weighing the same in all.

    It is the middle of the lowest gap between scores where that holds, to 1 / ``CUTS`` of their range. Only documents that pass the base rules count, as the others are dropped anyway.
    """
    marked = labels.filter("doc_id is not null and quality in (0, 1)").filter(teaching()).groupBy(labels["doc_id"].cast("long").alias("marked_id")).agg(F.max("quality").alias("good"))
    rows = scores.filter("not base_failed").select("doc_id", "score").join(marked.hint("merge"), F.col("doc_id") == F.col("marked_id"))
    low, high = rows.agg(F.min("score"), F.max("score")).first()
    if low is None or low == high:
        return THRESHOLD
    width = (high - low) / CUTS
    by = {g: [0] * (CUTS + 1) for g in (0, 1)}
    for r in rows.groupBy("good", F.floor((F.col("score") - low) / width).cast("int").alias("cut")).count().collect():  # 2 * (CUTS + 1) rows at most
        by[r.good][min(r.cut, CUTS)] += r["count"]
    bad, good = sum(by[0]), sum(by[1])
    if not bad or not good:
        return THRESHOLD
    # Right verdicts, times bad * good, if what lies below a cut is dropped.
    right, gain = [], good * bad
    for b, g in zip(by[0], by[1]):
        right.append(gain)
        gain += b * good - g * bad
    best = max(right)
    if best <= good * bad:
        return THRESHOLD
    first = right.index(best)
    last = first
    while last < CUTS and right[last + 1] == best:
        last += 1
    return round(low + (first + last) / 2 * width, 6)


def decide(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def judge(docs: DataFrame, weights: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """``scored`` with kept."""
    return decide(scored(docs, weights, buckets), threshold)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row's verdict, with weights and threshold from the labelled documents among ``docs``."""
    buckets = buckets_for(text_bytes(docs))
    scores = materialize(scored(docs, place_weights(place_counts(docs, labels, buckets), buckets), buckets), "scores")
    return decide(scores, separating(scores, labels))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
