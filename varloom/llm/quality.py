"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

    y = w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

The last term holds all pairwise interactions in time linear in the features of a text. The
features: words hashed to ``BUCKETS`` places (damped counts, unit length), and measures of a
text's structure with its ``n_chars`` column, standardised.

The machine is fitted on the driver to a bounded, hash-chosen sample of labelled rows
(``sample`` documents at most, halved between the labels, and of each half as many as have
``sample_features`` / 2 features together); every document is scored. What is broadcast is the
sample's ids and labels, and the model: both of a fixed size. The driver holds 24 bytes a feature.

Nulls and odd rows: a null or empty text is scored by its structure; a null n_chars counts as
the text's length; rows with a null id or label teach nothing; rows that repeat a labelled
doc_id teach once, by the text of the least hash, and labels that contradict count as good;
repeated rows are scored once each; with labels of fewer than two kinds every score is that kind's (0.5 without any); an
empty table gives no rows; other columns are ignored, or kept by ``keep_good``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, id_crc32, materialize, slices, small_batches

BUCKETS = 1 << 16
STRUCTURE = ("log_words", "word_length", "upper", "digit", "symbol", "exclaim", "punctuation", "other_byte", "distinct", "dup_lines", "line_length", "upper_words", "log_chars", "chars_a_byte")
WIDTH = BUCKETS + len(STRUCTURE)
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[48:58], _CLASS[[ord(c) for c in "#*$%&|<>"]], _CLASS[33], _CLASS[[ord(c) for c in ".,;:?"]], _CLASS[128:] = 1, 2, 3, 4, 5, 6


def featurise(texts: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, word buckets and values of each text, and its structure (texts x measures)."""
    pa.set_memory_pool(pa.system_memory_pool())  # gives back at once what a batch has used
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    n = len(texts)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(x.as_py().encode() for x in texts), np.uint8)
    kind = _CLASS[data]

    def share(k: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        return (total[ends[1:]] - total[ends[:-1]]) / np.maximum(size, 1)

    lists = pc.ascii_split_whitespace(texts)
    flat, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(flat)
    names = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy(zero_copy_only=False)
    real = np.array([bool(w) for w in names] or [False])
    bucket = np.array([zlib.crc32(w.encode().lower()) % BUCKETS for w in names] or [0], np.int64)
    shout = np.array([len(w) > 1 and w.isupper() for w in names] or [False])
    if len(code):
        keep = real[code]
        code, owner = code[keep], owner[keep]
    words = np.bincount(owner, minlength=n).astype(np.float64)
    letters = np.bincount(owner, weights=np.array([len(w) for w in names] or [0], float)[code] if len(code) else None, minlength=n)
    shouted = np.bincount(owner, weights=shout[code].astype(float) if len(code) else None, minlength=n)
    key, count = np.unique(owner.astype(np.int64) * BUCKETS + (bucket[code] if len(code) else 0), return_counts=True)
    row, index = key // BUCKETS, key % BUCKETS
    per_doc = np.bincount(row, minlength=n)
    value = np.log1p(count)
    value = value / np.sqrt(np.bincount(row, weights=value * value, minlength=n))[row]
    lines = np.zeros((n, 2))
    for i, x in enumerate(texts):
        parts = [p for p in x.as_py().split("\n") if p.strip()]
        lines[i] = (1 - len(set(parts)) / len(parts) if parts else 0, np.log1p(sum(map(len, parts)) / max(1, len(parts))))
    length = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.float64)
    chars = pc.coalesce(n_chars.cast(pa.float64()), pa.array(length)).to_numpy(zero_copy_only=False)
    many = np.maximum(words, 1)
    structure = np.stack([np.log1p(words), letters / many, share(1), share(2), share(3), share(4), share(5), share(6), per_doc / many, lines[:, 0], lines[:, 1], shouted / many, np.log1p(np.maximum(chars, 0)), np.maximum(chars, 0) / np.maximum(size, 1)], axis=1)
    return np.concatenate([[0], np.cumsum(per_doc)]), index, value, structure


class FactorisationMachine:
    """Weights, factors and the standardisation of the structure measures."""

    def __init__(self, factors: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(WIDTH, np.float32)
        self.v = (0.02 * rng.standard_normal((WIDTH, factors))).astype(np.float32)
        self.mean, self.deviation = np.zeros(len(STRUCTURE)), np.ones(len(STRUCTURE))

    def inputs(self, features: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, indices and values with the standardised structure appended."""
        bounds, index, value, structure = features
        n, m = structure.shape
        z = np.clip((structure - self.mean) / self.deviation, -4, 4) / 2
        row = np.concatenate([np.repeat(np.arange(n), np.diff(bounds)), np.repeat(np.arange(n), m)])
        return row, np.concatenate([index, np.tile(np.arange(BUCKETS, WIDTH), n)]), np.concatenate([value, z.ravel()])

    def ordered(self, features: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``inputs``, document after document in 8 bytes a feature, and where each document begins."""
        bounds, index, value, structure = features
        n, m = structure.shape
        z = np.clip((structure - self.mean) / self.deviation, -4, 4) / 2
        begin = bounds + m * np.arange(n + 1)
        own = np.ones(begin[-1], bool)
        own[(begin[1:, None] - m + np.arange(m)).ravel()] = False
        out, x = np.empty(begin[-1], np.int32), np.empty(begin[-1], np.float32)
        out[own], x[own] = index, value
        out[~own], x[~own] = np.tile(np.arange(BUCKETS, WIDTH), n), z.ravel()
        return out, x, begin

    def raw(self, n: int, row: np.ndarray, index: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The machine's output, and the factor sums that its gradient needs."""
        y = self.w0 + np.bincount(row, weights=self.w[index] * x, minlength=n)
        sums = np.empty((n, self.v.shape[1]))
        for f in range(self.v.shape[1]):
            vx = self.v[index, f] * x
            sums[:, f] = np.bincount(row, weights=vx, minlength=n)
            y += 0.5 * (sums[:, f] ** 2 - np.bincount(row, weights=vx * vx, minlength=n))
        return y, sums

    def score(self, features: tuple) -> np.ndarray:
        n = len(features[3])
        y, _ = self.raw(n, *self.inputs(features))
        return 1 / (1 + np.exp(-np.clip(y, -40, 40)))

    def fit(self, features: tuple, labels: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 2e-5, batch: int = 128, seed: int = 7) -> FactorisationMachine:
        """Adagrad on the logistic loss, the two labels weighted alike."""
        rng = np.random.default_rng(seed)
        structure = features[3]
        self.mean, self.deviation = structure.mean(0), np.maximum(structure.std(0), 1e-6)
        index, x, begin = self.ordered(features)
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        gw, gv, g0 = np.full(WIDTH, 1e-3), np.full(self.v.shape, 1e-3), 1e-3
        for _ in range(epochs):
            shuffled = rng.permutation(len(labels))
            for at in range(0, len(labels), batch):
                rows = shuffled[at : at + batch]
                n = begin[rows + 1] - begin[rows]
                where = np.repeat(begin[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                i, v, r = index[where], x[where], np.repeat(np.arange(len(rows)), n)
                y, sums = self.raw(len(rows), r, i, v)
                error = weight[rows] * (1 / (1 + np.exp(-np.clip(y, -40, 40))) - labels[rows]) / len(rows)
                touched, place = np.unique(i, return_inverse=True)
                g = np.bincount(place, weights=error[r] * v) + decay * self.w[touched]
                gw[touched] += g * g
                self.w[touched] -= rate * g / np.sqrt(gw[touched])
                for f in range(self.v.shape[1]):
                    g = np.bincount(place, weights=error[r] * v * (sums[r, f] - self.v[i, f] * v)) + decay * self.v[touched, f]
                    gv[touched, f] += g * g
                    self.v[touched, f] -= 0.3 * rate * g / np.sqrt(gv[touched, f])
                g0 += error.sum() ** 2
                self.w0 -= rate * error.sum() / np.sqrt(g0)
        return self


def _inputs(docs: DataFrame) -> DataFrame:
    chars = docs["n_chars"].cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), chars.alias("n_chars"))


def training_rows(labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, quality): at most ``sample`` / 2 documents of each label, the first by hash of the id.

    Only rows whose crc32(doc_id) mod 3 is not 1 may teach.
    """
    may = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").filter(id_crc32() % 3 != 1)
    may = may.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    by_hash = [F.xxhash64("doc_id"), "doc_id"]
    return may.filter("quality = 0").orderBy(*by_hash).limit(sample // 2).unionByName(may.filter("quality = 1").orderBy(*by_hash).limit(sample // 2))


def within(rows: DataFrame, most: int) -> DataFrame:
    """Rows (doc_id, quality, n, ...) of each label, in the order of the sample, while n adds up to ``most`` at most."""
    order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.select("doc_id", "quality", "n").withColumn("total", F.sum("n").over(order)).filter(F.col("total") <= most)
    return rows.join(F.broadcast(kept.select("doc_id")), "doc_id", "left_semi")


def train(docs: DataFrame, labels: DataFrame, sample: int = 6_000, sample_features: int = 20_000_000) -> FactorisationMachine:
    """Fit the machine; the features of the sample are all that reaches the driver."""
    small_batches(docs.sparkSession)
    sampled = training_rows(labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                bounds, index, value, structure = featurise(batch.column("text"), batch.column("n_chars"))
                parts = [(index[a:b].astype("<u4").tobytes(), value[a:b].astype("<f4").tobytes(), s.tobytes()) for a, b, s in zip(bounds, bounds[1:], structure)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *(pa.array(c, pa.binary()) for c in zip(*parts))], names=["doc_id", "quality", "i", "x", "s"])

    found = _inputs(docs).join(F.broadcast(sampled), "doc_id").groupBy("doc_id", "quality").agg(F.min_by(F.struct("text", "n_chars"), F.struct(F.xxhash64("text"), "n_chars")).alias("d"))
    rows = materialize(found.select("doc_id", "quality", "d.text", "d.n_chars").mapInArrow(run, "doc_id long, quality int, i binary, x binary, s binary"), "sample").withColumn("n", F.octet_length("i") / 4)
    # Partition after partition, so neither side of the driver holds the sample more than once.
    got = [(r.doc_id, r.quality, bytes(r.i), bytes(r.x), bytes(r.s)) for r in within(rows, sample_features // 2).toLocalIterator()]
    got.sort()
    machine = FactorisationMachine()
    y = np.array([quality for _, quality, *_ in got])
    if len(set(y.tolist())) < 2:
        machine.v[:] = 0
        machine.w0 = 0.0 if not len(y) else 4.0 * (2 * int(y[0]) - 1)
        return machine
    bounds = np.concatenate([[0], np.cumsum([len(i) // 4 for _, _, i, _, _ in got])])
    index, value = (np.frombuffer(b"".join(r[c] for r in got), t) for c, t in ((2, "<u4"), (3, "<f4")))
    structure = np.frombuffer(b"".join(r[4] for r in got)).reshape(len(got), -1)
    del got
    return machine.fit((bounds, index, value, structure), y)


def score_documents(docs: DataFrame, machine: FactorisationMachine) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                score = model.value.score(featurise(batch.column("text"), batch.column("n_chars")))
                held = [zlib.crc32(b"" if k is None else str(k).encode()) % 3 == 1 for k in batch.column("doc_id").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return _inputs(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, machine: FactorisationMachine) -> DataFrame:
    """The rows of ``docs`` that the machine predicts to be good, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    has_chars = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                chars = batch.column("n_chars") if has_chars else pa.nulls(batch.num_rows, pa.int64())
                score = model.value.score(featurise(batch.column("text"), chars))
                yield batch.filter(pa.array(score >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_documents(docs, train(docs, documents(spark, sf_dir, "labels")))
