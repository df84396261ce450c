"""Token-id output: shards of raw ids with a minimal perfect hash index over document keys.

A shard is one record of a Parquet table: a stretch of documents in ascending doc_id order,
their ids as little-endian unsigned integers (16 bits where the vocabulary allows), and an
index that maps a key to its place in constant time. The index is hash-and-displace: keys
fall into small buckets, each bucket stores the displacement that sends its keys to free
slots of a table exactly as large as the key set. A slot stores a fingerprint, which tells
keys of the shard from others, and the offset and length of the key's ids. ``first_key`` and
``last_key`` of a shard are columns with statistics, so ``lookup`` reads only shards that may
hold a key, and ``directory`` is the table from keys to shards without any payload.

Documents are range-partitioned by doc_id and text hash (one shuffle of the texts), tokenised
and written shard by shard; a reader needs the shard totals only to know where a shard's ids
start, which are added up in two levels. A key's documents may lie in several shards, so no
doc_id, however often it repeats, makes a shard or a task larger than others.

Nulls and odd rows: a null or empty text is the end id alone; a null doc_id sorts first and
is kept under a key of its own; rows that repeat a doc_id lie side by side, in the order of
their text's hash, and share one entry a shard that counts them; an empty table gives no
shards; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, planned_bytes, slices, small_batches
from .subwords import encoder, vocabulary_path

SHARD = "part long, seq long, first_key long, last_key long, n_rows long, n_ids long, width int, payload binary, row_lengths binary, row_keys binary, displacements binary, fingerprints binary, entries binary"
#: Stands for a null doc_id among the keys.
NULL_KEY = -(1 << 63)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(keys: np.ndarray, seed) -> np.ndarray:
    """64-bit hash of integer keys, one for each seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + (np.asarray(seed, np.uint64) + np.uint64(1)) * _M1
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M1
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct integer keys by hash-and-displace.

    ``displacements``: for each bucket the seed under which its keys take free slots.
    ``fingerprints``: 32 bits of each slot's key.
    """

    KEYS_A_BUCKET = 4

    def __init__(self, displacements: np.ndarray, fingerprints: np.ndarray):
        self.displacements, self.fingerprints = displacements, fingerprints

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The index and each key's slot."""
        n = len(keys)
        buckets = max(1, -(-n // cls.KEYS_A_BUCKET))
        home = (mix(keys, 0) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        sizes = np.bincount(home, minlength=buckets)
        begin = np.cumsum(sizes) - sizes
        displacements, slots, taken = np.zeros(buckets, np.uint32), np.zeros(n, np.int64), np.zeros(n, bool)
        trial = np.arange(1, 65, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable").tolist():
            if not sizes[b]:
                break
            members = order[begin[b] : begin[b] + sizes[b]]
            first = 0
            while True:  # 64 displacements at a time
                at = (mix(keys[members][None, :], (trial + np.uint64(first))[:, None]) % np.uint64(n)).astype(np.int64)
                fits = ~taken[at].any(axis=1)
                if len(members) > 1:
                    s = np.sort(at, axis=1)
                    fits &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if fits.any():
                    k = int(np.argmax(fits))
                    break
                first += 64
            displacements[b] = first + k + 1
            slots[members] = at[k]
            taken[at[k]] = True
        fingerprints = np.zeros(n, np.uint32)
        fingerprints[slots] = cls.fingerprint(keys)
        return cls(displacements, fingerprints), slots

    @staticmethod
    def fingerprint(keys: np.ndarray) -> np.ndarray:
        return (mix(keys, (1 << 63) - 1) >> np.uint64(32)).astype(np.uint32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where the fingerprint says that the key is not stored."""
        if not len(self.fingerprints):
            return np.full(len(keys), -1)
        home = (mix(keys, 0) % np.uint64(len(self.displacements))).astype(np.int64)
        at = (mix(keys, self.displacements[home].astype(np.uint64)) % np.uint64(len(self.fingerprints))).astype(np.int64)
        return np.where(self.fingerprints[at] == self.fingerprint(keys), at, -1)


def build_shard(keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray, width: int) -> tuple:
    """One shard of rows sorted by key: (first and last key, rows, ids, width, payload and index parts)."""
    distinct, first, counts = np.unique(keys, return_index=True, return_counts=True)
    index, slots = PerfectHash.build(distinct)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    entries = np.zeros((len(distinct), 3), "<i8")  # row of the key's first document, rows, offset of its ids
    entries[slots] = np.stack([first, counts, ends[first]], axis=1)
    return (int(keys[0]), int(keys[-1]), len(keys), int(ends[-1]), width, ids.astype(f"<u{width}").tobytes(), lengths.astype("<i8").tobytes(), keys.astype("<i8").tobytes(), index.displacements.astype("<u4").tobytes(), index.fingerprints.astype("<u4").tobytes(), entries.tobytes())


class Shard:
    """Reader of one shard record."""

    def __init__(self, record: dict):
        self.ids = np.frombuffer(record["payload"], f"<u{record['width']}")
        self.lengths = np.frombuffer(record["row_lengths"], "<i8")
        self.keys = np.frombuffer(record["row_keys"], "<i8")
        self.index = PerfectHash(np.frombuffer(record["displacements"], "<u4"), np.frombuffer(record["fingerprints"], "<u4"))
        self.entries = np.frombuffer(record["entries"], "<i8").reshape(-1, 3)

    def locate(self, keys: np.ndarray) -> np.ndarray:
        """For each key: first row, rows, offset; -1 throughout for keys that the shard lacks."""
        at = self.index.slot(keys)
        found = self.entries[at] if len(self.entries) else np.zeros((len(keys), 3), np.int64)
        return np.where((at >= 0)[:, None], found, -1)

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of every document of ``key``."""
        row, n, at = self.locate(np.array([NULL_KEY if key is None else key]))[0]
        if row < 0 or self.keys[row] != (NULL_KEY if key is None else key):
            return []
        out = []
        for length in self.lengths[row : row + n].tolist():
            out.append(self.ids[at : at + length])
            at += length
        return out


def shard_writer(path: str, end_id: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = encoder(path, False, end_id)
        width = 2 if max(coder.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        named = [x.split() for x in SHARD.split(", ")]
        part = TaskContext.get().partitionId()  # ranges are numbered in order
        seq, held = 0, 0
        keys, lengths, ids = [], [], []

        def close():
            record = (part, seq, *build_shard(np.concatenate(keys), np.concatenate(lengths), np.concatenate(ids), width))
            for parts in (keys, lengths, ids):
                parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], kinds[t]) for v, (_, t) in zip(record, named)], names=[n for n, _ in named])

        for whole in batches:
            for batch in slices(whole, "text", 6 << 20):
                got, bounds = coder.encode(batch.column("text"))
                keys.append(batch.column("doc_id").fill_null(NULL_KEY).to_numpy(zero_copy_only=False))
                lengths.append(np.diff(bounds))
                ids.append(got)
                held += got.nbytes // 4 * width
                if held >= shard_bytes:
                    yield close()
                    seq, held = seq + 1, 0
        if keys:
            yield close()

    return run


def write_shards(docs: DataFrame, path: str, end_id: int = 2, partition_bytes: int = 8 << 20, shard_bytes: int = 4 << 20, out: str | None = None) -> DataFrame:
    """Write the id files of ``docs`` to ``out`` (else the shared folder); returns the table of shards.

    The number of range partitions follows the input's planned (stored) size, so a task's share
    stays the same at any size; a task holds one shard at a time, whatever its share.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    n = max(1, -(-planned_bytes(rows) // partition_bytes))
    order = ["doc_id", "h", "p"]
    # Equal rows differ by the partition that they come from.
    ordered = rows.select("*", F.xxhash64("text").alias("h"), F.spark_partition_id().alias("p")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    shards = ordered.select("doc_id", "text").mapInArrow(shard_writer(path, end_id, shard_bytes), SHARD)
    if out is None:
        return materialize(shards, "shards")
    shards.write.parquet(out)
    return read_shards(docs.sparkSession, out)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(path)


def directory(shards: DataFrame) -> DataFrame:
    """Which keys each shard spans: no payload is read."""
    return shards.select("part", "seq", "first_key", "last_key", "n_rows", "n_ids")


def lookup(shards: DataFrame, keys: list[int | None]) -> dict[int | None, list[np.ndarray]]:
    """The ids of every document of some keys, from the shards that may hold them.

    For keyed access to a few documents; for many, join on ``read_back``.
    """
    found: dict[int | None, list[np.ndarray]] = {k: [] for k in keys}
    wanted = [NULL_KEY if k is None else k for k in found]
    may = None
    for k in wanted:
        here = (F.col("first_key") <= k) & (F.col("last_key") >= k)
        may = here if may is None else may | here
    if may is None:
        return found
    for record in shards.filter(may).orderBy("part", "seq").toLocalIterator():
        shard = Shard(record.asDict())
        for k in found:
            found[k] += shard.get(k)
    return found


def read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every document of every shard, looked up by its key."""
    for batch in batches:
        for record in batch.to_pylist():
            shard = Shard(record)
            distinct = np.unique(shard.keys)
            at = shard.locate(distinct)
            if (at[:, 0] < 0).any():
                raise ValueError("an index lacks keys of its shard")
            out: tuple[list, ...] = ([], [], [], [])
            for key, (row, n, offset) in zip(distinct.tolist(), at.tolist()):
                for length in shard.lengths[row : row + n].tolist():
                    for column, value in zip(out, (None if key == NULL_KEY else key, offset, length, zlib.crc32(shard.ids[offset : offset + length].astype("<u4").tobytes()))):
                        column.append(value)
                    offset += length
            place = [pa.array([record[c]] * len(out[0]), pa.int64()) for c in ("part", "seq")]
            yield pa.RecordBatch.from_arrays([*place, *(pa.array(c, pa.int64()) for c in out)], names=["part", "seq", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def shard_starts(shards: DataFrame, together: int = 1024) -> DataFrame:
    """part, seq, shard_start: ids of all shards before each one, by totals of so many parts at a time."""
    sizes = shards.select("part", "seq", "n_ids", F.expr(f"part div {together}").alias("piece"))
    totals = sizes.groupBy("piece").agg(F.sum("n_ids").alias("sum"))
    earlier = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("piece", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("piece").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(totals, "piece").select("part", "seq", (F.col("before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("shard_start"))


def read_back(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 from the files."""
    rows = shards.mapInArrow(read_documents, "part long, seq long, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(shard_starts(shards), ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(write_shards(documents(spark, sf_dir), vocabulary_path("word_bpe_49k.json")))
