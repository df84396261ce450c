"""Near-duplicate detection with HyperMinHash sketches.

A document's set holds its distinct five-word shingles. Its sketch has ``TABLES`` tables of
four buckets: a table's hash deals the shingles to the buckets, and of each bucket's smallest
hash the sketch keeps the count of leading zeros and ten bits of mantissa. The four
compressed registers of a table form a band (one 64-bit number); documents that share a
band are candidates. Two documents at similarity 0.75 share none of the 40 bands with a
probability of 3e-7.

Candidates are not expanded into all pairs. Documents with equal sets are one representative
from the start. Then, twice, every member of a band's group meets one hub of its groups (the
member with the most company over all bands, then one by hash); pairs pass a comparison of
set sizes (exact) and of collision-corrected sketch estimates (four standard deviations wide),
and are confirmed on full sets. Groups whose members are by then in one component are
finished. The members of the others are banded anew, in 120 bands of eight registers,
whose groups hold only documents that are much more alike (at similarity 0.75 two share none
with a probability of 3e-6), and meet hubs of these groups. What is then still apart is compared
inside its fine groups: members outside a group's largest component with all its members, in
chunks of both, so a group of m members with s outside costs m + s rows as long as either fits
a chunk, and 2 m s / ``CHUNK`` beyond. So no link between components is left out, while a group of
near copies costs a multiple of its size.

Components come from label propagation with pointer jumping over confirmed links; later links
are contracted to the components that they join first, so only those are worked on again.
Nothing but counts reaches the driver. All tables that are used again lie in the shared folder.

Nulls and odd rows: a null or empty text, or one without words, has the empty set and links
with nothing; fewer than five words are one shingle; a null doc_id links with nothing, has a
null component and is kept; rows that repeat a doc_id are one document and give a row each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, slices, small_batches, trim

WIDTH = 5
TABLES, BUCKETS, MANTISSA = 40, 4, 10
#: Pairs whose estimate is this far below the threshold are dropped: four standard deviations.
MARGIN = 0.14
#: Below so many shingles an estimate says little; such pairs are all confirmed on sets.
FEW = 12
#: Hashes of the second banding, buckets of each and registers of a band: 120 bands in all.
FINE_TABLES, FINE_BUCKETS, FINE_BAND = 15, 64, 8
#: Members of either side that a task compares at a time, and shingles that it confirms at a time.
CHUNK, CHUNK_SHINGLES = 256, 10_000
#: Bytes of a group after which a worker gives freed memory back.
BIG = 1 << 20
EMPTY = np.uint16(0xFFFF)
#: Set apart the bands of different tables, so that a band says which table it is of.
_NAME = np.random.default_rng(20240608).integers(-(1 << 63), 1 << 63, TABLES, np.int64)
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_TABLE, _FINE_TABLE = ((np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) << np.uint64(1)) | np.uint64(1) for seed, n in ((20240607, TABLES), (20240609, FINE_TABLES)))


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(WIDTH, len(words))
    with np.errstate(over="ignore"):
        x = np.full(len(words) - width + 1, np.uint64(width))
        for k in range(width):
            x = (x ^ (x >> np.uint64(31))) * _P + h[k : len(words) - width + 1 + k] * _Q
        x ^= x >> np.uint64(32)
        x *= _P
        x ^= x >> np.uint64(29)
    return np.unique(x)


def _register(best: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of smallest hashes."""
    bits = best.astype(np.float64).view(np.uint64)
    zeros = np.uint64(1023 + 63) - (bits >> np.uint64(52))
    register = (zeros << np.uint64(MANTISSA)) | ((bits >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1))
    return np.where(best == _MAX, np.uint64(EMPTY), register).astype(np.uint16)


def registers(x: np.ndarray) -> np.ndarray:
    """Bands of a set: for each table one integer of four 16-bit registers."""
    best = np.full((BUCKETS, TABLES), _MAX)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 8192):
            h = x[at : at + 8192, None] * _TABLE
            h ^= h >> np.uint64(32)
            h *= _Q
            bucket, value = h >> np.uint64(62), h << np.uint64(2)
            for k in range(BUCKETS):
                np.minimum(best[k], np.where(bucket == k, value, _MAX).min(0), out=best[k])
    return _register(best).T.copy().view(np.int64)[:, 0] ^ _NAME


_EDGES = np.arange(FINE_BUCKETS, dtype=np.uint64) << np.uint64(58)


def fine_bands(x: np.ndarray) -> np.ndarray:
    """Bands of the second banding, in order: hashes of eight neighbouring registers and their number.

    One hash fills 64 buckets; a band without any shingle says nothing and is 0.
    """
    best = np.full((FINE_TABLES, FINE_BUCKETS), _MAX)
    with np.errstate(over="ignore"):
        for t in range(FINE_TABLES):
            h = x * _FINE_TABLE[t]
            h ^= h >> np.uint64(32)
            h = np.sort(h * _Q)
            first = np.searchsorted(h, _EDGES)
            there = first < len(h)
            there[there] = h[first[there]] >> np.uint64(58) == np.flatnonzero(there).astype(np.uint64)
            best[t, there] = h[first[there]] << np.uint64(6)
        two = _register(best).reshape(-1, FINE_BAND).copy().view(np.uint64)
        some = (two != _MAX).any(1)
        h = (two[:, 0] * _P ^ two[:, 1] >> np.uint64(7)) * _Q + two[:, 1] * _P + np.arange(len(two), dtype=np.uint64)
        h = (h ^ h >> np.uint64(29)) * _P
        return np.where(some, h ^ h >> np.uint64(32), np.uint64(0)).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity of pairs from their registers (pairs x registers) and set sizes.

    Registers also agree by chance, when different smallest hashes share leading zeros and
    mantissa; the share to expect for these set sizes is taken out.
    """
    void = (a == EMPTY) & (b == EMPTY)
    used = np.maximum(1, (~void).sum(1))
    agree = ((a == b) & ~void).sum(1) / used
    level = 2.0 ** -np.arange(0, 64)
    p, q = (np.exp(-(s[:, None] / BUCKETS) * level / 2) - np.exp(-(s[:, None] / BUCKETS) * level) for s in (n.astype(float), m.astype(float)))
    chance = (p * q).sum(1) / (1 << MANTISSA)
    return (agree - chance) / (1 - chance)


_SKETCH = "doc_id long, h long, n_shingles long, content binary, bands array<bigint>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 2 << 20):
            size, content, bands = [], [], []
            for text in batch.column("text"):
                x = shingles(text.as_py())
                size.append(len(x))
                content.append(xxhash.xxh128_digest(x.tobytes()) if len(x) else None)
                bands.append(registers(x) if len(x) else np.zeros(0, np.int64))
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(size, pa.int64()), pa.array(content, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "h", "n_shingles", "content", "bands"])


def _likely(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = ((batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, TABLES) ^ _NAME).view(np.uint16) for c in ("bands_a", "bands_b"))
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            keep = (np.minimum(n, m) < FEW) | (estimate(a, b, n, m) >= threshold / 100 - MARGIN)
            yield batch.select(["a", "b", "n_a"]).filter(pa.array(keep))

    return run


def _both(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= threshold * (len(x) + len(y) - both) > 0


def _linked(threshold: int):
    """Links among pairs of one hub: its text comes once, those of its pairs once each."""

    def run(left, right):
        a, b = [], []
        if left.num_rows and right.num_rows:
            hub, y = right.column("hub_of")[0].as_py(), shingles(right.column("hub_text")[0].as_py())
            for rep, text in zip(left.column("rep").to_pylist(), left.column("text")):
                if _both(shingles(text.as_py()), y, threshold):
                    a.append(min(rep, hub))
                    b.append(max(rep, hub))
        if left.nbytes > BIG:
            trim()
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _least_agreeing(threshold: int) -> int:
    return math.ceil(TABLES * BUCKETS * (threshold / 100 - MARGIN))


_PART = "key long, l long, r long, rep long, partners array<bigint>"


def _partners(threshold: int):
    """Of two chunks of one group: each member on the right with its likely partners on the left.

    A pair belongs to the group of its first common band.
    """

    def run(key, table):
        side, rep, n, component, main = (table.column(c).to_numpy() for c in ("side", "rep", "n", "component", "main"))
        bands, fine = (table.column(c).combine_chunks().flatten().to_numpy().reshape(len(rep), -1) for c in ("bands", "fine"))
        lanes = (bands ^ _NAME).view(np.uint16).reshape(len(rep), -1)
        k, l, r = (x.as_py() for x in key)
        home = fine == np.int32(k >> 32)
        left = np.flatnonzero(side == 0)
        found: dict[int, list[int]] = {}
        for i in np.flatnonzero(side == 1).tolist():
            # Pairs of two members outside the largest component would be met from both sides.
            j = left[(component[left] != component[i]) & ((component[left] == main[left]) | (rep[left] < rep[i]))]
            j = j[np.minimum(n[j], n[i]) * 100 >= np.maximum(n[j], n[i]) * threshold]
            agree = (lanes[j] == lanes[i]).sum(1)
            j = j[(np.minimum(n[j], n[i]) < FEW) | (agree >= _least_agreeing(threshold))]
            if len(j):
                common = (fine[j] == fine[i]) & (fine[i] != 0)
                j = j[home[i][common.argmax(1)]]
            if len(j):
                found.setdefault(int(rep[i]), []).extend(rep[j].tolist())
        wanted = {x for named in found.values() for x in named}
        rows = [(x, found.get(x, [])) for x in sorted({*found, *wanted})]
        if table.nbytes > BIG:
            trim()
        return pa.table([*(pa.array([v] * len(rows), pa.int64()) for v in (k, l, r)), pa.array([x for x, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.list_(pa.int64()))], names=["key", "l", "r", "rep", "partners"])

    return run


def _confirmed(threshold: int):
    """Links among the named partners of a group's two chunks, on full sets."""

    def run(table):
        sets: dict[int, np.ndarray] = {}
        partners: dict[int, list[int]] = {}
        for rep, named, text in zip(table.column("rep").to_pylist(), table.column("partners").to_pylist(), table.column("text")):
            sets[rep] = shingles(text.as_py())
            partners[rep] = named
        links = [(min(rep, other), max(rep, other)) for rep, named in partners.items() for other in named if _both(sets[rep], sets[other], threshold)]
        if table.nbytes > BIG:
            trim()
        return pa.table([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    return run


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 2 << 20):
            bands = [fine_bands(shingles(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(bands, pa.list_(pa.int64()))], names=["rep", "fine"])


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest id that links reach from each linked node."""
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    total = lambda df: df.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]  # noqa: E731  labels only fall
    before = total(labels)
    while True:  # labels fall in every round but the last
        offered = edges.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "component")
        lowered = materialize(offered.unionByName(labels).groupBy("node").agg(F.min("component").alias("component")), "lowered")
        further = lowered.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = materialize(lowered.join(further, "component").select("node", F.col("next").alias("component")), "labels")
        now = total(labels)
        if now == before:
            return labels
        before = now


class _Finder:
    """Works through the groups of one corpus."""

    def __init__(self, reps: DataFrame, texts: DataFrame, groups: DataFrame, threshold: int):
        self.reps, self.texts, self.groups, self.threshold = reps, texts, groups, threshold
        self.labels: DataFrame | None = None

    def confirm(self, pairs: DataFrame) -> None:
        """Add the links among ``pairs`` (rep, hub, n, n_hub) and renew the components."""
        near = pairs.filter(F.least("n", "n_hub") * 100 >= F.greatest("n", "n_hub") * self.threshold).select(F.col("rep").alias("a"), F.col("hub").alias("b"))
        bands = lambda s: self.reps.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("bands").alias(f"bands_{s}"))
        likely = near.join(bands("a"), "a").join(bands("b"), "b").mapInArrow(_likely(self.threshold), "a long, b long, n_a long")
        self.link(likely.select(F.col("a").alias("rep"), F.col("b").alias("hub"), F.col("n_a").alias("n")))

    def link(self, pairs: DataFrame) -> None:
        """Add the links among likely pairs (rep, hub, n of rep), confirmed on full sets."""
        likely = materialize(pairs, "likely")
        # A hub's text goes to as many tasks as its pairs' shingles need.
        parts = likely.groupBy("hub").agg(F.ceil(F.sum("n") / CHUNK_SHINGLES).alias("parts"))
        dealt = materialize(likely.join(parts, "hub").select("rep", "hub", F.pmod(F.xxhash64("rep"), "parts").alias("part")), "dealt")
        left = dealt.join(self.texts, "rep").select("hub", "part", "rep", "text")
        hubs = dealt.select(F.col("hub").alias("hub_of"), F.col("part").alias("part_of")).distinct()
        right = hubs.join(self.texts.select(F.col("rep").alias("hub_of"), F.col("text").alias("hub_text")), "hub_of")
        self.add(left.groupBy("hub", "part").cogroup(right.groupBy("hub_of", "part_of")).applyInArrow(_linked(self.threshold), "a long, b long"))

    def add(self, found: DataFrame) -> None:
        """Join the components that the links of ``found`` connect."""
        found = materialize(found.distinct(), "links")
        if self.labels is None:
            self.labels = components(found)
            return
        at = lambda c: self.labels.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
        joined = found.join(at("a"), "a", "left").join(at("b"), "b", "left").select("a", "b", F.coalesce("c_a", "a").alias("c"), F.coalesce("c_b", "b").alias("d"))
        joined = materialize(joined, "contracted")
        apart = joined.filter("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct()
        moved = components(apart).select(F.col("component").alias("next"), F.col("node").alias("component"))
        ends = joined.select(F.col("a").alias("node"), F.col("c").alias("component")).unionByName(joined.select(F.col("b").alias("node"), F.col("d").alias("component")))
        every = self.labels.unionByName(ends).distinct()
        self.labels = materialize(every.join(moved, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "labels")

    def rows(self) -> DataFrame:
        """Group rows with the component that each member is in by now."""
        if self.labels is None:
            return self.groups.withColumn("component", F.col("rep"))
        named = self.labels.select(F.col("node").alias("rep"), "component")
        return self.groups.join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    def unfinished(self, rows: DataFrame, extra: list | None = None) -> DataFrame:
        """Groups with members in more than one component."""
        return rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), *(extra or [])).filter("low < high").drop("low", "high")

    def star(self, preference: Column) -> None:
        """Every member of an unfinished group against one hub: the most preferred of its groups.

        One pair a member and round, however many groups it shares with its hub.
        """
        rows = materialize(self.rows().withColumn("preference", preference), "rows")
        hub = F.max(F.struct("preference", (-F.col("rep")).alias("order"), "n", "component")).alias("h")
        hubs = materialize(self.unfinished(rows, [hub]), "hubs")
        met = rows.join(hubs, "key").filter((F.col("rep") != -F.col("h.order")) & (F.col("component") != F.col("h.component")))
        top = met.groupBy("rep").agg(F.max("h").alias("h"), F.first("n").alias("n"))
        self.confirm(top.select("rep", (-F.col("h.order")).alias("hub"), "n", F.col("h.n").alias("n_hub")))

    def band_finely(self) -> None:
        """From now on the groups are those of the second banding, of members that are still apart."""
        rows = materialize(self.rows(), "rows")
        left = rows.join(self.unfinished(rows), "key", "left_semi").groupBy("rep").agg(F.first("n").alias("n"), F.first("weight").alias("weight"))
        left = materialize(left, "left")
        fine = left.join(self.texts, "rep").select("rep", "text").mapInArrow(_fine, "rep long, fine array<bigint>")
        self.fine = materialize(fine, "fine", codec="none")
        members = materialize(self.fine.join(left, "rep").select("rep", "n", "weight", F.explode("fine").alias("key")).filter("key <> 0"), "members")
        shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
        self.groups = materialize(members.join(shared, "key"), "groups")

    def rest(self) -> None:
        """Members that are still outside their group's largest component, against the group.

        Either side is cut into chunks by hash; a task compares two chunks and names each
        member's partners by their registers, and only links confirmed on full sets leave the next.
        """
        rows = materialize(self.rows(), "rows")
        sizes = rows.join(self.unfinished(rows), "key", "left_semi").groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
        open_ = sizes.groupBy("key").agg(F.sum("size").alias("members"), F.max("size").alias("most"), F.max_by("component", F.struct("size", "component")).alias("main"))
        open_ = materialize(open_.select("key", "main", F.ceil(F.col("members") / CHUNK).alias("ls"), F.ceil((F.col("members") - F.col("most")) / CHUNK).alias("rs")), "open")
        sketch = self.reps.select("rep", "bands").join(self.fine.select("rep", F.expr("transform(fine, x -> cast(shiftright(x, 32) as int))").alias("fine")), "rep")
        left = rows.join(open_, "key").join(sketch, "rep").select("key", "rep", "n", "component", "bands", "fine", "main", "ls", "rs")
        left = materialize(left, "left", codec="none")
        own = lambda count, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), count)
        one = left.withColumn("side", F.lit(0)).withColumn("l", own(F.col("ls"), 1)).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rs") - 1)))
        two = left.filter("component <> main").withColumn("side", F.lit(1)).withColumn("r", own(F.col("rs"), 2)).withColumn("l", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ls") - 1)))
        columns = ["key", "l", "r", "side", "rep", "n", "component", "main", "bands", "fine"]
        named = one.select(columns).unionByName(two.select(columns)).groupBy("key", "l", "r").applyInArrow(_partners(self.threshold), _PART)
        whole = materialize(named, "partners").join(self.texts, "rep")
        self.add(whole.groupBy("key", "l", "r").applyInArrow(_confirmed(self.threshold), "a long, b long"))


def near_duplicates(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; ``threshold`` in percent.

    Equal sets are one class; links, hubs and components are of classes (``rep``).
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    sketches = materialize(rows.mapInArrow(_sketch, _SKETCH), "sketches", codec="none")
    known = sketches.filter("content is not null and doc_id is not null")
    classes = known.groupBy("content").agg(F.min(F.struct("doc_id", "h")).alias("low"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes.select("content", "low.doc_id", "low.h", "n", "bands", F.monotonically_increasing_id().alias("rep")), "classes", codec="none")
    named = sketches.select("doc_id", "n_shingles", "content").join(classes.select("content", "rep"), "content", "left").drop("content")
    named = materialize(named, "named")

    reps = classes.select("rep", "n", "bands")
    members = reps.select("rep", "n", F.explode("bands").alias("key"))
    shared = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "shared")
    grouped = materialize(members.join(shared, "key"), "grouped")
    weights = materialize(grouped.groupBy("rep").agg(F.sum("size").alias("weight")), "weights")
    groups = materialize(grouped.join(weights, "rep").select("key", "rep", "n", "weight"), "groups")
    wanted = classes.join(weights, "rep", "left_semi").select("rep", "doc_id", "h")
    # Of rows that repeat both id and text one will do; they lie together after the join.
    texts = materialize(rows.join(wanted, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("rep", "text"), "texts")

    finder = _Finder(reps, texts, groups, threshold)
    # Rows of one doc_id are one document, whatever their texts.
    several = named.filter("doc_id is not null and rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").drop("b")
    finder.add(named.join(several, "doc_id").filter("rep > a").select("a", F.col("rep").alias("b")))
    finder.star(F.col("weight"))
    finder.star(F.xxhash64("rep"))
    finder.band_finely()
    finder.star(F.col("weight"))
    finder.rest()

    labels = finder.labels.select(F.col("node").alias("rep"), "component")
    of_class = materialize(classes.select("rep", "doc_id").join(labels, "rep", "left").select("rep", "doc_id", F.coalesce("component", "rep").alias("component")), "of_class")
    lowest = of_class.groupBy("component").agg(F.min("doc_id").alias("least"))
    final = of_class.join(lowest, "component").select("rep", "least")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return named.join(final, "rep", "left").select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id))::BIGINT AS component_id, w.doc_id <= coalesce(m.b, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id
"""
