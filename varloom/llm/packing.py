"""Packing: documents to token sequences by hierarchical multi-length packing.

Every document is tokenised and routed to the smallest context size (tier) that holds it;
what exceeds the largest tier is cut into full windows and a remainder. Tiers are packed from
long to short: a window opens with the tier's longest piece, its gap takes the largest
shorter pieces that fit, and when none fits, one is cut to fill the rest exactly. Windows of
a tier are dealt to step groups of equal token counts.

Each input partition is packed on its own, in rounds of bounded size whose leftovers go to
the next round, so nothing is shuffled and a task holds one round only. The last leftovers of
a partition become windows at powers of two, so no window needs padding.

Nulls and odd rows: a null or empty text is the end id alone; a null doc_id is carried as
null; repeated rows are packed once each; an empty table gives no rows; other columns are
ignored; a text of any length is cut, never shortened.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, slices, small_batches
from .subwords import encoder, vocabulary_path

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
TIERS = (256, 512, 1024, 2048)


class Packer:
    """Packs the pieces of one partition; ``emit`` gets (piece, offset) lists window by window."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = 65_536):
        self.tiers, self.longest, self.step_tokens = tuple(sorted(tiers)), max(tiers), step_tokens
        self.pools: dict[int, list] = {}  # length -> pieces (document row, start)
        self.mask = 0  # bit n is set if a piece of length n waits
        self.waiting = 0
        self.sequences = 0
        self.windows = dict.fromkeys(self.tiers, 0)
        self.out: list[tuple] = []

    def _put(self, length: int, piece: tuple) -> None:
        self.pools.setdefault(length, []).append(piece)
        self.mask |= 1 << length
        self.waiting += length

    def _take(self, at_most: int) -> tuple[int, tuple] | None:
        found = (self.mask & ((1 << (at_most + 1)) - 1)).bit_length() - 1
        if found < 1:
            return None
        pool = self.pools[found]
        piece = pool.pop()
        if not pool:
            self.mask &= ~(1 << found)
        self.waiting -= found
        return found, piece

    def _smallest(self) -> tuple[int, tuple]:
        least = (self.mask & -self.mask).bit_length() - 1
        return self._take(least)

    def add(self, row, tokens: int) -> None:
        start = 0
        while tokens - start >= self.longest:
            self._window(self.longest, [(row, start, self.longest, 0)])
            start += self.longest
        if tokens > start:
            self._put(tokens - start, (row, start))

    def _window(self, size: int, pieces: list[tuple]) -> None:
        tier = next((t for t in self.tiers if t >= size), self.longest)
        per_group = max(1, self.step_tokens // tier)
        group = self.windows[tier] // per_group * len(self.tiers) + self.tiers.index(tier)
        self.windows[tier] += 1
        for row, start, length, offset in pieces:
            self.out.append((row, start, length, self.sequences, offset, size, group))
        self.sequences += 1

    def _fill(self, size: int) -> None:
        """One full window of ``size`` from the waiting pieces, of which there are enough."""
        pieces, offset = [], 0
        while offset < size:
            gap = size - offset
            got = self._take(gap)
            if got is None:  # none fits: cut the shortest one
                length, (row, start) = self._smallest()
                pieces.append((row, start, gap, offset))
                self._put(length - gap, (row, start + gap))
                break
            length, (row, start) = got
            pieces.append((row, start, length, offset))
            offset += length
        self._window(size, pieces)

    def pack(self, final: bool) -> None:
        """Tiers from long to short; a tier's turn lasts while it has pieces of its own."""
        for tier, below in zip(reversed(self.tiers), [*reversed(self.tiers[:-1]), 0]):
            while self.waiting >= tier and self.mask >> (below + 1):
                self._fill(tier)
        while self.waiting >= self.tiers[0]:
            self._fill(self.tiers[0])
        while final and self.waiting:
            self._fill(1 << (self.waiting.bit_length() - 1))


def packer(path: str, end_id: int, tiers: tuple[int, ...], step_tokens: int, round_bytes: int, cache_units: int):
    """Function for ``mapInArrow`` over (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, packs = encoder(path, True, end_id, cache_units), Packer(tiers, step_tokens)
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held: dict[int, tuple] = {}  # documents of which pieces still wait
        serial = 0

        def flush(final: bool):
            packs.pack(final)
            if not packs.out:
                return None
            crc = [zlib.crc32(held[r][1][s : s + n].tobytes()) for r, s, n, *_ in packs.out]
            row, start, length, seq, offset, size, group = zip(*packs.out)
            packs.out = []
            waiting = {piece[0] for pool in packs.pools.values() for piece in pool}
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([held[r][0] for r in row], pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()), pa.array([len(held[r][1]) for r in row], pa.int64()),
                    pa.array(np.array(seq, np.int64) + base), pa.array(offset, pa.int64()), pa.array(size, pa.int32()),
                    pa.array(np.array(group, np.int64) + base),
                ],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )
            for r in set(held) - waiting:
                del held[r]
            return batch

        for whole in batches:
            for batch in slices(whole, "text", round_bytes):
                ids, bounds = coder.encode(batch.column("text"))
                keys = batch.column("doc_id").to_pylist()
                for k, a, b in zip(keys, bounds[:-1].tolist(), bounds[1:].tolist()):
                    held[serial] = (k, ids[a:b].astype("<u4"))
                    packs.add(serial, b - a)
                    serial += 1
                if (out := flush(False)) is not None:
                    yield out
        if (out := flush(True)) is not None:
            yield out

    return run


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = 65_536, round_bytes: int = 4 << 20, cache_units: int = 500_000) -> DataFrame:
    """One row per piece. ``tiers`` are powers of two, the largest is the sequence length.

    ``tier`` is the window's token count; windows of a ``step_group`` share a tier and hold
    ``step_tokens`` tokens (the last group of a partition may hold fewer). ``cache_units`` bounds
    a worker's memory for units that it has tokenised.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(packer(path, end_id, tiers, step_tokens, round_bytes, cache_units), SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"))
