"""Language-model scoring with a weighted backoff automaton.

Every n-gram seen in the training documents is a state; an arc leads from a state along a
word to the state of the longest seen suffix, and a failure arc leads to the next shorter
suffix. Weights come from Dirichlet smoothing, order by order:

    P_1(w)   = (c(w) + 0.1) / (N + 0.1 (V + 1))
    P_k(w|h) = (c(hw) + K P_{k-1}(w|h')) / (c(h) + K)

so an arc carries log10 P_k, a failure arc log10(K / (c(h) + K)), and the probabilities of all
words and one unknown word sum to 1. A text is scored in one traversal from left to right
that carries the state.

The model is as large as the corpus, so it is never broadcast. Documents form blocks of a
fixed size. A block sends each of its distinct words and word pairs once, in runs cut at fixed
ranges of their hashes, with their counts; a range adds the counts of all blocks and answers each
block with the totals of just what it asked for, and whether the n-gram occurs elsewhere. Of
the longer n-grams a block then sends only those whose context occurs more than once in the
corpus, level by level: any other n-gram occurs once at most, which its block knows by itself.
Both exchanges hold one entry for each distinct n-gram of a block, whatever a word's frequency,
so frequent words make no hot key.

Ranges and blocks form a tree of a fan-out of ``fan`` at most: a range of a group of blocks first
adds up what these send and passes one run to each of its sub-ranges, so the number of runs grows
with the number of blocks times their depth in the tree, not with its square.

Keys of pairs and longer n-grams are cut to 20 bits more than it takes to number the corpus's
bytes, so that any one of them is mistaken for another with a probability of a millionth.

Nulls and odd rows: a null or empty text is the end token alone; a null doc_id counts as the
empty text when it is hashed; repeated rows are scored, and counted, once each; an empty
table gives no rows; with no training documents both scores follow from N = V = 0; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_bytes, trim

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, vocabulary long, base_score double, score double"
#: Hashes of what is no word: the end of a text and the state before its first word.
END, START = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
ADDED = 0.1
ORDER, STRENGTH = 3, 16.0


def held_out(keys: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if k is None else str(k).encode()) % 10 == 0 for k in keys], bool)


class Block:
    """The n-grams of a block of documents: a key for each order and position.

    ``keys[k]`` and ``valid[k]`` are of order k + 1; keys of pairs and more have ``bits`` bits.
    """

    def __init__(self, table: pa.Table, order: int, bits: int = 64):
        pa.set_memory_pool(pa.system_memory_pool())  # gives back at once what a block has used
        self.order = order
        self.ids = table.column("doc_id").to_pylist()
        self.n = len(self.ids)
        texts = pc.fill_null(table.column("text"), "").combine_chunks()
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
        flat = lists.flatten()
        owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        coded = pc.dictionary_encode(flat)
        del texts, lists, flat
        names = np.array([xxhash.xxh64_intdigest(w.encode()) for w in coded.dictionary.to_pylist()] or [0], np.uint64)
        keep = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False) if len(coded.dictionary) else np.zeros(1, bool)
        code = coded.indices.to_numpy(zero_copy_only=False)
        real = keep[code] if len(code) else np.zeros(0, bool)
        word, owner = names[code[real]] if len(code) else np.zeros(0, np.uint64), owner[real]
        counts = np.bincount(owner, minlength=self.n).astype(np.int64)
        stops = np.cumsum(counts)
        tokens = np.insert(word, stops, END)
        self.lengths = counts + 1
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.at = (np.arange(len(tokens)) - np.repeat(self.starts, self.lengths)).astype(np.int32)  # position in the document
        self.train = ~held_out(self.ids)
        self.trained = np.repeat(self.train, self.lengths)
        self.keys, self.valid = [tokens], [np.ones(len(tokens), bool)]
        whole = tokens
        for k in range(2, order + 1):
            before = np.roll(whole, 1)
            before[self.at == 0] = START
            with np.errstate(over="ignore"):
                x = (before ^ (before >> np.uint64(29))) * _A + tokens * _B + np.uint64(k)
                x ^= x >> np.uint64(32)
                whole = x * _A
            whole ^= whole >> np.uint64(29)
            self.keys.append(whole >> np.uint64(64 - bits))
            self.valid.append(self.at >= k - 2)

    def distinct(self, level: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of the asked positions, their training and other counts, and each position's place.

        Words also hold the start state, once for each document, so that its count is known.
        """
        extra = np.full(self.n if level == 0 else 0, START)
        keys = np.concatenate([self.keys[level][asked], extra])
        weight = np.concatenate([self.trained[asked], self.train if level == 0 else np.zeros(0, bool)])
        unique, inverse = np.unique(keys, return_inverse=True)
        train = np.bincount(inverse, weights=weight, minlength=len(unique)).astype(np.int64)
        place = np.zeros(len(asked), np.int64)
        place[asked] = inverse[: int(asked.sum())]
        return unique, train, np.bincount(inverse, minlength=len(unique)) - train, place

    def before(self, values: np.ndarray, first) -> np.ndarray:
        """Each position's value of the position before it, ``first`` at the start of a document."""
        out = np.roll(values, 1)
        out[self.at == 0] = first
        return out


# Runs of keys and of counts, byte plane by byte plane: the high planes are near empty.


def _planes(values: np.ndarray) -> bytes:
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = max((k + 1 for k in range(8) if planes[k].any()), default=1)
    data = np.ascontiguousarray(planes[:used]).tobytes()
    return bytes([used]) + len(values).to_bytes(4, "little") + (pa.Codec("zstd", 1).compress(data, asbytes=True) if data else b"")


def _values(data: bytes) -> np.ndarray:
    used, n = data[0], int.from_bytes(data[1:5], "little")
    out = np.zeros((8, n), np.uint8)
    if n:
        out[:used] = np.frombuffer(pa.Codec("zstd").decompress(data[5:], used * n, asbytes=True), np.uint8).reshape(used, n)
    return np.ascontiguousarray(out.T).view("<u8")[:, 0]


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_values(data), dtype=np.uint64)


def cuts(unique: np.ndarray, level: int, bits: int, path: int, depth: int, fan: int) -> np.ndarray:
    """Where each of the ``fan`` sub-ranges of the range ``path`` begins, at ``depth`` in the tree."""
    width = 64 if level == 0 else bits
    marks = np.array([((path * fan + s) << width) // fan**depth for s in range(1, fan)], np.uint64)
    return np.concatenate([[0], np.searchsorted(unique, marks), [len(unique)]]).astype(np.int64)


class Automaton:
    """Arc and failure weights at every position of a block, from the totals of its n-grams.

    ``seen[k]``: training count of the n-gram of order k + 1 that ends at each position.
    """

    def __init__(self, block: Block, seen: list[np.ndarray], starts: float, tokens: int, vocabulary: int, strength: float):
        self.block, self.order = block, block.order
        self.known = seen[0] > 0
        p = (seen[0] + ADDED) / (tokens + ADDED * (vocabulary + 1))
        self.root = np.log10(p)
        self.arc, self.has_arc, self.failure = [], [], []
        for k in range(2, self.order + 1):
            context = block.before(seen[k - 2], starts if k == 2 else 0)
            p = np.where(block.valid[k - 1], (seen[k - 1] + strength * p) / (context + strength), p)
            self.arc.append(np.log10(p))
            self.has_arc.append(block.valid[k - 1] & (seen[k - 1] > 0))
            self.failure.append(np.log10(strength / (context + strength)))
        self.start_level = int(starts > 0 and self.order > 1)

    def base(self) -> np.ndarray:
        return np.add.reduceat(self.root, self.block.starts) if self.block.n else np.zeros(0)

    def traverse(self) -> np.ndarray:
        """One step for each position, for all documents that are still running.

        ``level`` is the state: how many of the last words the automaton remembers.
        """
        block = self.block
        rank = np.argsort(-block.lengths, kind="stable")
        starts, lengths = block.starts[rank], block.lengths[rank]
        score, level = np.zeros(block.n), np.full(block.n, self.start_level)
        running = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if block.n else 0), side="left")
        for t, n in enumerate(running.tolist()):
            at, state = starts[:n] + t, level[:n]
            reached = np.where(self.known[at], 1, 0)
            gain = np.zeros(n)
            open_ = np.ones(n, bool)
            for k in range(self.order, 1, -1):
                here = open_ & (state >= k - 1)
                arc = here & self.has_arc[k - 2][at]
                gain += np.where(arc, self.arc[k - 2][at], np.where(here, self.failure[k - 2][at], 0.0))
                reached[arc] = k
                open_ &= ~arc
            score[:n] += gain + np.where(open_, self.root[at], 0.0)
            level[:n] = np.minimum(reached, self.order - 1)
        out = np.empty(block.n)
        out[rank] = score
        return out


# Exchanges. A unit is a block, or a group of blocks further up; a part is a range of keys.

_SENT = "unit long, part long, level int, keys binary, train binary, other binary"
_ANSWER = "unit long, part long, level int, totals binary, tokens long, vocabulary long"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    named = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(named)
    return pa.table([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, named)], names=[n for n, _ in named])


def _runs(unit: int, level: int, path: int, depth: int, shape: tuple[int, int], unique, train, other) -> list[tuple]:
    """Rows for all sub-ranges, empty ones too: every range answers every unit."""
    fan, bits = shape
    edges = cuts(unique, level, bits, path, depth, fan).tolist()
    return [(unit, path * fan + s, level, packed(unique[a:b]), _planes(train[a:b]), _planes(other[a:b])) for s, (a, b) in enumerate(zip(edges, edges[1:]))]


def _send_words(shape: tuple[int, int], order: int):
    """The words and pairs of a block."""

    def run(key, docs):
        block = Block(docs, min(order, 2), shape[1])
        rows = []
        for level in range(min(order, 2)):
            unique, train, other, _ = block.distinct(level, block.valid[level])
            rows += _runs(key[0].as_py(), level, 0, 1, shape, unique, train, other)
        del block
        trim()
        return _table(_SENT, rows)

    return run


class Known:
    """What a block knows of its n-grams from the answers so far."""

    def __init__(self, block: Block, answers: pa.Table):
        rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("level", "part", "totals", "tokens", "vocabulary"))), key=lambda r: r[:2])
        self.block = block
        self.tokens, self.vocabulary = (sum(r[c] for r in rows if r[0] == 0) for c in (3, 4))
        self.seen: list[np.ndarray] = []
        self.shared = np.ones(len(block.at), bool)
        levels = sorted({r[0] for r in rows})
        for level in levels:
            totals = np.concatenate([_values(r[2]) for r in rows if r[0] == level])
            asked = self.asked(level)
            unique, _, _, place = block.distinct(level, asked)
            if level == 0:
                self.starts = int(totals[np.searchsorted(unique, START)] >> np.uint64(1)) if block.n else 0
            answer = totals[place] if len(totals) else np.zeros(len(place), np.uint64)
            # What wasn't asked for occurs here alone.
            self.seen.append(np.where(asked, answer >> np.uint64(1), block.trained & block.valid[level]).astype(np.float64))
            self.shared = asked & ((answer & np.uint64(1)) > 0)

    def asked(self, level: int) -> np.ndarray:
        """Positions whose n-gram of this level may occur elsewhere."""
        if level < 2:
            return self.block.valid[level]
        return self.block.valid[level] & self.block.before(self.shared, False)


def _send_longer(shape: tuple[int, int], level: int):
    """N-grams of order level + 1 whose context the answers tell to occur elsewhere."""

    def run(key, docs, answers):
        rows = []
        if docs.num_rows:
            block = Block(docs, level + 1, shape[1])
            known = Known(block, answers)
            unique, train, other, _ = block.distinct(level, known.asked(level))
            rows = _runs(key[0].as_py(), level, 0, 1, shape, unique, train, other)
            del block, known
            trim()
        return _table(_SENT, rows)

    return run


def _columns(table: pa.Table, *names: str) -> list[list]:
    return [table.column(c).to_pylist() for c in names]


def _merged(table: pa.Table, level: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Rows of a level, their distinct keys with summed counts, and each row's places in them."""
    levels, keys, train, other = _columns(table, "level", "keys", "train", "other")
    rows = [i for i, x in enumerate(levels) if x == level]
    runs = [unpacked(keys[i]) for i in rows]
    unique, inverse = np.unique(np.concatenate(runs), return_inverse=True)
    add = lambda parts: np.bincount(inverse, weights=np.concatenate([_values(parts[i]) for i in rows]).astype(np.float64), minlength=len(unique)).astype(np.int64)
    return rows, unique, add(train), add(other), np.split(inverse, np.cumsum([len(r) for r in runs])[:-1])


def _answer(table):
    """Totals of a range for every unit that asks: twice the training count, plus 1 if there is more than one in all."""
    out = []
    units, parts, levels = _columns(table, "unit", "part", "level")
    for level in sorted(set(levels)):
        rows, unique, train, other, places = _merged(table, level)
        word = unique != START
        tokens, vocabulary = (int(train[word].sum()), int((train[word] > 0).sum())) if level == 0 else (0, 0)
        value = train * 2 + (train + other > 1)
        out += [(units[i], parts[i], level, _planes(value[p]), tokens, vocabulary) for i, p in zip(rows, places)]
    trim()
    return _table(_ANSWER, out)


def _merge(shape: tuple[int, int], depth: int):
    """What a group of units sends on: the sums of a range, cut to its sub-ranges."""

    def run(key, table):
        group, path = (x.as_py() for x in key)
        out = []
        for level in sorted(set(_columns(table, "level")[0])):
            _, unique, train, other, _ = _merged(table, level)
            out += _runs(group, level, path, depth + 1, shape, unique, train, other)
        return _table(_SENT, out)

    return run


def _spread(table, answers):
    """A group's answers, dealt to its units."""
    out = []
    units, parts, levels = _columns(table, "unit", "part", "level")
    for level in sorted(set(levels)):
        rows, _, _, _, places = _merged(table, level)
        top = sorted((r for r in zip(*_columns(answers, "level", "part", "totals", "tokens", "vocabulary")) if r[0] == level), key=lambda r: r[1])
        totals = np.concatenate([_values(r[2]) for r in top])
        tokens, vocabulary = (sum(r[c] for r in top) for c in (3, 4))
        out += [(units[i], parts[i], level, _planes(totals[p]), tokens, vocabulary) for i, p in zip(rows, places)]
    return _table(_ANSWER, out)


def _exchange(sent: DataFrame, shape: tuple[int, int], levels: int, depth: int = 1) -> DataFrame:
    """Answers to every run of ``sent``, through ``levels`` levels of the tree."""
    fan = shape[0]
    if levels == 1:
        return sent.groupBy("part").applyInArrow(_answer, _ANSWER)
    grouped = sent.withColumn("group", F.expr(f"unit div {fan}"))
    passed = grouped.groupBy("group", "part").applyInArrow(_merge(shape, depth), _SENT)
    answers = _exchange(passed, shape, levels - 1, depth + 1)
    back = answers.select(F.col("unit").alias("to"), F.expr(f"part div {fan}").alias("up"), "part", "level", "totals", "tokens", "vocabulary")
    return grouped.groupBy("group", "part").cogroup(back.groupBy("to", "up")).applyInArrow(_spread, _ANSWER)


def _score(shape: tuple[int, int], order: int, strength: float):
    def run(docs, answers):
        if not docs.num_rows:
            return pa.table([pa.array([], pa.bool_() if "boolean" in x else pa.float64() if "double" in x else pa.int64()) for x in RESULT.split(", ")], names=[x.split()[0] for x in RESULT.split(", ")])
        block = Block(docs, order, shape[1])
        known = Known(block, answers)
        automaton = Automaton(block, known.seen, known.starts, known.tokens, known.vocabulary, strength)
        n_known = np.add.reduceat(automaton.known.astype(np.int64), block.starts)
        columns = [pa.array(block.ids, pa.int64()), pa.array(~block.train), pa.array(block.lengths), pa.array(n_known), pa.array([known.tokens] * block.n, pa.int64()), pa.array([known.vocabulary] * block.n, pa.int64()), pa.array(automaton.base()), pa.array(automaton.traverse())]
        return pa.table(columns, names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def lm_scores(docs: DataFrame, order: int = ORDER, strength: float = STRENGTH, block_bytes: int = 8 << 20, fan: int = 256) -> DataFrame:
    """Score every document with a model of the training documents among them.

    ``strength`` is K above. ``block_bytes`` bounds the text that a task holds; with it the
    number of blocks, and of ranges, follows the input.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    size = text_bytes(rows)
    blocks = max(1, -(-size // block_bytes))
    levels = next(d for d in range(1, 64) if fan**d >= blocks)
    fan = next(f for f in range(1, fan + 1) if f**levels >= blocks)
    shape = (fan, min(64, size.bit_length() + 20))
    # Copies of a row, of which a third of the corpus may consist, differ by their partition.
    unit = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks))
    dealt = rows.withColumn("unit", unit)
    every = None
    for level in range(1, max(order, 2)):
        if every is None:
            sent = dealt.groupBy("unit").applyInArrow(_send_words(shape, order), _SENT)
        else:
            sent = dealt.groupBy("unit").cogroup(every.groupBy("to")).applyInArrow(_send_longer(shape, level), _SENT)
        answers = _exchange(sent, shape, levels).withColumnRenamed("unit", "to")
        every = answers if every is None else every.unionByName(answers)
    return dealt.groupBy("unit").cogroup(every.groupBy("to")).applyInArrow(_score(shape, order, strength), RESULT)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_scores(documents(spark, sf_dir))
    return scores.withColumn("base_score", F.round("base_score", 6)).withColumn("score", F.round("score", 6))


#: crc32 of a decimal text; the table of the checksum follows from its polynomial.
_CRC = """
crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)))
"""
SQL = f"""
WITH {_CRC.strip()},
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT r, doc_id, list_concat(w, [' ']) AS w, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(k) + 1), lambda i: CAST(ord(k[i]) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10 = 0 AS held_out FROM d, crc),
e AS (SELECT r, doc_id, held_out, unnest(w) AS w, unnest(range(len(w))) AS i FROM h),
t AS (SELECT r, doc_id, held_out, w, i, coalesce(lag(w) OVER o, '  ') AS a, CASE WHEN i = 0 THEN NULL ELSE coalesce(lag(w, 2) OVER o, '  ') END AS b FROM e WINDOW o AS (PARTITION BY r ORDER BY i)),
c1 AS (SELECT w, count(*) AS n FROM t WHERE NOT held_out GROUP BY w),
c2 AS (SELECT a, w, count(*) AS n FROM t WHERE NOT held_out GROUP BY a, w),
c3 AS (SELECT b, a, w, count(*) AS n FROM t WHERE NOT held_out AND b IS NOT NULL GROUP BY b, a, w),
z AS (SELECT coalesce(sum(n), 0)::BIGINT AS n, count(*) AS v, (SELECT count(*) FROM h WHERE NOT held_out) AS s FROM c1),
p AS (
  SELECT t.r, t.doc_id, t.held_out, c1.n IS NOT NULL AS known, z.n AS train_tokens, z.v AS vocabulary, (coalesce(c1.n, 0) + {ADDED}) / (z.n + {ADDED} * (z.v + 1)) AS p1, t.b,
    coalesce(c2.n, 0) AS n2, CASE WHEN t.i = 0 THEN z.s ELSE coalesce(x.n, 0) END AS h2, coalesce(c3.n, 0) AS n3, coalesce(y.n, 0) AS h3
  FROM t CROSS JOIN z LEFT JOIN c1 ON c1.w = t.w LEFT JOIN c2 ON c2.a = t.a AND c2.w = t.w LEFT JOIN c1 AS x ON x.w = t.a
    LEFT JOIN c3 ON c3.b = t.b AND c3.a = t.a AND c3.w = t.w LEFT JOIN c2 AS y ON y.a = t.b AND y.w = t.a),
q AS (SELECT *, (n2 + {STRENGTH} * p1) / (h2 + {STRENGTH}) AS p2 FROM p)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, any_value(train_tokens) AS train_tokens, any_value(vocabulary) AS vocabulary, round(sum(log10(p1)), 6) AS base_score,
  round(sum(log10(CASE WHEN b IS NULL THEN p2 ELSE (n3 + {STRENGTH} * p2) / (h3 + {STRENGTH}) END)), 6) AS score
FROM q GROUP BY r, doc_id, held_out
"""
