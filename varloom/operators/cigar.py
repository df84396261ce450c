"""Alignment runs: CIGAR, MD and clip arithmetic as column expressions.

Operations and what they advance: M = X both axes, I S the query, D N the reference, H P
neither. Positions are 1-based.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ON_REFERENCE, ON_QUERY = ("M", "=", "X", "D", "N"), ("M", "=", "X", "I", "S")
_OPS = "([0-9]+)([MIDNSHP=X])"


def operations(cigar: Column) -> Column:
    """Array of (len, op)."""
    lengths, ops = F.regexp_extract_all(cigar, F.lit(_OPS), F.lit(1)), F.regexp_extract_all(cigar, F.lit(_OPS), F.lit(2))
    return F.transform(F.arrays_zip(lengths.alias("n"), ops.alias("op")), lambda x: F.struct(x["n"].cast("int").alias("len"), x["op"].alias("op")))


def total(ops: Column, kinds: tuple[str, ...]) -> Column:
    return F.aggregate(F.filter(ops, lambda x: x["op"].isin(*kinds)), F.lit(0).cast("long"), lambda a, x: a + x["len"])


def reference_end(pos: Column, ops: Column) -> Column:
    return pos + total(ops, ON_REFERENCE) - 1


def query_length(ops: Column) -> Column:
    """Read length, hard-clipped bases included."""
    return total(ops, (*ON_QUERY, "H"))


def clip(ops: Column, side: str) -> Column:
    """(size, hard) of the clip at one end, (0, false) without."""
    end = F.try_element_at(ops, F.lit(1 if side == "left" else -1))
    clips = end["op"].isin("S", "H")
    return F.struct(F.when(clips, end["len"]).otherwise(0).alias("size"), F.coalesce(end["op"] == "H", F.lit(False)).alias("hard"))


def read_span(ops: Column, minus: Column) -> Column:
    """(start, end) on the read as it was sequenced: they descend on the minus strand."""
    left, right, size = clip(ops, "left")["size"], clip(ops, "right")["size"], query_length(ops)
    start = F.when(minus, size - left).otherwise(left + 1)
    end = F.when(minus, right + 1).otherwise(size - right)
    return F.struct(start.alias("start"), end.alias("end"))


def aligned_runs(df: DataFrame, cigar: str = "cigar", pos: str = "pos", seq: str | None = "seq") -> DataFrame:
    """One row a run: idx, op, len, rpos, qpos and the run's read bases (``run_seq``).

    Offsets are running sums inside the row.
    """
    keep = df.columns
    ops = df.withColumn("__ops", operations(F.col(cigar)))
    step = "named_struct('r', a.r + if(x.op in ('M','=','X','D','N'), x.len, 0), 'q', a.q + if(x.op in ('M','=','X','I','S'), x.len, 0), 'out', concat(a.out, array(named_struct('op', x.op, 'len', x.len, 'rpos', a.r, 'qpos', a.q))))"
    fold = f"aggregate(__ops, named_struct('r', cast({pos} as bigint), 'q', 1L, 'out', cast(array() as array<struct<op:string,len:int,rpos:bigint,qpos:bigint>>)), (a, x) -> {step}).out"
    rows = ops.select(*keep, F.posexplode(F.expr(fold)).alias("idx", "x")).select(*keep, "idx", "x.*")
    if seq:
        bases = F.when(F.col("op").isin(*ON_QUERY), F.substring(seq, F.col("qpos").cast("int"), F.col("len")))
        rows = rows.withColumn("run_seq", bases)
    return rows


def md_tokens(md: Column) -> Column:
    """Parts of an MD tag: match lengths, mismatched bases, ^deleted bases."""
    return F.filter(F.regexp_extract_all(md, F.lit("(\\^[A-Z]+|[0-9]+|[A-Z])"), F.lit(1)), lambda x: x != "0")


def flavour(cigar: Column, md: Column) -> Column:
    """How an alignment tells its mismatches, row by row."""
    exact = cigar.rlike("[=X]")
    return F.when(exact & md.isNotNull(), "=X+MD").when(exact, "=X").when(md.isNotNull(), "M+MD").otherwise("M")


def split_runs(cigar: str, md: str | None) -> list[tuple[str, int]]:
    """(op, len) with every M divided into = and X by the MD tag; M stays = where there is none."""
    import re

    marks: list[list] = []
    for token in re.findall(r"\^[A-Z]+|[0-9]+|[A-Z]", md or ""):
        if token[0] == "^":
            continue
        kind, n = ("=", int(token)) if token.isdigit() else ("X", 1)
        if n and marks and marks[-1][0] == kind:
            marks[-1][1] += n
        elif n:
            marks.append([kind, n])
    out: list[tuple[str, int]] = []
    at, used = 0, 0
    for n, op in re.findall(_OPS, cigar):
        left = int(n)
        if op != "M" or not marks:
            out.append(("=" if op == "M" else op, left))
            if op in "=X" and marks:  # the tag also counts runs that are told apart already
                while left and at < len(marks):
                    step = min(left, marks[at][1] - used)
                    left, used = left - step, used + step
                    if used == marks[at][1]:
                        at, used = at + 1, 0
            continue
        while left:
            if at >= len(marks):
                raise ValueError(f"MD {md} is too short for {cigar}")
            step = min(left, marks[at][1] - used)
            out.append((marks[at][0], step))
            left, used = left - step, used + step
            if used == marks[at][1]:
                at, used = at + 1, 0
    return out


def with_exact_cigar(df: DataFrame) -> DataFrame:
    """``df`` with its cigar's M runs divided by the MD tag; rows that have none pass unchanged."""
    needs = F.col("cigar").contains("M") & F.col("md").isNotNull()
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = ["".join(f"{n}{op}" for op, n in split_runs(c, m)) for c, m in zip(batch.column("cigar").to_pylist(), batch.column("md").to_pylist())]
            yield batch.set_column(batch.schema.get_field_index("cigar"), "cigar", pa.array(exact, pa.string()))

    return df.filter(~needs).unionByName(df.filter(needs).mapInArrow(run, schema))


def mark_mismatches(runs: DataFrame, tiles: DataFrame, tile: int) -> DataFrame:
    """Exact runs for alignments without MD tag: M runs compared with the reference's tiles.

    A run is joined with the tiles it lies on, cut at their edges, and divided where its bases
    change between like and unlike.
    """
    m = runs.filter("op = 'M'").withColumn("tile", F.explode(F.sequence(F.floor((F.col("rpos") - 1) / tile).cast("int"), F.floor((F.col("rpos") + F.col("len") - 2) / tile).cast("int"))))
    low = F.greatest(F.col("rpos"), F.col("tile").cast("long") * tile + 1)
    high = F.least(F.col("rpos") + F.col("len") - 1, (F.col("tile").cast("long") + 1) * tile)
    m = m.join(tiles.select(F.col("chrom"), "tile", F.col("seq").alias("__ref")), ["chrom", "tile"]).withColumn("low", low).withColumn("high", high)
    part = F.substring("run_seq", (F.col("low") - F.col("rpos") + 1).cast("int"), (F.col("high") - F.col("low") + 1).cast("int"))
    ref = F.substring("__ref", (F.col("low") - F.col("tile").cast("long") * tile).cast("int"), (F.col("high") - F.col("low") + 1).cast("int"))
    m = m.withColumn("__a", F.upper(part)).withColumn("__b", F.upper(ref))
    same = "transform(sequence(1, length(__a)), i -> substring(__a, i, 1) = substring(__b, i, 1))"
    cuts = f"aggregate({same}, cast(array() as array<struct<same:boolean,n:int>>), (a, s) -> if(size(a) > 0 and element_at(a, -1).same = s, concat(slice(a, 1, size(a) - 1), array(named_struct('same', s, 'n', element_at(a, -1).n + 1))), concat(a, array(named_struct('same', s, 'n', 1)))))"
    places = f"transform(array({cuts}), c -> transform(c, (x, i) -> named_struct('op', if(x.same, '=', 'X'), 'len', x.n, 'skip', aggregate(slice(c, 1, i), 0, (t, y) -> t + y.n))))[0]"
    parts = m.withColumn("x", F.explode(F.expr(places)))
    fixed = {"op": F.col("x.op"), "len": F.col("x.len"), "rpos": F.col("low") + F.col("x.skip"), "qpos": F.col("qpos") + F.col("low") - F.col("rpos") + F.col("x.skip"), "run_seq": F.substring("__a", F.col("x.skip") + 1, F.col("x.len"))}
    return runs.filter("op <> 'M'").unionByName(parts.select(*(fixed[c].alias(c) if c in fixed else F.col(c) for c in runs.columns)))


def signatures(runs: DataFrame, min_size: int, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Insertion and deletion runs of at least ``min_size``, inside a window if one is given."""
    found = runs.filter(F.col("op").isin("I", "D") & (F.col("len") >= min_size))
    if start is not None:
        found = found.filter(F.col("rpos").between(start, end))
    return found


def query_position(runs: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """Query position of a reference position for each key: of the run that covers it."""
    advance = F.when(F.col("op").isin("M", "=", "X"), at - F.col("rpos")).otherwise(0)
    inside = F.col("op").isin(*ON_REFERENCE) & (F.col("rpos") <= at) & (at < F.col("rpos") + F.col("len"))
    return runs.filter(inside).groupBy(*keys).agg(F.max(F.col("qpos") + advance).alias("query_pos"))


def trim_clips(ops: Column) -> Column:
    """Operations without clips at either end."""
    return F.filter(ops, lambda x: ~x["op"].isin("S", "H"))
