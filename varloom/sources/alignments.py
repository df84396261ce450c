"""Alignments from SAM text and BAM files, and the filters that every scan applies.

Columns: qname, flag, chrom, pos (1-based), mapq, cigar, seq, nm, md, sa.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cigar as cg

SCHEMA = "qname string, flag int, chrom string, pos long, mapq int, cigar string, seq string, nm int, md string, sa string"
SECONDARY, REVERSE, UNMAPPED = 256, 16, 4


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SAM text; header lines are left out. Split by lines, so files of any size are read in parallel."""
    f = F.split("value", "\t")
    tag = lambda name: F.regexp_extract("value", f"\t{name}:[A-Za-z]:([^\t]*)", 1)
    lines = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.col("value") != ""))
    unset = lambda c: F.when(~c.isin("*", ""), c)
    return lines.select(
        f[0].alias("qname"), f[1].cast("int").alias("flag"), unset(f[2]).alias("chrom"), f[3].cast("long").alias("pos"), f[4].cast("int").alias("mapq"), unset(f[5]).alias("cigar"),
        unset(f[9]).alias("seq"), tag("NM").try_cast("int").alias("nm"), unset(tag("MD")).alias("md"), unset(tag("SA")).alias("sa"),
    )


def read_sam_header(spark: SparkSession, path: str) -> DataFrame:
    """chrom, length, rank of the contigs in a SAM header."""
    lines = spark.read.text(path).filter(F.col("value").startswith("@SQ"))
    named = lines.select(F.regexp_extract("value", "\tSN:([^\t]*)", 1).alias("chrom"), F.regexp_extract("value", "\tLN:([0-9]+)", 1).cast("long").alias("length"), F.monotonically_increasing_id().alias("__at"))
    return named.select("chrom", "length", (F.row_number().over(Window.orderBy("__at")) - 1).alias("rank"))


# BAM

# Fixed values of the format.
_BASES, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_SIZE = {b"A": 1, b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4}


def inflate(data: bytes) -> bytes:
    """Content of a blocked gzip file."""
    out, at = [], 0
    while at < len(data):
        d = zlib.decompressobj(31)
        out.append(d.decompress(data[at:]) + d.flush())
        at = len(data) - len(d.unused_data)
    return b"".join(out)


def _tags(data: bytes) -> dict[str, object]:
    found, at = {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), data[at + 2 : at + 3]
        at += 3
        if kind in (b"Z", b"H"):
            end = data.index(b"\0", at)
            found[name] = data[at:end].decode()
            at = end + 1
        elif kind == b"B":
            (n,) = struct.unpack_from("<I", data, at + 1)
            at += 5 + n * _SIZE[data[at : at + 1]]
        else:
            size = _SIZE[kind]
            found[name] = data[at : at + 1].decode() if kind == b"A" else struct.unpack_from("<" + {b"c": "b", b"C": "B", b"s": "h", b"S": "H", b"i": "i", b"I": "I", b"f": "f"}[kind], data, at)[0]
            at += size
    return found


def header(data: bytes) -> tuple[list[str], list[int], int] | None:
    """Names and lengths of the contigs and where the records begin; None if ``data`` ends before."""
    if data[:4] != b"BAM\1"[: len(data)]:
        raise ValueError("no BAM")
    try:
        (text,) = struct.unpack_from("<i", data, 4)
        (contigs,) = struct.unpack_from("<i", data, 8 + text)
        at, names, lengths = 12 + text, [], []
        for _ in range(contigs):
            (n,) = struct.unpack_from("<i", data, at)
            names.append(data[at + 4 : at + 3 + n].decode())
            lengths.append(struct.unpack_from("<i", data, at + 4 + n)[0])
            at += 8 + n
    except struct.error:
        return None
    return names, lengths, at


def record_size(data: bytes, at: int) -> int:
    """Bytes of the record at ``at``, 0 if it goes on past the data."""
    if at + 4 > len(data):
        return 0
    size = 4 + struct.unpack_from("<i", data, at)[0]
    return size if at + size <= len(data) else 0


def parse_record(data: bytes, at: int) -> tuple:
    """Contig number and the columns of the alignments schema without it."""
    size, ref, pos, name_len, mapq, _, n_cigar, flag, length = struct.unpack_from("<iiiBBHHHi", data, at)
    p, end = at + 36, at + 4 + size
    qname = data[p : p + name_len - 1].decode()
    p += name_len
    cigar = "".join(f"{x >> 4}{_OPS[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", data, p))
    p += 4 * n_cigar
    packed = data[p : p + (length + 1) // 2]
    seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:length]
    p += (length + 1) // 2 + length
    tags = _tags(data[p:end])
    return ref, qname, flag, pos + 1, mapq, tags.get("CG_TEXT") or cigar or None, seq or None, tags.get("NM"), tags.get("MD"), tags.get("SA")


def plausible(data: bytes, at: int) -> int:
    """Size of what may be a record at ``at`` (-1: surely none, 0: too little data to tell)."""
    if at + 36 > len(data):
        return 0
    size, ref, pos, name_len, _, _, n_cigar, flag, length, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    least = 32 + name_len + 4 * n_cigar + (length + 1) // 2 + length
    if not (32 < size < 1 << 29 and ref >= -1 and pos >= -1 and mate >= -1 and mate_pos >= -1 and name_len > 1 and length >= 0 and flag < 1 << 12 and least <= size):
        return -1
    name = data[at + 36 : at + 36 + name_len]
    if len(name) == name_len and (name[-1] != 0 or not all(32 < c < 127 for c in name[:-1])):
        return -1
    return 4 + size


def first_record(data: bytes, chain: int = 4) -> int:
    """Where the first of ``chain`` records in a row begins, or of those that the data ends in; -1 if nowhere."""
    for at in range(len(data) - 36):
        there, n = at, 0
        while n < chain:
            size = plausible(data, there)
            if size < 0:
                break
            if size == 0 or there + size > len(data):
                n = chain if n else n
                break
            there, n = there + size, n + 1
        if n >= chain or (n and there == len(data)):
            return at
    return -1


#: Fixed value: how blocks of a blocked gzip file begin, up to their size.
_BLOCK = bytes((31, 139, 8, 4, 0, 0, 0, 0, 0, 255, 6, 0, 66, 67, 2, 0))
_PARSED = "path string, split long, ref int, qname string, flag int, pos long, mapq int, cigar string, seq string, nm int, md string, sa string, head binary, tail binary, names array<string>, lengths array<long>"
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    named = [x.split() for x in _PARSED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*rows), named)], names=[n for n, _ in named])


def _row(path: str, split: int, record: tuple = (None,) * 10, head=None, tail=None, names=None, lengths=None) -> tuple:
    return path, split, *record, head, tail, names, lengths


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """path, split, data: the blocks of blocked gzip files without their first 16 bytes.

    The constant beginning of the blocks is the line separator of a text scan, so files are
    split, and read in parallel, by Spark itself, wherever they lie.
    """
    text = spark.read.option("lineSep", _BLOCK.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("data"))


class _Split:
    """Records of one split: whole ones as rows, its first and last pieces for its neighbours."""

    def __init__(self, path: str, split: int):
        self.path, self.split, self.data, self.started, self.head = path, split, b"", False, None

    def rows(self, more: bytes, last: bool) -> Iterator[tuple]:
        self.data += more
        if not self.started:
            if self.split == 0:
                found = header(self.data)
                if found is None:
                    return
                at = found[2]
                yield _row(self.path, 0, names=found[0], lengths=found[1])
            else:
                if len(self.data) < 1 << 19 and not last:
                    return
                at = first_record(self.data)
                if at < 0:
                    if last:
                        raise ValueError("a split holds no whole record: raise spark.sql.files.maxPartitionBytes")
                    return
                self.head = self.data[:at]
            self.data, self.started = self.data[at:], True
        at = 0
        while size := record_size(self.data, at):
            yield _row(self.path, self.split, parse_record(self.data, at))
            at += size
        self.data = self.data[at:]
        if last:
            yield _row(self.path, self.split, head=self.head or b"", tail=self.data)


def _parse_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current: _Split | None = None
    rows: list[tuple] = []
    for batch in batches:
        for path, split, data in zip(*(batch.column(c).to_pylist() for c in ("path", "split", "data"))):
            if len(data) < 10:  # what stands before the first block
                continue
            if current is None or (current.path, current.split) != (path, split):
                if current is not None:
                    rows += current.rows(b"", True)
                current = _Split(path, split)
            rows += current.rows(zlib.decompress(data[2:-8], -15), False)
            if len(rows) >= 2_000:
                yield _batch(rows)
                rows = []
    if current is not None:
        rows += current.rows(b"", True)
    if rows:
        yield _batch(rows)


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records between a split's last piece and the next one's first."""
    for batch in batches:
        rows = []
        for path, split, tail, head in zip(*(batch.column(c).to_pylist() for c in ("path", "split", "tail", "next"))):
            data, at = (tail or b"") + (head or b""), 0
            while size := record_size(data, at):
                rows.append(_row(path, split, parse_record(data, at)))
                at += size
            if at != len(data):
                raise ValueError(f"{path} ends inside a record")
        if rows:
            yield _batch(rows)


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    """Files whose blocks begin otherwise: one task a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = _Split(name, 0)
                rows: list[tuple] = []
                for row in part.rows(inflate(content.as_py()), True):
                    rows.append(row)
                    if len(rows) == 5_000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _PARSED)


def read_bam(spark: SparkSession, path: str, index: DataFrame | None = None, regions: DataFrame | None = None, with_place: bool = False) -> DataFrame:
    """BAM files, split as Spark splits any file: a split finds its first record by the shape of
    several in a row, and pieces of records at its ends are put together with its neighbours'.

    With an ``index`` (``index_bam``) and ``regions`` (chrom, start, end; null ends: a whole
    contig) only the splits that hold such a region are decoded, and only its alignments stay.
    The decoded rows are staged, as both the records and the pieces are read from them.
    """
    from ..plans.storage import staged

    blocks = _blocks(spark, path)
    start = blocks.filter("split = 0").select("data").first()
    if start is None or len(start.data) > 0:
        parsed = staged(_whole_files(spark, path), "bam")
    else:
        if index is not None and regions is not None:
            r = regions.select(F.col("chrom").alias("r_chrom"), F.coalesce("start", F.lit(1)).alias("r_start"), F.coalesce("end", F.lit(1 << 62)).alias("r_end"))
            inside = (F.col("chrom") == F.col("r_chrom")) & (F.col("start") <= F.col("r_end")) & (F.col("end") >= F.col("r_start"))
            wanted = index.join(r, inside, "left_semi").select("path", F.explode(F.array_compact(F.array(F.lit(0).cast("long"), "split", "next"))).alias("split")).distinct()
            blocks = blocks.join(F.broadcast(wanted), ["path", "split"], "left_semi")
        parsed = staged(blocks.mapInArrow(_parse_blocks, _PARSED), "bam")
    contigs = parsed.filter("names is not null").select(F.col("path").alias("h_path"), F.col("names").alias("h_names"))
    pieces = parsed.filter("tail is not null")
    after = F.lead(F.struct("split", "head")).over(Window.partitionBy("path").orderBy("split"))
    joined = pieces.withColumn("__n", after)
    if index is not None and regions is not None:  # a gap between decoded splits loses nothing that was asked for
        follows = index.select("path", "split", "next").distinct()
        joined = joined.join(follows, ["path", "split"], "left").filter(F.col("__n.split") == F.col("next"))
    between = joined.select("path", "split", "tail", F.col("__n.head").alias("next")).filter("octet_length(tail) > 0 or octet_length(next) > 0")
    rows = parsed.filter("qname is not null").unionByName(between.mapInArrow(_stitch, _PARSED))
    named = rows.join(contigs, F.col("path") == F.col("h_path")).withColumn("chrom", F.when(F.col("ref") >= 0, F.get("h_names", F.col("ref"))))
    columns = [x.split()[0] for x in SCHEMA.split(", ")]
    out = named.select(*(["path", "split"] if with_place else []), *columns)
    if regions is not None:
        from ..operators.intervals import in_regions

        out = in_regions(with_ends(out), regions).select(*out.columns)
    return out


def index_bam(spark: SparkSession, path: str) -> DataFrame:
    """path, split, chrom, start, end, next: what each split of BAM files spans, and the split after it.

    The splits are those of this session's file settings; the index serves reads under the same.
    """
    rows = with_ends(read_bam(spark, path, with_place=True)).groupBy("path", "split", "chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    splits = _blocks(spark, path).filter("octet_length(data) >= 10").select("path", "split").distinct()
    order = splits.withColumn("next", F.lead("split").over(Window.partitionBy("path").orderBy("split")))
    return rows.join(order, ["path", "split"])


def read_bam_header(spark: SparkSession, path: str) -> DataFrame:
    """path, chrom, length, rank of the contigs in BAM files."""
    first = _blocks(spark, path).filter("split = 0").mapInArrow(_header_rows, "path string, names array<string>, lengths array<long>")
    return first.select("path", F.posexplode(F.arrays_zip("names", "lengths")).alias("rank", "c")).select("path", F.col("c.names").alias("chrom"), F.col("c.lengths").alias("length"), "rank")


def _header_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: dict[str, bytes] = {}
    done: set[str] = set()
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("data").to_pylist()):
            if path in done or len(data) < 10:
                continue
            parts[path] = parts.get(path, b"") + zlib.decompress(data[2:-8], -15)
            if found := header(parts[path]):
                done.add(path)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([found[0]], pa.list_(pa.string())), pa.array([found[1]], pa.list_(pa.int64()))], names=["path", "names", "lengths"])


# Scans


def usable(df: DataFrame, min_mapq: int = 20) -> DataFrame:
    """Alignments with bases, of known and sufficient quality, that aren't secondary."""
    ok = (F.length(F.coalesce("seq", F.lit(""))) > 0) & (F.col("mapq") >= min_mapq) & (F.col("mapq") != 255)
    return df.filter(ok & (F.col("flag").bitwiseAND(SECONDARY) == 0) & F.col("cigar").isNotNull())


def with_ends(df: DataFrame) -> DataFrame:
    """Adds start and end on the reference."""
    return df.withColumn("start", F.col("pos")).withColumn("end", cg.reference_end(F.col("pos"), cg.operations(F.col("cigar"))))


def named(df: DataFrame, names: DataFrame) -> DataFrame:
    """Alignments of the reads in ``names`` (qname)."""
    return df.join(names.select("qname").distinct(), "qname", "left_semi")


def local_coverage(df: DataFrame, keys: list[str]) -> DataFrame:
    """bases, reads, span, mean read length and coverage (4 bases / span) of each key."""
    size = F.length("seq")
    stats = df.groupBy(*keys).agg(F.sum(size).alias("bases"), F.count(F.lit(1)).alias("reads"), (F.max("end") - F.min("start") + 1).alias("span"), F.avg(size).alias("mean_read_len"))
    return stats.withColumn("coverage", F.expr("4D * bases / greatest(span, 1)"))


def signature_density(df: DataFrame, min_size: int) -> Column:
    """Insertions and deletions of at least ``min_size`` for each 1,000 reference bases of an alignment."""
    ops = cg.operations(F.col("cigar"))
    n = F.size(F.filter(ops, lambda x: x["op"].isin("I", "D") & (x["len"] >= min_size)))
    return n * 1000.0 / F.greatest(F.col("end") - F.col("start") + 1, F.lit(1))


def drop_dense_reads(df: DataFrame, max_density: float, min_size: int = 18, short: int = 1000) -> DataFrame:
    """Reads whose densest alignment is within bounds, with some slack where no other alignment is.

    Short dense alignments rule their read out.
    """
    rows = df.withColumn("__density", signature_density(df, min_size))
    rows = rows.withColumn("__bad", (F.col("end") - F.col("start") < short) & (F.col("__density") > max_density))
    reads = rows.groupBy("qname").agg(F.max("__density").alias("most"), F.bool_or("__bad").alias("bad"), F.bool_and(F.col("sa").isNull()).alias("alone"))
    kept = reads.filter(~F.col("bad") & ((F.col("most") <= max_density) | (F.col("alone") & (F.col("most") <= 1.5 * max_density))))
    return df.join(kept.select("qname"), "qname", "left_semi")


def skip_ultra_deep(df: DataFrame, limit: float = 5_000.0, tile: int = 100_000) -> DataFrame:
    """Without the alignments that begin in tiles covered more than ``limit`` times (collapsed repeats)."""
    at = F.floor(F.col("start") / tile)
    deep = df.groupBy("chrom", at.alias("__tile")).agg((F.sum(F.col("end") - F.col("start") + 1) / tile).alias("__depth")).filter(F.col("__depth") > limit)
    return df.withColumn("__tile", at).join(deep.select("chrom", "__tile"), ["chrom", "__tile"], "left_anti").drop("__tile")
