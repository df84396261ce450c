"""Media columns: interleaved document sequences with payloads resolved by digest.

HTML becomes an ordered array of structs, one for each text run or media reference:
``position, kind ('text' or 'media'), text, digest, caption``. A figure's caption goes to all of
its media, wherever in the figure it stands; scripts, styles, templates and noscript parts give
neither text nor media; a template, noscript part or caption that is never closed hides nothing.
A media store is a table of
(digest, stored form); references meet it in a join on the digest, after which every struct is
still at its position with its own caption.

Payloads are stored as PNG images of 8-bit RGB samples, 64 pixels (192 bytes) a row.

Nulls and odd rows: null HTML gives an empty sequence, a null text an empty payload (one row
of spaces); a reference whose digest the store lacks stays in place with a null payload;
repeated rows are kept, copies of a payload are measured once each stored copy and joined as
one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize

ROW = 192
SEGMENTS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


# The stored form


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pad(data: bytes) -> bytes:
    """``data`` with spaces up to a positive multiple of a pixel row."""
    return data + b" " * (ROW - len(data) if not data else -len(data) % ROW)


def to_png(payload: bytes, level: int = 1) -> bytes:
    """Lossless 8-bit RGB image of a padded payload."""
    height = len(payload) // ROW
    samples = np.zeros((height, ROW + 1), np.uint8)  # each row begins with its filter, 0: none
    samples[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    header = struct.pack(">IIBBBBB", ROW // 3, height, 8, 2, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(samples.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """Samples (rows, 192) of such an image; a checksum that fails raises."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, parts, size = 8, [], (0, 0)
    while at < len(data):
        (length,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + length]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + length)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, depth, color, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, color) != (8, 2):
                raise ValueError("not 8-bit RGB")
            size = (height, width * 3)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + length
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(size[0], size[1] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Size, channel means and deviations, and a 64-bit average hash over an 8 x 8 grid."""
    pixels = samples.reshape(-1, 3).astype(np.int64)
    n = len(pixels)
    total, squares = pixels.sum(0), (pixels * pixels).sum(0)
    spread = [int(round((max(0, n * int(q) - int(s) ** 2)) ** 0.5 * 100 / n)) for s, q in zip(total, squares)]
    flat = samples.reshape(-1)
    cells = np.add.reduceat(flat.astype(np.int64), np.arange(64) * (len(flat) // 64))
    bits = int("".join("1" if c * 64 > int(cells.sum()) else "0" for c in cells.tolist()), 2)
    return f"64x{len(samples)};mean={','.join(str(int(s) * 100 // n) for s in total)};dev={','.join(map(str, spread))};ahash={bits:016x}"


# Interleaved sequences


class _Reader(HTMLParser):
    """Start tags, end tags and text of a page, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, str, dict]] = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("start", tag, dict(attrs)))

    def handle_startendtag(self, tag, attrs):
        self.events.append(("start", tag, dict(attrs)))
        if tag in HIDDEN or tag in ("figure", "figcaption"):
            self.events.append(("end", tag, {}))

    def handle_endtag(self, tag):
        self.events.append(("end", tag, {}))

    def handle_data(self, data):
        self.events.append(("text", data, {}))


BREAKS = frozenset("p div br li ul ol table tr td th h1 h2 h3 h4 h5 h6 article section nav figure figcaption header footer main aside".split())
HIDDEN = frozenset(("script", "style", "template", "noscript"))
MEDIA = frozenset(("img", "video", "audio", "source", "embed"))


def _closings(events: list[tuple[str, str, dict]], tags: frozenset, within: str | None = None) -> dict[int, int]:
    """Place of each start tag's own end tag, for those that have one.

    A caption must close before the figure that it opened in does.
    """
    found: dict[int, int] = {}
    waiting: dict[str, list[int]] = {t: [] for t in tags}
    for i, (kind, tag, _) in enumerate(events):
        if kind == "start" and tag in tags:
            waiting[tag].append(i)
        elif kind == "end" and tag in tags and waiting[tag]:
            found[waiting[tag].pop()] = i
        elif within and kind == "end" and tag == within:
            for open_ in waiting.values():
                open_.clear()
    return found


def _run(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def segments(source: str | None) -> list[dict]:
    """The ordered structs of a page."""
    reader = _Reader()
    reader.feed(source or "")
    reader.close()
    hidden = _closings(reader.events, HIDDEN)
    hidden = sorted(hidden.items())
    events, upto = [], -1
    for i, e in enumerate(reader.events):
        while hidden and hidden[0][0] < i:
            upto = max(upto, hidden.pop(0)[1])
        if hidden and hidden[0][0] == i:
            upto = max(upto, hidden.pop(0)[1])
        if i > upto:
            events.append(e)
    captions = _closings(events, frozenset(("figcaption",)), "figure")
    out: list[dict] = []
    text: list[str] = []
    figures: list[tuple[int, list[str]]] = []  # first segment, captions
    until, caption = -1, []

    def flush() -> None:
        run = _run(text)
        text.clear()
        if run:
            out.append({"position": len(out), "kind": "text", "text": run, "digest": None, "caption": None})

    def leave() -> None:
        first, found = figures.pop()
        for s in out[first:]:
            if s["kind"] == "media" and found:
                s["caption"] = " ".join(found)

    for i, (kind, tag, attrs) in enumerate(events):
        if kind == "text":
            (caption if i < until else text).append(tag)
            continue
        if i < until:
            caption.append(" " if tag in BREAKS else "")
        elif tag in BREAKS or tag in MEDIA:
            flush()
        if i == until:
            figures[-1][1].append(_run(caption))
            caption = []
        if kind == "start" and tag in MEDIA:
            out.append({"position": len(out), "kind": "media", "text": None, "digest": (attrs.get("src") or "").removeprefix("media:"), "caption": attrs.get("alt")})
        elif kind == "start" and tag == "figure":
            figures.append((len(out), []))
        elif kind == "start" and tag == "figcaption" and i in captions and figures and i >= until:
            until, caption = captions[i], []
        elif kind == "end" and tag == "figure" and figures:
            leave()
    flush()
    while figures:
        leave()
    return out


def interleave(pages: DataFrame, key: str, html_column: str) -> DataFrame:
    """(key, segments): the ordered structs of each row's HTML."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([segments(x) for x in batch.column(1).to_pylist()], item)], names=["key", "segments"])

    read = pages.select(F.col(key).alias("key"), F.col(html_column).cast("string").alias("html"))
    return read.mapInArrow(run, f"key {kind}, segments {SEGMENTS}").withColumnRenamed("key", key)


def references(sequences: DataFrame, key: str) -> DataFrame:
    """One row for each media reference: key, position, digest, caption."""
    return sequences.select(key, F.explode("segments").alias("s")).filter("s.kind = 'media'").select(key, "s.position", "s.digest", "s.caption")


_MEASURED = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for digest, media in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = media.as_py()
            samples = from_png(data)
            payload = samples.tobytes()
            rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)))
        kinds = [pa.string() if "string" in x else pa.int64() for x in _MEASURED.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=[x.split()[0] for x in _MEASURED.split(", ")])


def measure_store(store: DataFrame) -> DataFrame:
    """Features of every stored medium, read back from its bytes; one row for each digest."""
    return store.select("digest", "media").mapInArrow(_measure, _MEASURED).dropDuplicates(["digest"])


def resolve(refs: DataFrame, measured: DataFrame) -> DataFrame:
    """References with what the store has for their digest (nulls where it has nothing).

    The measured side is thin and lies in the shared folder, so both sides of the join are
    plain exchanges and a digest that very many documents share is split at run time.
    """
    return refs.join(materialize(measured, "measured"), "digest", "left")


_STORED = "doc_id long, html string, digest string, media binary"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_pylist()
        texts = batch.column(1)
        for at in range(0, len(keys), 512):  # small batches: the payloads double here
            rows = []
            for k, text in zip(keys[at : at + 512], texts.slice(at, 512)):
                data = (text.as_py() or "").encode()
                payload = pad(data)
                digest = hashlib.sha256(payload).hexdigest()
                page = f'<article><p>document {html.escape(str(k))}</p><figure><img src="media:{digest}" alt=""><figcaption>{len(data)} bytes</figcaption></figure></article>'
                rows.append((k, page, digest, to_png(payload)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.binary()))], names=["doc_id", "html", "digest", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """Every text as an image and a page that refers to it, written to the shared folder."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return materialize(rows.mapInArrow(_store, _STORED), "media", codec="none")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_texts(documents(spark, sf_dir))
    refs = references(interleave(stored, "doc_id", "html"), "doc_id")
    resolved = resolve(refs, measure_store(stored))
    n_bytes = F.regexp_extract("caption", "^([0-9]+) bytes$", 1).cast("long")
    return resolved.select("doc_id", n_bytes.alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "digest")
