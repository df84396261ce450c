"""Helpers that the operators of this subpackage share: words, stable splits, shared tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the five ASCII controls from tab to carriage return.
SEPARATORS = " \t\n\x0b\f\r"
SEPARATOR_RUN = "[ \\t\\n\\x0B\\f\\r]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """Array of the maximal runs of non-separators of ``text`` (JVM only)."""
    return F.array_remove(F.split(text, SEPARATOR_RUN), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def id_crc32(column: str = "doc_id") -> Column:
    """crc32 of the id written as decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees: the cluster's ``spark.checkpoint.dir``, else one of our own.

    A local master without the setting (tests) uses a folder of this machine; a cluster without
    it is an error, as nothing else is known to be seen by all executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return "file:///tmp/checkpoints"
    raise ValueError("spark.checkpoint.dir must name a folder that all executors see")


def application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/varloom/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, tag: str, codec: str = "snappy", outside: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, gives the planner real sizes,
    and makes sure that branches reusing ``df`` see the same rows. ``outside``: the table
    outlives the innermost ``scope``.
    """
    spark = df.sparkSession
    path = f"{application_dir(spark)}/{_SCOPE[-2 if outside and len(_SCOPE) > 1 else -1]}{uuid.uuid4().hex}/{tag}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Sub-folders that tables written by now belong to, the innermost last.
_SCOPE = [""]


@contextmanager
def scope(spark: SparkSession):
    """Tables that are written inside lie in a folder of their own, deleted at the end.

    For work whose result has been written elsewhere by then.
    """
    name = f"{_SCOPE[-1]}{uuid.uuid4().hex}/"
    _SCOPE.append(name)
    try:
        yield
    finally:
        _SCOPE.pop()
        _delete(spark, f"{application_dir(spark)}/{name}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Fewer rows in an Arrow batch, where the session has the default: texts are long, workers hold less."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) == 10_000:
        spark.conf.set(name, str(rows))


def planned_bytes(df: DataFrame) -> int:
    """The planner's size of ``df``, from file sizes and without a scan; else the texts' bytes."""
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:  # no planner to ask in this kind of session
        size = 0
    return size if 0 < size < 1 << 55 else text_bytes(df)


def release(spark: SparkSession) -> None:
    """Delete this application's shared tables; results that still read them must be written by then."""
    _delete(spark, application_dir(spark))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Total UTF-8 bytes of a text column: one scan, one number to the driver."""
    return int(docs.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0)


def running(array: str, op: Callable[[str, str], str] = "({} + {})".format, block: int = 256) -> str:
    """SQL for the running totals of an int array: 0, then the total of the first, first two, ...

    Blocks are folded one by one and then shifted by the blocks before them, so the time is
    linear in the array, which a single fold that appends to its result would not be.
    """
    inner = f"transform(sequence(0, cast(greatest(size(rv) - 1, 0) div {block} as int)), rc -> aggregate(slice(rv, rc * {block} + 1, {block}), array(0), (ra, rx) -> concat(ra, array({op('element_at(ra, -1)', 'rx')}))))"
    before = f"aggregate(ri, array(0), (ra, rr) -> concat(ra, array({op('element_at(ra, -1)', 'element_at(rr, -1)')})))"
    shifted = f"concat(array(0), flatten(transform(ri, (rr, rk) -> transform(slice(rr, 2, size(rr)), ry -> {op('ry', 'rs[rk]')}))))"
    return f"transform(array({array}), rv -> transform(array({inner}), ri -> transform(array({before}), rs -> {shifted})[0])[0])[0]"


def trim() -> None:
    """Give freed memory back to the system, where its C library can: workers live on between tasks."""
    import ctypes

    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def slices(batch, column: str, limit: int):
    """Cut an Arrow batch into runs of rows whose ``column`` holds about ``limit`` bytes.

    Once they are worked off, the worker's freed memory is given back.
    """
    import numpy as np
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size.astype(np.int64)) // max(1, limit)
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    trim()
