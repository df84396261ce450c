"""Position windows: bins, runs of flagged positions, anchored chunks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bins(df: DataFrame, keys: list[str], pos: str, size: int, aggregates: list[Column]) -> DataFrame:
    return df.groupBy(*keys, F.floor(F.col(pos) / size).cast("long").alias("bin")).agg(*aggregates)


def runs(df: DataFrame, keys: list[str], pos: str, gap: int = 1, aggregates: list[Column] | None = None) -> DataFrame:
    """Maximal runs of positions at most ``gap`` apart: keys, start, end, n and the aggregates."""
    order = Window.partitionBy(*keys).orderBy(pos)
    opens = F.when(F.col(pos) - F.lag(pos).over(order) <= gap, 0).otherwise(1)
    rows = df.withColumn("__opens", opens).withColumn("__run", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "__run").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count(F.lit(1)).alias("n"), *(aggregates or [])).drop("__run")


def runs_tiled(df: DataFrame, keys: list[str], pos: str, tile: int, gap: int = 1, aggregates: dict[str, Callable] | None = None) -> DataFrame:
    """``runs`` for contigs of any length: runs of each tile, then of the runs.

    ``aggregates``: columns to carry, each with a function (min, max or sum) for both steps.
    """
    from .intervals import merge

    folded = [f(c).alias(c) for c, f in (aggregates or {}).items()]
    parts = runs(df.withColumn("__tile", F.floor(F.col(pos) / tile)), [*keys, "__tile"], pos, gap, folded)
    whole = merge(parts.withColumnRenamed("n", "__n"), keys, gap=gap, extra=[F.sum("__n").alias("members"), *folded])
    return whole.drop("n").withColumnRenamed("members", "n")


def chunks(df: DataFrame, keys: list[str], near: int = 1000, far: int = 2000, gap: int = 500, close: int = 300) -> DataFrame:
    """Work chunks, each anchored at its first region.

    A region joins while it starts within ``near`` of the anchor, up to ``far`` if it is less
    than ``gap`` from the region before, and beyond if less than ``close``. Adds ``chunk``.
    The anchor makes this a fold in order. Where a region begins past every rule's reach from all
    before it, a chunk begins for certain; so the fold runs over the stretch between two such
    places only, not over a contig.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) + max(near, gap, close)
    opens = F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))
    rows = df.withColumn("__opens", opens).withColumn("__stretch", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "end"], kind="stable")
        chunk, anchor, last, numbers = 0, 0, 0, []
        for start, end in zip(pdf["start"].tolist(), pdf["end"].tolist()):
            if not (chunk and (start < anchor + near or (start < anchor + far and start - last < gap) or start - last < close)):
                chunk, anchor = chunk + 1, start
            last = end
            numbers.append(chunk)
        return pdf.assign(__chunk=numbers)[[*keys, "__stretch", "start", "end", "__chunk"]]

    kinds = dict(rows.dtypes)
    named = [*keys, "__stretch", "start", "end"]
    parts = rows.select(*named).groupBy(*keys, "__stretch").applyInPandas(fold, ", ".join(f"`{c}` {kinds[c]}" for c in named) + ", `__chunk` int")
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("__stretch", "__chunk"))
    return parts.select(*keys, "start", "end", number.alias("chunk"))
