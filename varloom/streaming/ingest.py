"""Incremental ingest: new alignment rows as they arrive, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.alignments import SCHEMA, usable, with_ends


def arriving(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Alignment rows of new Parquet files in a folder, filtered as every scan is."""
    return with_ends(usable(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(folder)))


def append_by_contig(rows: DataFrame, table: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append each batch to a table by contig; a batch that is tried again replaces its own part."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("chrom").parquet(f"{table}/batch={number}")
        if then:
            then(batch, number)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts for each key and tumbling window; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")
