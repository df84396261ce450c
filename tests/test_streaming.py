"""Incremental ingest gives what a batch read gives."""

from varloom.sources import alignments as al
from varloom.streaming import ingest


def test_ingest(spark, tmp_path):
    rows = [(f"r{k}", 0, f"chr{k % 2}", 10 + k, 60 if k % 3 else 5, "10M", "A" * 10, 0, None, None) for k in range(12)]
    df = spark.createDataFrame(rows, al.SCHEMA)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    query = ingest.append_by_contig(ingest.arriving(spark, str(tmp_path / "in"), 1), str(tmp_path / "table"), str(tmp_path / "check"))
    query.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "table"))
    assert sorted(r.qname for r in got.collect()) == sorted(r[0] for r in rows if r[4] >= 20)
    assert got.select("batch").distinct().count() >= 2


def test_windowed_counts(spark, tmp_path):
    spark.sql("SELECT timestamp_seconds(id * 20) AS ts, id % 2 AS k FROM range(30)").write.parquet(str(tmp_path / "e"))
    stream = ingest.windowed_counts(spark.readStream.schema("ts timestamp, k long").parquet(str(tmp_path / "e")), "ts", ["k"], "1 minute", "1 minute")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.k, r.n) for r in spark.sql("SELECT k, n FROM counts").collect()} == {(0, 2), (0, 1), (1, 1), (1, 2)}
