"""Streaming operators against their batch forms."""

import datetime as dt

from pyspark.sql import functions as F

from quern.operators.ingest import version_history
from quern.streaming import versions, windows

T0 = dt.datetime(2024, 1, 1)


def stream_of(spark, tmp_path, batches, schema):
    path = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_versions_equal_batch(spark, tmp_path):
    schema = "item string, content string, at timestamp"
    rows = [(f"i{k % 3}", f"c{(k * k) % 5}", T0 + dt.timedelta(minutes=k)) for k in range(30)]
    stream = stream_of(spark, tmp_path, [rows[:12], rows[12:20], rows[20:]], schema)
    # one trigger per file; files may come in any order within a run, so the stream is checked per item order
    got = sorted((r.item, r.at, r.content, r.version, r.status) for r in drain(versions.versioned(stream, "item", "content", "at"), "versions", "append").collect())
    batch = version_history(spark.createDataFrame(rows, schema).withColumn("tie", F.lit(0)), "item", "content", "at", "tie")
    want = sorted((r.item, r.at, r.content, r.version, r.status) for r in batch.collect())
    assert got == want


def test_windows_drop_late_rows(spark, tmp_path):
    schema = "k string, at timestamp, v double"
    first = [("a", T0 + dt.timedelta(minutes=m), 1.0) for m in (0, 1, 2, 60)]
    late = [("a", T0 + dt.timedelta(minutes=3), 5.0), ("a", T0 + dt.timedelta(minutes=200), 1.0)]
    # rows are judged by the watermark of the trigger before, so one passes between
    stream = stream_of(spark, tmp_path, [first, [("a", T0 + dt.timedelta(minutes=61), 1.0)], late, [("a", T0 + dt.timedelta(minutes=400), 1.0)]], schema)
    got = {r.start: (r.n, r.total) for r in drain(windows.windowed(stream, "at", "10 minutes", None, "5 minutes", ["k"], "v"), "windows", "append").collect()}
    assert got[T0] == (3, 3.0)


def test_deduplicated(spark, tmp_path):
    schema = "k string, at timestamp"
    stream = stream_of(spark, tmp_path, [[("a", T0), ("b", T0)], [("a", T0 + dt.timedelta(minutes=1))]], schema)
    assert sorted(r.k for r in drain(windows.deduplicated(stream, "at", "1 hour", ["k"]), "dedup", "append").collect()) == ["a", "b"]
