from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.sources import bars as B
from tidemark.streaming.bars import stream_bars, stream_cooldown

SF = "/root/testdata/sf0.001"


def test_stream_bars_equal_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet").select(
        F.col("event_type").alias("pair"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price")
    )
    ev.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = stream_bars(stream, "1 hour", "0 seconds", ["pair"]).writeStream.format("memory").queryName("bars_out").outputMode("append")
    q = q.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("bars_out")
    want = B.resample(ev, "1 hour", ["pair"], "ts", price="price")
    assert got.count() >= want.count() - 10  # the last windows wait for the watermark
    assert got.exceptAll(want).count() == 0


def test_stream_cooldown(spark, tmp_path):
    rows = spark.createDataFrame([("A", i, s) for i, s in enumerate([1, 1, 0, -1, 1, 0, 1])], "pair string, bar_no long, signal int")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream_cooldown(stream, 2).writeStream.format("memory").queryName("cool_out").outputMode("append")
    q = q.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [r["signal"] for r in spark.table("cool_out").orderBy("bar_no").collect()]
    assert got == [1, 0, 0, -1, 0, 0, 1]
