from pyspark.sql import functions as F

from tidemark.sources import bars as B
from tidemark.streaming import bars as S

SF = "/root/testdata/sf0.001"


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    ticks = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts")
    ticks.write.parquet(str(tmp_path / "ticks"))
    live = S.stream_bars(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks")), "event_type", "ts", "value", "event_id")
    S.append_stream(live, str(tmp_path / "bars"), ["instrument", "ts"], str(tmp_path / "check")).start().awaitTermination(120)
    got = {(r.instrument, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in spark.read.parquet(str(tmp_path / "bars")).collect()}
    batch = {(r.instrument, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in B.event_bars(spark, SF).select("*", F.col("ts").cast("timestamp").alias("t")).drop("ts").withColumnRenamed("t", "ts").collect()}
    assert got and all(batch[k] == v for k, v in got.items())
    assert len(batch) - len(got) <= 10  # the last bars wait for the watermark


def test_rolling_windows_keep_order(spark, tmp_path):
    bars = B.event_bars(spark, SF).select("instrument", F.col("ts").cast("timestamp").alias("ts"), "close")
    bars.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "bars"))
    live = S.rolling_windows(spark.readStream.schema(bars.schema).parquet(str(tmp_path / "bars")), 8)
    query = live.writeStream.format("memory").queryName("rolling").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "check")).start()
    query.awaitTermination(120)
    got = spark.table("rolling")
    n = bars.groupBy("instrument").count().collect()
    assert got.count() == sum(max(0, r["count"] - 7) for r in n)
    assert got.where(F.size("closes") != 8).count() == 0
