"""Live bars: ticks to bars with a watermark, and rolling windows with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def stream_bars(ticks: DataFrame, instrument: str, ts: str, price: str, order: str, length: str = "4 hours", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Bars of a tick stream; a bar is given once the watermark has passed its end, later ticks are dropped."""
    at = F.struct(F.col("_ts"), F.col(order))
    df = ticks.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    got = df.groupBy(F.window("_ts", length, slide), F.col(instrument).alias("instrument")).agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").cast("double").alias("volume"))
    return got.select("instrument", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def session_bars(ticks: DataFrame, instrument: str, ts: str, price: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    df = ticks.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    got = df.groupBy(F.session_window("_ts", gap), F.col(instrument).alias("instrument")).agg(F.max(price).alias("high"), F.min(price).alias("low"), F.count("*").cast("double").alias("volume"))
    return got.select("instrument", F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), "high", "low", "volume")


def rolling_windows(bars: DataFrame, length: int) -> DataFrame:
    """For each new bar of a stream of bars in order: the closes of the last `length` bars of its instrument, once there are so many. The state is that many bars a key."""

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        out = []
        for part in parts:
            for ts, close in part.sort_values("ts")[["ts", "close"]].itertuples(index=False):
                held = [*held[-(length - 1) :], (ts, float(close))] if length > 1 else [(ts, float(close))]
                if len(held) == length:
                    out.append((key[0], held[0][0], ts, [c for _, c in held]))
        state.update(([t for t, _ in held], [c for _, c in held]))
        yield pd.DataFrame(out, columns=["instrument", "start_ts", "end_ts", "closes"])

    return bars.groupBy("instrument").applyInPandasWithState(step, "instrument string, start_ts timestamp, end_ts timestamp, closes array<double>", "ts array<timestamp>, closes array<double>", "append", "NoTimeout")


def append_stream(df: DataFrame, path: str, key: list[str], checkpoint: str):
    """A stream into Parquet in which each key stands once, however often a batch is run again.

    checkpoint: a folder that outlives the run, so that a restarted stream goes on where it stopped.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(key)
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            new = new.join(spark.read.parquet(path).select(*key), key, "left_anti")
        new.write.mode("append").parquet(path)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
