"""What follows a window: labels from the next h bars, strictly after its last one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A

HORIZONS = (1, 3, 5, 10, 20, 40, 60, 80)
BARRIERS = (0.005, 0.01, 0.02)


def _first(fut: Column, test) -> Column:
    """Place from 1 of the first bar that passes, 0 for none."""
    return F.array_position(F.transform(fut, test), F.lit(True))


def barrier(fut: Column, anchor: Column, up: float, down: float) -> Column:
    a, b = _first(fut, lambda x: x["high"] >= anchor * (1 + up)), _first(fut, lambda x: x["low"] <= anchor * (1 - down))
    return F.when((a == 0) & (b == 0), "NEITHER").when(b == 0, "UP_FIRST").when(a == 0, "DOWN_FIRST").when(a == b, "SAME_BAR_BOTH").when(a < b, "UP_FIRST").otherwise("DOWN_FIRST")


def direction(r: Column, flat: float = 1e-6) -> Column:
    return F.when(r.isNull(), "UNAVAILABLE").when(r > flat, "POSITIVE").when(r < -flat, "NEGATIVE").otherwise("FLAT")


def continuation(source: Column, r: Column) -> Column:
    return (
        F.when(source.isNull() | (F.abs(source) < 1e-6), "SOURCE_DIRECTION_UNAVAILABLE").when(r.isNull(), "UNAVAILABLE").when(F.abs(r) <= 1e-12, "SIDEWAYS")
        .when(F.signum(source) == F.signum(r), "CONTINUATION").otherwise("REVERSAL")
    )


def outcomes(windows: DataFrame, horizons: tuple[int, ...] = (5,)) -> DataFrame:
    """A row for each window and horizon. windows: sliding_windows(..., horizon=max(horizons)). Windows without a bar behind them have NO_FUTURE_BARS."""
    df = windows.withColumn("horizon", F.explode(F.array(*map(F.lit, sorted(set(horizons))))))
    df = df.withColumn("fut", F.slice("future", 1, F.col("horizon"))).withColumn("anchor", A.last(F.col("bars"))["close"])
    fut, anchor = F.col("fut"), F.col("anchor")
    df = df.withColumn("closes", F.transform("fut", lambda x: x["close"])).withColumn("available", F.size("fut"))
    df = df.withColumn("path", F.concat(F.array(F.lit(0.0)), F.transform("closes", lambda c: F.ln(c / F.col("anchor")))))
    some = F.col("available") > 0
    high, low = F.array_max(F.transform(fut, lambda x: x["high"])), F.array_min(F.transform(fut, lambda x: x["low"]))
    steps = A.diff(F.col("path"))
    r = F.when(some, A.last(F.col("closes")) / anchor - 1)
    travelled = A.total(F.transform(steps, lambda x: F.abs(x)))
    relative = F.transform("closes", lambda c: F.ln(c))
    hits = [barrier(fut, anchor, b, b) for b in BARRIERS]
    source = A.last(F.col("bars"))["close"] / F.get("bars", F.lit(0))["close"] - 1
    first_hit = F.coalesce(*(F.when(h != "NEITHER", h) for h in hits), F.lit("NEITHER"))
    return df.select(
        "window_id", "instrument", "timeframe", "length", "end_ts", "horizon", "available", (F.col("available") >= F.col("horizon")).alias("is_complete"),
        F.when(F.col("available") == 0, "NO_FUTURE_BARS").when(F.col("available") < F.col("horizon"), "PARTIAL_HORIZON").otherwise("NONE").alias("flag"),
        "anchor", r.alias("simple_return"), F.when(some, A.last(F.col("path"))).alias("log_return"),
        (high / anchor - 1).alias("mfe"), (low / anchor - 1).alias("mae"),
        F.when(some, _first(fut, lambda x: x["high"] == high)).alias("mfe_bar"), F.when(some, _first(fut, lambda x: x["low"] == low)).alias("mae_bar"),
        F.when(F.col("available") > 1, A.spread(steps, 1)).alias("realized_volatility"),
        F.when(some & (travelled > 1e-12), F.abs(A.last(F.col("path"))) / travelled).alias("path_efficiency"),
        F.when(some, -F.expm1(-A.drawdown(relative))).alias("max_drawdown"), F.when(some, F.expm1(A.runup(relative))).alias("max_runup"),
        direction(r).alias("direction_class"), source.alias("source_return"), continuation(source, r).alias("continuation"),
        *(F.when(some, h).otherwise("UNAVAILABLE").alias(f"barrier_{b * 1000:g}".replace(".", "_")) for h, b in zip(hits, BARRIERS)),
        F.when(some, first_hit).otherwise("UNAVAILABLE").alias("first_barrier"),
        F.when(some, F.when(hits[1] == "UP_FIRST", "GAIN_FIRST").when(hits[1] == "DOWN_FIRST", "GAIN_AFTER_DRAWDOWN_UNKNOWN").otherwise(hits[1])).otherwise("UNAVAILABLE").alias("gain_sequence"),
        F.when(some, F.when(hits[1] == "UP_FIRST", "DRAWDOWN_AFTER_GAIN_UNKNOWN").when(hits[1] == "DOWN_FIRST", "DRAWDOWN_FIRST").otherwise(hits[1])).otherwise("UNAVAILABLE").alias("drawdown_sequence"),
        "path",
    )


def supersede(observations: DataFrame) -> DataFrame:
    """The complete row of each window and horizon where there is one, else the one with most bars."""
    from pyspark.sql.window import Window

    best = F.row_number().over(Window.partitionBy("window_id", "horizon").orderBy(F.desc("is_complete"), F.desc("available")))
    return observations.withColumn("_n", best).where("_n = 1").drop("_n")
