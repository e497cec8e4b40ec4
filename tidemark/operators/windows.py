"""Sliding windows over sorted bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written

LENGTHS = (8, 16, 32, 64, 128, 256)
BAR = ("ts", "open", "high", "low", "close", "volume")
SERIES = ("instrument", "timeframe")


def expected_windows(n: int, length: int, stride: int = 1) -> int:
    return (n - length) // stride + 1 if n >= length else 0


def number_bars(bars: DataFrame) -> DataFrame:
    """bars with bar_no, from 1 in each series, without a task that holds a series: a range sort, and the sizes of its parts summed."""
    df = bars.repartitionByRange(*SERIES, "ts").sortWithinPartitions(*SERIES, "ts").withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    df = written(df, "bars")  # numbers and sizes must come from the same parts
    sizes = df.groupBy(*SERIES, "_p").agg(F.count("*").alias("_c"), F.min("_m").alias("_first"))
    before = F.sum("_c").over(Window.partitionBy(*SERIES).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    at = sizes.withColumn("_base", F.coalesce(before, F.lit(0))).drop("_c")
    return df.join(at, [*SERIES, "_p"]).withColumn("bar_no", F.col("_base") + F.col("_m") - F.col("_first") + 1).drop("_p", "_m", "_base", "_first")


def spread_series(bars: DataFrame, chunk: int, before: int, after: int) -> DataFrame:
    """Deals each series over tasks: chunks of `chunk` bars, each with the bars that its frames reach before and after it as guests.

    With few series and very many bars a window over a series is one task; over (series, chunk) it is many, for
    (before + after) / chunk more rows. Columns added: bar_no, chunk, own (false for guests).
    """
    n = F.col("bar_no") - 1
    first = F.floor(F.greatest(n - after, F.lit(0)) / chunk)
    final = F.floor((n + before) / chunk)
    df = number_bars(bars).withColumn("chunk", F.explode(F.sequence(first, final)))
    return df.withColumn("own", F.col("chunk") == F.floor(n / chunk))


def _gap(seconds: Column, keys: tuple[str, ...]) -> Column:
    w = Window.partitionBy(*keys).orderBy("ts")
    step = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    return F.greatest(F.floor(step / (F.lit(1_000_000).cast("long") * seconds)) - 1, F.lit(0).cast("long"))


def sliding_windows(bars: DataFrame, lengths: tuple[int, ...] = (16,), stride: int = 1, horizon: int = 0, calendar: str = "continuous", seconds: int = 14400, gap_ratio: float = 0.0, chunk: int | None = 4096) -> DataFrame:
    """Every window of the given lengths, with its bars as an array, and with horizon the bars behind it as `future`.

    One sort serves all lengths: a frame of the longest is cut to each shorter one. A window sees its own bars only. Flags:
    UNKNOWN_CALENDAR, NULL_VOLUME, ZERO_VOLUME, INVALID_OHLC, and on a continuous calendar MISSING_BARS and EXTREME_GAP; NONE
    without any. The source hash depends on the window's bars alone. chunk: the bars of a series that one task takes (see
    spread_series), so that a long series is many tasks; None makes a series one task.
    """
    lengths = tuple(sorted(set(lengths)))
    keys = (*SERIES, "chunk") if chunk else SERIES
    w = Window.partitionBy(*keys).orderBy("ts")
    bar = F.struct(*BAR, F.col("_gap").alias("gap"))
    df = spread_series(bars, chunk, lengths[-1], horizon) if chunk else bars.withColumn("bar_no", F.row_number().over(w)).withColumn("own", F.lit(True))
    df = df.withColumn("_gap", _gap(F.lit(seconds), keys))
    df = df.withColumn("_bars", F.collect_list(bar).over(w.rowsBetween(-(lengths[-1] - 1), 0)))
    if horizon:
        df = df.withColumn("future", F.collect_list(F.struct(*BAR)).over(w.rowsBetween(1, horizon)))
    df = df.where("own").withColumn("length", F.explode(F.array(*map(F.lit, lengths)))).where("bar_no >= length").where((F.col("bar_no") - F.col("length")) % stride == 0)
    df = df.withColumn("bars", F.slice("_bars", -F.col("length"), F.col("length")))
    b = F.col("bars")
    any_bar = lambda test: F.exists(b, test)
    missing = F.aggregate(F.slice(b, 2, F.col("length") - 1), F.lit(0).cast("long"), lambda s, x: s + x["gap"]) if calendar == "continuous" else F.lit(0).cast("long")
    df = df.withColumn("missing_bars", missing)
    flags = F.array_sort(F.array_compact(F.array(
        F.when(F.lit(calendar == "unknown"), "UNKNOWN_CALENDAR"), F.when(any_bar(lambda x: x["volume"].isNull()), "NULL_VOLUME"), F.when(any_bar(lambda x: x["volume"] == 0), "ZERO_VOLUME"),
        F.when(any_bar(lambda x: (x["high"] < F.greatest(x["open"], x["close"], x["low"])) | (x["low"] > F.least(x["open"], x["close"], x["high"]))), "INVALID_OHLC"),
        F.when(F.col("missing_bars") > 0, "MISSING_BARS"), F.when(F.col("missing_bars") / F.col("length") > gap_ratio, "EXTREME_GAP"),
    )))
    text = F.concat_ws("|", F.transform(b, lambda x: F.concat_ws(",", F.unix_micros(x["ts"].cast("timestamp")).cast("string"), *(F.coalesce(x[c].cast("string"), F.lit("")) for c in BAR[1:]))))
    return df.select(
        *SERIES, "length", at_first("bars", "ts").alias("start_ts"), F.col("ts").alias("end_ts"), "bar_no", "bars", *(["future"] if horizon else []), "missing_bars",
        F.when(F.size(flags) > 0, flags).otherwise(F.array(F.lit("NONE"))).alias("quality_flags"), F.sha2(text, 256).alias("source_hash"),
    ).withColumn("window_id", F.sha2(F.concat_ws("|", *SERIES, F.col("length").cast("string"), F.col("end_ts").cast("string"), F.lit(calendar), "source_hash"), 256))


def at_first(bars: str, field: str) -> Column:
    return F.get(F.col(bars), F.lit(0))[field]


def strict(windows: DataFrame) -> DataFrame:
    """Without windows that miss bars."""
    return windows.where(~F.arrays_overlap("quality_flags", F.array(F.lit("MISSING_BARS"), F.lit("EXTREME_GAP"))))


def new_windows(windows: DataFrame, stored: DataFrame) -> DataFrame:
    """Windows not stored yet: the same build again gives none, and later bars never change stored ones."""
    return windows.join(stored.select("window_id"), "window_id", "left_anti")


def horizon_alignment(spark, lengths: list[int], horizons: list[int]) -> DataFrame:
    """Each pair of length and horizon, their ratio and the nearest standard ratio (the first on ties)."""
    a = spark.createDataFrame([(x,) for x in lengths], "length int")
    b = spark.createDataFrame([(x,) for x in horizons], "horizon int")
    r = F.col("horizon") / F.col("length")
    near = F.array_min(F.array(*(F.struct(F.abs(r - x).alias("d"), F.lit(k).alias("k"), F.lit(x).alias("ratio")) for k, x in enumerate((0.125, 0.25, 0.5, 1.0, 2.0)))))["ratio"]
    # Two configuration lists of a few values each.
    return a.crossJoin(F.broadcast(b)).select("length", "horizon", r.alias("ratio"), near.alias("nearest_ratio"))
