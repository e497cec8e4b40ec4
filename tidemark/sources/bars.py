"""Bars: from event tables, from CSV text, and the registries around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Standard timeframes and their seconds; a calendar month has none. Fixed values.
TIMEFRAMES = {"M1": 60, "M5": 300, "M15": 900, "M30": 1800, "H1": 3600, "H4": 14400, "D1": 86400, "W1": 604800, "MN1": None}
REQUIRED = ("timestamp", "open", "high", "low", "close", "volume")
PRICES = ("open", "high", "low", "close")


def to_bars(ticks: DataFrame, instrument: str, ts: str, price: str, order: list[str], timeframe: str) -> DataFrame:
    """One bar for each instrument and time bucket that has ticks; first and last by (ts, order). One shuffle, with map-side combine."""
    seconds = TIMEFRAMES[timeframe]
    bucket = F.window(F.col(ts), f"{seconds} seconds").start
    at = F.struct(F.col(ts), *order)
    return (
        ticks.groupBy(F.col(instrument).alias("instrument"), bucket.alias("ts"))
        .agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").cast("double").alias("volume"))
        .select("instrument", F.lit(timeframe).alias("timeframe"), F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")
    )


def event_bars(spark: SparkSession, sf_dir: str, timeframe: str = "H4") -> DataFrame:
    return to_bars(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "value", ["event_id"], timeframe)


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_bars(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority", "o_orderdate", "o_totalprice", ["o_orderkey"], "D1")


def timeframe_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TIMEFRAMES.items()), "code string, seconds int")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with the rows' order. The order follows the files' names and offsets, so it needs no shuffle."""
    return spark.read.option("header", True).csv(path).withColumn("row_no", F.monotonically_increasing_id())


def parse_rows(raw: DataFrame) -> DataFrame:
    """Typed columns; what does not parse is null."""
    number = lambda c: F.expr(f"try_cast({c} AS double)")
    return raw.select("*", F.expr("try_to_timestamp(CAST(timestamp AS string))").alias("ts"), *(number(c).alias(f"{c}_value") for c in (*PRICES, "volume")))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def validate_rows(rows: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Row errors in the order in which they are tested; `accepted` where there are none.

    rows: row_no, ts, open_value .. volume_value. key: columns of a series (none: the rows are one series). A duplicate is any
    row whose time was seen before in row order; out of order is a time before that of the previous row with a time, unless it
    is a duplicate. Prices are judged only in rows without these errors.
    """
    part = key or [F.lit(1)]
    in_order = Window.partitionBy(*part).orderBy("row_no")
    seen = F.row_number().over(Window.partitionBy(*part, "ts").orderBy("row_no"))
    before = F.last("ts", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    o, h, low, c, v = (F.col(f"{x}_value") for x in (*PRICES, "volume"))
    when = lambda cond, code: F.when(cond, F.lit(code))
    df = rows.withColumn("_seen", seen).withColumn("_before", before)
    duplicate = F.col("ts").isNotNull() & (F.col("_seen") > 1)
    first = F.array_compact(F.array(
        when(F.col("ts").isNull(), "INVALID_TIMESTAMP"), when(duplicate, "DUPLICATE_TIMESTAMP"), when(~duplicate & (F.col("ts") < F.col("_before")), "OUT_OF_ORDER"),
        *(when(~_finite(x), f"NON_FINITE_{n.upper()}") for n, x in zip((*PRICES, "volume"), (o, h, low, c, v))),
    ))
    second = F.array_compact(F.array(
        when(F.least(o, h, low, c) <= 0, "NON_POSITIVE_PRICE"), when(v < 0, "NEGATIVE_VOLUME"),
        when(h < F.greatest(o, c, low), "HIGH_BELOW_PRICES"), when(low > F.least(o, c, h), "LOW_ABOVE_PRICES"),
    ))
    df = df.withColumn("_first", first).withColumn("errors", F.when(F.size("_first") > 0, F.col("_first")).otherwise(second))
    return df.withColumn("accepted", F.size("errors") == 0).drop("_seen", "_before", "_first")


def import_status(rows: DataFrame) -> DataFrame:
    """Counts and the status of an import, from validate_rows."""
    n = rows.agg(F.count("*").alias("total"), F.count_if("accepted").alias("accepted_rows"))
    bad = F.col("total") - F.col("accepted_rows")
    status = F.when(F.col("accepted_rows") == 0, "failed").when(bad > 0, "completed_with_errors").otherwise("completed")
    return n.select("*", bad.alias("rejected_rows"), status.alias("status"))


def append_new(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new whose key is not stored yet: run again it gives nothing."""
    return new.join(existing.select(*key), key, "left_anti")


def flag_duplicates(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows with the flag of those that come again."""
    again = new.select(*key).distinct().withColumn("_again", F.lit(True))
    flag = F.when(F.col("_again"), F.array_union("quality_flags", F.array(F.lit("duplicate_on_import")))).otherwise(F.col("quality_flags"))
    return existing.join(again, key, "left").withColumn("quality_flags", flag).drop("_again")


def repair(rows: DataFrame) -> DataFrame:
    """A provider's bars in canonical form: high and low enclose all prices, missing volume is 0."""
    return rows.withColumn("high", F.greatest(*PRICES)).withColumn("low", F.least(*PRICES)).withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def keep_last_of_day(bars: DataFrame) -> DataFrame:
    day = F.to_date("ts")
    last = F.row_number().over(Window.partitionBy("instrument", day).orderBy(F.desc("ts")))
    return bars.withColumn("day", day).withColumn("_n", last).where("_n = 1").drop("_n")


def compare_providers(a: DataFrame, b: DataFrame, review_below: float = 0.85) -> DataFrame:
    """By instrument: days of either side, return correlation, absolute price difference, scale; REVIEW_REQUIRED if the returns don't agree."""
    left = keep_last_of_day(a).select("instrument", "day", F.col("close").alias("close_a"))
    right = keep_last_of_day(b).select("instrument", "day", F.col("close").alias("close_b"))
    both = left.join(right, ["instrument", "day"], "full_outer")
    w = Window.partitionBy("instrument").orderBy("day")
    back = lambda c: F.lag(c).over(w)
    common = both.where("close_a IS NOT NULL AND close_b IS NOT NULL")
    common = common.withColumn("r_a", F.try_divide(F.col("close_a"), back("close_a")) - 1).withColumn("r_b", F.try_divide(F.col("close_b"), back("close_b")) - 1)
    seen = both.groupBy("instrument").agg(F.count_if(F.col("close_b").isNull()).alias("only_a"), F.count_if(F.col("close_a").isNull()).alias("only_b"))
    diff = F.abs(F.col("close_a") - F.col("close_b"))
    stats = common.groupBy("instrument").agg(
        F.count("*").alias("common_days"), F.corr("r_a", "r_b").alias("return_correlation"), F.percentile(diff, F.lit(0.5)).alias("median_abs_diff"),
        F.percentile(diff, F.lit(0.95)).alias("p95_abs_diff"), F.percentile(F.try_divide(F.col("close_a"), F.col("close_b")), F.lit(0.5)).alias("scale_ratio"),
    )
    verdict = F.when(F.coalesce("return_correlation", F.lit(0.0)) < review_below, "REVIEW_REQUIRED").otherwise("OK")
    return seen.join(stats, "instrument", "left").withColumn("verdict", verdict)


def profile(bars: DataFrame) -> DataFrame:
    """Data-quality counters of each series, one pass over sorted bars."""
    w = Window.partitionBy("instrument", "timeframe").orderBy("ts")
    change = F.abs(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    delta = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 1_000_000
    df = bars.withColumn("change", change).withColumn("delta", delta)
    modes = df.where("delta IS NOT NULL").groupBy("instrument", "timeframe", "delta").count()
    modal = modes.groupBy("instrument", "timeframe").agg(F.min_by("delta", F.struct(-F.col("count"), F.col("delta"))).alias("modal_delta"))
    df = df.join(modal, ["instrument", "timeframe"], "left")
    bad = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    return df.groupBy("instrument", "timeframe").agg(
        F.count("*").alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.first("modal_delta").alias("modal_delta"),
        F.count_if(bad).alias("invalid_ohlc"), F.count_if(F.least(*PRICES) <= 0).alias("non_positive"),
        F.avg((F.coalesce("volume", F.lit(0.0)) == 0).cast("double")).alias("empty_volume_rate"),
        *(F.count_if(F.col("change") > t).alias(f"moves_over_{int(t * 100)}") for t in (0.20, 0.45, 0.60)),
        F.count_if(F.col("delta") > 3 * F.col("modal_delta")).alias("large_gaps"), F.count_if(F.col("delta") > F.col("modal_delta")).alias("gaps"),
    )


def decide(profiled: DataFrame) -> DataFrame:
    """ACCEPTED, ACCEPTED_WITH_WARNINGS, MANUAL_REVIEW or REJECTED from the counters."""
    hard = F.col("invalid_ohlc") + F.col("non_positive")
    warned = (F.col("empty_volume_rate") > 0) | (F.col("moves_over_20") > 0) | (F.col("large_gaps") > 0)
    decision = F.when((hard > 0) & (F.col("bars") <= hard), "REJECTED").when(hard > 0, "MANUAL_REVIEW").when(warned, "ACCEPTED_WITH_WARNINGS").otherwise("ACCEPTED")
    return profiled.withColumn("hard_errors", hard).withColumn("decision", decision)
