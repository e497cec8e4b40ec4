"""Normalised price paths of windows, resampled to a fixed number of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A

POINTS = 64
FLOOR = 1e-12
METHODS = (
    "anchored_simple_return", "anchored_log_return", "zscore_close", "range_close", "range_close_centred", "volatility_targeted_return",
    "anchored_ohlc", "atr_anchored_ohlc", "volume_relative_mean",
)
OHLC = ("open", "high", "low", "close")


def channel(bars: Column, name: str) -> Column:
    return F.transform(bars, lambda x: x[name])


def true_ranges(bars: Column) -> Column:
    """high - low of the first bar, then the range that includes the previous close."""
    rest = F.zip_with(F.slice(bars, 2, F.greatest(F.size(bars) - 1, F.lit(0))), F.slice(bars, 1, F.greatest(F.size(bars) - 1, F.lit(0))), lambda x, p: F.greatest(x["high"] - x["low"], F.abs(x["high"] - p["close"]), F.abs(x["low"] - p["close"])))
    first = F.get(bars, F.lit(0))
    return F.concat(F.array(first["high"] - first["low"]), rest)


def _scaled(a: Column, centre: Column, scale: Column) -> Column:
    return F.transform(a, lambda x: (x - centre) / scale)


def values(method: str, bars: Column) -> tuple[dict[str, Column], Column]:
    """The channels of a method, and the code of what makes it impossible (null: nothing)."""
    c, v = channel(bars, "close"), channel(bars, "volume")
    c0 = F.get(c, F.lit(0))
    bad_price = F.when(F.exists(c, lambda x: x.isNull() | (x <= 0)), "NON_POSITIVE_CLOSE")
    bad_ohlc = F.when(F.exists(bars, lambda x: (x["high"] < F.greatest(x["open"], x["close"], x["low"])) | (x["low"] > F.least(x["open"], x["close"], x["high"]))), "INVALID_OHLC")
    short = F.when(F.size(bars) < 2, "TOO_FEW_BARS")
    if method == "anchored_simple_return":
        return {"close": F.transform(c, lambda x: x / c0 - 1)}, F.coalesce(short, bad_price)
    if method == "anchored_log_return":
        return {"close": F.transform(c, lambda x: F.ln(x / c0))}, F.coalesce(short, bad_price)
    if method == "zscore_close":
        s = A.spread(c)
        return {"close": _scaled(c, A.mean(c), s)}, F.coalesce(short, bad_price, F.when(s < FLOOR, "ZERO_VARIANCE"))
    if method in ("range_close", "range_close_centred"):
        width = F.array_max(c) - F.array_min(c)
        out = _scaled(c, F.array_min(c), width)
        return {"close": F.transform(out, lambda x: 2 * x - 1) if method.endswith("centred") else out}, F.coalesce(short, bad_price, F.when(width < FLOOR, "ZERO_RANGE"))
    if method == "volatility_targeted_return":
        logs = F.transform(c, lambda x: F.ln(x / c0))  # a running sum of steps telescopes
        s = A.spread(A.diff(logs))
        return {"close": F.transform(logs, lambda x: x / s)}, F.coalesce(F.when(F.size(bars) < 3, "TOO_FEW_BARS"), bad_price, F.when(s < FLOOR, "ZERO_VARIANCE"))
    if method == "anchored_ohlc":
        return {k: F.transform(channel(bars, k), lambda x: x / c0 - 1) for k in OHLC}, F.coalesce(short, bad_price, bad_ohlc)
    if method == "atr_anchored_ohlc":
        atr = A.mean(true_ranges(bars))
        return {k: _scaled(channel(bars, k), c0, atr) for k in OHLC}, F.coalesce(short, bad_price, bad_ohlc, F.when(atr < FLOOR, "ZERO_ATR"))
    if method == "volume_relative_mean":
        m = A.mean(v)
        return {"volume": F.transform(v, lambda x: x / m)}, F.coalesce(short, F.when(F.exists(v, lambda x: x.isNull()), "MISSING_VOLUME"), F.when(F.abs(m) == 0, "ZERO_VOLUME"))
    raise ValueError(f"unknown method {method!r}")


def normalize(windows: DataFrame, method: str = "anchored_log_return", points: int = POINTS, resampling: str = "linear") -> DataFrame:
    """windows with a column for each channel (`<channel>_path`), its numbers, and error_code; a window that fails has null paths."""
    channels, error = values(method, F.col("bars"))
    df = windows.withColumn("error_code", error)
    for name, raw in channels.items():
        # The raw path is a column of its own, or Catalyst would compute it anew for each point.
        df = df.withColumn(f"_{name}", F.when(F.col("error_code").isNull(), raw)).withColumn(f"{name}_path", A.resample(F.col(f"_{name}"), points, resampling))
    main = F.col(f"_{'close' if 'close' in channels else 'volume'}")
    stats = F.struct(F.array_min(main).alias("min"), F.array_max(main).alias("max"), A.mean(main).alias("mean"), A.spread(main).alias("std"), (F.array_max(main) - F.array_min(main)).alias("range"), A.last(main).alias("endpoint"))
    return df.withColumn("stats", F.when(main.isNotNull(), stats)).drop(*(f"_{k}" for k in channels))
