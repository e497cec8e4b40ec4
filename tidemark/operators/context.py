"""Rule-based context of a window from its features: eight dimensions, each a state and a confidence. All plain column expressions.

A missing feature counts as 0 in the arithmetic; where a rule needs to know, it tests for null. The resolution links need the
rows of all lengths together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the rules, weights of the composite confidence, lengths of the resolutions.
STRONG_SLOPE, WEAK_SLOPE, STRONG_FIT, STRONG_EFFICIENCY, LEAST_MOVE = 0.10, 0.03, 0.65, 0.60, 0.02
PERSISTENCE_BOUNDS = {"hurst_rs_v1": (0.45, 0.55), "ar_1_coefficient": (-0.10, 0.10), "lag_1_autocorrelation": (-0.10, 0.10), "variance_ratio_2": (0.90, 1.10), "variance_ratio_4": (0.90, 1.10)}
WEIGHTS = {"trend": 0.22, "volatility": 0.16, "volatility_phase": 0.10, "persistence": 0.14, "activity": 0.08, "shock": 0.12, "market_phase": 0.10, "multi_resolution": 0.08}
DIMENSIONS = tuple(WEIGHTS)
MIDDLE, MACRO = 64, 256


def _f(name: str, missing: float = 0.0) -> Column:
    return F.coalesce(F.col(name), F.lit(missing))


def _or(name: str, other: float) -> Column:
    """The value, or other where it is null or 0."""
    return F.coalesce(F.nullif(F.col(name), F.lit(0.0)), F.lit(other))


def _clip(c: Column, low: float = 0.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(1.0))


def _tails() -> Column:
    return F.greatest(F.abs(_f("upper_tail_ratio")), F.abs(_f("lower_tail_ratio")))


def _largest() -> Column:
    return F.greatest(F.abs(_f("maximum_positive_return")), F.abs(_f("maximum_negative_return")))


def trend() -> tuple[Column, Column]:
    slope, end = F.col("linear_regression_slope"), _f("normalized_endpoint_return")
    fit = (_f("linear_regression_r_squared") + _f("path_efficiency_ratio") + _f("trend_direction_consistency")) / 3
    rising, falling = _f("higher_high_count") + _f("higher_low_count"), _f("lower_high_count") + _f("lower_low_count")
    way = _clip(slope / STRONG_SLOPE, -1.0)
    shape = _clip((rising - falling) / F.greatest(rising + falling, F.lit(1.0)), -1.0)
    small = (F.abs(end) < LEAST_MOVE) | (_f("path_displacement") < LEAST_MOVE)
    conflicts = reduce(lambda a, b: a + b, (x.cast("int") for x in (small, shape * way < -0.2, _f("momentum_acceleration") * way < 0)))
    strong = (F.abs(slope) >= STRONG_SLOPE) & (_f("linear_regression_r_squared") >= STRONG_FIT) & (_f("path_efficiency_ratio") >= STRONG_EFFICIENCY)
    weak = (F.abs(slope) >= WEAK_SLOPE) & (fit >= 0.35) & (F.abs(end) >= LEAST_MOVE)
    named = lambda kind: F.when(slope > 0, f"{kind}_UPTREND").otherwise(f"{kind}_DOWNTREND")
    state = F.when(slope.isNull(), "UNCERTAIN").when(strong, named("STRONG")).when(weak, named("WEAK")).when((fit < 0.45) | (F.abs(slope) < WEAK_SLOPE), "RANGE").otherwise("UNCERTAIN")
    return state, F.when(slope.isNull(), 0.0).otherwise(_clip(_clip((F.abs(slope) / STRONG_SLOPE + fit) / 2) - 0.12 * conflicts))


def volatility() -> tuple[Column, Column]:
    realized = F.abs(F.coalesce(F.nullif(F.col("realized_volatility"), F.lit(0.0)), F.col("return_std"), F.lit(0.0)))
    atr = F.abs(_f("normalized_atr"))
    score = _clip(0.75 * _clip((realized / 0.035 + atr / 0.03) / 2) + 0.25 * _clip(_tails() / 4))
    state = F.when((realized >= 0.07) | (atr >= 0.07) | (score >= 0.9), "EXTREME").when(score >= 0.7, "HIGH").when(score <= 0.2, "VERY_LOW").when(score <= 0.4, "LOW").otherwise("NORMAL")
    return state, _clip(F.abs(score - 0.5) * 1.5 + 0.25)


def volatility_phase() -> tuple[Column, Column]:
    a, b = F.col("volatility_expansion_ratio"), F.col("range_expansion_ratio")
    missing, mean = a.isNull() | b.isNull(), (a + b) / 2
    agree = 1 - F.least(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)), F.lit(1.0))
    state = F.when(missing, "UNCERTAIN").when(mean <= 0.75, "COMPRESSING").when(mean >= 1.33, "EXPANDING").otherwise("STABLE")
    return state, F.when(missing, 0.0).otherwise(_clip(F.when(state == "STABLE", 0.45).otherwise(F.abs(mean - 1)) + 0.35 * agree))


def persistence() -> tuple[Column, Column]:
    votes = F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), F.when(F.col(n) >= hi, 1).when(F.col(n) <= lo, -1).otherwise(0)) for n, (lo, hi) in PERSISTENCE_BOUNDS.items())))
    mean = F.try_divide(F.aggregate(votes, F.lit(0), lambda s, x: s + x), F.size(votes))
    divided = F.exists(votes, lambda x: x > 0) & F.exists(votes, lambda x: x < 0)
    state = F.when(mean.isNull(), "UNCERTAIN").when(mean > 0.35, "PERSISTENT").when(mean < -0.35, "MEAN_REVERTING").otherwise("NEUTRAL")
    sure = F.when(state == "NEUTRAL", 0.55).otherwise(F.abs(mean)) - F.when(divided, 0.2).otherwise(0.0)
    return state, F.when(mean.isNull(), 0.0).otherwise(_clip(sure))


def activity() -> tuple[Column, Column]:
    needed = ("relative_volume_mean", "volume_coefficient_of_variation", "volume_expansion_ratio", "volume_trend_slope")
    missing = reduce(lambda a, b: a | b, (F.col(n).isNull() for n in needed))
    score = _clip((_or("relative_volume_mean", 1.0) - 0.5) / 1.5 * 0.35 + _clip(_or("volume_expansion_ratio", 1.0) / 2) * 0.35 + _clip(_f("volume_coefficient_of_variation")) * 0.2 + _clip(F.abs(_f("volume_trend_slope"))) * 0.1)
    state = F.when(missing, "UNAVAILABLE").when(score <= 0.3, "LOW").when(score >= 0.7, "ELEVATED").otherwise("NORMAL")
    return state, F.when(missing, 0.0).otherwise(_clip(F.abs(score - 0.5) + 0.45))


def shock() -> tuple[Column, Column]:
    z = _largest() / F.greatest(F.abs(_f("return_std")), F.lit(1e-12))
    share = _largest() / F.greatest(_f("path_length"), F.lit(1e-12))
    state = F.when((z >= 5) | (share >= 0.35), "DISCONTINUOUS").when((z >= 3) | (_tails() >= 3), "EVENT_LIKE").otherwise("NORMAL")
    return state, _clip(F.when(state == "NORMAL", 1 - F.least(z / 10, F.lit(0.8))).otherwise(z / 5))


def market_phase() -> tuple[Column, Column]:
    t, phase, act = F.col("trend"), F.col("volatility_phase"), F.col("activity")
    state = (
        F.when(t.endswith("UPTREND") & (phase != "COMPRESSING"), "MARKUP_LIKE").when(t.endswith("DOWNTREND") & (phase != "COMPRESSING"), "MARKDOWN_LIKE")
        .when((t == "RANGE") & (act == "ELEVATED"), "DISTRIBUTION_LIKE").when((t == "RANGE") & (phase == "COMPRESSING"), "ACCUMULATION_LIKE").when(t == "RANGE", "BALANCED").otherwise("TRANSITION")
    )
    return state, _clip((F.col("trend_confidence") + F.col("volatility_phase_confidence") + F.greatest("activity_confidence", F.lit(0.5))) / 3)


def _polarity(t: Column) -> Column:
    return F.when(t.endswith("UPTREND"), "BULLISH").when(t.endswith("DOWNTREND"), "BEARISH").when(t == "RANGE", "RANGE").otherwise("UNCERTAIN")


def multi_resolution(contexts: DataFrame) -> DataFrame:
    """With the agreement of the trends that end with a window at the longer lengths: one aggregation over (series, end), one join."""
    keys = ["instrument", "timeframe", "end_ts"]
    way = _polarity(F.col("trend"))
    longer = contexts.where(F.col("length").isin(MIDDLE, MACRO)).groupBy(*keys).agg(F.max(F.when(F.col("length") == MIDDLE, way)).alias("_middle"), F.max(F.when(F.col("length") == MACRO, way)).alias("_macro"))
    # A window is no link of its own.
    mid = F.when(F.col("length") != MIDDLE, F.col("_middle"))
    mac = F.when(F.col("length") != MACRO, F.col("_macro"))
    moves = lambda c: c.isin("BULLISH", "BEARISH")
    state = (
        F.when(mid.isNull() | mac.isNull(), "UNAVAILABLE").when((way == mid) & (mid == mac) & (way != "UNCERTAIN"), F.concat(F.lit("ALIGNED_"), way))
        .when(moves(way) & moves(mac) & (way != mac), F.concat(F.lit("LOCAL_"), way, F.lit("_MACRO_"), mac))
        .when(moves(way) & (mac == "RANGE"), "LOCAL_TREND_MACRO_RANGE").when((way == "RANGE") & moves(mac), "LOCAL_RANGE_MACRO_TREND").otherwise("MIXED")
    )
    sure = F.when(state == "UNAVAILABLE", 0.0).when(state.startswith("ALIGNED"), 0.85).otherwise(0.65)
    return contexts.join(longer, keys, "left").withColumn("multi_resolution", state).withColumn("multi_resolution_confidence", sure).drop("_middle", "_macro")


def family() -> Column:
    t, v, m = F.col("trend"), F.col("volatility"), F.col("multi_resolution")
    high = v.isin("HIGH", "EXTREME")
    side = lambda name: F.when(high, f"{name}_TREND_HIGH_VOL").otherwise(f"{name}_TREND_LOW_VOL")
    return (
        F.when(F.col("shock") != "NORMAL", "TRANSITIONAL_SHOCK").when(m.startswith("LOCAL_") | (m == "MIXED"), "MIXED_MULTI_SCALE").when(t.endswith("UPTREND"), side("BULL"))
        .when(t.endswith("DOWNTREND"), side("BEAR")).when((t == "RANGE") & v.isin("VERY_LOW", "LOW"), "RANGE_LOW_VOL").when(t == "RANGE", "RANGE_HIGH_VOL").otherwise("UNCERTAIN_CONTEXT")
    )


def classify(described: DataFrame) -> DataFrame:
    """described (features of all lengths together) with states, confidences, composite code and family."""
    df = described
    for name, rule in (("trend", trend), ("volatility", volatility), ("volatility_phase", volatility_phase), ("persistence", persistence), ("activity", activity), ("shock", shock), ("market_phase", market_phase)):
        state, sure = rule()
        df = df.withColumns({name: state, f"{name}_confidence": sure})
    df = multi_resolution(df)
    known = reduce(lambda a, b: a + b, ((~F.col(k).isin("UNCERTAIN", "UNAVAILABLE")).cast("int") for k in DIMENSIONS))
    composite = reduce(lambda a, b: a + b, (F.col(f"{k}_confidence") * w for k, w in WEIGHTS.items()))
    flags = F.array_compact(F.array(F.when(known < len(DIMENSIONS), "PARTIAL_CONTEXT"), F.when(composite < 0.5, "LOW_COMPOSITE_CONFIDENCE")))
    return df.withColumns({"family": family(), "composite": F.concat_ws("__", *DIMENSIONS), "composite_confidence": composite, "completeness": known / len(DIMENSIONS), "context_flags": flags})
