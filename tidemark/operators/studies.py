"""Baselines, arms, gates and verdicts over evaluated forecasts. Verdicts are CASE columns, so they judge many groups at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import similarity, validation
from .validation import brier, draw

#: Dimensions that two windows must share, by the name of the context definition.
CONTEXTS = {"trend_volatility": ("trend", "volatility"), "trend_volatility_persistence": ("trend", "volatility", "persistence"), "core_context": ("trend", "volatility", "persistence", "shock"), "context_family": ("family",)}
EARLIEST = ("unconditional_outcome_v1", "naive_continuation_v1", "naive_mean_reversion_v1", "recent_mean_return_v1")
ARMS = ("same_instrument", "same_asset_class", "cross_asset", "context_matched")


def same_context(dims: tuple[str, ...]) -> Column:
    """q_<dim> is known and equals c_<dim>, for all dims."""
    out = F.lit(True)
    for d in dims:
        out = out & F.col(f"q_{d}").isNotNull() & F.coalesce(F.col(f"q_{d}") == F.col(f"c_{d}"), F.lit(False))
    return out


def arm(name: str) -> Column:
    return {
        "same_instrument": F.col("q_instrument") == F.col("c_instrument"), "same_asset_class": F.col("q_asset_class") == F.col("c_asset_class"),
        "cross_asset": F.col("q_instrument") != F.col("c_instrument"), "context_matched": same_context(CONTEXTS["core_context"]),
    }[name]


def baseline(pairs: DataFrame, name: str, k: int, seed: str = "1") -> DataFrame:
    """k candidates of each query by a rule that knows nothing of similarity. pairs: q_id, c_id, c_end and what the rule compares.

    Draws are the first k in the order of a hash of seed, query and candidate. Without a context of its own a query draws from all.
    """
    known = F.col("q_trend").isNotNull() if "q_trend" in pairs.columns else F.lit(False)
    if name in EARLIEST:
        order = F.row_number().over(Window.partitionBy("q_id").orderBy("c_end", "c_id"))
        return pairs.withColumn("rank", order).where(F.col("rank") <= k)
    rule = {
        "random_history_v1": F.lit(True), "same_instrument_random_v1": F.col("q_instrument") == F.col("c_instrument") if "q_instrument" in pairs.columns else F.lit(True),
        "same_asset_class_random_v1": F.col("q_asset_class") == F.col("c_asset_class") if "q_asset_class" in pairs.columns else F.lit(True),
    }
    if name in ("same_context_random_v1", "context_filter_random_v1"):
        kept = pairs.where(~known | same_context(CONTEXTS["core_context"]))
    elif name == "same_volatility_random_v1":
        kept = pairs.where(~known | same_context(("volatility",)))
    else:
        kept = pairs.where(rule[name])
    return draw(kept.withColumn("baseline", F.lit(name)), ["q_id", "baseline"], seed, k)


def walk_forward_run(windows: DataFrame, labels: DataFrame, plan: DataFrame, methods: tuple[str, ...], horizons: tuple[int, ...], ks: tuple[int, ...], same_instrument: bool = True) -> DataFrame:
    """Metrics by fold, method, horizon and k of forecasts whose candidates were all over before their query began.

    windows: window_id, instrument, timeframe, length, start_ts, end_ts and what the methods compare. labels: window_id, horizon,
    simple_return, mfe, mae, continuation, complete ones only. plan: validation.folds(). A query is a window that ends in a fold's
    test interval; its candidates end in the fold's index interval and must be eligible for the horizon.
    """
    # The folds are a few rows.
    tests = windows.join(F.broadcast(plan), windows["end_ts"].between(plan["test_start"], plan["test_end"])).withColumn("until", F.col("index_end"))
    found = []
    for method in methods:
        for h in horizons:
            near = similarity.search(tests, windows, method, max(ks), same_instrument=same_instrument, serves=lambda q, c, h=h: validation.eligibility(q, c, h).isNull())
            known = near.join(labels.where(F.col("horizon") == h).withColumnRenamed("window_id", "c_id"), "c_id")
            found.append(known.withColumn("method", F.lit(method)))
    near = reduce(DataFrame.unionByName, found).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("rank") <= F.col("k"))
    keys = ["fold", "method", "horizon", "k"]
    forecasts = validation.forecast(near.withColumn("weight", validation.weights("uniform_v1", [*keys, "q_id"])), [*keys, "q_id"])
    actual = labels.select(F.col("window_id").alias("q_id"), "horizon", F.col("simple_return").alias("actual"))
    evaluated = forecasts.join(actual, ["q_id", "horizon"]).select(*keys, "q_id", F.col("positive").alias("p"), (F.col("actual") > 0).alias("up"), "actual", F.col("mean_return").alias("predicted"), "q10", F.col("median_return").alias("q50"), "q90")
    return validation.metrics(evaluated, keys)


def skill(evaluations: DataFrame, keys: list[str], against: str) -> DataFrame:
    """Brier skill of each method against the method `against` within keys: 1 - b / b0. evaluations: method, p, up."""
    b = evaluations.groupBy(*keys, "method").agg(F.avg(brier(F.col("p"), F.col("up"))).alias("brier"), F.count("*").alias("n"))
    base = F.max(F.when(F.col("method") == against, F.col("brier"))).over(Window.partitionBy(*keys))
    return b.withColumn("skill", 1 - F.col("brier") / F.greatest(base, F.lit(1e-12)))


def layers(table: DataFrame) -> DataFrame:
    """Rows (position, layer, brier) with the skill against the layer before."""
    before = F.lag("brier").over(Window.orderBy("position"))  # one row a layer
    return table.withColumn("skill_vs_prior_layer", 1 - F.col("brier") / F.greatest(before, F.lit(1e-12)))


def summaries(evaluations: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Means of the losses for several groupings in one pass, with GROUPING SETS."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return evaluations.withColumn("_b", brier(F.col("p"), F.col("up"))).groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(
        F.grouping_id().alias("grouping"), F.count("*").alias("n"), F.avg("_b").alias("brier"), F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mae")
    )


def gates(values: DataFrame) -> DataFrame:
    """values: gate, actual, required. A study is ready if all have passed."""
    return values.withColumn("status", F.when(F.col("actual") >= F.col("required"), "PASSED").otherwise("FAILED"))


def episode_quality(episodes: Column, largest: Column, top3: Column, least: int = 30, most: float = 0.1, most3: float = 0.25) -> Column:
    return F.when((episodes >= least) & (largest <= most) & (top3 <= most3), "ADEQUATE").when((episodes >= max(1, least // 2)) & (largest <= 0.2), "MARGINAL").otherwise("INADEQUATE")


def experiment_verdict(n: Column, skill_: Column, accuracy: Column, low: Column) -> Column:
    return (
        F.when(n < 10, "INSUFFICIENT_DATA").when((skill_ <= 0) | (accuracy <= 0.5), "NO_SUPPORTED_EDGE").when((low > 0) & (n >= 50), "OUT_OF_SAMPLE_SUPPORTED").otherwise("PROMISING")
    )


def diagnostic_verdict(records: Column, concentrated: Column, near_constant: Column, available: Column, rho: Column) -> Column:
    return (
        F.when(records < 20, "INSUFFICIENT_SAMPLE").when(concentrated, "EPISODE_CONCENTRATION_FAILURE").when((near_constant > 0.25) | (available < 0.7), "REPRESENTATION_FAILURE")
        .when(F.abs(rho) < 0.05, "NO_RETRIEVAL_EDGE").otherwise("REFINEMENT_PROMISING")
    )


def study_verdict(ready: Column, instruments: Column, quality: Column, skill_: Column) -> Column:
    return (
        F.when(~ready & (instruments > 0), "PILOT_ONLY").when(~ready, "STUDY_NOT_READY").when(quality != "ADEQUATE", "INSUFFICIENT_EPISODE_DIVERSITY")
        .when(skill_ > 0, "REFINEMENT_PROMISING").otherwise("NO_RETRIEVAL_EDGE")
    )


def replication_verdict(c: dict[str, Column]) -> Column:
    """c: sufficient, skill, context_skill, consistent, diverse, single, calibrated, low, independent."""
    all_met = (c["context_skill"] > 0) & c["diverse"] & ~c["single"] & c["calibrated"] & F.coalesce(c["low"] > 0, F.lit(False)) & c["independent"]
    return (
        F.when(~c["sufficient"] | c["skill"].isNull() | c["context_skill"].isNull(), "REPLICATION_INCONCLUSIVE").when((c["skill"] <= 0) | ~c["consistent"], "REPLICATION_NOT_SUPPORTED")
        .when(all_met, "REPLICATION_SUPPORTED").otherwise("REPLICATION_PARTIAL")
    )


def prospective_verdict(n: Column, skill_: Column, low: Column, least: int = 30, preferred: int = 100) -> Column:
    return (
        F.when((n < least) | skill_.isNull(), "PROSPECTIVE_EVIDENCE_ACCUMULATING").when(skill_ <= 0, "PROSPECTIVE_CONTEXT_SIGNAL_NOT_SUPPORTED")
        .when((n >= preferred) & F.coalesce(low > 0, F.lit(False)), "PROSPECTIVE_CONTEXT_SIGNAL_SUPPORTED").otherwise("PROSPECTIVE_CONTEXT_SIGNAL_WEAK")
    )


def timing(observations: DataFrame, least_days: int = 5, margin_hours: int = 2) -> DataFrame:
    """When a daily run is safe, from observations (at, instrument, new_bar, reachable): the latest of the instruments' earliest times of a new bar, plus a margin.

    Days are distinct calendar dates; an instrument that never showed a new bar leaves the time open.
    """
    seen = observations.where("reachable")
    weekday = F.weekday("at") < 5
    days = seen.agg(F.count_distinct(F.when(weekday, F.to_date("at"))).alias("weekdays"), F.count_distinct(F.when(~weekday, F.to_date("at"))).alias("weekend_days"))
    first = seen.groupBy("instrument").agg(F.min(F.when(F.col("new_bar"), F.date_format("at", "HH:mm"))).alias("earliest"))
    # One row an instrument, and one row of days.
    last = first.agg(F.max("earliest").alias("slowest"), F.count_if(F.col("earliest").isNull()).alias("silent"), F.count("*").alias("instruments"))
    ok = (F.col("weekdays") >= least_days) & (F.col("silent") == 0) & (F.col("instruments") > 0)
    hour = F.pmod(F.substring("slowest", 1, 2).cast("int") + margin_hours, F.lit(24))
    both = days.crossJoin(last)
    return both.select("weekdays", "weekend_days", "instruments", "silent", F.when(ok, F.concat(F.lpad(hour.cast("string"), 2, "0"), F.substring("slowest", 3, 3))).alias("safe_time"), F.when(ok, "SCHEDULER_TIMING_VALIDATED").otherwise("SCHEDULER_TIMING_NOT_YET_VALIDATED").alias("status"))
