"""Walk-forward evaluation of neighbour forecasts: folds, eligibility, weights, aggregates, losses, calibration, significance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 1e-12


def folds(windows: DataFrame, method: str = "expanding_walk_forward_v1", count: int = 3, least_index: int = 5, test: int = 3, rolling: int = 10) -> DataFrame:
    """fold, index_start, index_end, test_start, test_end (times) over the windows in order of (end, id).

    The order's numbers come from one global sort of (end, id); the folds' few bounds are then read from it.
    """
    n = windows.count()
    if n < least_index + 1:
        raise ValueError("no window can be tested")
    if method == "anchored_holdout_v1":
        starts = [max(least_index, n * 7 // 10)]
    elif method == "purged_kfold_v1":
        starts = [i * max(1, n // count) for i in range(1, count)]
    else:
        starts = [s for i in range(count) if (s := least_index + i * test) < n]
    plan = []
    for k, s in enumerate(starts, 1):
        stop = min(s + test, n)
        low = max(0, s - rolling) if method == "rolling_walk_forward_v1" else 0
        high = (n if stop < n else s) if method == "purged_kfold_v1" else s
        if s < stop and low < high:
            plan.append((k, low, high - 1, s, stop - 1))
    spark = windows.sparkSession
    wanted = spark.createDataFrame([(k, name, i) for k, *bounds in plan for name, i in zip(("index_start", "index_end", "test_start", "test_end"), bounds)], "fold int, name string, n long")
    ordered = windows.select("end_ts", "window_id").repartitionByRange(F.col("end_ts"), F.col("window_id")).sortWithinPartitions("end_ts", "window_id").withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_m").alias("_first"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = ordered.join(F.broadcast(base), "_p").select("end_ts", (F.col("_base") + F.col("_m") - F.col("_first")).alias("n"))
    return at.join(F.broadcast(wanted), "n").groupBy("fold").pivot("name", ["index_start", "index_end", "test_start", "test_end"]).agg(F.first("end_ts"))


def _seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1_000_000


def eligibility(q: dict[str, Column], c: dict[str, Column], horizon: Column | int, gap_bars: int = 0, purge_source: bool = True, purge_outcome: bool = True, cross: bool = True, same: bool = True) -> Column:
    """The first reason why a candidate may not serve a query, null if it may. Both: id, instrument, start, end, length."""
    qs, qe, cs, ce = _seconds(q["start"]), _seconds(q["end"]), _seconds(c["start"]), _seconds(c["end"])
    step = lambda s, e, n: F.when(n > 1, (e - s) / F.greatest(n - 1, F.lit(1))).otherwise(e - s)
    q_out, c_out = qe + step(qs, qe, q["length"]) * horizon, ce + step(cs, ce, c["length"]) * horizon
    meet = lambda a, b, x, y: (a <= y) & (x <= b)
    bar = F.greatest(qe - qs, ce - cs) / F.greatest(F.greatest(q["length"], c["length"]) - 1, F.lit(1))
    return (
        F.when(q["id"] == c["id"], "SAME_QUERY").when(ce >= qe, "FUTURE_OR_CONTEMPORARY")
        .when(F.lit(not cross) & (q["instrument"] != c["instrument"]), "CROSS_ASSET_EXCLUDED").when(F.lit(not same) & (q["instrument"] == c["instrument"]), "SAME_INSTRUMENT_EXCLUDED")
        .when(F.lit(gap_bars > 0) & (ce > qe - bar * gap_bars), "EMBARGO_OR_TEMPORAL_DISTANCE").when(F.lit(purge_source) & meet(cs, ce, qs, qe), "SOURCE_OVERLAP")
        .when(F.lit(purge_outcome) & meet(cs, ce, qe, q_out), "CANDIDATE_SOURCE_OVERLAPS_QUERY_OUTCOME").when(F.lit(purge_outcome) & meet(ce, c_out, qs, qe), "CANDIDATE_OUTCOME_OVERLAPS_QUERY_SOURCE")
        .when(F.lit(purge_outcome) & meet(ce, c_out, qe, q_out), "OUTCOME_OVERLAP")
    )


def weights(method: str, keys: list[str], temperature: float = 1.0) -> Column:
    """Weight of a neighbour (distance, score, rank) in its query; the sum of a query is 1."""
    w = Window.partitionBy(*keys)
    raw = {
        "uniform_v1": F.lit(1.0), "inverse_distance_v1": 1 / (F.greatest("distance", F.lit(0.0)) + 1e-9),
        "softmax_similarity_v1": F.exp((F.col("score") - F.max("score").over(w)) / max(temperature, 1e-9)), "rank_decay_v1": 1 / F.col("rank"),
    }[method]
    return raw / F.sum(raw).over(w)


def forecast(neighbours: DataFrame, keys: list[str]) -> DataFrame:
    """By query from neighbours (weight, simple_return, mfe, mae, continuation): frequencies, means, quantiles, trimmed mean, spread."""
    w, r = F.col("weight"), F.col("simple_return")
    share = lambda cond: F.sum(F.when(cond, w).otherwise(0.0)) / F.sum(w)
    base = neighbours.where(r.isNotNull())
    ordered = F.sort_array(F.collect_list("simple_return"))  # k values at most
    out = base.groupBy(*keys).agg(
        F.count("*").alias("neighbours"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_size"), share(r > 0).alias("positive"), share(r < 0).alias("negative"),
        (F.sum(w * r) / F.sum(w)).alias("mean_return"), F.percentile(r, F.lit(0.5)).alias("median_return"), F.percentile(r, F.lit(0.1)).alias("q10"), F.percentile(r, F.lit(0.9)).alias("q90"),
        F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("std_return"), (F.sum(w * F.col("mfe")) / F.sum(w)).alias("mean_mfe"), (F.sum(w * F.col("mae")) / F.sum(w)).alias("mean_mae"),
        share(F.col("continuation") == "CONTINUATION").alias("p_continuation"), share(F.col("continuation") == "REVERSAL").alias("p_reversal"), ordered.alias("_r"),
    )
    n = F.size("_r")
    cut = F.floor(n / 10).cast("int")
    middle = F.slice("_r", cut + 1, n - 2 * cut)
    mad = F.sort_array(F.transform("_r", lambda x: F.abs(x - F.col("median_return"))))
    half = (F.get(mad, F.floor((n - 1) / 2).cast("int")) + F.get(mad, F.floor(n / 2).cast("int"))) / 2
    return out.withColumns({
        "effective_size": F.least(F.greatest("effective_size", F.lit(1.0)), F.col("neighbours").cast("double")), "flat": F.greatest(1 - F.col("positive") - F.col("negative"), F.lit(0.0)),
        "trimmed_mean": F.aggregate(middle, F.lit(0.0), lambda s, x: s + x) / F.size(middle), "mad_return": half,
    }).drop("_r")


def brier(p: Column, up: Column) -> Column:
    q = F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))  # least and greatest pass over nulls
    return (q - up.cast("double")) * (q - up.cast("double"))


def log_loss(p: Column, up: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return -F.when(up, F.ln(q)).otherwise(F.ln(1 - q))


def pinball(actual: Column, predicted: Column, q: float) -> Column:
    return F.greatest(q * (actual - predicted), (q - 1) * (actual - predicted))


def metrics(evaluations: DataFrame, keys: list[str]) -> DataFrame:
    """By keys from evaluations (p, up, actual, predicted, q10, q50, q90): the twelve metrics."""
    p, up, a = F.col("p"), F.col("up"), F.col("actual")
    guess = p >= 0.5
    n = F.count("*")
    cells = {"tp": guess & up, "tn": ~guess & ~up, "fp": guess & ~up, "fn": ~guess & up}
    loss = (pinball(a, F.col("q10"), 0.1) + pinball(a, F.col("q50"), 0.5) + pinball(a, F.col("q90"), 0.9)) / 3
    error = a - F.col("predicted")
    df = evaluations.groupBy(*keys).agg(
        n.alias("n"), *(F.count_if(c).alias(k) for k, c in cells.items()), F.avg(brier(p, up)).alias("brier_score"), F.avg(log_loss(p, up)).alias("log_loss"),
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(loss).alias("pinball_loss"), F.avg(F.abs(error)).alias("empirical_crps"),
    )
    at_least_1 = lambda c: F.greatest(c, F.lit(1))
    tp, tn, fp, fn = map(F.col, cells)
    product = ((tp + fp) * (tp + fn)).cast("double") * ((tn + fp) * (tn + fn)).cast("double")
    return df.withColumns({
        "direction_accuracy": (tp + tn) / at_least_1(F.col("n")), "balanced_accuracy": (tp / at_least_1(tp + fn) + tn / at_least_1(tn + fp)) / 2,
        "matthews_correlation": (tp * tn - fp * fn) / F.sqrt(F.greatest(product, F.lit(1.0))), "brier_skill_score": 1 - F.col("brier_score") / 0.25,
    })


def calibration(evaluations: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """By keys and bin of p: count, mean p, share of up, gap; empty bins are listed. ECE and MCE by calibration_error."""
    p = F.col("p")
    # Compared with k / bins as written, so that an edge falls where the comparison puts it.
    which = F.least(F.aggregate(F.array(*(F.lit(k / bins) for k in range(1, bins))), F.lit(0), lambda s, e: s + (p >= e).cast("int")), F.lit(bins - 1))
    got = evaluations.withColumn("bin", which).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("confidence"), F.avg(F.col("up").cast("double")).alias("frequency"))
    every = evaluations.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(got, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("gap", F.abs(F.col("confidence") - F.col("frequency")))


def calibration_error(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


def z_test(k: Column, n: Column, share: float = 0.5) -> Column:
    """Two-sided p-value of k hits of n against a true share, by the normal approximation.

    The error function is summed by its series of positive terms, whose quotient is 2 z^2 / (2 i + 1).
    """
    z = F.abs(k / n - share) / F.sqrt(share * (1 - share) / n) / F.sqrt(F.lit(2.0))
    start = F.struct(z.alias("term"), z.alias("total"))
    step = lambda s, i: F.struct((s["term"] * 2 * z * z / (2 * i + 1)).alias("term"), (s["total"] + s["term"] * 2 * z * z / (2 * i + 1)).alias("total"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(119)), start, step)["total"]
    return F.when(n > 0, F.greatest(1 - 2 / F.sqrt(F.lit(3.141592653589793)) * F.exp(-z * z) * series, F.lit(0.0)))


def adjust(tests: DataFrame, keys: list[str]) -> DataFrame:
    """tests (p_value) with Benjamini-Hochberg and Holm adjusted values within keys."""
    part = Window.partitionBy(*keys)
    m = F.count("*").over(part)
    up = part.orderBy("p_value", "test")
    rank = F.row_number().over(up)
    df = tests.withColumns({"_m": m, "_rank": rank})
    bh = F.min(F.col("p_value") * F.col("_m") / F.col("_rank")).over(up.rowsBetween(0, Window.unboundedFollowing))
    holm = F.max(F.col("p_value") * (F.col("_m") - F.col("_rank") + 1)).over(up.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"p_bh": F.least(bh, F.lit(1.0)), "p_holm": F.least(holm, F.lit(1.0))}).drop("_m", "_rank")


def draw(pairs: DataFrame, keys: list[str], seed: str, k: int) -> DataFrame:
    """k candidates of each query in the order of a hash: a draw that any engine repeats."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), *keys, "c_id"), 256)
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(h))).where(F.col("rank") <= k)


def bootstrap(values: DataFrame, keys: list[str], value: str = "value", reps: int = 200, block: bool = False, seed: int = 1, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the mean by keys, iid or in blocks of floor(sqrt(n)) rows in order of `n`. values are metrics of queries: a group fits a task."""
    import numpy as np
    import pandas as pd

    def one(key, part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("n")[value].to_numpy(float)
        size = max(1, int(np.sqrt(len(x)))) if block else 1
        start = np.random.default_rng(seed).integers(0, len(x) - size + 1, (reps, -(-len(x) // size)))
        means = np.sort(x[(start[:, :, None] + np.arange(size)).reshape(reps, -1)[:, : len(x)]].mean(axis=1))
        low, high = means[int(alpha / 2 * (reps - 1))], means[int((1 - alpha / 2) * (reps - 1))]
        return pd.DataFrame([[*key, x.mean(), low, high, means.std(ddof=1)]])

    kept = [f for f in values.schema.fields if f.name in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", mean double, low double, high double, standard_error double"
    return values.select(*(f.name for f in kept), "n", value).groupBy(*(f.name for f in kept)).applyInPandas(lambda key, part: one(key, part).set_axis([f.name for f in kept] + ["mean", "low", "high", "standard_error"], axis=1), schema)
