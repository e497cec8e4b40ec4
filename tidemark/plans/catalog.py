"""Registry of the engine's queries and of the SQL that must give the same rows."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import context, diagnostics, features, normalize, outcomes, prospective, relational, similarity, studies, validation, windows
from ..sources import bars as B
from ..sources import providers

LENGTH = 16
SERIES = ["instrument", "timeframe"]


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show; -0 becomes 0."""
    return df.select(*(F.round(F.col(c) + F.lit(0.0), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _h4_windows(spark: SparkSession, sf_dir: str, horizon: int = 0, lengths: tuple[int, ...] = (LENGTH,)) -> DataFrame:
    return windows.sliding_windows(B.event_bars(spark, sf_dir), lengths, horizon=horizon)


def _asked(df: DataFrame) -> DataFrame:
    """The stated query set of searches against all windows: every 50th window of each series."""
    return df.where("bar_no % 50 = 0")


_BARS = """bars AS (
  SELECT event_type AS instrument, 'H4' AS timeframe, time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01') AS ts,
    arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2, 3)"""
_D1 = """bars AS (
  SELECT o_orderpriority AS instrument, 'D1' AS timeframe, date_trunc('day', o_orderdate) AS ts,
    arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close,
    CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2, 3)"""
#: Windows of 16 bars with their closes and, for the labels, the five bars behind.
_WIN = (
    _BARS
    + """, numbered AS (
  SELECT *, row_number() OVER s AS bar_no, list(close) OVER w AS c, list(open) OVER w AS o, list(high) OVER w AS h, list(low) OVER w AS l, list(volume) OVER w AS v,
    first(ts) OVER w AS start_ts, list(close) OVER f AS fc, list(high) OVER f AS fh, list(low) OVER f AS fl
  FROM bars
  WINDOW s AS (PARTITION BY instrument ORDER BY ts), w AS (PARTITION BY instrument ORDER BY ts ROWS BETWEEN 15 PRECEDING AND CURRENT ROW),
    f AS (PARTITION BY instrument ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
win AS (SELECT * EXCLUDE (ts), ts AS end_ts FROM numbered WHERE bar_no >= 16)"""
)


def bars_h4(spark, sf_dir):
    return _r(B.event_bars(spark, sf_dir))


def bars_d1(spark, sf_dir):
    return _r(B.order_bars(spark, sf_dir))


def window_counts(spark, sf_dir):
    w = _h4_windows(spark, sf_dir, lengths=(8, 16, 32, 64))
    return w.groupBy(*SERIES, "length").agg(F.count("*").alias("n_windows"), F.min("start_ts").alias("first_start"), F.max("end_ts").alias("last_end"))


def window_flags(spark, sf_dir):
    w = windows.sliding_windows(B.event_bars(spark, sf_dir, "H1"), (LENGTH,), seconds=3600)
    return w.select(*SERIES, "end_ts", "missing_bars", F.concat_ws(",", "quality_flags").alias("flags"))


def outcome_labels(spark, sf_dir):
    got = outcomes.outcomes(_h4_windows(spark, sf_dir, horizon=5), (5,))
    return _r(got.select("instrument", "end_ts", "available", "is_complete", "simple_return", "log_return", "mfe", "mae", "mfe_bar", "mae_bar", "direction_class", "continuation", "barrier_5", "barrier_10", "barrier_20", "first_barrier", "gain_sequence", "drawdown_sequence"))


def outcome_summary(spark, sf_dir):
    """Bars to windows to labels to groups: the smallest whole chain."""
    got = outcomes.outcomes(_h4_windows(spark, sf_dir, horizon=5), (5,)).where("is_complete")
    return _r(got.groupBy("instrument", "direction_class").agg(F.count("*").alias("n"), F.avg("simple_return").alias("avg_return"), F.avg("mfe").alias("avg_mfe"), F.avg("mae").alias("avg_mae")))


def outcome_paths(spark, sf_dir):
    got = outcomes.outcomes(_h4_windows(spark, sf_dir, horizon=5), (5,)).where("is_complete")
    return _r(got.select("instrument", "end_ts", "realized_volatility", "path_efficiency"))


def _norm(method: str):
    def query(spark, sf_dir):
        df = normalize.normalize(_h4_windows(spark, sf_dir), method)
        path = F.col("volume_path" if method == "volume_relative_mean" else "close_path")
        return _r(df.select("instrument", "end_ts", F.get(path, F.lit(0)).alias("p0"), F.get(path, F.lit(21)).alias("p21"), F.get(path, F.lit(40)).alias("p40"), F.get(path, F.lit(63)).alias("p63"), A.mean(path).alias("path_mean")))

    return query


def _norm_sql(raw: str, over: str = "c") -> str:
    at = lambda i: f"(n[{i * 15 // 63 + 1}] + (n[least({i * 15 // 63 + 2}, 16)] - n[{i * 15 // 63 + 1}]) * ({i}.0 * 15 / 63 - {i * 15 // 63}))"
    mean = "list_avg(list_transform(range(64), lambda i: n[CAST(floor(i * 15 / 63) AS INT) + 1] + (n[least(CAST(floor(i * 15 / 63) AS INT) + 2, 16)] - n[CAST(floor(i * 15 / 63) AS INT) + 1]) * (i * 15 / 63 - floor(i * 15 / 63))))"
    points = ", ".join(f"round({at(i)} + 0.0, 6) AS p{i}" for i in (0, 21, 40, 63))
    return f"WITH {_WIN}, norm AS (SELECT instrument, end_ts, {raw} AS n FROM win) SELECT instrument, end_ts, {points}, round({mean} + 0.0, 6) AS path_mean FROM norm"


_STD = "sqrt(list_avg(list_transform({0}, lambda x: (x - list_avg({0})) * (x - list_avg({0})))))"
_TR = "list_transform(range(1, 17), lambda i: CASE WHEN i = 1 THEN h[1] - l[1] ELSE greatest(h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1])) END)"
_NORMS = {
    "anchored_simple_return": "list_transform(c, lambda x: x / c[1] - 1)",
    "anchored_log_return": "list_transform(c, lambda x: ln(x / c[1]))",
    "zscore_close": f"list_transform(c, lambda x: (x - list_avg(c)) / {_STD.format('c')})",
    "range_close": "list_transform(c, lambda x: (x - list_min(c)) / (list_max(c) - list_min(c)))",
    "atr_anchored_ohlc": f"list_transform(c, lambda x: (x - c[1]) / list_avg({_TR}))",
    "volume_relative_mean": "list_transform(v, lambda x: x / list_avg(v))",
    "range_close_centred": "list_transform(c, lambda x: 2 * (x - list_min(c)) / (list_max(c) - list_min(c)) - 1)",
    "volatility_targeted_return": f"list_transform(c, lambda x: ln(x / c[1]) / {_STD.format('list_transform(range(2, 17), lambda i: ln(c[i] / c[i - 1]))')})",
    "anchored_ohlc": "list_transform(c, lambda x: x / c[1] - 1)",
}

def window_features(spark, sf_dir):
    """All windows with the features that plain SQL can state."""
    return _r(features.features(_h4_windows(spark, sf_dir)).select("instrument", "end_ts", *_FEATURE_SQL))


def market_features(spark, sf_dir):
    """All 75 features; checked against numpy in the tests."""
    return features.features(_h4_windows(spark, sf_dir))


def market_context(spark, sf_dir):
    described = features.features(windows.sliding_windows(B.event_bars(spark, sf_dir, "H1"), (16, 64, 256), seconds=3600))
    return context.classify(described).select("window_id", *SERIES, "length", "end_ts", *context.DIMENSIONS, "family", "composite", "composite_confidence", "completeness")


def context_families(spark, sf_dir):
    return market_context(spark, sf_dir).groupBy("length", "family").count()


def _searchable(spark, sf_dir):
    df = normalize.normalize(_h4_windows(spark, sf_dir, horizon=5))
    return df.select("window_id", *SERIES, "length", "start_ts", "end_ts", "bar_no", "future", "bars", "quality_flags", F.col("close_path").alias("path"))


def analogues(spark, sf_dir):
    """The three nearest earlier windows of the same instrument by shape, for every window."""
    base = _searchable(spark, sf_dir).select("window_id", *SERIES, "length", "end_ts", "path")
    got = similarity.search(base, base, "shape_euclidean_v1", 3, same_instrument=True)
    ends = base.select(F.col("window_id").alias("q_id"), "instrument", F.col("end_ts").alias("q_end"))
    return _r(got.join(ends, "q_id").select("instrument", "q_end", "rank", "c_end", "distance"))


def analogue_methods(spark, sf_dir):
    """The three nearest earlier windows of the asked ones by seven methods, over the features that SQL states and a context of two dimensions."""
    base = _searchable(spark, sf_dir)
    described = features.features(_h4_windows(spark, sf_dir)).select("window_id", F.array(*(F.col(n) if n in _FEATURE_SQL else F.lit(None).cast("double") for n in features.NAMES)).alias("vec"))
    last = F.element_at("path", -1)
    known = {"trend": F.when(last > 0, "UP").otherwise("DOWN"), "volatility": F.when(F.abs(last) > 0.5, "HIGH").otherwise("LOW")}
    context_ = F.struct(*(known.get(d, F.lit("ANY")).alias(d) for d in similarity.COMPARED))
    df = base.join(described, "window_id").select("window_id", *SERIES, "length", "end_ts", "bar_no", "path", "vec", context_.alias("context"))
    ends = base.select(F.col("window_id").alias("q_id"), "instrument", F.col("end_ts").alias("q_end"))
    found = [similarity.search(_asked(df), df, m, 3, same_instrument=True).withColumn("method", F.lit(m)) for m in _METHODS_CHECKED]
    return _r(reduce(DataFrame.unionByName, found).join(ends, "q_id").select("method", "instrument", "q_end", "rank", "c_end", "distance"))


_METHODS_CHECKED = ("shape_correlation_v1", "dna_cosine_v1", "dna_robust_cosine_v1", "dna_robust_euclidean_v1", "dna_group_balanced_v1", "market_analogue_v1", "shape_dna_context_v2")


def analogues_blend(spark, sf_dir):
    """Shape, features and context together, episodes capped."""
    described = context.classify(features.features(_h4_windows(spark, sf_dir, lengths=(16, 64)))).where(F.col("length") == LENGTH)
    vec = described.select("window_id", similarity.vector().alias("vec"), F.struct(*similarity.COMPARED).alias("context"))
    base = _searchable(spark, sf_dir).join(vec, "window_id").select("window_id", *SERIES, "length", "end_ts", "path", "vec", "context", similarity.episode(16 * 14400).alias("episode_id"))
    return similarity.search(base, base, "episode_diverse_analogue_v1", 5, same_instrument=True, per_episode=1)


def embedding_neighbours(spark, sf_dir):
    """Cosine neighbours within a label of the embeddings table."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    side = lambda p: v.select("label", F.col("vec_id").alias(f"{p}_id"), F.col("e").alias(p))
    from pyspark.sql.window import Window

    pairs = side("q").where("q_id % 50 = 0").join(side("c"), "label").where("q_id <> c_id").select("q_id", "c_id", F.round(similarity.cosine(F.col("q"), F.col("c")), 6).alias("distance"))
    order = F.row_number().over(Window.partitionBy("q_id").orderBy("distance", "c_id"))
    return pairs.withColumn("rank", order).where("rank <= 5")


def _neighbours(spark, sf_dir):
    base = _searchable(spark, sf_dir)
    labels = outcomes.outcomes(base.select("window_id", *SERIES, "length", "end_ts", "bars", "future"), (5,)).where("is_complete").select(F.col("window_id").alias("c_id"), "simple_return", "mfe", "mae", "continuation")
    light = base.select("window_id", *SERIES, "length", "start_ts", "end_ts", "path")
    # Only candidates whose outcome was over before the query's first bar: what follows the query must not tell of itself.
    found = similarity.search(light, light, "shape_euclidean_v1", 10, same_instrument=True, serves=lambda q, c: validation.eligibility(q, c, 5).isNull())
    return found.join(labels, "c_id"), labels


def neighbour_forecast(spark, sf_dir):
    near, labels = _neighbours(spark, sf_dir)
    got = validation.forecast(near.withColumn("weight", validation.weights("rank_decay_v1", ["q_id"])), ["q_id"])
    ends = _searchable(spark, sf_dir).select(F.col("window_id").alias("q_id"), "instrument", "end_ts")
    return _r(got.join(ends, "q_id").select("instrument", "end_ts", "neighbours", "positive", "negative", "mean_return", "median_return", "q10", "q90", "std_return", "effective_size"))


def _evaluations(spark, sf_dir):
    near, labels = _neighbours(spark, sf_dir)
    got = validation.forecast(near.withColumn("weight", validation.weights("uniform_v1", ["q_id"])), ["q_id"])
    actual = labels.select(F.col("c_id").alias("q_id"), F.col("simple_return").alias("actual"))
    inst = _searchable(spark, sf_dir).select(F.col("window_id").alias("q_id"), "instrument", "end_ts")
    return got.join(actual, "q_id").join(inst, "q_id").select("q_id", "instrument", "end_ts", F.col("positive").alias("p"), (F.col("actual") > 0).alias("up"), "actual", F.col("mean_return").alias("predicted"), "q10", F.col("median_return").alias("q50"), "q90")


def validation_metrics(spark, sf_dir):
    return _r(validation.metrics(_evaluations(spark, sf_dir), ["instrument"]).drop("tp", "tn", "fp", "fn"))


def validation_calibration(spark, sf_dir):
    return _r(validation.calibration(_evaluations(spark, sf_dir), ["instrument"]))


def validation_run(spark, sf_dir):
    """Walk-forward folds over two fifths and more of the windows, two horizons and two sizes of neighbourhood."""
    base = _searchable(spark, sf_dir)
    labels = outcomes.outcomes(base.select("window_id", *SERIES, "length", "end_ts", "bars", "future"), (1, 5)).where("is_complete").select("window_id", "horizon", "simple_return", "mfe", "mae", "continuation")
    light = base.select("window_id", *SERIES, "length", "start_ts", "end_ts", "path")
    n = light.count()
    plan = validation.folds(light, "expanding_walk_forward_v1", 3, n * 2 // 5, n // 5)
    got = studies.walk_forward_run(light, labels, plan, ("shape_euclidean_v1",), (1, 5), (5, 10))
    return _r(got.select("fold", "method", "horizon", "k", "n", "brier_score", "mae", "direction_accuracy", "brier_skill_score"))


def eligibility_reasons(spark, sf_dir):
    """Why candidates may not serve the asked windows, counted."""
    base = _searchable(spark, sf_dir).select("window_id", "instrument", "timeframe", "length", "start_ts", "end_ts", "bar_no")
    late = _asked(base)
    name = {"id": "window_id", "instrument": "instrument", "start": "start_ts", "end": "end_ts", "length": "length"}
    q, c = late.select("timeframe", *(F.col(v).alias(f"q_{k}") for k, v in name.items())), base.select("timeframe", *(F.col(v).alias(f"c_{k}") for k, v in name.items()))
    reason = validation.eligibility({k: F.col(f"q_{k}") for k in name}, {k: F.col(f"c_{k}") for k in name}, 5, gap_bars=3)
    return q.join(c, "timeframe").groupBy(F.col("q_instrument").alias("instrument"), F.coalesce(reason, F.lit("ELIGIBLE")).alias("reason")).agg(F.count("*").alias("n"))


def walk_forward_folds(spark, sf_dir):
    return validation.folds(_h4_windows(spark, sf_dir).select("window_id", "end_ts"), "expanding_walk_forward_v1")


def quality_profile(spark, sf_dir):
    return _r(B.decide(B.profile(B.event_bars(spark, sf_dir, "H1"))))


def row_validation(spark, sf_dir):
    """Events as imported rows, with defects made by their id, judged one by one."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.when(F.col("event_id") % 101 == 0, None).when(F.col("event_id") % 89 == 0, F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000) * 3_600_000_000).cast("timestamp_ntz")).otherwise(F.col("ts"))
    v = F.col("value")
    rows = e.select("event_type", F.col("event_id").alias("row_no"), ts.alias("ts"), v.alias("open_value"), F.when(F.col("event_id") % 97 == 0, v - 1).otherwise(v + 1).alias("high_value"), (v - 1).alias("low_value"), F.when(F.col("event_id") % 83 == 0, F.lit(float("nan"))).otherwise(v).alias("close_value"), F.when(F.col("event_id") % 79 == 0, -1.0).otherwise(1.0).alias("volume_value"))
    return B.validate_rows(rows, ["event_type"]).select("row_no", F.concat_ws(",", "errors").alias("errors"), "accepted")


def provider_comparison(spark, sf_dir):
    a = B.order_bars(spark, sf_dir)
    b = a.where(F.day("ts") != 13).withColumn("close", F.col("close") * F.when(F.day("ts") % 2 == 0, 1.01).otherwise(1.0))
    return _r(B.compare_providers(a, b), 4)


def feature_availability(spark, sf_dir):
    return _r(features.availability(market_features(spark, sf_dir)))


def feature_distribution(spark, sf_dir):
    return diagnostics.distribution(market_features(spark, sf_dir))


def feature_redundancy(spark, sf_dir):
    return diagnostics.redundant_pairs(market_features(spark, sf_dir))


def distance_deciles(spark, sf_dir):
    near, labels = _neighbours(spark, sf_dir)
    actual = labels.select(F.col("c_id").alias("q_id"), F.col("simple_return").alias("own"))
    scored = near.join(actual, "q_id").select("q_id", "c_id", "distance", F.abs(F.col("simple_return") - F.col("own")).alias("discrepancy"))
    return _r(diagnostics.deciles(scored, "distance", ["q_id", "c_id"], "discrepancy"))


def significance(spark, sf_dir):
    """Adjusted p-values of one test an instrument: whether the forecasts' hits differ from chance."""
    e = _evaluations(spark, sf_dir)
    hits = e.groupBy("instrument").agg(F.count("*").alias("n"), F.count_if((F.col("p") >= 0.5) == F.col("up")).alias("k"))
    t = hits.select(F.col("instrument").alias("test"), F.lit(1).alias("g"), validation.z_test(F.col("k"), F.col("n")).alias("p_value"))
    return _r(validation.adjust(t, ["g"]).select("test", "p_value", "p_bh", "p_holm"))


def prospective_fallback(spark, sf_dir):
    """For every window: the probability from the narrowest history that is large enough, as of its end."""
    history, queries = _prospective_inputs(spark, sf_dir)
    return _r(prospective.fallback(queries, history, least=30))


def _prospective_inputs(spark, sf_dir, ask=lambda df: df):
    w = _h4_windows(spark, sf_dir, horizon=5)
    o = outcomes.outcomes(w, (5,)).join(w.select("window_id", "bar_no"), "window_id").select("bar_no", "window_id", "instrument", "end_ts", "horizon", "is_complete", "simple_return", "source_return")
    # A context that SQL can state as well: the sign of the window's own move, and whether it was large.
    c = o.withColumn("trend", F.when(F.col("source_return") > 0, "UP").otherwise("DOWN")).withColumn("volatility", F.when(F.abs("source_return") > 0.5, "HIGH").otherwise("LOW"))
    queries = ask(c).select("window_id", "instrument", "horizon", "trend", "volatility", F.col("end_ts").alias("as_of"))
    return c, queries


def forecast_evaluation(spark, sf_dir):
    history, queries = _prospective_inputs(spark, sf_dir)
    forecasts = prospective.fallback(queries, history, least=30).where("not insufficient")
    return _r(prospective.evaluate(prospective.mature(forecasts, history), ["horizon"]))


def _baseline(name: str):
    def query(spark, sf_dir):
        """Ten candidates of the asked windows, by a baseline's rule."""
        history, queries = _prospective_inputs(spark, sf_dir, _asked)
        c = history.where("is_complete").select("horizon", F.concat_ws("@", "instrument", "end_ts").alias("c_id"), F.col("instrument").alias("c_instrument"), F.col("end_ts").alias("c_end"), F.col("trend").alias("c_trend"), F.col("volatility").alias("c_volatility"))
        q = queries.select("horizon", F.concat_ws("@", "instrument", "as_of").alias("q_id"), F.col("instrument").alias("q_instrument"), "as_of", F.col("trend").alias("q_trend"), F.col("volatility").alias("q_volatility"))
        return studies.baseline(q.join(c, "horizon").where("c_end < as_of"), name, 10).select("q_id", "c_id", "rank")

    return query


def loss_summaries(spark, sf_dir):
    e = _evaluations(spark, sf_dir).withColumn("month", F.date_format("end_ts", "yyyy-MM"))
    return _r(studies.summaries(e, [["instrument", "month"], ["instrument"], ["month"], []]))


def experiment_verdicts(spark, sf_dir):
    e = _evaluations(spark, sf_dir)
    # The lower end of the 95 % interval of the mean gain over a coin's Brier score.
    gain = 0.25 - validation.brier(F.col("p"), F.col("up"))
    low = e.groupBy("instrument").agg((F.avg(gain) - 1.96 * F.stddev_samp(gain) / F.sqrt(F.count("*"))).alias("low"))
    m = validation.metrics(e, ["instrument"]).join(low, "instrument")
    return m.select("instrument", "n", studies.experiment_verdict(F.col("n"), F.col("brier_skill_score"), F.col("direction_accuracy"), F.col("low")).alias("verdict"))


def run_timing(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return studies.timing(e.select(F.col("ts").alias("at"), F.col("event_type").alias("instrument"), (F.col("value") > 100).alias("new_bar"), (F.col("event_id") % 3 != 0).alias("reachable")))


def provider_payloads(spark, sf_dir):
    """Daily bars through a provider's nested JSON and back."""
    b = B.order_bars(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    fields = F.create_map(F.lit("1. open"), text("open"), F.lit("2. high"), text("high"), F.lit("3. low"), text("low"), F.lit("4. close"), text("close"), F.lit("5. volume"), text("volume"))
    day = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("k"), fields.alias("v"))
    payload = b.groupBy("instrument").agg(F.to_json(F.create_map(F.lit("Time Series (Daily)"), F.map_from_entries(F.collect_list(day)))).alias("payload"))
    got = providers.nested_bars(payload.withColumn("asset_class", F.when(F.col("instrument") == "1-URGENT", "forex").otherwise("index")))
    return _r(got.select("instrument", F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume"))


def evenly_spaced_bars(spark, sf_dir):
    return relational.spaced(B.order_bars(spark, sf_dir).select(*SERIES, "ts"), ["instrument"], ["ts"], 7)


def chronological_parts(spark, sf_dir):
    cut = relational.parts(B.order_bars(spark, sf_dir), ["instrument"], ["ts"])
    return cut.groupBy("instrument", "part").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def even_chunks(spark, sf_dir):
    cut = relational.split_evenly(B.order_bars(spark, sf_dir), ["instrument"], ["ts"], 7)
    return cut.groupBy("instrument", "chunk").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


def bars_page(spark, sf_dir):
    return _r(relational.page(B.event_bars(spark, sf_dir), ["ts", "instrument"], 3, 50))


def bars_in_range(spark, sf_dir):
    chosen = relational.matching(B.event_bars(spark, sf_dir), {"timeframe": "H4", "instrument": None}, {"volume": 3.0})
    return _r(relational.in_range(chosen, "ts", dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 20)))


def latest_bars(spark, sf_dir):
    return _r(relational.latest(B.event_bars(spark, sf_dir), list(SERIES), ["ts"]))


def customers_of_all_priorities(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return relational.divide(orders, ["o_custkey"], "o_orderpriority", orders)


def customer_universes(spark, sf_dir):
    side = lambda t, c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(c).alias("custkey"))
    return relational.same_universe(side("customer", "c_custkey"), side("orders", "o_custkey"), ["custkey"])


def contained_spans(spark, sf_dir):
    """Spans of users' events of a type that lie within the span of a user divisible by 50."""
    spans = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type", "user_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    return relational.contained(spans, spans.where("user_id % 50 = 0"), ["event_type"])


def direction_counts(spark, sf_dir):
    got = relational.counts_map(outcomes.outcomes(_h4_windows(spark, sf_dir, horizon=5), (5,)), ["instrument"], "direction_class")
    return got.select("instrument", F.to_json("counts").alias("counts"))


def outcome_completeness(spark, sf_dir):
    got = outcomes.outcomes(_h4_windows(spark, sf_dir, horizon=20), (1, 5, 20))
    return _r(relational.complete_rate(got, ["instrument"]))


def strict_confusion(spark, sf_dir):
    return _r(relational.strict_confusion(_evaluations(spark, sf_dir), ["instrument"]))


def calibration_intervals(spark, sf_dir):
    return _r(relational.calibration_interval(_evaluations(spark, sf_dir), ["instrument"]))


def instrument_warnings(spark, sf_dir):
    """Source warnings of instruments derived from the orders' priorities."""
    i = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority").distinct()
    p = F.col("o_orderpriority")
    provider = F.when(p.startswith("1"), "yahoo_finance_v1").when(p.startswith("5"), "csv").otherwise("alpha_vantage_v1")
    codes = relational.source_warnings(provider, F.when(p.startswith("2"), "Forex").otherwise("index"), F.when(p.startswith("3"), "GC=F").otherwise(p), F.when(p.startswith("1"), "provider_adjusted").otherwise("none"))
    return i.select("o_orderpriority", F.concat_ws(",", codes).alias("warnings"))


_PICK = ["analogue_methods", "validation_run", "evenly_spaced_bars", "chronological_parts", "even_chunks", "bars_page", "bars_in_range", "latest_bars", "customers_of_all_priorities", "customer_universes", "contained_spans", "direction_counts", "outcome_completeness", "strict_confusion", "calibration_intervals", "instrument_warnings", "loss_summaries", "experiment_verdicts", "run_timing", "provider_payloads", "bars_h4", "bars_d1", "window_counts", "window_flags", "outcome_labels", "outcome_summary", "outcome_paths", "window_features", "market_features", "market_context", "context_families", "analogues", "analogues_blend", "embedding_neighbours", "neighbour_forecast", "validation_metrics", "validation_calibration", "eligibility_reasons", "walk_forward_folds", "quality_profile", "row_validation", "provider_comparison", "feature_availability", "feature_distribution", "feature_redundancy", "distance_deciles", "significance", "prospective_fallback", "forecast_evaluation"]
QUERIES = {name: globals()[name] for name in _PICK} | {f"norm_{m}": _norm(m) for m in normalize.METHODS}
BASELINES = ("random_history_v1", "same_instrument_random_v1", "same_volatility_random_v1", "unconditional_outcome_v1")
QUERIES |= {f"baseline_{m.removesuffix('_v1')}": _baseline(m) for m in BASELINES}

_RET = "list_transform(range(2, 17), lambda i: ln(c[i] / c[i - 1]))"
_BARRIER = """CASE WHEN len(fc) = 0 THEN 'UNAVAILABLE' WHEN u{0} IS NULL AND d{0} IS NULL THEN 'NEITHER' WHEN d{0} IS NULL THEN 'UP_FIRST' WHEN u{0} IS NULL THEN 'DOWN_FIRST'
  WHEN u{0} = d{0} THEN 'SAME_BAR_BOTH' WHEN u{0} < d{0} THEN 'UP_FIRST' ELSE 'DOWN_FIRST' END"""
_HITS = ", ".join(f"list_position(list_transform(fh, lambda x: x >= c[16] * (1 + {b})), true) AS u{k}, list_position(list_transform(fl, lambda x: x <= c[16] * (1 - {b})), true) AS d{k}" for k, b in ((5, 0.005), (10, 0.01), (20, 0.02)))
_LABELS = (
    _WIN
    + f""", fut AS (SELECT * EXCLUDE (fc, fh, fl), coalesce(fc, []) AS fc, coalesce(fh, []) AS fh, coalesce(fl, []) AS fl FROM win), hits AS (SELECT *, {_HITS} FROM fut), lab0 AS (
  SELECT instrument, end_ts, len(fc) AS available, len(fc) >= 5 AS is_complete, c, fc, fh, fl, c[16] / c[1] - 1 AS source_return, fc[len(fc)] / c[16] - 1 AS simple_return, ln(fc[len(fc)] / c[16]) AS log_return,
    list_max(fh) / c[16] - 1 AS mfe, list_min(fl) / c[16] - 1 AS mae, list_position(fh, list_max(fh)) AS mfe_bar, list_position(fl, list_min(fl)) AS mae_bar,
    {_BARRIER.format(5)} AS barrier_5, {_BARRIER.format(10)} AS barrier_10, {_BARRIER.format(20)} AS barrier_20, bar_no, start_ts FROM hits),
labels_ AS (SELECT *, CASE WHEN simple_return IS NULL THEN 'UNAVAILABLE' WHEN simple_return > 1e-6 THEN 'POSITIVE' WHEN simple_return < -1e-6 THEN 'NEGATIVE' ELSE 'FLAT' END AS direction_class,
    CASE WHEN source_return IS NULL OR abs(source_return) < 1e-6 THEN 'SOURCE_DIRECTION_UNAVAILABLE' WHEN simple_return IS NULL THEN 'UNAVAILABLE' WHEN abs(simple_return) <= 1e-12 THEN 'SIDEWAYS'
      WHEN sign(source_return) = sign(simple_return) THEN 'CONTINUATION' ELSE 'REVERSAL' END AS continuation,
    CASE WHEN available = 0 THEN 'UNAVAILABLE' WHEN barrier_5 <> 'NEITHER' THEN barrier_5 WHEN barrier_10 <> 'NEITHER' THEN barrier_10 WHEN barrier_20 <> 'NEITHER' THEN barrier_20 ELSE 'NEITHER' END AS first_barrier
  FROM lab0)"""
)
_R6 = lambda *names: ", ".join(f"round({n} + 0.0, 6) AS {n}" for n in names)
_PATH = "list_transform(range(64), lambda i: n[CAST(floor(i * 15 / 63) AS INT) + 1] + (n[least(CAST(floor(i * 15 / 63) AS INT) + 2, 16)] - n[CAST(floor(i * 15 / 63) AS INT) + 1]) * (i * 15 / 63 - floor(i * 15 / 63)))"
_PAIRS = f""", norm AS (SELECT instrument, end_ts, start_ts, {_NORMS['anchored_log_return']} AS n FROM win), shape AS (SELECT instrument, end_ts, start_ts, {_PATH} AS p FROM norm),
pairs AS (SELECT q.instrument, q.end_ts AS q_end, k.end_ts AS c_end, sqrt(list_sum(list_transform(range(1, 65), lambda i: (q.p[i] - k.p[i]) * (q.p[i] - k.p[i]))) / 64) AS distance
  FROM shape q JOIN shape k ON q.instrument = k.instrument AND k.end_ts < q.end_ts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY instrument, q_end ORDER BY distance, c_end) AS rank FROM pairs QUALIFY rank <= 10)"""
_SERVES = "AND epoch_us(k.end_ts) + (epoch_us(k.end_ts) - epoch_us(k.start_ts)) / 15.0 * 5 < epoch_us(q.start_ts)"
_NEAR = _LABELS + _PAIRS.replace("k.end_ts < q.end_ts)", f"k.end_ts < q.end_ts {_SERVES})") + """, near AS (SELECT r.instrument, r.q_end, r.rank, r.distance, r.c_end, o.simple_return AS x FROM ranked r JOIN labels_ o ON o.instrument = r.instrument AND o.end_ts = r.c_end AND o.is_complete)"""
_EVAL = _NEAR + """, fc_ AS (SELECT instrument, q_end, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS p, avg(x) AS predicted, quantile_cont(x, 0.1) AS q10, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.9) AS q90 FROM near GROUP BY ALL),
ev AS (SELECT f.*, o.simple_return AS actual, o.simple_return > 0 AS up FROM fc_ f JOIN labels_ o ON o.instrument = f.instrument AND o.end_ts = f.q_end AND o.is_complete)"""
_EVAL_ALONE = f"WITH {_EVAL}"
_HALF = lambda lo, hi: f"sqrt(list_avg(list_transform(r[{lo}:{hi}], lambda x: (x - list_avg(r[{lo}:{hi}])) * (x - list_avg(r[{lo}:{hi}])))))"
_CORR = lambda a, b: f"(list_avg(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i])) - list_avg({a}) * list_avg({b})) / ({_STD.format(a)} * {_STD.format(b)})"
_XX = "list_sum(list_transform(range(1, 65), lambda i: ((i - 1) / 63 - 0.5) * ((i - 1) / 63 - 0.5)))"
_ALIKE = lambda m: f"list_sum(list_transform(range(1, {65 - m}), lambda i: len(list_filter(range(i + 1, {66 - m}), lambda j: {' AND '.join(f'abs(p[i + {k}] - p[j + {k}]) <= radius' for k in range(m))}))))"
_FEATURE_SQL = {
    "return_mean": "list_avg(r)", "return_std": _STD.format("r"), "positive_return_ratio": "len(list_filter(r, lambda x: x > 0)) / 15.0", "negative_return_ratio": "len(list_filter(r, lambda x: x < 0)) / 15.0",
    "momentum_first_half": "list_sum(r[1:7])", "momentum_second_half": "list_sum(r[8:15])", "maximum_positive_return": "list_max(r)", "maximum_negative_return": "list_min(r)", "return_median": "list_median(r)",
    "normalized_atr": f"list_avg({_TR.replace('h[1] - l[1]', 'greatest(h[1] - l[1], abs(h[1] - c[1]), abs(l[1] - c[1]))')}) / list_avg(c)",
    "body_to_range_mean": "CASE WHEN flat THEN NULL ELSE list_avg(list_transform(range(1, 17), lambda i: abs(c[i] - o[i]) / (h[i] - l[i]))) END",
    "bullish_candle_ratio": "len(list_filter(range(1, 17), lambda i: c[i] > o[i])) / 16.0", "bearish_candle_ratio": "len(list_filter(range(1, 17), lambda i: c[i] < o[i])) / 16.0",
    "inside_bar_ratio": "len(list_filter(range(2, 17), lambda i: h[i] <= h[i - 1] AND l[i] >= l[i - 1])) / 15.0", "outside_bar_ratio": "len(list_filter(range(2, 17), lambda i: h[i] >= h[i - 1] AND l[i] <= l[i - 1])) / 15.0",
    "close_location_value_mean": "CASE WHEN flat THEN NULL ELSE list_avg(list_transform(range(1, 17), lambda i: (c[i] - l[i]) / (h[i] - l[i]))) END",
    "upper_wick_ratio_mean": "CASE WHEN flat THEN NULL ELSE list_avg(list_transform(range(1, 17), lambda i: (h[i] - greatest(o[i], c[i])) / (h[i] - l[i]))) END",
    "lower_wick_ratio_mean": "CASE WHEN flat THEN NULL ELSE list_avg(list_transform(range(1, 17), lambda i: (least(o[i], c[i]) - l[i]) / (h[i] - l[i]))) END",
    "relative_volume_mean": "CAST(1 AS DOUBLE)", "volume_expansion_ratio": "list_avg(v[9:16]) / list_avg(v[1:8])", "high_volume_location": "(list_position(v, list_max(v)) - 1) / 15.0", "normalized_endpoint_return": "ln(c[16] / c[1])",
    "volatility_first_half": _HALF(1, 7), "volatility_second_half": _HALF(8, 15),
    "momentum_acceleration": "list_sum(r[8:15]) - list_sum(r[1:7])", "volatility_expansion_ratio": f"{_HALF(8, 15)} / {_HALF(1, 7)}", "realized_volatility": "sd",
    "lag_1_autocorrelation": _CORR("r[1:14]", "r[2:15]"), "lag_2_autocorrelation": _CORR("r[1:13]", "r[3:15]"), "ar_1_coefficient": _CORR("r[1:14]", "r[2:15]"),
    "return_skewness": "list_avg(list_transform(r, lambda x: (x - list_avg(r)) ** 3)) / sd ** 3", "return_kurtosis": "list_avg(list_transform(r, lambda x: (x - list_avg(r)) ** 4)) / sd ** 4",
    "return_mad": "list_median(list_transform(r, lambda x: abs(x - list_median(r))))", "downside_volatility": f"coalesce({_STD.format('neg')}, 0)", "upside_volatility": f"coalesce({_STD.format('pos')}, 0)",
    "volatility_asymmetry": f"coalesce({_STD.format('pos')}, 0) - coalesce({_STD.format('neg')}, 0)", "upper_tail_ratio": "list_aggregate(r, 'quantile_cont', 0.95) / sd", "lower_tail_ratio": "abs(list_aggregate(r, 'quantile_cont', 0.05)) / sd",
    "variance_ratio_2": f"pow({_STD.format('s2')}, 2) / (2 * sd * sd)", "variance_ratio_4": f"pow({_STD.format('s4')}, 2) / (4 * sd * sd)",
    "path_displacement": "abs(p[64] - p[1])", "path_length": "list_sum(list_transform(d, lambda x: abs(x)))", "path_efficiency_ratio": "abs(p[64] - p[1]) / list_sum(list_transform(d, lambda x: abs(x)))",
    "maximum_drawdown_normalized": "list_max(list_transform(range(1, 65), lambda i: list_max(p[1:i]) - p[i]))", "maximum_runup_normalized": "list_max(list_transform(range(1, 65), lambda i: p[i] - list_min(p[1:i])))",
    "endpoint_position_in_range": "(p[64] - list_min(p)) / (list_max(p) - list_min(p))", "linear_regression_slope": "slope", "lsma_slope": "slope", "linear_regression_intercept": "list_avg(p) - slope / 2", "lsma_endpoint": "list_avg(p) + slope / 2",
    "linear_regression_r_squared": f"slope * slope * {_XX} / list_sum(list_transform(p, lambda x: (x - list_avg(p)) * (x - list_avg(p))))",
    "linear_regression_residual_std": f"sqrt((list_sum(list_transform(p, lambda x: (x - list_avg(p)) * (x - list_avg(p)))) - slope * slope * {_XX}) / 64)",
    "trend_direction_consistency": "abs(list_avg(list_transform(d, lambda x: sign(x))))", "range_expansion_ratio": "(list_max(p[33:64]) - list_min(p[33:64])) / (list_max(p[1:32]) - list_min(p[1:32]))",
    "turning_point_count": "CAST(len(list_filter(range(2, len(moves) + 1), lambda i: moves[i] <> moves[i - 1])) AS DOUBLE)", "turning_point_density": "len(list_filter(range(2, len(moves) + 1), lambda i: moves[i] <> moves[i - 1])) / 62",
    "permutation_entropy": "-list_sum(list_transform(list_distinct(orders), lambda o: len(list_filter(orders, lambda x: x = o)) / 62 * ln(len(list_filter(orders, lambda x: x = o)) / 62))) / ln(6)",
    "sample_entropy": f"-ln({_ALIKE(3)} / {_ALIKE(2)})", "body_to_range_std": f"CASE WHEN flat THEN NULL ELSE {_STD.format('body')} END",
    "volume_coefficient_of_variation": f"{_STD.format('v')} / list_avg(v)", "volume_trend_slope": "list_sum(list_transform(range(1, 17), lambda i: ((i - 1) / 15 - 0.5) * v[i])) / list_avg(v) / list_sum(list_transform(range(1, 17), lambda i: ((i - 1) / 15 - 0.5) * ((i - 1) / 15 - 0.5)))",
    "volume_absolute_return_correlation": _CORR("v[2:16]", "a"),
}
ORACLE_SQL = {
    "bars_h4": f"WITH {_BARS} SELECT instrument, timeframe, ts, {_R6('open', 'high', 'low', 'close', 'volume')} FROM bars",
    "bars_d1": f"WITH {_D1} SELECT instrument, timeframe, ts, {_R6('open', 'high', 'low', 'close', 'volume')} FROM bars",
    "window_counts": f"""WITH {_BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) AS k FROM bars), len AS (SELECT unnest([8, 16, 32, 64])::INT AS length)
      SELECT b.instrument, b.timeframe, length, count(*) AS n_windows, min(a.ts) AS first_start, max(b.ts) AS last_end FROM n b, len JOIN n a ON a.instrument = b.instrument AND a.k = b.k - length + 1 GROUP BY ALL""",
    "window_flags": f"""WITH {_BARS.replace("'H4'", "'H1'").replace('4 hours', '1 hour')}, g AS (
      SELECT *, greatest(floor((epoch_us(ts) - epoch_us(lag(ts) OVER s)) / 3600000000.0) - 1, 0) AS gap, row_number() OVER s AS k FROM bars WINDOW s AS (PARTITION BY instrument ORDER BY ts)),
      m AS (SELECT *, CAST(coalesce(sum(gap) OVER (PARTITION BY instrument ORDER BY ts ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS missing_bars FROM g)
      SELECT instrument, timeframe, ts AS end_ts, missing_bars, CASE WHEN missing_bars > 0 THEN 'EXTREME_GAP,MISSING_BARS' ELSE 'NONE' END AS flags FROM m WHERE k >= 16""",
    "outcome_labels": f"""WITH {_LABELS} SELECT instrument, end_ts, CAST(available AS INT) AS available, is_complete, {_R6('simple_return', 'log_return', 'mfe', 'mae')}, CAST(mfe_bar AS BIGINT) AS mfe_bar, CAST(mae_bar AS BIGINT) AS mae_bar,
      direction_class, continuation, barrier_5, barrier_10, barrier_20, first_barrier, CASE barrier_10 WHEN 'UP_FIRST' THEN 'GAIN_FIRST' WHEN 'DOWN_FIRST' THEN 'GAIN_AFTER_DRAWDOWN_UNKNOWN' ELSE barrier_10 END AS gain_sequence,
      CASE barrier_10 WHEN 'UP_FIRST' THEN 'DRAWDOWN_AFTER_GAIN_UNKNOWN' WHEN 'DOWN_FIRST' THEN 'DRAWDOWN_FIRST' ELSE barrier_10 END AS drawdown_sequence FROM labels_""",
    "outcome_summary": f"""WITH {_LABELS} SELECT instrument, direction_class, count(*) AS n, round(avg(simple_return), 6) AS avg_return, round(avg(mfe), 6) AS avg_mfe, round(avg(mae), 6) AS avg_mae FROM labels_ WHERE is_complete GROUP BY ALL""",
    "outcome_paths": f"""WITH {_LABELS}, s AS (SELECT instrument, end_ts, list_transform(range(1, 6), lambda i: ln(fc[i] / CASE WHEN i = 1 THEN c[16] ELSE fc[i - 1] END)) AS r FROM labels_ WHERE is_complete)
      SELECT instrument, end_ts, round(sqrt(list_sum(list_transform(r, lambda x: (x - list_avg(r)) * (x - list_avg(r)))) / 4), 6) AS realized_volatility, round(abs(list_sum(r)) / list_sum(list_transform(r, lambda x: abs(x))), 6) AS path_efficiency FROM s""",
    "window_features": f"""WITH {_WIN}, w0 AS (SELECT *, {_RET} AS r, {_NORMS['anchored_log_return']} AS n, len(list_filter(range(1, 17), lambda i: h[i] - l[i] <= 0)) > 0 AS flat FROM win),
      w1 AS (SELECT *, {_PATH} AS p, {_STD.format('r')} AS sd, list_transform(r, lambda x: abs(x)) AS a, list_filter(r, lambda x: x < 0) AS neg, list_filter(r, lambda x: x > 0) AS pos, list_transform(range(1, 17), lambda i: abs(c[i] - o[i]) / (h[i] - l[i])) AS body,
        list_transform(range(1, 15), lambda i: r[i] + r[i + 1]) AS s2, list_transform(range(1, 13), lambda i: r[i] + r[i + 1] + r[i + 2] + r[i + 3]) AS s4 FROM w0),
      w2 AS (SELECT *, list_transform(range(1, 64), lambda i: p[i + 1] - p[i]) AS d, 0.2 * {_STD.format('p')} AS radius, list_sum(list_transform(range(1, 65), lambda i: ((i - 1) / 63 - 0.5) * p[i])) / {_XX} AS slope,
        list_transform(range(1, 63), lambda i: CAST(p[i] <= p[i + 1] AS INT) * 4 + CAST(p[i + 1] <= p[i + 2] AS INT) * 2 + CAST(p[i] <= p[i + 2] AS INT)) AS orders FROM w1),
      w AS (SELECT *, list_transform(list_filter(d, lambda x: abs(x) > 1e-12), lambda x: sign(x)) AS moves FROM w2)
      SELECT instrument, end_ts, {', '.join(f'round({e} + 0.0, 6) AS {n}' for n, e in _FEATURE_SQL.items())} FROM w""",
    "analogues": f"WITH {_WIN}{_PAIRS} SELECT instrument, q_end, CAST(rank AS INT) AS rank, c_end, round(distance, 6) AS distance FROM ranked WHERE rank <= 3",
    "embedding_neighbours": """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT q.vec_id AS q_id, c.vec_id AS c_id, round(1 - list_cosine_similarity(q.e, c.e), 6) AS distance
      FROM v q JOIN v c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
      SELECT q_id, c_id, distance, CAST(row_number() OVER (PARTITION BY q_id ORDER BY distance, c_id) AS INT) AS rank FROM p QUALIFY rank <= 5""",
    "neighbour_forecast": f"""WITH {_NEAR}, u AS (SELECT *, 1.0 / rank AS w FROM near) SELECT instrument, q_end AS end_ts, count(*) AS neighbours, round(sum(CASE WHEN x > 0 THEN w ELSE 0 END) / sum(w), 6) AS positive,
      round(sum(CASE WHEN x < 0 THEN w ELSE 0 END) / sum(w), 6) AS negative, round(sum(w * x) / sum(w), 6) AS mean_return, round(quantile_cont(x, 0.5), 6) AS median_return, round(quantile_cont(x, 0.1), 6) AS q10,
      round(quantile_cont(x, 0.9), 6) AS q90, round(coalesce(stddev_samp(x), 0.0), 6) AS std_return, round(least(greatest(sum(w) * sum(w) / sum(w * w), 1.0), count(*)), 6) AS effective_size FROM u GROUP BY ALL""",
    "validation_metrics": f"""WITH {_EVAL}, z AS (SELECT *, p >= 0.5 AS g, least(greatest(p, 1e-12), 1 - 1e-12) AS pc FROM ev), a AS (SELECT instrument, count(*) AS n, count(*) FILTER (WHERE g AND up) AS tp, count(*) FILTER (WHERE NOT g AND NOT up) AS tn,
      count(*) FILTER (WHERE g AND NOT up) AS fp, count(*) FILTER (WHERE NOT g AND up) AS fn, avg((p - up::INT) * (p - up::INT)) AS brier_score, avg(-CASE WHEN up THEN ln(pc) ELSE ln(1 - pc) END) AS log_loss, avg(abs(actual - predicted)) AS mae,
      sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse, avg((greatest(0.1 * (actual - q10), -0.9 * (actual - q10)) + greatest(0.5 * (actual - q50), -0.5 * (actual - q50)) + greatest(0.9 * (actual - q90), -0.1 * (actual - q90))) / 3) AS pinball_loss
      FROM z GROUP BY instrument) SELECT instrument, n, {_R6('brier_score', 'log_loss', 'mae', 'rmse', 'pinball_loss')}, round(mae, 6) AS empirical_crps, round((tp + tn) / greatest(n, 1), 6) AS direction_accuracy,
      round((tp / greatest(tp + fn, 1) + tn / greatest(tn + fp, 1)) / 2, 6) AS balanced_accuracy, round((tp * tn - fp * fn) / sqrt(greatest(CAST((tp + fp) * (tp + fn) AS DOUBLE) * ((tn + fp) * (tn + fn)), 1.0)), 6) AS matthews_correlation,
      round(1 - brier_score / 0.25, 6) AS brier_skill_score FROM a""",
    "validation_calibration": f"""WITH {_EVAL}, b AS (SELECT *, CAST(least(len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[], lambda e: p >= e)), 9) AS INT) AS bin FROM ev),
      t AS (SELECT instrument, bin, count(*) AS n, avg(p) AS confidence, avg(up::INT) AS frequency FROM b GROUP BY ALL), every AS (SELECT instrument, CAST(unnest(range(10)) AS INT) AS bin FROM (SELECT DISTINCT instrument FROM ev))
      SELECT e.instrument, e.bin, coalesce(n, 0) AS n, round(confidence, 6) AS confidence, round(frequency, 6) AS frequency, round(abs(confidence - frequency), 6) AS gap FROM every e LEFT JOIN t ON t.instrument = e.instrument AND t.bin = e.bin""",
    "eligibility_reasons": f"""WITH {_WIN}, e AS (SELECT instrument, bar_no, epoch_us(start_ts) / 1e6 AS s, epoch_us(end_ts) / 1e6 AS e FROM win), q AS (SELECT * FROM e WHERE bar_no % 50 = 0),
      p AS (SELECT q.instrument, q.s AS qs, q.e AS qe, c.s AS cs, c.e AS ce, q.e + (q.e - q.s) / 15 * 5 AS qo, c.e + (c.e - c.s) / 15 * 5 AS co, c.instrument = q.instrument AND c.e = q.e AS same FROM q, e c)
      SELECT instrument, CASE WHEN same THEN 'SAME_QUERY' WHEN ce >= qe THEN 'FUTURE_OR_CONTEMPORARY' WHEN ce > qe - greatest(qe - qs, ce - cs) / 15 * 3 THEN 'EMBARGO_OR_TEMPORAL_DISTANCE' WHEN cs <= qe AND qs <= ce THEN 'SOURCE_OVERLAP'
      WHEN cs <= qo AND qe <= ce THEN 'CANDIDATE_SOURCE_OVERLAPS_QUERY_OUTCOME' WHEN ce <= qe AND qs <= co THEN 'CANDIDATE_OUTCOME_OVERLAPS_QUERY_SOURCE' WHEN ce <= qo AND qe <= co THEN 'OUTCOME_OVERLAP' ELSE 'ELIGIBLE' END AS reason, count(*) AS n FROM p GROUP BY ALL""",
    "walk_forward_folds": f"""WITH {_WIN}, w AS (SELECT end_ts, row_number() OVER (ORDER BY end_ts) - 1 AS n FROM win), f AS (SELECT unnest([1, 2, 3])::INT AS fold)
      SELECT fold, max(CASE WHEN n = 0 THEN end_ts END) AS index_start, max(CASE WHEN n = 4 + (fold - 1) * 3 THEN end_ts END) AS index_end, max(CASE WHEN n = 5 + (fold - 1) * 3 THEN end_ts END) AS test_start, max(CASE WHEN n = 7 + (fold - 1) * 3 THEN end_ts END) AS test_end FROM w, f GROUP BY fold""",
    "row_validation": """WITH r AS (SELECT event_id AS row_no, event_type, CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 89 = 0 THEN date_trunc('hour', ts) ELSE ts END AS ts, value AS o, CASE WHEN event_id % 97 = 0 THEN value - 1 ELSE value + 1 END AS h,
      value - 1 AS l, CASE WHEN event_id % 83 = 0 THEN NULL ELSE value END AS c, CASE WHEN event_id % 79 = 0 THEN -1.0 ELSE 1.0 END AS v FROM events),
      x AS (SELECT *, row_number() OVER (PARTITION BY event_type, ts ORDER BY row_no) AS seen, last_value(ts IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
      e AS (SELECT row_no, concat_ws(',', CASE WHEN ts IS NULL THEN 'INVALID_TIMESTAMP' END, CASE WHEN ts IS NOT NULL AND seen > 1 THEN 'DUPLICATE_TIMESTAMP' END, CASE WHEN seen = 1 AND ts < before THEN 'OUT_OF_ORDER' END, CASE WHEN c IS NULL THEN 'NON_FINITE_CLOSE' END) AS first,
        concat_ws(',', CASE WHEN least(o, h, l, c) <= 0 THEN 'NON_POSITIVE_PRICE' END, CASE WHEN v < 0 THEN 'NEGATIVE_VOLUME' END, CASE WHEN h < greatest(o, c, l) THEN 'HIGH_BELOW_PRICES' END, CASE WHEN l > least(o, c, h) THEN 'LOW_ABOVE_PRICES' END) AS second FROM x)
      SELECT row_no, CASE WHEN first <> '' THEN first ELSE second END AS errors, first = '' AND second = '' AS accepted FROM e""",
    "quality_profile": f"""WITH {_BARS.replace("'H4'", "'H1'").replace('4 hours', '1 hour')}, d AS (SELECT *, abs(close / lag(close) OVER s - 1) AS change, (epoch_us(ts) - epoch_us(lag(ts) OVER s)) / 1e6 AS delta FROM bars WINDOW s AS (PARTITION BY instrument ORDER BY ts)),
      m AS (SELECT instrument, delta AS modal_delta FROM (SELECT instrument, delta, count(*) AS k FROM d WHERE delta IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY k DESC, delta) = 1),
      p AS (SELECT d.instrument, timeframe, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts, any_value(modal_delta) AS modal_delta, count(*) FILTER (WHERE high < greatest(open, close, low) OR low > least(open, close, high)) AS invalid_ohlc,
        count(*) FILTER (WHERE least(open, high, low, close) <= 0) AS non_positive, avg(CASE WHEN volume = 0 THEN 1.0 ELSE 0.0 END) AS empty_volume_rate, count(*) FILTER (WHERE change > 0.2) AS moves_over_20, count(*) FILTER (WHERE change > 0.45) AS moves_over_45, count(*) FILTER (WHERE change > 0.6) AS moves_over_60,
        count(*) FILTER (WHERE delta > 3 * modal_delta) AS large_gaps, count(*) FILTER (WHERE delta > modal_delta) AS gaps FROM d JOIN m ON m.instrument = d.instrument GROUP BY 1, 2)
      SELECT *, invalid_ohlc + non_positive AS hard_errors, CASE WHEN invalid_ohlc + non_positive > 0 AND bars <= invalid_ohlc + non_positive THEN 'REJECTED' WHEN invalid_ohlc + non_positive > 0 THEN 'MANUAL_REVIEW'
        WHEN empty_volume_rate > 0 OR moves_over_20 > 0 OR large_gaps > 0 THEN 'ACCEPTED_WITH_WARNINGS' ELSE 'ACCEPTED' END AS decision FROM p""",
    "significance": f"""WITH {_EVAL}, h AS (SELECT instrument AS test, count(*) AS n, count(*) FILTER (WHERE (p >= 0.5) = up) AS k FROM ev GROUP BY 1), z AS (SELECT test, abs(k / n - 0.5) / sqrt(0.25 / n) / sqrt(2) AS z FROM h),
      t AS (SELECT test, CASE WHEN z = 0 THEN 1.0 ELSE 1 - 2 / sqrt(pi()) * exp(-z * z) * list_sum(list_transform(range(120), lambda i: exp((2 * i + 1) * ln(z) + i * ln(4) + lgamma(i + 1) - lgamma(2 * i + 2)))) END AS p_value FROM z), r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p_value, test) AS k FROM t)
      SELECT test, round(p_value, 6) AS p_value, round(least(min(p_value * m / k) OVER (ORDER BY p_value, test ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 6) AS p_bh,
      round(least(max(p_value * (m - k + 1)) OVER (ORDER BY p_value, test ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0), 6) AS p_holm FROM r""",
    "prospective_fallback": f"""WITH {_LABELS}, c AS (SELECT *, CASE WHEN source_return > 0 THEN 'UP' ELSE 'DOWN' END AS trend, CASE WHEN abs(source_return) > 0.5 THEN 'HIGH' ELSE 'LOW' END AS volatility FROM labels_),
      q AS (SELECT instrument, end_ts AS as_of, trend, volatility FROM c),
      s AS (SELECT q.instrument, q.as_of, q.trend, q.volatility, count(*) FILTER (WHERE h.trend = q.trend AND h.volatility = q.volatility) AS n1, count(*) FILTER (WHERE h.trend = q.trend) AS n2, count(h.end_ts) AS n3,
        count(*) FILTER (WHERE h.trend = q.trend AND h.volatility = q.volatility AND h.simple_return > 0) AS k1, count(*) FILTER (WHERE h.trend = q.trend AND h.simple_return > 0) AS k2, count(*) FILTER (WHERE h.simple_return > 0) AS k3
        FROM q LEFT JOIN c h ON h.instrument = q.instrument AND h.is_complete AND h.end_ts < q.as_of GROUP BY 1, 2, 3, 4)
      SELECT instrument, CAST(5 AS INT) AS horizon, as_of, CASE WHEN n1 >= 30 THEN 'trend_volatility' WHEN n2 >= 30 THEN 'trend_only' ELSE 'unconditional' END AS level, CASE WHEN n1 >= 30 THEN n1 WHEN n2 >= 30 THEN n2 ELSE n3 END AS n,
      round((CASE WHEN n1 >= 30 THEN k1 WHEN n2 >= 30 THEN k2 ELSE k3 END + 1) / (CASE WHEN n1 >= 30 THEN n1 WHEN n2 >= 30 THEN n2 ELSE n3 END + 2), 6) AS p, round(k3 / CASE WHEN n3 > 0 THEN n3 END, 6) AS baseline, greatest(n1, n2, n3) < 30 AS insufficient FROM s""",
    "distance_deciles": f"""WITH {_NEAR}, d AS (SELECT n.instrument, n.q_end, n.c_end, n.distance, abs(n.x - o.simple_return) AS v FROM near n JOIN labels_ o ON o.instrument = n.instrument AND o.end_ts = n.q_end AND o.is_complete),
      i AS (SELECT *, row_number() OVER (ORDER BY distance) - 1 AS i, count(*) OVER () AS m FROM d) SELECT CAST(least(i * 10 // m + 1, 10) AS INT) AS decile, count(*) AS n, round(min(distance), 6) AS low, round(max(distance), 6) AS high, round(avg(v), 6) AS mean_value FROM i GROUP BY 1""",
    "provider_comparison": f"""WITH {_D1}, a AS (SELECT instrument, CAST(ts AS DATE) AS day, close FROM bars), b AS (SELECT instrument, day, close * CASE WHEN day(day) % 2 = 0 THEN 1.01 ELSE 1.0 END AS close FROM a WHERE day(day) <> 13),
      m AS (SELECT a.instrument, a.day, a.close AS ca, b.close AS cb FROM a LEFT JOIN b ON b.instrument = a.instrument AND b.day = a.day),
      r AS (SELECT *, ca / lag(ca) OVER w - 1 AS ra, cb / lag(cb) OVER w - 1 AS rb FROM m WHERE cb IS NOT NULL WINDOW w AS (PARTITION BY instrument ORDER BY day)),
      t AS (SELECT instrument, count(*) AS common_days, corr(ra, rb) AS return_correlation, quantile_cont(abs(ca - cb), 0.5) AS median_abs_diff, quantile_cont(abs(ca - cb), 0.95) AS p95_abs_diff, quantile_cont(ca / cb, 0.5) AS scale_ratio FROM r GROUP BY 1)
      SELECT m.instrument, count(*) FILTER (WHERE cb IS NULL) AS only_a, CAST(0 AS BIGINT) AS only_b, common_days, round(return_correlation, 4) AS return_correlation, round(median_abs_diff, 4) AS median_abs_diff, round(p95_abs_diff, 4) AS p95_abs_diff,
      round(scale_ratio, 4) AS scale_ratio, CASE WHEN coalesce(return_correlation, 0) < 0.85 THEN 'REVIEW_REQUIRED' ELSE 'OK' END AS verdict FROM m JOIN t ON t.instrument = m.instrument GROUP BY ALL""",
}
ORACLE_SQL["forecast_evaluation"] = f"""WITH f AS ({ORACLE_SQL['prospective_fallback']}), o AS ({ORACLE_SQL['outcome_labels'].replace('simple_return + 0.0, 6', 'simple_return + 0.0, 12')}),
  m AS (SELECT f.*, o.simple_return > 0 AS up FROM f JOIN o ON o.instrument = f.instrument AND o.end_ts = f.as_of AND o.is_complete WHERE NOT f.insufficient)
  SELECT horizon, count(*) AS n, round(avg(CAST((p >= 0.5) = up AS INT)), 6) AS accuracy, round(avg((p - up::INT) * (p - up::INT)), 6) AS brier, round(avg((baseline - up::INT) * (baseline - up::INT)), 6) AS brier_baseline,
  round(1 - avg((p - up::INT) * (p - up::INT)) / avg((baseline - up::INT) * (baseline - up::INT)), 6) AS skill FROM m GROUP BY horizon""".replace(", 6) AS p,", ", 15) AS p,").replace(", 6) AS baseline", ", 15) AS baseline")
ORACLE_SQL |= {f"norm_{m}": _norm_sql(e) for m, e in _NORMS.items()}
_FEATURES_OF = ORACLE_SQL["window_features"].rpartition("SELECT instrument, end_ts,")[0]
_COSINE = lambda a, b, w="1.0": f"(1 - list_sum(list_transform(j, lambda i: {a}[i] * {b}[i] * {w} * {w})) / (sqrt(list_sum(list_transform(j, lambda i: {a}[i] * {a}[i] * {w} * {w}))) * sqrt(list_sum(list_transform(j, lambda i: {b}[i] * {b}[i] * {w} * {w})))))"
_SHAPE = "sqrt(list_avg(list_transform(range(1, 65), lambda i: (qp[i] - kp[i]) * (qp[i] - kp[i]))))"
_DISTANCES = {
    "shape_correlation_v1": f"1 - {_CORR('qp', 'kp')}", "dna_cosine_v1": _COSINE("qx", "kx"), "dna_robust_cosine_v1": f"{_COSINE('qy', 'ky')} + 1 - share",
    "dna_robust_euclidean_v1": "sqrt(list_avg(list_transform(j, lambda i: (qy[i] - ky[i]) * (qy[i] - ky[i])))) + 1 - share", "dna_group_balanced_v1": f"{_COSINE('qy', 'ky', 'w[i]')} + 1 - share",
    "market_analogue_v1": f"0.45 * {_SHAPE} + 0.45 * {_COSINE('qx', 'kx')} + 0.10 * away", "shape_dna_context_v2": f"0.34 * {_SHAPE} + 0.33 * ({_COSINE('qy', 'ky')} + 1 - share) + 0.33 * away",
}
ORACLE_SQL["analogue_methods"] = f"""{_FEATURES_OF.rstrip()}, vec AS (SELECT instrument, end_ts, bar_no, p, [{', '.join(f'CAST({_FEATURE_SQL.get(n, "NULL")} AS DOUBLE)' for n in features.NAMES)}] AS x FROM w),
  both_ AS (SELECT *, list_transform(x, lambda e: sign(e) * ln(1 + abs(e))) AS y FROM vec),
  pair AS (SELECT q.instrument, q.end_ts AS q_end, k.end_ts AS c_end, q.p AS qp, k.p AS kp, q.x AS qx, k.x AS kx, q.y AS qy, k.y AS ky, list_filter(range(1, 76), lambda i: q.x[i] IS NOT NULL AND k.x[i] IS NOT NULL) AS j,
    1 - (5 + CAST((q.p[64] > 0) = (k.p[64] > 0) AS INT) + CAST((abs(q.p[64]) > 0.5) = (abs(k.p[64]) > 0.5) AS INT)) / 7 AS away FROM both_ q JOIN both_ k ON k.instrument = q.instrument AND k.end_ts < q.end_ts WHERE q.bar_no % 50 = 0),
  weighed AS (SELECT *, len(j) / 75 AS share, list_transform(range(1, 76), lambda i: 1.0 / greatest(len(list_filter(j, lambda t: (g)[t] = (g)[i])), 1)) AS w FROM pair, (SELECT [{', '.join(f"'{features.GROUP_OF[n]}'" for n in features.NAMES)}] AS g)),
  scored AS ({' UNION ALL '.join(f"SELECT '{m}' AS method, instrument, q_end, c_end, {e} AS distance FROM weighed" for m, e in _DISTANCES.items())})
  SELECT method, instrument, q_end, CAST(row_number() OVER (PARTITION BY method, instrument, q_end ORDER BY distance, c_end) AS INT) AS rank, c_end, round(distance, 6) AS distance FROM scored QUALIFY rank <= 3"""
ORACLE_SQL["validation_run"] = f"""WITH {_LABELS}{_PAIRS.split(', pairs AS')[0]}, e AS (SELECT list(end_ts ORDER BY end_ts) AS e, count(*) AS n FROM shape), f AS (SELECT *, unnest([1, 2, 3])::INT AS fold FROM e),
      g AS (SELECT fold, e[n * 2 // 5 + (fold - 1) * (n // 5)] AS until, e[n * 2 // 5 + (fold - 1) * (n // 5) + 1] AS a, e[least(n * 2 // 5 + fold * (n // 5), n)] AS z FROM f),
      q AS (SELECT s.*, g.fold, g.until, unnest([1, 5])::INT AS horizon FROM shape s JOIN g ON s.end_ts BETWEEN g.a AND g.z),
      m AS (SELECT q.fold, q.horizon, q.instrument, q.end_ts AS q_end, k.end_ts AS c_end, row_number() OVER (PARTITION BY q.fold, q.horizon, q.instrument, q.end_ts ORDER BY sqrt(list_sum(list_transform(range(1, 65), lambda i: (q.p[i] - k.p[i]) * (q.p[i] - k.p[i]))) / 64), k.end_ts) AS rank
        FROM q JOIN shape k ON k.instrument = q.instrument AND k.end_ts <= q.until AND epoch_us(k.end_ts) + (epoch_us(k.end_ts) - epoch_us(k.start_ts)) / 15.0 * q.horizon < epoch_us(q.start_ts)),
      r AS (SELECT instrument, end_ts, unnest([1, 5])::INT AS horizon, unnest([fc[1], fc[5]]) / c[16] - 1 AS x FROM labels_), v AS (SELECT *, unnest([5, 10])::INT AS k FROM m),
      t AS (SELECT v.fold, v.horizon, v.k, v.instrument, v.q_end, avg(CASE WHEN o.x > 0 THEN 1.0 ELSE 0.0 END) AS p, avg(o.x) AS predicted FROM v JOIN r o ON o.instrument = v.instrument AND o.end_ts = v.c_end AND o.horizon = v.horizon AND o.x IS NOT NULL WHERE v.rank <= v.k GROUP BY ALL)
      SELECT t.fold, 'shape_euclidean_v1' AS method, t.horizon, t.k, count(*) AS n, round(avg((p - (o.x > 0)::INT) * (p - (o.x > 0)::INT)), 6) AS brier_score, round(avg(abs(o.x - predicted)), 6) AS mae, round(avg(((p >= 0.5) = (o.x > 0))::INT), 6) AS direction_accuracy,
      round(1 - avg((p - (o.x > 0)::INT) * (p - (o.x > 0)::INT)) / 0.25, 6) AS brier_skill_score FROM t JOIN r o ON o.instrument = t.instrument AND o.end_ts = t.q_end AND o.horizon = t.horizon AND o.x IS NOT NULL GROUP BY ALL"""
_PLACED = f"WITH {_D1}, n AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY instrument) AS m, ntile(7) OVER w AS chunk FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY ts))"
_TS = "ts::TIMESTAMP"
ORACLE_SQL |= {
    "evenly_spaced_bars": f"{_PLACED} SELECT instrument, timeframe, {_TS} AS ts FROM n WHERE m <= 7 OR list_contains(list_transform(range(7), lambda k: CAST(floor(k * (m - 1) / 6) AS BIGINT)), i)",
    "chronological_parts": f"{_PLACED} SELECT instrument, CASE WHEN i / m < 0.6 THEN 1 WHEN i / m < 0.8 THEN 2 ELSE 3 END AS part, count(*) AS n, min({_TS}) AS first_ts, max({_TS}) AS last_ts FROM n GROUP BY 1, 2",
    "even_chunks": f"{_PLACED} SELECT instrument, CAST(chunk AS INT) AS chunk, count(*) AS n, max({_TS}) AS last_ts FROM n GROUP BY 1, 2",
    "bars_page": f"WITH {_BARS} SELECT instrument, timeframe, ts, {_R6('open', 'high', 'low', 'close', 'volume')} FROM bars ORDER BY ts, instrument LIMIT 50 OFFSET 150",
    "bars_in_range": f"WITH {_BARS} SELECT instrument, timeframe, ts, {_R6('open', 'high', 'low', 'close', 'volume')} FROM bars WHERE volume >= 3 AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20'",
    "latest_bars": f"WITH {_BARS} SELECT instrument, timeframe, ts, {_R6('open', 'high', 'low', 'close', 'volume')} FROM bars QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY ts DESC) = 1",
    "customers_of_all_priorities": "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)",
    "customer_universes": """WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders), j AS (SELECT a.k AS x, b.k AS y FROM a FULL JOIN b ON a.k = b.k)
      SELECT count(*) FILTER (WHERE y IS NULL) AS only_a, count(*) FILTER (WHERE x IS NULL) AS only_b, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS in_both, count(*) FILTER (WHERE x IS NULL OR y IS NULL) = 0 AS equal FROM j""",
    "contained_spans": """WITH s AS (SELECT event_type, user_id, min(ts) AS start_ts, max(ts) AS end_ts FROM events GROUP BY 1, 2)
      SELECT * FROM s i WHERE EXISTS (SELECT 1 FROM s o WHERE o.user_id % 50 = 0 AND o.event_type = i.event_type AND o.start_ts <= i.start_ts AND o.end_ts >= i.end_ts)""",
    "direction_counts": f"""WITH {_LABELS}, t AS (SELECT instrument, direction_class AS k, count(*) AS n FROM labels_ GROUP BY ALL) SELECT instrument, '{{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}}' AS counts FROM t GROUP BY 1""",
    "outcome_completeness": f"""WITH {_WIN}, m AS (SELECT instrument, bar_no, max(bar_no) OVER (PARTITION BY instrument) AS last FROM win), h AS (SELECT *, unnest([1, 5, 20]) AS h FROM m)
      SELECT instrument, count(*) FILTER (WHERE bar_no + h <= last) AS complete, count(DISTINCT bar_no) AS windows, CAST(3 AS BIGINT) AS horizons, round(count(*) FILTER (WHERE bar_no + h <= last) / count(*), 6) AS complete_rate FROM h GROUP BY 1""",
    "strict_confusion": f"""WITH {_EVAL}, c AS (SELECT instrument, CAST(count(*) FILTER (WHERE p >= 0.5 AND up) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE p < 0.5 AND NOT up) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE p >= 0.5 AND NOT up) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE p < 0.5 AND up) AS DOUBLE) AS fn FROM ev GROUP BY 1)
      SELECT *, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy, round((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS matthews FROM c""",
    "calibration_intervals": f"""WITH {_EVAL}, t AS (SELECT instrument, CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, avg(p) AS confidence, avg(up::INT) AS frequency FROM ev GROUP BY 1, 2)
      SELECT instrument, bin, n, round(confidence, 6) AS confidence, round(frequency, 6) AS frequency, round(greatest(frequency - 1.96 * sqrt(frequency * (1 - frequency) / n), 0) + 0.0, 6) AS low, round(least(frequency + 1.96 * sqrt(frequency * (1 - frequency) / n), 1), 6) AS high FROM t""",
    "instrument_warnings": """SELECT DISTINCT o_orderpriority, CASE o_orderpriority[1] WHEN '1' THEN 'PROVIDER_DATA_RESEARCH_ONLY,POSSIBLE_RETROACTIVE_PROVIDER_REVISION,PRICE_ADJUSTMENT_PROVIDER_CONTROLLED,CRYPTO_SINGLE_VENUE_OR_AGGREGATED_SOURCE'
      WHEN '2' THEN 'PROVIDER_DATA_RESEARCH_ONLY,FOREX_VOLUME_UNAVAILABLE,CRYPTO_SINGLE_VENUE_OR_AGGREGATED_SOURCE' WHEN '3' THEN 'PROVIDER_DATA_RESEARCH_ONLY,FUTURES_CONTINUOUS_CONTRACT_UNVERIFIED' WHEN '4' THEN 'PROVIDER_DATA_RESEARCH_ONLY,CRYPTO_SINGLE_VENUE_OR_AGGREGATED_SOURCE' ELSE '' END AS warnings FROM orders""",
}

_BASE = f"""WITH {_LABELS}, c AS (SELECT instrument, end_ts, is_complete, bar_no, CASE WHEN source_return > 0 THEN 'UP' ELSE 'DOWN' END AS trend, CASE WHEN abs(source_return) > 0.5 THEN 'HIGH' ELSE 'LOW' END AS volatility FROM labels_),
  q AS (SELECT * FROM c WHERE bar_no % 50 = 0),
  p AS (SELECT q.instrument || '@' || CAST(q.end_ts AS VARCHAR) AS q_id, h.instrument || '@' || CAST(h.end_ts AS VARCHAR) AS c_id, h.end_ts AS c_end FROM q JOIN c h ON h.is_complete AND h.end_ts < q.end_ts WHERE @)
  SELECT q_id, c_id, CAST(row_number() OVER (PARTITION BY q_id ORDER BY #) AS INT) AS rank FROM p QUALIFY rank <= 10"""
_RULES = {"random_history": "true", "same_instrument_random": "q.instrument = h.instrument", "same_volatility_random": "q.volatility = h.volatility"}
ORACLE_SQL |= {f"baseline_{k}": _BASE.replace("@)", f"{rule})").replace("WHERE @", f"WHERE {rule}").replace("#", f"sha256('1|' || q_id || '|{k}_v1|' || c_id)") for k, rule in _RULES.items()}
ORACLE_SQL |= {
    "baseline_unconditional_outcome": _BASE.replace("WHERE @", "WHERE true").replace("#", "c_end, c_id"),
    "loss_summaries": f"""WITH {_EVAL}, m AS (SELECT *, strftime(q_end, '%Y-%m') AS month FROM ev) SELECT instrument, month, CAST(2 * grouping(instrument) + grouping(month) AS BIGINT) AS grouping, count(*) AS n,
      round(avg((p - up::INT) * (p - up::INT)), 6) AS brier, round(avg(abs(actual - predicted)), 6) AS mae FROM m GROUP BY GROUPING SETS ((instrument, month), (instrument), (month), ())""",
    "experiment_verdicts": f"""WITH m AS ({ORACLE_SQL['validation_metrics']}), g AS ({_EVAL_ALONE} SELECT instrument, avg(0.25 - (p - up::INT) * (p - up::INT)) - 1.96 * stddev_samp(0.25 - (p - up::INT) * (p - up::INT)) / sqrt(count(*)) AS low FROM ev GROUP BY 1)
      SELECT m.instrument, n, CASE WHEN n < 10 THEN 'INSUFFICIENT_DATA' WHEN brier_skill_score <= 0 OR direction_accuracy <= 0.5 THEN 'NO_SUPPORTED_EDGE' WHEN low > 0 AND n >= 50 THEN 'OUT_OF_SAMPLE_SUPPORTED' ELSE 'PROMISING' END AS verdict FROM m JOIN g ON g.instrument = m.instrument""",
    "run_timing": """WITH o AS (SELECT ts, event_type AS instrument, value > 100 AS new_bar FROM events WHERE event_id % 3 <> 0), f AS (SELECT instrument, min(CASE WHEN new_bar THEN strftime(ts, '%H:%M') END) AS e FROM o GROUP BY 1),
      d AS (SELECT count(DISTINCT CASE WHEN isodow(ts) <= 5 THEN CAST(ts AS DATE) END) AS weekdays, count(DISTINCT CASE WHEN isodow(ts) > 5 THEN CAST(ts AS DATE) END) AS weekend_days FROM o), s AS (SELECT max(e) AS slowest, count(*) FILTER (WHERE e IS NULL) AS silent, count(*) AS instruments FROM f)
      SELECT weekdays, weekend_days, instruments, silent, CASE WHEN weekdays >= 5 AND silent = 0 AND instruments > 0 THEN lpad(CAST((CAST(slowest[1:2] AS INT) + 2) % 24 AS VARCHAR), 2, '0') || slowest[3:5] END AS safe_time,
      CASE WHEN weekdays >= 5 AND silent = 0 AND instruments > 0 THEN 'SCHEDULER_TIMING_VALIDATED' ELSE 'SCHEDULER_TIMING_NOT_YET_VALIDATED' END AS status FROM d, s""",
    "provider_payloads": f"""WITH {_D1} SELECT instrument, CAST(ts AS TIMESTAMP) AS ts, {_R6('open', 'high', 'low', 'close')}, CASE WHEN instrument = '1-URGENT' THEN CAST(0 AS DOUBLE) ELSE volume END AS volume FROM bars""",
}
