"""Operators against hand-computed values, numpy and DuckDB."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.operators import context, diagnostics, features, normalize, outcomes, prospective, similarity, studies, validation, windows
from tidemark.plans import catalog
from tidemark.sources import bars as B
from tidemark.sources import providers

SF = "/root/testdata/sf0.001"
SCHEMA = "instrument string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def make_bars(spark, closes, highs=None, lows=None, skip=(), scale=1.0):
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i, c in enumerate(closes):
        if i not in skip:
            h, low = (highs or {}).get(i, c + 0.5 * scale), (lows or {}).get(i, c - 0.5 * scale)
            rows.append(("X", "H1", start + dt.timedelta(hours=i), c - 0.1 * scale, float(h), float(low), float(c), 1000.0 + i))
    return spark.createDataFrame(rows, SCHEMA)


def test_window_counts_and_rerun(spark):
    bars = make_bars(spark, range(100, 110))
    got = windows.sliding_windows(bars, (4,), seconds=3600)
    assert got.count() == 7 == windows.expected_windows(10, 4) and windows.expected_windows(10, 4, 2) == 4 and windows.expected_windows(3, 4) == 0
    assert windows.new_windows(got, got).count() == 0
    more = windows.sliding_windows(make_bars(spark, range(100, 111)), (4,), seconds=3600)
    assert windows.new_windows(more, got).count() == 1
    assert windows.sliding_windows(bars, (4,), 2, seconds=3600).count() == 4


def test_gaps_are_flagged_on_a_continuous_calendar_only(spark):
    bars = make_bars(spark, range(100, 110), skip=(5, 6))
    flagged = windows.sliding_windows(bars, (4,), seconds=3600)
    assert {r.missing_bars for r in flagged.collect()} == {0, 2}
    assert windows.strict(flagged).count() == sum(r.missing_bars == 0 for r in flagged.collect())
    assert windows.sliding_windows(bars, (4,), seconds=3600, calendar="session_based").where("missing_bars > 0").count() == 0


@pytest.mark.parametrize("chunk", [1, 7, 10, 100])
def test_series_in_chunks_give_the_same_windows(spark, chunk):
    bars = make_bars(spark, range(100, 140), skip=(11, 20, 21)).union(make_bars(spark, range(50, 75)).withColumn("instrument", F.lit("Y"))).repartition(3)
    whole = windows.sliding_windows(bars, (4, 8), 3, 2, seconds=3600, chunk=None)
    dealt = windows.sliding_windows(bars, (4, 8), 3, 2, seconds=3600, chunk=chunk)
    assert sorted(map(str, whole.collect())) == sorted(map(str, dealt.select(*whole.columns).collect()))


@pytest.mark.parametrize("horizon,future,expected", [
    (2, [(105, 106, 99), (102, 107, 101)], {"simple_return": 0.02, "mfe": 0.07, "mfe_bar": 2, "mae": -0.01, "mae_bar": 1, "continuation": "CONTINUATION", "is_complete": True}),
    (1, [(100.5, 102, 98)], {"realized_volatility": None, "barrier_5": "SAME_BAR_BOTH", "barrier_20": "SAME_BAR_BOTH", "path_efficiency": 1.0}),
    (3, [(101, 101.5, 100.5)], {"is_complete": False, "flag": "PARTIAL_HORIZON", "available": 1}),
    (3, [], {"is_complete": False, "flag": "NO_FUTURE_BARS", "simple_return": None, "direction_class": "UNAVAILABLE"}),
])
def test_outcomes(spark, horizon, future, expected):
    closes = [97, 98, 99, 100] + [f[0] for f in future]
    bars = make_bars(spark, closes, {4 + i: f[1] for i, f in enumerate(future)}, {4 + i: f[2] for i, f in enumerate(future)})
    row = outcomes.outcomes(windows.sliding_windows(bars, (4,), seconds=3600, horizon=horizon), (horizon,)).orderBy("end_ts").first()
    for k, v in expected.items():
        assert row[k] == (pytest.approx(v) if isinstance(v, float) else v), k


def test_resampling_equals_interp(spark):
    r = np.random.default_rng(1)
    rows = [(r.normal(size=n).tolist(),) for n in (2, 3, 16, 63, 64, 65, 200)] + [([1.0],)]
    got = spark.createDataFrame(rows, "a array<double>").select("a", A.resample(F.col("a"), 64).alias("b"), A.resample(F.col("a"), 64, "previous").alias("p")).collect()
    for x in got[:-1]:
        n = len(x.a)
        np.testing.assert_allclose(x.b, np.interp(np.linspace(0, 1, 64), np.linspace(0, 1, n), x.a), atol=1e-12)
        assert x.p[0] == x.a[0] and x.p[-1] == x.a[-1] and set(x.p) <= set(x.a)
    assert got[-1].b is None


def test_normalisation_failures(spark):
    flat = windows.sliding_windows(make_bars(spark, [100] * 8), (8,), seconds=3600)
    for method, code in (("zscore_close", "ZERO_VARIANCE"), ("range_close", "ZERO_RANGE"), ("volatility_targeted_return", "ZERO_VARIANCE"), ("anchored_log_return", None)):
        row = normalize.normalize(flat, method).first()
        assert row.error_code == code and (row.close_path is None) == (code is not None)
    bad = windows.sliding_windows(make_bars(spark, [1, 2, -3, 4]), (4,), seconds=3600)
    assert normalize.normalize(bad, "anchored_log_return").first().error_code == "NON_POSITIVE_CLOSE"


def _matrix(n=20, length=32, seed=3):
    r = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(r.normal(0, 0.01, (n, length)), axis=1))
    o = c * (1 + r.normal(0, 0.002, c.shape))
    h, low = np.maximum(o, c) * 1.003, np.minimum(o, c) * 0.997
    y = np.stack([np.interp(np.linspace(0, 1, 64), np.linspace(0, 1, length), np.log(x / x[0])) for x in c])
    return y, o, h, low, c, r.uniform(900, 1600, c.shape)


def test_features_against_numpy():
    y, o, h, low, c, v = _matrix()
    f = features.compute(y, o, h, low, c, v)
    assert sorted(f) == sorted(features.NAMES) and len(features.NAMES) == 75
    r = np.diff(np.log(c), axis=1)
    x = np.linspace(0, 1, 64)
    for i in range(len(c)):
        slope, intercept = np.polyfit(x, y[i], 1)
        assert f["linear_regression_slope"][i] == pytest.approx(slope) and f["linear_regression_intercept"][i] == pytest.approx(intercept)
        assert f["curvature_quadratic"][i] == pytest.approx(np.polyfit(x, y[i], 2)[0])
        assert f["lag_1_autocorrelation"][i] == pytest.approx(np.corrcoef(r[i][:-1], r[i][1:])[0, 1])
        assert f["upper_tail_ratio"][i] == pytest.approx(np.percentile(r[i], 95) / r[i].std())
        orders = [tuple(np.argsort(y[i][k : k + 3], kind="stable")) for k in range(62)]
        share = np.array([orders.count(o) for o in set(orders)]) / 62
        assert f["permutation_entropy"][i] == pytest.approx(-(share * np.log(share)).sum() / np.log(6))
        # sample entropy, all pairs one by one
        n, tol = 64, 0.2 * y[i].std()
        count = lambda m: sum(np.abs(y[i][a : a + m] - y[i][b : b + m]).max() <= tol for a in range(n - m + 1) for b in range(a + 1, n - m + 1))  # noqa: B023, E731
        a, b = count(3), count(2)
        assert np.isnan(f["sample_entropy"][i]) if not a or not b else f["sample_entropy"][i] == pytest.approx(-np.log(a / b))


def test_features_do_not_depend_on_scale_and_name_missing_volume():
    y, o, h, low, c, v = _matrix()
    a, b = features.compute(y, o, h, low, c, v), features.compute(y, o * 10, h * 10, low * 10, c * 10, v)
    for k in features.NAMES:
        np.testing.assert_allclose(a[k], b[k], rtol=1e-9, atol=1e-12, equal_nan=True)
    silent = features.compute(y, o, h, low, c, v * 0)
    assert all(np.isnan(silent[k]).all() for k in features.GROUPS["VOLUME"]) and not np.isnan(silent["return_std"]).any()


def test_context_of_a_clear_uptrend(spark):
    values = dict.fromkeys(features.NAMES, 0.0) | {"linear_regression_slope": 0.12, "linear_regression_r_squared": 0.8, "path_efficiency_ratio": 0.7, "trend_direction_consistency": 0.7, "normalized_endpoint_return": 0.16, "path_displacement": 0.16, "realized_volatility": 0.02, "return_std": 0.02, "normalized_atr": 0.02, "hurst_rs_v1": 0.6, "ar_1_coefficient": 0.2, "lag_1_autocorrelation": 0.2, "variance_ratio_2": 1.2, "variance_ratio_4": 1.2, "relative_volume_mean": 1.0, "maximum_positive_return": 0.025, "maximum_negative_return": -0.018, "path_length": 0.3, "volatility_expansion_ratio": 1.0, "range_expansion_ratio": 1.0}
    schema = "instrument string, timeframe string, length int, end_ts timestamp_ntz, " + features.SCHEMA
    end = dt.datetime(2024, 1, 1)
    rows = [("X", "D1", n, end, *values.values()) for n in (16, 64, 256)]
    got = {r.length: r for r in context.classify(spark.createDataFrame(rows, schema)).collect()}
    assert got[16].trend == "STRONG_UPTREND" and got[16].persistence == "PERSISTENT" and got[16].multi_resolution == "ALIGNED_BULLISH"
    assert got[64].multi_resolution == "UNAVAILABLE" and got[16].family.startswith("BULL_TREND") and got[16].market_phase == "MARKUP_LIKE"
    assert abs(sum(context.WEIGHTS.values()) - 1) < 1e-12


def test_distances(spark):
    df = spark.createDataFrame([([0.0, 0.1, 0.2, 0.3], [0.0, 0.1, 0.2, 0.3], [1.0, None, 2.0], [1.0, 5.0, 2.0])], "a array<double>, b array<double>, u array<double>, v array<double>")
    d, share, _ = similarity.feature_distance(F.col("u"), F.col("v"), names=["x", "y", "z"])
    row = df.select(similarity.euclidean(F.col("a"), F.col("b")).alias("e"), similarity.correlation(F.col("a"), F.col("b")).alias("c"), d.alias("d"), share.alias("s"), similarity.correlation(F.col("a"), F.transform("a", lambda x: F.lit(1.0))).alias("flat")).first()
    assert row.e == 0 and row.c == pytest.approx(0) and row.d == pytest.approx(0) and row.s == pytest.approx(2 / 3) and row.flat == 1


@pytest.mark.parametrize("method", similarity.METHODS)
def test_search_looks_back_only(spark, method):
    start = dt.datetime(2024, 1, 1)
    r = np.random.default_rng(2)
    rows = [(f"w{i:02d}", "X", "D1", 4, start + dt.timedelta(days=i), r.normal(size=8).tolist(), r.normal(size=75).tolist(), {k: "A" for k in similarity.COMPARED}, f"e{i // 3}") for i in range(12)]
    ctx = "struct<" + ",".join(f"{k}:string" for k in similarity.COMPARED) + ">"
    base = spark.createDataFrame(rows, f"window_id string, instrument string, timeframe string, length int, end_ts timestamp_ntz, path array<double>, vec array<double>, context {ctx}, episode_id string")
    got = similarity.search(base, base, method, 3, per_episode=1 if method.startswith("episode") else None).collect()
    assert got and all(r.c_id < r.q_id for r in got) and max(r["rank"] for r in got) == 3
    for q in {r.q_id for r in got}:
        assert sorted(r["rank"] for r in got if r.q_id == q) == list(range(1, 1 + sum(r.q_id == q for r in got)))


def test_eligibility_reasons_in_order(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"w{i}", "X", start + dt.timedelta(hours=i - 3), start + dt.timedelta(hours=i), 4) for i in (0, 6, 8, 10, 11)]
    df = spark.createDataFrame(rows, "id string, instrument string, start timestamp_ntz, end timestamp_ntz, length int")
    q, c = df.where("id = 'w10'"), df
    names = df.columns
    both = q.select(*(F.col(n).alias(f"q_{n}") for n in names)).crossJoin(c.select(*(F.col(n).alias(f"c_{n}") for n in names)))
    side = lambda p: {n: F.col(f"{p}_{n}") for n in names}
    reason = {r.c_id: r.r for r in both.select("c_id", validation.eligibility(side("q"), side("c"), 1).alias("r")).collect()}
    assert reason == {"w0": None, "w6": "CANDIDATE_OUTCOME_OVERLAPS_QUERY_SOURCE", "w8": "SOURCE_OVERLAP", "w10": "SAME_QUERY", "w11": "FUTURE_OR_CONTEMPORARY"}
    gap = {r.c_id: r.r for r in both.select("c_id", validation.eligibility(side("q"), side("c"), 1, gap_bars=5).alias("r")).collect()}
    assert gap["w6"] == "EMBARGO_OR_TEMPORAL_DISTANCE"


def test_losses_weights_and_intervals(spark):
    one = spark.range(1)
    row = one.select(validation.brier(F.lit(0.7), F.lit(True)).alias("b"), validation.pinball(F.lit(1.0), F.lit(0.0), 0.9).alias("p"), *(c.alias(n) for c, n in zip(prospective.wilson(F.lit(0), F.lit(0)), "lh"))).first()
    assert row.b == pytest.approx(0.09) and row.p == pytest.approx(0.9) and (row.l, row.h) == (0, 1)
    near = spark.createDataFrame([("q", k, d, 1 / (1 + d)) for k, d in enumerate((0.1, 0.2, 0.4), 1)], "q_id string, rank int, distance double, score double")
    for m in ("uniform_v1", "inverse_distance_v1", "softmax_similarity_v1", "rank_decay_v1"):
        w = [r.w for r in near.select(validation.weights(m, ["q_id"]).alias("w")).collect()]
        assert sum(w) == pytest.approx(1) and w == sorted(w, reverse=True)


def test_folds_and_bootstrap(spark):
    start = dt.datetime(2024, 1, 1)
    w = spark.createDataFrame([(f"w{i:03d}", start + dt.timedelta(days=i)) for i in range(40)], "window_id string, end_ts timestamp_ntz").repartition(3)
    day = lambda t: (t - start).days
    got = {r.fold: tuple(map(day, r[1:])) for r in validation.folds(w, "rolling_walk_forward_v1").collect()}
    assert got == {1: (0, 4, 5, 7), 2: (0, 7, 8, 10), 3: (1, 10, 11, 13)}
    assert {r.fold: tuple(map(day, r[1:])) for r in validation.folds(w, "anchored_holdout_v1").collect()} == {1: (0, 27, 28, 30)}
    with pytest.raises(ValueError):
        validation.folds(w.limit(3))
    values = spark.createDataFrame([("g", i, float(i % 5)) for i in range(50)], "g string, n int, value double")
    for block in (False, True):
        r = validation.bootstrap(values, ["g"], block=block).first()
        assert r.low <= r["mean"] <= r.high and r["mean"] == pytest.approx(2.0)


def test_redundancy_and_clusters(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(50, 75))
    x[:, 1], x[:, 2] = x[:, 0], -x[:, 0]
    df = spark.createDataFrame([(f"w{i}", *map(float, row)) for i, row in enumerate(x)], "window_id string, " + features.SCHEMA)
    pairs = {(p.a, p.b): p.correlation for p in diagnostics.redundant_pairs(df).collect()}
    n = features.NAMES
    assert set(pairs) == {(n[0], n[1]), (n[0], n[2]), (n[1], n[2])} and pairs[n[0], n[2]] == pytest.approx(-1)
    assert diagnostics.clusters(list(pairs)) == [sorted(n[:3])]
    assert diagnostics.distribution(df).count() == 75
    for m in diagnostics.SCALINGS:
        assert diagnostics.scaling(df, m).count() == 75


def test_row_errors(spark):
    t = "2024-01-01 0{}:00:00"
    rows = [(0, t.format(0), "1", "2", "0.5", "1", "5"), (1, t.format(2), "1", "2", "0.5", "1", "5"), (2, t.format(1), "1", "2", "0.5", "1", "5"), (3, t.format(2), "1", "2", "0.5", "1", "5"), (4, "soon", "1", "2", "0.5", "1", "5"), (5, t.format(5), "x", "2", "0.5", "1", "5"), (6, t.format(6), "1", "0.9", "0.5", "1", "-5"), (7, t.format(7), "-1", "2", "-2", "1", "5")]
    raw = spark.createDataFrame(rows, "row_no long, timestamp string, open string, high string, low string, close string, volume string")
    got = {r.row_no: r.errors for r in B.validate_rows(B.parse_rows(raw)).collect()}
    assert got == {0: [], 1: [], 2: ["OUT_OF_ORDER"], 3: ["DUPLICATE_TIMESTAMP"], 4: ["INVALID_TIMESTAMP"], 5: ["NON_FINITE_OPEN"], 6: ["NEGATIVE_VOLUME", "HIGH_BELOW_PRICES"], 7: ["NON_POSITIVE_PRICE"]}
    assert B.import_status(B.validate_rows(B.parse_rows(raw))).first().status == "completed_with_errors"


def test_forecasts_mature_once(spark):
    start = dt.datetime(2024, 1, 1)
    h = spark.createDataFrame([("X", 5, start + dt.timedelta(days=i), "UP" if i % 2 else "DOWN", "LOW", True, 0.01 if i % 3 else -0.01) for i in range(80)], "instrument string, horizon int, end_ts timestamp_ntz, trend string, volatility string, is_complete boolean, simple_return double")
    q = spark.createDataFrame([("X", 5, "UP", "LOW", start + dt.timedelta(days=d)) for d in (10, 70, 500)], "instrument string, horizon int, trend string, volatility string, as_of timestamp_ntz")
    f = prospective.fallback(q, h, 30)
    got = {(r.as_of - start).days: (r.level, r.n, r.insufficient) for r in f.collect()}
    assert got == {10: ("unconditional", 10, True), 70: ("trend_volatility", 35, False), 500: ("trend_volatility", 40, False)}
    m = prospective.mature(f, h)
    assert {(r.as_of - start).days: r.status for r in m.collect()} == {10: "MATURED", 70: "MATURED", 500: "PENDING_OUTCOME"}
    assert prospective.new_forecasts(f, f, ["instrument", "horizon", "as_of"]).count() == 0
    assert prospective.evaluate(m, ["horizon"]).first().n == 2


def test_verdicts(spark):
    lit = lambda **k: {n: F.lit(v) for n, v in k.items()}
    good = dict(sufficient=True, skill=0.1, context_skill=0.1, consistent=True, diverse=True, single=False, calibrated=True, low=0.01, independent=True)
    cases = [({}, "REPLICATION_SUPPORTED"), ({"low": -0.1}, "REPLICATION_PARTIAL"), ({"skill": -0.1}, "REPLICATION_NOT_SUPPORTED"), ({"sufficient": False}, "REPLICATION_INCONCLUSIVE"), ({"single": True}, "REPLICATION_PARTIAL")]
    row = spark.range(1).select(*(studies.replication_verdict(lit(**(good | c))).alias(f"v{k}") for k, (c, _) in enumerate(cases))).first()
    assert list(row) == [v for _, v in cases]
    p = lambda *a: studies.experiment_verdict(*map(F.lit, a))
    assert list(spark.range(1).select(p(20, 0.1, 0.6, -1.0).alias("a"), p(5, 0.1, 0.6, 1.0).alias("b"), p(60, 0.1, 0.6, 0.01).alias("c"), p(60, 0.0, 0.6, 0.01).alias("d")).first()) == ["PROMISING", "INSUFFICIENT_DATA", "OUT_OF_SAMPLE_SUPPORTED", "NO_SUPPORTED_EDGE"]
    q = lambda n, s, low: studies.prospective_verdict(F.lit(n), F.lit(s), F.lit(low))
    assert spark.range(1).select(q(10, 0.1, 0.1).alias("a"), q(200, 0.1, 0.1).alias("b"), q(40, 0.1, 0.1).alias("c")).first()["b"] == "PROSPECTIVE_CONTEXT_SIGNAL_SUPPORTED"


def test_provider_payloads(spark):
    text = '{"Meta Data": {"1": "x"}, "Time Series (Digital Currency Daily)": {"2024-01-02": {"1a. open (EUR)": "9", "1b. open (USD)": "1", "2. high": "3", "3. low": "0.5", "4. close": "2", "5. volume": "7"}, "soon": {"1. open": "1"}, "2024-01-01": {"1. open": "1", "2. high": "1", "3. low": "1", "4. close": "4", "5. volume": "oops"}}}'
    df = spark.createDataFrame([("X", "crypto", text), ("Y", "forex", text), ("Z", "index", None), ("W", "index", "{}")], "instrument string, asset_class string, payload string")
    got = sorted((r.instrument, r.ts.day, r.open, r.high, r.low, r.close, r.volume) for r in providers.nested_bars(df).collect())
    assert got == [("X", 1, 1, 4, 1, 4, 0), ("X", 2, 1, 3, 0.5, 2, 7), ("Y", 1, 1, 4, 1, 4, 0), ("Y", 2, 1, 3, 0.5, 2, 0)]
    assert providers.accept(providers.nested_bars(df)).count() == 0
    with pytest.raises(ValueError):
        providers.read_manifest(spark, '{"datasets": [{"symbol": "X"}]}')


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in ("events", "orders", "embeddings", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    shown = lambda rows: sorted((tuple(float(x) if isinstance(x, float) else str(x) for x in r) for r in rows), key=repr)
    mine, theirs = shown(df.select(*columns).collect()), shown(found.select(*columns).fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        for x, y in zip(a, b):
            assert x == (pytest.approx(y, abs=2e-6, nan_ok=True) if isinstance(y, float) else y)
