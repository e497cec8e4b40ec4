"""The 75-number description of a window.

All windows of one length in an Arrow batch are one matrix, so every feature is a few numpy operations over all of them. What
cannot be computed is NaN inside and null outside, with the reason in `reasons`. `y` is the resampled log path of 64 points, `r`
the log returns of the raw bars.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .normalize import POINTS, channel, normalize

EPS = 1e-12
#: Names in registry order, by group.
GROUPS = {
    "PATH": ["normalized_endpoint_return", "path_displacement", "path_length", "path_efficiency_ratio", "maximum_drawdown_normalized", "maximum_runup_normalized", "endpoint_position_in_range", "normalized_atr"],
    "TREND": ["linear_regression_slope", "linear_regression_intercept", "linear_regression_r_squared", "linear_regression_residual_std", "trend_direction_consistency", "lsma_endpoint", "lsma_slope", "curvature_quadratic"],
    "MOMENTUM": ["return_mean", "return_std", "positive_return_ratio", "negative_return_ratio", "momentum_first_half", "momentum_second_half", "momentum_acceleration", "lag_1_autocorrelation", "lag_2_autocorrelation", "ar_1_coefficient", "return_skewness", "return_kurtosis", "return_median", "return_mad"],
    "VOLATILITY": ["realized_volatility", "downside_volatility", "upside_volatility", "volatility_asymmetry", "volatility_first_half", "volatility_second_half", "volatility_expansion_ratio", "range_expansion_ratio"],
    "DISTRIBUTION": ["upper_tail_ratio", "lower_tail_ratio", "maximum_positive_return", "maximum_negative_return"],
    "PERSISTENCE": ["hurst_rs_v1", "variance_ratio_2", "variance_ratio_4"],
    "COMPLEXITY": ["permutation_entropy", "sample_entropy", "higuchi_fractal_dimension", "turning_point_count", "turning_point_density"],
    "STRUCTURE": ["swing_count", "average_swing_size", "median_swing_size", "average_swing_duration", "maximum_swing_size", "impulse_pullback_ratio", "higher_high_count", "lower_low_count", "higher_low_count", "lower_high_count", "lower_wick_ratio_mean"],
    "CANDLE": ["body_to_range_mean", "body_to_range_std", "upper_wick_ratio_mean", "bullish_candle_ratio", "bearish_candle_ratio", "inside_bar_ratio", "outside_bar_ratio", "close_location_value_mean"],
    "VOLUME": ["relative_volume_mean", "volume_coefficient_of_variation", "volume_trend_slope", "volume_absolute_return_correlation", "volume_expansion_ratio", "high_volume_location"],
}
NAMES = [n for names in GROUPS.values() for n in names]
GROUP_OF = {n: g for g, names in GROUPS.items() for n in names}
SCHEMA = ", ".join(f"{n} double" for n in NAMES)


def _sr(a, b):
    """a / b, 0 where b is nothing."""
    b = np.asarray(b, float)
    return np.where(np.abs(b) < EPS, 0.0, a / np.where(np.abs(b) < EPS, 1.0, b))


def _line(y: np.ndarray):
    x = np.linspace(0, 1, y.shape[1])
    d = x - x.mean()
    m = y.mean(axis=1)
    slope = (y - m[:, None]) @ d / (d @ d)
    rest = y - m[:, None] - slope[:, None] * d
    sse, sst = (rest**2).sum(axis=1), ((y - m[:, None]) ** 2).sum(axis=1)
    return slope, m - slope * x.mean(), np.where(sst < EPS, 1.0, 1 - sse / np.where(sst < EPS, 1, sst)), rest.std(axis=1)


def _corr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sa, sb = a.std(axis=1), b.std(axis=1)
    flat = (sa < EPS) | (sb < EPS)
    cov = ((a - a.mean(axis=1, keepdims=True)) * (b - b.mean(axis=1, keepdims=True))).mean(axis=1)
    return np.where(flat, np.nan, cov / np.where(flat, 1, sa * sb))


def _masked_std(r: np.ndarray, keep: np.ndarray) -> np.ndarray:
    n = keep.sum(axis=1)
    m = (r * keep).sum(axis=1) / np.maximum(n, 1)
    return np.sqrt((((r - m[:, None]) ** 2) * keep).sum(axis=1) / np.maximum(n, 1))


def _hurst(r: np.ndarray) -> np.ndarray:
    n = r.shape[1]
    sizes = [s for s in (8, 16, 32) if s <= n]
    if n < 16 or len(sizes) < 2:
        return np.full(len(r), np.nan)
    xs, ys = np.log(np.array(sizes, float)), []
    for s in sizes:
        c = r[:, : n // s * s].reshape(len(r), n // s, s)
        d = np.cumsum(c - c.mean(axis=2, keepdims=True), axis=2)
        width, sd = d.max(axis=2) - d.min(axis=2), c.std(axis=2)
        ok = sd >= EPS
        rs = np.where(ok, width / np.where(ok, sd, 1), 0).sum(axis=1)
        k = (ok & (width > 0)).sum(axis=1)
        ys.append(np.where(k > 0, rs / np.maximum(k, 1), np.nan))
    y = np.log(np.stack(ys, axis=1))
    out = np.full(len(r), np.nan)
    ok = np.isfinite(y)
    n_ok = ok.sum(axis=1)
    d = np.where(ok, xs - ((ok * xs).sum(axis=1) / np.maximum(n_ok, 1))[:, None], 0)
    fit = n_ok >= 2
    out[fit] = (d * np.where(ok, y, 0)).sum(axis=1)[fit] / (d * d).sum(axis=1)[fit]
    return out


def _variance_ratio(r: np.ndarray, lag: int) -> np.ndarray:
    if r.shape[1] < lag + 1:
        return np.full(len(r), np.nan)
    s = np.lib.stride_tricks.sliding_window_view(r, lag, axis=1).sum(axis=2)
    v = r.var(axis=1)
    return np.where(v < EPS, np.nan, s.var(axis=1) / np.where(v < EPS, 1, lag * v))


def _permutation_entropy(x: np.ndarray) -> np.ndarray:
    if x.shape[1] < 3:
        return np.full(len(x), np.nan)
    t = np.lib.stride_tricks.sliding_window_view(x, 3, axis=1)
    code = (t[..., 0] <= t[..., 1]) * 4 + (t[..., 1] <= t[..., 2]) * 2 + (t[..., 0] <= t[..., 2])
    p = np.stack([(code == k).mean(axis=1) for k in range(8)], axis=1)
    return -(p * np.log(np.where(p > 0, p, 1))).sum(axis=1) / np.log(6)


def _sample_entropy(x: np.ndarray, m: int = 2) -> np.ndarray:
    """By blocks of windows; the pairs of a window's places are compared by their distance in time."""
    n = x.shape[1]
    out = np.full(len(x), np.nan)
    if n < 16:
        return out
    for at in range(0, len(x), 2000):
        y = x[at : at + 2000]
        sd = y.std(axis=1)
        longer, shorter = np.zeros(len(y)), np.zeros(len(y))
        for lag in range(1, n - m + 1):
            close = np.abs(y[:, lag:] - y[:, :-lag]) <= 0.2 * sd[:, None]
            both = np.logical_and.reduce([close[:, k : close.shape[1] - m + 1 + k] for k in range(m)])
            shorter += both.sum(axis=1)
            if close.shape[1] > m:
                longer += (both[:, :-1] & close[:, m:]).sum(axis=1)
        ok = (sd >= EPS) & (longer > 0) & (shorter > 0)
        out[at : at + 2000][ok] = -np.log(longer[ok] / shorter[ok])
    return out


def _higuchi(y: np.ndarray, kmax: int = 6) -> np.ndarray:
    n = y.shape[1]
    lengths = []
    for k in range(1, kmax + 1):
        parts = []
        for m in range(k):
            steps = (n - 1 - m) // k
            if steps >= 1:
                s = np.abs(np.diff(y[:, m : m + steps * k + 1 : k], axis=1)).sum(axis=1)
                parts.append(s * (n - 1) / (steps * k) / k)
        lengths.append(np.mean(parts, axis=0))
    length = np.stack(lengths, axis=1)
    x = np.log(1 / np.arange(1, kmax + 1))
    d = x - x.mean()
    ok = (length > EPS).all(axis=1)
    return np.where(ok, np.log(np.where(length > EPS, length, 1)) @ d / (d @ d), np.nan)


def _structure(y: np.ndarray) -> dict[str, np.ndarray]:
    keys = [*GROUPS["STRUCTURE"][:10]]
    out = {k: np.zeros(len(y)) for k in keys}
    high = (y[:, 1:-1] >= y[:, :-2]) & (y[:, 1:-1] > y[:, 2:])
    low = (y[:, 1:-1] <= y[:, :-2]) & (y[:, 1:-1] < y[:, 2:])
    for i in range(len(y)):
        at = np.concatenate([[0], np.flatnonzero(high[i] | low[i]) + 1, [y.shape[1] - 1]])
        size = np.abs(np.diff(y[i][at]))
        h, lo = np.diff(y[i][1:-1][high[i]]), np.diff(y[i][1:-1][low[i]])
        row = [len(size), size.mean(), np.median(size), np.diff(at).mean(), size.max(), _sr(size.max(), size.mean()), (h > 0).sum(), (lo < 0).sum(), (lo > 0).sum(), (h < 0).sum()]
        for k, v in zip(keys, row):
            out[k][i] = v
    return out


def compute(y: np.ndarray, o: np.ndarray, h: np.ndarray, low: np.ndarray, c: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    """Every feature of windows of one length: y (n, 64), the others (n, L). NaN: unavailable."""
    n, length = c.shape
    f: dict[str, np.ndarray] = {}
    dy = np.diff(y, axis=1)
    r = np.diff(np.log(c), axis=1)
    top, bottom = y.max(axis=1), y.min(axis=1)
    f["normalized_endpoint_return"] = y[:, -1] - y[:, 0]
    f["path_displacement"] = np.abs(f["normalized_endpoint_return"])
    f["path_length"] = np.abs(dy).sum(axis=1)
    f["path_efficiency_ratio"] = _sr(f["path_displacement"], f["path_length"])
    f["maximum_drawdown_normalized"] = (np.maximum.accumulate(y, axis=1) - y).max(axis=1)
    f["maximum_runup_normalized"] = (y - np.minimum.accumulate(y, axis=1)).max(axis=1)
    f["endpoint_position_in_range"] = _sr(y[:, -1] - bottom, top - bottom)
    previous = np.concatenate([c[:, :1], c[:, :-1]], axis=1)
    tr = np.maximum.reduce([h - low, np.abs(h - previous), np.abs(low - previous)])
    f["normalized_atr"] = _sr(tr.mean(axis=1), c.mean(axis=1))
    slope, intercept, r2, rest = _line(y)
    f |= {"linear_regression_slope": slope, "linear_regression_intercept": intercept, "linear_regression_r_squared": r2, "linear_regression_residual_std": rest, "lsma_endpoint": slope + intercept, "lsma_slope": slope}
    f["trend_direction_consistency"] = np.abs(np.sign(dy).mean(axis=1))
    f["curvature_quadratic"] = y @ np.linalg.pinv(np.vander(np.linspace(0, 1, y.shape[1]), 3))[0]
    half = r.shape[1] // 2
    r1, r2h = r[:, :half], r[:, half:]
    sd = r.std(axis=1)
    centred = r - r.mean(axis=1, keepdims=True)
    flat = sd < EPS
    safe = np.where(flat, 1, sd)
    f |= {"return_mean": r.mean(axis=1), "return_std": sd, "positive_return_ratio": (r > 0).mean(axis=1), "negative_return_ratio": (r < 0).mean(axis=1), "momentum_first_half": r1.sum(axis=1), "momentum_second_half": r2h.sum(axis=1)}
    f["momentum_acceleration"] = f["momentum_second_half"] - f["momentum_first_half"]
    nothing = np.full(n, np.nan)
    f["lag_1_autocorrelation"] = _corr(r[:, :-1], r[:, 1:]) if r.shape[1] >= 3 else nothing
    f["lag_2_autocorrelation"] = _corr(r[:, :-2], r[:, 2:]) if r.shape[1] >= 4 else nothing
    f["ar_1_coefficient"] = f["lag_1_autocorrelation"]
    f["return_skewness"] = np.where(flat, np.nan, (centred**3).mean(axis=1) / safe**3)
    f["return_kurtosis"] = np.where(flat, np.nan, (centred**4).mean(axis=1) / safe**4)
    f["return_median"] = np.median(r, axis=1)
    f["return_mad"] = np.median(np.abs(r - f["return_median"][:, None]), axis=1)
    f["realized_volatility"] = sd
    f["downside_volatility"], f["upside_volatility"] = _masked_std(r, r < 0), _masked_std(r, r > 0)
    f["volatility_asymmetry"] = f["upside_volatility"] - f["downside_volatility"]
    f["volatility_first_half"] = r1.std(axis=1) if half else nothing
    f["volatility_second_half"] = r2h.std(axis=1)
    f["volatility_expansion_ratio"] = _sr(f["volatility_second_half"], f["volatility_first_half"])
    mid = y.shape[1] // 2
    f["range_expansion_ratio"] = _sr(np.ptp(y[:, mid:], axis=1), np.ptp(y[:, :mid], axis=1))
    q = np.percentile(r, [5, 95], axis=1)
    f["upper_tail_ratio"], f["lower_tail_ratio"] = _sr(q[1], sd), _sr(np.abs(q[0]), sd)
    f["maximum_positive_return"], f["maximum_negative_return"] = r.max(axis=1), r.min(axis=1)
    f["hurst_rs_v1"], f["variance_ratio_2"], f["variance_ratio_4"] = _hurst(r), _variance_ratio(r, 2), _variance_ratio(r, 4)
    f["permutation_entropy"], f["sample_entropy"], f["higuchi_fractal_dimension"] = _permutation_entropy(y), _sample_entropy(y), _higuchi(y)
    turn = np.zeros(n)
    for i in range(n):
        s = np.sign(dy[i][np.abs(dy[i]) > EPS])
        turn[i] = (s[1:] != s[:-1]).sum()
    f["turning_point_count"], f["turning_point_density"] = turn, turn / max(1, y.shape[1] - 2)
    f |= _structure(y)
    width = h - low
    bad = (width <= 0).any(axis=1)
    w = np.where(width <= 0, 1, width)
    candle = lambda x: np.where(bad, np.nan, x)
    body = np.abs(c - o) / w
    f["body_to_range_mean"], f["body_to_range_std"] = candle(body.mean(axis=1)), candle(body.std(axis=1))
    f["upper_wick_ratio_mean"] = candle(((h - np.maximum(o, c)) / w).mean(axis=1))
    f["lower_wick_ratio_mean"] = candle(((np.minimum(o, c) - low) / w).mean(axis=1))
    f["bullish_candle_ratio"], f["bearish_candle_ratio"] = (c > o).mean(axis=1), (c < o).mean(axis=1)
    inside, outside = (h[:, 1:] <= h[:, :-1]) & (low[:, 1:] >= low[:, :-1]), (h[:, 1:] >= h[:, :-1]) & (low[:, 1:] <= low[:, :-1])
    f["inside_bar_ratio"], f["outside_bar_ratio"] = inside.mean(axis=1), outside.mean(axis=1)
    f["close_location_value_mean"] = candle(((c - low) / w).mean(axis=1))
    vm = v.mean(axis=1)
    silent = ~np.isfinite(vm) | (vm <= 0)
    volume = lambda x: np.where(silent, np.nan, x)
    relative = v / np.where(silent, 1, vm)[:, None]
    f["relative_volume_mean"] = volume(relative.mean(axis=1))
    f["volume_coefficient_of_variation"] = volume(_sr(v.std(axis=1), vm))
    f["volume_trend_slope"] = volume(_line(relative)[0])
    f["volume_absolute_return_correlation"] = volume(_corr(v[:, 1:], np.abs(r)))
    f["volume_expansion_ratio"] = volume(_sr(v[:, length // 2 :].mean(axis=1), v[:, : length // 2].mean(axis=1)))
    f["high_volume_location"] = volume(np.argmax(np.where(np.isfinite(v), v, -np.inf), axis=1) / max(1, length - 1))
    return f


def _run(batches):
    for batch in batches:
        keys = {k: batch.column(k) for k in ("window_id", "instrument", "timeframe", "length", "end_ts")}
        paths = batch.column("close_path").to_pylist()
        raw = [batch.column(k).to_pylist() for k in ("o", "h", "l", "c", "v")]
        out = np.full((batch.num_rows, len(NAMES)), np.nan)
        lengths = np.array(batch.column("length").to_pylist())
        for length in np.unique(lengths):
            rows = [i for i in np.flatnonzero(lengths == length) if paths[i] is not None]
            if rows:
                with np.errstate(all="ignore"):
                    got = compute(np.array([paths[i] for i in rows], float), *(np.array([x[i] for i in rows], float) for x in raw))
                out[rows] = np.stack([got[n] for n in NAMES], axis=1)
        columns = {n: pa.array(out[:, k], pa.float64(), mask=~np.isfinite(out[:, k])) for k, n in enumerate(NAMES)}
        yield pa.RecordBatch.from_pydict(keys | columns)


def features(windows: DataFrame) -> DataFrame:
    """window_id, series, length, end_ts and the 75 features. windows: sliding_windows(...)."""
    df = normalize(windows, "anchored_log_return", POINTS)
    parts = [channel(F.col("bars"), k).alias(k[0]) for k in ("open", "high", "low", "close", "volume")]
    df = df.select("window_id", "instrument", "timeframe", "length", "end_ts", "close_path", *parts)
    return df.mapInArrow(_run, f"window_id string, instrument string, timeframe string, length int, end_ts timestamp_ntz, {SCHEMA}")


def availability(described: DataFrame) -> DataFrame:
    """Share of windows that have each feature, one pass."""
    n = F.count("*").cast("double")
    shares = described.agg(*(F.try_divide(F.count(c).cast("double"), n).alias(c) for c in NAMES))
    return shares.unpivot([], NAMES, "feature", "availability")
