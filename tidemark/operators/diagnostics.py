"""What the features and distances are worth: distributions, redundancy, deciles, monotonicity, episodes, scaling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .features import NAMES

EPS = 1e-12
SCALINGS = ("none_v1", "zscore_reference_v1", "robust_median_mad_v1", "robust_iqr_v1", "winsorized_zscore_v1", "group_balanced_robust_v1")


def long_form(described: DataFrame, names: list[str] = NAMES) -> DataFrame:
    return described.select("window_id", *names).unpivot(["window_id"], names, "feature", "value")


def distribution(described: DataFrame, names: list[str] = NAMES) -> DataFrame:
    """By feature: availability, moments, quantiles, MAD, distinct values, outliers beyond 10 robust scales. Two passes over the long form."""
    v = long_form(described, names)
    x = F.col("value")
    stats = v.groupBy("feature").agg(
        F.count("*").alias("n"), F.count(x).alias("available"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.percentile(x, F.array(*map(F.lit, (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)))).alias("quantiles"), F.count_distinct(F.round(x, 12)).alias("distinct"),
    )
    centre = stats.select("feature", F.get("quantiles", F.lit(3)).alias("median"))
    # One row a feature.
    off = v.join(F.broadcast(centre), "feature").withColumn("off", F.abs(x - F.col("median")))
    mad = off.groupBy("feature").agg(F.percentile("off", F.lit(0.5)).alias("mad"))
    out = off.join(F.broadcast(mad), "feature").groupBy("feature").agg(F.avg((F.col("off") > 10 * 1.4826 * F.col("mad")).cast("double")).alias("outlier_rate"))
    share = F.try_divide(F.col("available"), F.col("n"))
    return stats.join(mad, "feature").join(out, "feature").withColumn("availability", share).withColumn("near_constant", F.coalesce(F.col("std") < EPS, F.lit(True)))


def _moments(batches):
    """For each pair of features the sums over the rows that have both: a row a pair from each task, whatever its rows."""
    n = len(NAMES)
    sums = np.zeros((6, n, n))
    for batch in batches:
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(float)
        k = np.isfinite(x).astype(float)
        v = np.where(k > 0, x, 0)
        sums += np.stack([k.T @ k, v.T @ k, k.T @ v, (v * v).T @ k, k.T @ (v * v), v.T @ v])
    i, j = np.triu_indices(n, 1)
    yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32())} | {f"s{q}": pa.array(sums[q][i, j]) for q in range(6)})


def redundant_pairs(described: DataFrame, at: float = 0.95) -> DataFrame:
    """Pairs of features whose correlation over at least 3 common rows reaches `at` in either direction: one pass over the rows."""
    schema = "i int, j int, " + ", ".join(f"s{q} double" for q in range(6))
    total = described.select(*NAMES).mapInArrow(_moments, schema).groupBy("i", "j").agg(*(F.sum(f"s{q}").alias(f"s{q}") for q in range(6)))
    n, sx, sy, sxx, syy, sxy = (F.col(f"s{q}") for q in range(6))
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    floor = 1e-12 * n
    rho = F.when((n < 3) | (vx < floor) | (vy < floor), 0.0).otherwise((sxy - sx * sy / n) / F.sqrt(F.greatest(vx, floor) * F.greatest(vy, floor)))
    names = F.array(*map(F.lit, NAMES))
    return total.where(n > 0).select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), rho.alias("correlation")).where(F.abs("correlation") >= at)


def clusters(pairs: list[tuple[str, str]]) -> list[list[str]]:
    """Features joined by pairs; there are at most as many as features."""
    up: dict[str, str] = {}

    def root(x: str) -> str:
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    groups: dict[str, list[str]] = {}
    for x in sorted(up):
        groups.setdefault(root(x), []).append(x)
    return sorted(groups.values())


def _numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with `_i` (from 0) in order and `_n`: a range sort and the sizes of its parts instead of one window over everything."""
    from ..session import written

    df = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    sizes = df.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_m").alias("_f"))
    w = Window.orderBy("_p")  # a row for each part
    base = sizes.select("_p", "_f", F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"))
    return df.join(F.broadcast(base), "_p").withColumn("_i", F.col("_base") + F.col("_m") - F.col("_f")).drop("_p", "_m", "_f", "_base")


def deciles(rows: DataFrame, by: str, ties: list[str], value: str) -> DataFrame:
    """Ten groups of equal size in ascending order of `by`: count, bounds, mean of value."""
    d = _numbered(rows, [F.col(by), *map(F.col, ties)])
    bin_ = F.least(F.floor(F.col("_i") * 10 / F.col("_n")) + 1, F.lit(10)).cast("int")
    return d.groupBy(bin_.alias("decile")).agg(F.count("*").alias("n"), F.min(by).alias("low"), F.max(by).alias("high"), F.avg(value).alias("mean_value"))


def average_rank(column: str, keys: list[str]) -> Column:
    """Rank from 1 with ties at their mean."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(column)) + (F.count("*").over(Window.partitionBy(*keys, column)) - 1) / 2


def spearman(rows: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    ranks = rows.withColumns({"_a": average_rank(a, keys), "_b": average_rank(b, keys)})
    return ranks.groupBy(*keys).agg(F.coalesce(F.corr("_a", "_b"), F.lit(0.0)).alias("spearman"), F.coalesce(F.corr(a, b), F.lit(0.0)).alias("pearson"))


def monotonicity(table: DataFrame) -> DataFrame:
    """Verdict on a decile table: whether the mean value rises or falls with the decile."""
    rho = spearman(table.withColumn("_g", F.lit(1)), "decile", "mean_value", ["_g"]).drop("_g")
    return rho.withColumn("verdict", F.when(F.col("spearman") > 0.1, "RISING").when(F.col("spearman") < -0.1, "FALLING").otherwise("FLAT"))


def concentration(matches: DataFrame) -> DataFrame:
    """By query how matches (q_id, episode_id) spread over episodes."""
    per = matches.groupBy("q_id", "episode_id").agg(F.count("*").alias("c"))
    top = F.sort_array(F.collect_list("c"), asc=False)
    out = per.groupBy("q_id").agg(F.count("*").alias("episodes"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("_s"), top.alias("_top"))
    three = F.aggregate(F.slice("_top", 1, 3), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("q_id", "episodes", "n", (F.get("_top", F.lit(0)) / F.col("n")).alias("top1_share"), (three / F.col("n")).alias("top3_share"), (F.col("n") * F.col("n") / F.col("_s")).alias("effective_episodes"))


def scaling(described: DataFrame, method: str, names: list[str] = NAMES) -> DataFrame:
    """One row a feature: centre, scale and bounds of a scaling method, fitted on described."""
    v = long_form(described, names).where("value IS NOT NULL")
    q = F.percentile("value", F.array(*map(F.lit, (0.01, 0.25, 0.5, 0.75, 0.99))))
    s = v.groupBy("feature").agg(q.alias("q"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    at = lambda k: F.get("q", F.lit(k))
    mad = v.join(F.broadcast(s.select("feature", at(2).alias("m"))), "feature").groupBy("feature").agg((1.4826 * F.percentile(F.abs(F.col("value") - F.col("m")), F.lit(0.5))).alias("mad"))
    s = s.join(mad, "feature")
    centre, scale = {
        "none_v1": (F.lit(0.0), F.lit(1.0)), "zscore_reference_v1": (F.col("mean"), F.col("std")), "robust_median_mad_v1": (at(2), F.col("mad")), "group_balanced_robust_v1": (at(2), F.col("mad")),
        "robust_iqr_v1": (at(2), (at(3) - at(1)) / 1.349), "winsorized_zscore_v1": (F.col("mean"), F.col("std")),
    }[method]
    wins = method == "winsorized_zscore_v1"
    inf = F.lit(float("inf"))
    return s.select("feature", centre.alias("centre"), F.when(scale < EPS, 1.0).otherwise(scale).alias("scale"), (at(0) if wins else -inf).alias("low"), (at(4) if wins else inf).alias("high"))


def dispersion(neighbours: DataFrame) -> DataFrame:
    """By query the spread and the entropy (bits) of the neighbours' outcomes."""
    r = F.col("simple_return")
    q = F.percentile(r, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = neighbours.groupBy("q_id").agg(F.stddev_samp(r).alias("std"), q.alias("_q"), F.avg((r > 0).cast("double")).alias("up"), F.avg((r < 0).cast("double")).alias("down"))
    part = lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)
    flat = F.greatest(1 - F.col("up") - F.col("down"), F.lit(0.0))
    return out.select("q_id", "std", (F.get("_q", F.lit(2)) - F.get("_q", F.lit(0))).alias("iqr"), (part(F.col("up")) + part(F.col("down")) + part(flat)).alias("entropy"))
