"""Forecasts as of a cutoff: history by fallback level, maturation, evaluation. The ledger is append-only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import validation

LEVELS = ("trend_volatility", "trend_only", "unconditional")
Z = 1.959963985


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """95 % interval of a share; (0, 1) without observations."""
    p = F.try_divide(k, n)
    mid, half = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    scale = 1 + Z * Z / n
    return F.when(n == 0, 0.0).otherwise(F.greatest((mid - half) / scale, F.lit(0.0))), F.when(n == 0, 1.0).otherwise(F.least((mid + half) / scale, F.lit(1.0)))


def smoothed(k: Column, n: Column, a: float = 1.0, b: float = 1.0) -> Column:
    return (k + a) / (n + a + b)


def shrunk(k: Column, n: Column, prior: Column, m: float = 20.0) -> Column:
    return (k + m * prior) / (n + m)


def fallback(queries: DataFrame, history: DataFrame, least: int = 30, strict_as_of: bool = False) -> DataFrame:
    """For each query (instrument, horizon, trend, volatility, as_of) the share of rising outcomes at the first level with `least` rows.

    history: instrument, horizon, end_ts, trend, volatility, is_complete, simple_return, and known_at (when an outcome was known)
    with strict_as_of; without it a window counts once it ended, as if its outcome were known at once. History and queries are
    one timeline with running counts: one shuffle by (instrument, horizon), nothing grows with queries times history.
    """
    # At one time a query stands before a window that ends then (its end must be earlier), but behind an outcome known then.
    seen = history.where("is_complete").select("instrument", "horizon", F.col("known_at" if strict_as_of else "end_ts").alias("as_of"), F.lit(0 if strict_as_of else 2).alias("_kind"), "trend", "volatility", F.lit(1).alias("_n"), F.coalesce((F.col("simple_return") > 0).cast("int"), F.lit(0)).alias("_k"))
    asked = queries.select("instrument", "horizon", "as_of", F.lit(1).alias("_kind"), "trend", "volatility", F.lit(0).alias("_n"), F.lit(0).alias("_k")).distinct()
    df = seen.unionByName(asked)
    for i, more in ((2, []), (1, ["trend"]), (0, ["trend", "volatility"])):
        w = Window.partitionBy("instrument", "horizon", *more).orderBy("as_of", "_kind").rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumns({f"n{i}": F.coalesce(F.sum("_n").over(w), F.lit(0)), f"k{i}": F.coalesce(F.sum("_k").over(w), F.lit(0))})
    df = df.where("_kind = 1")
    pick = lambda p: F.when(F.col("n0") >= least, p(0)).when(F.col("n1") >= least, p(1)).otherwise(p(2))
    n, k = pick(lambda i: F.col(f"n{i}")), pick(lambda i: F.col(f"k{i}"))
    return df.select("instrument", "horizon", "as_of", pick(lambda i: F.lit(LEVELS[i])).alias("level"), n.alias("n"), smoothed(k, n).alias("p"), F.try_divide(F.col("k2"), F.col("n2")).alias("baseline"), (F.greatest("n0", "n1", "n2") < least).alias("insufficient"))


def new_forecasts(forecasts: DataFrame, ledger: DataFrame, key: list[str]) -> DataFrame:
    """What the ledger does not hold yet."""
    return forecasts.join(ledger.select(*key), key, "left_anti")


def genuine(forecasts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Without forecasts made before their cutoff or after their outcome was complete. forecasts: created_at, as_of."""
    done = outcomes.where("is_complete").select("instrument", "horizon", F.col("end_ts").alias("as_of"))
    return forecasts.where(F.col("created_at") >= F.col("as_of")).join(done, ["instrument", "horizon", "as_of"], "left_anti")


def mature(forecasts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Forecasts with their complete outcome, where there is one."""
    done = outcomes.where("is_complete").select("instrument", "horizon", F.col("end_ts").alias("as_of"), F.col("simple_return").alias("actual"))
    out = forecasts.join(done, ["instrument", "horizon", "as_of"], "left")
    return out.withColumn("status", F.when(F.col("actual").isNotNull(), "MATURED").otherwise("PENDING_OUTCOME")).withColumn("up", F.col("actual") > 0)


def evaluate(matured: DataFrame, keys: list[str]) -> DataFrame:
    """By keys: counts, hits, Brier score and its skill against each forecast's own baseline (null if any has none)."""
    done = matured.where("status = 'MATURED'")
    b, b0 = validation.brier(F.col("p"), F.col("up")), validation.brier(F.col("baseline"), F.col("up"))
    df = done.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(((F.col("p") >= 0.5) == F.col("up")).cast("double")).alias("accuracy"), F.avg(b).alias("brier"), F.avg(b0).alias("brier_baseline"), F.count_if(F.col("baseline").isNull()).alias("_missing"))
    skill = F.when(F.col("_missing") == 0, 1 - F.col("brier") / F.greatest("brier_baseline", F.lit(1e-12)))
    return df.withColumn("skill", skill).drop("_missing")
