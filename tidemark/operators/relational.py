"""Selections, splits and set relations that the studies and runs are put together from; all plain DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def in_range(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Rows between start and end, both included; a missing bound is open."""
    for bound, test in ((start, lambda c, b: c >= b), (end, lambda c, b: c <= b)):
        if bound is not None:
            df = df.where(test(F.col(column), F.lit(bound)))
    return df


def matching(df: DataFrame, equal: dict | None = None, least: dict | None = None, holds: dict | None = None) -> DataFrame:
    """A list filter: equalities, lower bounds and values that an array column must hold; None asks nothing. Limits come after it."""
    for wanted, test in ((equal, lambda c, v: c == v), (least, lambda c, v: c >= v), (holds, lambda c, v: F.array_contains(c, v))):
        for name, value in (wanted or {}).items():
            if value is not None:
                df = df.where(test(F.col(name), F.lit(value)))
    return df


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page `number` (from 0) of rows in a total order."""
    return df.orderBy(*order).offset(number * size).limit(size)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`, by a partial aggregate: no key is sorted."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def spaced(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """At most n rows of each key, evenly spaced in its order: the places floor(i * (m - 1) / (n - 1)) of m rows, the first alone for n = 1."""
    w = Window.partitionBy(*keys)
    place, m = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    numbered = df.withColumns({"_at": place, "_m": m})
    step = F.floor(F.col("_at") * (n - 1) / F.greatest(F.col("_m") - 1, F.lit(1)))
    # A place is picked if it is the rounded-down image of some i: of the next ones, floor(i (m - 1) / (n - 1)) = place.
    hit = lambda i: F.floor(i * (F.col("_m") - 1) / max(n - 1, 1)) == F.col("_at")
    picked = (F.col("_m") <= n) | ((F.col("_at") == 0) if n == 1 else hit(step) | hit(step + 1))
    return numbered.where(picked).drop("_at", "_m")


def parts(df: DataFrame, keys: list[str], order: list[str], shares: tuple[float, ...] = (0.6, 0.2, 0.2)) -> DataFrame:
    """A column `part` (from 1) that cuts each key's rows, in order, into shares of them."""
    w = Window.partitionBy(*keys)
    at = (F.row_number().over(w.orderBy(*order)) - 1) / F.count("*").over(w)
    bounds, total = [], 0.0
    for s in shares[:-1]:
        total = round(total + s, 12)
        bounds.append(total)
    part = F.lit(len(shares))
    for k in range(len(bounds), 0, -1):
        part = F.when(at < bounds[k - 1], k).otherwise(part)
    return df.withColumn("part", part)


def split_evenly(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """A column `chunk` (from 1): n runs of each key's rows in order, the first ones a row longer where the rows don't divide."""
    return df.withColumn("chunk", F.ntile(n).over(Window.partitionBy(*keys).orderBy(*order)))


def divide(df: DataFrame, by: list[str], item: str, required: DataFrame) -> DataFrame:
    """Relational division: the keys `by` that have every value of required's column `item`."""
    wanted = required.select(item).distinct()
    n = wanted.count()
    if not n:
        return df.select(*by).distinct()
    return df.select(*by, item).distinct().join(wanted, item, "left_semi").groupBy(*by).count().where(F.col("count") == n).select(*by)


def same_universe(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many distinct keys only a has, only b has and both have, and whether the sets are equal."""
    side = lambda df, name: df.select(*columns).distinct().withColumn(name, F.lit(1))
    both = side(a, "_a").unionByName(side(b, "_b"), allowMissingColumns=True).groupBy(*columns).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    only = lambda x, y: F.count_if(F.col(x).isNotNull() & F.col(y).isNull())
    out = both.agg(only("_a", "_b").alias("only_a"), only("_b", "_a").alias("only_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("in_both"))
    return out.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def contained(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """inner rows (start_ts, end_ts) whose interval lies in an interval of outer with the same keys, ends included.

    Outer intervals that begin no later are a running maximum of their ends over one timeline of both sides, so nothing is
    paired: one shuffle by the keys.
    """
    timeline = inner.withColumn("_kind", F.lit(1)).unionByName(outer.select(*keys, "start_ts", "end_ts").withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    reach = F.max(F.when(F.col("_kind") == 0, F.col("end_ts"))).over(Window.partitionBy(*keys).orderBy("start_ts", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    return timeline.withColumn("_reach", reach).where((F.col("_kind") == 1) & (F.col("_reach") >= F.col("end_ts"))).select(*inner.columns)


def counts_map(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """For each key the counts of a column's values as a map in order of the values."""
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(column).alias("key"), F.col("n").alias("value"))))).alias("counts"))


def complete_rate(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Complete outcomes over windows times horizons, by keys."""
    return outcomes.groupBy(*keys).agg(F.count_if("is_complete").alias("complete"), F.count_distinct("window_id").alias("windows"), F.count_distinct("horizon").alias("horizons")).withColumn(
        "complete_rate", F.try_divide(F.col("complete").cast("double"), F.col("windows") * F.col("horizons"))
    )


def strict_confusion(evaluations: DataFrame, keys: list[str], at: float = 0.5) -> DataFrame:
    """Sensitivity, specificity, balanced accuracy and Matthews correlation (p, up); null where a class is absent."""
    said = F.col("p") >= at
    n = lambda test: F.count_if(test).cast("double")
    c = evaluations.groupBy(*keys).agg(n(said & F.col("up")).alias("tp"), n(~said & ~F.col("up")).alias("tn"), n(said & ~F.col("up")).alias("fp"), n(~said & F.col("up")).alias("fn"))
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    c = c.withColumn("sensitivity", F.try_divide(tp, tp + fn)).withColumn("specificity", F.try_divide(tn, tn + fp))
    return c.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2).withColumn("matthews", F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))))


def calibration_interval(evaluations: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """By bins of p: count, mean p, share of risen, and its normal 95 % interval within [0, 1]."""
    binned = evaluations.withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int"))
    t = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("confidence"), F.avg(F.col("up").cast("double")).alias("frequency"))
    half = 1.96 * F.sqrt(F.col("frequency") * (1 - F.col("frequency")) / F.col("n"))
    return t.withColumn("low", F.greatest(F.col("frequency") - half, F.lit(0.0))).withColumn("high", F.least(F.col("frequency") + half, F.lit(1.0)))


#: Providers whose data carry warnings, and the codes.
WARNED = ("yahoo_finance_v1", "alpha_vantage_v1")
SOURCE_WARNINGS = ("PROVIDER_DATA_RESEARCH_ONLY", "POSSIBLE_RETROACTIVE_PROVIDER_REVISION", "PRICE_ADJUSTMENT_PROVIDER_CONTROLLED", "FUTURES_CONTINUOUS_CONTRACT_UNVERIFIED", "FOREX_VOLUME_UNAVAILABLE", "CRYPTO_SINGLE_VENUE_OR_AGGREGATED_SOURCE")


def source_warnings(provider: Column, asset_class: Column, symbol: Column, adjustment: Column) -> Column:
    """What is known of a source's data, as an array of codes; empty for providers not warned of."""
    kind = F.lower(asset_class)
    tests = (F.lit(True), provider == WARNED[0], adjustment.contains("provider"), kind.contains("future") | symbol.endswith("=F"), (kind == "forex") | symbol.endswith("=X"), (kind == "crypto") | symbol.contains("-"))
    codes = F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), code) for t, code in zip(tests, SOURCE_WARNINGS))))
    return F.when(provider.isin(*WARNED), codes).otherwise(F.array().cast("array<string>"))


def episode_gap(length: Column | int, horizon: Column | int, least: Column | int) -> Column:
    """Bars that part two episodes: the longest of the window, its horizon and the least separation."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(lit(length), lit(horizon), lit(least))


def revised(stored: Column, found: Column) -> Column:
    """Whether the data behind a stored row are other ones now."""
    return ~stored.eqNullSafe(found)


def group_coverage(a: Column, b: Column, groups: list[str]) -> Column:
    """A map from group to the share of its features that both vectors know."""
    known = F.zip_with(a, b, lambda x, y: (x.isNotNull() & y.isNotNull()).cast("int"))
    entries = []
    for g in dict.fromkeys(groups):
        at = [k for k, h in enumerate(groups) if h == g]
        total = F.lit(0)
        for k in at:
            total = total + F.get(known, F.lit(k))
        entries += [F.lit(g), total / len(at)]
    return F.create_map(*entries)
