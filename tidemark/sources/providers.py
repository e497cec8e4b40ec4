"""Payloads of data providers, manifests, file hashes and small reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bars import PRICES, repair

# What a dataset of a manifest must state.
MANIFEST_FIELDS = ("symbol", "name", "asset_class", "exchange", "currency", "timezone", "timeframe", "source", "path", "volume_type", "price_adjustment", "minimum_rows")


def nested_bars(payloads: DataFrame) -> DataFrame:
    """Bars of JSON payloads (instrument, asset_class, payload) that map a "Time Series" to {date: {field: text}}.

    A field is the first key that ends with its name, one without a foreign currency first. Volume of forex, or none, is 0; high
    and low are widened to enclose open and close; rows whose date does not parse are dropped.
    """
    series = F.from_json("payload", "map<string,string>")
    named = F.map_filter(series, lambda k, v: k.contains("Time Series"))
    days = F.from_json(F.get(F.map_values(named), F.lit(0)), "map<string,map<string,string>>")
    df = payloads.select("instrument", "asset_class", F.explode(days).alias("day", "fields"))

    def field(name: str) -> Column:
        keys = F.filter(F.map_keys("fields"), lambda k: F.lower(k).rlike(rf"(^|[^a-z]){name}([^a-z]|$)"))
        home = F.filter(keys, lambda k: ~k.rlike(r"\((?!USD\))[A-Z]{3}\)"))
        key = F.coalesce(F.get(home, F.lit(0)), F.get(keys, F.lit(0)))
        return F.when(key.isNotNull(), F.try_element_at("fields", key)).try_cast("double")

    out = df.select("instrument", F.try_to_timestamp("day").alias("ts"), *(field(p).alias(p) for p in PRICES), F.when(F.lower("asset_class") != "forex", field("volume")).alias("volume"))
    return repair(out.where("ts IS NOT NULL"))


def accept(bars: DataFrame) -> DataFrame:
    """By instrument why a provider's bars cannot be used; no row for those that can."""
    from pyspark.sql.window import Window

    seen = F.count("*").over(Window.partitionBy("instrument", "ts"))
    bad = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    df = bars.withColumn("_n", seen).groupBy("instrument").agg(F.max(F.col("_n") > 1).alias("dup"), F.max(F.least(*PRICES) <= 0).alias("neg"), F.max(bad).alias("bad"), F.max(F.greatest(*PRICES).isNull()).alias("none"))
    why = F.array_compact(F.array(F.when(F.col("dup"), "DUPLICATE_TIMESTAMPS"), F.when(F.col("neg"), "NON_POSITIVE_PRICE"), F.when(F.col("bad"), "INVALID_OHLC"), F.when(F.col("none"), "MISSING_PRICE")))
    return df.select("instrument", why.alias("reasons")).where(F.size("reasons") > 0)


def read_manifest(spark: SparkSession, text: str) -> DataFrame:
    """Datasets of a JSON manifest, one row each. Missing fields are an error."""
    datasets = json.loads(text)["datasets"]
    for d in datasets:
        if missing := [f for f in MANIFEST_FIELDS if f not in d]:
            raise ValueError(f"dataset {d.get('symbol')!r} lacks {', '.join(missing)}")
    schema = ", ".join(f"{f} {'long' if f == 'minimum_rows' else 'string'}" for f in MANIFEST_FIELDS)
    return spark.createDataFrame([tuple(d[f] for f in MANIFEST_FIELDS) for d in datasets], schema)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("source_hash"))


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
