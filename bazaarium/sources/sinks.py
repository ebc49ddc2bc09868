"""Sinks: snapshots with a lifetime, reports as CSV, and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bazaarium.functions import urls


def write_snapshot(df: DataFrame, path: str, now: Column, fresh_s: int, stale_s: int) -> None:
    """Append rows with the times until which they are fresh and may be served stale."""
    stamped = df.withColumn("expires_at", F.timestamp_add("SECOND", F.lit(fresh_s), now)).withColumn("stale_until", F.timestamp_add("SECOND", F.lit(stale_s), now))
    stamped.write.mode("append").parquet(path)


def read_snapshot(spark: SparkSession, path: str, now: Column, stale: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows still fresh, or with ``stale`` those that may still be served; of each of ``keys`` those written last.

    Without ``keys`` the last write of all counts.
    """
    rows = spark.read.parquet(path)
    last = rows.groupBy(*keys).agg(F.max("expires_at").alias("expires_at"))
    kept = rows.join(last, [*keys, "expires_at"], "left_semi")
    return kept.where(F.col("stale_until" if stale else "expires_at") > now).drop("expires_at", "stale_until")


def write_sheets(chosen: DataFrame, every: DataFrame, path: str) -> None:
    """The two tables of a justification as CSV with headers, each row's query in a folder of its own."""
    for name, sheet in (("summary", chosen), ("all_sources", every)):
        sheet.write.mode("overwrite").option("header", True).partitionBy("query_id").csv(f"{path}/{name}")


def observed(offers: DataFrame, name: str = "offers") -> tuple[DataFrame, Observation]:
    """Offers, with counters that are filled while they are used."""
    seen = Observation(name)
    counts = [F.count_if(F.col("source") == s).alias(f"{s}_offers") for s in ("wb", "ozon", "ya_market", "runet")]
    return offers.observe(seen, F.count("*").alias("offers"), F.count_if(F.col("price") > 0).alias("priced"), *counts), seen


def image_cache_keys(offers: DataFrame) -> DataFrame:
    """(source, image, key) of the pictures that may be kept, by source and link: those on an allowed host."""
    distinct = offers.where(F.col("image").rlike("^https?://") & urls.allowed_host(urls.host(F.col("image")))).select("source", "image").distinct()
    return distinct.withColumn("key", F.concat_ws("/", "source", F.sha1("image")))
