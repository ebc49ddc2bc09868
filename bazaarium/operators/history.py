"""Price history: series of (source, item_id, ts, price)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["source", "item_id"]
KEPT_POINTS = 2000


def record(points: DataFrame, more: DataFrame) -> DataFrame:
    """Series with new points of positive price, the newest KEPT_POINTS of each."""
    return newest(points.unionByName(more.where("price > 0")), KEPT_POINTS)


def newest(points: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest points of each series."""
    order = W.partitionBy(*KEY).orderBy(F.desc("ts"), F.desc("price"))
    return points.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def series(points: DataFrame, limit: int = 200) -> DataFrame:
    """The newest ``limit`` points of each series with ``place``, oldest first."""
    return newest(points, limit).withColumn("place", F.row_number().over(W.partitionBy(*KEY).orderBy("ts", "price")))


def latest(points: DataFrame) -> DataFrame:
    """The newest point of each series."""
    last = F.max_by(F.struct("ts", "price"), F.struct("ts", "price"))
    return points.groupBy(*KEY).agg(last.alias("last")).select(*KEY, "last.ts", "last.price")


def compare(items: DataFrame, points: DataFrame) -> DataFrame:
    """Requested (request_id, source, item_id) with the latest price, null if there is none, and whether it is the lowest."""
    with_price = items.join(latest(points), KEY, "left")
    order = W.partitionBy("request_id").orderBy(F.asc_nulls_last("price"), *KEY)
    return with_price.withColumn("cheapest", (F.row_number().over(order) == 1) & F.col("price").isNotNull())


def sparkline(points: DataFrame) -> DataFrame:
    """Series of two points or more: first and last price, change in percent and trend (good below -2, bad above 2).

    From a first price of 0 the change is infinite, or not a number if the last is 0 too; both count as above 2.
    """
    at = F.struct("ts", "price")
    found = points.groupBy(*KEY).agg(F.count("*").alias("points"), F.min_by("price", at).cast("double").alias("first_price"), F.max_by("price", at).cast("double").alias("last_price"))
    first, rise = F.col("first_price"), F.col("last_price") - F.col("first_price")
    diff = F.when(first == 0, rise * F.lit(float("inf"))).otherwise(rise / first * 100)
    trend = F.when(diff < -2, "good").when(diff > 2, "bad").otherwise("flat")
    return found.where("points >= 2").withColumn("diff_pct", diff).withColumn("trend", trend)


def hourly(points: DataFrame, hours: int = 1) -> DataFrame:
    """An extension: min, mean and median price of each source by windows of event time."""
    own = points.withColumn("ts", F.col("ts").cast("timestamp"))
    found = own.groupBy("source", F.window("ts", f"{hours} hours")).agg(F.count("*").alias("points"), F.min("price").alias("min_price"), (F.sum("price").cast("double") / F.count("price")).alias("mean_price"), F.median("price").alias("median_price"))
    return found.select("source", F.col("window.start").alias("window_start"), "points", "min_price", "mean_price", "median_price")


def bursts(points: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """An extension: sessions of a source's points with no gap longer than ``gap``."""
    own = points.withColumn("ts", F.col("ts").cast("timestamp"))
    found = own.groupBy("source", F.session_window("ts", gap)).agg(F.count("*").alias("points"))
    return found.select("source", F.col("session_window.start").alias("session_start"), "points")
