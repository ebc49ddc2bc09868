"""Streams of offers and of price checks that come in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bazaarium.functions import text
from bazaarium.operators import offers as ops

ALERT = "watch_id string, check_id long, check_ts timestamp, prev_price double, new_price double, diff_pct double"


def enriched(offers: DataFrame, region: int = 213) -> DataFrame:
    """Offers of a stream with regional price and relevance; needs no state."""
    priced = ops.for_region(offers, F.lit(region))
    score = text.relevance(F.col("query"), F.col("name"), F.col("characteristics"), F.col("rating"), F.col("reviews_count"))
    return priced.withColumn("relevance", F.coalesce("relevance", score) if "relevance" in offers.columns else score)


def distinct_offers(offers: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First offer of each (query, link) within the watermark."""
    return offers.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["query_id", "url"])


def _alerts(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Compare each check that found a price with the one before; the state is the last price."""
    prev = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values(["check_ts", "check_id"])
    out = []
    for r in rows.itertuples(index=False):
        if r.best_price is None or pd.isna(r.best_price):
            continue
        price = float(r.best_price)
        if prev is not None and prev > 0:
            diff = (price - prev) / prev * 100
            if abs(diff) >= r.threshold_pct:
                out.append((key[0], r.check_id, r.check_ts, prev, price, diff))
        prev = price
    if prev is not None:
        state.update((prev,))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in ALERT.split(", ")])


def alert_stream(checks: DataFrame) -> DataFrame:
    """Alerts of a stream of checks (watch_id, check_id, check_ts, best_price double, threshold_pct), with a baseline per watch.

    Alerts come with the micro-batch of their check, so a micro-batch must not be older than those before it; where that may
    happen ``stateful.alert_stream`` waits for the watermark instead.  Checks of one micro-batch are taken in order of time.
    """
    return checks.groupBy("watch_id").applyInPandasWithState(_alerts, ALERT, "price double", "append", GroupStateTimeout.NoTimeout)


def hourly_stream(points: DataFrame, delay: str = "2 hours") -> DataFrame:
    """An extension: counts and mean prices by source and hour of event time, emitted when the watermark passes."""
    found = points.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "source").agg(F.count("*").alias("points"), F.avg(F.col("price").cast("double")).alias("mean_price"))
    return found.select("source", F.col("window.start").alias("window_start"), "points", "mean_price")
