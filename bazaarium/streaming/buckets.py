"""Keyed state over events in batch: token buckets, escalation after failures, and cache lifetimes.

A token bucket is a fold over each key's calls in order.  Rows are dealt by key and sorted, and the fold keeps one bucket
at a time, so a key of any size needs no memory of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarium.plans import bridge

# Lifetimes in seconds, and the source whose stale entries may be served.
FRESH_S, STALE_S, STALE_SOURCE = 900, {"wb": 21_600}, "wb"
STALE_OTHER_S = 3600


def consume(tokens: float, last: float, now: float, capacity: float, rate: float, want: float = 1.0) -> tuple[float, int]:
    """Tokens left and milliseconds to wait (0: granted) for one call; refusals keep the tokens that had come in."""
    tokens = min(capacity, tokens + max(0.0, now - last) * rate)
    return (tokens - want, 0) if tokens >= want else (tokens, math.ceil((want - tokens) / rate * 1000))


def token_bucket(calls: DataFrame, per_minute: int) -> DataFrame:
    """(key, call_id, ts, tokens, wait_ms) of calls (key, call_id, ts in seconds); no limit at 0 or less per minute."""
    if per_minute <= 0:
        return calls.select("key", "call_id", "ts", F.lit(None).cast("double").alias("tokens"), F.lit(0).cast("long").alias("wait_ms"))
    capacity, rate = float(per_minute), per_minute / 60

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tokens, last = None, capacity, 0.0
        for frame in frames:
            left, waits = [], []
            for k, ts in zip(frame["key"], frame["ts"], strict=True):
                if k != key:
                    key, tokens, last = k, capacity, ts
                tokens, wait = consume(tokens, last, ts, capacity, rate)
                last = ts
                left.append(tokens)
                waits.append(wait)
            yield frame.assign(tokens=left, wait_ms=waits)

    dealt = calls.select("key", "call_id", "ts").repartition("key").sortWithinPartitions("key", "ts", "call_id")
    return dealt.mapInPandas(fold, "key string, call_id long, ts double, tokens double, wait_ms long")


def calls_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls; a day counts as a minute, so that buckets run dry."""
    e = bridge.table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("key"), F.col("event_id").alias("call_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 1440).alias("ts"))


def escalations(failures: DataFrame, window_s: int = 7200, threshold: int = 3, top: int = 3) -> DataFrame:
    """(source, event_id, recent, level) of failed calls (source, event_id, ts).

    A failure that is the ``threshold``-th or later within the window (older ones at exactly its length are out) lifts
    the level by one, from 1 to ``top``; successes change nothing and levels never fall.
    """
    at = failures.withColumn("at", F.unix_micros("ts"))
    before = F.count("*").over(W.partitionBy("source").orderBy("at").rangeBetween(-(window_s * 1_000_000 - 1), -1))
    same = F.row_number().over(W.partitionBy("source", "at").orderBy("event_id"))
    counted = at.withColumn("recent", before + same)
    lifts = F.sum((F.col("recent") >= threshold).cast("int")).over(W.partitionBy("source").orderBy("at", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    return counted.withColumn("level", F.least(F.lit(top), lifts + 1).cast("int")).select("source", "event_id", "recent", "level")


def failures_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three events as failures."""
    e = bridge.table(spark, sf_dir, "events").where("event_id % 3 <> 0")
    return e.select(F.col("event_type").alias("source"), "event_id", F.col("ts").cast("timestamp").alias("ts"))


def cache_reads(points: DataFrame, fresh_s: int = FRESH_S, stale_source: str = "purchase", stale_s: int = STALE_S["wb"]) -> DataFrame:
    """Per series: reads by what the entry written last can serve: fresh, stale (where allowed) or miss."""
    last = F.lag("ts").over(W.partitionBy("source", "item_id").orderBy("ts", "price"))
    age = F.timestamp_diff("SECOND", last, F.col("ts"))
    limit = F.when(F.col("source") == stale_source, stale_s).otherwise(0)
    status = F.when(age < fresh_s, "fresh").when(age < limit, "stale").otherwise("miss")
    return points.withColumn("status", status).groupBy("source", "status").agg(F.count("*").alias("reads"))


def single_flight(calls: DataFrame, *key: str) -> DataFrame:
    """Calls at the same moment for the same key, fetched once: one row each with the number of followers."""
    return calls.groupBy(*key).agg(F.min("call_id").alias("leader"), (F.count("*") - 1).alias("followers"))
