"""Running counters of a stream of offers, kept by a listener over the metrics that each micro-batch reports."""

from __future__ import annotations

from collections import Counter
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from bazaarium import values as V
from bazaarium.streaming.streams import distinct_offers

METRICS = "offers_seen"


class RunningCounters(StreamingQueryListener):
    """Sums of the counters that a stream reports; ``after`` has their state after each micro-batch with rows.

    Nothing but a number for each source comes to the driver.
    """

    def __init__(self, name: str = METRICS):
        self.name, self.totals, self.after = name, Counter(), []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None and row["offers"]:
            self.totals.update({k: v or 0 for k, v in row.asDict().items()})
            self.after.append(dict(self.totals))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def counted_offers(offers: DataFrame, delay: str = "1 hour", sources: tuple[str, ...] = V.SOURCES, name: str = METRICS) -> DataFrame:
    """Offers of a stream, each link of a query once within the watermark, with their counts by source reported as ``name``."""
    counts = [F.count_if(F.col("source") == s).alias(s) for s in sources]
    return distinct_offers(offers, delay).observe(name, F.count("*").alias("offers"), *counts)


@contextmanager
def counting(spark: SparkSession, name: str = METRICS):
    """Running counters of the streams that run inside; they are complete once the block has ended."""
    listener = RunningCounters(name)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        spark.streams.removeListener(listener)
