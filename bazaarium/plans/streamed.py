"""Streams over the driver's event files, run to their end and read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarium.functions import pricing
from bazaarium.plans import bridge
from bazaarium.session import shared_dir, stored
from bazaarium.streaming import counters, stateful, streams


def _folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _run(found: DataFrame, mode: str = "append") -> DataFrame:
    """Write a stream's result as Parquet until its input is used up, and read it."""
    spark, path = found.sparkSession, _folder(found.sparkSession)
    job = found.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/out")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of the files of a folder."""
    path = f"{_folder(spark)}/in"
    bridge.table(spark, sf_dir, "events").write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def _run_parts(parts: list[DataFrame], stream: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Add each part to the input of one stream in turn and run the stream until it has used it up; what it wrote in all."""
    spark, path = parts[0].sparkSession, _folder(parts[0].sparkSession)
    schema = None
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        with stateful.rocksdb(spark):
            found = stream(spark.readStream.schema(part.schema).parquet(f"{path}/in"))
            schema = found.schema
            job = found.writeStream.outputMode(mode)
            write = lambda df, _: df.write.mode("append").parquet(f"{path}/out")
            job.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out")


def price_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the checks in the event stream, which comes in three parts that overlap in time and an empty check that ends it."""
    e = bridge.table(spark, sf_dir, "events")
    price = F.when(F.col("event_id") % 10 != 0, F.col("value").cast("decimal(12,2)").cast("double"))
    checks = e.select(F.concat_ws("/", "user_id", "event_type").alias("watch_id"), F.col("event_id").alias("check_id"), F.col("ts").cast("timestamp").alias("check_ts"), price.alias("best_price"), F.lit(2.0).alias("threshold_pct"))
    first, last = checks.agg(F.min(F.unix_seconds("check_ts")), F.max(F.unix_seconds("check_ts"))).first()
    third = max(1, (last - first) // 3 + 1)
    late = (F.col("check_id") % 4 == 0).cast("int")
    part = F.least(F.lit(2), ((F.unix_seconds("check_ts") - first) / third).cast("int") + late)
    ends = spark.range(1).select(F.lit("end").alias("watch_id"), F.lit(0).cast("long").alias("check_id"), F.timestamp_seconds(F.lit(last + 3 * third + 60)).alias("check_ts"), F.lit(None).cast("double").alias("best_price"), F.lit(2.0).alias("threshold_pct"))
    found = _run_parts([*[checks.where(part == n) for n in range(3)], ends], lambda c: stateful.alert_stream(c, f"{2 * third} seconds"))
    return found.select("watch_id", "check_id", F.round("diff_pct", 4).alias("diff_pct"))


def search_rows(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Offers and ends of sources in four parts: wb ends early, ozon never, so time has to end it; the last row moves time on."""
    o = bridge.offers(spark, sf_dir)
    place = F.concat_ws("-", *[F.format_string("%012d", F.col(c)) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
    score = stateful.worth(F.col("rating"), pricing.reviews_of(F.col("characteristics")))
    some = o.select("query_id", F.lit("offer").alias("kind"), "source", F.lit(None).cast("string").alias("error"), place.alias("pos"), F.col("price").cast("double").alias("price"), score.alias("worth"), (F.col("l_orderkey") % F.when(F.col("source") == "wb", 2).otherwise(3)).alias("part"))
    some = stored(some, "search-offers")  # each part reads them, and so do the ends
    ends = some.select("query_id", "source").where("source <> 'ozon'").distinct().select("query_id", F.lit("finished").alias("kind"), "source", F.when(F.col("source") == "runet", "partial").alias("error"), F.lit(None).cast("string").alias("pos"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("double").alias("worth"), F.when(F.col("source") == "wb", 2).otherwise(3).cast("long").alias("part"))
    rows = some.unionByName(ends)
    tick = spark.range(1).select(F.lit("").alias("query_id"), F.lit("tick").alias("kind"), F.lit("").alias("source"), *[F.lit(None).cast(k).alias(c) for c, k in (("error", "string"), ("pos", "string"), ("price", "double"), ("worth", "double"))], at(3600).alias("fetched_at"))
    return [*[rows.where(F.col("part") == n).drop("part").withColumn("fetched_at", at(10 * n)) for n in range(4)], tick]


def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of the searches in ``search_rows``; the offers of a query never all arrive in one micro-batch."""
    return _run_parts(search_rows(spark, sf_dir), stateful.search_events).where("query_id <> ''")


def search_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What searches end with: stats of each source, ranked deals, and, in the row of ``done``, how many offers came and whether all came in order."""
    e = search_events(spark, sf_dir)
    none = lambda kind: F.lit(None).cast(kind)
    ends = e.where("event IN ('source_finished', 'top_deal')").select("query_id", "event", "source", "rank", F.col("pos").alias("offer"), F.round("score", 4).alias("score"), "offers", "min_price", F.round(F.col("avg_price") * F.col("offers"), 2).alias("total_price"), F.round("median_price", 3).alias("median_price"), "error", none("int").alias("in_order"))
    stage = F.when(F.col("event") == "source_started", 1).when(F.col("event") == "offer", 2).when(F.col("event") == "source_finished", 3)
    by_source = e.where(stage.isNotNull()).groupBy("query_id", "source").agg(*[F.min(F.when(stage == n, F.col("seq"))).alias(f"a{n}") for n in (1, 2, 3)], F.max(F.when(stage == 2, F.col("seq"))).alias("z2"), F.max("seq").alias("last"))
    sound = by_source.groupBy("query_id").agg(F.every(F.coalesce((F.col("a1") < F.col("a2")) & (F.col("z2") < F.col("a3")), F.lit(True))).alias("sources"), F.max("last").alias("last"))
    whole = e.groupBy("query_id").agg(F.sum((F.col("event") == "offer").cast("long")).alias("offers"), F.count("*").alias("n"), F.max("seq").alias("seq"), F.count_distinct("seq").alias("distinct"), F.min(F.when(F.col("event") == "top_deal", F.col("seq"))).alias("deals"), F.max(F.when(F.col("event") == "done", F.col("seq"))).alias("done"))
    order = F.col("sources") & (F.col("last") < F.col("deals")) & (F.col("done") == F.col("seq")) & (F.col("n") == F.col("seq")) & (F.col("distinct") == F.col("n"))
    done = whole.join(sound, "query_id").select("query_id", F.lit("done").alias("event"), none("string").alias("source"), none("int").alias("rank"), none("string").alias("offer"), none("double").alias("score"), "offers", *[none("double").alias(c) for c in ("min_price", "total_price", "median_price")], none("string").alias("error"), order.cast("int").alias("in_order"))
    return ends.unionByName(done).withColumns({c: F.col(c).cast("double") for c in ("rank", "offers", "in_order")})


def running_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters after each of three parts of the offers, in which links come again."""
    o = bridge.offers(spark, sf_dir).select("query_id", "source", "url", (F.col("l_orderkey") % 3).alias("part"))
    parts = [o.where(F.col("part") == n).select("query_id", "source", "url", F.timestamp_seconds(F.lit(1_700_000_000 + 60 * n)).alias("fetched_at")) for n in range(3)]
    with counters.counting(spark) as seen:
        _run_parts(parts, counters.counted_offers)
    return spark.createDataFrame([(n, k, v) for n, after in enumerate(seen.after) for k, v in after.items()], "part long, counter string, offers long")


def price_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of the event stream as they are after its last part, the newest 200 points of each."""
    p = bridge.table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("item_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("decimal(12,2)").alias("price"), "event_id")
    parts = [p.where(F.col("event_id") % 3 == n).drop("event_id") for n in (2, 0, 1)]
    found = _run_parts(parts, lambda s: stateful.series_stream(s, 200), "update")
    last = found.groupBy("source", "item_id").agg(F.max_by("points", "version").alias("points"))
    return last.select("source", "item_id", F.posexplode("points").alias("place", "p")).select("source", "item_id", (F.col("place") + 1).alias("place"), "p.ts", "p.price")


def hourly_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of the event stream that the watermark has passed."""
    e = _events(spark, sf_dir)
    points = e.select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))
    return _run(streams.hourly_stream(points)).select("source", "window_start", "points", F.round("mean_price", 4).alias("mean_price"))
