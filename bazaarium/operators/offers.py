"""Groups, ranks, price comparison, sorting and deduplication of offers.

Input tables have the columns of ``schemas.OFFERS``; only those named in a function are needed.  ``pos`` settles ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarium import values as V
from bazaarium.functions import pricing, text, urls
from bazaarium.operators.ranking import medians, placed
from bazaarium.session import stored


def select_sources(offers: DataFrame, wanted: list[str] | None = None, registered: tuple[str, ...] = ("wb", "ozon", "runet")) -> DataFrame:
    """Offers of the wanted sources that are registered; of all registered ones if none is named."""
    names = [s for s in wanted if s in registered] if wanted else list(registered)
    return offers.where(F.col("source").isin(names))


def priced(offers: DataFrame) -> DataFrame:
    """Offers with a price above 0."""
    return offers.where("price > 0")


def group_stats(offers: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Per (query_id, source): offers, min_price, avg_price, median_price; averages also to 0.01, halves to even.

    ``status`` (query_id, source, error, cached) adds groups without offers, with count 0 and their error.
    """
    facts = offers.groupBy("query_id", "source").agg(F.count("*").alias("offers"), F.min("price").alias("min_price"), F.avg("price").alias("mean"))
    found = with_group(facts, medians(offers, ["query_id", "source"], "price", "median_price"), "query_id", "source")
    shown = found.select("query_id", "source", "offers", "min_price", F.bround(F.col("mean"), 2).cast("decimal(12,2)").alias("avg_price"), "median_price", F.bround(F.col("median_price").cast("decimal(20,6)"), 2).cast("decimal(12,2)").alias("median_shown"))
    if status is None:
        return shown
    return status.join(shown, ["query_id", "source"], "left").withColumn("offers", F.coalesce("offers", F.lit(0)))


def with_group(rows: DataFrame, facts: DataFrame, *keys: str) -> DataFrame:
    """Rows with what is known of their group; ``facts`` has one row for each value of the keys, null among them.

    Facts are aggregated first and joined back, so no task holds a group's rows.  They go by broadcast only where Spark finds
    them small enough when it runs.
    """
    named = facts.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return rows.join(named, on, "left").drop(*[f"_of_{k}" for k in keys])


def with_deal_score(offers: DataFrame, weights: pricing.DealWeights = pricing.DealWeights(), reviews: Column | None = None) -> DataFrame:
    """Add ``score``: z-scores are over all offers of the query, with the sample deviation, 1 where that is 0 or unknown.

    ``reviews`` is where the count comes from; by default the characteristics, as rankings have always had it.
    """
    price = F.col("price").cast("double")
    facts = offers.groupBy("query_id").agg(F.count("*").alias("_n"), F.avg(price).alias("_mean"), F.stddev_samp(price).alias("_sd"))
    z = F.when(F.col("_n") < 2, F.lit(0.0)).otherwise((price - F.col("_mean")) / F.when(F.coalesce("_sd", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("_sd")))
    count = reviews if reviews is not None else pricing.reviews_of(F.col("characteristics"))
    return with_group(offers, facts, "query_id").withColumn("score", pricing.deal_score(z, F.col("rating"), count, weights)).drop("_n", "_mean", "_sd")


def best_deals(offers: DataFrame, top: int = 10, **scoring) -> DataFrame:
    """The ``top`` offers of each query by score: rank from 1, score to 4 digits."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    return with_deal_score(offers, **scoring).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("score", F.round("score", 4))


def cheapest(offers: DataFrame) -> DataFrame:
    """The cheapest priced offer of each query, the first of equal ones.

    Lowest prices are found first, by hashing; a minimum of whole offers would sort them all.  They are written, so that
    Spark knows their size when it plans and deals out the offers only where they are many.
    """
    lowest = stored(priced(offers).groupBy("query_id").agg(F.min("price").alias("_lowest")), "lowest")
    tied = with_group(priced(offers), lowest, "query_id").where(F.col("price") == F.col("_lowest")).drop("_lowest")
    offer = F.struct(*[c for c in offers.columns if c != "query_id"])
    return tied.groupBy("query_id").agg(F.min_by(offer, "pos").alias("offer")).select("query_id", "offer.*")


def cheapest_few(offers: DataFrame, n: int = 3) -> DataFrame:
    """(query_id, top_offers): snapshot of the n cheapest priced offers as (source, price, name, url)."""
    order = W.partitionBy("query_id").orderBy("price", "pos")
    few = priced(offers).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    item = F.struct("place", "source", F.col("price").cast("string").alias("price"), "name", "url")
    return few.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["source"], x["price"], x["name"], x["url"])).alias("top_offers"))


def market_context(offers: DataFrame) -> DataFrame:
    """Per query: median, mean, min and max of priced offers, mean rating, and number of sources of all offers."""
    p = F.when(F.col("price") > 0, F.col("price"))
    facts = offers.groupBy("query_id").agg(
        F.count(p).alias("priced"), (F.sum(p).cast("double") / F.count(p)).alias("mean_price"), F.min(p).alias("min_price"), F.max(p).alias("max_price"),
        F.avg("rating").alias("mean_rating"), F.count_distinct("source").alias("sources"),
    )
    return with_group(facts, medians(priced(offers), ["query_id"], "price", "median_price"), "query_id")


def against_market(offers: DataFrame) -> DataFrame:
    """Offers with ``delta_pct`` to the median of their query's priced offers, 0 where there is none."""
    context = market_context(offers).select("query_id", "median_price")
    delta = F.when(F.col("median_price") > 0, (F.col("price").cast("double") - F.col("median_price")) / F.col("median_price") * 100).otherwise(0.0)
    return offers.join(context, "query_id").withColumn("delta_pct", delta)


def totals_by_source(offers: DataFrame) -> DataFrame:
    """Count, min and mean price per source and over all sources (source null), per query."""
    return offers.rollup("query_id", "source").agg(F.count("*").alias("offers"), F.min("price").alias("min_price"), (F.sum("price").cast("double") / F.count("price")).alias("mean_price")).where("query_id IS NOT NULL")


def dumping_flags(offers: DataFrame) -> DataFrame:
    """Priced offers with their (query, source) group's median and size, ``drop_pct`` and ``dumping``."""
    keys = ["query_id", "source"]
    facts = with_group(medians(priced(offers), keys, "price", "group_median"), priced(offers).groupBy(*keys).agg(F.count("*").alias("group_size")), *keys)
    sized = with_group(priced(offers), facts, *keys)
    drop = sized.withColumn("drop_pct", pricing.drop_pct(F.col("price").cast("double"), F.col("group_median")))
    return drop.withColumn("dumping", pricing.dumping(F.col("drop_pct"), F.col("group_size"), F.col("source")))


def region_levels(spark) -> DataFrame:
    """(region_id, level): the fixed table of price levels."""
    return spark.createDataFrame([(k, v) for k, v in V.REGION_LEVELS.items()], "region_id int, level double")


def for_region(offers: DataFrame, region: Column) -> DataFrame:
    """Offers with ``region_id`` and ``regional_price`` there; regions without a level have the default one."""
    asked = offers.withColumn("region_id", region.cast("int"))
    levels = F.broadcast(region_levels(offers.sparkSession))  # a fixed table of some 30 rows
    joined = asked.join(levels, "region_id", "left")
    return joined.withColumn("regional_price", pricing.regional_price(F.col("price"), F.col("url"), F.col("region_id"), F.col("level"))).drop("level")


def with_relevance(offers: DataFrame, query: str = "query") -> DataFrame:
    """Offers with ``relevance`` where they have none; every row is scored, without a shuffle."""
    keep = F.col("relevance") if "relevance" in offers.columns else F.lit(None).cast("double")
    score = text.relevance(F.col(query), F.col("name"), F.col("characteristics"), F.col("rating"), F.col("reviews_count"))
    return offers.withColumn("relevance", F.coalesce(keep, score))


SORTS = {
    "relevance": lambda: [F.desc(F.coalesce("relevance", F.lit(0.0))), F.asc("price")],
    "price_asc": lambda: [F.asc("price")],
    "price_desc": lambda: [F.desc("price")],
    "reviews_desc": lambda: [F.desc(F.coalesce("reviews_count", F.lit(0)))],
    "reviews_asc": lambda: [F.asc(F.coalesce("reviews_count", F.lit(0)))],
}


def sorted_places(offers: DataFrame, mode: str) -> DataFrame:
    """Offers with ``place`` within their query in one of the five orders of SORTS."""
    return placed(offers, ["query_id"], [*SORTS[mode](), F.col("pos")])


def per_source_limit(offers: DataFrame, most: int | Column) -> DataFrame:
    """The first ``most`` offers of each (query, source)."""
    order = W.partitionBy("query_id", "source").orderBy("pos")
    return offers.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def first_of(offers: DataFrame, *keys: Column, order: tuple[Column, ...] = ()) -> DataFrame:
    """The first offer of each key."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*(order or (F.col("pos"),))))
    return offers.withColumn("_n", place).where("_n = 1").drop("_n")


def dedup_url(offers: DataFrame) -> DataFrame:
    """First offer of each link within a query."""
    return first_of(offers, F.col("query_id"), F.col("url"))


def dedup_listing(offers: DataFrame, priority: Column | None = None) -> DataFrame:
    """First offer of each seller and first 50 characters of the name; lower ``priority`` goes first."""
    seller = F.lower(F.trim(F.coalesce("seller", F.lit(""))))
    name = F.substring(F.lower(F.trim("name")), 1, 50)
    order = ((priority,) if priority is not None else ()) + (F.col("pos"),)
    return first_of(offers, F.col("query_id"), seller, name, order=order)


def dedup_host(offers: DataFrame) -> DataFrame:
    """First offer of each host within a query, hosts that other sources cover left out."""
    # A host is found once a row: a null one stands in a list of its own, so that Spark sees no step to find it in again.
    hosted = offers.withColumn("_host", F.explode(F.array(urls.host(F.col("url")))))
    return first_of(hosted.where(~urls.below(F.col("_host"), V.EXCLUDED_HOSTS)), F.col("query_id"), F.col("_host")).drop("_host")


def dedup_sku(offers: DataFrame, sku: str = "item_id") -> DataFrame:
    """First offer of each article within a query; offers without one all stay."""
    blank = F.coalesce(F.trim(F.col(sku)), F.lit("")) == ""
    return offers.where(blank).unionByName(first_of(offers.where(~blank), F.col("query_id"), F.col(sku)))


def summary(offers: DataFrame) -> DataFrame:
    """The fields an agent is shown of an offer."""
    return offers.select("query_id", "source", "name", F.col("price").cast("string").alias("price"), "currency", "url", "rating", "seller")
