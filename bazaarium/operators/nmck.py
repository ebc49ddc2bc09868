"""Contract price: selection of comparable offers and its statistics.

The cheapest priced offer of each seller; of those within half and twice their median (or all, if fewer than three are),
the five most trusted; mean, sample deviation and variation of their prices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarium import values as V
from bazaarium.functions import pricing
from bazaarium.operators.offers import with_group
from bazaarium.operators.ranking import medians, placed
from bazaarium.session import stored


#: What statistics need of an offer, and what the sheets show beside it.
NEEDED, SHOWN = ("query_id", "source", "seller", "price", "rating", "reviews_count", "pos"), ("name", "url")


def one_per_seller(offers: DataFrame) -> DataFrame:
    """Cheapest priced offer of each seller of a query, the first of equal ones; adds ``seller_key``."""
    keyed = offers.where("price > 0").withColumn("seller_key", pricing.seller_key(F.col("seller"), F.col("source")))
    rest, order = [c for c in keyed.columns if c not in ("query_id", "seller_key", "price", "pos")], ("price", "pos")
    if any("map<" in kind for _, kind in keyed.dtypes):  # has no order, so it can't stand behind the order in one minimum
        first = F.min_by(F.struct(*order, *rest), F.struct(*order))
    else:
        first = F.min(F.struct(*order, *rest))
    # Partial minima meet before the shuffle, so a large seller is no large group.
    return keyed.groupBy("query_id", "seller_key").agg(first.alias("_o")).select("_o.*", "query_id", "seller_key").select(*keyed.columns)


def selection(offers: DataFrame, preview: bool = False) -> DataFrame:
    """The chosen offers with ``number`` from 1, ``market_median`` and ``trust``.

    Pools of fewer than three sellers give their offers by price.  ``preview`` is the variant of a page, which takes a
    rating of 0 for a missing one.
    """
    p, low, high = F.col("price").cast("double"), *V.NMCK_BAND
    pool = stored(one_per_seller(offers), "sellers")
    # Facts are written: Spark then knows when it plans whether they are few, and deals out the pool only where they are not.
    facts = stored(with_group(medians(pool, ["query_id"], "price", "market_median"), pool.groupBy("query_id").agg(F.count("*").alias("sellers")), "query_id"), "market")
    banded = with_group(pool, facts, "query_id").withColumn("in_band", p.between(F.col("market_median") * low, F.col("market_median") * high))
    counts = stored(banded.groupBy("query_id").agg(F.count_if("in_band").alias("banded")), "banded")
    kept = with_group(banded, counts, "query_id").where((F.col("banded") < V.NMCK_LEAST) | F.col("in_band"))
    rating = F.nullif(F.col("rating"), F.lit(0.0)) if preview else F.col("rating")
    trusted = kept.withColumn("trust", pricing.seller_trust(F.col("reviews_count"), rating))
    few = F.col("sellers") < V.NMCK_LEAST
    order = W.partitionBy("query_id").orderBy(F.when(few, F.lit(0.0)).otherwise(-F.col("trust")), F.when(few, p).otherwise(F.abs(p - F.col("market_median"))), "pos")
    return trusted.withColumn("number", F.row_number().over(order)).where(F.col("number") <= V.NMCK_OFFERS).drop("banded", "in_band")


def statistics(offers: DataFrame, preview: bool = False) -> DataFrame:
    """Per query with three chosen offers or more: n_offers, mean, stdev, cv_pct, homogeneous and the sellers used.

    ``homogeneous`` is told by the variation before rounding; a ``preview`` is not rounded.
    """
    return _statistics(selection(offers.select(*NEEDED), preview), preview)


def _statistics(chosen: DataFrame, preview: bool = False) -> DataFrame:
    p = F.col("price").cast("double")
    digits = (lambda c: c) if preview else (lambda c: F.round(c, 2))
    seller = F.coalesce(F.nullif(F.trim("seller"), F.lit("")), pricing.source_label(F.col("source")))
    found = chosen.groupBy("query_id").agg(
        F.count("*").alias("n_offers"), F.avg(p).alias("mu"), F.stddev_samp(p).alias("sigma"), F.transform(F.array_sort(F.collect_list(F.struct("number", seller.alias("seller")))), lambda x: x["seller"]).alias("sources_used")
    )
    cv = F.when(F.col("mu") > 0, F.col("sigma") / F.col("mu") * 100).otherwise(0.0)
    return found.where(F.col("n_offers") >= V.NMCK_LEAST).select("query_id", "n_offers", digits(F.col("mu")).alias("mean"), digits(F.col("sigma")).alias("stdev"), digits(cv).alias("cv_pct"), (cv <= V.NMCK_VARIATION).alias("homogeneous"), "sources_used")


def chosen_sheet(offers: DataFrame, quantity: int = 1) -> DataFrame:
    """The chosen offers of a justification with their statistics and total."""
    few = stored(selection(offers.select(*NEEDED, *SHOWN)), "chosen")
    stats = _statistics(few).select("query_id", "n_offers", "mean", "stdev", "cv_pct", "homogeneous", (F.col("mean") * quantity).alias("total"))
    return few.select("query_id", "number", pricing.source_label(F.col("source")).alias("source_label"), "seller", "name", "price", "url").join(stats, "query_id")


#: The order of all offers of a justification.
WHOLE_ORDER = ("source_label", "price", "pos")


def labelled(offers: DataFrame) -> DataFrame:
    """All offers of a justification in no order yet, for a sink that brings them into ``WHOLE_ORDER``."""
    return offers.select("query_id", pricing.source_label(F.col("source")).alias("source_label"), "seller", "name", "price", "url", "pos")


def whole_sheet(offers: DataFrame) -> DataFrame:
    """All offers of a justification by source and price."""
    every = placed(labelled(offers), ["query_id"], [F.asc(c) for c in WHOLE_ORDER], "number")
    return every.select("query_id", "number", "source_label", "seller", "name", "price", "url")


def sheets(offers: DataFrame, quantity: int = 1) -> tuple[DataFrame, DataFrame]:
    """Both tables of a justification."""
    return chosen_sheet(offers, quantity), whole_sheet(offers)
