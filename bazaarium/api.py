"""What a caller asks: search, deals, history, reviews, comparison, contract prices and watches, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarium.operators import history, nmck, normalize, offers, reviews, watches
from bazaarium.operators.facets import facets
from bazaarium.operators.reviews import breakdown

__all__ = ["clarify", "compare_offers", "explain_context", "facets", "get_price_history", "get_reviews_sample", "get_top_deals", "nmck_report", "search", "search_products", "sentiment", "watch_alerts"]


def search(offers_table: DataFrame, queries: DataFrame, max_per_source: int = 10, sources: list[str] | None = None, region_id: int = 213, fix: bool = True, keep: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Groups and best deals for (query_id, raw): the queries normalised, offers limited, priced for the region and scored.

    ``keep`` may hold the scored offers for the tables made of them: ``DataFrame.persist``, ``DataFrame.checkpoint`` or a written table.
    """
    if not 1 <= max_per_source <= 50:
        raise ValueError("max_per_source is 1 to 50")
    asked = normalize.normalized(queries, fix)
    found = offers.per_source_limit(offers.select_sources(offers_table, sources), max_per_source).join(asked.select("query_id", F.col("raw").alias("query")), "query_id")
    found = offers.for_region(found, F.lit(region_id)).withColumn("price", F.col("regional_price"))
    found = (keep or (lambda table: table))(offers.with_relevance(found, "query"))
    return {"queries": asked, "offers": found, "groups": offers.group_stats(found), "top_deals": offers.best_deals(found)}


def clarify(queries: DataFrame) -> DataFrame:
    return normalize.clarified(queries)


def search_products(offers_table: DataFrame, max_per_source: int = 5) -> DataFrame:
    """The first offers of each source, in short."""
    return offers.summary(offers.per_source_limit(offers_table, max_per_source))


def get_top_deals(offers_table: DataFrame, top_k: int = 5) -> DataFrame:
    """Best deals, never more than 5."""
    return offers.best_deals(offers_table, top=min(5, top_k)).select("query_id", "rank", "score", "source", "name", "price", "url")


def get_price_history(points: DataFrame, source: str, item_id: str, limit: int = 200) -> DataFrame:
    if not 0 < limit <= history.KEPT_POINTS:
        raise ValueError(f"limit is 1 to {history.KEPT_POINTS}")
    return history.series(points.where((F.col("source") == source) & (F.col("item_id") == item_id)), limit)


def get_reviews_sample(table: DataFrame, per_label: int = 2) -> tuple[DataFrame, DataFrame]:
    """Breakdown and quotes of classified reviews by item."""
    return breakdown(table, "item_id"), reviews.quotes(table, "item_id", n=per_label, rounded=True)


def compare_offers(items: DataFrame, points: DataFrame) -> DataFrame:
    return history.compare(items, points)


def sentiment(table: DataFrame) -> DataFrame:
    return breakdown(table, "item_id")


def nmck_report(offers_table: DataFrame, quantity: int = 1) -> dict[str, DataFrame]:
    """Statistics and the two tables of a justification."""
    if not 1 <= quantity <= 10_000:
        raise ValueError("quantity is 1 to 10000")
    chosen, every = nmck.sheets(offers_table, quantity)
    return {"statistics": nmck.statistics(offers_table), "chosen": chosen, "all_sources": every}


def explain_context(offers_table: DataFrame) -> DataFrame:
    return offers.market_context(offers_table)


def watch_alerts(checks: DataFrame) -> DataFrame:
    return watches.price_changes(checks)
