"""Reviews: joined text, sentiment, quotes, ratings and order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarium.functions.numbers import review_time
from bazaarium.operators.ranking import placed

LABELS = ("positive", "neutral", "negative")


def joined_text(*parts: Column) -> Column:
    """Parts that are not blank, joined by spaces and trimmed."""
    kept = F.filter(F.array(*parts), lambda p: F.coalesce(F.trim(p), F.lit("")) != "")
    return F.trim(F.array_join(kept, " "))


def classified(reviews: DataFrame, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """Reviews with (label, score) of a model over ``text``; without a model all are neutral with score 0.

    Equal texts are classified once and joined back.
    """
    if model is None:
        return reviews.withColumn("label", F.lit("neutral")).withColumn("score", F.lit(0.0))
    once = reviews.select("text").distinct().withColumn("_s", model(F.col("text"))).select(F.col("text").alias("_text"), "_s.label", "_s.score")
    return reviews.join(once, reviews["text"].eqNullSafe(once["_text"]), "left").drop("_text")


def breakdown(results: DataFrame, *keys: str) -> DataFrame:
    """Counts and percents (to 0.1) of positive and negative labels, neutral being the rest."""
    found = results.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("label") == "positive").alias("positive"), F.count_if(F.col("label") == "negative").alias("negative"))
    found = found.withColumn("neutral", F.col("total") - F.col("positive") - F.col("negative"))
    return found.select("*", *[F.when(F.col("total") > 0, F.round(F.col(c) * 100.0 / F.col("total"), 1)).otherwise(0.0).alias(f"{c}_pct") for c in LABELS])


def quotes(results: DataFrame, *keys: str, n: int = 3, cut: int = 240, rounded: bool = False) -> DataFrame:
    """The ``n`` quotes of each label by votes and score, texts cut; ``rounded`` compares scores to 3 digits."""
    score = F.round("score", 3) if rounded else F.col("score")
    order = W.partitionBy(*keys, "label").orderBy(F.desc("pluses"), F.desc(score), "pos")
    return results.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).withColumn("text", F.substring("text", 1, cut))


def long_enough(reviews: DataFrame, least: int = 30, ui_labels: tuple[str, ...] = ()) -> DataFrame:
    """Reviews whose text has ``least`` characters or more and is no label of the page."""
    return reviews.where((F.length("text") >= least) & ~F.lower(F.trim("text")).isin(*[x.lower() for x in ui_labels] or [""]))


def enough_for_aspects(reviews: DataFrame, *keys: str, least: int = 20, texts: int = 3) -> DataFrame:
    """Reviews of ``least`` characters or more, of the items that have ``texts`` of them at least."""
    long = reviews.where(F.length(F.trim("text")) >= least)
    enough = long.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= texts)
    return long.join(enough, list(keys), "left_semi")


def dedup_reviews(reviews: DataFrame, *keys: str) -> DataFrame:
    """First review of each author and first 120 characters."""
    order = W.partitionBy(*keys, F.coalesce("author", F.lit("")), F.substring("text", 1, 120)).orderBy("pos")
    return reviews.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def rating_histogram(reviews: DataFrame, *keys: str) -> DataFrame:
    """Reviews by rating."""
    return reviews.groupBy(*keys, "rating").agg(F.count("*").alias("reviews"))


def sorted_reviews(reviews: DataFrame, by: str, *keys: str) -> DataFrame:
    """Reviews with ``place``: newest, oldest or by rating; dates that are none come last, a missing rating counts -1."""
    at = review_time(F.col("published_at"))
    first = {"newest": F.desc_nulls_last(at), "oldest": F.asc_nulls_last(at), "rating": F.desc(F.coalesce("rating", F.lit(-1)))}[by]
    return placed(reviews, list(keys), [first, F.asc("pos")])


def with_pages(offers: DataFrame, pages: DataFrame) -> DataFrame:
    """Offers with their review page (imt_id, valuation, total): the page's rating and total go before the offer's."""
    joined = offers.join(pages, "imt_id", "left")
    return joined.withColumn("rating", F.coalesce(F.col("valuation").try_cast("double"), F.col("rating"))).withColumn("reviews_count", F.coalesce(F.col("total"), F.col("reviews_count"))).select(*offers.columns)
