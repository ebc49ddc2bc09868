"""Facets of a query's offers, and filtering by them.

One long table: (query_id, kind, label, min, max, value, offers); numeric facets have bounds, string facets a row for each
value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarium import values as V
from bazaarium.functions.numbers import first_number
from bazaarium.session import stored

SCHEMA = ["query_id", "kind", "label", "min", "max", "value", "offers"]


def builtin(offers: DataFrame) -> DataFrame:
    """Price, rating and number of reviews, where any offer has them."""
    rating = F.when(F.coalesce("rating", F.lit(0.0)) > 0, F.col("rating"))
    found = offers.groupBy("query_id").agg(F.min("price").alias("lo"), F.max("price").alias("hi"), F.count("price").alias("prices"), F.count(rating).alias("ratings"), F.max("reviews_count").alias("most"), F.count("reviews_count").alias("reviews"))

    def facet(label: str, n: str, lo: Column, hi: Column) -> Column:
        return F.struct(F.lit("numeric").alias("kind"), F.lit(label).alias("label"), lo.cast("double").alias("min"), hi.cast("double").alias("max"), F.lit(None).cast("string").alias("value"), F.col(n).alias("offers"))

    each = F.array(facet("Цена", "prices", F.floor("lo"), F.ceil("hi")), facet("Рейтинг", "ratings", F.lit(0), F.lit(5)), facet("Кол-во отзывов", "reviews", F.lit(0), F.ceil("most")))
    return found.select("query_id", F.explode(F.filter(each, lambda f: f["offers"] > 0)).alias("f")).select("query_id", "f.*")


def _facet_key(key: Column) -> Column:
    """Label of a characteristic, null where it makes no facet."""
    low, bad = F.lower(key), key.isin(*V.FACET_SKIPPED)
    for part in V.FACET_BLACKLIST:
        bad = bad | F.contains(low, F.lit(part))
    labels = F.create_map(*[F.lit(x) for pair in V.FACET_LABELS.items() for x in pair])
    return F.when(~bad, F.coalesce(F.try_element_at(labels, key), key))


def dynamic(offers: DataFrame, most: int = V.FACET_MOST) -> DataFrame:
    """Facets from characteristics with two values or more that enough offers have, the ``most`` common ones.

    Numeric if enough values are numbers that differ, else a row for each value.  Counts go by (query, label, value)
    first, so a common label is no single group of rows.
    """
    # One more pair without a key stands for the offer itself, so one pass counts offers and values; the counts are written
    # once, as what follows reads them three times.
    plain = F.coalesce("characteristics", F.create_map().cast("map<string,string>"))
    none = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    # Offers with equal characteristics are told apart by nothing here: they are counted first and looked at once.
    alike = offers.select("query_id", F.map_entries(plain).alias("_entries")).groupBy("query_id", "_entries").agg(F.count("*").alias("_alike"))
    pairs = alike.select("query_id", "_alike", F.explode(F.concat("_entries", none)).alias("p"))
    pairs = pairs.select("query_id", "_alike", F.when(F.col("p.key").isNotNull(), _facet_key(F.col("p.key"))).alias("label"), F.trim("p.value").alias("value"), F.col("p.key").isNull().alias("whole"))
    pairs = pairs.where("whole OR (label IS NOT NULL AND value IS NOT NULL AND value <> '')")
    counted = stored(pairs.groupBy("query_id", "label", "value").agg(F.sum("_alike").alias("n")), "facet-values")
    n = counted.where("label IS NULL").select("query_id", F.col("n").alias("all_offers"))
    by_value = counted.where("label IS NOT NULL").withColumn("number", first_number(F.col("value")))
    by_label = by_value.groupBy("query_id", "label").agg(
        F.count("*").alias("distinct_values"), F.sum("n").alias("offers"), F.sum(F.when(F.col("number").isNotNull(), F.col("n")).otherwise(0)).alias("numbers"), F.min("number").alias("lo"), F.max("number").alias("hi")
    )
    enough = F.col("offers") >= F.greatest(F.lit(2), F.ceil(F.col("all_offers") * V.FACET_COVERAGE))
    numeric = (F.col("numbers") / F.col("offers") >= V.FACET_NUMERIC) & (F.col("numbers") >= 2) & (F.col("hi") > F.col("lo"))
    kept = by_label.join(n, "query_id").where((F.col("distinct_values") >= 2) & enough).withColumn("numeric", F.coalesce(numeric, F.lit(False)))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("offers"), "label"))
    kept = kept.withColumn("place", place).where(F.col("place") <= most)
    bounds = kept.where("numeric").select("query_id", F.lit("numeric").alias("kind"), "label", F.floor("lo").cast("double").alias("min"), F.ceil("hi").cast("double").alias("max"), F.lit(None).cast("string").alias("value"), "offers")
    strings = kept.where("NOT numeric").select("query_id", "label").join(by_value, ["query_id", "label"])
    none = F.lit(None).cast("double")
    return bounds.unionByName(strings.select("query_id", F.lit("string").alias("kind"), "label", none.alias("min"), none.alias("max"), "value", F.col("n").alias("offers")))


def facets(offers: DataFrame) -> DataFrame:
    """Built-in and dynamic facets of each query."""
    return builtin(offers).select(*SCHEMA).unionByName(dynamic(offers).select(*SCHEMA))


def facet_value(label: str) -> Column:
    """An offer's value of a dynamic facet."""
    keys = [label, *[k for k, v in V.FACET_LABELS.items() if v == label]]
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at("characteristics", F.lit(k))), F.lit("")) for k in dict.fromkeys(keys)])


def apply_filters(offers: DataFrame, ranges: dict[str, tuple[float, float]] | None = None, choices: dict[str, list[str]] | None = None, sources: list[str] | None = None) -> DataFrame:
    """Offers that pass all filters: ranges include their ends, and an offer without the value passes.

    ``ranges`` go by ``price``, ``rating``, ``reviews`` or a label; ``choices`` by label; ``sources`` leave others out.
    """
    own = {"price": F.col("price").cast("double"), "rating": F.when(F.col("rating") > 0, F.col("rating")), "reviews": F.col("reviews_count").cast("double")}
    out = offers
    for label, (lo, hi) in (ranges or {}).items():
        value = own[label] if label in own else first_number(facet_value(label))
        out = out.where(value.isNull() | value.between(lo, hi))
    for label, wanted in (choices or {}).items():
        if wanted:
            value = facet_value(label)
            out = out.where(value.isNull() | value.isin(wanted))
    return out.where(F.col("source").isin(sources)) if sources else out


def search_values(found: DataFrame, part: str) -> DataFrame:
    """String facet values with ``part`` in them, whatever the case."""
    return found.where((F.col("kind") == "string") & F.contains(F.lower("value"), F.lit(part.lower())))
