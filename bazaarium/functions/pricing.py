"""Prices: best-deal score, trust, regional price, dumping flag and what a page shows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarium import values as V


@dataclass(frozen=True)
class DealWeights:
    """Weights of the best-deal score."""

    price: float = -0.40
    rating: float = 0.25
    reviews: float = 0.15
    trust: float = 0.15
    delivery: float = -0.05


def deal_score(z: Column, rating: Column, reviews: Column, weights: DealWeights = DealWeights(), trust: float = 0.5, days: float = 3.0) -> Column:
    """Weighted sum of the price's z-score, rating, reviews, seller trust and days of delivery; a null rating counts 0."""
    return (
        F.lit(weights.price) * z
        + F.lit(weights.rating) * F.coalesce(rating, F.lit(0.0)) / 5
        + F.lit(weights.reviews) * F.ln(F.lit(1.0) + F.coalesce(reviews, F.lit(0))) / 10
        + F.lit(weights.trust * trust)
        + F.lit(weights.delivery * days / 30)
    )


def reviews_of(characteristics: Column) -> Column:
    """First of the counts kept among the characteristics that is a whole number other than 0, else 0."""
    tries = [F.nullif(F.try_element_at(characteristics, F.lit(k)).try_cast("int"), F.lit(0)) for k in ("feedbacks", "reviews", "rating_count")]
    return F.coalesce(*tries, F.lit(0))


def seller_trust(reviews: Column, rating: Column) -> Column:
    """Trust in an offer of the contract-price selection; a missing rating counts 4."""
    return F.log10(F.coalesce(reviews, F.lit(0)) + F.lit(1.0)) * F.coalesce(rating, F.lit(V.NMCK_RATING))


def seller_key(seller: Column, source: Column) -> Column:
    """Who sells: the seller's name in lower case without outer spaces, or the source where there is none."""
    return F.lower(F.trim(F.coalesce(F.nullif(F.trim(seller), F.lit("")), source)))


def source_label(source: Column) -> Column:
    """How a report names the source."""
    out = F.create_map(*[F.lit(x) for pair in V.SOURCE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(out, source), source)


def regional_price(price: Column, url: Column, region: Column, level: Column) -> Column:
    """Price in another region: the level there and up to one percent either way by the link, in whole units.

    The base region keeps its price; halves round up.
    """
    noise = (F.conv(F.substring(F.md5(url), 1, 2), 16, 10).cast("double") / 255 - 0.5) * 0.02
    moved = F.round((price.cast("double") * (F.coalesce(level, F.lit(V.DEFAULT_LEVEL)) + noise)).cast("decimal(20,6)"), 0).cast("decimal(12,2)")
    return F.when(region == V.BASE_REGION, price.cast("decimal(12,2)")).otherwise(moved)


def drop_pct(price: Column, median: Column) -> Column:
    """How far below the median a price is, in whole percent."""
    return F.round((median - price) / median * 100, 0).cast("int")


def dumping(drop: Column, group_size: Column, source: Column) -> Column:
    """Whether a price is suspiciously low in a group large enough to tell."""
    limit = F.when(source == "runet", V.DUMPING_DROP_RUNET).otherwise(V.DUMPING_DROP)
    return (group_size >= V.DUMPING_LEAST) & (drop >= limit)


def match_badge(relevance: Column) -> Column:
    """Bucket of the relevance shown with an offer."""
    return F.when(relevance >= 80, "high").when(relevance >= 60, "medium").otherwise("low")


def plausible(price: Column, most: float = 5_000_000) -> Column:
    """Whether a price is above 0 and below the given bound."""
    return (price > 0) & (price < most)


def shown_price(price: Column, currency: Column | None = None) -> Column:
    """A price (a number or its text) as shown: whole units, halves away from 0, thousands apart by no-break spaces, rubles by their sign.

    A text that is no number stays as it is; null stays null.
    """
    unit = F.lit("₽") if currency is None else F.when(F.coalesce(currency, F.lit("RUB")) == "RUB", "₽").otherwise(currency)
    whole = F.replace(F.format_number(F.round(price.try_cast("decimal(30,6)"), 0), 0), F.lit(","), F.lit("\u00a0"))
    return F.coalesce(F.concat(whole, F.lit(" "), unit), price.cast("string"))


def delta_arrow(pct: Column) -> Column:
    """A change in percent with an arrow."""
    mark = F.when(pct < 0, "↓").when(pct > 0, "↑").otherwise("=")
    return F.concat(mark, F.lit(" "), F.format_number(F.abs(pct), 1), F.lit("%"))


def time_ago(ts: Column, now: Column) -> Column:
    """How long ago a moment was, in minutes, hours or days."""
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 60_000_000)
    hours = F.floor(minutes / 60)
    said = F.when(minutes < 1, "только что").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" мин назад")))
    said = said.when(hours < 24, F.concat(hours.cast("string"), F.lit(" ч назад"))).otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit(" дн назад")))
    return F.when(ts.isNull(), "никогда").otherwise(said)
