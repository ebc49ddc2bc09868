"""Offers out of captured payloads: JSON responses, widget maps, card texts and pages.

Every reader takes a DataFrame with the payload in a column, and drops rows that cannot make an offer.  Fetching is not
done here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarium.functions import jsonld, numbers, urls
from bazaarium.functions.pricing import plausible
from bazaarium.operators.offers import dedup_listing

STUB = "struct<nm: string, id: string, sku: string, name: string, brand: string, url: string, image: string, price_rub: double, price: double, sizes: array<struct<price: struct<total: double, product: double, basic: double>>>, supplier: string, rating: double, feedbacks: int>"
PAGE = f"hydration array<{STUB}>, jsonld array<{STUB}>, dom array<{STUB}>"
CARD = "nm_id long, imt_id long, imt_name string, slug string, description string, selling struct<brand_name: string>, subj_root_name string, subj_name string, media struct<photo_count: int, has_video: boolean>, grouped_options array<struct<group_name: string, options: array<struct<name: string, value: string>>>>, options array<struct<name: string, value: string>>, clientPriceU long, discountPriceU long, basicPriceU long, extended struct<clientPriceU: double, discountPriceU: double, basicPriceU: double>, colors array<string>"
FEEDBACK_PAGE = "feedbackCount int, feedbackCountWithPhoto int, feedbackCountWithVideo int, valuation string, valuationDistribution map<string, int>, feedbacks array<struct<id: string, nmId: long, productValuation: int, text: string, pros: string, cons: string, color: string, size: string, createdDate: string, votes: struct<pluses: int, minuses: int>, photos: array<struct<id: string, key: string, isReady: boolean>>>>"


def _filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def catalogue_stubs(captured: DataFrame, payload: str = "payload", *keep: str) -> DataFrame:
    """Product stubs of a result page: of its three extracts the first that is not empty, in page order (``pos``)."""
    page = captured.select(*keep, F.from_json(payload, PAGE).alias("p"))
    some = [F.when(F.size(f"p.{way}") > 0, F.col(f"p.{way}")) for way in ("hydration", "jsonld", "dom")]
    stubs = page.select(*keep, F.posexplode(F.coalesce(*some)).alias("pos", "s"))
    price = F.coalesce(*[F.when(plausible(p), p) for p in (F.col("s.price_rub"), *[F.try_element_at("s.sizes", F.lit(1))["price"][k] / 100 for k in ("total", "product", "basic")], F.col("s.price"))])
    name = F.regexp_replace(F.trim("s.name"), r"(?U)^[\s/,.;:\-–—]+", "")
    found = stubs.select(*keep, "pos", F.coalesce(*[F.col(f"s.{k}").try_cast("long") for k in ("nm", "id", "sku")]).alias("nm_id"), name.alias("name"), F.coalesce(F.get_json_object("s.brand", "$.name"), F.col("s.brand")).alias("brand"), "s.supplier", "s.url", "s.image", price.cast("decimal(12,2)").alias("price"), "s.rating", F.col("s.feedbacks").alias("reviews_count"))
    return found.where("nm_id IS NOT NULL")


def _rubles(kopecks: Column) -> Column:
    """Whole rubles of a plausible price in kopecks."""
    return F.when(plausible(kopecks, 500_000_000), F.floor(kopecks / 100))


def _size_price(colors: Column) -> Column:
    """The first plausible price of a size of a colour; what is no object is passed over."""
    sizes = F.flatten(F.transform(F.coalesce(colors, F.array().cast("array<string>")), lambda c: F.coalesce(F.from_json(c, "sizes array<string>")["sizes"], F.array().cast("array<string>"))))
    each = F.transform(sizes, lambda s: F.from_json(F.get_json_object(s, "$.price"), "product double, basic double, total double"))
    prices = F.transform(each, lambda p: _rubles(F.coalesce(*[F.nullif(p[k], F.lit(0.0)) for k in ("product", "basic", "total")])))
    return F.get(F.filter(prices, lambda p: p.isNotNull()), F.lit(0))


def cards(captured: DataFrame, payload: str = "payload", *keep: str) -> DataFrame:
    """Card details, with options as (group, name, value) triples and the price from any of its fields."""
    c = captured.select(*keep, F.from_json(payload, CARD).alias("c")).where("c.nm_id IS NOT NULL")
    triple = lambda group, o: F.struct(group.alias("group"), o["name"].alias("name"), o["value"].alias("value"))
    grouped = F.flatten(F.transform("c.grouped_options", lambda g: F.transform(g["options"], lambda o: triple(g["group_name"], o))))
    flat = F.transform("c.options", lambda o: triple(F.lit(""), o))
    price = F.coalesce(*[_rubles(F.col(f"c.{at}{k}")) for at in ("extended.", "") for k in ("clientPriceU", "discountPriceU", "basicPriceU")], _size_price(F.col("c.colors")))
    return c.select(
        *keep, "c.nm_id", "c.imt_id", "c.imt_name", "c.description", F.col("c.selling.brand_name").alias("brand"), F.col("c.subj_root_name").alias("category_root"), F.col("c.subj_name").alias("category"),
        F.col("c.media.photo_count").alias("photo_count"), F.coalesce("c.media.has_video", F.lit(False)).alias("has_video"), F.when(F.size("c.grouped_options") > 0, grouped).otherwise(flat).alias("characteristics"), price.alias("price_rub"),
    )


def with_cards(stubs: DataFrame, details: DataFrame) -> DataFrame:
    """Stubs with what their card adds: a stub's own values stay, empty ones are filled."""
    d = details.select("nm_id", "imt_id", F.col("brand").alias("_brand"), F.col("imt_name").alias("_name"), F.col("price_rub").alias("_price"), F.col("characteristics").alias("_triples"))
    joined = stubs.join(d, "nm_id", "left")
    pairs = F.transform(F.coalesce("_triples", F.array().cast("array<struct<group: string, name: string, value: string>>")), lambda t: F.struct(t["name"].alias("key"), t["value"].alias("value")))
    own = F.array(F.struct(F.lit("Бренд").alias("key"), _filled(F.col("brand"), F.col("_brand")).alias("value")), F.struct(F.lit("Поставщик").alias("key"), F.col("supplier").alias("value")))
    every = F.filter(F.concat(pairs, own), lambda p: (F.coalesce(p["key"], F.lit("")) != "") & (F.coalesce(p["value"], F.lit("")) != ""))
    return joined.select(*[c for c in stubs.columns if c not in ("name", "brand", "price")], "imt_id", _filled(F.col("name"), F.col("_name")).alias("name"), _filled(F.col("brand"), F.col("_brand")).alias("brand"), F.coalesce("price", F.col("_price").cast("decimal(12,2)")).alias("price"), jsonld.first_wins(every).alias("characteristics"))


def catalogue_offers(stubs: DataFrame) -> DataFrame:
    """Stubs as offers; those without name, price or link go.  The cover comes first among the pictures."""
    link = _filled(F.col("url"), F.format_string("https://www.wildberries.ru/catalog/%d/detail.aspx", F.col("nm_id")))
    image = _filled(F.col("image"), urls.image_url(F.col("nm_id")))
    found = stubs.withColumn("url", link).withColumn("image", image).withColumn("images", F.array_distinct(F.array("image", *[urls.image_url(F.col("nm_id"), n) for n in range(1, 6)])))
    return found.where("name <> '' AND price > 0").withColumn("source", F.lit("wb")).withColumn("item_id", F.col("nm_id").cast("string"))


def feedback_pages(captured: DataFrame, payload: str = "payload", *keep: str) -> DataFrame:
    """Totals of review pages; the distribution is carried as it came."""
    p = captured.select(*keep, F.from_json(payload, FEEDBACK_PAGE).alias("p"))
    return p.select(*keep, F.col("p.feedbackCount").alias("total"), F.col("p.feedbackCountWithPhoto").alias("with_photo"), F.col("p.feedbackCountWithVideo").alias("with_video"), "p.valuation", F.col("p.valuationDistribution").alias("valuation_distribution"))


def feedbacks(captured: DataFrame, payload: str = "payload", *keep: str, limit: int = 200) -> DataFrame:
    """Reviews of pages, those without article number left out, the newest ``limit`` of each page by their date's text."""
    rows = captured.withColumn("_page", F.monotonically_increasing_id()).select(*keep, "_page", F.posexplode(F.from_json(payload, FEEDBACK_PAGE)["feedbacks"]).alias("pos", "f")).where("f.nmId IS NOT NULL")
    found = rows.select(*keep, "_page", "pos", "f.id", F.col("f.nmId").alias("nm_id"), F.col("f.productValuation").alias("rating"), "f.text", "f.pros", "f.cons", "f.color", "f.size", F.col("f.createdDate").alias("created"), F.coalesce("f.votes.pluses", F.lit(0)).alias("pluses"), F.coalesce("f.votes.minuses", F.lit(0)).alias("minuses"), F.transform(F.filter("f.photos", lambda p: p["isReady"]), lambda p: p["key"]).alias("photo_keys"))
    order = F.row_number().over(W.partitionBy("_page").orderBy(F.desc("created"), "pos"))
    return found.withColumn("place", order).where(F.col("place") <= limit).drop("_page")


# Beginnings of the names of widgets that hold search results.
RESULT_WIDGETS = ("searchResultsV2", "tileGridDesktop", "skuList")
WIDGET = "items array<struct<sku: string, skuId: string, title: string, name: string, price: string, finalPrice: string, link: string, image: string, rating: string, reviews: string, seller: string>>"


def widget_stubs(captured: DataFrame, payload: str = "payload", *keep: str) -> DataFrame:
    """Stubs of a page whose widgets are JSON texts under their names; broken ones are skipped, the first of an article stays."""
    widgets = captured.withColumn("_page", F.monotonically_increasing_id()).select(*keep, "_page", F.explode(F.from_json(payload, "widgetStates map<string, string>")["widgetStates"]).alias("widget", "state"))
    wanted = widgets.where(" OR ".join(f"startswith(widget, '{w}')" for w in RESULT_WIDGETS))
    items = wanted.select(*keep, "_page", "widget", F.posexplode(F.from_json("state", WIDGET)["items"]).alias("pos", "i"))
    link = F.when(F.startswith("i.link", F.lit("/")), F.concat(F.lit("https://www.ozon.ru"), F.col("i.link"))).otherwise(F.col("i.link"))
    found = items.select(*keep, "_page", "widget", "pos", _filled(F.col("i.sku"), F.col("i.skuId")).alias("item_id"), _filled(F.col("i.title"), F.col("i.name")).alias("name"), numbers.digits_price(_filled(F.col("i.price"), F.col("i.finalPrice"))).alias("price"), link.alias("url"), "i.image", numbers.comma_number(F.col("i.rating")).alias("rating"), numbers.comma_number(F.col("i.reviews"), "int").alias("reviews_count"), "i.seller")

    first = F.row_number().over(W.partitionBy("_page", F.coalesce("item_id", F.concat_ws("/", "widget", "pos"))).orderBy("widget", "pos"))
    return found.withColumn("_n", first).where("_n = 1").drop("_n", "_page")


def widget_offers(stubs: DataFrame) -> DataFrame:
    """Stubs as offers: link, name and price are needed; the seller is a characteristic too."""
    return stubs.where("url <> '' AND name <> '' AND price > 0").withColumn("source", F.lit("ozon")).withColumn("characteristics", F.map_filter(F.create_map(F.lit("Продавец"), F.col("seller")), lambda k, v: F.coalesce(v, F.lit("")) != ""))


def page_offers(pages: DataFrame, html: str = "html", url: str = "url", least: int = 100) -> DataFrame:
    """Product nodes of shop pages as offers: a name, and a price of ``least`` or more; the host sells."""
    text = lambda path: F.try_variant_get("node", path, "string")
    # Exploded, so that what is asked of name and price is found once; other fields only of what stays.
    n = jsonld.products(pages, html, (url,)).select(url, "node", F.explode(F.array(F.struct(F.trim(text("$.name")).alias("name"), jsonld.price(F.col("node")).alias("price")))).alias("_own"))
    n = n.where((F.coalesce("_own.name", F.lit("")) != "") & (F.col("_own.price") >= least))
    found = n.select(F.col(url).alias("url"), "_own.name", "_own.price", jsonld.image(F.col("node")).alias("image"), jsonld.brand(F.col("node")).alias("brand"), jsonld.characteristics(F.col("node")).alias("characteristics"), F.substring(text("$.description"), 1, 500).alias("description"), text("$.aggregateRating.ratingValue").try_cast("double").alias("rating"), text("$.aggregateRating.reviewCount").try_cast("int").alias("reviews_count"), urls.host(F.col(url)).alias("seller"))
    return found.withColumn("source", F.lit("runet"))


def market_offers(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Product nodes of a marketplace's pages as offers; the first of listed offers counts, and its count of ratings is a characteristic."""
    n = jsonld.products(pages, html, (url,))
    text = lambda path: F.try_variant_get("node", path, "string")
    offer = F.coalesce(F.try_variant_get("node", "$.offers[0]", "variant"), F.try_variant_get("node", "$.offers", "variant"))
    count = text("$.aggregateRating.ratingCount")
    found = n.select(text("$.name").alias("name"), jsonld.plain_price(offer).alias("price"), F.coalesce(F.try_variant_get(offer, "$.priceCurrency", "string"), F.lit("RUB")).alias("currency"), F.coalesce(text("$.url"), F.try_variant_get(offer, "$.url", "string")).alias("url"), jsonld.image(F.col("node")).alias("image"), text("$.aggregateRating.ratingValue").try_cast("double").alias("rating"), F.map_filter(F.create_map(F.lit("rating_count"), count), lambda k, v: v.isNotNull()).alias("characteristics"))
    return found.where("name <> '' AND price > 0 AND url <> ''").withColumn("source", F.lit("ya_market"))


def shopping_offers(cards: DataFrame, text: str = "text", title: str = "title", seller: str = "seller", query: str = "query", least: int = 100, image: str = "image") -> DataFrame:
    """Shopping cards (their text, title and seller) as offers: price of ``least`` or more and a seller whose shop is known or not.

    A picture, where the cards have any, is kept if it is a link or the picture itself (a data link).
    """
    body, name = F.col(text), F.trim(F.col(title))
    picture = F.when(F.col(image).rlike("^(http|data:image)"), F.col(image)) if image in cards.columns else F.lit(None).cast("string")
    found = cards.select(F.col(query).alias("query"), name.alias("name"), numbers.ruble_price(body).cast("decimal(12,2)").alias("price"), F.col(seller).alias("seller"), numbers.card_rating(body).alias("rating"), numbers.card_reviews(body).cast("int").alias("reviews_count"), numbers.title_attributes(name, body).alias("characteristics"), urls.seller_link(F.col(seller), name).alias("url"), picture.alias("image"))
    return found.where((F.col("price") >= least) & (F.coalesce("seller", F.lit("")) != "") & (F.length("name") >= 4)).withColumn("source", F.lit("runet"))


def organic_results(rows: DataFrame, text: str = "text") -> DataFrame:
    """Search results that have a cart mark or a rating, with rating and count."""
    body = F.col(text)
    found = rows.withColumn("rating", numbers.card_rating(body)).withColumn("reviews_count", numbers.card_reviews(body))
    return found.where(body.rlike("(?iu)в корзину|купить") | F.col("rating").isNotNull())


def organic_offers(results: DataFrame, pages: DataFrame) -> DataFrame:
    """Results with the product on their page; rating and count of the result fill what the page lacks."""
    r = results.select("url", F.col("rating").alias("_rating"), F.col("reviews_count").cast("int").alias("_reviews"))
    found = page_offers(pages).join(r, "url")
    return found.withColumn("rating", F.coalesce("rating", "_rating")).withColumn("reviews_count", F.coalesce("reviews_count", "_reviews")).drop("_rating", "_reviews")


def runet_offers(shopping: DataFrame, organic: DataFrame) -> DataFrame:
    """Both kinds of offers by name, shopping cards before others."""
    common = [c for c in shopping.columns if c in organic.columns]
    return shopping.select(*common, F.lit(0).alias("priority")).unionByName(organic.select(*common, F.lit(1).alias("priority")))


def runet_scan(shopping: DataFrame, organic: DataFrame, limit: int) -> DataFrame:
    """Both kinds of offers of each query: the first of each shop and name, shopping cards first, ``limit`` of a query.

    At most three times ``limit`` organic offers of a query are looked at.  Needs query_id and pos.
    """
    place = F.row_number().over(W.partitionBy("query_id").orderBy("pos"))
    candidates = organic.withColumn("_n", place).where(F.col("_n") <= 3 * limit).drop("_n")
    once = dedup_listing(runet_offers(shopping, candidates), F.col("priority"))
    order = F.row_number().over(W.partitionBy("query_id").orderBy("priority", "pos"))
    return once.withColumn("place", order).where(F.col("place") <= limit)


#: Readers by the kind of payload; callers add their own.
READERS: dict[str, Callable[..., DataFrame]] = {
    "catalogue": catalogue_stubs, "cards": cards, "feedbacks": feedbacks, "widgets": widget_stubs, "product_pages": page_offers,
    "market_pages": market_offers, "shopping": shopping_offers, "organic": organic_results,
}


def read(kind: str, captured: DataFrame, *args, **options) -> DataFrame:
    """Rows of a payload kind by its registered reader."""
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}; there are {', '.join(sorted(READERS))}")
    return READERS[kind](captured, *args, **options)
