"""Queries over payloads, pages and reviews made from the driver's tables and read back, each with its SQL (DuckDB).

The SQL states what the reader must find, straight from the table the payload was made of.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarium.functions import lemmas, pricing, text, urls
from bazaarium.operators import offers, reviews, watches
from bazaarium.plans import bridge
from bazaarium.session import shared_dir
from bazaarium.sources import adapters, captures, widgets
from bazaarium.sources.keyed import KeyedTable
from bazaarium.streaming import buckets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts, dealt out evenly: a row is small and its payload is not, and a file's groups of rows, which a task reads whole, may be few."""
    return bridge.table(spark, sf, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _cents(column: str = "p_retailprice") -> Column:
    return F.round(F.col(column) * 100).cast("long")


def _stub_payload() -> Column:
    """A result page with one product in one of its three extracts."""
    key = F.col("p_partkey")
    first = _json(hydration=F.array(F.struct(key.alias("nm"), F.concat(F.lit(" / "), F.col("p_name")).alias("name"), F.col("p_brand").alias("brand"), (_cents() / 100).alias("price_rub"), F.lit("s").alias("supplier"))))
    sizes = F.array(F.struct(F.struct(_cents().cast("double").alias("total")).alias("price")))
    second = _json(hydration=F.array().cast("array<string>"), jsonld=F.array(F.struct(key.cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), sizes.alias("sizes"))))
    third = _json(dom=F.array(F.struct(key.alias("sku"), F.col("p_name").alias("name"), F.lit(9e9).alias("price_rub"), (_cents() / 100).alias("price"))))
    return F.when(key % 3 == 0, first).when(key % 3 == 1, second).otherwise(third)


@query("SELECT p_partkey AS nm_id, p_name AS name, CASE WHEN p_partkey % 3 < 2 THEN p_brand END AS brand, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS price FROM part")
def catalogue_page_stubs(spark, sf):
    found = captures.catalogue_stubs(_parts(spark, sf).select(_stub_payload().alias("payload")))
    return found.select("nm_id", "name", "brand", F.col("price").cast("double").alias("price"))


def _card_payload() -> Column:
    options = F.array(F.struct(F.lit("Тип").alias("name"), F.col("p_type").alias("value")), F.struct(F.lit("Размер").alias("name"), F.col("p_size").cast("string").alias("value")))
    return _json(nm_id=F.col("p_partkey"), imt_id=F.col("p_partkey") + 7, imt_name=F.col("p_name"), selling=F.struct(F.col("p_brand").alias("brand_name")), options=options, discountPriceU=_cents())


@query("SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_partkey + 7 AS imt_id, p_name AS name, p_brand AS brand, p_type AS type, CAST(p_size AS VARCHAR) AS size, p_brand AS of_brand, CASE WHEN p_partkey % 3 = 0 THEN 's' END AS seller, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS price, 'https://www.wildberries.ru/catalog/' || p_partkey || '/detail.aspx' AS url, CAST(5 AS INT) AS images FROM part WHERE p_retailprice > 0")
def catalogue_page_offers(spark, sf):
    p = _parts(spark, sf)
    stubs, cards = captures.catalogue_stubs(p.select(_stub_payload().alias("payload"))), captures.cards(p.select(_card_payload().alias("payload")))
    found, c = captures.catalogue_offers(captures.with_cards(stubs, cards)), F.col("characteristics")
    return found.select("item_id", "imt_id", "name", "brand", c["Тип"].alias("type"), c["Размер"].alias("size"), c["Бренд"].alias("of_brand"), c["Поставщик"].alias("seller"), F.col("price").cast("double").alias("price"), "url", F.size("images").alias("images"))


@query("SELECT p_partkey AS nm_id, p_brand AS brand, 2 AS options, CAST(floor(CAST(p_retailprice AS DECIMAL(12,2))) AS BIGINT) AS price_rub, false AS has_video FROM part")
def card_details(spark, sf):
    found = captures.cards(_parts(spark, sf).select(_card_payload().alias("payload")))
    return found.select("nm_id", "brand", F.size("characteristics").alias("options"), F.col("price_rub").cast("long").alias("price_rub"), "has_video")


def _widget_payload() -> Column:
    key = F.col("p_partkey")
    price = F.concat(F.replace(F.format_number(F.floor("p_retailprice"), 0), F.lit(","), F.lit(" ")), F.lit(" ₽"))
    item = F.struct(key.cast("string").alias("sku"), F.col("p_name").alias("title"), price.alias("finalPrice"), F.concat(F.lit("/product/"), key.cast("string")).alias("link"), F.lit("4,5").alias("rating"), F.col("p_size").cast("string").alias("reviews"), F.col("p_brand").alias("seller"))
    state = F.to_json(F.struct(F.array(item, item).alias("items")))
    return F.to_json(F.struct(F.create_map(F.lit("tileGridDesktop-1"), state, F.lit("footer-1"), state, F.lit("skuList-2"), F.lit("{broken")).alias("widgetStates")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS name, CAST(floor(p_retailprice) AS DOUBLE) AS price, 'https://www.ozon.ru/product/' || p_partkey AS url, CAST(4.5 AS DOUBLE) AS rating, CAST(p_size AS INT) AS reviews_count, p_brand AS of_seller FROM part WHERE floor(p_retailprice) > 0")
def widget_page_offers(spark, sf):
    found = captures.widget_offers(captures.widget_stubs(_parts(spark, sf).select(_widget_payload().alias("payload"))))
    return found.select("item_id", "name", F.col("price").cast("double").alias("price"), "url", "rating", "reviews_count", F.col("characteristics")["Продавец"].alias("of_seller"))


def _product_page(extra: str = "") -> Column:
    """A page whose JSON-LD is a graph with a product, after a broken block; the product's shape goes by the key."""
    key = F.col("p_partkey")
    price, product = (_cents() / 100).cast("decimal(12,2)").cast("string"), F.lit('"@type": "Product", "name": "')
    plain = F.concat(product, F.col("p_name"), F.lit('", "image": ["//img.example/'), key.cast("string"), F.lit('"], "brand": {"name": "'), F.col("p_brand"), F.lit('"}, "offers": {"price": "'), price, F.lit('", "availability": "https://schema.org/InStock"}, "color": "'), F.col("p_type"), F.lit(f'"{extra}'))
    listed = F.concat(product, F.col("p_name"), F.lit('", "image": {"contentUrl": "https://img.example/'), key.cast("string"), F.lit('"}, "brand": "'), F.col("p_brand"), F.lit('", "offers": [{"lowPrice": '), price, F.lit(', "availability": "InStock"}], "color": "'), F.col("p_type"), F.lit(f'"{extra}'))
    graph = F.concat(F.lit('{"@graph": [{"@type": "WebSite"}, {'), plain, F.lit("}]}"))
    items = F.concat(F.lit('{"@type": "ItemList", "itemListElement": [{"item": {'), listed, F.lit("}}]}"))
    return F.concat(F.lit('<html><script type="application/ld+json">{broken</script><script type="application/ld+json">'), F.when(key % 2 == 0, graph).otherwise(items), F.lit("</script></html>"))


def _page_url() -> Column:
    return F.concat(F.lit("https://shop"), (F.col("p_partkey") % 9).cast("string"), F.lit(".example/"), F.col("p_partkey").cast("string"))


PAGE_SQL = "SELECT 'https://shop' || (p_partkey % 9) || '.example/' || p_partkey AS url, p_name AS name, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS price, 'https://img.example/' || p_partkey AS image, p_brand AS brand, 'shop' || (p_partkey % 9) || '.example' AS seller, p_type AS color, 'InStock' AS available FROM part WHERE CAST(p_retailprice AS DECIMAL(12,2)) >= 100"


@query(PAGE_SQL)
def product_pages(spark, sf):
    found = captures.page_offers(_parts(spark, sf).select(_page_url().alias("url"), _product_page().alias("html")))
    c = F.col("characteristics")
    return found.select("url", "name", F.col("price").cast("double").alias("price"), "image", "brand", "seller", c["Цвет"].alias("color"), c["Наличие"].alias("available"))


@query("SELECT p_name AS name, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS price, 'RUB' AS currency, 'https://m.example/1' AS url, 'https://img.example/' || p_partkey AS image, CAST(4.5 AS DOUBLE) AS rating, '7' AS rating_count FROM part WHERE p_retailprice > 0")
def market_pages(spark, sf):
    extra = ', "url": "https://m.example/1", "aggregateRating": {"ratingValue": 4.5, "ratingCount": 7}'
    found = captures.market_offers(_parts(spark, sf).select(_page_url().alias("url"), _product_page(extra).alias("html")))
    return found.select("name", F.col("price").cast("double").alias("price"), "currency", "url", "image", "rating", F.col("characteristics")["rating_count"].alias("rating_count"))


@query("SELECT 'https://shop' || (p_partkey % 9) || '.example/' || p_partkey AS url, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS price, CASE WHEN p_partkey % 5 <> 0 THEN CAST(4.2 AS DOUBLE) END AS rating, CAST(CASE WHEN p_partkey % 5 <> 0 THEN 12 END AS DOUBLE) AS reviews_count, p_partkey % 5 = 0 AS cart FROM part WHERE CAST(p_retailprice AS DECIMAL(12,2)) >= 100 AND p_partkey % 5 <> 1")
def organic_offers(spark, sf):
    p = _parts(spark, sf).select(_page_url().alias("url"), _product_page().alias("html"), F.when(F.col("p_partkey") % 5 == 0, "В корзину").when(F.col("p_partkey") % 5 == 1, "Обзор").otherwise("Товар 4,2 (12)").alias("text"))
    found = captures.organic_offers(captures.organic_results(p), p.select("url", "html"))
    return found.select("url", F.col("price").cast("double").alias("price"), "rating", F.col("reviews_count").cast("double").alias("reviews_count"), F.col("rating").isNull().alias("cart"))


@query("SELECT p_partkey AS nm_id, 'b' AS newest, 3 AS total, CAST(4.7 AS DOUBLE) AS rating, 1 AS photos FROM part")
def review_pages(spark, sf):
    one = lambda name, day, ready: F.struct(F.lit(name).alias("id"), F.col("p_partkey").alias("nmId"), F.lit(f"2024-0{day}-01").alias("createdDate"), F.array(F.struct(F.lit(f"k{name}").alias("key"), F.lit(ready).alias("isReady"))).alias("photos"))
    nameless = F.struct(F.lit("c").alias("id"), F.lit(None).cast("bigint").alias("nmId"), F.lit("2024-09-01").alias("createdDate"), F.array().cast("array<struct<key: string, isReady: boolean>>").alias("photos"))
    page = _json(feedbackCount=F.lit(3), valuation=F.lit("4.7"), feedbacks=F.array(one("a", 1, True), one("b", 2, True), nameless, one("d", 1, False)))
    rows = _parts(spark, sf).select(F.col("p_partkey").alias("imt_id"), page.alias("payload"))
    first = captures.feedbacks(rows, "payload", "imt_id").where("place = 1").select("imt_id", "nm_id", F.col("id").alias("newest"), F.size("photo_keys").alias("photos"))
    bare = first.withColumn("rating", F.lit(None).cast("double")).withColumn("reviews_count", F.lit(None).cast("int"))
    found = reviews.with_pages(bare, captures.feedback_pages(rows, "payload", "imt_id").select("imt_id", "valuation", "total"))
    return found.select("nm_id", "newest", F.col("reviews_count").alias("total"), "rating", "photos")


@query("""SELECT p_partkey, p_name || ' ' || p_brand AS image_query, CAST(CASE WHEN p_size % 7 = 0 THEN 50 ELSE least(100, p_size * 3) END AS INT) AS aspect_score,
  CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE lower(p_name) END AS spelled, 'positive' AS sentiment, p_type AS aspect, CAST(p_size AS INT) AS mentions FROM part""")
def llm_answers(spark, sf):
    k, name = F.col("p_partkey"), F.col("p_name")
    answer = F.concat(F.when(k % 2 == 0, "На фото ").otherwise("Запрос: "), F.lit("«"), name, F.lit(" "), F.col("p_brand"), F.lit("».\nПояснение"))
    score = F.when(F.col("p_size") % 7 == 0, "нет").otherwise((F.col("p_size") * 3).cast("string"))
    raw = F.when(k % 2 == 0, F.upper("p_name")).otherwise(F.lower("p_name"))
    fixed = F.concat(F.upper("p_name"), F.lit("!."))
    items = F.array(F.struct(F.concat(F.lit(" "), F.col("p_type")).alias("label"), F.col("p_size").cast("string").alias("mentions")), F.struct(F.lit("").alias("label"), F.lit("1").alias("mentions")))
    kept = text.aspects(items)
    return _parts(spark, sf).select("p_partkey", text.image_query(answer).alias("image_query"), text.aspect_score(score).alias("aspect_score"), text.spelling_applied(raw, fixed).alias("spelled"), text.sentiment_label(F.lit("LABEL_POS")).alias("sentiment"), kept[0]["label"].alias("aspect"), kept[0]["mentions"].alias("mentions"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'user-' || p_partkey WHEN length(p_name) BETWEEN 8 AND 128 THEN 'anon-' || p_name END AS owner_key,
  CASE WHEN p_partkey % 2 = 0 THEN 'https://h/' || p_partkey END AS image, CASE WHEN p_partkey % 4 < 2 THEN p_name ELSE p_name || ' купить в ' || CASE p_partkey % 4 WHEN 2 THEN 'Санкт-Петербурге' ELSE 'Екатеринбурге' END END AS geo_query,
  'https://' || 'shop.example.ru' || '/search/?q=' || p_partkey AS shop, p_size % 2 = 0 AS plausible, CASE WHEN p_size < 20 THEN '↓' WHEN p_size > 20 THEN '↑' ELSE '=' END || ' ' || abs(p_size - 20) || '.0%' AS delta FROM part""")
def small_links(spark, sf):
    k = F.col("p_partkey")
    region = F.element_at(F.array(F.lit(0), F.lit(1_000_000), F.lit(2), F.lit(54)), (k % 4 + 1).cast("int"))
    return _parts(spark, sf).select(
        "p_partkey", urls.owner_key(F.when(k % 3 == 0, k.cast("string")), F.col("p_name")).alias("owner_key"), urls.absolute_image(F.when(k % 2 == 0, F.concat(F.lit(" //h/"), k.cast("string"))).otherwise("data:x")).alias("image"),
        urls.geo_query(F.col("p_name"), region).alias("geo_query"), urls.seller_link(F.lit("shop.example.ru"), k.cast("string")).alias("shop"),
        pricing.plausible(F.when(F.col("p_size") % 2 == 0, 10.0).otherwise(9e6)).alias("plausible"), pricing.delta_arrow((F.col("p_size") - 20).cast("double")).alias("delta"),
    )


OFFERS = bridge.OFFERS_SQL


@query(f"WITH {OFFERS} SELECT query_id, source, name, CAST(price AS VARCHAR) AS price, 'RUB' AS currency, url, rating, seller FROM offers")
def offer_summaries(spark, sf):
    return offers.summary(bridge.offers(spark, sf))


@query(f"WITH {OFFERS} SELECT query_id, source, count(*) - 1 AS followers FROM offers GROUP BY 1, 2")
def single_flights(spark, sf):
    calls = bridge.offers(spark, sf).withColumn("call_id", F.col("l_orderkey"))
    return buckets.single_flight(calls, "query_id", "source").select("query_id", "source", "followers")


def _detail_payload() -> Column:
    """A product page's widgets: named values in two shapes, controls, reviews and what a stub lacks."""
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    features = F.concat(
        F.lit('{"groups": [{"short": [{"name": "Тип", "values": [{"text": "'), F.col("p_type"), F.lit('"}, {"text": "x"}]}, {"title": {"textRs": [{"content": "Раз"}, {"content": "мер"}]}, "values": [{"text": "'),
        F.col("p_size").cast("string"), F.lit('"}]}, {"name": "Купить", "values": [{"text": "да"}]}, {"name": "Цена", "values": [{"text": "Перейти"}]}]}]}'),
    )
    comment = F.concat(F.lit("A review that is long enough of "), name)
    said = F.concat(F.lit('{"reviews": [{"author": {"name": "Ann"}, "content": {"comment": {"text": "'), comment, F.lit('"}, "score": 4, "photos": ["https://p/1", "https://p/1", {"url": "https://p/2"}]}}, {"text": "short"}, {"authorName": "Ann", "text": "'), comment, F.lit('"}, {"userName": "Bob", "rating": "5", "text": "'), comment, F.lit(' again", "date": "2024-01-02"}]}'))
    states = F.create_map(
        F.lit("webFeatures-1"), features, F.lit("webListReviews-2"), said, F.lit("webProductHeading-3"), F.concat(F.lit('{"title": {"textRs": [{"content": "'), name, F.lit('"}]}}')),
        F.lit("webProductMainWidget-4"), F.concat(F.lit('{"sku": '), key, F.lit("}")), F.lit("webPrice-5"), F.concat(F.lit('{"cardPrice": {"text": "'), F.floor("p_retailprice").cast("string"), F.lit(' ₽"}}')),
        F.lit("webGallery-6"), F.lit('{"images": ["https://g/1", {"src": "https://g/2", "type": "image"}, {"src": "https://g/3", "type": "video"}]}'), F.lit("webReviewProductScore-7"), F.lit('{"score": 4.5, "reviewsCount": 12}'), F.lit("broken-8"), F.lit("{"),
    )
    return F.to_json(F.struct(states.alias("widgetStates")))


def _details(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", _detail_payload().alias("payload"))


@query("SELECT p_partkey, 'Тип' AS name, p_type || ', x' AS value FROM part UNION ALL SELECT p_partkey, 'Раз мер', CAST(p_size AS VARCHAR) FROM part")
def widget_characteristics(spark, sf):
    states = widgets.widget_states(_details(spark, sf), "payload", "p_partkey").where("widget = 'webFeatures-1'")
    return widgets.name_values(states, "p_partkey").select("p_partkey", "name", "value")


@query("""SELECT p_partkey, 1 AS place, 'Ann' AS author, 4 AS score, 'A review that is long enough of ' || p_name AS text, NULL AS published_at, 'https://p/1 https://p/2' AS photos FROM part
UNION ALL SELECT p_partkey, 2, NULL, 4, 'A review that is long enough of ' || p_name, NULL, 'https://p/1 https://p/2' FROM part
UNION ALL SELECT p_partkey, 3, 'Bob', 5, 'A review that is long enough of ' || p_name || ' again', '2024-01-02', '' FROM part""")
def widget_reviews(spark, sf):
    found = widgets.widget_reviews(widgets.widget_states(_details(spark, sf), "payload", "p_partkey"), "p_partkey")
    return found.select("p_partkey", "place", "author", "score", "text", "published_at", F.array_join("photos", " ").alias("photos"))


def _unsorted_payload() -> Column:
    """A page whose keys are not in alphabetical order, with values ten levels deep, more reviews than are kept and two review widgets."""
    name = F.col("p_name")

    def review(author: str) -> list[Column]:
        return [F.lit(f'{{"author": "{author}", "text": "A long review by {author} of '), name, F.lit('"}')]

    def deep(inner: list[Column], levels: int = 10) -> list[Column]:
        return [F.lit("".join(f'{{"k{9 - n % 10}": ' for n in range(levels))), *inner, F.lit("}" * levels)]

    first = [F.lit('{"z": '), *deep(review("Zoe")), F.lit(', "b": ['), *review("Ann"), F.lit(", "), *review("Bob"), F.lit('], "m": {"k": '), *review("Cid"), F.lit(', "a": '), *review("Dan"), F.lit('}, "c": '), *review("Eve"), F.lit(', "a": '), *review("Fay"), F.lit("}")]
    value = [F.lit('{"name": "Цвет", "values": [{"text": "'), F.col("p_type"), F.lit('"}]}')]
    features = [F.lit('{"y": '), *deep(value, 12), F.lit(', "x": {"name": "Цвет", "values": [{"text": "other"}]}, "a": {"title": "Вес", "values": [{"text": "1 кг"}]}}')]
    states = F.create_map(
        F.lit("webListReviews-9"), F.concat(*first), F.lit("webListReviews-1"), F.concat(*review("Gus")), F.lit("webFeatures-5"), F.concat(*features), F.lit("webFeatures-2"), F.lit('{"name": "Вес", "values": [{"text": "2 кг"}]}'),
        F.lit("webProductHeading-8"), F.lit('{"title": "first"}'), F.lit("webProductHeading-3"), F.lit('{"title": "second"}'), F.lit("webGallery-6"), F.lit('{"images": ["https://g/2", "https://g/1"]}'), F.lit("webGallery-4"), F.lit('{"coverImage": ["https://g/1", "https://g/0"]}'),
    )
    return F.to_json(F.struct(states.alias("widgetStates")))


UNSORTED_REVIEWS = "(VALUES (1, 'Zoe'), (2, 'Ann'), (3, 'Bob'), (4, 'Cid'), (5, 'Dan')) AS r(place, author)"


@query(f"SELECT p_partkey, place, author, 'A long review by ' || author || ' of ' || p_name AS text FROM part, {UNSORTED_REVIEWS}")
def widget_reviews_in_order(spark, sf):
    rows = _parts(spark, sf).select("p_partkey", _unsorted_payload().alias("payload"))
    return widgets.widget_reviews(widgets.widget_states(rows, "payload", "p_partkey"), "p_partkey").select("p_partkey", "place", "author", "text")


@query("""SELECT p_partkey, 'first' AS name, p_type AS colour, '1 кг' AS weight, 'https://g/2 https://g/1 https://g/0' AS images, 'Zoe Ann Bob Cid Dan Eve Fay Gus' AS authors FROM part""")
def widget_pages(spark, sf):
    rows = _parts(spark, sf).select("p_partkey", _unsorted_payload().alias("payload"))
    found, c = widgets.pages(widgets.widget_states(rows, "payload", "p_partkey"), "p_partkey", reviews=50), F.col("characteristics")
    return found.select("p_partkey", "name", c["Цвет"].alias("colour"), c["Вес"].alias("weight"), F.array_join("images", " ").alias("images"), F.array_join(F.transform("reviews", lambda r: r["author"]), " ").alias("authors"))


@query("""SELECT 'https://shop' || (p_partkey % 9) || '.example/' || p_partkey AS url,
  CASE p_partkey % 6 WHEN 0 THEN 'https://i/u' WHEN 1 THEN 'https://i/thumb' WHEN 2 THEN 'https://i/c' WHEN 3 THEN 'https://i/t' WHEN 4 THEN 'https://i/offer' END || CAST(p_partkey AS VARCHAR) AS image
FROM part WHERE CAST(p_retailprice AS DECIMAL(12,2)) >= 100""")
def nested_pictures(spark, sf):
    k = F.col("p_partkey").cast("string")
    shapes = [
        F.concat(F.lit('"image": {"image": [{"contentUrl": {"image": [[{"url": "//i/u'), k, F.lit('"}]]}}]}')), F.concat(F.lit('"image": [{}, "data:x", {"thumbnailUrl": "https://i/thumb'), k, F.lit('"}]')),
        F.concat(F.lit('"image": {"image": "https://i/x", "contentUrl": "//i/c'), k, F.lit('"}')), F.concat(F.lit('"image": [], "thumbnailUrl": {"url": {"url": {"url": "https://i/t'), k, F.lit('"}}}')),
        F.concat(F.lit('"color": "x"')), F.lit('"image": {"width": 5}'),
    ]
    shape = F.coalesce(*[F.when(F.col("p_partkey") % 6 == n, s) for n, s in enumerate(shapes)])
    offer = F.concat(F.lit('"offers": [{"price": '), (_cents() / 100).cast("decimal(12,2)").cast("string"), F.lit(', "image": ["https://i/offer'), F.when(F.col("p_partkey") % 6 == 4, k).otherwise(""), F.lit('"]}]'))
    wraps = 9
    node = F.concat(F.lit('{"@graph": [' * wraps + '{"@type": "Product", "name": "n", '), shape, F.lit(", "), offer, F.lit("}" + "]}" * wraps))
    html = F.concat(F.lit('<script type="application/ld+json">'), node, F.lit("</script>"))
    return captures.page_offers(_parts(spark, sf).select(_page_url().alias("url"), html.alias("html"))).select("url", "image")


@query("""SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS item_id, CASE WHEN p_partkey % 2 = 0 THEN 'own' ELSE p_name END AS name, floor(p_retailprice) AS price, CAST(4.5 AS DOUBLE) AS rating,
  CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 12 END AS reviews_count, 2 AS images, p_type || ', x' AS type, 3 AS reviews FROM part""")
def backfilled_stubs(spark, sf):
    k = F.col("p_partkey")
    none = lambda kind: F.lit(None).cast(kind)
    stubs = _parts(spark, sf).select("p_partkey", F.lit("").alias("item_id"), F.when(k % 2 == 0, "own").alias("name"), none("decimal(12,2)").alias("price"), none("double").alias("rating"), F.when(k % 3 == 0, 3).alias("reviews_count"))
    found = widgets.backfilled(stubs, _details(spark, sf), key="p_partkey")
    return found.select("p_partkey", "item_id", "name", F.col("price").cast("double").alias("price"), "rating", "reviews_count", F.size("images").alias("images"), F.col("characteristics")["Тип"].alias("type"), F.size("reviews").alias("reviews"))


def _captured_offers(spark: SparkSession, sf: str) -> DataFrame:
    """Offers that adapters read from a folder of captured payloads of two sources, later than the first day."""
    k = F.col("p_partkey")
    day = F.timestamp_seconds(F.lit(1_700_000_000) + F.when(k % 3 == 0, 0).otherwise(86_400))
    widget = F.to_json(F.struct(F.create_map(F.lit("tileGridDesktop-1"), F.concat(F.lit('{"items": [{"sku": "'), k.cast("string"), F.lit('", "title": "'), F.col("p_name"), F.lit('", "price": "'), F.floor("p_retailprice").cast("string"), F.lit(' ₽", "link": "/p/1", "seller": "'), F.col("p_brand"), F.lit('"}]}'))).alias("widgetStates")))
    page = _product_page(', "url": "https://m.example/1"')
    parts = _parts(spark, sf)
    rows = [parts.select(_page_url().alias("url"), day.alias("captured_at"), payload.alias("payload"), F.lit(kind).alias("kind"), F.lit(source).alias("source")) for payload, kind, source in ((widget, "widgets", "ozon"), (page, "market_pages", "ya_market"), (F.lit("other"), "notes", "ozon"))]
    path = f"{shared_dir(spark)}/captures-{uuid.uuid4().hex}"
    for r in rows:
        adapters.keep(r, path)
    return adapters.offers(spark, path, ["ozon", "ya_market"], since=datetime(2023, 11, 14, 22, 13, 21))


@query("""SELECT 'ozon' AS source, CAST(p_partkey AS VARCHAR) AS item_id, p_name AS name, floor(p_retailprice) AS price, 'https://www.ozon.ru/p/1' AS url, p_brand AS seller FROM part WHERE p_partkey % 3 <> 0 AND floor(p_retailprice) > 0
UNION ALL SELECT 'ya_market', NULL, p_name, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE), 'https://m.example/1', NULL FROM part WHERE p_partkey % 3 <> 0 AND p_retailprice > 0""")
def captured_offers(spark, sf):
    return _captured_offers(spark, sf).select("source", "item_id", "name", F.col("price").cast("double").alias("price"), "url", "seller")


@query("""WITH o AS (SELECT o_custkey AS id, o_orderkey AS n, CAST(o_totalprice AS DOUBLE) AS price, o_orderstatus AS s, o_orderkey % 3 AS part FROM orders),
  last AS (SELECT id, n, price FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY part DESC, n DESC) = 1),
  again AS (SELECT id, n, price FROM o WHERE s = 'F' AND id % 14 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1)
SELECT * FROM last WHERE id % 7 <> 0 UNION ALL SELECT * FROM again""")
def keyed_rows(spark, sf):
    """A keyed table after three upserts, a compaction, a deletion and one more upsert."""
    o = bridge.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("n"), F.col("o_totalprice").cast("double").alias("price"), "o_orderstatus")
    latest = lambda rows: rows.groupBy("id").agg(F.max(F.struct("n", "price")).alias("r")).select("id", "r.n", "r.price")
    table = KeyedTable(spark, f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}", "id long, n long, price double", ("id",))
    for part in range(3):
        table.upsert(latest(o.where(F.col("n") % 3 == part)))
    table.compact()
    table.delete(o.select("id").where("id % 7 = 0"))
    table.upsert(latest(o.where("o_orderstatus = 'F' AND id % 14 = 0")))
    return table.read()


# Words beside those of the lemmatiser's vocabulary, or forms of its words, and their dictionary forms.
DECLINED = (
    ("наушниками", "наушники"), ("гарнитурой", "гарнитура"), ("Смартфонам", "смартфон"), ("ноутбуков", "ноутбук"), ("телевизорах", "телевизор"), ("компьютером", "компьютер"), ("колонок", "колонка"), ("мышей", "мышь"), ("кроссовками", "кроссовки"),
    ("кедах", "кеды"), ("видеокартами", "видеокарта"), ("планшетов", "планшет"), ("кофемолке", "кофемолка"), ("подъёмниками", "подъёмник"), ("перчатками", "перчатка"), ("выключателей", "выключатель"), ("сканерами", "сканер"), ("тарелками", "тарелка"),
    ("напильников", "напильник"), ("микросхемами", "микросхема"), ("колыбелями", "колыбель"), ("iPhone", "iphone"), ("тв", "тв"), ("x5", "x5"),
)


@query(f"SELECT p_partkey, w.word, w.lemma FROM part JOIN (VALUES {', '.join(f'({n}, {w!r}, {v!r})' for n, (w, v) in enumerate(DECLINED))}) AS w(n, word, lemma) ON p_partkey % {len(DECLINED)} = n")
def lemmatised_words(spark, sf):
    word = F.element_at(F.array(*[F.lit(w) for w, _ in DECLINED]), (F.col("p_partkey") % len(DECLINED) + 1).cast("int"))
    return _parts(spark, sf).select("p_partkey", word.alias("word")).withColumn("lemma", lemmas.lemma(F.col("word")))


@query("""SELECT p_partkey AS nm_id, CAST(CASE p_partkey % 4 WHEN 0 THEN 100 + p_size WHEN 1 THEN 200 + p_size WHEN 2 THEN 300 + p_size END AS DOUBLE) AS price_rub FROM part""")
def card_prices_of_sizes(spark, sf):
    """Cards whose price stands in their extension, in a size of a colour after what is no object, or nowhere."""
    k, cents = F.col("p_partkey").cast("string"), (F.col("p_size") * 100 + 99)
    money = lambda base: (F.lit(base * 100) + cents).cast("string")
    shapes = [
        F.concat(F.lit('"clientPriceU": 77700, "extended": {"clientPriceU": 0, "discountPriceU": '), money(100), F.lit("}")),
        F.concat(F.lit('"colors": [7, {"sizes": ["x", {"price": 5}, {"price": {"product": 0, "basic": '), money(200), F.lit(', "total": 1}}]}, {"sizes": [{"price": {"product": 100}}]}]')),
        F.concat(F.lit('"colors": [{"sizes": [{"price": {"product": 500000000}}, {"price": {"total": '), money(300), F.lit("}}]}]")),
        F.lit('"colors": ["red", 3]'),
    ]
    shape = F.coalesce(*[F.when(F.col("p_partkey") % 4 == n, s) for n, s in enumerate(shapes)])
    found = captures.cards(_parts(spark, sf).select(F.concat(F.lit('{"nm_id": '), k, F.lit(", "), shape, F.lit("}")).alias("payload")))
    return found.select("nm_id", F.col("price_rub").cast("double").alias("price_rub"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'http://i/' || p_partkey WHEN 1 THEN 'data:image/png;x' END AS image,
  CASE WHEN v >= 1000 THEN CAST(v // 1000 AS VARCHAR) || chr(160) || printf('%03d', v % 1000) ELSE CAST(v AS VARCHAR) END || CASE p_partkey % 2 WHEN 0 THEN ' ₽' ELSE ' USD' END AS shown,
  p_partkey % 3 = 0 AS allowed FROM (SELECT *, CAST(floor(CAST(p_retailprice AS DECIMAL(12,2)) + 0.5) AS BIGINT) AS v FROM part) WHERE floor(p_retailprice) >= 100 AND v < 1000000""")
def shown_cards(spark, sf):
    """Pictures, shown prices and hosts of shopping cards."""
    p, k = _parts(spark, sf).where("p_retailprice < 999999"), F.col("p_partkey")
    image = F.when(k % 4 == 0, F.concat(F.lit("http://i/"), k.cast("string"))).when(k % 4 == 1, "data:image/png;x").when(k % 4 == 2, "blob:y")
    text = F.concat(F.replace(F.format_number(F.floor("p_retailprice"), 0), F.lit(","), F.lit(" ")), F.lit(" ₽"))
    cards = p.select("p_partkey", F.concat(F.lit("Card "), k.cast("string")).alias("title"), text.alias("text"), F.lit("dns").alias("seller"), k.cast("string").alias("query"), image.alias("image"))
    found = captures.shopping_offers(cards).select(F.col("query").cast("long").alias("p_partkey"), "image")
    host = F.when(k % 3 == 0, "Basket-1.WBbasket.ru").when(k % 3 == 1, "notwb.ru").otherwise("ozon.ru.evil.example")
    said = p.select("p_partkey", pricing.shown_price(F.col("p_retailprice").cast("decimal(12,2)"), F.when(k % 2 == 0, "RUB").otherwise("USD")).alias("shown"), urls.allowed_host(host).alias("allowed"))
    return found.join(said, "p_partkey")


POS = bridge.POS


@query(f"""WITH {OFFERS}, c AS (SELECT *, 0 AS priority FROM offers WHERE source = 'wb' UNION ALL SELECT *, 1 FROM offers WHERE source = 'runet' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {POS}) <= 60
), d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id, lower(trim(seller)), substr(lower(trim(name)), 1, 50) ORDER BY priority, {POS}) = 1
) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY priority, {POS}) AS place, l_orderkey, l_linenumber FROM d QUALIFY place <= 20""")
def runet_scan(spark, sf):
    o = bridge.offers(spark, sf)
    return captures.runet_scan(o.where("source = 'wb'"), o.where("source = 'runet'"), 20).select("query_id", "place", "l_orderkey", "l_linenumber")


@query("""WITH a AS (SELECT o_orderkey AS id, o_custkey AS watch_id, o_orderdate AS created_at, o_orderstatus = 'F' AS was_read FROM orders)
SELECT c_custkey AS id, count(a.id) AS alerts, count(a.id) FILTER (NOT was_read) AS unread, max(a.created_at) AS last_alert_at FROM customer LEFT JOIN a ON watch_id = c_custkey GROUP BY 1""")
def watches_with_alerts(spark, sf):
    return watches.with_alerts(bridge.watches(spark, sf), _alerts(spark, sf)).select("id", "alerts", "unread", "last_alert_at")


def _alerts(spark: SparkSession, sf: str) -> DataFrame:
    read = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    return bridge.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("watch_id"), F.col("o_orderdate").alias("created_at"), read.alias("read_at"))


@query("SELECT 'watches' AS kind, count(*) AS n FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'alerts', count(*) FROM orders WHERE o_custkey % 3 <> 0")
def deleted_watches(spark, sf):
    own = bridge.watches(spark, sf)
    left = watches.delete_watches(own, _alerts(spark, sf), own.where("id % 3 = 0"))
    return left[0].agg(F.lit("watches").alias("kind"), F.count("*").alias("n")).unionByName(left[1].agg(F.lit("alerts").alias("kind"), F.count("*").alias("n")))


@query("SELECT c_custkey AS user_id, count(o_orderkey) AS favorites, max(o_orderdate) AS newest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def user_favorites(spark, sf):
    users = bridge.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    own = bridge.table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.lit("wb").alias("source"), F.col("o_orderkey").cast("string").alias("item_id"), F.lit("n").alias("name"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("created_at"))
    found = watches.favorites_of(users, own)
    return found.select("user_id", F.size("favorites").cast("long").alias("favorites"), F.get("favorites", F.lit(0))["created_at"].alias("newest"))


@query("""SELECT p_partkey, 'https://feedback-' || lpad(CAST(p_partkey % 12 AS VARCHAR), 2, '0') || '.wbbasket.ru/' || p_name || '/fs.jpg' AS photo, 'https://videofeedback' || lpad(CAST(p_partkey % 12 AS VARCHAR), 2, '0') || '.wbbasket.ru/' || p_name || '/index.m3u8' AS video,
  CASE WHEN m < 1 THEN 'только что' WHEN m < 60 THEN m || ' мин назад' WHEN m // 60 < 24 THEN (m // 60) || ' ч назад' ELSE (m // 1440) || ' дн назад' END AS ago FROM (SELECT *, p_partkey * p_size % 5000 AS m FROM part)""")
def media_links(spark, sf):
    key = F.concat((F.col("p_partkey") % 12).cast("string"), F.lit("/"), F.col("p_name"))
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    ts = F.timestamp_add("MINUTE", -(F.col("p_partkey") * F.col("p_size") % 5000).cast("int"), now)
    return _parts(spark, sf).select("p_partkey", urls.feedback_photo(key)["jpg"].alias("photo"), urls.feedback_video(key)["hls"].alias("video"), pricing.time_ago(ts, now).alias("ago"))


@query(f"WITH {bridge.REVIEWS_SQL}, l AS (SELECT item_id, author, pos FROM reviews WHERE length(trim(text)) >= 20) SELECT item_id, author, count(*) AS texts, min(pos) AS first FROM l GROUP BY 1, 2 HAVING count(*) >= 3")
def texts_for_aspects(spark, sf):
    found = reviews.enough_for_aspects(bridge.reviews(spark, sf), "item_id", "author")
    return found.groupBy("item_id", "author").agg(F.count("*").alias("texts"), F.min("pos").alias("first"))


CRC = "list_reduce(range(0, 64), lambda c, i: xor(c >> 1, (xor(c, p_partkey >> i) & 1) * 40961), CAST(0 AS BIGINT))"
ORACLES["feedback_shards"] = f"SELECT p_partkey, crc, CASE WHEN crc % 100 >= 50 THEN 2 ELSE 1 END AS shard FROM (SELECT p_partkey, {CRC} AS crc FROM part)"
# Capacity 1, one token a minute; the first call of a key finds a full bucket.
ORACLES["rate_limited"] = """WITH RECURSIVE calls AS (
  SELECT event_type AS key, event_id AS call_id, epoch_us(ts) / CAST(1000000 AS DOUBLE) / 1440 AS ts FROM events
), placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, call_id) AS n FROM calls
), run AS (
  SELECT key, n, call_id, ts, CAST(0 AS DOUBLE) AS tokens, CAST(0 AS BIGINT) AS wait_ms FROM placed WHERE n = 1
  UNION ALL
  SELECT key, n, call_id, ts, CASE WHEN have >= 1 THEN have - 1 ELSE have END, CASE WHEN have >= 1 THEN 0 ELSE CAST(ceil((1 - have) / (CAST(1 AS DOUBLE) / 60) * 1000) AS BIGINT) END
  FROM (SELECT p.*, least(CAST(1 AS DOUBLE), r.tokens + greatest(CAST(0 AS DOUBLE), p.ts - r.ts) * (CAST(1 AS DOUBLE) / 60)) AS have FROM run r JOIN placed p ON p.key = r.key AND p.n = r.n + 1)
) SELECT key, call_id, ts, tokens, wait_ms FROM run"""
# The stream gives an hour once its watermark, two hours behind the latest event, has passed the hour's end.
ORACLES["hourly_prices_stream"] = "SELECT source, window_start, points, mean_price FROM (SELECT event_type AS source, date_trunc('hour', ts) AS window_start, count(*) AS points, round(avg(value), 4) AS mean_price FROM events GROUP BY 1, 2) WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR"
