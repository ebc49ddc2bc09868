"""Operators over offers on small tables, with the branches the large tables do not reach."""

import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bazaarium import api
from bazaarium.functions import numbers, urls
from bazaarium.operators import facets, history, nmck, offers, reviews, watches

COLUMNS = "query_id string, source string, item_id string, name string, price decimal(12,2), url string, seller string, rating double, reviews_count int, characteristics map<string,string>, pos long, currency string, relevance double"


def table(spark, *rows):
    names = [c.split()[0] for c in COLUMNS.replace("map<string,string>", "map").split(", ")]
    full = []
    for i, row in enumerate(rows):
        r = {"query_id": "q", "source": "wb", "item_id": str(i), "name": "n", "price": 100, "url": f"https://example.com/{i}", "seller": None, "rating": None, "reviews_count": None, "characteristics": {}, "pos": i, "currency": "RUB", "relevance": None} | row
        r["price"] = None if r["price"] is None else Decimal(str(r["price"]))
        full.append(tuple(r[n] for n in names))
    return spark.createDataFrame(full, COLUMNS)


def test_groups_keep_failed_sources(spark):
    o = table(spark, {"price": 100}, {"source": "ya_market", "price": 200}, {"source": "ya_market", "price": 300}, {"source": "runet", "price": 250})
    status = spark.createDataFrame([("q", s, e, False) for s, e in (("wb", None), ("ozon", "boom"), ("ya_market", None), ("runet", None))], "query_id string, source string, error string, cached boolean")
    got = {r.source: r for r in offers.group_stats(o, status).collect()}
    assert {k: r.offers for k, r in got.items()} == {"wb": 1, "ozon": 0, "ya_market": 2, "runet": 1}
    assert got["ozon"].error == "boom" and got["ozon"].min_price is None
    assert got["ya_market"].median_price == 250.0


def test_best_deal_scores(spark):
    o = table(spark, {"price": 100000, "name": "luxury"}, {"price": 9000, "name": "budget"}, {"price": 50000, "source": "ozon", "name": "middle"})
    got = offers.best_deals(o).orderBy("rank").collect()
    assert [(r.rank, r.name, r.score) for r in got] == [(1, "budget", 0.4562), (2, "middle", 0.0963), (3, "luxury", -0.3425)]
    assert offers.best_deals(table(spark, {})).first().score == 0.07


def test_nmck_golden(spark):
    rows = [{"seller": f"s{i}", "price": p} for i, p in enumerate((100, 110, 120, 400, 30))]
    got = nmck.statistics(table(spark, *rows)).first()
    assert (got.n_offers, got.mean, got.stdev, got.cv_pct, got.homogeneous) == (3, 110.0, 10.0, 9.09, True)


def test_nmck_needs_three_sellers(spark):
    o = table(spark, {"seller": "a", "price": 5}, {"seller": " A ", "price": 4}, {"seller": "b", "price": 3})
    assert nmck.statistics(o).count() == 0
    assert [float(r.price) for r in nmck.selection(o).orderBy("number").collect()] == [3.0, 4.0]


def test_nmck_band_too_narrow_takes_the_pool(spark):
    o = table(spark, *[{"seller": s, "price": p} for s, p in (("a", 10), ("b", 100), ("c", 1000), ("d", 0))])
    assert sorted(float(r.price) for r in nmck.selection(o).collect()) == [10.0, 100.0, 1000.0]


def test_regional_price(spark):
    o = table(spark, {"url": "https://example.com/a", "price": 1234})
    price = lambda region: float(offers.for_region(o, F.lit(region)).first().regional_price)
    assert price(2) == 1217
    assert price(213) == 1234
    noise = (hashlib.md5(b"https://example.com/a").digest()[0] / 255 - 0.5) * 0.02
    assert price(424242) == round(1234 * (0.97 + noise))


@pytest.mark.parametrize(("source", "n", "price", "flag"), [("wb", 5, 70, True), ("wb", 4, 10, False), ("runet", 5, 70, False), ("runet", 5, 65, True)])
def test_dumping(spark, source, n, price, flag):
    o = table(spark, *[{"source": source, "price": 100}] * (n - 1), {"source": source, "price": price})
    assert offers.dumping_flags(o).where(F.col("price") == price).first().dumping is flag


def test_facets(spark):
    o = table(
        spark,
        {"characteristics": {"brand": "A", "Память": "64 ГБ", "Вес": "1"}, "rating": 4.0, "reviews_count": 3},
        {"characteristics": {"Производитель": "B", "Память": "128 ГБ", "Цвет": "белый"}},
        {"characteristics": {"Brand": "A", "Память": "256", "rating": "5"}, "price": 250},
    )
    got = {(r.label, r.value): (r.kind, r.min, r.max, r.offers) for r in facets.facets(o).collect()}
    assert got[("Цена", None)] == ("numeric", 100.0, 250.0, 3)
    assert got[("Рейтинг", None)] == ("numeric", 0.0, 5.0, 1)
    assert got[("Память", None)] == ("numeric", 64.0, 256.0, 3)
    assert got[("Бренд", "A")][0] == "string" and got[("Бренд", "A")][3] == 2
    assert not any(label in ("Вес", "Цвет", "rating") for label, _ in got)
    kept = facets.apply_filters(o, {"Память": (100, 300)}, {"Бренд": ["A"]})
    assert [r.item_id for r in kept.collect()] == ["2"]
    assert facets.apply_filters(o, {"rating": (4.5, 5)}).count() == 2  # offers without a rating pass


def test_dedup(spark):
    o = table(spark, {"url": "https://a.ru/1", "item_id": "1"}, {"url": "https://a.ru/1", "item_id": "1"}, {"url": "https://www.ozon.ru/2", "item_id": ""}, {"url": "https://b.ru/3", "item_id": ""})
    assert offers.dedup_url(o).count() == 3
    assert offers.dedup_sku(o).count() == 3
    assert sorted(r.pos for r in offers.dedup_host(o).collect()) == [0, 3]


def test_sorts_settle_ties_by_arrival(spark):
    o = table(spark, {"price": 5, "reviews_count": None}, {"price": 5, "reviews_count": 2}, {"price": 1, "relevance": 9.0})
    order = lambda mode: [r.pos for r in offers.sorted_places(o, mode).orderBy("place").collect()]
    assert order("price_asc") == [2, 0, 1]
    assert order("reviews_desc") == [1, 0, 2]
    assert order("relevance") == [2, 0, 1]


def test_history(spark):
    pts = spark.createDataFrame([("wb", "1", f"2024-01-0{d} 00:00:00", p) for d, p in ((1, "100"), (2, "90"), (3, "97"))] + [("wb", "2", "2024-01-01 00:00:00", "5")], "source string, item_id string, ts string, price string").selectExpr("source", "item_id", "cast(ts as timestamp) ts", "cast(price as decimal(12,2)) price")
    got = history.sparkline(pts).first()
    assert (got.points, got.diff_pct, got.trend) == (3, pytest.approx(-3), "good")
    items = spark.createDataFrame([(1, "wb", "1"), (1, "wb", "2"), (1, "wb", "none")], "request_id int, source string, item_id string")
    assert {(r.item_id, r.cheapest) for r in history.compare(items, pts).collect()} == {("1", False), ("2", True), ("none", False)}
    with pytest.raises(ValueError):
        api.get_price_history(pts, "wb", "1", 0)


def test_price_changes(spark):
    rows = [(1, 1, "100"), (1, 2, None), (1, 3, "98"), (1, 4, "98.5"), (2, 1, "0"), (2, 2, "5")]
    c = spark.createDataFrame([(w, i, i, p) for w, i, p in rows], "watch_id int, check_id int, check_ts int, best_price string").selectExpr("watch_id", "check_id", "check_ts", "cast(best_price as decimal(12,2)) best_price", "2.0D threshold_pct")
    got = watches.price_changes(c).collect()
    assert [(r.watch_id, r.check_id, r.diff_pct) for r in got] == [(1, 3, -2.0)]


def test_upsert_and_recent(spark):
    old = spark.createDataFrame([("u", "wb", "1")], "user_id string, source string, item_id string")
    new = spark.createDataFrame([("u", "wb", "1"), ("u", "wb", "2"), ("u", "wb", "2")], "user_id string, source string, item_id string")
    assert watches.upsert_favorites(old, new).count() == 2
    h = spark.createDataFrame([("o", "A", 1), ("o", "a", 3), ("o", "b", 2)], "owner_key string, query string, ts int")
    assert [(r.query, r.place) for r in watches.recent_queries(h).orderBy("place").collect()] == [("a", 1), ("b", 2)]


def test_sentiment(spark):
    r = spark.createDataFrame([("i", x) for x in ("positive", "positive", "neutral", "negative")], "item_id string, label string")
    got = reviews.breakdown(r, "item_id").first()
    assert (got.positive_pct, got.neutral_pct, got.negative_pct) == (50.0, 25.0, 25.0)
    assert reviews.classified(spark.createDataFrame([("x",)], "text string")).first().label == "neutral"


def test_joined_text(spark):
    got = spark.range(1).select(reviews.joined_text(F.lit("Отличное качество"), F.lit(" "), F.lit("быстрая доставка")).alias("t")).first().t
    assert got == "Отличное качество быстрая доставка"


def test_numbers(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    card = F.lit("1 299,50 ₽\nМагазин\n4,7 (1,2 тыс)")
    assert one(numbers.ruble_price(card)) == 1299
    assert one(numbers.card_rating(card)) == 4.7
    assert one(numbers.card_reviews(card)) == 1200
    assert one(numbers.digits_price(F.lit("99,90"))) == 9990
    assert one(numbers.first_number(F.lit("нет"))) is None
    assert one(numbers.review_time(F.lit("1700000000000"))) == 1.7e9
    assert one(numbers.review_time(F.lit("вчера"))) is None
    attributes = one(numbers.title_attributes(F.lit("Смартфон Apple iPhone 15 256 ГБ, 6,1\" чёрный eSIM"), F.lit("Обычно 100 000 ₽ 90 000 ₽ в наличии")))
    assert attributes["Бренд"] == "Apple" and attributes["Память"] == "256 ГБ" and attributes["Диагональ"] == "6.1''" and attributes["Цвет"] == "чёрный" and attributes["SIM"] == "eSIM" and attributes["Наличие"] == "в наличии"


def test_links(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    assert one(urls.crc16(F.lit(777).cast("long"))) == 27379
    assert one(urls.feedback_shard(F.lit(777).cast("long"))) == 2
    assert one(urls.with_region(F.lit("https://x.ru/?lr=2&sku=456"), F.lit(213))) == "https://x.ru/?lr=213&sku=456"
    assert one(urls.shard(F.lit(14_400_000).cast("long"))) == "02"
    assert one(urls.shard(F.lit(768_600_000).cast("long"))) == "36"
    assert one(urls.excluded_host(F.lit("https://m.lamoda.ru/x"))) is True
    assert one(urls.seller_link(F.lit("М.Видео"), F.lit("a b"))) == "https://www.mvideo.ru/product-list-page?q=a+b"
    assert one(urls.seller_link(F.lit("biggeek.ru"), F.lit("x"))) == "https://biggeek.ru/search/?q=x"
    assert one(urls.owner_key(F.lit(None).cast("string"), F.lit("short"))) is None
    assert one(numbers.discount_pct(F.lit(75), F.lit(100))) == 25


def test_search_api(spark):
    o = table(spark, {"name": "iphone 15", "price": 10}, {"name": "iphone 15 case", "price": 5, "source": "ozon"}, {"name": "x", "source": "ya_market"})
    got = api.search(o, spark.createDataFrame([("q", "iphone 15")], "query_id string, raw string"), region_id=2)
    assert got["groups"].count() == 2 and got["top_deals"].count() == 2
    assert all(0 <= r.relevance <= 100 for r in got["offers"].collect())
    with pytest.raises(ValueError):
        api.search(o, o, max_per_source=0)
