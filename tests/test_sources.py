"""Captured payloads, snapshots, buckets and streams."""

import json
import math

from pyspark.sql import functions as F

from bazaarium.functions import jsonld
from bazaarium.sources import captures, sinks
from bazaarium.streaming import buckets, streams

PAGES = [
    ("https://a.ru/1", '<script type="application/ld+json">{"@type": "Product", "name": "A", "offers": {"price": "1 299,50"}, "image": "//h/x"}</script>'),
    ("https://b.ru/2", '<script type="application/ld+json">{"@graph": [{"@type": ["Thing", "Product"], "name": "B", "offers": [{"lowPrice": 500}], "brand": {"name": "Br"}}]}</script>'),
    ("https://c.ru/3", '<script type="application/ld+json">{"@type": "ItemList", "itemListElement": [{"item": {"@type": "Product", "name": "C", "price": 150, "color": "red", "additionalProperty": [{"name": "k", "value": "v"}]}}]}</script><script type="application/ld+json">{broken</script>'),
    ("https://d.ru/4", '<script type="application/ld+json">{"@type": "WebPage", "mainEntity": {"@type": "Product", "name": "D", "offers": {"price": 99}}}</script>'),
    ("https://e.ru/5", "<p>nothing</p>"),
]


def test_product_pages(spark):
    pages = spark.createDataFrame(PAGES, "url string, html string")
    got = {r.name: r for r in captures.page_offers(pages).collect()}
    assert set(got) == {"A", "B", "C"}  # D is too cheap
    assert float(got["A"].price) == 1299.5 and got["A"].image == "https://h/x" and got["A"].seller == "a.ru"
    assert float(got["B"].price) == 500 and got["B"].brand == "Br"
    assert got["C"].characteristics == {"Цвет": "red", "k": "v"}


def test_market_pages(spark):
    html = '<script type="application/ld+json">{"@type": "Product", "name": "M", "url": "https://m.ru/1", "offers": [{"price": "10.50", "priceCurrency": "USD"}], "aggregateRating": {"ratingValue": 4.5, "ratingCount": 7}}</script>'
    got = captures.market_offers(spark.createDataFrame([("u", html)], "url string, html string")).first()
    assert (float(got.price), got.currency, got.rating, got.characteristics) == (10.5, "USD", 4.5, {"rating_count": "7"})


def test_catalogue(spark):
    payload = json.dumps({"hydration": [], "jsonld": [], "dom": [{"nm": "5", "name": "/ Чайник", "price_rub": 900, "url": ""}, {"nm": "x", "name": "y"}, {"nm": "6", "name": "", "sizes": [{"price": {"total": 12300}}]}]})
    stubs = captures.catalogue_stubs(spark.createDataFrame([(payload,)], "payload string"))
    card = json.dumps({"nm_id": 6, "imt_id": 60, "imt_name": "Лампа", "selling": {"brand_name": "Свет"}, "grouped_options": [{"group_name": "g", "options": [{"name": "Цвет", "value": "белый"}]}], "clientPriceU": 99900})
    full = captures.with_cards(stubs, captures.cards(spark.createDataFrame([(card,)], "payload string")))
    got = {r.nm_id: r for r in captures.catalogue_offers(full).collect()}
    assert float(got[5].price) == 900 and got[5].name == "Чайник"
    assert got[6].name == "Лампа" and float(got[6].price) == 123 and got[6].characteristics == {"Цвет": "белый", "Бренд": "Свет"}


def test_feedbacks(spark):
    page = json.dumps({"feedbackCount": 2, "valuation": "4.7", "valuationDistribution": {"5": 2}, "feedbacks": [{"id": "a", "nmId": 1, "createdDate": "2024-01-01"}, {"id": "b", "nmId": 1, "createdDate": "2024-02-01"}, {"id": "c"}]})
    rows = spark.createDataFrame([(page,)], "payload string")
    assert [r.id for r in captures.feedbacks(rows).orderBy("place").collect()] == ["b", "a"]
    assert captures.feedback_pages(rows).first().valuation_distribution == {"5": 2}


def test_widgets(spark):
    item = json.dumps({"items": [{"sku": "1", "title": "T", "price": "38 112 ₽", "link": "/product/1", "seller": "S"}, {"sku": "1", "title": "again"}]})
    payload = json.dumps({"widgetStates": {"searchResultsV2-1": item, "other-1": item, "skuList-2": "{broken"}})
    got = captures.widget_offers(captures.widget_stubs(spark.createDataFrame([(payload,)], "payload string"))).collect()
    assert [(float(r.price), r.url, r.characteristics) for r in got] == [(38112.0, "https://www.ozon.ru/product/1", {"Продавец": "S"})]


def test_first_value_of_a_key_stays(spark):
    pairs = F.array(F.struct(F.lit("a").alias("key"), F.lit("1").alias("value")), F.struct(F.lit("a").alias("key"), F.lit("2").alias("value")))
    assert spark.range(1).select(jsonld.first_wins(pairs).alias("m")).first().m == {"a": "1"}


def test_snapshot(spark, tmp_path):
    path, t = str(tmp_path / "s"), "cast('2024-01-01 00:%s:00' as timestamp)"
    sinks.write_snapshot(spark.range(1), path, F.expr(t % "00"), 900, 3600)
    assert sinks.read_snapshot(spark, path, F.expr(t % "10")).count() == 1
    assert sinks.read_snapshot(spark, path, F.expr(t % "20")).count() == 0
    assert sinks.read_snapshot(spark, path, F.expr(t % "20"), stale=True).count() == 1


def test_bucket_against_plain(spark):
    calls = [("a", i, float(t)) for i, t in enumerate((0, 1, 2, 30, 31, 200))] + [("b", 9, 5.0)]
    got = {r.call_id: r.wait_ms for r in buckets.token_bucket(spark.createDataFrame(calls, "key string, call_id long, ts double"), 2).collect()}
    tokens, last = 2.0, 0.0
    for _, i, t in calls[:-1]:
        tokens, last = min(2.0, tokens + (t - last) / 30), t
        if tokens >= 1:
            tokens -= 1
            assert got[i] == 0
        else:
            assert got[i] == math.ceil((1 - tokens) * 30 * 1000)
    assert got[9] == 0
    assert buckets.token_bucket(spark.createDataFrame(calls, "key string, call_id long, ts double"), 0).where("wait_ms > 0").count() == 0


def test_escalation(spark):
    f = spark.createDataFrame([("s", i, t) for i, t in enumerate((0, 10, 20, 30, 40, 200))], "source string, event_id int, t int").selectExpr("source", "event_id", "timestamp_seconds(t) ts")
    assert [r.level for r in buckets.escalations(f, 60).orderBy("event_id").collect()] == [1, 1, 2, 3, 3, 3]


def test_alert_stream_equals_batch(spark, tmp_path):
    for n, rows in enumerate(([("w", 1, 100.0), ("w", 2, None)], [("w", 3, 90.0), ("v", 4, 5.0)])):
        spark.createDataFrame([(w, i, p, 2.0) for w, i, p in rows], "watch_id string, check_id long, best_price double, threshold_pct double").selectExpr("watch_id", "check_id", "timestamp_seconds(check_id) check_ts", "best_price", "threshold_pct").coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    schema = spark.read.parquet(str(tmp_path / "in" / "0")).schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job = streams.alert_stream(stream).writeStream.format("memory").queryName("alerts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    job.awaitTermination()
    got = spark.sql("SELECT * FROM alerts").collect()
    assert [(r.watch_id, r.check_id, round(r.diff_pct, 4)) for r in got] == [("w", 3, -10.0)]
