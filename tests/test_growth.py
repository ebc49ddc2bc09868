"""What larger tables bring: values that small ones lack, and work that must not be done many times a row."""

import math
from datetime import datetime

from pyspark.sql import functions as F

from bazaarium.functions import json_nodes, jsonld, urls
from bazaarium.operators import facets, history, nmck, offers, ranking
from bazaarium.plans import catalog, payloads
from bazaarium.sources import widgets

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sparkline_from_a_price_of_nothing(spark):
    points = [("s", k, datetime(2024, 1, day), float(p)) for k, prices in (("a", (0, 5)), ("b", (0, 0)), ("c", (4, 5))) for day, p in enumerate(prices, 1)]
    rows = spark.createDataFrame(points, "source string, item_id string, ts timestamp, price double").withColumn("price", F.col("price").cast("decimal(12,2)"))
    found = {r.item_id: r for r in history.sparkline(rows).collect()}
    assert found["a"].diff_pct == math.inf and math.isnan(found["b"].diff_pct) and found["c"].diff_pct == 25
    assert [found[k].trend for k in "abc"] == ["bad"] * 3


def test_hosts_are_found_once_a_row(spark):
    links = spark.range(3).select(F.concat(F.lit("https://img"), F.col("id").cast("string"), F.lit(".ozon.ru/x")).alias("u"))
    for found in (urls.excluded_host(F.col("u")), urls.allowed_host(urls.host(F.col("u")))):
        assert plan(links.select(found.alias("x"))).count("ParseUrlEvaluator") == 1


def test_hosts_and_those_below(spark):
    names = ["ozon.ru", "img.OZON.ru", "fakeozon.ru", "ozon.ru.evil.example", "ozonxru", "ozon.ru\n", None]
    rows = spark.createDataFrame([(n, h) for n, h in enumerate(names)], "n int, h string")
    assert [r.x for r in rows.orderBy("n").select(urls.allowed_host(F.col("h")).alias("x")).collect()] == [True, True] + [False] * 5


def test_crc_is_small_and_right(spark):
    def plain(value):
        crc = 0
        for byte in value.to_bytes(8, "little", signed=True):
            crc ^= byte
            for _ in range(8):
                crc = crc >> 1 ^ (crc & 1) * 0xA001
        return crc

    values = [0, 1, 777, -1, 255, 1 << 40, -(1 << 63), (1 << 63) - 1]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", urls.crc16(F.col("v")).alias("crc"))
    assert {r.v: r.crc for r in rows.collect()} == {v: plain(v) for v in values}
    assert plan(rows).count("shiftright") < 10


def test_shards_of_three_digits_are_whole(spark):
    nm = spark.range(1).select(F.lit(2_766_134_739).alias("nm"))
    assert nm.select(urls.shard(F.col("nm")).alias("s")).first().s == "100"


def test_payloads_are_made_in_as_many_tasks_as_there_are(spark):
    """A file of one group of rows is read by one task, whatever its size."""
    assert payloads._parts(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_walk_marks_the_first_object(spark):
    rows = spark.createDataFrame([(1, '[{"a": {"b": {}}}, {"c": 1}]'), (2, "{"), (3, None), (4, "[]"), (5, ' {"x": [{}]}')], "k int, t string")
    found = json_nodes.walk(rows, ["k"], "t").selectExpr("k", "at", "first", "to_json(node) AS node").orderBy("k", "at").collect()
    assert [tuple(r) for r in found] == [(1, 1, True, '{"a":{"b":{}}}'), (1, 7, False, '{"b":{}}'), (1, 13, False, "{}"), (1, 19, False, '{"c":1}'), (5, 1, True, '{"x":[{}]}'), (5, 8, False, "{}")]


def test_a_payload_is_parsed_once(spark):
    rows = spark.range(2).select("id", F.concat(F.lit('{"widgetStates": {"w'), F.col("id").cast("string"), F.lit('": "{}"}}')).alias("payload"))
    states = widgets.widget_states(rows, "payload", "id")
    assert plan(states).count("from_json") == 1
    assert sorted(tuple(r) for r in states.collect()) == [(0, "w0", 0, "{}"), (1, "w1", 0, "{}")]


def test_pages_without_reviews_have_none(spark):
    rows = spark.createDataFrame([(1, "webListReviews-1", 0, '{"text": "short"}'), (1, "other", 1, '{"text": "A text that is long enough for a review"}'), (2, "WEBListReviews", 0, '{"text": "A text that is long enough for a review"}')], "k int, widget string, pos int, state string")
    assert [r.k for r in widgets.widget_reviews(rows, "k").collect()] == [2]


def test_places_write_narrow_rows(spark, monkeypatch):
    seen, store = [], ranking.stored
    monkeypatch.setattr(ranking, "stored", lambda rows, label: seen.append(set(rows.columns)) or store(rows, label))
    catalog.sorted_by_price(spark, SF)
    assert seen and not any({"name", "url", "characteristics"} & columns for columns in seen)


def test_contract_price_carries_what_it_needs(spark, monkeypatch):
    seen, store = [], nmck.stored
    monkeypatch.setattr(nmck, "stored", lambda rows, label: seen.append(set(rows.columns)) or store(rows, label))
    catalog.nmck_statistics(spark, SF)
    assert seen and not any({"name", "url", "characteristics"} & columns for columns in seen)


def test_one_per_seller_with_and_without_a_map(spark):
    rows = spark.createDataFrame([("q", "wb", " A", 3, 1), ("q", "wb", "a", 2, 3), ("q", "wb", "a", 2, 2), ("q", "wb", "", 5, 4), ("q", "wb", None, 0, 5)], "query_id string, source string, seller string, price int, pos int")
    for own in (rows, rows.withColumn("m", F.create_map(F.lit("k"), F.lit("v")))):
        assert sorted((r.seller_key, r.price, r.pos) for r in nmck.one_per_seller(own).collect()) == [("a", 2, 2), ("wb", 5, 4)]


def test_cheapest_sorts_no_whole_offers(spark):
    rows = spark.createDataFrame([("q", 3, 1), ("q", 2, 3), ("q", 2, 2), ("r", 0, 1), (None, 1, 9)], "query_id string, price int, pos int").withColumn("m", F.create_map(F.lit("k"), F.lit("v")))
    found = offers.cheapest(rows)
    assert "_lowest" in plan(found)
    assert {(r.query_id, r.price, r.pos) for r in found.collect()} == {("q", 2, 2), (None, 1, 9)}


def test_a_host_is_found_once_for_its_first_offer(spark):
    rows = spark.createDataFrame([("q", "https://A.example/1", 2), ("q", "https://a.example/2", 1), ("q", "https://x.ozon.ru/", 0), ("q", "none", 4)], "query_id string, url string, pos int")
    found = offers.dedup_host(rows)
    assert plan(found).count("ParseUrlEvaluator") == 1
    assert sorted((r.url, r.pos) for r in found.collect()) == [("https://a.example/2", 1), ("none", 4)]


def test_equal_characteristics_are_looked_at_once(spark):
    rows = spark.createDataFrame([("q", {"Цвет": c}) for c in "aab"] + [("q", None)], "query_id string, characteristics map<string, string>")
    found = facets.dynamic(rows)
    assert {(r.value, r.offers) for r in found.collect()} == {("a", 2), ("b", 1)}


def test_objects_without_the_key_are_left_out():
    text = r'{"@graph": [{"\u0040type": "Product", "offers": {"@type": 1}}, {"a": {"@type": 2}}, {"@graph": {"@type": []}}]}'
    found = [t for _, _, t in json_nodes.objects(text, ("@graph",), "@type")]
    assert found == [r'{"\u0040type": "Product", "offers": {"@type": 1}}', '{"@type": []}']


def test_pairs_are_made_once_for_all_keys(spark):
    rows = spark.range(1).select(F.array(*[F.struct(F.lit(k).alias("key"), F.concat(F.lit(v), F.col("id").cast("string")).alias("value")) for k, v in ("ax", "by", "az")]).alias("pairs"))
    found = rows.select(jsonld.first_wins(F.filter("pairs", lambda p: p["value"] != "")).alias("m"))
    assert found.first().m == {"a": "x0", "b": "y0"}
    assert found._jdf.queryExecution().analyzed().toString().count("filter(pairs#") == 1


def test_pages_are_not_sent_whole_to_their_stubs(spark):
    """What pages say is many times what Spark takes it for, so that a broadcast of it fails the driver."""
    captured = spark.range(3).select("id", F.concat(F.lit('{"widgetStates": {"webProductHeading-1": "{\\"title\\": \\"page '), F.col("id").cast("string"), F.lit('\\"}"}}')).alias("payload"))
    stubs = spark.range(1, 5).selectExpr("id", "'' AS item_id", "if(id = 2, 'own', null) AS name", "CAST(null AS DECIMAL(12,2)) AS price", "CAST(null AS DOUBLE) AS rating", "CAST(null AS INT) AS reviews_count")
    found = widgets.backfilled(stubs, captured, key="id")
    assert sorted((r.id, r.name) for r in found.collect()) == [(1, "page 1"), (2, "own"), (3, None), (4, None)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
