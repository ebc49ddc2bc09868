"""The capture format, its filters, and adapters' common columns."""

import datetime

import pytest
from pyspark.sql import functions as F

from bazaarium.sources import adapters


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("captures"))
    day = lambda n: datetime.datetime(2024, 1, n)
    rows = [("u1", day(1), '{"widgetStates": {"skuList-1": "{\\"items\\": [{\\"sku\\": 5, \\"title\\": \\"Pot\\", \\"price\\": \\"900 ₽\\", \\"link\\": \\"/p/5\\"}]}"}}', "widgets", "ozon"), ("u2", day(2), "{broken", "widgets", "ozon"), ("u3", day(3), "text", "notes", "wb"), ("u4", day(4), None, "widgets", "other"), (None, None, "late", "notes", None)]
    adapters.keep(spark.createDataFrame(rows[:3], adapters.SCHEMA), path)
    adapters.keep(spark.createDataFrame(rows[3:], adapters.SCHEMA), path)
    return path


def urls(df):
    return sorted(str(r.url) for r in df.collect())


def test_reads_what_was_kept_and_filters_as_spark_does(spark, folder):
    table = adapters.captured(spark, folder)
    assert urls(table) == ["None", "u1", "u2", "u3", "u4"]
    assert urls(table.where("kind = 'widgets' AND source IN ('ozon', 'wb')")) == ["u1", "u2"]
    assert urls(table.where("source IS NULL")) == ["None"]
    assert urls(table.where("kind = 'nothing'")) == []
    assert urls(table.where("source = 'ozon'").unionByName(table.where("source = 'wb'"))) == ["u1", "u2", "u3"]


def test_options_choose_files_and_times(spark, folder):
    day = lambda n: datetime.datetime(2024, 1, n)
    assert urls(adapters.captured(spark, folder, kinds=["widgets"])) == ["u1", "u2", "u4"]
    assert urls(adapters.captured(spark, folder, ["widgets", "notes"], ["ozon", None])) == ["None", "u1", "u2"]
    assert urls(adapters.captured(spark, folder, since=day(2), until=day(4))) == ["u2", "u3"]
    assert urls(adapters.captured(spark, folder, kinds=["nothing"])) == []
    files = adapters.CaptureReader({"path": folder, "kinds": '["widgets"]', "sources": '["ozon"]'}).partitions()
    assert files and {(f.kind, f.source) for f in files} == {("widgets", "ozon")}


def test_adapters_give_one_schema(spark, folder):
    found = adapters.offers(spark, folder)
    assert [c.split()[0] for c in adapters.OFFER.replace("map<string, string>", "map").split(", ")] == found.columns
    row = found.collect()
    assert [(r.source, r.item_id, r.name, float(r.price), r.url, r.rating) for r in row] == [("ozon", "5", "Pot", 900.0, "https://www.ozon.ru/p/5", None)]
    assert row[0].captured_at == datetime.datetime(2024, 1, 1)
    with pytest.raises(ValueError, match="no adapter for nobody"):
        adapters.offers(spark, folder, ["nobody"])


def test_callers_register_adapters(spark, folder, monkeypatch):
    monkeypatch.setattr(adapters, "ADAPTERS", dict(adapters.ADAPTERS))
    adapters.register(adapters.Adapter("notes", "wb", lambda p: p.select(F.col("payload").alias("name"), F.lit("7").alias("price"), "url")))
    got = adapters.offers(spark, folder, ["wb"]).first()
    assert (got.source, got.name, float(got.price), got.seller) == ("wb", "text", 7.0, None)
