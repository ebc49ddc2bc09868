"""A keyed table under upserts, deletions, old reads, compaction, writers that collide and writes that break off."""

import pytest
from pyspark.sql import functions as F

from bazaarium.sources.keyed import KeyedTable

SCHEMA = "k string, n long, m map<string,string>"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ("k",))


def rows(spark, *values):
    return spark.createDataFrame([(k, n, {"n": str(n)}) for k, n in values], SCHEMA)


def held(df):
    return sorted((r.k or "", r.n, r.m["n"]) for r in df.collect())


def test_upsert_delete_and_old_states(spark, table):
    assert table.version() == 0 and held(table.read()) == []
    assert table.upsert(rows(spark, ("a", 1), ("b", 2), (None, 3))) == 1
    assert table.upsert(rows(spark, ("b", 4), (None, 5), ("c", 6))) == 2
    assert table.delete(spark.createDataFrame([("a",), ("nobody",)], "k string")) == 3
    assert held(table.read()) == [("", 5, "5"), ("b", 4, "4"), ("c", 6, "6")]
    assert held(table.read(1)) == [("", 3, "3"), ("a", 1, "1"), ("b", 2, "2")]
    assert held(table.read(0)) == []
    table.upsert(rows(spark, ("a", 7)).select("n", "k").withColumn("other", F.lit(1)).withColumn("m", F.create_map(F.lit("n"), F.lit("7"))))
    assert ("a", 7, "7") in held(table.read())


def test_compaction_keeps_what_stands_and_later_changes_win(spark, table):
    for n in range(4):
        table.upsert(rows(spark, ("a", n), (f"k{n}", n)))
    table.delete(spark.createDataFrame([("k0",)], "k string"))
    before = held(table.read())
    table.compact()
    assert held(table.read()) == before and len(table.commits()) == 1
    table.compact()
    assert len(table.commits()) == 1
    table.upsert(rows(spark, ("k0", 9), ("a", 10)))
    assert ("k0", 9, "9") in held(table.read()) and ("a", 10, "10") in held(table.read())


def test_change_during_compaction_stays(spark, table, monkeypatch):
    table.upsert(rows(spark, ("a", 1)))
    table.upsert(rows(spark, ("a", 2), ("b", 2)))
    write = table._write

    def slow(found, deleted):
        name = write(found, deleted)
        monkeypatch.setattr(table, "_write", write)
        table.upsert(rows(spark, ("a", 3)))
        return name

    monkeypatch.setattr(table, "_write", slow)
    table.compact()
    assert held(table.read()) == [("a", 3, "3"), ("b", 2, "2")]


def test_writers_that_collide_both_get_in(spark, table, monkeypatch):
    table.upsert(rows(spark, ("a", 1)))
    other = KeyedTable(spark, table.path, SCHEMA, ("k",))
    real = table.version
    monkeypatch.setattr(table, "version", lambda: (monkeypatch.setattr(table, "version", real), other.upsert(rows(spark, ("b", 2))), real() - 1)[-1])
    assert table.upsert(rows(spark, ("c", 3))) == 3
    assert held(table.read()) == [("a", 1, "1"), ("b", 2, "2"), ("c", 3, "3")]


def test_write_that_breaks_off_is_not_seen(spark, table, monkeypatch):
    table.upsert(rows(spark, ("a", 1)))

    def broken(*_):
        raise OSError("the driver died")

    with monkeypatch.context() as m:
        m.setattr(table, "_log", broken)
        with pytest.raises(OSError):
            table.upsert(rows(spark, ("a", 2)))
    assert held(table.read()) == [("a", 1, "1")]
    assert len(table.orphans()) == 1
    table.upsert(rows(spark, ("a", 3)))
    assert held(table.read()) == [("a", 3, "3")] and len(table.orphans()) == 1
