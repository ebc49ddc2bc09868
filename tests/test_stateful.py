"""Streams with state, over several micro-batches that come out of order, late or never."""

import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bazaarium.streaming import stateful

START = 1_700_000_000


def run(spark, folder, parts, schema, stream, mode="append"):
    """Rows that a stream gives, a list for each part of its input."""
    out, found = [], []
    for n, rows in enumerate(parts):
        part = spark.createDataFrame(rows, schema)
        names = [f.name for f in part.schema if f.name.endswith("_s")]
        part = part.withColumns({c.removesuffix("_s"): F.timestamp_seconds(F.lit(START) + F.col(c)) for c in names}).drop(*names)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        found.clear()
        with stateful.rocksdb(spark):
            job = stream(spark.readStream.schema(part.schema).parquet(f"{folder}/in")).writeStream.outputMode(mode)
            job.foreachBatch(lambda df, _: found.extend(df.collect())).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        out.append(list(found))
    return out


SEARCH = "query_id string, kind string, source string, error string, pos string, price double, worth double, fetched_at_s long"


def offer(query, source, pos, price, at, worth=0.0):
    return (query, "offer", source, None, pos, price, worth, at)


def end(query, source, at, error=None):
    return (query, "finished", source, error, None, None, None, at)


def test_search_starts_streams_finishes_and_ends_with_deals(spark, tmp_path):
    parts = [
        [offer("q", "wb", "1", 100.0, 0), offer("q", "ozon", "2", 50.0, 0), offer("r", "wb", "1", 7.0, 0), offer("q", "elsewhere", "9", 1.0, 0)],
        [end("q", "wb", 5), offer("q", "ozon", "3", None, 5), offer("q", "ozon", "4", 60.0, 6)],
        [end("q", "ozon", 8, "broke off"), offer("q", "ozon", "5", 1.0, 9)],
        [("", "tick", "", None, None, None, None, 1000)],
        [end("q", "wb", 1001), offer("r", "ozon", "8", 8.0, 1001)],
    ]
    got = run(spark, str(tmp_path), parts, SEARCH, lambda s: stateful.search_events(s, ("wb", "ozon"), top=2, wait_s=60))
    of = lambda rows, q: [(r.event, r.source) for r in sorted(rows, key=lambda r: r.seq) if r.query_id == q]
    assert of(got[0], "q") == [("source_started", "wb"), ("source_started", "ozon"), ("offer", "wb"), ("offer", "ozon")]
    assert of(got[1], "q") == [("offer", "ozon"), ("source_finished", "wb")]
    third = sorted((r for r in got[2] if r.query_id == "q"), key=lambda r: r.seq)
    assert [r.event for r in third] == ["offer", "source_finished", "top_deal", "top_deal", "done"]
    assert [(r.pos, r.rank) for r in third if r.event == "top_deal"] == [("5", 1), ("2", 2)]
    finished = third[1]
    assert (finished.offers, finished.min_price, finished.median_price, finished.error) == (3, 1.0, 50.0, "broke off")
    assert of(got[3], "r") == [("source_finished", "wb"), ("source_finished", "ozon"), ("top_deal", "wb"), ("done", None)]
    assert {r.error for r in got[3] if r.event == "source_finished"} == {"timeout"}
    assert got[4] == []
    seqs = defaultdict(list)
    for r in sum(got, []):
        seqs[r.query_id].append(r.seq)
    assert all(sorted(s) == list(range(1, len(s) + 1)) for s in seqs.values())


def test_messages_leave_out_empty_fields(spark):
    row = [("q", 3, "offer", "wb", "7", None, None, None, None, None, None, None)]
    got = stateful.event_messages(spark.createDataFrame(row, stateful.EVENT)).first()
    assert (got.event, json.loads(got.data)) == ("offer", {"source": "wb", "pos": "7"})


CHECKS = "watch_id string, check_id long, check_ts_s long, best_price double, threshold_pct double"


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (1, 2, 0)])
def test_alerts_are_those_in_order_of_time_whatever_comes_first(spark, tmp_path, order):
    checks = [("w", n, 60 * n, price, 5.0) for n, price in enumerate([100.0, 110.0, None, 111.0, 90.0, 0.0, 50.0, 70.0, 70.0])] + [("v", 1, 30, 10.0, 5.0), ("v", 2, 500, 20.0, 5.0)]
    parts = [[c for c in checks if c[1] % 3 == n] for n in order]
    got = run(spark, str(tmp_path), [*parts, [("end", 0, 5000, None, 1.0)]], CHECKS, lambda s: stateful.alert_stream(s, "1000 seconds"))
    assert got[:3] == [[], [], []]
    alerts = sorted((r.watch_id, r.check_id, r.prev_price, r.new_price) for r in got[3])
    assert alerts == [("v", 2, 10.0, 20.0), ("w", 1, 100.0, 110.0), ("w", 4, 111.0, 90.0), ("w", 5, 90.0, 0.0), ("w", 7, 50.0, 70.0)]


def test_series_keep_the_newest_points(spark, tmp_path):
    parts = [[("s", "1", 10 * n, 1.0 + n) for n in range(4)], [("s", "1", 5, 9.0), ("s", "1", 35, 2.0), ("s", "1", 35, 2.0), ("s", "2", 1, -1.0)]]
    got = run(spark, str(tmp_path), parts, "source string, item_id string, ts_s long, price double", lambda s: stateful.series_stream(s, 3), "update")
    assert [[p.price for p in r.points] for r in got[0]] == [[2.0, 3.0, 4.0]]
    assert [(r.version, [p.price for p in r.points]) for r in got[1]] == [(2, [4.0, 2.0, 2.0])]


def test_keys_without_an_id_and_many_keys_in_few_groups(spark, tmp_path):
    seen = []
    checks = [(w, n, 60 * n, 100.0 * (n + 1), 5.0) for w in (None, *map(str, range(700))) for n in range(2)]
    def alerts(rows):
        found = stateful.alert_stream(rows, "10 seconds")
        seen.append(found._jdf.queryExecution().analyzed().toString())
        return found
    got = run(spark, str(tmp_path / "a"), [checks, [("end", 0, 5000, None, 1.0)]], CHECKS, alerts)
    assert {r.watch_id for r in got[1]} == {None, *map(str, range(700))} and len(got[1]) == 701
    assert "[slot#" in seen[0]
    points = [(None, "1", n, 1.0 + n) for n in range(3)]
    last = run(spark, str(tmp_path / "s"), [points], "source string, item_id string, ts_s long, price double", lambda s: stateful.series_stream(s, 2), "update")[0]
    assert [(r.source, r.version, [p.price for p in r.points]) for r in last] == [(None, 1, [2.0, 3.0])]


def test_session_keeps_its_state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), stateful.rocksdb(spark):
        assert spark.conf.get(key) != before
        raise ValueError
    assert spark.conf.get(key) == before
