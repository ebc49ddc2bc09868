"""Streams with state by key: searches that end in deals, price alerts in order of time, and bounded price series.

State is in RocksDB lists, maps and values, read as they are needed; timers follow event time.  Start such a stream inside
``with rocksdb(spark):``, which sets the state store that they need and puts the session back as it was.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from bazaarium import values as V
from bazaarium.functions import pricing

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])


EVENT = "query_id string, seq long, event string, source string, pos string, rank int, score double, offers long, min_price double, avg_price double, median_price double, error string"
_OFFER = "pos string, source string, price double, worth double"
#: Prices that a search holds before they go to its state as one list.
HELD = 1 << 18


#: Offers that go to a search as one row, and rows among which they are gathered: PySpark makes a tuple of each row of a group.
PACKED, GATHERED = 100, 25_000
_PACK = "query_id string, kind string, source string, error string, fetched_at timestamp, event_ms long, pos array<string>, price array<double>, worth array<double>"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _PACK: up to PACKED rows alike in query, kind, source, error and second of their time, in their order."""
    keys, lists = ["query_id", "kind", "source", "error", "second"], ["pos", "price", "worth"]

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        groups = table.select(keys).append_column("n", pa.array(np.arange(len(table)))).group_by(keys, use_threads=False).aggregate([("n", "list")])
        rows = pa.concat_arrays(groups["n_list"].chunks)
        order, ends = rows.flatten().to_numpy(), rows.offsets.to_numpy()
        parts = -(-np.diff(ends) // PACKED)
        starts = np.repeat(ends[:-1], parts) + PACKED * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        own, table = table.take(order[starts]), table.take(order)
        us = table["us"].fill_null(0).to_numpy()
        timeless = own["us"].is_null().to_numpy(zero_copy_only=False)
        last, first = np.maximum.reduceat(us, starts), np.minimum.reduceat(us, starts) // 1000
        times = [pa.array(last, mask=timeless).cast(pa.timestamp("us", "UTC")), pa.array(first, mask=timeless)]
        cut = pa.array(np.append(starts, len(table)), pa.int32())
        listed = [pa.ListArray.from_arrays(cut, pa.concat_arrays(table[c].chunks)) for c in lists]
        names = [*keys[:4], "fetched_at", "event_ms", *lists]
        return pa.Table.from_arrays([*(own[c] for c in keys[:4]), *times, *listed], names).combine_chunks().to_batches()[0]

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= GATHERED:
            yield packed(held)
            held, n = [], 0
    if held:
        yield packed(held)


def contenders(offers: pd.DataFrame, top: int, weight: float) -> pd.DataFrame:
    """Offers that may be among the ``top`` by ``weight`` times the price's deviation plus worth, whatever mean and spread will be.

    Those left out have ``top`` others that are no worse by price and by worth, equal ones by ``pos``.  Exact: where few offers
    are worse by both, as many stay.
    """
    price, worth = offers["price"].to_numpy() * np.sign(-weight), offers["worth"].to_numpy()
    order, at, size = np.lexsort((-worth, price)), 0, 64
    some, best = [], np.empty(0)
    while at < len(order):
        block = order[at : at + size]
        if len(best) == top:
            block = block[worth[block] >= best[0]]
        some.append(block)
        best = np.sort(np.concatenate([best, worth[block]]))[-top:]
        at, size = at + size, 2 * size
    left = offers.iloc[np.concatenate(some)] if some else offers
    key = sorted(zip((left["price"] * np.sign(-weight)).tolist(), (-left["worth"]).tolist(), left["pos"].tolist(), left["source"].tolist(), range(len(left)), strict=True))
    stays, heap = [], []
    for _, minus, _, _, n in key:
        if len(heap) < top:
            heapq.heappush(heap, -minus)
        elif -minus > heap[0]:
            heapq.heapreplace(heap, -minus)
        else:
            continue
        stays.append(n)
    return left.iloc[stays]


class Search(StatefulProcessor):
    """One search: sources start, bring offers and finish; when all have, its best deals follow, and it is done.

    A source that has not finished when the timer fires counts as failed.  Of the offers the state has prices, in lists of
    many, and ``contenders`` for the best deals; so no offer is a call of its own.  The end holds the prices of a source.
    """

    def __init__(self, sources: tuple[str, ...], top: int, weight: float, wait_ms: int):
        self.sources, self.top, self.weight, self.wait_ms = sources, top, weight, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.prices = handle.getListState("prices", "source string, prices binary")
        self.best = handle.getListState("best", _OFFER)
        self.status = handle.getMapState("status", "source string", "finished boolean")
        self.last = handle.getValueState("last", "seq long, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.exists()
        seq, done = self.last.get() if known else (0, False)
        if done:
            for _ in rows:
                pass
            return
        status = {k[0]: v[0] for k, v in self.status.iterator()}
        first, best, ended = None, None, {}
        held: dict[str, list[np.ndarray]] = defaultdict(list)
        n_held = 0
        for frame in rows:
            at = int(frame["event_ms"].min())
            first = at if first is None else min(first, at)
            begun = []
            for source in frame["source"].unique():
                if source in self.sources and source not in status:
                    status[source] = False
                    self.status.updateValue((source,), (False,))
                    begun.append(("source_started", source))
            frame = frame[frame["source"].isin(self.sources)]
            packs = frame[frame["kind"] == "offer"]
            found = _frame([], _OFFER)
            if len(packs):
                pos, price, worth = (np.concatenate(packs[c].tolist()) for c in ("pos", "price", "worth"))
                found = pd.DataFrame({"pos": pos, "source": np.repeat(packs["source"].to_numpy(), packs["pos"].map(len)), "price": price.astype(np.float64), "worth": worth.astype(np.float64)})
                found = found[found["price"].notna()]
            if begun:
                yield self._numbered(key, seq, begun)
                seq += len(begun)
            if len(found):
                for source, own in found.groupby("source", sort=False)["price"]:
                    held[source].append(own.to_numpy(np.float64))
                n_held += len(found)
                if n_held >= HELD:
                    self._keep(held)
                    n_held = 0
                if best is None:
                    best = _frame(list(self.best.get()), _OFFER).astype({"price": "float64", "worth": "float64"})
                fresh = found.fillna({"worth": -np.inf})
                best = contenders(pd.concat([best, fresh]) if len(best) else fresh, self.top, self.weight)
                yield self._offers(key, seq, found)
                seq += len(found)
            for r in frame[frame["kind"] == "finished"].itertuples(index=False):
                ended[r.source] = r.error
        self._keep(held)
        if best is not None:
            self.best.put(list(best.itertuples(index=False, name=None)))
        if not known:
            self.handle.registerTimer(first + self.wait_ms)
        yield from self._emit(key, seq, ended, status)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seq, done = self.last.get()
        if done:
            return
        status = {k[0]: v[0] for k, v in self.status.iterator()}
        yield from self._emit(key, seq, {s: "timeout" for s in self.sources if not status.get(s)}, status)

    def _keep(self, held: dict[str, list[np.ndarray]]) -> None:
        """Move held prices to the state."""
        lists = [(source, np.concatenate(own).astype("<f8").tobytes()) for source, own in held.items()]
        if lists:
            self.prices.appendList(lists)
        held.clear()

    def _kept(self) -> Iterator[tuple[str, np.ndarray]]:
        for source, prices in self.prices.get():
            yield source, np.frombuffer(prices, "<f8")

    def _deals(self) -> list[tuple[float, str, str]]:
        n, total = 0, 0.0
        for _, p in self._kept():
            n, total = n + len(p), total + float(p.sum())
        mean = total / n if n else 0.0
        spread = (sum(float(((p - mean) ** 2).sum()) for _, p in self._kept()) / (n - 1)) ** 0.5 if n > 1 else 0.0
        z = (lambda p: (p - mean) / (spread or 1.0)) if n > 1 else (lambda p: 0.0)
        return heapq.nsmallest(self.top, ((-(self.weight * z(price) + worth), pos, source) for pos, source, price, worth in self.best.get()))

    @staticmethod
    def _offers(key, seq: int, found: pd.DataFrame) -> pd.DataFrame:
        """Events of offers."""
        n = len(found)
        own = {"query_id": key[0], "seq": np.arange(seq + 1, seq + n + 1), "event": "offer", "source": found["source"].to_numpy(), "pos": found["pos"].to_numpy()}
        return pd.DataFrame({**own, **{f.split()[0]: None for f in EVENT.split(", ")[5:]}}, index=range(n))

    @staticmethod
    def _numbered(key, seq: int, events: list[tuple]) -> pd.DataFrame:
        return _frame([(key[0], seq + n, *e, *[None] * (10 - len(e))) for n, e in enumerate(events, 1)], EVENT)

    def _emit(self, key, seq: int, ended: dict[str, str | None], status: dict[str, bool]) -> Iterator[pd.DataFrame]:
        ended = {s: e for s, e in ended.items() if not status.get(s)}
        out, prices = [], defaultdict(list)
        if ended:
            for source, p in self._kept():
                if source in ended:
                    prices[source].append(p)
        for source, error in ended.items():
            p = np.concatenate(prices.pop(source, [np.zeros(0)]))
            facts = (float(p.min()), float(p.mean()), float(np.median(p))) if len(p) else (None, None, None)
            out.append(("source_finished", source, None, None, None, len(p), *facts, error if isinstance(error, str) else None))
            status[source] = True
            self.status.updateValue((source,), (True,))
        done = all(status.get(s) for s in self.sources)
        if done:
            out += [("top_deal", source, pos, rank, -worst) for rank, (worst, pos, source) in enumerate(self._deals(), 1)]
            out.append(("done",))
            self.prices.clear()
            self.best.clear()
        self.last.update((seq + len(out), done))
        yield self._numbered(key, seq, out)


def worth(rating: Column, reviews: Column, weights: pricing.DealWeights = pricing.DealWeights()) -> Column:
    """What an offer's score is without its price."""
    return pricing.deal_score(F.lit(0.0), rating, reviews, weights)


def search_events(rows: DataFrame, sources: tuple[str, ...] = V.SOURCES, top: int = 10, weights: pricing.DealWeights = pricing.DealWeights(), delay: str = "1 minute", wait_s: int = 120) -> DataFrame:
    """Events of searches from a stream of (query_id, kind, source, error, pos, price, worth, fetched_at).

    ``kind`` is ``offer`` or ``finished``; other kinds only move time on.  ``pos`` orders equal deals, ``worth`` is what ``worth`` gives.
    For each query, numbered by ``seq``: source_started, offer and source_finished (with count, prices and error) of each source,
    top_deal by rank when all of ``sources`` have finished or ``wait_s`` seconds after its first row, then done.  What comes after
    that is ignored; sources not named are too.  Rows of one second are taken as late only if all of them are.
    """
    known = rows.select("query_id", "kind", "source", "error", F.unix_seconds("fetched_at").alias("second"), F.unix_micros("fetched_at").alias("us"), "pos", F.col("price").cast("double").alias("price"), F.col("worth").cast("double").alias("worth"))
    timed = known.mapInArrow(_pack, _PACK).withWatermark("fetched_at", delay)
    return timed.groupBy("query_id").transformWithStateInPandas(Search(tuple(sources), top, weights.price, 1000 * wait_s), EVENT, "Append", "EventTime")


def event_messages(events: DataFrame) -> DataFrame:
    """(query_id, seq, event, data): each event as the message that a client gets, ``data`` being JSON without empty fields."""
    fields = [c.split()[0] for c in EVENT.split(", ") if c.split()[0] not in ("query_id", "seq", "event")]
    return events.select("query_id", "seq", "event", F.to_json(F.struct(*fields)).alias("data"))


ALERT = "watch_id string, check_id long, event_us long, prev_price double, new_price double, diff_pct double"


#: Groups that watches and series are dealt into.  A group costs a call of Python for each micro-batch, so one for each key
#: would cost most where keys are many; what one group waits for is held at once.  Part of a stream's state: not to be changed between runs.
SLOTS = 512


def _slot(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")


class Alerts(StatefulProcessor):
    """Checks of a slot's watches wait until the watermark has passed them, so those of a watch are compared in order of time whatever came first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, watch_id string, check_id long, price double, threshold double")
        self.price = handle.getMapState("price", "watch_id string", "price double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            found = frame[frame["best_price"].notna()]
            if len(found):
                self.waiting.appendList(list(zip(*(found[c].tolist() for c in ("event_us", "watch_id", "check_id", "best_price", "threshold_pct")), strict=True)))
                least = int(found["event_us"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield _frame([], ALERT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = 1000 * timerValues.getCurrentWatermarkInMs()
        due, rest, out = defaultdict(list), [], []
        for us, watch, *check in self.waiting.get():
            if us < passed:
                due[watch].append((us, *check))
            else:
                rest.append((us, watch, *check))
        for watch, checks in due.items():
            known = self.price.getValue((watch,))
            prev = known[0] if known is not None else None
            for us, check_id, price, threshold in sorted(checks):
                if prev is not None and prev > 0:
                    diff = (price - prev) / prev * 100
                    if abs(diff) >= threshold:
                        out.append((watch, check_id, us, prev, price, diff))
                prev = price
            self.price.updateValue((watch,), (prev,))
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
            if rest:
                self.handle.registerTimer(min(r[0] for r in rest) // 1000 + 1)
        yield _frame(out, ALERT)


def alert_stream(checks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Alerts of a stream of checks (watch_id, check_id, check_ts, best_price double, threshold_pct), with a baseline per watch.

    A check is compared with the one before it in time, also where micro-batches bring them in another order, as long as
    none is later than ``delay``; so alerts come that much later.  Checks without a price set nothing.
    """
    timed = checks.withColumn("event_us", F.unix_micros("check_ts")).withWatermark("check_ts", delay)
    found = timed.withColumn("slot", _slot("watch_id")).groupBy("slot").transformWithStateInPandas(Alerts(), ALERT, "Append", "EventTime")
    return found.select("watch_id", "check_id", F.timestamp_micros("event_us").alias("check_ts"), "prev_price", "new_price", "diff_pct")


SERIES = "source string, item_id string, version long, points array<struct<us: long, price: double>>"


class Series(StatefulProcessor):
    """The newest points of each of a slot's series in lists of bounded length."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.series = handle.getMapState("series", "source string, item_id string", "version long, us array<long>, price array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[tuple[str, str], list[tuple[int, float]]] = defaultdict(list)
        for frame in rows:
            for source, item, *point in zip(*(frame[c].tolist() for c in ("source", "item_id", "event_us", "price")), strict=True):
                held = fresh[source, item]
                held.append(tuple(point))
                if len(held) >= 2 * self.most:
                    held[:] = heapq.nlargest(self.most, held)
        out = []
        for name, points in fresh.items():
            known = self.series.getValue(name)
            version, us, price = known if known is not None else (0, [], [])
            held = heapq.nlargest(self.most, [*points, *zip(us, price, strict=True)])
            self.series.updateValue(name, (version + 1, [p[0] for p in held], [p[1] for p in held]))
            out.append((*name, version + 1, [{"us": us, "price": price} for us, price in reversed(held)]))
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=["source", "item_id", "version", "points"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["source", "item_id", "version", "points"])


def series_stream(points: DataFrame, most: int = 2000) -> DataFrame:
    """(source, item_id, version, points) after each micro-batch with points of a series: those kept, oldest first, and how often it has changed.

    ``points`` has (source, item_id, ts, price), prices above 0 count; the newest ``most`` of each series are kept.
    """
    timed = points.where("price > 0").select("source", "item_id", F.unix_micros("ts").alias("event_us"), F.col("price").cast("double").alias("price"))
    found = timed.withColumn("slot", _slot("source", "item_id")).groupBy("slot").transformWithStateInPandas(Series(most), SERIES, "Update", "None")
    return found.select("source", "item_id", "version", F.transform("points", lambda p: F.struct(F.timestamp_micros(p["us"]).alias("ts"), p["price"].alias("price"))).alias("points"))
