"""What a search keeps of its offers, and how they come to it."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from bazaarium.streaming import stateful


@pytest.mark.parametrize("weight", [-0.4, 0.3, 0.0])
def test_contenders_hold_the_best_whatever_mean_and_spread(weight):
    rng = np.random.default_rng(4)
    n = 3000
    offers = pd.DataFrame({"pos": [f"{p:05d}" for p in rng.permutation(n)], "source": "wb", "price": rng.integers(1, 400, n).astype(float), "worth": rng.integers(0, 40, n) / 64})
    left = stateful.contenders(offers, 10, weight)
    assert len(left) < 300
    for mean, spread in ((200, 115), (3, 0.5), (5000, 4000)):
        best = lambda rows: sorted(zip((-(weight * (rows["price"] - mean) / spread + rows["worth"])).tolist(), rows["pos"]))[:10]  # noqa: E731, B023
        assert best(left) == best(offers)
    parts = None
    for at in range(0, n, 700):
        parts = stateful.contenders(pd.concat([parts, offers[at : at + 700]]), 10, weight)
    assert sorted(parts["pos"]) == sorted(left["pos"])


def test_offers_come_packed_in_their_order():
    rows = [(q, "offer", s, None, 60 + n // 400, 1_000_000 * (60 + n // 400) + n, str(n), float(n) if n % 5 else None, 0.5) for n in range(500) for q, s in [(("a", None)[n % 2], ("wb", "ozon")[n // 2 % 2])]]
    batch = pa.RecordBatch.from_pylist([dict(zip(("query_id", "kind", "source", "error", "second", "us", "pos", "price", "worth"), r, strict=True)) for r in rows])
    batch = batch.set_column(3, "error", pa.array([None] * 500, pa.string()))
    found = [r for b in stateful._pack(iter([batch.slice(0, 200), batch.slice(200)])) for r in b.to_pylist()]
    assert len(found) == 8 and max(len(r["pos"]) for r in found) == stateful.PACKED
    got = [(r["query_id"], r["kind"], r["source"], p, x, w) for r in found for p, x, w in zip(r["pos"], r["price"], r["worth"], strict=True)]
    key = lambda r: int(r[3])
    assert sorted(got, key=key) == [(r[0], r[1], r[2], r[6], r[7], r[8]) for r in rows]
    for r in found:
        us = [rows[int(p)][5] for p in r["pos"]]
        assert us == sorted(us) and r["event_ms"] == us[0] // 1000 and r["fetched_at"].timestamp() * 1e6 == us[-1]
