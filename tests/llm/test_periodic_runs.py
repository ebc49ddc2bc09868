"""Runs against all starts and periods, and the query against its contract in plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from bazaarium.llm import periodic_runs as pr
from bazaarium.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(s, least=12):
    """All (start, length, period): for each period, stretches where elements that far apart agree."""
    best = {}
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and j > i:
                best.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in best.items())


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_z_function_equals_comparing(letters):
    rng = np.random.default_rng(letters)
    for n in [*range(0, 30), 100, 500]:
        for s in (rng.integers(0, letters, n), np.resize(rng.integers(0, letters, 1 + n // 7), n)):
            want = [next((k for k in range(n - i) if s[k] != s[i + k]), n - i) for i in range(n)]
            assert pr.z_function(s).tolist() == want


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_equal_all_starts_and_periods(least):
    rng = np.random.default_rng(least)
    for case in range(250):
        n = int(rng.integers(0, 160))
        s = rng.integers(0, int(rng.integers(1, 4)), n)
        if case % 2 and n:
            a, p = int(rng.integers(0, n)), int(rng.integers(1, 20))
            s[a:] = np.resize(s[a : a + p], n - a)
            s[rng.integers(0, n, case % 3)] = 9
        assert pr.find_runs(s, least) == plain_runs(s.tolist(), least)


def test_long_loops_and_one_word():
    rng = np.random.default_rng(3)
    s = np.resize(rng.integers(0, 50, 700), 9000)
    assert pr.find_runs(s) == [(0, 9000, 700)]
    assert pr.find_runs(np.zeros(30000, np.int64)) == [(0, 30000, 1)]
    assert pr.find_runs(np.arange(20000)) == []
    fib = [0]
    while len(fib) < 900:
        fib, last = fib + (last if len(fib) > 1 else [1]), fib
    assert pr.find_runs(np.array(fib[:900])) == plain_runs(fib[:900])


def wanted(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    numbers = {}
    runs = plain_runs([numbers.setdefault(w, len(numbers)) for w in words])
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


def test_query_equals_plain_version(spark, rows):
    got = queries.op11_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [wanted(i, t) for i, t in rows]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(r[1] > 0 for r in want) > 10


def test_odd_rows(edge, empty):
    seed = F.lit(None).cast("long")
    got = pr.described(pr.periodic_runs(pr.looped(edge, seed)))
    assert got.count() == edge.count()
    assert {r.n_runs for r in got.where("doc_id IN (3, 4, 5, 10)").collect()} == {0}
    assert got.where("doc_id = 3").first().collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert pr.periodic_runs(pr.looped(empty, seed)).count() == 0


def test_text_longer_than_a_slice(spark):
    text = " ".join(f"w{i % 50021}" for i in range(700_000))
    assert len(text) > 4 << 20
    got = pr.periodic_runs(spark.createDataFrame([(1, text), (2, "a " * 400_000)], "doc_id long, text string")).collect()
    assert [tuple(r.runs[0]) for r in got] == [(0, 700_000, 50021), (0, 400_000, 1)]
    assert got[1].collapsed == "a"
