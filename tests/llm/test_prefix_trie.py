"""The trie against one built node by node from dictionaries."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from bazaarium.llm import prefix_trie, queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows, shared, base):
    """{conv_id: [(role, text)]} from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    digest = lambda r: hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}:{r[3] or ''}".encode()).hexdigest()
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, digest(r))):
        own[r[0]].append((r[2] or "", r[3] or ""))
    return {c: own.get(base(c), [])[: shared(c)] + own[c][shared(c) :] for c in list(own)}


def plain_trie(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in children[node])
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(paths[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=key) == sorted(want, key=key)


def contract(rows):
    return plain_trie(rebuilt(rows, lambda c: zlib.crc32(str(c).encode()) % 6, lambda c: c - c % 100))


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_equals_the_contract(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_prefix_trie(spark, sf)
    assert got.columns == COLUMNS
    same(got, contract(rows))


SCHEMA = "conv_id long, turn long, role string, text string"


def test_many_alike_turnless_and_long_conversations(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = []
    for c in [*range(5, 300), 900, 950, 1201]:  # some without a conversation to open with
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t if t else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "b🙂", "", None])))
    rows += [(150, t, "user", f"turn {t % 7}") for t in range(10, 700)]
    rows += [(c, 1, "user", "hello") for c in range(2000, 2600)]
    rows += [(None, 1, "user", "nobody's")]
    spark.createDataFrame(rows, SCHEMA).withColumn("k1", F.lit(1)).withColumn("place", F.lit("x")).write.parquet(str(tmp_path / "conversations.parquet"))
    same(queries.op13_prefix_trie(spark, str(tmp_path)), contract(rows))


def test_conversations_as_they_are(spark):
    rows = [(1, 1, "u", "hi"), (1, 2, "a", "yes"), (2, 1, "u", "hi"), (3, 1, "u", "hi"), (3, 2, "a", "no"), (4, 1, "uh", "i"), (4, 1, "u", "hi"), (5, 1, None, None), (-7, 3, "u", "hi")]
    paths = rebuilt(rows, lambda c: 0, lambda c: c)
    same(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)), plain_trie(paths))


def test_ends_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 50)
    rows = [(c, 1, "u", "hi") for c in range(3000)]
    same(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(7)), plain_trie(rebuilt(rows, lambda c: 0, lambda c: c)))


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
