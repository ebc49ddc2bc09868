"""Ids against the library, the plan against bounds, other packers and all configurations, and the query against its contract."""

import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from tokenizers import Tokenizer

from bazaarium.llm import packing, queries
from bazaarium.llm.word_bpe import WordBpe


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(queries.WORD_BPE))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(tokenizer, rows):
    bpe = WordBpe(queries.vocabulary(queries.WORD_BPE))
    assert bpe.by_words
    odd = ["", " ", "Don't WE'LL 'tis x'S", "é É  ́x", "İstanbul ΣΑΣ Σ ǅ ﬁ", "a b c\x85d\x1ce\x1ff", "x<|endoftext|>y < |endoftext|>", "漢字🙂 ½ ² 12345", "a­b\x7f\x00c", " ̸= ≠ Å Ω K", "=" * 5000, "ß ẞ ŉ", "A\u030a I\u0307 I\u0307\u0301 K\u0327. O\u0308\u0304! S\u0323\u0307, E\u0301", "Word. WORD! word, word.. \"word.\" it'S. ªº. µ. x² 5. a.b."]
    for text in odd + [t or "" for _, t in rows]:
        assert np.frombuffer(bpe.encode(text.encode()), "<u2").tolist() == ids_of(tokenizer, text), text


def first_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        at = next((i for i, b in enumerate(bins) if b + x <= capacity), None)
        if at is None:
            bins.append(x)
        else:
            bins[at] += x
    return len(bins)


def sound(counts, bins):
    got = Counter()
    for config, n in bins:
        assert n > 0 and sum(config) < len(counts)
        for length in config:
            got[length] += n
    assert dict(got) == {int(x): int(counts[x]) for x in np.flatnonzero(counts)}
    return sum(n for _, n in bins)


def shapes():
    rng = np.random.default_rng(5)
    yield rng.integers(1, 2049, 500)
    yield np.clip(rng.lognormal(6, 1, 5000).astype(int), 1, 2048)
    yield rng.integers(500, 900, 3000)
    yield np.full(1000, 700)
    yield np.full(77, 2048)
    yield np.array([1])


@pytest.mark.parametrize("lengths", list(shapes()), ids=lambda x: f"{len(x)}-{x.max()}")
def test_plan_places_all_in_no_more_sequences_than_first_fit(lengths):
    counts = np.bincount(lengths, minlength=2049)
    n = sound(counts, packing.plan(counts))
    assert n >= -(-lengths.sum() // 2048)
    assert n <= 1.003 * first_fit(lengths.tolist(), 2048) + 1
    assert packing.plan(counts) == packing.plan(counts)


def test_plan_is_best_on_small_cases():
    @cache
    def fewest(items, capacity):
        if not items:
            return 0
        first, rest = items[0], items[1:]
        best = len(items)
        for mask in range(1 << len(rest)):
            if first + sum(x for i, x in enumerate(rest) if mask >> i & 1) <= capacity:
                best = min(best, 1 + fewest(tuple(x for i, x in enumerate(rest) if not mask >> i & 1), capacity))
        return best

    rng = np.random.default_rng(8)
    worse = 0
    for _ in range(40):
        items = rng.integers(1, 25, rng.integers(1, 9))
        counts = np.bincount(items, minlength=31)
        worse += sound(counts, packing.plan(counts)) - fewest(tuple(sorted(items.tolist(), reverse=True)), 30)
    assert worse <= 1


def test_knapsack_equals_all_multisets():
    rng = np.random.default_rng(2)
    for _ in range(20):
        prices = np.where(rng.random(13) < 0.5, rng.random(13), -1.0)
        want = [0.0]
        for c in range(1, 13):
            want.append(max([want[c - 1], *(prices[x] + want[c - x] for x in range(1, c + 1) if prices[x] > 0)]))
        np.testing.assert_allclose(packing.knapsack(prices), want)


def test_fractions_leave_no_length_behind():
    rng = np.random.default_rng(4)
    lengths = rng.lognormal(6, 0.8, 50000).astype(int)
    lengths = lengths[(lengths > 20) & (lengths < 2048)]
    counts = np.bincount(lengths, minlength=2049)
    use, prices = packing.solve(counts, rng)
    covered = np.zeros(2049)
    for config, share in use.items():
        np.add.at(covered, list(config), share)
    ratio = covered[counts > 0] / counts[counts > 0]
    assert np.percentile(ratio, 1) > 0.6 * np.median(ratio)
    assert prices[counts > 0].min() > 0


def checked(got, docs, tokenizer):
    """Every piece as the contract says, every sequence without gap or overlap; the number of sequences."""
    want = Counter()
    for doc_id, text in docs:
        ids = [*ids_of(tokenizer, text), 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want[doc_id, n, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(held)


def test_query_equals_the_contract(spark, rows, tokenizer):
    got = queries.op12_packing(spark, SF).collect()
    n = checked(got, rows, tokenizer)
    assert n <= first_fit([r.length for r in got], 2048)


def test_sequences_hold_the_ids_of_their_pieces(docs):
    placed = packing.packed(packing.pieces(docs, queries.vocabulary(queries.WORD_BPE)))
    whole = {r.sequence_id: (r.length, bytes(r.ids)) for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        length, ids = whole[r.sequence_id]
        assert len(ids) == 4 * length and ids[4 * r.offset :].startswith(bytes(r.ids))


def test_odd_rows(edge, empty, tokenizer):
    file = queries.vocabulary(queries.WORD_BPE)
    from pyspark.sql import functions as F

    cut = packing.pieces(edge, file).withColumn("ids_crc32", F.crc32("ids"))
    checked(packing.packed(cut).collect(), [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()], tokenizer)
    assert packing.packed(packing.pieces(empty, file)).count() == 0


def test_long_text_is_cut(spark, tokenizer):
    text = "many words of a long text, " * 180_000
    assert len(text) > 4 << 20
    got = packing.packed(packing.pieces(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), queries.vocabulary(queries.WORD_BPE))).collect()
    assert sum(r.length for r in got) == len(ids_of(tokenizer, text)) + 2
    assert len({r.sequence_id for r in got}) == -(-sum(r.length for r in got) // 2048)
