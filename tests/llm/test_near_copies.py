"""The pipeline's near-dedup stage against similarity by brute force."""

import random
from itertools import combinations

import numpy as np
import plain

import corpus_pipeline
from bazaarium.llm import near_copies

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = plain.WORD.findall((text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def kept(rows):
    """Rows that stay, comparing all pairs; rows are (id, text), the first of a group by id stays, null last."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in combinations(range(len(rows)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            up[top(a)] = top(b)
    best = {}
    for n, (i, _) in enumerate(rows):
        best[top(n)] = min(best.get(top(n), (True, 0, n)), (i is None, i or 0, n))
    return sorted((rows[n] for _, _, n in best.values()), key=str)


def staying(spark, rows):
    out = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, SCHEMA).coalesce(1), "")
    return sorted(map(tuple, out.collect()), key=str)


def planted(seed=3):
    """Texts with copies in which from one word in 400 to one in 30 is another, so similarities lie around the bound."""
    rng, rows = random.Random(seed), []
    for n in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 80, 200, 400]))]
        rows.append((n, " ".join(words)))
        for k in range(4):
            other = list(words)
            for at in rng.sample(range(len(words)), max(1, len(words) // rng.choice([400, 100, 60, 45, 30]))):
                other[at] = f"x{rng.randrange(5000)}"
            rows.append((100 * (k + 1) + n, " ".join(other)))
    return rows


def test_near_copies_equal_brute_force(spark, rows):
    for table in (rows, planted()):
        want = kept(table)
        assert len(want) < len(table) and staying(spark, table) == want


def test_large_group_and_chains(spark):
    """Copies of one text join by a star; texts that drift are joined though the ends are not similar."""
    rng = random.Random(5)
    base = [f"b{n}" for n in range(120)]
    drift, rows = list(base), [(0, " ".join(base))]
    for n in range(1, 40):
        drift[(n * 3) % 120] = f"d{n}"
        rows.append((n, " ".join(drift)))
    for n in range(100, 300):
        one = [f"c{k}" for k in range(150)]
        one[rng.randrange(150)] = f"o{n}"
        rows.append((n, " ".join(one)))
    assert [i for i, _ in staying(spark, rows)] == [i for i, _ in kept(rows)]


def test_blocks_meet_all_pairs_across():
    import numpy as np

    rng = np.random.default_rng(1)
    n = 60
    nodes, sizes, kinds, fps = np.arange(n), rng.integers(20, 40, n), rng.integers(0, 8, n), np.zeros(n, np.uint64)
    got = {tuple(sorted(p)) for u, v in near_copies._across(nodes, sizes, fps, kinds, 100) for p in zip(u.tolist(), v.tolist(), strict=True)}
    assert got == {(a, b) for a, b in combinations(range(n), 2) if kinds[a] != kinds[b] and 5 * min(sizes[a], sizes[b]) >= 4 * max(sizes[a], sizes[b])}


def test_rows_with_equal_or_null_ids_stay_apart(spark):
    one, two, three = (" ".join(f"{c}{n}" for n in range(40)) for c in "abc")
    table = [(1, one), (None, one), (None, two), (2, one), (2, three), (3, three), (None, two)]
    assert staying(spark, table) == sorted([(1, one), (None, two), (2, three)], key=str)


def test_finer_sketches_pass_all_near_pairs_and_few_others():
    rng = np.random.default_rng(12)

    def passing(common, own):
        sets = [np.unique(rng.integers(0, 1 << 64, common + 2 * own, np.uint64)) for _ in range(150)]
        pairs = [(np.sort(s[rng.permutation(len(s))])[: common + 2 * own], s) for s in sets]
        out = []
        for _, s in pairs:
            mixed = rng.permutation(s)
            a, b = np.sort(mixed[: common + own]), np.sort(np.concatenate([mixed[:common], mixed[common + own :]]))
            fine = np.frombuffer(near_copies.fine_sketch(a) + near_copies.fine_sketch(b), np.uint64).reshape(2, -1)
            out.append(near_copies._fine_fit(fine, np.array([0]), np.array([1]))[0])
        return np.mean(out)

    for n in (18, 180, 900):
        assert passing(8 * n // 2, n // 2) == 1.0  # a similarity of 0.8
    assert passing(300, 100) < 0.02  # 0.6


def test_texts_a_little_less_alike_give_few_candidates(spark, monkeypatch):
    rng = np.random.default_rng(13)
    base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    rows = []
    for i in range(250):
        words = list(base)
        for at in rng.choice(300, 12, replace=False):
            words[at] = f"x{rng.integers(0, 10**9)}"
        rows.append((i, " ".join(words)))
    seen = []
    verified = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *rest: (seen.append(pairs.count()), verified(pairs, *rest))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stays = {r.doc_id for r in near_copies.one_of_each(docs).collect()}
    sets = [near_copies.shingles(near_copies.words_of(t)) for _, t in rows]
    up = list(range(250))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(250):
        for b in range(a):
            if near_copies.similar(sets[a], sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    assert stays == {top(a) for a in range(250)}
    assert sum(seen) < 250 * 249 / 2 / 5


def indexed(spark, rows):
    """Of rows (node, size, kind, print) those that the index of bytes lets meet, and the pairs when all have one sketch."""
    texts = spark.createDataFrame(rows, "node long, size int, kind long, print binary")
    sketched = texts.selectExpr("*", f"cast(repeat('x', {near_copies.FINE // 4}) AS binary) AS sketch")
    met = {r.node for r in near_copies._meeting(texts, False).collect()}
    return met, {(r.u, r.v) for r in near_copies._meeting(sketched, True).collect()}


def test_fingerprints_propose_pairs(spark):
    """Texts meet by two bytes of a fingerprint in place and few enough other bits, whatever else they share."""
    rng = np.random.default_rng(21)
    base = rng.integers(0, 256, 2 * near_copies.HALF, np.uint8)
    two, one, far, few = (base ^ np.uint8(1) for _ in range(4))
    two[[3, 20]] = base[[3, 20]]
    one[[3, 40]] = base[[3, 40]]  # one of each half
    far[:] = ~base
    far[[3, 20]] = base[[3, 20]]
    few[-1] = base[-1]  # the last byte alone
    for other, size, meet in ((two, 100, True), (one, 100, False), (far, 100, False), (few, 100, False), (few, near_copies.FEW, True)):
        for sizes, kinds, fit in (((size, size), (1, 2), True), ((size, size * 2), (1, 2), False), ((size, size), (1, 1), False)):
            rows = [(n, s, k, bytearray(p)) for n, s, k, p in zip((1, 2), sizes, kinds, (base.tobytes(), other.tobytes()), strict=True)]
            assert indexed(spark, rows) == (({1, 2}, {(2, 1)}) if meet and fit else (set(), set()))


def test_fingerprints_of_near_copies_agree_in_enough_bytes():
    """Pairs at a similarity of 0.8 share a list and are within the bounds of bits, of few shingles too."""
    rng = np.random.default_rng(22)
    for common, a, b, need in ((4, 0, 1, 1), (12, 0, 3, 1), (8, 1, 1, 1), (20, 0, 5, 2), (80, 10, 10, 2), (800, 100, 100, 2)):
        for _ in range(400):
            x = rng.integers(0, 1 << 64, common + a + b, np.uint64)
            p, q = (np.frombuffer(near_copies.fingerprint(np.unique(s)), np.uint8).reshape(2, -1) for s in (x[: common + a], np.concatenate([x[:common], x[common + a :]])))
            shared, bits = (p == q).sum(axis=1), np.bitwise_count(p ^ q).sum(axis=1)
            few = need == 1
            assert ((shared >= need) & (bits <= near_copies.MAX_BITS[1][few])).any() and bits.sum() <= near_copies.MAX_BITS[2][few]
