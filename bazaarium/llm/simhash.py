"""SimHash near-dedup with an inverted index of fingerprint bytes by position.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most 4 bytes, so at least 4 of their 8 bytes agree in
place.  The index has a posting list for the bytes at each of a few sets of positions, chosen so that whichever 4
positions agree, one set lies within them: such a pair meets in at least one list.  In a list the shared positional
bytes of each pair are tallied, pairs with the 4 guaranteed matches are retained, and those are verified bit by bit.

Only distinct fingerprints enter the index.  A list gives the links of a spanning forest, not all its pairs: a near pair
of which both ends are reached already adds nothing to the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarium.llm.components import connected_components
from bazaarium.llm.tables import hot_safe_left_join, id_and_text, slices, written

SHINGLE_WORDS, SEED = 4, 42
MAX_BITS = 4
#: Distinct fingerprints from which sets of four positions index them instead of sets of three.
WIDE_FROM = 50_000_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64; 0 for a text without words."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = zip(*(words[i:] for i in range(shingle_words)), strict=False)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in map(b" ".join, shingles)], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = np.array([fingerprint(t, shingle_words) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(make, "doc_id long, fp long")


def position_sets(width: int) -> list[tuple[int, ...]]:
    """Sets of byte positions of which at least one lies within any 4 of the 8 positions.

    Four: all sets of four.  Three: the 20 of Turan's covering, positions dealt into three classes in a ring, a set is
    within a class or has two of one class and one of the next.
    """
    if width == 4:
        return list(combinations(range(8), 4))
    kind = [0, 0, 0, 1, 1, 1, 2, 2]

    def chosen(s: tuple[int, ...]) -> bool:
        k = [kind[p] for p in s]
        return len(set(k)) == 1 or any(k.count(c) == 2 and k.count((c + 1) % 3) == 1 for c in range(3))

    return [s for s in combinations(range(8), 3) if chosen(s)]


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether fingerprints link: enough shared positional bytes, then few enough differing bits."""
    differ = np.bitwise_xor(a, b)
    tally = 8 - np.count_nonzero(differ[..., None].view(np.uint8), axis=-1)
    out = tally >= 8 - MAX_BITS
    out[out] = np.bitwise_count(differ[out]) <= MAX_BITS
    return out


def forest(fps: np.ndarray, step: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of one posting list, as arrays of positions.

    Breadth first: the nodes reached last are compared with the nodes not reached yet, in blocks.
    """
    left = np.arange(len(fps))
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            block, front = front[: max(1, step // len(left))], front[max(1, step // len(left)) :]
            hit = near(fps[block][:, None], fps[left][None, :])
            reached = hit.any(axis=0)
            if reached.any():
                to = left[reached]
                yield block[hit[:, reached].argmax(axis=0)], to
                front, left = np.concatenate([front, to]), left[~reached]


def links(distinct: DataFrame, width: int) -> DataFrame:
    """(u, v) of near fingerprints, enough of them to join all that are linked; ``distinct.fp`` has no repeats."""
    sets = position_sets(width)

    def key(number: int, positions: tuple[int, ...]) -> F.Column:
        # Bytes at the positions, with the number of the set above them.
        parts = [F.shiftleft(F.shiftright("fp", 8 * p).bitwiseAND(255), 8 * i) for i, p in enumerate(positions)]
        out = F.lit(number << 8 * width)
        for p in parts:
            out = out.bitwiseOR(p)
        return out

    postings = distinct.select("fp", F.explode(F.array(*[key(n, s) for n, s in enumerate(sets)])).alias("key"))
    lists = postings.repartition("key").sortWithinPartitions("key")

    def out(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    def settle(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        sizes = np.diff(starts, append=len(keys))
        two = starts[sizes == 2]
        u, v = fps[two], fps[two + 1]
        hit = near(u, v)
        if hit.any():
            yield out(u[hit], v[hit])
        more = sizes > 2
        for at, n in zip(starts[more].tolist(), sizes[more].tolist(), strict=True):
            own = fps[at : at + n]
            for a, b in forest(own):
                yield out(own[a], own[b])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            # A list may go on in the next batch: its part waits.
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or (held and held[-1][0][-1] != keys[0]):
                held.append((keys[:cut], fps[:cut]))
                yield from settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            held.append((keys[cut:], fps[cut:]))
        if held:
            yield from settle(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return lists.select("key", "fp").mapInArrow(scan, "u long, v long")


def near_groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Fingerprints of 16 lowercase hex digits link at MAX_BITS or fewer differing bits; ``component_id`` is the smallest
    doc_id reachable, itself included, and null only where all ids reachable are null.  A null text is empty and has
    fingerprint zero, linked like any other.  Rows that repeat keep a row each; other columns are not read.
    """
    prints = written(fingerprints(docs, shingle_words), "fingerprints")
    rows = prints.count()
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    width = 3 if distinct.count() < WIDE_FROM else 4
    found = connected_components(links(distinct.select("fp"), width))
    linked = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").where("n > 1 OR component IS NOT NULL")
    labels = linked.withColumn("component", F.coalesce("component", "fp"))
    least = labels.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = written(labels.join(least, "component").select("fp", "component_id", "n"), "components")
    joined = hot_safe_left_join(prints, ids, ["fp"], "n", rows)
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
