"""Packing pieces of documents into as few sequences of a fixed length as it can, by a configuration linear program.

A configuration is a multiset of lengths that fits into a sequence.  The program asks how often to use each so that
every length of the histogram is covered and the sum is least.  Multiplicative weights solve it: lengths covered less
weigh more, a knapsack by dynamic programming over the capacity prices them, and many configurations that are priced
nearly best share each step, which keeps steps even.  The fractions are rounded by taking configurations, most used
first, as often as whole pieces allow; what is left is solved again while that helps, and the last pieces go by best
fit or by their prices.  All that depends on the histogram alone, which has at most ``capacity`` rows whatever the corpus, and is done on
the driver; the size of the plan is bounded by the steps (``ROUNDS``, ``SAMPLES``, ``REPEATS``).

Pieces then find their places without a shuffle by length: each partition numbers its pieces of a length, sums over the
partitions before give numbers over the corpus, and the plan, sent to all tasks, maps numbers of a length to sequences.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarium.llm.tables import id_and_text, slices, written
from bazaarium.llm.word_bpe import opened

#: Steps of the weights in a solution, configurations that share a step, and how often what is left is solved again.
ROUNDS, SAMPLES, REPEATS = 60, 400, 6
#: A configuration takes part in a step if its price is within this share of the best.
NEAR = 0.002
#: Coverage is measured by the length that is covered most, among lengths with this share of the tokens.
MOST = 0.998
#: Shares of its pieces that a pass of rounding places before fractions below 1 are no longer rounded up.
UP = (0.0, 0.5)
#: How sharply weights fall with coverage, and the most that a step adds to the coverage of a length.
SHARPNESS, STEP = 3.0, 1 / 50
#: Sequences filled in the last pass before the knapsack is computed again.
AGAIN = 32
#: Pieces of a length are numbered below this.
_NUMBERS = 1 << 48

Plan = list[tuple[tuple[int, ...], int]]


def knapsack(prices: np.ndarray) -> np.ndarray:
    """The best price of a multiset of lengths with a sum of at most c, for each c; ``prices[l]`` below 0: no such length."""
    best = np.zeros(len(prices))
    for c in range(1, len(prices)):
        best[c] = max(best[c - 1], (prices[1 : c + 1] + best[c - 1 :: -1]).max())
    return best


def _filled(first: int, prices: np.ndarray, best: np.ndarray, counts: np.ndarray, rng: np.random.Generator | None = None) -> tuple[int, ...]:
    """A configuration with the length ``first``, filled up from the counted pieces: at random among nearly best ways, or, without ``rng``, in the best way."""
    out, space = [first], len(prices) - 1 - first
    while space > 0 and best[space] > 0:
        worth = prices[1 : space + 1] + best[space - 1 :: -1]
        for used in set(out):
            if used <= space and out.count(used) >= counts[used]:
                worth[used - 1] = -1.0
        worth[prices[1 : space + 1] < 0] = -1.0
        at = int(worth.argmax())
        if worth[at] < 0:
            break
        if rng is not None:
            ways = np.flatnonzero(worth >= (1 - NEAR) * best[space])
            at = int(ways[rng.integers(len(ways))]) if len(ways) else at
        out.append(at + 1)
        space -= out[-1]
    return tuple(sorted(out, reverse=True))


def _most(ratios: np.ndarray, tokens: np.ndarray) -> float:
    """The ratio that lengths with MOST of all tokens covered do not exceed; a few short lengths are in nearly every configuration."""
    ratios, tokens = ratios[ratios > 0], tokens[ratios > 0]
    order = np.argsort(ratios)
    return float(ratios[order][np.searchsorted(np.cumsum(tokens[order]), MOST * tokens.sum())])


def solve(counts: np.ndarray, rng: np.random.Generator) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """How often to use each configuration so that lengths are covered, in fractions, and prices, by multiplicative weights.

    ``counts[l]`` pieces have length l; the capacity is its last index.  Weights begin as the tokens of a length, the
    prices of a program in which only the sum of tokens counts.
    """
    lengths = np.flatnonzero(counts)
    tokens = lengths * counts[lengths]
    use: dict[tuple[int, ...], float] = defaultdict(float)
    covered, mean = np.zeros(len(counts)), np.zeros(len(counts))
    for _ in range(ROUNDS):
        prices = np.full(len(counts), -1.0)
        prices[lengths] = lengths * np.exp(-SHARPNESS * (covered[lengths] - covered[lengths].min()))
        best = knapsack(prices)
        mean += prices / best[-1]
        tight = lengths[prices[lengths] + best[len(counts) - 1 - lengths] >= (1 - NEAR) * best[-1]]
        drawn = tight if len(tight) <= SAMPLES else rng.choice(tight, SAMPLES, replace=False, p=counts[tight] / counts[tight].sum())
        step, gained = defaultdict(float), np.zeros(len(counts))
        for length in drawn.tolist():
            config = _filled(length, prices, best, counts, rng)
            share = counts[length] / config.count(length)
            step[config] += share
            np.add.at(gained, list(config), share)
        scale = STEP / _most(gained[lengths] / counts[lengths], tokens)
        for config, share in step.items():
            use[config] += scale * share
        covered[lengths] += scale * gained[lengths] / counts[lengths]
    level = _most(covered[lengths], tokens)

    return {config: share / level for config, share in use.items()}, mean / ROUNDS


def best_fit(counts: np.ndarray, bins: Plan) -> Plan:
    """Put the counted pieces, longest first, into the fullest of ``bins`` that take them, or into new ones."""
    capacity = len(counts) - 1
    by_space: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)

    def add(config: tuple[int, ...], n: int) -> None:
        group = by_space[capacity - sum(config)]
        group[config] = group.get(config, 0) + n

    for config, n in bins:
        add(config, n)
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            space = min((s for s, group in by_space.items() if s >= length and group), default=None)
            if space is None:
                each = min(left, capacity // length)
                n = left // each
                add((length,) * each, n)
                left -= n * each
                continue
            config, n = by_space[space].popitem()
            each = min(left, space // length)
            taken = min(n, left // each)
            add((*config, *(length,) * each), taken)
            if n > taken:
                by_space[space][config] = n - taken
            left -= taken * each
    return [(config, n) for group in by_space.values() for config, n in group.items()]


def _dive(counts: np.ndarray, prices: np.ndarray, bins: dict[tuple[int, ...], int]) -> None:
    """Take the longest piece left and fill its sequence in the way that is worth most, until all are placed."""
    left, prices, turn = counts, prices.copy(), 0
    while len(lengths := np.flatnonzero(left)):
        if turn % AGAIN == 0:
            prices[left == 0] = -1.0
            best = knapsack(prices)
        turn += 1
        config = _filled(int(lengths[-1]), np.where(left > 0, prices, -1.0), best, left)
        kinds, each = np.unique(config, return_counts=True)
        n = int((left[kinds] // each).min())
        left[kinds] -= n * each
        bins[config] += n


def _size(bins: Plan) -> int:
    return sum(n for _, n in bins)


def _rounded(counts: np.ndarray, seed: int, up: float) -> Plan:
    """Whole numbers of configurations for all counted pieces; each pass rounds fractions below 1 up until it has placed the share ``up`` of its pieces.

    What is left goes by best fit, or by worth from the longest on, whichever takes fewer sequences.
    """
    rng, left = np.random.default_rng(seed), counts.astype(np.int64)
    bins: dict[tuple[int, ...], int] = defaultdict(int)
    prices = np.arange(len(left), dtype=float)
    for _ in range(REPEATS):
        before = left.sum()
        if before == 0:
            break
        use, prices = solve(left, rng)
        for config, share in sorted(use.items(), key=lambda x: (-x[1], x[0])):
            if share < 1 and left.sum() <= before * (1 - up):
                break
            lengths, each = np.unique(config, return_counts=True)
            n = int(min(max(share, up > 0), (left[lengths] // each).min()))
            left[lengths] -= n * each
            bins[config] += n
        if left.sum() > 0.9 * before:
            break
    fitted = best_fit(left, [(config, n) for config, n in bins.items() if n])
    _dive(left, prices, bins)
    return min(fitted, [(config, n) for config, n in bins.items() if n], key=_size)


def plan(counts: np.ndarray, seed: int = 42) -> Plan:
    """Configurations and how many sequences take each: all counted pieces, none more.  The same for the same counts.

    The fractions are rounded in each of the ways in ``UP``; the one with fewest sequences stays.
    """
    return min((_rounded(counts, seed, up) for up in UP), key=_size)


def pieces(docs: DataFrame, tokenizer: bytes, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids): the ids of each text and ``end_id``, cut where they exceed ``capacity``.

    ``ids`` are little-endian unsigned 32-bit integers.  A null text is empty and has the end id alone; rows that repeat are
    kept; an empty table has no pieces.
    """
    file = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(file.value)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for part in slices(batch):
                rows: list[tuple] = []
                for doc_id, raw in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    ids = np.concatenate([np.frombuffer(bpe.encode(raw), f"<u{2 if bpe.code == 'H' else 4}").astype("<u4"), end])
                    rows += [(doc_id, n, at, min(capacity, len(ids) - at), ids[at : at + capacity].tobytes()) for n, at in enumerate(range(0, len(ids), capacity))]
                bpe.packed.trim()
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return id_and_text(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def _numbered(items: DataFrame, capacity: int) -> DataFrame:
    """Add ``_part`` and ``_rank``: the number of a row among those of its length in its partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            order = np.argsort(lengths, kind="stable")
            kinds, first, n = np.unique(lengths[order], return_index=True, return_counts=True)
            rank = np.empty(len(lengths), np.int64)
            rank[order] = np.arange(len(lengths)) - np.repeat(first, n) + np.repeat(seen[kinds], n)
            seen[kinds] += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), part, np.int32)), pa.array(rank)], [*batch.schema.names, "_part", "_rank"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return items.mapInArrow(count, f"{fields}, _part int, _rank long")


def packed(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``: where each row goes, ``length`` (1 to ``capacity``) being its size.

    Offsets within a sequence have no gaps and begin at 0; sequences are numbered from 0.  An empty table gives an empty
    one.  Rows are written once to the shared folder, so that numbers within partitions stay as they are.
    """
    spark, columns = items.sparkSession, items.columns
    stored = written(_numbered(items, capacity), "pieces")
    histogram = stored.groupBy("_part", "length").count()
    counts = np.zeros(capacity + 1, np.int64)
    for row in histogram.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    slots, sequence, used = [], 0, np.zeros(capacity + 1, np.int64)
    for config, n in plan(counts):
        offset = 0
        for length in config:
            slots.append((length * _NUMBERS + int(used[length]), sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    places = spark.sparkContext.broadcast(np.array(sorted(slots), np.int64).reshape(-1, 3))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, base, offsets = places.value.T
        for batch in batches:
            number = (batch.column("_rank").to_numpy() + batch.column("_before").to_numpy()) + batch.column("length").to_numpy() * _NUMBERS
            at = np.searchsorted(begins, number, "right") - 1
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(base[at] + number - begins[at]), pa.array(offsets[at])], [*columns, "sequence_id", "offset"])

    # One row for each partition and length; a window holds as many rows as there are partitions.
    before = F.sum("count").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    joined = stored.join(histogram.select("_part", "length", F.coalesce(before, F.lit(0)).alias("_before")), ["_part", "length"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return joined.select(*columns, "_rank", "_before").mapInArrow(place, f"{fields}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of packed pieces that still have their ids: a group holds one sequence."""
    part = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(part, F.lit(b"").cast("binary"), lambda got, p: F.concat(got, p["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), ids.alias("ids"))
