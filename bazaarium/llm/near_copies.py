"""Near copies by the similarity of their words, for the pipeline; op2 keeps its own contract.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more.  At that
similarity a SimHash bit differs with odds of some 0.15 and a byte agrees with odds of 0.27, so no few bytes of a 64-bit
fingerprint are sure to agree, but of a wider one enough are.  Fingerprints here have two halves of HALF bytes.  An inverted
index has a posting list for each value of the byte at each position; a pair that shares two bytes of a half (one, if both
texts have few shingles) is counted in, its bits are compared, and shingle sets are then compared exactly.  A pair at 0.8
shares fewer in both halves with odds below 1.5 in 100,000 whatever the sizes, a more similar one more rarely still.

The position of the last byte of a half needs no list, as a pair that shares two has one before it.  In a list, texts are
dealt by the bytes at later positions, so that only those with two bytes in common and sizes near enough meet.

Before that, texts with the same four bytes in a row are compared with one in the middle; only what that leaves in different
groups is compared pairwise, so a large group of copies costs links in proportion to its size.  Many texts that are all a
little less alike than asked meet but have no link, so texts that meet any get a finer sketch before they are compared, go
to more such stars and only then meet in pairs: two bits of each of FINE minima, of which a pair at 0.8 differs in some 77,
8 more or less; MOST_FINE is five of those away, and at 0.6 one pair in some thousands passes.  The sketch rules out, it
proposes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarium.llm.components import connected_components
from bazaarium.llm.simhash import _LOWER
from bazaarium.llm.tables import bitmap, flagged, hot_safe_left_join, numbered, slices, small_batches, tidy, written

SHINGLE_WORDS, SEED = 5, 42
#: Similarity as a fraction of whole numbers, so that the bound itself is met exactly.
NEAR, OF = 4, 5
#: Bytes of each half of a fingerprint; four in a row make a key of their own, so HALF is a multiple of four.
HALF = 28
#: Texts with up to FEW shingles meet by one byte: of 4 and 5 shingles a bit differs with odds of 0.19, of 12 and 15 with 0.16.
FEW = 15
#: Bits that may differ in one half and in both, and between texts with few shingles: five deviations above a pair at 0.8.
MAX_BITS = {1: (62, 72), 2: (108, 125)}
#: Groups with as many texts in some lists are not paired within themselves.
MANY = 64
_RNG = np.random.default_rng(SEED)
_ADD = _RNG.integers(0, 1 << 64, 2 * HALF // 8, np.uint64)


#: Minima of the finer sketch, 32 of which fill a word of 64 bits, and the most that may differ.
FINE, MOST_FINE = 512, 117
_FINE_XOR = _RNG.integers(0, 1 << 64, FINE, np.uint64)
_FINE_TIMES = _RNG.integers(0, 1 << 64, FINE, np.uint64) | np.uint64(1)
_LOW_BITS = np.uint64(0x5555555555555555)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_LOWER).split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles; of fewer words than a shingle has, all together; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    runs = zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False) if len(words) >= SHINGLE_WORDS else [words]
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, runs)], np.uint64))


def fingerprint(found: np.ndarray) -> bytes:
    """SimHash of a set of shingles that is not empty: a bit is 1 if it is in over half of them; a tie is the first one's bit."""
    counts, first = np.zeros(16 * HALF, np.int64), None
    for at in range(0, len(found), 1 << 11):
        # Splitmix64: as many words of a shingle's hash as the fingerprint has.
        z = found[at : at + (1 << 11), None] + _ADD
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((z ^ z >> np.uint64(31)).view(np.uint8), axis=1)
        first = bits[0] if first is None else first
        counts += bits.sum(axis=0, dtype=np.uint16)
    return np.packbits(counts * 2 + first > len(found)).tobytes()


def fine_sketch(found: np.ndarray) -> bytes:
    """Two bits of each of FINE minima over a set of shingles that is not empty."""
    least = np.full(FINE, ~np.uint64(0))
    for at in range(0, len(found), 1 << 9):
        np.minimum(least, ((found[at : at + (1 << 9), None] ^ _FINE_XOR) * _FINE_TIMES).min(axis=0), out=least)
    # The bits in the middle of a product by an odd number depend on all below them.
    two = (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(62)).reshape(-1, 32) << np.arange(0, 64, 2, dtype=np.uint64)
    return np.bitwise_or.reduce(two, axis=1).tobytes()


def _fine_fit(fine: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs of positions may be near copies, by their finer sketches."""
    differ = fine[a] ^ fine[b]
    return np.bitwise_count((differ | differ >> np.uint64(1)) & _LOW_BITS).sum(axis=1, dtype=np.int64) <= MOST_FINE


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles are near copies."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * OF >= NEAR * (len(a) + len(b) - common)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias("text")


def _prints(placed: DataFrame, the_id: str, the_text: str) -> DataFrame:
    """(row, doc_id, node, size, print) of every row; ``node`` is a hash of the words, equal texts share it."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                nodes, sizes, prints = [], [], []
                for text in part.column("text").to_pylist():
                    words = words_of(text)
                    found = shingles(words)
                    nodes.append(xxhash.xxh64_intdigest(b" ".join(words), SEED + 1))
                    sizes.append(len(found))
                    prints.append(fingerprint(found) if len(found) else None)
                signed = pa.array(np.array(nodes, np.uint64).view(np.int64))
                columns = [part.column("row"), part.column("doc_id"), signed, pa.array(sizes, pa.int32()), pa.array(prints, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "node", "size", "print"])

    read = placed.select(F.col("_row").alias("row"), F.col(the_id).cast("long").alias("doc_id"), _text(the_text))
    return read.mapInArrow(tidy(make), "row long, doc_id long, node long, size int, print binary")


def _fit(sizes: np.ndarray, fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs of positions may be near copies, by the bits of their fingerprints."""
    differ = np.bitwise_count(fps[a] ^ fps[b])
    most, few = MAX_BITS[2 if fps[:1].nbytes == 2 * HALF else 1]
    return differ.sum(axis=tuple(range(1, differ.ndim)), dtype=np.int64) <= np.where(np.maximum(sizes[a], sizes[b]) <= FEW, few, most)


def _windows(place: np.ndarray, sizes: np.ndarray, own: np.ndarray, other: np.ndarray | None, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ``own`` with ``other``, or among themselves, in blocks: those of one list and of sizes near enough.

    ``place`` is the list's number above the size, and both sides are in its order.
    """
    partners, base, least = own if other is None else other, place[own] - sizes[own], -(-sizes[own] * NEAR // OF)
    starts = np.arange(1, len(own) + 1) if other is None else np.searchsorted(place[partners], base + least, "left")
    lengths = np.searchsorted(place[partners], base + sizes[own] * OF // NEAR, "right") - starts
    before = np.append(0, np.cumsum(lengths))
    at = 0
    while at < len(own):
        upto = max(at + 1, int(np.searchsorted(before, before[at] + step, "right")) - 1)
        a = np.repeat(np.arange(at, upto), lengths[at:upto])
        if len(a):
            b = np.arange(len(a)) + np.repeat(starts[at:upto] - (before[at:upto] - before[at]), lengths[at:upto])
            yield own[a], partners[b]
        at = upto


def _across(nodes: np.ndarray, sizes: np.ndarray, fps: np.ndarray, kinds: np.ndarray, step: int = 1 << 16, lists: np.ndarray | None = None, fine: np.ndarray | None = None, last: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of different groups, in blocks; with ``lists`` only those of the same list, of which ``last`` has the last word."""
    place = sizes if lists is None else (lists << 32) + sizes
    rest = np.argsort(place, kind="stable")
    sides = []
    if len(kinds) >= MANY:
        names, counts = np.unique(kinds, return_counts=True)
        for name in names[counts >= MANY]:
            its = kinds[rest] == name
            own, rest = rest[its], rest[~its]
            sides.append((own, rest))
    for own, other in [*sides, (rest, None)]:
        for a, b in _windows(place, sizes, own, other, step):
            differ = kinds[a] != kinds[b]
            a, b = a[differ], b[differ]
            fit = _fit(sizes, fps, a, b)
            a, b = a[fit], b[fit]
            if fine is not None:
                fit = _fine_fit(fine, a, b)
                a, b = a[fit], b[fit]
            if last is not None and len(a):
                fit = last(a, b)
                a, b = a[fit], b[fit]
            if len(a):
                yield nodes[a], nodes[b]


def _settled(postings: DataFrame, settle: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows that ``settle`` makes of batches with whole lists of ``postings`` (key and others)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = batch.column("key").to_numpy()
            # A list may go on in the next batch: its part waits.
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or (held and held[-1].column("key")[0].as_py() != keys[0]):
                yield from settle([*held, batch.slice(0, cut)] if cut else held)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from settle(held)

    return postings.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(scan), schema).distinct()


def _values(held: list[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    return [np.concatenate([b.column(c).to_numpy() for b in held]) for c in names]


def _bytes(held: list[pa.RecordBatch], name: str) -> np.ndarray:
    """A row of bytes for each value of a binary column, all of one length."""
    found = [x for b in held for x in b.column(name).to_pylist()]
    return np.frombuffer(b"".join(found), np.uint8).reshape(len(found), -1)


def _starred(texts: DataFrame, every: int, fine: bool) -> DataFrame:
    """(u, v), u > v, without repeats: texts with the one of middle size among those with the same four bytes in a row.

    Rows of ``every`` bytes begin a key.  Of ``texts`` (node, size, kind, print; sketch, if ``fine``) only those of another
    group than the one in the middle are linked to it.
    """
    own = ["node", "size", "kind", *["sketch"] * fine]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            fours = np.lib.stride_tricks.sliding_window_view(_bytes([batch], "print"), 4, axis=1)[:, ::every].copy().view("<u4")
            for at, column in enumerate(fours[:, :, 0].T):
                yield pa.RecordBatch.from_arrays([pa.array(column.astype(np.int64) + (at << 32)), *[batch.column(c) for c in own]], ["key", *own])

    def settle(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, sizes, kinds = _values(held, "key", "node", "size", "kind")
        order = np.lexsort((nodes, sizes, keys))
        keys, nodes, sizes, kinds = keys[order], nodes[order], sizes[order].astype(np.int64), kinds[order]
        starts = np.flatnonzero(np.diff(keys, prepend=~keys[0]))
        counts = np.diff(starts, append=len(keys))
        hubs, rest = np.repeat(starts + counts // 2, counts), np.arange(len(keys))
        small, large = np.minimum(sizes, sizes[hubs]), np.maximum(sizes, sizes[hubs])
        fit = (kinds != kinds[hubs]) & (small * OF >= NEAR * large)
        hubs, rest = hubs[fit], rest[fit]
        if fine:
            fit = _fine_fit(_bytes(held, "sketch").view(np.uint64)[order], hubs, rest)
            hubs, rest = hubs[fit], rest[fit]
        u, v = nodes[hubs], nodes[rest]
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    schema = "key long, node long, size int, kind long" + ", sketch binary" * fine
    postings = texts.where("size > 0").select(*own, "print").mapInArrow(tidy(post), schema)
    return _settled(postings, settle, "u long, v long")


def _meeting(texts: DataFrame, fine: bool) -> DataFrame:
    """Of ``texts`` (node, size, kind, print; sketch, if ``fine``) those that meet one of another group in the index of bytes.

    (node) of texts that meet any by one half alone or, with finer sketches, the pairs (u, v), u > v; without repeats.
    """
    own = ["node", "size", "kind", *["sketch", "print"] * fine]
    schema = "key int, node long, size int, kind long" + (", sketch binary, print binary" if fine else ", half binary")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            prints = _bytes([batch], "print")
            few = pa.array(batch.column("size").to_numpy() <= FEW)
            for half in (0, HALF):
                mine = [] if fine else [pa.array([x.tobytes() for x in prints[:, half : half + HALF]], pa.binary())]
                for at in range(half, half + HALF):
                    keys = pa.array((at << 8) + prints[:, at].astype(np.int32))
                    out = pa.RecordBatch.from_arrays([keys, *[batch.column(c) for c in own], *mine], ["key", *own, *["half"] * (not fine)])
                    yield out.filter(few) if at == half + HALF - 1 else out

    def settle(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, sizes, kinds = _values(held, "key", "node", "size", "kind")
        sizes, lists = sizes.astype(np.int64), keys.astype(np.int64)
        half, at = np.divmod(lists >> 8, HALF)
        prints = _bytes(held, "print" if fine else "half")
        words = np.pad(prints, ((0, 0), (0, -prints.shape[1] % 8))).view(np.uint64)
        halves = np.where((half == 0)[:, None], prints[:, :HALF], prints[:, -HALF:])
        sketches = _bytes(held, "sketch").view(np.uint64) if fine else None
        us, vs = [], []

        def meet(taken: np.ndarray, numbers: np.ndarray, upto: int, few: bool) -> None:
            """A pair comes from the list of the first bytes that it shares alone: of one before ``upto``, and the one there."""

            def last(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                a, b = taken[a], taken[b]
                out = (halves[a, :upto] == halves[b, :upto]).sum(axis=1) == 1
                if not few:
                    out &= np.maximum(sizes[a], sizes[b]) > FEW
                if fine:
                    out &= (half[a] == 0) | ((prints[a, :HALF] == prints[b, :HALF]).sum(axis=1) < (1 if few else 2))
                return out

            for u, v in _across(nodes[taken], sizes[taken], words[taken], kinds[taken], 1 << 16, numbers, sketches[taken] if fine else None, last):
                us.append(np.maximum(u, v) if fine else np.unique(np.concatenate([u, v])))
                vs.append(np.minimum(u, v))

        def out() -> pa.RecordBatch:
            found = [pa.array(np.concatenate(x)) for x in (us, vs)] if fine else [pa.array(np.unique(np.concatenate(us)))]
            us.clear()
            vs.clear()
            return pa.RecordBatch.from_arrays(found, ["u", "v"] if fine else ["node"])

        for second in range(1, HALF):
            taken = np.flatnonzero(at < second)
            if len(taken) > 1:
                meet(taken, (lists[taken] << 8) + halves[taken, second], second, False)
            if sum(map(len, us)) > 1 << 16:
                yield out()
        for first in np.unique(at).tolist():
            taken = np.flatnonzero((at == first) & (sizes <= FEW))
            if len(taken) > 1:
                meet(taken, lists[taken], first + 1, True)
        if us:
            yield out()

    postings = texts.where("size > 0").select("node", "size", "kind", *["sketch"] * fine, "print").mapInArrow(tidy(post), schema)
    return _settled(postings, settle, "u long, v long" if fine else "node long")


def _read_again(nodes: DataFrame, placed: DataFrame, the_text: str, distinct: DataFrame, make: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(node, n, found) of ``nodes`` (node, n): what ``make`` makes of the shingles of one text of each, read again."""
    wanted = written(nodes.join(distinct.select("node", F.col("best.row").alias("row")), "node").withColumn("mark", F.xxhash64("row")), "wanted")
    read = placed.select(F.col("_row").alias("row"), F.xxhash64("_row").alias("mark"), _text(the_text))
    read = flagged(read, "mark", written(bitmap(wanted, "mark"), "wanted-bits")).where("_maybe").select("row", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [make(shingles(words_of(t))) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("n"), pa.array(sets, pa.binary())], ["node", "n", "found"])

    return written(read.join(wanted, "row").select("node", "n", "text").mapInArrow(tidy(run), "node long, n long, found binary"), "sets")


def _verified(pairs: DataFrame, placed: DataFrame, the_text: str, distinct: DataFrame) -> DataFrame:
    """The pairs that are near copies; one text of each node among them is read again for its shingles."""
    both = pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    sets = _read_again(both, placed, the_text, distinct, np.ndarray.tobytes)
    total = pairs.count()
    for end in ("u", "v"):
        pairs = hot_safe_left_join(pairs, sets.select(F.col("node").alias(end), F.col("found").alias(f"of_{end}"), "n"), [end], "n", total)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (map(lambda x: np.frombuffer(x.as_buffer(), np.uint64), batch.column(c)) for c in ("of_u", "of_v"))
            hit = pa.array([similar(a, b) for a, b in zip(*sides, strict=True)], pa.bool_())
            yield batch.select(["u", "v"]).filter(hit)

    return pairs.select("u", "v", "of_u", "of_v").mapInArrow(tidy(check), "u long, v long")


def _grouped(texts: DataFrame, links: DataFrame) -> DataFrame:
    """``texts`` with the group of each by the links found so far as its ``kind``."""
    groups = written(connected_components(links), "groups")
    return texts.drop("kind").join(groups, "node", "left").withColumn("kind", F.coalesce("component", "node")).drop("component")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each group of near copies the one with the smallest doc_id.

    Groups are joined by chains of near copies.  A null id counts as the largest, and of equal ids the first row stays;
    rows are told apart by their place alone.  Texts without words, null ones too, are copies of one another.
    """
    plain, own = numbered(small_batches(docs))
    the_id, the_text = (own[docs.columns.index(c)] for c in ("doc_id", "text"))
    placed = written(plain.select("*", F.monotonically_increasing_id().alias("_row")), "placed")
    prints = written(_prints(placed, the_id, the_text), "prints")
    rows = prints.count()
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    distinct = written(prints.groupBy("node").agg(F.min(place).alias("best"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("print").alias("print")), "distinct")
    plainly = distinct.select("node", "size", "print", F.col("node").alias("kind"))
    pairs = written(_starred(plainly, 4, False), "pairs")
    links = written(_verified(pairs, placed, the_text, distinct), "near")
    met = written(_meeting(_grouped(plainly, links), False), "meeting")
    fine = _read_again(met.withColumn("n", F.lit(1).cast("long")), placed, the_text, distinct, fine_sketch)
    plainly = written(plainly.join(fine.select("node", F.col("found").alias("sketch")), "node"), "met")
    stars = written(_starred(_grouped(plainly, links), 1, True).join(pairs, ["u", "v"], "left_anti"), "pairs")
    links = written(links.unionByName(_verified(stars, placed, the_text, distinct)), "near")
    second = _meeting(_grouped(plainly, links), True).join(pairs.unionByName(stars), ["u", "v"], "left_anti")
    second = written(second, "pairs")
    links = links.unionByName(_verified(second, placed, the_text, distinct))
    named = distinct.join(connected_components(links), "node", "left").withColumn("component", F.coalesce("component", "node")).select("node", "component", "best", "n")
    named = written(named, "named")
    stays = named.groupBy("component").agg(F.min("best").alias("stays"))
    # Nodes of one row that stay need no look at their rows.
    losing = written(named.join(stays, "component").where("n > 1 OR best <> stays").select("node", "n", F.col("stays.row").alias("stays")), "losing")
    gone = hot_safe_left_join(prints.select("row", "node"), losing, ["node"], "n", rows).where("row <> stays")
    gone = written(gone.select(F.col("row").alias("_row"), F.xxhash64("row").alias("_mark")), "gone")
    marked = flagged(placed.withColumn("_mark", F.xxhash64("_row")), "_mark", written(bitmap(gone, "_mark"), "gone-bits"))
    doubtful = marked.where("_maybe").join(gone.select("_row"), "_row", "left_anti").select(*own)
    return doubtful.unionByName(marked.where("NOT _maybe").select(*own)).toDF(*docs.columns)
