"""Periodic runs of words: maximal repetitions by Main-Lorentz divide and conquer on interned word ids.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least twice as long as
q and at least ``least`` words, that no neighbouring word extends keeping q.  A range of words is halved; Z-functions at
its middle give, for every q, how far words q apart agree to both sides of the middle, hence all repetitions that cross
it; these are extended over the whole text, intervals found again count once, with the smallest period.  The halves
follow in the same way.

A run holds ``(least + 1) // 2`` words that stand again q words later.  A range without such a pair has no run, so it is
not looked at; a range within a run whose period is at most ``least // 2`` has no other run.  Both rules are exact.
Texts are independent: there is no shuffle, and a task holds some megabytes of text, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarium.llm.tables import id_and_text, slices

LEAST = 12
#: Elements that are compared or copied at once.
BLOCK = 1 << 12
_ODD = np.uint64(0x9E3779B97F4A7C15)


def interned(words: list[bytes]) -> np.ndarray:
    """A number for each word; equal words have equal numbers."""
    first: dict[bytes, int] = {}
    return np.fromiter(map(first.setdefault, words, count()), np.int64, len(words))


def agreement(s: np.ndarray, a: int, b: int) -> int:
    """How many elements from ``a`` on equal those from ``b`` on, a < b."""
    done, step, n = 0, 16, len(s) - b
    while done < n:
        step = min(step, n - done)
        differs = s[a + done : a + done + step] != s[b + done : b + done + step]
        at = int(differs.argmax())
        if differs[at]:
            return done + at
        done, step = done + step, min(2 * step, BLOCK)
    return n


def z_function(s: np.ndarray) -> np.ndarray:
    """For each position, how far the rest of ``s`` agrees with its beginning.

    Positions whose first two elements do not both agree are settled for all at once, and those within a stretch known
    to agree copy their values from the beginning in blocks.
    """
    n = len(s)
    z = np.zeros(n, np.int64)
    if n == 0:
        return z
    z[1:] = s[1:] == s[0]
    heads = np.flatnonzero(z[1:-1] & (s[2:] == s[1])) + 1 if n > 2 else np.zeros(0, np.int64)
    z[0] = n
    i, left, right, k = 1, 0, 0, 0
    while i < n:
        if i >= right:
            k += int(np.searchsorted(heads[k:], i))
            if k == len(heads):
                break
            left = int(heads[k])
            right = left + agreement(s, 0, left)
            z[left], i = right - left, left + 1
            continue
        m = min(right - i, left, BLOCK)
        known, rest = z[i - left : i - left + m], right - np.arange(i, i + m)
        ties = np.flatnonzero(known == rest) if right < n else ()
        t = int(ties[0]) if len(ties) else m
        z[i : i + t] = np.minimum(known[:t], rest[:t])
        i += t
        if t < m:
            # It agrees up to the end of the stretch, perhaps beyond.
            right += agreement(s, right - i, right)
            z[i], left = right - i, i
            i += 1
    return z


def _crossing(s: np.ndarray, low: int, mid: int, high: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of repetitions of s[low:high] that cross ``mid``, one for each interval."""
    u, v, mark = s[low:mid], s[mid:high], np.array([-1], s.dtype)
    nu, nv = len(u), len(v)
    ahead = z_function(np.concatenate([v, mark, u, v]))
    behind = z_function(np.concatenate([u[::-1], mark, v[::-1], u[::-1]]))
    # Periods that reach forward from the middle: words from mid agree with those from mid + q.
    q = np.arange(1, nv + 1)
    fore, back = np.append(ahead[1:nv], 0), behind[nu + 1 + nv - q]
    found = [(mid - back, mid + q + fore, q)]
    # Periods that reach back from it: words from mid - q agree with those from mid.
    q = np.arange(1, nu + 1)
    fore, back = ahead[nv + 1 + nu - q], np.append(behind[1:nu], 0)
    found.append((mid - q - back, mid + fore, q))
    start, end, q = map(np.concatenate, zip(*found, strict=True))
    keep = end - start >= np.maximum(2 * q, least)
    start, end, q = start[keep], end[keep], q[keep]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    first = np.ones(len(q), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return list(zip(start[first].tolist(), end[first].tolist(), q[first].tolist(), strict=True))


def _again(s: np.ndarray, width: int) -> np.ndarray:
    """For each position, the end of the next like stretch of ``width`` elements; far beyond the end if there is none.

    Stretches are compared by hash, so one that is not alike may count: a range is then looked at in vain.
    """
    n = len(s) - width + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = mixed * _ODD + s[k : k + n].astype(np.uint64) + np.uint64(1)
    mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    alike = mixed[order[1:]] == mixed[order[:-1]]
    out = np.full(n, np.iinfo(np.int64).max)
    out[order[:-1][alike]] = order[1:][alike] + width
    return out


def find_runs(s: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a sequence of numbers not below 0, by start and period."""
    n, width = len(s), max(1, (least + 1) // 2)
    if n < max(least, 2):
        return []
    again = _again(s, width)
    backward, runs, short = s[::-1], {}, []
    todo = [(0, n)]
    while todo:
        low, high = todo.pop()
        if high - low < max(least, 2) or again[low : high - width].min(initial=high + 1) > high:
            continue
        if any(a <= low and high <= b for a, b in short):
            continue
        mid = (low + high) // 2
        for start, end, q in _crossing(s, low, mid, high, least):
            if end == high:
                end += agreement(s, end - q, end)
            if start == low:
                start -= agreement(backward, n - start - q, n - start)
            if runs.setdefault((start, end), q) > q:
                runs[start, end] = q
            if q <= least // 2:
                short.append((start, end))
        todo += [(mid, high), (low, mid)]
    return sorted((start, end - start, q) for (start, end), q in runs.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edges[start + q] += 1
        edges[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist())


SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row of ``docs`` (doc_id, text).

    ``runs`` lists (start, length, period) in words, by start and period; ``collapsed`` has the words outside of
    repeats, joined by one space.  A null, empty or blank text has no words, no runs and an empty ``collapsed``; rows that
    repeat are kept; an empty table gives an empty one.
    """
    parts = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sizes, found, left = [], [], []
                for raw in part.column("text").cast(pa.binary()).to_pylist():
                    words = raw.split()  # bytes are split at ASCII white space alone
                    runs = find_runs(interned(words), least)
                    sizes.append(len(words))
                    found.append(runs)
                    left.append(collapsed(words, runs))
                flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
                values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(parts))
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), values)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), lists, pa.array(left, pa.binary()).cast(pa.string(), safe=False)], ["doc_id", "n_words", "runs", "collapsed"])

    return id_and_text(docs).mapInArrow(find, SCHEMA)


def described(found: DataFrame) -> DataFrame:
    """Count, longest run and digests of what ``periodic_runs`` returns, in columns."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    said = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    one = found.withColumn("_longest", longest)
    return one.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_longest.start")).alias("start"), F.col("_longest.length").alias("length"), (-F.col("_longest.period")).alias("period"),
        F.expr("1000 * _longest.length div -_longest.period").alias("exponent_milli"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def looped(docs: DataFrame, seed: Column) -> DataFrame:
    """(doc_id, text) where one text in ten ends in a loop that its ``seed`` (a number, or null for none) chooses.

    With g = seed div 10, n words and seed a multiple of 10, word i from a = g % n on becomes word a + (i - a) % p,
    p = 1 + (n - a) div (3 + g % 8), and the words are joined by one space.
    """
    picked = docs.select(docs["doc_id"], docs["text"], seed.alias("_seed"))
    cut = picked.select("doc_id", "text", F.expr("_seed div 10").alias("_g"), F.when(F.col("_seed") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("_words"))
    sized = cut.withColumn("_n", F.size("_words")).withColumn("_a", F.expr("CASE WHEN _n > 0 THEN cast(_g % _n AS int) END")).withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + _g % 8) AS int)"))
    loop = F.expr("array_join(transform(sequence(0, _n - 1), i -> _words[CASE WHEN i < _a THEN i ELSE _a + (i - _a) % _p END]), ' ')")
    return sized.select("doc_id", F.when(F.col("_a").isNotNull(), loop).otherwise(F.col("text")).alias("text"))
