"""Exact dedup: counting quotient filters built per partition, merged by sorted remainders, then byte comparison.

A 64-bit fingerprint of the normalised text is cut into a slice (which machine merges it), a quotient (which run of
the filter it stands in) and a remainder.  Each partition builds its filter for each slice: remainders in sorted runs,
one run per occupied quotient, each with a count.  Filters of a slice merge without loss by merging their runs.
Fingerprints counted more than once send their documents on; there the whole texts are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarium.llm.tables import SPACES, bitmap, flagged, hot_safe_left_join, written

#: Fingerprints that a merged filter should hold at most, in the mean.
SLICE_ROWS = 1 << 18
#: Quotient bits within a slice.
QUOTIENT_BITS = 16
#: Fingerprints a task holds before it hands on filters.
HELD = 1 << 20


class CountingQuotientFilter:
    """Occupied quotients, run ends, sorted remainders and counts, for fingerprints that share their slice bits."""

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray, bits: int):
        """``fingerprints``: distinct and ascending, each under 2**bits."""
        self.bits, self.q = bits, min(QUOTIENT_BITS, bits)
        quotients = (fingerprints >> np.uint64(bits - self.q)).astype(np.uint32)
        self.remainders = fingerprints & np.uint64((1 << (bits - self.q)) - 1)
        self.counts = counts.astype(np.int64)
        self.occupied, first = np.unique(quotients, return_index=True)
        self.ends = np.append(first[1:], len(fingerprints)).astype(np.int64)

    def fingerprints(self) -> np.ndarray:
        """All fingerprints, ascending: the filter loses none."""
        runs = np.diff(self.ends, prepend=0)
        return np.repeat(self.occupied.astype(np.uint64), runs) << np.uint64(self.bits - self.q) | self.remainders

    def packed(self) -> bytes:
        head = np.array([self.bits, len(self.occupied), len(self.remainders)], "<i8")
        return b"".join(x.tobytes() for x in (head, self.occupied.astype("<u4"), self.ends.astype("<i8"), self.remainders.astype("<u8"), self.counts.astype("<i8")))

    @classmethod
    def unpacked(cls, raw: bytes) -> CountingQuotientFilter:
        bits, runs, n = np.frombuffer(raw, "<i8", 3).tolist()
        out, at = cls.__new__(cls), 24
        out.bits, out.q = bits, min(QUOTIENT_BITS, bits)
        for name, kind, k in (("occupied", "<u4", runs), ("ends", "<i8", runs), ("remainders", "<u8", n), ("counts", "<i8", n)):
            setattr(out, name, np.frombuffer(raw, kind, k, at))
            at += k * int(kind[2])
        return out

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Merge the sorted runs of several filters; counts of equal remainders in a run add up."""
        every, counts = np.concatenate([f.fingerprints() for f in filters]), np.concatenate([f.counts for f in filters])
        order = np.argsort(every, kind="stable")
        distinct, first = np.unique(every[order], return_index=True)
        return cls(distinct, np.add.reduceat(counts[order], first) if len(first) else counts[:0], filters[0].bits)


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the values of ``prints.fp`` (long, not null) that occur more than once among ``rows`` rows.

    A slice is one group of filters, at most one for each HELD fingerprints of a partition, so a fingerprint that holds
    a third of all rows is one counter in each.  The number of slices follows the number of rows.
    """
    slice_bits = max(4, int(np.ceil(np.log2(max(1, rows) / SLICE_ROWS))))
    bits = 64 - slice_bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def filters(held: list[np.ndarray]) -> pa.RecordBatch:
            distinct, counts = np.unique(np.concatenate(held), return_counts=True)
            at = (distinct >> np.uint64(bits)).astype(np.int64)
            which, first = np.unique(at, return_index=True)
            cut = np.append(first, len(distinct))
            own = distinct & np.uint64((1 << bits) - 1)
            made = [CountingQuotientFilter(own[a:b], counts[a:b], bits).packed() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(made, pa.binary())], ["slice", "filter"])

        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= HELD:
                yield filters(held)
                held = []
        if held:
            yield filters(held)

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        whole = CountingQuotientFilter.merged([CountingQuotientFilter.unpacked(x) for x in group["filter"]])
        more = whole.counts > 1
        found = whole.fingerprints()[more] | np.uint64(int(key[0]) << bits)
        return pd.DataFrame({"fp": found.view(np.int64), "n": whole.counts[more]})

    built = prints.select("fp").mapInArrow(build, "slice long, filter binary")
    return built.groupBy("slice").applyInPandas(merge, "fp long, n long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Texts are equal if identical once each run of ASCII white space is one space; a null text is empty.  ``keep_id`` is
    the smallest doc_id of the group, null only where all its ids are null; ``kept`` marks the rows with that id (all of
    them, should rows repeat it).  Other columns are not read; an empty table gives an empty result.
    """
    normal = F.regexp_replace(F.coalesce(docs["text"], F.lit("")), SPACES, " ")
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), normal.alias("text"))
    prints = written(base.select("doc_id", F.xxhash64("text").alias("fp"), F.sha2("text", 256).alias("text_sha256")), "prints")
    rows = prints.count()
    repeated = written(repeated_fingerprints(prints, rows), "repeated")

    # Byte verification: whole texts are the grouping key, so Spark compares their bytes; copies meet map-side first.
    suspects = flagged(base.withColumn("fp", F.xxhash64("text")), "fp", written(bitmap(repeated, "fp"), "repeated-bits")).where("_maybe").drop("_maybe")
    suspects = hot_safe_left_join(suspects, repeated.withColumn("seen", F.lit(1)), ["fp"], "n", rows).where("seen = 1")
    groups = suspects.groupBy("fp", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.where("group_size > 1").select("fp", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size", F.col("group_size").alias("n"))
    out = hot_safe_left_join(prints, written(groups, "groups"), ["fp", "text_sha256"], "n", rows)
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
