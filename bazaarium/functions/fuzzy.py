"""Fuzzy ratios as column expressions, by a longest common subsequence in one fold over each string."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings.

    A fold over the characters of ``a`` keeps one row of the table, itself a fold over those of ``b``.
    """
    def table(pair: Column) -> Column:
        second = pair["b"]
        places = F.when(F.size(second) > 0, F.sequence(F.lit(1), F.size(second))).otherwise(F.array().cast("array<int>"))

        def next_row(row: Column, char: Column) -> Column:
            def cell(done: Column, j: Column) -> Column:
                best = F.when(F.get(second, j - 1) == char, F.get(row, j - 1) + 1).otherwise(F.greatest(F.element_at(done, -1), F.get(row, j)))
                return F.concat(done, F.array(best))

            return F.aggregate(places, F.array(F.lit(0)), cell)

        return F.element_at(F.aggregate(pair["a"], F.array_repeat(F.lit(0), F.size(second) + 1), next_row), -1)

    return let(F.struct(_characters(a).alias("a"), _characters(b).alias("b")), table)


def indel_ratio(a: Column, b: Column) -> Column:
    """200 LCS / (length a + length b); 100 for two empty strings."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs(a, b) / total)


def token_set_ratio(a: Column, b: Column) -> Column:
    """Similarity 0 to 100 of two texts as sets of words: what they share against what either has besides.

    Null if a text is null; 0 if either has no words.
    """
    def words(t: Column) -> Column:
        return F.array_distinct(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))

    def joined(w: Column) -> Column:
        return F.array_join(F.array_sort(w), " ")

    def split(w: Column) -> Column:
        return F.struct(joined(F.array_intersect(w["a"], w["b"])).alias("shared"), joined(F.array_except(w["a"], w["b"])).alias("a"), joined(F.array_except(w["b"], w["a"])).alias("b"), ((F.size(w["a"]) == 0) | (F.size(w["b"]) == 0)).alias("none"))

    def ratio(t: Column) -> Column:
        s, la, lb = F.length(t["shared"]), F.length(t["a"]), F.length(t["b"])
        gap = F.when(s > 0, 1).otherwise(0)
        size_a, size_b = s + gap + la, s + gap + lb
        whole = F.lit(100.0) - F.lit(100.0) * (la + lb - 2 * lcs(t["a"], t["b"])) / (size_a + size_b)
        with_a = F.lit(100.0) - F.lit(100.0) * (gap + la) / (s + size_a)
        with_b = F.lit(100.0) - F.lit(100.0) * (gap + lb) / (s + size_b)
        full = (s > 0) & ((la == 0) | (lb == 0))
        return F.when(t["none"], F.lit(0.0)).when(full, F.lit(100.0)).when(s == 0, whole).otherwise(F.greatest(whole, with_a, with_b))

    return let(F.struct(words(a).alias("a"), words(b).alias("b")), lambda w: let(split(w), ratio))
