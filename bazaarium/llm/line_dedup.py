"""Line dedup by content-defined chunks of lines.

A text is cut into lines at newlines.  A rolling hash over the hashes of WINDOW neighbouring lines ends a chunk where it
leaves remainder 0, so boundaries depend on nearby lines alone and come back after lines are put in or taken out.
Chunks of two or more lines that occur more than once in the corpus stay at their first place (smallest doc_id, then
place in the text) and are removed everywhere else, after their bytes were compared.

Chunks alone miss the ragged ends of a passage, and short ones wholly.  With ``passages`` every pair of neighbouring lines
is a unit too, and every line of more than PASSAGE_WORDS words.  Lines that lie in units seen at an earlier place are
joined to runs, with what chunks remove, and runs of more than PASSAGE_WORDS words go.  Each line's text stays at its
first place: a unit around that cannot have an earlier one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarium.llm.tables import bitmap, flagged, hot_safe_left_join, numbered, slices, small_batches, tidy, written

WINDOW = 2
#: A chunk ends at one line of so many.
MEAN_LINES = 3
LEAST_LINES = 2
#: Runs of repeated lines go if they have more words than this.
PASSAGE_WORDS = 50
#: Kinds of units: place numbers are KINDS times a chunk's or line's number, plus the kind.
CHUNK, PAIR, LINE, KINDS = 0, 1, 2, 3
_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
_OUT = pow(_STEP, WINDOW, 1 << 64)
#: A null id counts as the largest.
_NO_ID = (1 << 63) - 1


def chunks(text: str) -> list[list[str]]:
    """Runs of lines; joined with newlines, in order, they are the text."""
    lines = text.split("\n")
    hashes = [xxhash.xxh64_intdigest(line) for line in lines]
    out, begun, roll = [], 0, 0
    for i, h in enumerate(hashes):
        roll = (roll * _STEP + h) & _MASK
        if i >= WINDOW:
            roll = (roll - hashes[i - WINDOW] * _OUT) & _MASK
        if i + 1 >= WINDOW and (roll >> 17) % MEAN_LINES == 0:
            out.append(lines[begun : i + 1])
            begun = i + 1
    if begun < len(lines):
        out.append(lines[begun:])
    return out


def _units(text: str, passages: bool) -> Iterator[tuple[int, str]]:
    """(place number, text) of what may repeat: chunks of LEAST_LINES lines or more, and with ``passages`` finer units."""
    for n, lines in enumerate(chunks(text)):
        if len(lines) >= LEAST_LINES:
            yield n * KINDS + CHUNK, "\n".join(lines)
    if passages:
        lines = text.split("\n")
        for n, line in enumerate(lines):
            if n + 1 < len(lines):
                yield n * KINDS + PAIR, f"{line}\n{lines[n + 1]}"
            if _words(line) > PASSAGE_WORDS:
                yield n * KINDS + LINE, line


def _words(line: str) -> int:
    return len(line.encode().split())


def _lost(text: str, cut: list[int]) -> tuple[list[str], set[int]]:
    """The lines of a text, and the numbers of those that go by the place numbers of its repeated units."""
    gone, fine, at = set(), set(), 0
    numbers, lines = set(cut), text.split("\n")
    for n, chunk in enumerate(chunks(text)):
        if n * KINDS + CHUNK in numbers:
            gone.update(range(at, at + len(chunk)))
        at += len(chunk)
    for number in numbers:
        n, kind = divmod(number, KINDS)
        if kind != CHUNK:
            fine.update((n, n + 1) if kind == PAIR else (n,))
    if fine:
        run: list[int] = []
        for n in range(len(lines) + 1):
            if n in fine or n in gone:
                run.append(n)
            elif run:
                if sum(_words(lines[i]) for i in run) > PASSAGE_WORDS:
                    gone.update(run)
                run = []
    return lines, gone


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents under their id and a hash of their text; rows equal in both are the same document."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)).alias("_id"), F.xxhash64(text).alias("_print"), text.alias("_text"))


def _occurrences(keyed: DataFrame, texts: bool, passages: bool) -> DataFrame:
    """(_id, _print, chunk_no, fp, fp2[, chunk]) of every unit; ``chunk_no`` is its place number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "_print", "chunk_no", "fp", "fp2"] + ["chunk"] * texts
        for batch in batches:
            for part in slices(batch, "_text"):
                rows: list[tuple] = []
                for i, p, text in zip(*(part.column(c).to_pylist() for c in ("_id", "_print", "_text")), strict=True):
                    for n, chunk in _units(text, passages):
                        # Units of different kinds never meet: their hashes have different seeds.
                        two = (xxhash.xxh64_intdigest(chunk, seed + 2 * (n % KINDS)) for seed in (1, 2))
                        rows.append((i, p, n, *(x - (1 << 63) for x in two)) + ((chunk,) if texts else ()))
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                kinds = [pa.int64()] * 5 + [pa.string()] * texts
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return keyed.mapInArrow(tidy(run), "_id long, _print long, chunk_no long, fp long, fp2 long" + ", chunk string" * texts)


def removals(docs: DataFrame, passages: bool = False) -> DataFrame:
    """(_id, _print, cut): place numbers of the units seen at an earlier place, for documents that have any."""
    keyed = _keyed(docs)
    every = written(_occurrences(keyed, False, passages), "chunks")
    total = every.count()
    often = written(every.groupBy("fp", "fp2").agg(F.count("*").alias("n")).where("n > 1"), "often")
    # Byte comparison: the chunk's text is part of the grouping key; equal chunks meet map-side first.
    texts = flagged(_occurrences(keyed, True, passages), "fp", written(bitmap(often, "fp"), "often-bits")).where("_maybe").drop("_maybe")
    texts = hot_safe_left_join(texts, often.withColumn("seen", F.lit(1)), ["fp", "fp2"], "n", total).where("seen = 1")
    place = F.struct("_id", "_print", "chunk_no")
    groups = texts.groupBy("fp", "fp2", "chunk").agg(F.min(place).alias("first"), F.count("*").alias("n")).drop("chunk")
    # Should two texts share both hashes, neither is touched.
    sure = groups.groupBy("fp", "fp2").agg(F.first("first").alias("first"), F.sum("n").alias("n"), F.count("*").alias("kinds")).where("kinds = 1 AND n > 1").drop("kinds")
    marked = hot_safe_left_join(every, written(sure, "repeats"), ["fp", "fp2"], "n", total)
    return marked.where(F.col("first").isNotNull() & (F.col("first") != place)).groupBy("_id", "_print").agg(F.collect_set("chunk_no").alias("cut"))


def deduplicated(docs: DataFrame, before: str = "lines_before", removed: str = "lines_removed", passages: bool = False) -> DataFrame:
    """All columns of ``docs`` with repeated chunks gone from text, and two more: lines before, and those removed.

    With ``passages`` repeated runs of lines with more than PASSAGE_WORDS words go too, whatever the chunks.

    A null text stays null and has no lines; an empty one is a single empty line.  Rows equal in id and text are treated
    alike.  A document that loses all its lines keeps an empty text.  An empty table gives an empty result.  Columns of
    ``docs`` with the two names are replaced, whatever other columns it has stay as they are.
    """
    docs = small_batches(docs).drop(before, removed)
    names = docs.columns
    plain, own = numbered(docs)
    the_id, the_text = (own[names.index(c)] for c in ("doc_id", "text"))
    keyed = plain.select("*", F.coalesce(F.col(the_id).cast("long"), F.lit(_NO_ID)).alias("_id"), F.xxhash64(F.coalesce(the_text, F.lit(""))).alias("_print"))
    cuts = written(removals(docs, passages), "removals")
    marked = flagged(keyed, "_print", written(bitmap(cuts, "_print"), "removal-bits"))
    touched = marked.where("_maybe").join(cuts, ["_id", "_print"], "left").select(*own, "cut")
    joined = touched.unionByName(marked.where("NOT _maybe").select(*own, F.lit(None).cast("array<long>").alias("cut")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, the_text):
                texts, had, gone_lines = [], [], []
                for text, cut in zip(part.column(the_text).to_pylist(), part.column("cut").to_pylist(), strict=True):
                    kept, lost = text, 0
                    if cut:
                        lines, gone = _lost(text, cut)
                        kept, lost = "\n".join(x for n, x in enumerate(lines) if n not in gone), len(gone)
                    texts.append(kept)
                    had.append(0 if text is None else text.count("\n") + 1)
                    gone_lines.append(lost)
                columns = [pa.array(texts, pa.string()) if c == the_text else part.column(c) for c in own]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(had, pa.int64()), pa.array(gone_lines, pa.int64())], [*own, "_had", "_lost"])

    schema = joined.drop("cut").schema.add("_had", "long").add("_lost", "long")
    return joined.mapInArrow(tidy(run), schema).toDF(*names, before, removed)
