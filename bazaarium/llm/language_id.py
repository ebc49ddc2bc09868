"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1- to 3-grams of code points per language over all labelled documents given, as a sum over
partitions; the matrix of log-probabilities has N x 3 x BUCKETS cells for N languages, whatever the size of the input,
and is broadcast.  Scoring hashes whole texts in numpy and adds, per document, the rows of the n-grams that occur in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarium.llm.tables import id_and_text, slices, small_batches, tidy

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
LONGEST = 3
SMOOTHING = 0.5
UNKNOWN = "und"
#: Characters handled at once.
SLICE_BYTES = 1 << 20
# Odd multipliers that mix neighbouring code points.
_MIX = np.array([2654435761, 2246822519, 3266489917], np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-gram: bucket of every place, and whether the n-gram lies within one text.

    Texts are lower-cased and have a space on either side; they are laid end to end.
    """
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    left = np.repeat(np.cumsum([len(t) for t in padded]), [len(t) for t in padded]) - np.arange(len(points))
    mixed = np.zeros(len(points), np.uint32)
    for n in range(LONGEST):
        ahead = points[n:] * _MIX[n]
        mixed[: len(ahead)] += ahead
        bucket = ((mixed ^ (mixed >> np.uint32(15))) * _MIX[0] >> np.uint32(32 - BUCKET_BITS)).astype(np.int32) + n * BUCKETS
        yield bucket, left > n


def counted(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of ``docs`` (text, lang) with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                langs = part.column("lang").to_pylist()
                texts = part.column("text").to_pylist()
                for lang in set(langs):
                    own = [t for t, k in zip(texts, langs, strict=True) if k == lang]
                    counts = held.setdefault(lang, np.zeros(LONGEST * BUCKETS, np.int64))
                    for bucket, inside in ngrams(own):
                        counts += np.bincount(bucket[inside], minlength=len(counts))
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])

    src = small_batches(docs).where(docs["lang"].isNotNull()).select(F.coalesce(docs["text"], F.lit("")).alias("text"), docs["lang"])
    return src.mapInArrow(tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Languages in order of code points, and per language and bucket the log-probability."""

    languages: list[str]
    table: np.ndarray


def fit(docs: DataFrame) -> Model:
    """Learn from ``docs`` (text, lang).  Rows without a language teach nothing; without rows there are no languages.

    The counts brought to the driver are at most LONGEST x BUCKETS for each language.
    """
    got = counted(docs).toArrow()
    languages = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((LONGEST * BUCKETS, len(languages)))
    place = {k: i for i, k in enumerate(languages)}
    counts[got.column("bucket").to_numpy(), [place[k] for k in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    table = np.log(counts + SMOOTHING)
    for n in range(LONGEST):
        own = slice(n * BUCKETS, (n + 1) * BUCKETS)
        table[own] -= np.log(counts[own].sum(axis=0) + SMOOTHING * BUCKETS)
    return Model(languages, np.ascontiguousarray(table.T, np.float32))


def log_likelihoods(model: Model, texts: list[str]) -> np.ndarray:
    """Sum of log-probabilities of each text's n-grams, per language."""
    sizes = np.array([len(t.lower()) + 2 for t in texts])
    starts = np.cumsum(sizes) - sizes
    out = np.zeros((len(texts), len(model.languages)))
    for bucket, inside in ngrams(texts):
        for k in range(len(model.languages)):
            each = np.take(model.table[k], bucket).astype(np.float64)
            each[~inside] = 0
            out[:, k] += np.add.reduceat(each, starts)
    return out


def predicted(model: Model, texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and its posterior probability; UNKNOWN and 0 for texts without letters or a model without languages."""
    if not model.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    found = log_likelihoods(model, texts)
    best = found.argmax(axis=1)
    with np.errstate(under="ignore"):
        posterior = 1 / np.exp(found - found.max(axis=1, keepdims=True)).sum(axis=1)
    known = [has_letter(t) for t in texts]
    langs = [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known, strict=True)]
    return langs, [p if k else 0.0 for p, k in zip(posterior.tolist(), known, strict=True)]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``; a null text has no letter.  Only doc_id and text are read."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                langs, scores = predicted(model, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return id_and_text(docs).mapInArrow(tidy(label), "doc_id long, lang_pred string, score double")


def kept(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language of probability ``least`` or more."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                langs, scores = predicted(model, [t or "" for t in part.column("text").to_pylist()])
                yield part.filter(pa.array([k != UNKNOWN and s >= least for k, s in zip(langs, scores, strict=True)], pa.bool_()))

    return small_batches(docs).mapInArrow(tidy(run), docs.schema)
