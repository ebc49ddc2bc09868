"""Training-corpus pipeline: five stages in order, each over all that its predecessor kept.

``ORACLE_SQL`` is None, as SQL cannot express the language model or the piece search; tests hold the stages against
plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarium.llm import language_id, line_dedup, mixing, sentencepiece_unigram
from bazaarium.llm import near_copies as similar
from bazaarium.llm.queries import PIECES, vocabulary
from bazaarium.llm.tables import held_out, written

#: Documents whose language is less probable than this go, as do those without letters.
LEAST_PROBABILITY = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn languages from labelled documents; documents without a language to tell go."""
    model = language_id.fit(docs.where(~held_out(docs["doc_id"], 4, 2)))
    return language_id.kept(docs, model, LEAST_PROBABILITY)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks and passages of lines go from texts; documents left without words by that go."""
    own = docs.columns
    lines_before, removed = ("_".join(["stage", c, *own]) for c in ("lines", "removed"))  # names no column has
    out = line_dedup.deduplicated(docs, lines_before, removed, passages=True)
    left = (F.col(removed) == 0) | (mixing.n_words(F.col("text")) > 0)
    return out.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*own)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, a similarity of 0.8 or more."""
    return similar.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeated(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode; one row per document with digests of its ids and of the text they give back."""
    model = vocabulary(PIECES)
    back = sentencepiece_unigram.decoded(sentencepiece_unigram.encoded(docs, model), model)
    return back.select("doc_id", "n_pieces", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs, f"stage-{n}")
    return docs
