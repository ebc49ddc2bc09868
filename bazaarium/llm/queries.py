"""Queries over the driver's tables, one per operator, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarium.llm import exact_dedup, language_id, line_dedup, mixing, mpeg_audio, packing, periodic_runs, prefix_trie, sentencepiece_unigram, simhash, sst, token_counts, toxicity
from bazaarium.llm.tables import held_out

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> bytes:
    """A public vocabulary file, read where the driver runs; tasks get its content."""
    return Path(public_tokenizers.path(name)).read_bytes()


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = held_out(F.col("doc_id"), 5, 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~out & F.col("toxic").isNotNull())
    machine = toxicity.fit(docs.select("doc_id", "text").join(labels, "doc_id"))
    return toxicity.scored(docs, machine).select("doc_id", out.alias("held_out"), "score", "predicted")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sst.token_shards(documents(spark, sf_dir), vocabulary(BYTE_BPE), end_id=2)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = held_out(F.col("doc_id"), 4, 2)
    model = language_id.fit(docs.where(~out))
    return language_id.identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.audio_column(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(documents(spark, sf_dir), passages=True)
    return out.select("doc_id", "lines_before", "lines_removed", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, model = documents(spark, sf_dir), vocabulary(PIECES)
    back = sentencepiece_unigram.decoded(sentencepiece_unigram.encoded(docs, model), model)
    return back.select("doc_id", "n_pieces", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), vocabulary(BYTE_BPE), limit=1024)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    looped = periodic_runs.looped(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string").cast("binary")))
    return periodic_runs.described(periodic_runs.periodic_runs(looped))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(documents(spark, sf_dir), vocabulary(WORD_BPE), end_id=0, capacity=2048)
    return packing.packed(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), 2048)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    c = F.col("conv_id")
    return prefix_trie.trie(prefix_trie.with_openings(turns, base=c - c % 100, shared=F.crc32(c.cast("string").cast("binary")) % 6, most=5))


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents
), g AS (SELECT text, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g USING (text)
"""

# Sizes, targets and the cut of the last pass follow from the shuffled axis alone; the schedule fills it block by block.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffled,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), a AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY shuffled, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d
), t AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source
), r AS (SELECT *, 3 * source_size AS most, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM t
), l AS (
  SELECT *, CAST((sum(source_size) OVER ()) - coalesce(sum(most) OVER w, 0) AS DOUBLE) / CAST((sum(weight) OVER ()) - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
  FROM r WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT source, source_size, CASE WHEN ratio <= level THEN CAST(most AS DOUBLE) ELSE weight * (SELECT arg_min(level, ratio) FROM l WHERE ratio > level) END AS target FROM l
), q AS (SELECT *, CAST(floor(target) AS BIGINT) AS quota FROM g)
SELECT a.doc_id, a.size, q.source_size, q.target,
       CAST(CASE WHEN a.size = 0 THEN 0 ELSE (q.quota // q.source_size) * a.size
            + greatest(0, least(a.size, q.quota % q.source_size - a.start)) END AS BIGINT) AS taken
FROM a JOIN q ON a.source IS NOT DISTINCT FROM q.source
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_token_shards": op3_token_shards,
    "op4_language_id": op4_language_id,
    "op5_mpeg_audio": op5_mpeg_audio,
    "op6_mixing": op6_mixing,
    "op7_line_dedup": op7_line_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_token_counts": op10_token_counts,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_packing": op12_packing,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {"op6_mixing": OP6_SQL, "op8_exact_dedup": OP8_SQL}
