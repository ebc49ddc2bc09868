"""Small helpers shared by the operators: the shared folder, written stages and Arrow slices."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarium.session import shared_dir

#: Text handled at once inside a task; a single longer text is a slice of its own.
SLICE_BYTES = 4 << 20

#: ASCII white space as the contracts name it.
SPACES = r"[\x20\x09-\x0D]+"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and nothing is computed twice."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of text that go to Python at once; with long texts the usual 10,000 would fill its memory.
BATCH_ROWS = 1000


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, with the session set to hand Python no more than BATCH_ROWS rows at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(docs.sparkSession.conf.get(key)) <= BATCH_ROWS:
        docs.sparkSession.conf.set(key, BATCH_ROWS)
    return docs


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function, after which memory that is free again goes back to the machine: workers live on and share it with other stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library alone
        if trim:
            trim(0)

    return task


def numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns named c0, c1 and so on, and those names: none clashes with what an operator adds."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts empty; whatever other columns there are stay behind."""
    small_batches(docs)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def slices(batch: pa.RecordBatch, text: int | str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text each."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > at and held + size > limit:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    if at < batch.num_rows:
        yield batch.slice(at)


#: Bits of a membership bitmap; its rows, one for each 64 bits, are at most 2 ** (BITMAP_BITS - 6).
BITMAP_BITS = 24


def bitmap(keys: DataFrame, column: str) -> DataFrame:
    """(_word, _bits): a bitmap of the low bits of a long column.  Its size is bounded whatever the number of keys."""
    place = F.col(column).bitwiseAND((1 << BITMAP_BITS) - 1)
    bits = keys.select(F.shiftright(place, 6).alias("_word"), F.expr(f"shiftleft(1L, cast({column} & 63 AS int))").alias("_bit"))
    return bits.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def flagged(df: DataFrame, column: str, members: DataFrame) -> DataFrame:
    """Add ``_maybe``: false only if a row's key is not among those of a written bitmap.

    Rows that cannot match thus need no shuffle.  With more keys more rows are passed on, none is lost.
    """
    word = F.shiftright(F.col(column).bitwiseAND((1 << BITMAP_BITS) - 1), 6)
    joined = df.withColumn("_word", word).join(F.broadcast(members), "_word", "left")
    hit = F.expr(f"(shiftright(_bits, cast({column} & 63 AS int)) & 1) = 1")
    return joined.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_word", "_bits")


def hot_safe_left_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, share: int = 1000) -> DataFrame:
    """Left join whose hot keys go by broadcast.

    ``right`` has one row per key and says in ``weight`` how many rows of ``left`` carry it.  Keys that hold more
    than 1/``share`` of ``total`` rows are fewer than ``share``, so that part is broadcast with a proven bound.  All
    other keys join by shuffle; rows already settled get a key of their own there, so they spread evenly.
    """
    out = [c for c in right.columns if c not in keys and c != weight]
    hot = right.where(F.col(weight) * share > total)
    cold = right.where(F.col(weight) * share <= total)
    mark = F.lit(True).alias("_hot")
    first = left.join(F.broadcast(hot.select(*keys, *[F.col(c).alias(f"_h_{c}") for c in out], mark)), keys, "left")
    lead = keys[0]
    spread = F.when(F.col("_hot") | F.col(lead).isNull(), F.xxhash64(F.lit("settled"), F.monotonically_increasing_id()))
    first = first.withColumn("_key", F.coalesce(spread, F.xxhash64(*keys)))
    last = cold.select(F.xxhash64(*keys).alias("_key"), *[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_c_{c}") for c in out])
    on = (first["_key"] == last["_key"]) & F.col("_hot").isNull()
    for k in keys:
        on = on & (first[k] == last[f"_k_{k}"])
    joined = first.join(last, on, "left")
    return joined.select(*[first[c] for c in left.columns], *[F.coalesce(f"_h_{c}", f"_c_{c}").alias(c) for c in out])
