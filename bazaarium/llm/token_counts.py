"""Token counts: pieces are counted once per distinct pre-token and joined to per-document pre-token frequencies.

Two passes over the texts.  The first counts distinct pre-tokens over all documents; each distinct one is given
its number of pieces.  The second finds every document's pre-token frequencies and joins them to those numbers: the
most frequent ``hot`` short pre-tokens by a broadcast table (``hot`` bounds its size and takes the keys that would
skew a shuffle), all others by a shuffle join.  Ids are never materialised.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarium.llm.byte_bpe import ByteBpe, opened, words
from bazaarium.llm.tables import id_and_text, slices, written

#: The broadcast table has at most HOT pre-tokens of at most HOT_CHARS characters.
HOT, HOT_CHARS = 300_000, 32
#: Distinct pre-tokens a task holds before it hands its counts on.
HELD = 300_000


def frequencies(bpe: ByteBpe, text: str) -> tuple[Counter, int]:
    """Pre-tokens of a text and how often each occurs; and the pieces that special strings in it make."""
    if not bpe.by_words:
        return Counter(), len(bpe.text_ids(text))
    parts, fixed = [text], 0
    for special in bpe.special:
        cut = [p.split(special) for p in parts]
        fixed += sum(len(c) - 1 for c in cut)
        parts = [p for c in cut for p in c]
    found: Counter = Counter()
    for part in parts:
        first, *rest = words(part)
        for p in bpe.pretokens_of(first):
            found[p] += 1
        for word, n in Counter(rest).items():
            for p in bpe.pretokens[word]:
                found[p] += n
    return found, fixed


def token_counts(docs: DataFrame, tokenizer: bytes, limit: int = 1024, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``tokenizer`` is the content of a byte-level BPE file of the tokenizers library.  A null text counts as empty: 0
    bytes, 0 tokens.  Rows that repeat, ids that repeat and null ids each keep a row of their own.  Columns other than
    doc_id and text are not read.
    """
    spark = docs.sparkSession
    src = id_and_text(docs)
    file = spark.sparkContext.broadcast(tokenizer)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, held = opened(file.value), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["piece", "n"])

        for batch in batches:
            for part in slices(batch):
                for text in part.column("text").to_pylist():
                    held.update(frequencies(bpe, text)[0])
                bpe.pretokens.trim()
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(file.value)
        for batch in batches:
            pieces = [len(bpe.piece_ids(p)) for p in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("n"), pa.array(pieces, pa.int32())], ["piece", "n", "pieces"])

    counted = src.select("text").mapInArrow(distinct, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    priced = written(counted.mapInArrow(price, "piece string, n long, pieces int"), "pieces")

    short = priced.where(F.length("piece") <= HOT_CHARS)
    top = short.orderBy(F.desc("n"), "piece").limit(hot).select("piece", "pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top.column("piece").to_pylist(), top.column("pieces").to_pylist(), strict=True)))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pieces_of = opened(file.value), known.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch):
                rows: list[int] = []
                ids: list[int | None] = []
                sizes: list[int | None] = []
                pieces: list[str] = []
                times: list[int] = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    found, done = frequencies(bpe, text)
                    row += 1
                    at = len(pieces)
                    # No pre-token mixes a control character with digits: this key joins with nothing and spreads evenly.
                    pieces.append(f"\x00{row}")
                    times.append(0)
                    for p, n in found.items():
                        k = pieces_of.get(p)
                        if k is None:
                            pieces.append(p)
                            times.append(n)
                        else:
                            done += k * n
                    more = len(pieces) - at - 1
                    times[at] = done
                    rows += [row] * (more + 1)
                    ids += [doc_id] + [None] * more
                    sizes += [len(text.encode())] + [None] * more
                bpe.pretokens.trim()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(pieces, pa.string()), pa.array(times, pa.int64())],
                    ["row", "doc_id", "n_bytes", "piece", "times"],
                )

    # The first row of a document has n_bytes and the pieces already known; the others have a pre-token and its frequency.
    settled = src.mapInArrow(settle, "row long, doc_id long, n_bytes long, piece string, times long")
    joined = settled.join(priced.select("piece", "pieces"), "piece", "left")
    share = F.when(F.col("n_bytes").isNotNull(), F.col("times")).otherwise(F.col("times") * F.col("pieces"))
    return (
        joined.groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(share).alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
