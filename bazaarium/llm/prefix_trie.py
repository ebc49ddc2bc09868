"""The prefix trie of conversations: one row per node, by smallest-member ownership.

A node is a distinct sequence of first d turns (role, text).  Its smallest member owns it, and as members only go away
further down, a conversation that owns a node owns the rest of its own path: each owns a suffix.  So all about a
subtree follows from sums over the members of its top: the tokens of a member's turns from there on, less those of the
turns it owns, add up to what sharing saves; members that own a leaf count leaves.

Nodes are known by two 64-bit hashes of the digests (SHA-256) of their turns by place, combined so that windows can run
over the turns of a conversation; nothing is compared turn by turn.  Windows number turns and sum what is left of a
conversation; owners and sums by node are aggregates that Spark combines before the shuffle, so a node that most
conversations share is no task of its own.  A conversation's turns are numbered in one task, which streams them; texts
stay behind at the scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarium.llm.tables import written

#: Text of conversation ids that is handed on at once.
CHUNK = 1 << 13


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, said, tokens): each turn by its place from 1, the digest of its role and text, and code points.

    Turns are ordered by ``turn``, null first; equal ones by digest.  A null role or text is empty.  Rows without a conv_id
    belong to no conversation.
    """
    role, text = (F.coalesce(conversations[c], F.lit("")) for c in ("role", "text"))
    said = F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)
    rows = conversations.where(conversations["conv_id"].isNotNull()).select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].alias("turn"), said.alias("said"), F.char_length(text).cast("long").alias("tokens"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "said")
    return rows.select("conv_id", F.row_number().over(order).alias("place"), "said", "tokens")


def with_openings(numbered: DataFrame, base: Column, shared: Column, most: int) -> DataFrame:
    """Turns of conversations rebuilt from the opening of another, and every conversation's row for the root.

    Of conversation c the first ``shared`` turns (a column of conv_id, at most ``most``) are those of conversation
    ``base`` (all if it has fewer, none if there is no such), then come c's own turns after its first ``shared``.
    Place 0 stands for the root.
    """
    convs = numbered.groupBy("conv_id").agg(F.lit(1).alias("_one")).select("conv_id", base.alias("_base"), shared.alias("_shared"))
    openings = numbered.where(F.col("place") <= most).where(F.col("conv_id") == base).select(F.col("conv_id").alias("_base"), "place", "said", "tokens")
    heads = convs.join(openings, "_base").where("place <= _shared").select("conv_id", F.lit(1).alias("own"), "place", "said", "tokens")
    tails = numbered.where(F.col("place") > shared).select("conv_id", F.lit(2).alias("own"), "place", "said", "tokens")
    roots = convs.select("conv_id", F.lit(0).alias("own"), F.lit(0).alias("place"), F.lit("").alias("said"), F.lit(0).cast("long").alias("tokens"))
    order = W.partitionBy("conv_id").orderBy("own", "place")
    return roots.unionByName(heads).unionByName(tails).select("conv_id", (F.row_number().over(order) - 1).alias("place"), "said", "tokens")


def paths(rebuilt: DataFrame) -> DataFrame:
    """Each place of each conversation with its node (k1, k2), the node above (p1, p2), whether it is the last, and ``rest``: tokens from there on."""
    way = W.partitionBy("conv_id").orderBy("place")
    mark = F.when(F.col("place") > 0, F.sha2(F.concat_ws(":", F.col("place").cast("string"), "said"), 256))
    marks = rebuilt.withColumn("_m", mark).select("conv_id", "place", "tokens", *[F.when(F.col("place") > 0, F.xxhash64("_m", F.lit(n))).otherwise(F.lit(0).cast("long")).alias(f"m{n}") for n in (1, 2)])
    whole = W.partitionBy("conv_id")
    summed = marks.select(
        "conv_id", "place", "tokens", "m1", "m2", F.bit_xor("m1").over(way).alias("k1"), F.bit_xor("m2").over(way).alias("k2"),
        F.lead("place").over(way).isNull().alias("ends"), (F.sum("tokens").over(whole) - F.sum("tokens").over(way) + F.col("tokens")).alias("rest"),
    )
    return summed.select("conv_id", "place", "k1", "k2", F.col("k1").bitwiseXOR(F.col("m1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("m2")).alias("p2"), "ends", "rest")


def _ends(walked: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): SHA-256 of the decimal ids of the conversations that end at a node, ascending, joined by commas.

    Ids are first sorted over all tasks by node and id and joined in chunks, so that a node where most conversations end
    is spread; a second pass streams the chunks of a node through its digest, holding one at a time.
    """
    spark = walked.sparkSession
    ids = walked.where("ends").select("k1", "k2", "conv_id")
    dealt = ids.repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size, rows = None, None, [], 0, []
        for batch in batches:
            for k1, k2, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k1, k2) != node or size > CHUNK:
                    if held:
                        rows.append((*node, first, ",".join(held)))
                    node, first, held, size = (k1, k2), conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
                rows = []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*node, first, ",".join(held)), strict=True))], schema)

    names = ["k1", "k2", "first", "ids"]
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    chunks = dealt.mapInArrow(join, "k1 long, k2 long, first long, ids string")
    parts = chunks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first")
    out = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, rows = None, None, []
        for batch in batches:
            for k1, k2, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k1, k2) != node:
                    if node is not None:
                        rows.append({"k1": node[0], "k2": node[1], "ends_sha256": state.hexdigest()})
                    node, state = (k1, k2), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if rows:
                yield pa.RecordBatch.from_pylist(rows, out)
                rows = []
        if node is not None:
            yield pa.RecordBatch.from_pylist([{"k1": node[0], "k2": node[1], "ends_sha256": state.hexdigest()}], out)

    return parts.mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def trie(rebuilt: DataFrame) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``rebuilt`` has (conv_id, place, said, tokens), place 0 being the root, as ``with_openings`` returns them.  No conversation, no
    nodes.
    """
    walked = written(paths(rebuilt), "paths")
    # Who owns a node, and what of that conversation's path.
    first = F.min(F.struct("conv_id", "rest", "p1", "p2"))
    owners = written(walked.groupBy("k1", "k2", "place").agg(first.alias("first"), F.every("ends").alias("leaf")), "owners")
    owned = owners.groupBy(F.col("first.conv_id").alias("conv_id")).agg(F.min(F.struct("place", "first.rest", "first.p1", "first.p2")).alias("top"), F.max(F.col("leaf").cast("int")).alias("leaf"))
    # The owner of the node above a conversation's first own one; its other nodes have the conversation itself above them.
    above = owners.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("first.conv_id").alias("above"))
    tops = owned.select("conv_id", F.col("top.place").alias("from"), F.col("top.rest").alias("own_rest"), "leaf", F.col("top.p1").alias("p1"), F.col("top.p2").alias("p2"))
    tops = written(tops.join(above, ["p1", "p2"], "left").drop("p1", "p2"), "tops")
    marked = walked.join(tops.select("conv_id", "from", "own_rest", "leaf"), "conv_id", "left")
    mine = F.coalesce(F.col("place") >= F.col("from"), F.lit(False))
    saved = F.when(mine, 0).otherwise(F.col("rest") - F.coalesce("own_rest", F.lit(0)))
    child = ~F.col("ends") & F.coalesce(F.col("place") + 1 >= F.col("from"), F.lit(False))
    nodes = marked.groupBy("k1", "k2", F.col("place").cast("long").alias("depth")).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(child.cast("long")).alias("n_children"),
        F.sum(F.coalesce(F.col("leaf").cast("long"), F.lit(0))).alias("n_leaves"), F.sum(saved).alias("saved_tokens"),
    )
    named = nodes.join(tops.select("conv_id", "from", "above"), "conv_id", "left")
    parent = F.when(F.col("depth") > 0, F.when(F.col("depth") > F.col("from"), F.col("conv_id")).otherwise(F.col("above")))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return named.join(_ends(walked), ["k1", "k2"], "left").select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) as they are."""
    return trie(with_openings(turns(conversations), F.col("conv_id"), F.lit(0), 0))
