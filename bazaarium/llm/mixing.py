"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words.

Targets: sources in order of code points, null last, weigh 5, 2, 1, repeating; they share all words, a source that
would be read more than ``cap`` times stops there and the excess goes to the others by weight.

Each source's documents are shuffled (by a digest of their ids) and laid end to end on an axis that is cut into blocks
of ``block`` words.  Slot j of the schedule takes the golden-ratio point frac(j / phi), and the source whose interval of
cumulative weights holds it; the k-th slot of a source reads its k-th block, beginning anew after the last.  A source
stops at its target: its last block is cut there, and the few slots by which the schedule falls short come at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarium.llm.tables import numbered, written

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 1024
#: Documents of a source are laid out in so many parts, so no window holds a whole source.
PARTS_HEX = 3
#: Slots that are ranked together.
CHUNK = 1 << 16
#: 2**32 over the golden ratio, the multiplier of the schedule.
GOLDEN = 2654435769
CELL = 1 << 20


def n_words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target, quota) by filling up to a level; a source with no words has target 0.

    ``quota`` is the target in whole words.  One row per source: the only windows without a key are over these.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), turn + 1).cast("long")).withColumn("most", F.col("source_size") * CAP)
    # In order of the level at which a source is full, those before it are full already.
    fill = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    used, gone = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("most", "weight"))
    level = (F.sum("source_size").over(whole) - used) / (F.sum("weight").over(whole) - gone)
    leveled = weighed.withColumn("level", level).withColumn("full", F.col("most") / F.col("weight") <= F.col("level"))
    common = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("most") / F.col("weight"))).over(whole)
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight") * common)
    return leveled.withColumn("target", target).select("source", "source_size", "target", F.floor("target").cast("long").alias("quota"))


def on_axis(sized: DataFrame) -> DataFrame:
    """Add ``start``: where a document begins on the shuffled axis of its source.  Sums of parts, then within parts."""
    parted = sized.withColumn("part", F.substring("shuffled", 1, PARTS_HEX))
    parts = parted.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = parts.select(F.col("source").alias("name"), F.col("part").alias("of_part"), F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("source", "part").orderBy("shuffled", "doc_id", "row").rowsBetween(W.unboundedPreceding, -1)
    offset = parted.withColumn("offset", F.coalesce(F.sum("size").over(within), F.lit(0)))
    on = F.col("source").eqNullSafe(F.col("name")) & (F.col("part") == F.col("of_part"))
    return offset.join(bases, on).select(*sized.columns, (F.col("offset") + F.col("base")).alias("start"))


def schedule(goals: DataFrame, total: int, block: int = BLOCK_WORDS) -> DataFrame:
    """(slot, source, rank, block_no, words): which block each slot reads and how many of its words.

    ``goals`` comes from ``targets``; ``total`` is the number of words to take.  Sources are found by equal cells of
    the unit interval, so the join is on a cell number whatever the number of sources.
    """
    spark = goals.sparkSession
    last_pass = F.col("quota") % F.col("source_size")
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    need = F.floor(F.col("quota") / F.col("source_size")).cast("long") * blocks + F.ceil(last_pass / block).cast("long")
    wanted = goals.where("quota > 0").withColumn("blocks", blocks).withColumn("need", need)
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    upto = F.sum("quota").over(by_name.rowsBetween(W.unboundedPreceding, W.currentRow))
    share = F.sum("quota").over(W.partitionBy())
    edge = F.round(upto / share * (1 << 32)).cast("long")
    wanted = wanted.withColumn("hi", edge).withColumn("lo", F.coalesce(F.lag("hi").over(by_name), F.lit(0)))

    cells = wanted.where("hi > lo").select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / CELL), F.floor((F.col("hi") - 1) / CELL))).alias("cell"))
    j = F.col("id") % (1 << 32)
    high, low = F.shiftright(j, 16), j.bitwiseAND(0xFFFF)
    point = ((high * GOLDEN % (1 << 32)) * (1 << 16) + low * GOLDEN) % (1 << 32)
    slots = spark.range(-(-total // block)).select(F.col("id").alias("slot"), point.alias("point"))
    found = slots.withColumn("cell", F.floor(F.col("point") / CELL)).join(cells, "cell").where("point >= lo AND point < hi")

    chunked = found.select("slot", "source", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = chunked.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select(F.col("source").alias("name"), F.col("chunk").alias("of_chunk"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = chunked.withColumn("at", F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1)
    same_source = F.col("source").eqNullSafe(F.col("name"))
    dealt = ranked.join(bases, same_source & (F.col("chunk") == F.col("of_chunk"))).select("slot", "source", (F.col("at") + F.col("base")).alias("rank"))

    got = counts.groupBy(F.col("source").alias("name")).agg(F.sum("n").alias("got"))
    short = wanted.join(got, same_source, "left").select("source", F.coalesce("got", F.lit(0)).alias("got"), "need").where("got < need")
    tail = short.select(F.lit(-(-total // block)).cast("long").alias("slot"), "source", F.explode(F.sequence("got", F.col("need") - 1)).alias("rank"))

    facts = wanted.select(F.col("source").alias("name"), "source_size", "quota", "blocks", "need")
    every = dealt.unionByName(tail)
    every = every.join(facts, same_source).where("rank < need")
    number = F.col("rank") % F.col("blocks")
    at = F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size") + number * block
    words = F.least(F.lit(block), F.col("source_size") - number * block, F.col("quota") - at)
    return every.select("slot", "source", "rank", number.alias("block_no"), words.cast("long").alias("words"))


def pieces(axis: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(row, doc_id, source, block_no, lo, hi): the words [lo, hi) of a block that come from a document."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    cut = axis.where("size > 0").withColumn("block_no", F.explode(F.sequence(first, last)))
    at = F.col("block_no") * block
    return cut.select("row", "doc_id", "source", "block_no", F.greatest(F.col("start") - at, F.lit(0)).alias("lo"), F.least(F.col("start") + F.col("size") - at, F.lit(block)).alias("hi"))


def sized_documents(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(row, doc_id, source, size, shuffled), written once; ``row``, a column's name or the place, tells equal ids apart."""
    doc_id = docs["doc_id"].cast("long")
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return written(docs.select((docs[row] if row else F.monotonically_increasing_id()).alias("row"), doc_id.alias("doc_id"), docs["source"], n_words(docs["text"]).alias("size"), digest.alias("shuffled")), "sized")


def mixed_blocks(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself: (slot, source, rank, doc_id, row, lo, hi), the words of a block each slot reads, in slot order."""
    sized = sized_documents(docs)
    goals = written(targets(sized), "targets")
    total = goals.agg(F.sum("quota")).first()[0] or 0
    slots, parts = schedule(goals, total, block), pieces(on_axis(sized), block)
    slots = slots.withColumnsRenamed({"source": "name", "block_no": "number"})
    on = F.col("source").eqNullSafe(F.col("name")) & (F.col("block_no") == F.col("number")) & (F.col("words") > F.col("lo"))
    return slots.join(parts, on).select("slot", "source", "rank", "doc_id", "row", "lo", F.least("hi", "words").alias("hi"))


def mixture(docs: DataFrame, block: int = BLOCK_WORDS, row: str | None = None) -> DataFrame:
    """(row, doc_id, size, source_size, target, taken) for every row of ``docs``.

    A null text has size 0 and is taken 0 times; a null source is a source of its own, the last.  Rows with equal ids are
    told apart by their place.  An empty table gives an empty result.  ``taken`` is at most CAP times the size, and each
    source's sum is its target in whole words.
    """
    sized = sized_documents(docs, row)
    goals = written(targets(sized), "targets")
    total = goals.agg(F.sum("quota")).first()[0] or 0
    slots = schedule(goals, total, block)
    # What the slots take of a block: whole readings, and the cut one at a source's target.
    full = F.col("words") >= F.least(F.lit(block), F.col("source_size") - F.col("block_no") * block)
    sizes = goals.select(F.col("source").alias("name"), "source_size")
    same_source = F.col("source").eqNullSafe(F.col("name"))
    slots = slots.join(sizes, same_source).withColumn("full", full)
    reads = slots.groupBy(F.col("source").alias("name"), F.col("block_no").alias("number")).agg(F.count_if("full").alias("whole"), F.coalesce(F.max(F.when(~F.col("full"), F.col("words"))), F.lit(0)).alias("part"))
    parts = pieces(on_axis(sized), block)
    n = F.col("hi") - F.col("lo")
    taken = F.col("whole") * n + F.greatest(F.lit(0), F.least(n, F.col("part") - F.col("lo")))
    took = parts.join(reads, same_source & (F.col("block_no") == F.col("number"))).groupBy("row").agg(F.sum(taken).alias("taken"))
    out = sized.join(took, "row", "left")
    facts = goals.select(F.col("source").alias("name"), "source_size", "target")
    out = out.join(facts, same_source)
    return out.select("row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def repeated(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, all columns: each as often as its words are taken, rounded.

    Rows of size 0 and rows taken less than half go.
    """
    plain, own = numbered(docs)
    placed = written(plain.select("*", F.monotonically_increasing_id().alias("_row")), "placed")
    read = [F.col(own[docs.columns.index(c)]).alias(c) for c in ("doc_id", "source", "text")]
    plan = mixture(placed.select(*read, "_row"), block, row="_row")
    times = plan.where("size > 0").select(F.col("row").alias("_row"), F.round(F.col("taken") / F.col("size")).cast("int").alias("_times"))
    return placed.join(times.where("_times > 0"), "_row").withColumn("_time", F.explode(F.sequence(F.lit(1), "_times"))).select(*own).toDF(*docs.columns)
