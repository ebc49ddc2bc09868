"""Places within groups and exact medians where a group may be any share of the table.

A window over a group's key alone sorts the group in one task, and ``median`` keeps all its values there.  Here rows are
dealt by range over key and order, so a large group spans as many tasks as it needs; what is carried from one task to
the next is a row for each key and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarium.session import stored

#: Ranges of values to a doubling.
RANGES = 16


def placed(rows: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their number from 1 within ``keys`` by ``order``; null keys are a group, equal rows come in any order.

    Rows are sorted over all tasks and written once to the shared folder, each with its task and number there; the first
    numbers of a key in each task and the counts of the tasks before give its place.
    """
    columns = [c for c in rows.columns if c != name]
    rows = rows.select(*columns)
    dealt = rows.repartitionByRange(*[F.col(k) for k in keys], *order).sortWithinPartitions(*[F.col(k) for k in keys], *order)
    sorted_rows = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "placed")
    task = F.shiftright("_at", 33)
    firsts = sorted_rows.groupBy(*keys, task.alias("_task")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)  # one row for each task
    shifts = firsts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_task", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    # Written too: Spark then knows when it plans that they are few, and does not deal out all rows again.
    shifts = stored(shifts, "shifts")
    joined = sorted_rows.withColumn("_in", task).join(shifts, [F.col("_in") == F.col("_task"), *on])
    return joined.select(*columns, (F.col("_at") + F.col("_shift")).alias(name))


def medians(rows: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(``keys``, ``name``): the exact median of each group's values that are not null; groups without any are left out.

    Values are counted, their counts summed by range of values (a few hundred rows for each group), and only the ranges with
    the middle are gone through in order.
    """
    v = F.col(value)
    width = F.signum(v) * F.floor(F.log2(F.abs(v.cast("double")) + 1) * RANGES)
    counts = rows.where(v.isNotNull()).groupBy(*keys, v.alias("_v"), width.cast("int").alias("_range")).agg(F.count("*").alias("_n"))
    whole, before = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = counts.groupBy(*keys, "_range").agg(F.sum("_n").alias("_m")).withColumn("_all", F.sum("_m").over(whole)).withColumn("_upto", F.sum("_m").over(before))
    low, high = F.floor((F.col("_all") + 1) / 2), F.ceil((F.col("_all") + 1) / 2)
    middle = totals.where((F.col("_upto") >= low) & (F.col("_upto") - F.col("_m") < high)).select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_range").alias("_of_range"), low.alias("_low"), high.alias("_high"), (F.col("_upto") - F.col("_m")).alias("_before"))
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] + [F.col("_range").eqNullSafe(F.col("_of_range"))]
    near = counts.join(middle, on)
    place = F.col("_before") + F.sum("_n").over(W.partitionBy(*keys, "_range").orderBy("_v"))
    found = near.withColumn("_place", place).where((F.col("_place") >= F.col("_low")) & (F.col("_place") - F.col("_n") < F.col("_high")))
    halves = [F.max(F.when((F.col("_place") >= F.col(end)) & (F.col("_place") - F.col("_n") < F.col(end)), F.col("_v").cast("double"))) * 0.5 for end in ("_low", "_high")]
    return found.groupBy(*keys).agg((halves[0] + halves[1]).alias(name))
