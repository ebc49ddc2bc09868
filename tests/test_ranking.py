"""Places and medians against plain Python, with groups of any size, ties and nulls."""

import statistics
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarium.operators import offers
from bazaarium.operators.ranking import medians, placed


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    keys = ["hot"] * 3000 + [None] * 200 + [f"k{n}" for n in rng.integers(0, 300, 1500)]
    return [(k, float(round(v, 2)) if n % 11 else None, n) for n, (k, v) in enumerate(zip(keys, rng.normal(50, 400, len(keys)), strict=True))]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "k string, v double, id long").repartition(5)


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_places_equal_sorting_each_group(spark, rows, table, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        got = {r.id: r.place for r in placed(table.withColumn("place", F.lit("clash")), ["k"], [F.desc_nulls_last("v"), F.asc("id")]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = defaultdict(list)
    for k, v, i in rows:
        groups[k].append((v is None, -(v or 0), i))
    assert got == {r[2]: n for g in groups.values() for n, r in enumerate(sorted(g), 1)}


def test_medians_equal_statistics(rows, table):
    groups = defaultdict(list)
    for k, v, _ in rows:
        if v is not None:
            groups[k].append(v)
    got = {r.k: r.m for r in medians(table, ["k"], "v", "m").collect()}
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        assert got[k] == pytest.approx(statistics.median(values), rel=1e-12)


def test_medians_of_decimals_zeros_and_far_values(spark):
    values = ["0", "0.01", "0.01", "-5", "9999999999.99", "1e-9"]
    table = spark.createDataFrame([(v,) for v in values], "t string").select(F.lit(1).alias("k"), F.col("t").cast("decimal(22,9)").alias("v"))
    assert medians(table, ["k"], "v").first().median == pytest.approx((0.01 + 1e-9) / 2)
    assert medians(table.where("false"), ["k"], "v").count() == 0


def test_no_window_over_a_query_alone_holds_its_offers(spark, table):
    plan = offers.sorted_places(table.select(F.col("k").alias("query_id"), F.col("v").alias("price"), F.col("id").alias("pos")), "price_asc")._jdf.queryExecution().executedPlan().toString()
    assert "_at" in plan and "row_number" not in plan


def test_empty_table_has_no_places(table):
    assert placed(table.where("false"), ["k"], [F.asc("v")]).count() == 0
