"""The Spark session the library expects."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "bazaarium", **conf: str) -> SparkSession:
    """A session in UTC with adaptive plans; other settings stay the cluster's own."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local master, as in tests, may do without that setting; elsewhere its lack is an error, as files would be lost.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or "file:///tmp/checkpoints/bazaarium").rstrip("/")


def stored(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` written once to the shared folder and read from there: nothing is computed twice, and lineage ends."""
    path = f"{shared_dir(rows.sparkSession)}/{label}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
