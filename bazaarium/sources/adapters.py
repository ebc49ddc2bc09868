"""Captured payloads as a data source, and adapters that turn each kind of payload into offers of one schema.

``spark.read.format("captures").option("path", ..).load()`` reads the files of a folder that ``keep`` has written.  The options
``kinds`` and ``sources`` (JSON lists) choose files, so others stay unread; ``since`` and ``until`` (times of capture, the end not
included) go to the scan of a file.  The reader takes no filters: Spark 4.1 keeps what it pushes with the relation, so a
plan that uses one relation twice with two filters would get the rows of the last filter for both.

An adapter names the kind it reads and parses it; ``offers`` runs adapters and gives every result the same columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from bazaarium.sources import captures

SCHEMA = "url string, captured_at timestamp, payload string, kind string, source string"
_LAYOUT = ds.partitioning(pa.schema([("kind", pa.string()), ("source", pa.string())]), flavor="hive")


def keep(payloads: DataFrame, path: str) -> None:
    """Add payloads (the columns of SCHEMA) to a folder, with kind and source as folders in it."""
    payloads.select("url", "captured_at", "payload", "kind", "source").write.mode("append").partitionBy("kind", "source").parquet(path)


def _opened(path: str) -> ds.Dataset:
    fs, root = pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)
    return ds.dataset(root, filesystem=fs, format="parquet", partitioning=_LAYOUT, exclude_invalid_files=False)


@dataclass
class File(InputPartition):
    """One file and the values of its folders."""

    name: str
    kind: str | None
    source: str | None


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.wanted = {c: json.loads(options[f"{c}s"]) for c in ("kind", "source") if options.get(f"{c}s")}
        self.since, self.until = (options.get(c) and datetime.fromisoformat(options[c]) for c in ("since", "until"))

    def partitions(self) -> list[InputPartition]:
        out = []
        for fragment in _opened(self.path).get_fragments():
            own = ds.get_partition_keys(fragment.partition_expression)
            if all(own.get(column) in values for column, values in self.wanted.items()):
                out.append(File(fragment.path, own.get("kind"), own.get("source")))
        return out or [File("", None, None)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs = pafs.FileSystem.from_uri(self.path)[0] if ":" in self.path else pafs.LocalFileSystem()
        with fs.open_input_file(partition.name) as raw:
            # Page by page: a dataset's scan holds whole groups of rows, and several of them.
            file = pq.ParquetFile(raw, buffer_size=1 << 20, pre_buffer=False)
            for batch in file.iter_batches(batch_size=1000, columns=["url", "captured_at", "payload"], use_threads=False):
                yield from self._wanted(batch, partition)

    def _wanted(self, batch: pa.RecordBatch, partition: File) -> Iterator[pa.RecordBatch]:
        for moment, compare in ((self.since, pc.greater_equal), (self.until, pc.less)):
            if moment:
                at = batch.column("captured_at").cast(pa.timestamp("us", "UTC"))
                batch = batch.filter(compare(at, pa.scalar(moment, pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))))
        n = batch.num_rows
        if n:
            at = batch.column("captured_at").cast(pa.timestamp("us", "UTC"))
            yield pa.RecordBatch.from_arrays([batch.column("url"), at, batch.column("payload"), pa.array([partition.kind] * n, pa.string()), pa.array([partition.source] * n, pa.string())], ["url", "captured_at", "payload", "kind", "source"])


class CaptureSource(DataSource):
    """The format ``captures``; its option ``path`` names the folder."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(dict(self.options))


def captured(spark: SparkSession, path: str, kinds: list[str] | None = None, sources: list[str | None] | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Payloads kept in a folder, of the kinds and sources named, captured from ``since`` (UTC) and before ``until``."""
    spark.dataSource.register(CaptureSource)
    load = spark.read.format("captures").option("path", path)
    for name, value in (("kinds", kinds), ("sources", sources)):
        load = load.option(name, json.dumps(value)) if value is not None else load
    for name, moment in (("since", since), ("until", until)):
        load = load.option(name, moment.isoformat()) if moment is not None else load
    return load.load()


OFFER = "source string, url string, item_id string, name string, price decimal(12,2), image string, characteristics map<string, string>, seller string, rating double, reviews_count int, captured_at timestamp"


@dataclass(frozen=True)
class Adapter:
    """How one kind of payload of one source becomes offers: ``parse`` takes payloads and returns any columns of OFFER."""

    kind: str
    source: str
    parse: Callable[[DataFrame], DataFrame]

    def offers(self, payloads: DataFrame) -> DataFrame:
        """Offers of the adapter's own payloads, with the columns of OFFER; what it does not know is null."""
        own = payloads.where((F.col("kind") == self.kind) & (F.col("source") == self.source))
        found = self.parse(own)
        fields = [f.split(" ", 1) for f in OFFER.replace("map<string, string>", "map<string;string>").split(", ")]
        return found.select(*[(F.col(c) if c in found.columns else F.lit(None)).cast(k.replace(";", ", ")).alias(c) if c != "source" else F.lit(self.source).alias(c) for c, k in fields])


def _widgets(payloads: DataFrame) -> DataFrame:
    return captures.widget_offers(captures.widget_stubs(payloads, "payload", "captured_at"))


def _catalogue(payloads: DataFrame) -> DataFrame:
    found = captures.catalogue_offers(captures.catalogue_stubs(payloads, "payload", "captured_at"))
    return found.withColumn("seller", F.col("supplier"))


#: Adapters by source; callers add their own with ``register``.
ADAPTERS: dict[str, Adapter] = {}


def register(adapter: Adapter) -> Adapter:
    """Make an adapter known; a later one of the same source takes its place."""
    ADAPTERS[adapter.source] = adapter
    return adapter


register(Adapter("catalogue", "wb", _catalogue))
register(Adapter("widgets", "ozon", _widgets))
register(Adapter("market_pages", "ya_market", lambda p: captures.market_offers(p, "payload")))
register(Adapter("product_pages", "runet", lambda p: captures.page_offers(p, "payload")))


def offers(spark: SparkSession, path: str, sources: list[str] | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Offers in a folder of payloads by the adapters of all registered sources, or of those named; a name without an adapter is an error.

    Each adapter's files are read alone.
    """
    wanted = sources if sources is not None else list(ADAPTERS)
    unknown = [s for s in wanted if s not in ADAPTERS]
    if unknown:
        raise ValueError(f"no adapter for {', '.join(unknown)}; there are {', '.join(sorted(ADAPTERS))}")
    out = spark.createDataFrame([], OFFER)
    for adapter in (ADAPTERS[s] for s in wanted):
        out = out.unionByName(adapter.offers(captured(spark, path, [adapter.kind], [adapter.source], since, until)))
    return out
