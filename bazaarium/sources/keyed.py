"""A table of rows by key that is changed by appending: upserts, deletions, old states, compaction.

A change writes its rows in a folder of their own and then one small file of a log, by a rename that fails if that number
is taken; a change whose log file is missing has not happened, so a write that breaks off leaves nothing to see.  A row of a
later change stands for earlier ones of its key.  Compaction writes the rows that stand as one folder and takes the others
out of the log; changes that come meanwhile stay.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

_TRIES = 20


class KeyedTable:
    """Rows of ``schema`` under ``path``, one for each value of ``keys`` (null is a value)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self._conf)

    def _at(self, name: str):
        return self._fs.makeQualified(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"))

    def _entries(self) -> list[dict]:
        """The log's entries by number."""
        folder = self._at("log")
        if not self._fs.exists(folder):
            return []
        out = []
        for status in self._fs.listStatus(folder):
            name = status.getPath().getName()
            if name.endswith(".json") and name[0] != ".":
                stream = self._fs.open(status.getPath())
                try:
                    out.append(json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
                finally:
                    stream.close()
        return sorted(out, key=lambda e: e["version"])

    def version(self) -> int:
        """Number of the last change, 0 before the first."""
        return max((e["version"] for e in self._entries()), default=0)

    def commits(self, version: int | None = None) -> dict[str, int]:
        """Folders that count at a version, with the rank of their rows."""
        out: dict[str, int] = {}
        for e in self._entries():
            if version is None or e["version"] <= version:
                for name in e["remove"]:
                    out.pop(name, None)
                out[e["add"]] = e["rank"]
        return out

    def _log(self, name: str, remove: list[str], rank: int | None) -> int:
        """Enter a change under the next free number."""
        paths = self._jvm.org.apache.hadoop.fs
        no_options = self.spark.sparkContext._gateway.new_array(getattr(paths, "Options$Rename"), 0)
        for _ in range(_TRIES):
            version = self.version() + 1
            entry = {"version": version, "add": name, "remove": remove, "rank": version if rank is None else rank}
            draft, final = self._at(f"log/.{name}"), self._at(f"log/{version:020d}.json")
            out = self._fs.create(draft, True)
            try:
                out.write(bytearray(json.dumps(entry).encode()))
            finally:
                out.close()
            try:
                paths.FileContext.getFileContext(final.toUri(), self._conf).rename(draft, final, no_options)
                return version
            except Exception as error:
                if "FileAlreadyExists" not in str(error):
                    raise
        raise RuntimeError(f"{self.path}: {_TRIES} other changes came first")

    def _write(self, rows: DataFrame, deleted: bool) -> str:
        name = uuid.uuid4().hex
        named = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        rows.select(*named, F.lit(deleted).alias("_deleted")).write.parquet(f"{self.path}/data/commit={name}")
        return name

    def upsert(self, rows: DataFrame) -> int:
        """Put rows in, in place of those of their keys; keys are unique in ``rows``, else any row of a key stays.  The change's number."""
        return self._log(self._write(rows, False), [], None)

    def delete(self, keys: DataFrame) -> int:
        """Take out the rows of the keys in ``keys``; the change's number."""
        return self._log(self._write(keys.select(*self.keys).distinct(), True), [], None)

    def _read(self, commits: dict[str, int]) -> DataFrame:
        if not commits:
            return self.spark.createDataFrame([], self.schema).withColumn("_deleted", F.lit(False))
        names = [f.name for f in self.schema]
        whole = StructType([*self.schema.fields, StructField("_deleted", BooleanType()), StructField("commit", StringType())])
        rows = self.spark.read.option("basePath", f"{self.path}/data").schema(whole).parquet(*[f"{self.path}/data/commit={c}" for c in commits])
        ranks = self.spark.createDataFrame(list(commits.items()), "commit string, _rank long")
        ranked = rows.join(F.broadcast(ranks), "commit")  # a row for each folder in the log
        last = F.max_by(F.struct(*[n for n in names if n not in self.keys], "_deleted"), "_rank").alias("_row")
        found = ranked.groupBy(*self.keys).agg(last)
        return found.select(*[F.col(n) if n in self.keys else F.col(f"_row.{n}").alias(n) for n in names], "_row._deleted")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows that stand now, or stood after a change; groups hold the changes of a key, combined before the shuffle."""
        return self._read(self.commits(version)).where("NOT _deleted").drop("_deleted")

    def compact(self) -> int:
        """Write the rows that stand as one change in place of all so far; the states before it can no longer be read in parts."""
        commits = self.commits()
        if len(commits) < 2:
            return self.version()
        name = self._write(self._read(commits).where("NOT _deleted"), False)
        return self._log(name, list(commits), max(commits.values()))

    def orphans(self) -> list[str]:
        """Folders that no entry of the log names: of writes that broke off, or that go on just now."""
        known = {e["add"] for e in self._entries()}
        folder = self._at("data")
        names = [s.getPath().getName().removeprefix("commit=") for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(set(names) - known)
