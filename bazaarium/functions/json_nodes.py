"""Objects inside JSON texts, in the order of the text and to any depth: a tokenizer over Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\]:]|[^\s{}\[\]:,"]+', re.DOTALL)


#: Characters of objects that one batch of results holds, more where one object alone has them.
BATCH_CHARS = 1 << 22


def objects(text: str, only: tuple[str, ...] = (), having: str | None = None) -> Iterator[tuple[int, bool, str]]:
    """(place, first, text) of each object in a JSON text that parses, as it closes; ``place`` is where it begins, ``first`` whether none begins before.

    All lists are gone through; of an object all values, or those under the keys in ``only``.  With ``having``, objects without
    that key of their own are gone through but left out.  One pass that holds the open
    objects and lists; so depth has no bound.
    """
    opened: list[tuple[int, bool]] = []
    keys: list[str | None] = []
    has: list[bool] = []
    named = bool(only) or having is not None
    last, least = "", None
    for token in _TOKEN.finditer(text):
        first = text[token.start()]
        if first == ":":
            if named:
                keys[-1] = json.loads(last) if "\\" in last else last[1:-1]
                if keys[-1] == having:
                    has[-1] = True
        elif first in "{[":
            met = not opened or opened[-1][1] and (text[opened[-1][0]] == "[" or not only or keys[-1] in only)
            opened.append((token.start(), met))
            keys.append(None)
            has.append(having is None)
            if met and first == "{" and least is None:
                least = token.start()
        elif first in "}]":
            start, met = opened.pop()
            keys.pop()
            if has.pop() and met and first == "}":
                yield start, start == least, text[start : token.end()]
        else:
            last = token.group()


def walk(rows: DataFrame, keep: list[str], text: str, only: tuple[str, ...] = (), having: str | None = None) -> DataFrame:
    """(``keep``, at, first, node) of each object in the JSON texts of ``rows``, as variants; ``at`` orders them as the text does, ``first`` marks the first.

    ``only`` and ``having`` are those of ``objects``.  Texts that do not parse (also those nested beyond 1,000 levels or with a key twice in an object) have none, null neither.
    """
    parses = rows.select(*keep, F.col(text).alias("_text")).where(F.try_parse_json("_text").isNotNull())
    schema = StructType([*parses.drop("_text").schema, *StructType.fromDDL("at int, first boolean, object string")])

    def made(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        of, at, first, texts = zip(*found, strict=True)
        kept = batch.drop_columns(["_text"]).take(pa.array(of, pa.int64()))
        return pa.RecordBatch.from_arrays([*kept.columns, pa.array(at, pa.int32()), pa.array(first, pa.bool_()), pa.array(texts, pa.string())], [f.name for f in schema])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for row, value in enumerate(batch.column("_text")):
                for at, first, inner in objects(value.as_py(), only, having):
                    held.append((row, at, first, inner))
                    size += len(inner)
                    if size > BATCH_CHARS:
                        yield made(batch, held)
                        held, size = [], 0
            if held:
                yield made(batch, held)

    found = parses.mapInArrow(find, schema)
    # Exploded, so that what reads the node's fields does not parse it anew for each.
    return found.select(*keep, "at", "first", F.explode(F.array(F.parse_json("object"))).alias("node"))


def links(value: str | None, keys: tuple[str, ...]) -> list[str]:
    """Texts that may be a value's link, in the order in which they count: of a list each item in turn, of an object those under ``keys`` in their order, at any depth."""
    try:
        left = [json.loads(value)] if value is not None else []
    except (ValueError, RecursionError):
        return []
    out = []
    while left:
        node = left.pop()
        if isinstance(node, str):
            out.append(node)
        elif isinstance(node, list):
            left += reversed(node)
        elif isinstance(node, dict):
            left += [node.get(k) for k in reversed(keys)]
    return out


def candidate_links(value: Column, keys: tuple[str, ...]) -> Column:
    """``links`` of a JSON text, as an array."""

    @F.pandas_udf("array<string>")
    def found(values: pd.Series) -> pd.Series:
        return values.map(lambda v: links(v, keys))

    return found(value)
