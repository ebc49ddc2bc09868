"""Fields of variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(node: Column, path: str) -> Column:
    """Text of a node's field; null where it is none, an object or a list."""
    inner = F.try_variant_get(node, path, "variant")
    return F.when(F.schema_of_variant(inner).rlike("^(?!OBJECT|ARRAY)"), F.try_variant_get(node, path, "string"))


def is_object(node: Column) -> Column:
    return F.schema_of_variant(node).startswith("OBJECT")
