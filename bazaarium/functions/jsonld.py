"""JSON-LD in pages: product nodes by a walk over variants, and the fields of a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarium.functions import json_nodes
from bazaarium.functions.numbers import decimal_price
from bazaarium.functions.urls import absolute_image

BLOCK = r"(?is)<script[^>]*type=[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>"
#: Keys whose values hold further nodes.
NESTED = ("@graph", "itemListElement", "item", "mainEntity")


def blocks(html: Column) -> Column:
    """Texts of a page's JSON-LD scripts."""
    return F.regexp_extract_all(html, F.lit(BLOCK), 1)


def _text(node: Column, path: str) -> Column:
    return F.try_variant_get(node, path, "string")


def nodes(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("url",), having: str | None = None) -> DataFrame:
    """(``keep`` columns, node) of every node in a page's JSON-LD, to any depth; broken blocks give none.

    Lists are gone through; of a node's values only those under NESTED keys.  With ``having``, nodes without that key are left out.
    """
    start = pages.select(*keep, F.explode(blocks(F.col(html))).alias("_block"))
    return json_nodes.walk(start, list(keep), "_block", NESTED, having).drop("at", "first")


def products(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """The ``nodes`` that are products."""
    return nodes(pages, html, keep, "@type").where(is_product(F.col("node")))


def is_product(node: Column) -> Column:
    """Whether a node's type is Product, alone or in a list."""
    kind = F.to_json(F.try_variant_get(node, "$['@type']", "variant"))
    return F.coalesce(kind.rlike(r'^"Product"$|^\[.*"Product".*\]$'), F.lit(False))


def price(node: Column) -> Column:
    """First price that parses: of the offer, or the first of its offers, then its low price, then the node's own."""
    paths = ("$.offers.price", "$.offers[0].price", "$.offers.lowPrice", "$.offers[0].lowPrice", "$.price")
    return F.coalesce(*[decimal_price(_text(node, p)) for p in paths])


def plain_price(node: Column) -> Column:
    """Price or low price of an offer node as a plain decimal."""
    return F.coalesce(*[_text(node, p).try_cast("decimal(12,2)") for p in ("$.price", "$.lowPrice")])


# The keys of an object under which its picture may stand, in order.
PICTURE_KEYS = ("url", "contentUrl", "thumbnailUrl", "image")


def picture(value: Column) -> Column:
    """First link of a variant that is a text, an object or a list of such, in one another to any depth."""
    found = F.transform(json_nodes.candidate_links(F.to_json(value), PICTURE_KEYS), lambda u: absolute_image(u))
    return F.get(F.filter(found, lambda u: u.isNotNull()), F.lit(0))


def image(node: Column) -> Column:
    """First picture of a node: of its image, else of its thumbnail, else of the image or thumbnail of its first offer."""
    paths = ("$.image", "$.thumbnailUrl", "$.offers[0].image", "$.offers.image", "$.offers[0].thumbnailUrl", "$.offers.thumbnailUrl")
    given = [F.try_variant_get(node, p, "variant") for p in paths]
    return picture(F.coalesce(*[F.when(~F.coalesce(F.to_json(v).isin('""', "[]", "{}", "null"), F.lit(True)), v) for v in given]))


def brand(node: Column) -> Column:
    """Brand, given as text or as an object with a name; empty without one."""
    plain = _text(node, "$.brand")
    return F.coalesce(_text(node, "$.brand.name"), F.when(~F.startswith(plain, F.lit("{")), plain), F.lit(""))


def _tail(text: Column) -> Column:
    return F.element_at(F.split(text, "/"), -1)


def characteristics(node: Column) -> Column:
    """Map of a node's scalar facts, its weight, up to 30 additional properties, availability and condition.

    Names are cut to 60 characters and values to 120; the first value of a name stays.
    """
    labels = {"color": "Цвет", "material": "Материал", "model": "Модель", "mpn": "Артикул", "gtin": "Штрихкод", "sku": "SKU", "category": "Категория"}
    plain = {label: F.substring(F.trim(_text(node, f"$.{key}")), 1, 120) for key, label in labels.items()}
    plain["Вес"] = F.substring(_text(node, "$.weight"), 1, 40)
    first = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in plain.items()]
    listed = F.from_json(F.to_json(F.try_variant_get(node, "$.additionalProperty", "variant")), "array<struct<name: string, value: string>>")
    more = F.transform(F.slice(F.coalesce(listed, F.array().cast("array<struct<name: string, value: string>>")), 1, 30), lambda p: F.struct(F.substring(F.trim(p["name"]), 1, 60).alias("key"), F.substring(F.trim(p["value"]), 1, 120).alias("value")))
    last = [F.struct(F.lit(k).alias("key"), _tail(F.coalesce(_text(node, f"$.offers.{p}"), _text(node, f"$.offers[0].{p}"))).alias("value")) for k, p in (("Наличие", "availability"), ("Состояние", "itemCondition"))]
    every = F.filter(F.concat(F.array(*first), more, F.array(*last)), lambda p: (F.coalesce(p["key"], F.lit("")) != "") & (F.coalesce(p["value"], F.lit("")) != ""))
    return first_wins(every)


def first_wins(pairs: Column) -> Column:
    """Map of (key, value) pairs in which the first value of a key stays."""

    def of(found: Column) -> Column:
        keys = F.array_distinct(F.transform(found, lambda p: p["key"]))
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(found, lambda p: p["key"] == k), 1)["value"].alias("value"))))

    # As the variable of a function, or the pairs would be made anew for each key.
    return F.get(F.transform(F.array(pairs), of), F.lit(0))
