"""Parsers of captured payloads over the driver's pages and over card texts made from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarium.functions import jsonld
from bazaarium.plans import bridge
from bazaarium.sources import captures


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-LD blocks of each page, and whether it has a title."""
    p = bridge.table(spark, sf_dir, "pages")
    return p.select("page_id", F.size(jsonld.blocks(F.col("html"))).alias("blocks"), F.contains(F.lower("html"), F.lit("<title")).alias("titled"), F.octet_length("html").cast("long").alias("n_bytes"))


def shopping_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card texts made from parts, parsed back."""
    p = bridge.table(spark, sf_dir, "part")
    price = F.replace(F.format_number(F.floor("p_retailprice"), 0), F.lit(","), F.lit(" "))
    rating = F.replace(F.format_number(F.lit(1.0) + (F.col("p_partkey") % 40) / 10, 1), F.lit("."), F.lit(","))
    count = F.replace((F.col("p_size") / 10).cast("decimal(5,1)").cast("string"), F.lit("."), F.lit(","))
    ram = (F.col("p_partkey") % 3 + 1) * 8
    card = p.select("p_partkey", F.concat(F.lit("Samsung Galaxy "), ram.cast("string"), F.lit(" ГБ ОЗУ, "), F.col("p_name")).alias("title"), F.concat(price, F.lit(" ₽\nМагазин\n"), rating, F.lit(" ("), count, F.lit(" тыс)")).alias("text"), F.lit("dns").alias("seller"), F.col("p_partkey").cast("string").alias("query"))
    found = captures.shopping_offers(card)
    return found.select(F.col("query").cast("long").alias("p_partkey"), F.col("price").cast("double").alias("price"), "rating", F.col("reviews_count"), F.col("characteristics")["Бренд"].alias("brand"), F.col("characteristics")["ОЗУ"].alias("ram"))
