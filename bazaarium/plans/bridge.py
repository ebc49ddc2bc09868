"""The driver's tables seen as offers, prices, reviews, watches and queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Raw queries, by the part's key.
RAW_QUERIES = (
    "Айфон 15 Про", "кроссовки найк", "  iPhone 15!!  ", "лодка и яблоко", "ноутбук asus 15 i5 16gb", "наушники сони", "айвон 15",
    "ps 5", "беспроводные наушники", "айфон + наушники", "телевизор samsung, мука", "стол", "макбук эйр", "колонка и микроволновка", "рюкзак", "сяоми редми",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as offers; the part's name is the query."""
    line, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    joined = line.join(part, line["l_partkey"] == part["p_partkey"]).join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
    kind = F.col("l_suppkey") % 4
    source = F.when(kind == 0, "wb").when(kind == 1, "ozon").when(kind == 2, "ya_market").otherwise("runet")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return joined.select(
        F.col("p_name").alias("query_id"), source.alias("source"), F.col("l_partkey").cast("string").alias("item_id"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("p_size").cast("string")).alias("name"), price.alias("price"), F.lit("RUB").alias("currency"),
        F.concat(F.lit("https://shop"), (F.col("l_suppkey") % 20).cast("string"), F.lit(".example/"), F.col("l_partkey").cast("string")).alias("url"),
        F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("Тип"), F.col("p_type"), F.lit("Размер"), F.col("p_size").cast("string")).alias("characteristics"),
        F.col("s_name").alias("seller"), F.when(F.col("l_linenumber") != 7, F.lit(1.0) + ((F.col("l_partkey") + F.col("l_suppkey")) % 41) / F.lit(10.0)).alias("rating"),
        F.when(F.col("l_linenumber") != 6, (F.col("l_orderkey") % 5000).cast("int")).alias("reviews_count"), F.col("l_shipdate").alias("fetched_at"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price.alias("l_price")).alias("pos"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


OFFERS_SQL = """offers AS (
  SELECT p_name AS query_id, CASE l_suppkey % 4 WHEN 0 THEN 'wb' WHEN 1 THEN 'ozon' WHEN 2 THEN 'ya_market' ELSE 'runet' END AS source,
    CAST(l_partkey AS VARCHAR) AS item_id, concat_ws(' ', p_name, p_brand, p_type, CAST(p_size AS VARCHAR)) AS name,
    CAST(l_extendedprice AS DECIMAL(12,2)) AS price, 'https://shop' || (l_suppkey % 20) || '.example/' || l_partkey AS url,
    p_brand, p_type, p_size, s_name AS seller,
    CASE WHEN l_linenumber <> 7 THEN CAST(1.0 AS DOUBLE) + ((l_partkey + l_suppkey) % 41) / CAST(10.0 AS DOUBLE) END AS rating,
    CASE WHEN l_linenumber <> 6 THEN CAST(l_orderkey % 5000 AS INT) END AS reviews_count, l_shipdate AS fetched_at,
    l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
)"""
#: Order of arrival in SQL.
POS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, price"


def price_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as price points."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("item_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("decimal(12,2)").alias("price"))


POINTS_SQL = "points AS (SELECT event_type AS source, CAST(user_id AS VARCHAR) AS item_id, ts, CAST(value AS DECIMAL(12,2)) AS price FROM events)"


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reviews of one of their sources' items, labelled by quality and toxicity."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return d.join(labels, "doc_id", "left").select(
        F.col("source").alias("item_id"), F.col("doc_id").alias("pos"), F.col("lang").alias("author"), "text", label.alias("label"),
        (F.col("n_chars") % 50).cast("int").alias("pluses"), ((F.col("doc_id") % 97) / F.lit(97.0)).alias("score"), (F.col("n_chars") % 5 + 1).cast("int").alias("rating"),
        F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") * 86_400 + 1_600_000_000).cast("string")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("2024-02-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("T10:00:00Z"))).otherwise(F.lit("вчера")).alias("published_at"),
    )


REVIEWS_SQL = """reviews AS (
  SELECT source AS item_id, doc_id AS pos, lang AS author, text, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label,
    CAST(n_chars % 50 AS INT) AS pluses, (doc_id % 97) / CAST(97.0 AS DOUBLE) AS score, CAST(n_chars % 5 + 1 AS INT) AS rating,
    CASE WHEN doc_id % 3 = 0 THEN doc_id * 86400 + 1600000000 WHEN doc_id % 3 = 1 THEN epoch(TIMESTAMP '2024-02-01 10:00:00' + to_days(CAST(doc_id % 9 AS INT))) END AS dated
  FROM documents LEFT JOIN labels USING (doc_id)
)"""


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as checks of watches: one watch for each user and type; every tenth check finds no offer."""
    e = table(spark, sf_dir, "events")
    price = F.when(F.col("event_id") % 10 != 0, F.col("value").cast("decimal(12,2)"))
    return e.select(F.concat_ws("/", "user_id", "event_type").alias("watch_id"), F.col("event_id").alias("check_id"), F.col("ts").cast("timestamp").alias("check_ts"), price.alias("best_price"), F.lit(2.0).alias("threshold_pct"))


CHECKS_SQL = "checks AS (SELECT user_id || '/' || event_type AS watch_id, event_id AS check_id, ts AS check_ts, CASE WHEN event_id % 10 <> 0 THEN CAST(value AS DECIMAL(12,2)) END AS best_price FROM events)"


def watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as watches."""
    c = table(spark, sf_dir, "customer")
    last = F.when(F.col("c_custkey") % 7 != 0, F.timestamp_add("MINUTE", (-(F.col("c_custkey") % 600)).cast("int"), F.lit("2024-03-01 00:00:00").cast("timestamp")))
    return c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("user-"), (F.col("c_custkey") % 100).cast("string")).alias("owner_key"), F.col("c_mktsegment").alias("query"), (F.col("c_custkey") % 240 + 1).cast("int").alias("interval_min"), (F.col("c_custkey") % 5 != 0).alias("active"), last.alias("last_check_at"))


WATCHES_SQL = "watches AS (SELECT c_custkey AS id, 'user-' || (c_custkey % 100) AS owner_key, c_mktsegment AS query, CAST(c_custkey % 240 + 1 AS INT) AS interval_min, c_custkey % 5 <> 0 AS active, CASE WHEN c_custkey % 7 <> 0 THEN TIMESTAMP '2024-03-01' - to_minutes(c_custkey % 600) END AS last_check_at FROM customer)"


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw queries, one for each part."""
    raw = F.element_at(F.array(*[F.lit(q) for q in RAW_QUERIES]), (F.col("p_partkey") % len(RAW_QUERIES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.concat(raw, F.when(F.col("p_partkey") % 32 < 16, F.concat(F.lit(" "), F.col("p_name"))).otherwise("")).alias("raw"))


QUERIES_SQL = f"queries AS (SELECT p_partkey AS query_id, list_extract([{', '.join(repr(q) for q in RAW_QUERIES)}], CAST(p_partkey % {len(RAW_QUERIES)} + 1 AS INT)) || CASE WHEN p_partkey % 32 < 16 THEN ' ' || p_name ELSE '' END AS raw FROM part)"
