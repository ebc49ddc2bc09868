"""Queries over parts of the library that need no tables of their own, each with its SQL (DuckDB)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarium import api
from bazaarium.functions import pricing
from bazaarium.operators import facets, normalize, reviews, watches
from bazaarium.plans import bridge
from bazaarium.plans.payloads import OFFERS, query
from bazaarium.sources import sinks

_SCORED = f"""scored AS (SELECT *, count(*) OVER q AS n, avg(CAST(price AS DOUBLE)) OVER q AS mu, stddev_samp(CAST(price AS DOUBLE)) OVER q AS sd FROM offers WINDOW q AS (PARTITION BY query_id)),
zed AS (SELECT *, CASE WHEN n < 2 THEN 0 ELSE (CAST(price AS DOUBLE) - mu) / CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE sd END END AS z FROM scored),
valued AS (SELECT *, CAST(-0.4 * z + 0.25 * coalesce(rating, 0) / 5 + 0.15 * 0.5 - 0.05 * 3 / 30 AS DOUBLE) AS s FROM zed)"""


@query(f"WITH {OFFERS}, {_SCORED} SELECT query_id, CAST(rank AS BIGINT) AS rank, source, round(s, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, {bridge.POS}) AS rank FROM valued) WHERE rank <= 5")
def agent_top_deals(spark, sf):
    """An agent that asks for more than five deals gets five."""
    return api.get_top_deals(bridge.offers(spark, sf), 9).select("query_id", F.col("rank").cast("long").alias("rank"), "source", "score")


@query(f"WITH {OFFERS}, v AS (SELECT query_id, p_type AS value, count(*) AS offers, count(*) OVER (PARTITION BY query_id) AS n FROM offers GROUP BY 1, 2) SELECT query_id, value, offers FROM v WHERE n >= 2 AND lower(value) LIKE '%an%'")
def facet_value_search(spark, sf):
    found = facets.search_values(facets.dynamic(bridge.offers(spark, sf)), "aN")
    return found.select("query_id", "value", "offers")


@query("SELECT p_partkey AS query_id, CASE WHEN p_partkey % 3 = 0 THEN 'стул' ELSE 'стол' END AS normalized, CASE WHEN p_partkey % 3 = 0 THEN 'опечатка: «стол» → «стул»' ELSE '' END AS said FROM part")
def spelled_queries(spark, sf):
    """A spelling corrector given from outside is asked after typos of brands; where it gives nothing the text stays."""
    k = F.col("p_partkey")
    raw = bridge.table(spark, sf, "part").select(k.alias("query_id"), F.concat(F.when(k % 3 == 0, "Стол").otherwise("стол"), F.when(k % 2 == 0, " ").otherwise("")).alias("raw"))
    corrector = lambda text: F.when(F.col("query_id") % 3 == 0, F.replace(text, F.lit("стол"), F.lit("стул"))).when(F.col("query_id") % 3 == 1, "")
    found = normalize.normalized(raw, spelling=corrector)
    return found.select("query_id", "normalized", F.array_join("expansions", "; ").alias("said"))


@query(f"WITH {OFFERS} SELECT coalesce(source, 'offers') AS counter, count(*) AS offers FROM offers GROUP BY GROUPING SETS ((), (source)) UNION ALL SELECT 'priced', count(*) FROM offers WHERE price > 0")
def observed_offers(spark, sf):
    """Counters that fill while the offers are used."""
    rows, seen = sinks.observed(bridge.offers(spark, sf))
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(k.removesuffix("_offers"), v) for k, v in seen.get.items()], "counter string, offers long")


@query(f"WITH {OFFERS} SELECT DISTINCT source, image, source || '/' || sha1(image) AS key FROM (SELECT source, 'https://' || CASE l_suppkey % 3 WHEN 0 THEN 'img.ozon.ru' WHEN 1 THEN 'YANDEX.net' END || '/' || l_partkey AS image FROM offers) WHERE image IS NOT NULL")
def kept_pictures(spark, sf):
    host = F.when(F.col("l_suppkey") % 3 == 0, "img.ozon.ru").when(F.col("l_suppkey") % 3 == 1, "YANDEX.net").otherwise("fakeozon.ru")
    return sinks.image_cache_keys(bridge.offers(spark, sf).withColumn("image", F.concat(F.lit("https://"), host, F.lit("/"), F.col("l_partkey").cast("string"))))


@query(f"WITH {OFFERS} SELECT l_orderkey, l_linenumber, CAST(CASE l_orderkey % 4 WHEN 0 THEN l_linenumber WHEN 1 THEN 10 + l_linenumber WHEN 2 THEN 20 + l_linenumber ELSE 0 END AS INT) AS reviews FROM offers")
def reviews_among_characteristics(spark, sf):
    """Counts of reviews under any of their keys; zeros, texts and missing ones are passed over."""
    k, n = F.col("l_orderkey") % 4, F.col("l_linenumber")
    table = lambda **x: F.create_map(*[c for key, v in x.items() for c in (F.lit(key), v.cast("string"))])
    given = F.when(k == 0, table(feedbacks=n, reviews=F.lit(9))).when(k == 1, table(feedbacks=F.lit(0), reviews=10 + n)).when(k == 2, table(feedbacks=F.lit("many"), rating_count=20 + n)).otherwise(table(other=n))
    return bridge.offers(spark, sf).select("l_orderkey", "l_linenumber", pricing.reviews_of(given).alias("reviews"))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 = 0 AND o_orderstatus <> 'F' AND o_orderkey % 3 = 0 AND o_orderkey < 100 THEN 'now' WHEN o_orderstatus = 'F' THEN 'before' ELSE 'unread' END AS state FROM orders")
def marked_alerts(spark, sf):
    """One owner's unread alerts, of those named, are read now; all others stay."""
    o = bridge.table(spark, sf, "orders")
    alerts = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 5 == 0, "me").otherwise("you").alias("owner_key"), F.when(F.col("o_orderstatus") == "F", F.lit("2024-01-01").cast("timestamp")).alias("read_at"))
    found = watches.mark_read(alerts, "me", F.lit("2024-02-02").cast("timestamp"), list(range(0, 100, 3)))
    state = F.when(F.col("read_at") == F.lit("2024-02-02").cast("timestamp"), "now").when(F.col("read_at").isNotNull(), "before").otherwise("unread")
    return found.select("id", state.alias("state"))


@query("""SELECT doc_id, text, CASE WHEN length(text) % 2 = 0 THEN 'positive' ELSE 'negative' END AS label, CAST(length(text) AS DOUBLE) AS score FROM (SELECT doc_id, trim(concat_ws(' ', nullif(trim(lang), ''), nullif(trim(source), ''))) AS text FROM documents)""")
def classified_reviews(spark, sf):
    """Reviews joined from their parts, with the label and score of a model given from outside; equal texts are asked once."""
    d = bridge.table(spark, sf, "documents").select("doc_id", reviews.joined_text(F.col("lang"), F.lit(" "), F.col("source")).alias("text"))
    model = lambda text: F.struct(F.when(F.length(text) % 2 == 0, "positive").otherwise("negative").alias("label"), F.length(text).cast("double").alias("score"))
    return reviews.classified(d, model).select("doc_id", "text", "label", "score")
