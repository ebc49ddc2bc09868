"""SQL (DuckDB) with the meaning of the queries in ``catalog``, written apart from them."""

from __future__ import annotations

from bazaarium import values as V
from bazaarium.operators.normalize import FORMS, TERMS
from bazaarium.plans import extras, payloads  # noqa: F401
from bazaarium.plans.bridge import CHECKS_SQL, OFFERS_SQL, POINTS_SQL, POS, QUERIES_SQL, REVIEWS_SQL, WATCHES_SQL

ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
P = "CAST(price AS DOUBLE)"


def _with(*tables: str, body: str) -> str:
    return "WITH " + ", ".join(tables) + " " + body


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _map(table: dict) -> str:
    return "MAP {" + ", ".join(f"{_q(str(k)) if isinstance(k, str) else k}: {_q(v) if isinstance(v, str) else v}" for k, v in table.items()) + "}"


def _offers(body: str, *more: str) -> str:
    return _with(OFFERS_SQL, *more, body=body)


SCORED = f"""scored AS (
  SELECT *, count(*) OVER q AS n, avg({P}) OVER q AS mu, stddev_samp({P}) OVER q AS sd FROM offers WINDOW q AS (PARTITION BY query_id)
), zed AS (SELECT *, CASE WHEN n < 2 THEN 0 ELSE ({P} - mu) / CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE sd END END AS z FROM scored)"""


_TOP_TEN = f"""SELECT *, round(s, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, {POS}) AS rank FROM (SELECT *, CAST(-0.4 * z + 0.25 * coalesce(rating, 0) / 5 + 0.15 * ln(1 + 0) / 10 + 0.15 * 0.5 - 0.05 * 3 / 30 AS DOUBLE) AS s FROM zed)) WHERE rank <= 10"""


def _deals(price_weight: float, reviews: str, top: int, columns: str) -> str:
    score = f"{price_weight} * z + 0.25 * coalesce(rating, 0) / 5 + 0.15 * ln(1 + {reviews}) / 10 + 0.15 * 0.5 - 0.05 * 3 / 30"
    return _offers(
        f"SELECT {columns}, rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {POS}) AS rank FROM (SELECT *, CAST({score} AS DOUBLE) AS score FROM zed)) WHERE rank <= {top}", SCORED
    )


def _first(keys: str, columns: str, order: str = POS, where: str = "true", more: str = "") -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM offers WHERE {where}) WHERE rn = 1 {more}"


def _places(order: str, extra: str = "") -> str:
    return f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {order}, {POS}) AS place, {ID}{extra} FROM offers"


EXCLUDED = "(" + " OR ".join(f"h = {_q(x)} OR ends_with(h, {_q('.' + x)})" for x in V.EXCLUDED_HOSTS) + ")"
HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1))"

NMCK = f"""cheap AS (
  SELECT * FROM (SELECT *, lower(trim(coalesce(nullif(trim(seller), ''), source))) AS seller_key,
    row_number() OVER (PARTITION BY query_id, lower(trim(coalesce(nullif(trim(seller), ''), source))) ORDER BY price, {POS}) AS rn FROM offers WHERE price > 0) WHERE rn = 1
), pool AS (SELECT *, median({P}) OVER (PARTITION BY query_id) AS market_median, count(*) OVER (PARTITION BY query_id) AS sellers FROM cheap
), band AS (SELECT *, {P} BETWEEN market_median * 0.5 AND market_median * 2 AS inside FROM pool
), kept AS (SELECT * FROM (SELECT *, count_if(inside) OVER (PARTITION BY query_id) AS k FROM band) WHERE k < 3 OR inside
), chosen AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN sellers < 3 THEN 0 ELSE -trust END, CASE WHEN sellers < 3 THEN {P} ELSE abs({P} - market_median) END, {POS}) AS number
    FROM (SELECT *, log10(coalesce(reviews_count, 0) + 1.0) * coalesce(%s, 4.0) AS trust FROM kept)) WHERE number <= 5
)"""
LABELS = _map(V.SOURCE_LABELS)

NUMBER = r"TRY_CAST(replace(nullif(regexp_extract(value, '-?\d+(?:[.,]\d+)?'), ''), ',', '.') AS DOUBLE)"
DYNAMIC = f"""pairs AS (
  SELECT query_id, 'Бренд' AS label, p_brand AS value FROM offers UNION ALL SELECT query_id, 'Тип', p_type FROM offers UNION ALL SELECT query_id, 'Размер', CAST(p_size AS VARCHAR) FROM offers
), by_value AS (SELECT query_id, label, value, count(*) AS n, {NUMBER} AS num FROM pairs GROUP BY ALL
), by_label AS (
  SELECT query_id, label, count(*) AS kinds, sum(n) AS offers, sum(CASE WHEN num IS NOT NULL THEN n ELSE 0 END) AS numbers, min(num) AS lo, max(num) AS hi FROM by_value GROUP BY ALL
), kept AS (
  SELECT b.*, numbers / b.offers >= 0.7 AND numbers >= 2 AND hi > lo AS is_number FROM by_label b JOIN (SELECT query_id, count(*) AS c FROM offers GROUP BY 1) USING (query_id)
  WHERE kinds >= 2 AND b.offers >= greatest(2, ceil(c * 0.25)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY b.offers DESC, label) <= 8
)"""

REGION = f"(list_extract([213, 1, 2, 74, 99999], CAST(l_orderkey % 5 + 1 AS INT)))"
LEVEL = f"coalesce(list_extract(map_extract({_map(V.REGION_LEVELS)}, region_id), 1), 0.97)"
NOISE = "(CAST(('0x' || substr(md5(url), 1, 2)) AS INT) / CAST(255 AS DOUBLE) - 0.5) * 0.02"

TRANSLATED = "lower(raw)"
for _phrase in sorted(V.PHRASES, key=len, reverse=True):
    TRANSLATED = f"replace({TRANSLATED}, {_q(_phrase)}, {_q(V.PHRASES[_phrase])})"
CLEANED = r"trim(regexp_replace(regexp_replace(lower(nfc_normalize(raw)), '[^\p{L}\p{N}\p{M}_\s\-+./]', ' ', 'g'), '\s+', ' ', 'g'))"
STOP = "[" + ", ".join(map(_q, V.STOPWORDS)) + "]"

_VOLUME = "(nm_id // 100000)"
_LAST = V.SHARD_VOLUMES[-1]
_SHARD = f"CASE WHEN {_VOLUME} <= {_LAST} THEN lpad(CAST(len(list_filter({list(V.SHARD_VOLUMES)}, lambda b: b < {_VOLUME})) + 1 AS VARCHAR), 2, '0') ELSE lpad(CAST({len(V.SHARD_VOLUMES) + 1} + ({_VOLUME} - {_LAST}) // {V.SHARD_STEP} AS VARCHAR), 2, '0') END"
_BASE = f"'https://basket-' || ({_SHARD}) || '.wbbasket.ru/vol' || {_VOLUME} || '/part' || (nm_id // 1000) || '/' || nm_id"

ORACLES: dict[str, str] = {
    "group_stats": _offers(f"SELECT query_id, source, count(*) AS offers, CAST(min(price) AS DOUBLE) AS min_price, round(median({P}), 3) AS median_price FROM offers GROUP BY 1, 2"),
    "group_stats_shown": _offers(f"SELECT query_id, source, CAST(round_even(CAST(CAST(sum(price) AS DOUBLE) / count(*) AS DECIMAL(20,6)), 2) AS DOUBLE) AS avg_price, (t // 10 + CASE WHEN t % 10 > 5 OR (t % 10 = 5 AND t // 10 % 2 = 1) THEN 1 ELSE 0 END) / CAST(100 AS DOUBLE) AS median_shown FROM (SELECT query_id, source, price, CAST(round(median({P}) OVER (PARTITION BY query_id, source) * 1000) AS BIGINT) AS t FROM offers) GROUP BY 1, 2, t"),
    "group_means": _offers(f"SELECT query_id, source, CAST(sum(price) AS DOUBLE) / count(*) AS mean_price FROM offers GROUP BY 1, 2"),
    "totals_by_source": _offers(f"SELECT query_id, source, count(*) AS offers, CAST(min(price) AS DOUBLE) AS min_price, CAST(sum(price) AS DOUBLE) / count(*) AS mean_price FROM offers GROUP BY GROUPING SETS ((query_id, source), (query_id))"),
    "best_deals": _deals(-0.40, "0", 10, f"query_id, source, item_id, {P} AS price"),
    "best_deals_by_reviews": _deals(-0.3, "coalesce(reviews_count, 0)", 5, "query_id, item_id"),
    "cheapest_offers": _offers(_first("query_id", f"query_id, source, item_id, {P} AS price, url", f"price, {POS}", "price > 0")),
    "cheapest_three": _offers(f"SELECT query_id, place, source, CAST(price AS VARCHAR) AS price, url FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY price, {POS}) AS place FROM offers WHERE price > 0) WHERE place <= 3"),
    "market_context": _offers(f"SELECT query_id, count(*) FILTER (price > 0) AS priced, round(median({P}) FILTER (price > 0), 3) AS median_price, CAST(sum(price) FILTER (price > 0) AS DOUBLE) / count(*) FILTER (price > 0) AS mean_price, CAST(min(price) FILTER (price > 0) AS DOUBLE) AS min_price, CAST(max(price) FILTER (price > 0) AS DOUBLE) AS max_price, round(avg(rating), 6) AS mean_rating, count(DISTINCT source) AS sources FROM offers GROUP BY 1"),
    "against_market": _offers(f"SELECT query_id, {ID}, round(({P} - m) / m * 100, 4) AS delta_pct FROM offers JOIN (SELECT query_id, median({P}) FILTER (price > 0) AS m FROM offers GROUP BY 1) USING (query_id)"),
    "dumping_flags": _offers(
        "SELECT query_id, source, size >= 5 AND fall >= CASE WHEN source = 'runet' THEN 35 ELSE 30 END AS dumping, count(*) AS offers, max(size) AS group_size, min(fall) AS least_drop, max(fall) AS most_drop FROM "
        f"(SELECT *, CAST(round((m - {P}) / m * 100) AS INT) AS fall FROM (SELECT *, median({P}) OVER g AS m, count(*) OVER g AS size FROM offers WHERE price > 0 WINDOW g AS (PARTITION BY query_id, source))) GROUP BY 1, 2, 3"
    ),
    "regional_prices": _offers(f"SELECT {ID}, region_id, CASE WHEN region_id = 213 THEN {P} ELSE CAST(round(CAST({P} * ({LEVEL} + {NOISE}) AS DECIMAL(20,6)), 0) AS DOUBLE) END AS regional_price FROM (SELECT *, {REGION} AS region_id FROM offers)"),
    "sorted_by_relevance": _offers(_places("CASE WHEN l_orderkey % 3 <> 0 THEN l_partkey % 100 ELSE 0 END DESC, price")),
    "sorted_by_price": _offers(_places("price", ", 'up' AS way") + " UNION ALL " + _places("price DESC", ", 'down' AS way")),
    "sorted_by_reviews": _offers(_places("coalesce(reviews_count, 0) DESC", ", 'down' AS way") + " UNION ALL " + _places("coalesce(reviews_count, 0)", ", 'up' AS way")),
    "places_by_relevance": _offers(_places("CASE WHEN l_orderkey % 3 <> 0 THEN l_partkey % 100 ELSE 0 END DESC, price")),
    "places_by_price": _offers(_places("price", ", 'up' AS way") + " UNION ALL " + _places("price DESC", ", 'down' AS way")),
    "places_by_reviews": _offers(_places("coalesce(reviews_count, 0) DESC", ", 'down' AS way") + " UNION ALL " + _places("coalesce(reviews_count, 0)", ", 'up' AS way")),
    "per_source_limit": _offers(f"SELECT query_id, source, {ID} FROM offers QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY {POS}) <= 10"),
    "selected_sources": _offers("SELECT source, count(*) AS offers FROM offers WHERE source = 'ozon' GROUP BY 1 UNION ALL SELECT source, count(*) FROM offers WHERE source IN ('wb', 'ozon', 'runet') GROUP BY 1"),
    "dedup_url": _offers(_first("query_id, url", f"query_id, url, {ID}")),
    "dedup_listing": _offers(_first("query_id, lower(trim(seller)), substr(lower(trim(name)), 1, 50)", f"query_id, seller, {ID}", f"CASE WHEN source = 'runet' THEN 0 ELSE 1 END, {POS}")),
    "dedup_host": _offers(f"SELECT query_id, h AS host, {ID} FROM (SELECT *, {HOST} AS h FROM offers) WHERE NOT {EXCLUDED} QUALIFY row_number() OVER (PARTITION BY query_id, h ORDER BY {POS}) = 1"),
    "dedup_sku": _offers(f"SELECT query_id, sku, {ID} FROM (SELECT *, CASE WHEN l_linenumber <> 3 THEN item_id ELSE ' ' END AS sku FROM offers) QUALIFY trim(sku) = '' OR row_number() OVER (PARTITION BY query_id, sku ORDER BY {POS}) = 1"),
    "nmck_selection": _offers(f"SELECT query_id, number, seller_key, {P} AS price, round(trust, 6) AS trust, round(market_median, 3) AS market_median FROM chosen", NMCK % "rating"),
    "nmck_statistics": _offers(
        f"SELECT query_id, count(*) AS n_offers, round(avg({P}), 4) AS mean, round(stddev_samp({P}), 4) AS stdev, round(stddev_samp({P}) / avg({P}) * 100, 4) AS cv_pct, stddev_samp({P}) / avg({P}) * 100 <= 33 AS homogeneous, string_agg(seller, '|' ORDER BY number) AS sources_used FROM chosen GROUP BY 1 HAVING count(*) >= 3",
        NMCK % "nullif(rating, 0)",
    ),
    "nmck_statistics_rounded": _offers(f"SELECT query_id, count(*) AS n_offers, round(avg({P}), 2) AS mean, round(stddev_samp({P}), 2) AS stdev, round(stddev_samp({P}) / avg({P}) * 100, 2) AS cv_pct, stddev_samp({P}) / avg({P}) * 100 <= 33 AS homogeneous FROM chosen GROUP BY 1 HAVING count(*) >= 3", NMCK % "rating"),
    "nmck_workbooks": _offers(
        f"""SELECT query_id, CASE WHEN n >= 3 THEN 'AVERAGE(C3:C' || (n + 2) || ')' END AS mean, CASE WHEN n >= 3 THEN 'STDEV(C3:C' || (n + 2) || ')' END AS deviation, CAST(CASE WHEN n >= 3 THEN n ELSE 0 END AS DOUBLE) AS chosen,
  CAST(m AS DOUBLE) AS offers, CASE WHEN n >= 3 THEN s END AS chosen_sum, t AS offers_sum FROM (SELECT query_id, count(*) AS n, round(sum({P}), 2) AS s FROM chosen GROUP BY 1) JOIN (SELECT query_id, count(*) AS m, round(sum({P}), 2) AS t FROM offers GROUP BY 1) USING (query_id)""", NMCK % "rating"
    ),
    "nmck_sheet_chosen": _offers(f"SELECT query_id, number, list_extract(map_extract({LABELS}, source), 1) AS source_label, seller, {P} AS price, count(*) OVER (PARTITION BY query_id) AS n_offers FROM chosen", NMCK % "rating"),
    "nmck_sheet_all": _offers(f"SELECT query_id, source_label, seller, {P} AS price, row_number() OVER (PARTITION BY query_id ORDER BY source_label, price, {ID}, price) AS number FROM (SELECT *, list_extract(map_extract({LABELS}, source), 1) AS source_label FROM offers)"),
    "facets_builtin": _offers(
        "SELECT query_id, 'numeric' AS kind, 'Цена' AS label, CAST(floor(min(price)) AS DOUBLE) AS min, CAST(ceil(max(price)) AS DOUBLE) AS max, count(price) AS offers FROM offers GROUP BY 1 "
        "UNION ALL SELECT query_id, 'numeric', 'Рейтинг', 0, 5, count(*) FILTER (rating > 0) FROM offers GROUP BY 1 HAVING count(*) FILTER (rating > 0) > 0 "
        "UNION ALL SELECT query_id, 'numeric', 'Кол-во отзывов', 0, max(reviews_count), count(reviews_count) FROM offers GROUP BY 1 HAVING count(reviews_count) > 0"
    ),
    "facets_dynamic": _offers("SELECT query_id, 'numeric' AS kind, label, floor(lo) AS min, ceil(hi) AS max, NULL AS value, CAST(offers AS BIGINT) AS offers FROM kept WHERE is_number UNION ALL SELECT v.query_id, 'string', v.label, NULL, NULL, v.value, v.n FROM kept k JOIN by_value v USING (query_id, label) WHERE NOT coalesce(k.is_number, false)", DYNAMIC),
    "facet_filter": _offers(f"SELECT query_id, source, {ID} FROM offers WHERE {P} BETWEEN 20000 AND 60000 AND (rating IS NULL OR rating BETWEEN 2 AND 4) AND p_size BETWEEN 1 AND 30 AND p_brand IN ('Brand#12', 'Brand#17', 'Brand#2') AND source IN ('wb', 'runet')"),
    "price_series": _with(POINTS_SQL, body=f"SELECT source, item_id, ts, {P} AS price, row_number() OVER (PARTITION BY source, item_id ORDER BY ts, price) AS place FROM (SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY source, item_id ORDER BY ts DESC, price DESC) <= 50)"),
    "latest_prices": _with(POINTS_SQL, body=f"SELECT source, item_id, ts, {P} AS price FROM points QUALIFY row_number() OVER (PARTITION BY source, item_id ORDER BY ts DESC, price DESC) = 1"),
    "compared_items": _with(
        POINTS_SQL,
        "last AS (SELECT source, item_id, price FROM points QUALIFY row_number() OVER (PARTITION BY source, item_id ORDER BY ts DESC, price DESC) = 1)",
        "items AS (SELECT DISTINCT event_id % 50 AS request_id, event_type AS source, CAST(user_id + CASE WHEN event_id % 11 = 0 THEN 1000000 ELSE 0 END AS VARCHAR) AS item_id FROM events)",
        body=f"SELECT request_id, source, item_id, {P} AS price, price IS NOT NULL AND row_number() OVER (PARTITION BY request_id ORDER BY price NULLS LAST, source, item_id) = 1 AS cheapest FROM items LEFT JOIN last USING (source, item_id)",
    ),
    "sparklines": _with(POINTS_SQL, body=f"SELECT *, round((last_price - first_price) / first_price * 100, 4) AS diff_pct, CASE WHEN (last_price - first_price) / first_price * 100 < -2 THEN 'good' WHEN (last_price - first_price) / first_price * 100 > 2 THEN 'bad' ELSE 'flat' END AS trend FROM (SELECT source, item_id, count(*) AS points, first({P} ORDER BY ts, price) AS first_price, last({P} ORDER BY ts, price) AS last_price FROM points GROUP BY 1, 2 HAVING count(*) >= 2)"),
    "hourly_prices": _with(POINTS_SQL, body=f"SELECT source, date_trunc('hour', ts) AS window_start, count(*) AS points, CAST(min(price) AS DOUBLE) AS min_price, CAST(sum(price) AS DOUBLE) / count(*) AS mean_price FROM points GROUP BY 1, 2"),
    "scrape_bursts": _with(POINTS_SQL, body="SELECT source, min(ts) AS session_start, count(*) AS points FROM (SELECT *, sum(fresh) OVER (PARTITION BY source ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY source ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM points)) GROUP BY source, s"),
    "price_alerts": _with(CHECKS_SQL, body="SELECT watch_id, check_id, CAST(prev AS DOUBLE) AS prev_price, CAST(best_price AS DOUBLE) AS new_price, round(d, 4) AS diff_pct FROM (SELECT *, (CAST(best_price AS DOUBLE) - CAST(prev AS DOUBLE)) / CAST(prev AS DOUBLE) * 100 AS d FROM (SELECT *, lag(best_price) OVER (PARTITION BY watch_id ORDER BY check_ts, check_id) AS prev FROM checks WHERE best_price IS NOT NULL) WHERE prev > 0) WHERE abs(d) >= 2"),
    "due_watches": _with(WATCHES_SQL, body="SELECT id, owner_key, last_check_at FROM watches WHERE active AND (last_check_at IS NULL OR epoch(TIMESTAMP '2024-03-01') - epoch(last_check_at) >= interval_min * 60)"),
    "due_watches_first": _with(WATCHES_SQL, body="SELECT id, last_check_at FROM watches WHERE active AND (last_check_at IS NULL OR epoch(TIMESTAMP '2024-03-01') - epoch(last_check_at) >= interval_min * 60) ORDER BY last_check_at NULLS FIRST, id LIMIT 5"),
    "unread_counts": "SELECT 'user-' || (o_custkey % 300) AS owner_key, count(*) AS unread FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1",
    "listed_alerts": "SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_custkey % 3 = 1 AND o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200",
    "new_favorites": "SELECT source, count(*) AS favorites, CAST(sum(item_id * user_id) AS BIGINT) AS digest FROM (SELECT DISTINCT l_orderkey % 200 AS user_id, CAST(l_suppkey % 4 AS VARCHAR) AS source, l_partkey AS item_id FROM lineitem) GROUP BY 1",
    "recent_queries": "SELECT owner_key, query, ts, place FROM (SELECT *, row_number() OVER (PARTITION BY owner_key ORDER BY ts DESC, shown) AS place FROM (SELECT o_custkey % 50 AS owner_key, o_orderdate AS ts, lower(o_orderpriority || '-' || o_orderstatus) AS query, CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority || '-' || o_orderstatus) ELSE o_orderpriority || '-' || o_orderstatus END AS shown FROM orders QUALIFY row_number() OVER (PARTITION BY owner_key, query ORDER BY ts DESC, shown) = 1)) WHERE place <= 12",
    "sentiment_breakdown": _with(REVIEWS_SQL, body="SELECT item_id, total, positive, negative, total - positive - negative AS neutral, round(positive * 100.0 / total, 1) AS positive_pct, round(negative * 100.0 / total, 1) AS negative_pct, round((total - positive - negative) * 100.0 / total, 1) AS neutral_pct FROM (SELECT item_id, count(*) AS total, count_if(label = 'positive') AS positive, count_if(label = 'negative') AS negative FROM reviews GROUP BY 1)"),
    "review_quotes": _with(REVIEWS_SQL, body="SELECT item_id, label, place, pos, pluses, substr(text, 1, 240) AS text FROM (SELECT *, row_number() OVER (PARTITION BY item_id, label ORDER BY pluses DESC, score DESC, pos) AS place FROM reviews) WHERE place <= 3"),
    "review_quotes_rounded": _with(REVIEWS_SQL, body="SELECT item_id, label, place, pos FROM (SELECT *, row_number() OVER (PARTITION BY item_id, label ORDER BY pluses DESC, round(score, 3) DESC, pos) AS place FROM reviews) WHERE place <= 2"),
    "review_ratings": _with(REVIEWS_SQL, body="SELECT item_id, rating, count(*) AS reviews FROM reviews GROUP BY 1, 2"),
    "reviews_newest": _with(REVIEWS_SQL, body="SELECT item_id, pos, row_number() OVER (PARTITION BY item_id ORDER BY dated DESC NULLS LAST, pos) AS place FROM reviews"),
    "reviews_oldest": _with(REVIEWS_SQL, body="SELECT item_id, pos, row_number() OVER (PARTITION BY item_id ORDER BY dated NULLS LAST, pos) AS place FROM reviews"),
    "reviews_by_rating": _with(REVIEWS_SQL, body="SELECT item_id, pos, row_number() OVER (PARTITION BY item_id ORDER BY rating DESC, pos) AS place FROM reviews"),
    "reviews_deduplicated": _with(REVIEWS_SQL, body="SELECT item_id, pos FROM reviews WHERE length(text) >= 30 QUALIFY row_number() OVER (PARTITION BY item_id, author, substr(text, 1, 120) ORDER BY pos) = 1"),
    "cleaned_queries": _with(QUERIES_SQL, body=f"SELECT query_id, {CLEANED} AS cleaned FROM queries"),
    "translated_queries": _with(QUERIES_SQL, body=rf"SELECT query_id, array_to_string(list_transform(list_filter(regexp_split_to_array({TRANSLATED}, '\s+'), lambda w: w <> ''), lambda w: coalesce(list_extract(map_extract({_map(V.BRANDS)}, w), 1), w)), ' ') AS translated FROM queries"),
    "query_tokens": _with(QUERIES_SQL, body=f"SELECT query_id, array_to_string(list_filter(regexp_extract_all(lower(raw), '[a-zа-яё0-9]+'), lambda w: length(w) > 1 AND NOT list_contains({STOP}, w)), '|') AS tokens FROM queries"),
    "parsed_numbers": "SELECT p_partkey, CAST(v AS DOUBLE) AS first_number, CAST(CAST(v * 100 AS BIGINT) AS DOUBLE) AS digits_price, CAST(v AS DOUBLE) AS decimal_price, CAST(v AS DOUBLE) AS comma_number, CAST(round(100.0 * (p_retailprice * (1 + CAST(p_size AS DOUBLE) / 100) - p_retailprice) / (p_retailprice * (1 + CAST(p_size AS DOUBLE) / 100))) AS INT) AS discount FROM (SELECT *, CAST(p_retailprice AS DECIMAL(12,2)) AS v FROM part)",
    "shards_and_links": f"SELECT nm_id, {_SHARD} AS shard, {_BASE} || '/info/ru/card.json' AS card_url, {_BASE} || '/images/big/2.webp' AS image_url, {_BASE} || '/info/price-history.json' AS history_url FROM (SELECT p_partkey * 54321 + 777 AS nm_id FROM part)",
    "page_hosts": f"SELECT page_id, h AS host, {EXCLUDED} AS excluded, sha1('runet|' || url) AS cache_key, CASE WHEN regexp_matches(url, '[?&]lr=') THEN regexp_replace(url, '([?&]lr=)[^&#]*', '\\12', 'g') WHEN contains(url, '?') THEN url || '&lr=2' ELSE url || '?lr=2' END AS with_region FROM (SELECT *, {HOST} AS h FROM pages)",
    "item_ids": _offers(f"SELECT {ID}, CASE WHEN source = 'wb' THEN item_id ELSE url END AS id FROM offers"),
    "escalations": "SELECT source, event_id, recent, CAST(least(3, 1 + sum(CASE WHEN recent >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)) AS INT) AS level FROM (SELECT event_type AS source, event_id, epoch_us(ts) AS us, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 7199999999 PRECEDING AND 1 PRECEDING) + row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id) AS recent FROM events WHERE event_id % 3 <> 0)",
    "fresh_or_stale": _with(POINTS_SQL, body="SELECT source, CASE WHEN age < 900 THEN 'fresh' WHEN age < CASE WHEN source = 'purchase' THEN 21600 ELSE 0 END THEN 'stale' ELSE 'miss' END AS status, count(*) AS reads FROM (SELECT *, CAST(floor(epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY source, item_id ORDER BY ts, price)) / 1e6) AS BIGINT) AS age FROM points) GROUP BY 1, 2"),
    "search_stream": _offers(
        f"""SELECT * REPLACE (CAST(rank AS DOUBLE) AS rank, CAST(offers AS DOUBLE) AS offers, CAST(in_order AS DOUBLE) AS in_order) FROM (SELECT query_id, 'source_finished' AS event, source, NULL AS rank, NULL AS offer, NULL AS score, count(*) AS offers, min({P}) AS min_price, round(sum({P}), 2) AS total_price, round(median({P}), 3) AS median_price,
  CASE source WHEN 'ozon' THEN 'timeout' WHEN 'runet' THEN 'partial' END AS error, NULL AS in_order FROM offers GROUP BY 1, 3
UNION ALL SELECT query_id, 'source_finished', s.source, NULL, NULL, NULL, 0, NULL, NULL, NULL, 'timeout', NULL FROM (SELECT DISTINCT query_id FROM offers) q CROSS JOIN (VALUES ('wb'), ('ozon'), ('ya_market'), ('runet')) AS s(source) WHERE NOT EXISTS (SELECT 1 FROM offers o WHERE o.query_id = q.query_id AND o.source = s.source)
UNION ALL SELECT query_id, 'top_deal', source, rank, printf('%012d-%012d-%012d-%012d', l_orderkey, l_linenumber, l_partkey, l_suppkey), score, NULL, NULL, NULL, NULL, NULL, NULL FROM ({_TOP_TEN})
UNION ALL SELECT query_id, 'done', NULL, NULL, NULL, NULL, count(*), NULL, NULL, NULL, NULL, 1 FROM offers GROUP BY 1)""", SCORED
    ),
    "running_counters": _offers(
        "SELECT n AS part, coalesce(source, 'offers') AS counter, count(*) AS offers FROM (SELECT DISTINCT n, query_id, url, source FROM offers JOIN (VALUES (0), (1), (2)) AS parts(n) ON l_orderkey % 3 <= n) GROUP BY GROUPING SETS ((n), (n, source))"
    ),
    "price_series_stream": _with(POINTS_SQL, body=f"SELECT source, item_id, ts, {P} AS price, row_number() OVER (PARTITION BY source, item_id ORDER BY ts, price) AS place FROM (SELECT * FROM points WHERE price > 0 QUALIFY row_number() OVER (PARTITION BY source, item_id ORDER BY ts DESC, price DESC) <= 200)"),
    "price_alerts_stream": _with(CHECKS_SQL, body="SELECT watch_id, check_id, round(d, 4) AS diff_pct FROM (SELECT *, (CAST(best_price AS DOUBLE) - CAST(prev AS DOUBLE)) / CAST(prev AS DOUBLE) * 100 AS d FROM (SELECT *, lag(best_price) OVER (PARTITION BY watch_id ORDER BY check_ts, check_id) AS prev FROM checks WHERE best_price IS NOT NULL) WHERE prev > 0) WHERE abs(d) >= 2"),
    "parsed_pages": r"SELECT page_id, len(regexp_extract_all(html, '(?is)<script[^>]*application/ld.json[^>]*>')) AS blocks, contains(lower(html), '<title') AS titled, CAST(strlen(html) AS BIGINT) AS n_bytes FROM pages",
    "parsed_cards": "SELECT p_partkey, CAST(floor(p_retailprice) AS DOUBLE) AS price, 1 + (p_partkey % 40) / CAST(10 AS DOUBLE) AS rating, p_size * 100 AS reviews_count, 'Samsung' AS brand, (8 * (p_partkey % 3 + 1)) || ' ГБ' AS ram FROM part WHERE p_retailprice >= 100",
}

_PARTS = rf"list_filter(list_transform(regexp_split_to_array(lower(trim(raw)), {_q(V.CLARIFY_SPLIT)}), lambda p: trim(p)), lambda p: p <> '')"


def _tells(part: str) -> str:
    """Whether a half has a word that is no specification and is no brand alone."""
    words = rf"list_filter(regexp_split_to_array({part}, '\s+'), lambda w: w <> '' AND NOT regexp_matches(w, {_q(V.CLARIFY_SPEC)}))"
    return f"len({words}) > 0 AND NOT list_contains([{', '.join(map(_q, V.CLARIFY_BRANDS))}], {part})"


ORACLES["clarified_queries"] = _with(
    QUERIES_SQL,
    f"p AS (SELECT query_id, raw, {_PARTS} AS parts FROM queries)",
    f"h AS (SELECT query_id, raw, parts[1] AS a, parts[2] AS b FROM p WHERE len(parts) >= 2 AND length(lower(trim(raw))) >= 5 AND {_tells('parts[1]')} AND {_tells('parts[2]')})",
    body="SELECT query_id, 1 AS number, upper(substr(a, 1, 1)) || substr(a, 2) AS label, 'Искать только «' || a || '»' AS text, a AS query FROM h UNION ALL SELECT query_id, 2, upper(substr(b, 1, 1)) || substr(b, 2), 'Искать только «' || b || '»', b FROM h UNION ALL SELECT query_id, 3, 'Искать как написано', 'Искать «' || raw || '» по всему каталогу', raw FROM h",
)


def _lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts: a fold over the first's characters keeps a row of the table."""
    cell = f"list_append(done, CASE WHEN substr({b}, j[1], 1) = chr(c[1]) THEN row[j[1]] + 1 ELSE greatest(done[j[1]], row[j[1] + 1]) END)"
    inner = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda x: [CAST(x AS INT)]), lambda done, j: {cell}, [0])"
    return f"list_reduce(list_transform(list_filter(string_split({a}, ''), lambda x: x <> ''), lambda x: [unicode(x)]), lambda row, c: {inner}, list_resize([0], length({b}) + 1, 0))[length({b}) + 1]"


_TERMS = ", ".join(f"({_q(t)}, {i})" for i, t in enumerate(TERMS))
ORACLES["typo_corrections"] = _with(
    QUERIES_SQL,
    f"tokens AS (SELECT DISTINCT unnest(regexp_split_to_array({CLEANED}, '\\s+')) AS token FROM queries)",
    f"terms(term, place) AS (VALUES {_TERMS})",
    f"rated AS (SELECT token, term, place, CAST(200 AS DOUBLE) * ({_lcs('token', 'term')}) / (length(token) + length(term)) AS ratio FROM tokens, terms WHERE length(token) >= {V.TYPO_LEAST_CHARS} AND NOT regexp_full_match(token, '\\d+') AND 200.0 * least(length(token), length(term)) >= {V.TYPO_CUTOFF} * (length(token) + length(term)))",
    body=f"SELECT token, term AS fixed, round(ratio, 4) AS ratio FROM rated WHERE ratio >= {V.TYPO_CUTOFF} QUALIFY row_number() OVER (PARTITION BY token ORDER BY ratio DESC, place) = 1",
)

_WORDS = r"list_distinct(list_filter(regexp_split_to_array(%s, '\s+'), lambda w: w <> ''))"


def _tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-zа-яё0-9]+'), lambda w: length(w) > 1 AND NOT list_contains({STOP}, w))"


_TELLING = any(word in "тип" for word in V.TELLING_KEYS)
ORACLES["relevance"] = _with(
    f"o AS (SELECT p_partkey, p_name || ' pro ' || p_size AS q, concat_ws(' ', p_name, p_brand, p_type, p_size{', p_type' if _TELLING else ''}) AS t, (p_partkey % 41) / CAST(10 AS DOUBLE) + 1 AS rating, p_partkey % 5000 AS reviews FROM part)",
    f"w AS (SELECT *, {_WORDS % 'q'} AS wa, {_WORDS % 't'} AS wb, {_tokens('q')} AS tokens, {_tokens('t')} AS hay FROM o)",
    "s AS (SELECT *, array_to_string(list_sort(list_intersect(wa, wb)), ' ') AS shared, array_to_string(list_sort(list_filter(wa, lambda x: NOT list_contains(wb, x))), ' ') AS a, array_to_string(list_sort(list_filter(wb, lambda x: NOT list_contains(wa, x))), ' ') AS b FROM w)",
    "n AS (SELECT *, length(shared) AS s, length(a) AS la, length(b) AS lb, CASE WHEN shared = '' THEN 0 ELSE 1 END AS gap FROM s)",
    f"r AS (SELECT *, 100 - CAST(100 AS DOUBLE) * (la + lb - 2 * ({_lcs('a', 'b')})) / (2 * (s + gap) + la + lb) AS whole, 100 - CAST(100 AS DOUBLE) * (gap + la) / (s + s + gap + la) AS with_a, 100 - CAST(100 AS DOUBLE) * (gap + lb) / (s + s + gap + lb) AS with_b FROM n)",
    "base AS (SELECT *, CASE WHEN s > 0 AND (la = 0 OR lb = 0) THEN 100 WHEN s = 0 THEN whole ELSE greatest(whole, with_a, with_b) END AS base FROM r)",
    f"total AS (SELECT p_partkey, CASE WHEN len(tokens) = 0 THEN 0 ELSE round(greatest(0, least(100, base + least(len(list_filter(tokens, lambda w: regexp_matches(w, {_q(V.SPEC_PATTERN)}) AND list_contains(hay, w))) * 8.0, 25.0) + CASE WHEN base < 30 THEN 0 ELSE least(CAST(1 AS DOUBLE), log10(reviews + CAST(1 AS DOUBLE)) * rating / 15) * 10 * base / 100 END)), 1) END AS score FROM base)",
    body="SELECT p_partkey, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 60 THEN 'medium' ELSE 'low' END AS badge FROM total",
)

_GROUP_OF = {member: group for group in V.SYNONYMS for member in group}
_SYNONYMS = ", ".join(f"({_q(FORMS.get(m, m))}, {_q(other)}, {i})" for m, group in _GROUP_OF.items() for i, other in enumerate(group) if FORMS.get(other, other) != FORMS.get(m, m))
_SPLIT = r"list_filter(regexp_split_to_array(%s, '\s+'), lambda w: w <> '')"
ORACLES["normalized_queries"] = (
    ORACLES["typo_corrections"].replace("SELECT token, term AS fixed", "fixes AS (SELECT token, term AS fixed", 1).replace(") fixes AS", "), fixes AS", 1)
    + f"""), split AS (SELECT query_id, raw, {_SPLIT % CLEANED} AS words FROM queries
), placed AS (SELECT query_id, unnest(words) AS token, unnest(range(len(words))) AS place FROM split
), joined AS (SELECT query_id, token, place, coalesce(fixed, token) AS new FROM placed LEFT JOIN fixes USING (token)
), mended AS (SELECT query_id, string_agg(new, ' ' ORDER BY place) AS raw, list('опечатка: ' || token || ' → ' || new ORDER BY place) FILTER (new <> token) AS notes FROM joined GROUP BY 1
), told AS (SELECT query_id, raw AS mended, notes, array_to_string(list_transform({_SPLIT % TRANSLATED}, lambda w: coalesce(list_extract(map_extract({_map(V.BRANDS)}, w), 1), w)), ' ') AS normalized FROM mended
), syn(lemma, synonym, group_place) AS (VALUES {_SYNONYMS}
), words AS (SELECT query_id, normalized, {_SPLIT % 'normalized'} AS words FROM told
), each AS (SELECT query_id, normalized, words, unnest(words) AS token, unnest(range(len(words))) AS place FROM words
), swapped AS (
  SELECT query_id, place, group_place, token, synonym, array_to_string(list_concat(list_concat(words[:place], [synonym]), words[place + 2:]), ' ') AS alternate, normalized
  FROM each JOIN syn ON lemma = coalesce(list_extract(map_extract({_map(FORMS)}, lower(token)), 1), lower(token))
), once AS (SELECT * FROM swapped WHERE alternate <> normalized QUALIFY row_number() OVER (PARTITION BY query_id, alternate ORDER BY place, group_place) = 1
), few AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, group_place) AS number FROM once QUALIFY number <= 3
), alternates AS (SELECT query_id, string_agg(alternate, '; ' ORDER BY number) AS alternates, list('синоним: ' || token || ' → ' || synonym ORDER BY number) AS notes FROM few GROUP BY 1)
SELECT query_id, normalized, array_to_string(list_concat(list_concat(coalesce(t.notes, []), CASE WHEN mended <> normalized THEN ['перевод: «' || mended || '» → «' || normalized || '»'] ELSE [] END), coalesce(a.notes, [])), '; ') AS expansions, coalesce(alternates, '') AS alternates
FROM told t LEFT JOIN alternates a USING (query_id)"""
)

ORACLES |= payloads.ORACLES
