"""Schemas of the tables the operators read and write.

``pos`` is the order of arrival: anything that can be sorted and tells offers of one query apart.  All "first wins"
rules and ties go by it.
"""

from __future__ import annotations

REVIEW = "struct<author: string, score: int, text: string, published_at: string, photos: array<string>>"
OFFERS = f"query_id string, source string, item_id string, name string, price decimal(12,2), currency string, url string, image string, images array<string>, characteristics map<string, string>, seller string, rating double, reviews array<{REVIEW}>, reviews_count int, fetched_at timestamp, cached boolean, relevance double, pos long"
SOURCE_STATUS = "query_id string, source string, error string, cached boolean"
PRICE_POINTS = "source string, item_id string, ts timestamp, price decimal(12,2)"
WATCHES = "id long, owner_key string, query string, region_id int, interval_min int, threshold_pct double, active boolean, last_best_price decimal(12,2), last_best_source string, last_best_url string, last_best_name string, last_check_at timestamp, last_error string, created_at timestamp"
ALERTS = "id long, watch_id long, owner_key string, query string, prev_price decimal(12,2), new_price decimal(12,2), diff_pct double, offer_source string, offer_url string, offer_name string, top_offers array<struct<source: string, price: string, name: string, url: string>>, created_at timestamp, read_at timestamp"
FAVORITES = "user_id string, source string, item_id string, name string, price decimal(12,2), created_at timestamp"
FEEDBACKS = "id string, nm_id long, rating int, text string, pros string, cons string, color string, size string, created string, pluses int, minuses int"
