"""Widgets of product pages: rich text, characteristics, reviews, and what a page adds to its stub.

Payloads are JSON objects whose ``widgetStates`` are JSON texts by widget name; texts that do not parse are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarium import values as V
from bazaarium.functions import numbers
from bazaarium.functions.jsonld import first_wins
from bazaarium.functions.json_nodes import walk
from bazaarium.functions.variants import field, is_object

REVIEW_CHARS, REVIEW_LEAST, REVIEW_PHOTOS = 1000, 30, 6


def _empty(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def rich_text(node: Column, path: str = "$") -> Column:
    """Text of a node: itself, the contents of its runs joined by spaces, or its text or content; null without any."""
    runs = F.from_json(F.to_json(F.coalesce(F.try_variant_get(node, f"{path}.textRs", "variant"), F.try_variant_get(node, path, "variant"))), "array<struct<content: string>>")
    joined = F.array_join(F.filter(F.transform(runs, lambda r: r["content"]), lambda c: F.coalesce(c, F.lit("")) != ""), " ")
    said = F.coalesce(_empty(field(node, path)), _empty(joined), _empty(field(node, f"{path}.text")), _empty(field(node, f"{path}.content")))
    # Most objects lack most paths: one look then, not one for each of these shapes.
    return F.when(F.try_variant_get(node, path, "variant").isNotNull(), said)


def widget_states(captured: DataFrame, payload: str = "payload", *keep: str) -> DataFrame:
    """(``keep``, widget, pos, state) of the widgets of each page in the order of the text; states that do not parse go with the walk."""
    states = F.from_json(F.col(payload), "widgetStates map<string, string>")["widgetStates"]
    # Outer, so that no filter by what it explodes is put before it.
    return captured.select(*keep, F.posexplode_outer(F.map_entries(states)).alias("pos", "_e")).where("_e IS NOT NULL").select(*keep, F.col("_e.key").alias("widget"), "pos", F.col("_e.value").alias("state"))


def objects(states: DataFrame, *keep: str) -> DataFrame:
    """(``keep``, widget, place, first, node) of each object in widgets, at any depth; ``place`` orders them as the page does, ``first`` marks a widget's first."""
    found = walk(states, [*keep, "widget", "pos"], "state")
    return found.select(*keep, "widget", F.struct("pos", "at").alias("place"), "first", "node")


def _with_named(found: DataFrame) -> DataFrame:
    """Add ``named``: (name, value) of an object that is a named value, else null; page controls are none.

    Step by step, so that what one step finds is not found anew by the next; only objects with a name and values go on.
    """
    node = F.col("node")
    names = [rich_text(node, f"$.{k}") for k in ("title", "name", "label", "titleRs")]
    values = F.coalesce(*[F.try_variant_get(node, f"$.{k}", "variant") for k in ("values", "subtitleRs", "subtitle")])

    def item(v: Column) -> Column:
        runs = F.array_join(F.transform(F.from_json(F.get_json_object(v, "$.textRs"), "array<struct<content: string>>"), lambda r: r["content"]), " ")
        inner = F.coalesce(*[_empty(c) for c in (F.get_json_object(v, "$.text"), runs, F.get_json_object(v, "$.content"), F.get_json_object(v, "$.value"))])
        return F.when(F.startswith(v, F.lit("{")), inner).otherwise(_empty(v))

    step = found.withColumn("_values", values).withColumn("_name", F.when(F.col("_values").isNotNull(), F.trim(F.coalesce(*names))))
    named, v = F.col("_name") != "", F.col("_values")
    step = step.withColumn("_listed", F.when(named, F.from_json(F.to_json(v), "array<string>")))
    step = step.withColumn("_texts", F.filter(F.transform("_listed", item), lambda t: t.isNotNull()))
    alone = F.when(named & F.col("_listed").isNull() & is_object(v), F.coalesce(rich_text(v), field(v, "$.value")))
    step = step.withColumn("_value", F.trim(F.when(F.size("_texts") > 0, F.array_join("_texts", ", ")).otherwise(alone)))
    value, texts = F.col("_value"), F.col("_texts")
    control = F.coalesce((F.size(texts) == 1) & _one_of(F.get(texts, F.lit(0)), V.CONTROL_VALUES), F.lit(False))
    spaces = F.length(value) - F.length(F.replace(value, F.lit(" "), F.lit("")))
    fit = named & (value != "") & (F.length("_name") <= 100) & (F.length(value) <= 500) & (spaces <= 25) & ~control & ~_one_of(F.col("_name"), V.CONTROL_NAMES)
    return step.withColumn("named", F.when(fit, F.struct(F.col("_name").alias("name"), value.alias("value")))).drop("_values", "_name", "_listed", "_texts", "_value")


def name_values(states: DataFrame, *keep: str) -> DataFrame:
    """(``keep``, widget, place, name, value) of the named values in widgets, wherever they stand; page controls left out."""
    found = _with_named(objects(states, *keep))
    return found.where("named IS NOT NULL").select(*keep, "widget", "place", "named.name", "named.value")


def _first_named(pairs: Column) -> Column:
    """Map of (place, name, value) in which the first value of a name stays."""
    return first_wins(F.transform(F.array_sort(pairs), lambda p: F.struct(p["name"].alias("key"), p["value"].alias("value"))))


def characteristics(states: DataFrame, *keep: str) -> DataFrame:
    """(``keep``, characteristics) of each page: its named values, the first of each name."""
    return name_values(states, *keep).groupBy(*keep).agg(_first_named(F.collect_list(F.struct("place", "name", "value"))).alias("characteristics"))


def _of_reviews(widget: Column) -> Column:
    return widget.rlike(f"(?iu)^({'|'.join(re.escape(prefix) for prefix in V.REVIEW_WIDGETS)})")


def _one_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text is one of ``words`` whatever its case; longer ones are not lowered."""
    return (F.length(text) <= max(map(len, words))) & F.lower(text).isin(*words)


def _with_review(found: DataFrame) -> DataFrame:
    """Add ``review``: (author, score, text, published_at, photos) of an object that is a review, else null.

    Its text is found first, once and in widgets of reviews alone; only objects with a fit one go on.
    """
    node, body = F.col("node"), F.col("_body")
    given = F.trim(F.coalesce(*[rich_text(node, f"$.{p}") for p in ("text", "comment", "body", "content.comment.text", "content.comment", "review.text")]))
    author = F.coalesce(*[_empty(field(node, f"$.{p}")) for p in ("author", "authorName", "userName", "user.name", "author.name", "author.title")])
    score = F.coalesce(*[F.nullif(field(node, f"$.{p}").try_cast("double"), F.lit(0.0)) for p in ("score", "rating", "itemRating", "content.score")]).cast("int")
    published = F.coalesce(*[rich_text(node, f"$.{p}") for p in ("publishedAt", "createdAt", "date", "publicationDate", "content.publishedAt")])
    lists = [F.from_json(F.to_json(F.try_variant_get(node, f"$.{p}", "variant")), "array<string>") for p in ("photos", "images", "content.photos", "content.images", "media")]

    def link(item: Column) -> Column:
        inner = [F.get_json_object(item, f"$.{p}") for p in ("src", "url", "image", "photo.url")]
        return F.coalesce(F.when(~F.startswith(item, F.lit("{")), item), *inner)

    every = F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))
    photos = F.slice(F.array_distinct(F.filter(F.transform(every, link), lambda u: u.rlike("^https?://"))), 1, REVIEW_PHOTOS)
    fit = (F.length(body) >= REVIEW_LEAST) & ~_one_of(body, V.CONTROL_TEXTS)
    review = F.when(fit, F.struct(author.alias("author"), score.alias("score"), body.alias("text"), published.alias("published_at"), photos.alias("photos")))
    return found.withColumn("_body", F.when(_of_reviews(F.col("widget")), given)).withColumn("review", review).drop("_body")


def _first_reviews(found: Column, limit: int) -> Column:
    """Of (place, author, ..) the first ``limit`` by place, one of equal authors and beginnings, with ``place`` from 1 and texts cut."""
    key = lambda r: F.concat_ws("\n", F.coalesce(r["review"]["author"], F.lit("")), F.substring(r["review"]["text"], 1, 120))
    rows = F.array_sort(found)
    fresh = F.slice(F.filter(rows, lambda r, i: F.array_position(F.transform(rows, key), key(r)) == i + 1), 1, limit)
    cut = lambda r, i: F.struct((i + 1).alias("place"), *[r["review"][c].alias(c) for c in ("author", "score")], F.substring(r["review"]["text"], 1, REVIEW_CHARS).alias("text"), *[r["review"][c].alias(c) for c in ("published_at", "photos")])
    return F.transform(fresh, cut)


def widget_reviews(states: DataFrame, *keep: str, limit: int = 5) -> DataFrame:
    """(``keep``, place, author, score, text, published_at, photos): the first ``limit`` reviews of each page, in the order of its text.

    Only widgets of reviews count.  Every object with a text counts, so the content of a review comes again without its author
    where that stands outside.  Texts have REVIEW_LEAST characters at least and are cut at REVIEW_CHARS; of equal authors and beginnings the
    first stays; photos are links, each once, REVIEW_PHOTOS at most.
    """
    # No filter by review: it would be pushed below the step that finds it, which would then run twice.
    found = _with_review(objects(states.where(_of_reviews(F.col("widget"))), *keep))
    pages = found.groupBy(*keep).agg(_first_reviews(F.collect_list(F.when(F.col("review").isNotNull(), F.struct("place", "review"))), limit).alias("_r"))
    return pages.select(*keep, F.inline("_r"))


def pages(states: DataFrame, *keep: str, reviews: int = 5) -> DataFrame:
    """What the widgets of each product page say: (``keep``, name, sku, price, rating, reviews_count, images, characteristics, reviews).

    The first widget in the page that has a value gives it; images are those of all galleries, each once.  One walk and one
    aggregate; a group holds what one page's text does.
    """
    node, w = F.col("node"), F.col("widget")
    n = _with_review(_with_named(objects(states, *keep)))
    root, place = F.col("first"), F.col("place")
    price = numbers.digits_price(F.coalesce(*[rich_text(node, f"$.{k}") for k in ("cardPrice", "price", "finalPrice")]))
    listed = F.from_json(F.to_json(F.coalesce(*[F.try_variant_get(node, f"$.{k}", "variant") for k in ("images", "coverImage")])), "array<string>")
    picture = lambda i: F.when(~F.startswith(i, F.lit("{")), i).when(F.coalesce(F.get_json_object(i, "$.type"), F.lit("image")).isin("image", ""), F.coalesce(F.get_json_object(i, "$.src"), F.get_json_object(i, "$.url")))
    images = F.filter(F.transform(listed, picture), lambda u: u.isNotNull())
    rating = F.coalesce(*[F.nullif(field(node, f"$.{k}").try_cast("double"), F.lit(0.0)) for k in ("score", "totalScore")])
    facts = {
        "name": (w.startswith("webProductHeading"), rich_text(node, "$.title")), "sku": (w.startswith("webProductMainWidget"), field(node, "$.sku")),
        "price": (w.contains("webPrice") | w.startswith("webOzonAccountPrice"), price), "rating": (w.startswith("webReviewProductScore"), rating),
        "reviews_count": (w.startswith("webReviewProductScore"), field(node, "$.reviewsCount").try_cast("int")), "images": (w.startswith("webGallery"), images),
    }
    said = n.select(*keep, "place", *[F.when(root & of, value).alias(name) for name, (of, value) in facts.items()], "named", "review")
    first = [F.min_by(name, F.when(F.col(name).isNotNull(), place)).alias(name) for name in facts if name != "images"]
    gallery = F.array_sort(F.collect_list(F.when(F.col("images").isNotNull(), F.struct("place", "images"))))
    return said.groupBy(*keep).agg(
        *first, F.array_distinct(F.flatten(F.transform(gallery, lambda g: g["images"]))).alias("images"),
        _first_named(F.collect_list(F.when(F.col("named").isNotNull(), F.struct("place", "named.name", "named.value")))).alias("characteristics"),
        _first_reviews(F.collect_list(F.when(F.col("review").isNotNull(), F.struct("place", "review"))), reviews).alias("reviews"),
    )


def backfilled(stubs: DataFrame, captured: DataFrame, payload: str = "payload", key: str = "url", reviews: int = 5) -> DataFrame:
    """Stubs (``key``, item_id, name, price, rating, reviews_count) with what their product page adds: own values stay.

    Adds images, characteristics and reviews of the page.  Stubs without a page stay as they are.
    """
    filled = {"item_id": "sku", "name": "name", "price": "price", "rating": "rating", "reviews_count": "reviews_count"}
    found = pages(widget_states(captured, payload, key), key, reviews=reviews).withColumnsRenamed({c: f"_{c}" for c in filled.values()})
    # Spark takes a page's facts for no larger than the table they were made of, and would send them whole to the driver.
    joined = stubs.join(found.hint("merge"), key, "left")
    blank = lambda c: _empty(F.col(c)) if c in ("item_id", "name") else F.col(c)
    return joined.select(*[F.coalesce(blank(c), F.col(f"_{filled[c]}")).alias(c) if c in filled else F.col(c) for c in stubs.columns], "images", "characteristics", "reviews")
