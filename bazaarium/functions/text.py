"""Text: cleaning, tokens, translation of brands, typos, synonyms, clarification and relevance."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarium import values as V
from bazaarium.functions.fuzzy import let, token_set_ratio


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def clean(text: Column, compose: bool = False) -> Column:
    """Lower-case; what is neither word, space nor one of ``-+./`` becomes a space; spaces collapse.

    ``compose`` adds the NFKC step, in Python; Cyrillic and ASCII texts are the same without it.
    """
    lowered = F.lower(nfkc(text) if compose else text)
    kept = F.regexp_replace(lowered, r"(?U)[^\w\s\-+./]", " ")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def split_words(text: Column) -> Column:
    """Words between white space; none for a blank text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table, or null."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def translate(text: Column) -> Column:
    """Phrases, longest first, anywhere in the lower-cased text; then tokens; joined by single spaces."""
    out = F.lower(text)
    for phrase in sorted(V.PHRASES, key=len, reverse=True):
        out = F.replace(out, F.lit(phrase), F.lit(V.PHRASES[phrase]))
    table = F.create_map(*[F.lit(x) for pair in V.BRANDS.items() for x in pair])
    return F.array_join(F.transform(split_words(out), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def query_tokens(text: Column) -> Column:
    """Runs of Latin and Russian letters and digits, without stop words and single characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-zа-яё0-9]+)"), 1)
    stop = F.array(*[F.lit(w) for w in V.STOPWORDS])
    return F.filter(found, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def telling_values(characteristics: Column) -> Column:
    """Values whose key, in lower case, has one of the telling words in it."""
    def telling(k: Column, v: Column) -> Column:
        out = F.lit(False)
        for word in V.TELLING_KEYS:
            out = out | F.contains(F.lower(k), F.lit(word))
        return out & v.isNotNull() & (v != "")

    return F.map_values(F.map_filter(F.coalesce(characteristics, F.create_map().cast("map<string,string>")), telling))


def spec_bonus(tokens: Column, haystack: Column) -> Column:
    """8 for each token of the query that looks like a specification and is in the haystack, 25 at most."""
    hits = F.filter(tokens, lambda w: w.rlike(V.SPEC_PATTERN) & F.array_contains(haystack, w))
    return F.least(F.size(hits) * F.lit(8.0), F.lit(25.0))


def trust_bonus(base: Column, rating: Column, reviews: Column) -> Column:
    """Up to 10 for well reviewed offers, in proportion to the text score; none below 30."""
    weight = F.least(F.lit(1.0), F.log10(F.coalesce(reviews, F.lit(0)) + F.lit(1.0)) * F.coalesce(rating, F.lit(4.0)) / 15)
    return F.when(base < 30, F.lit(0.0)).otherwise(weight * 10 * base / 100)


def relevance(query: Column, name: Column, characteristics: Column, rating: Column, reviews: Column, casefold: bool = False) -> Column:
    """Score 0 to 100 of an offer for a query, to one digit; 0 for a blank query or name or a query without tokens.

    The fuzzy part compares texts as written; ``casefold`` compares them in lower case.
    """
    query, name = F.trim(query), F.trim(name)
    text = F.trim(F.concat_ws(" ", name, F.array_join(telling_values(characteristics), " ")))

    def score(t: Column) -> Column:
        a, b = (F.lower(t["query"]), F.lower(t["text"])) if casefold else (t["query"], t["text"])
        return let(token_set_ratio(a, b), lambda base: total(base, t))

    def total(base: Column, t: Column) -> Column:
        added = base + spec_bonus(t["tokens"], query_tokens(t["text"])) + trust_bonus(base, rating, reviews)
        return F.when(F.size(t["tokens"]) == 0, F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), added)), 1))

    blank = (F.coalesce(query, F.lit("")) == "") | (F.coalesce(name, F.lit("")) == "")
    return F.when(blank, F.lit(0.0)).otherwise(let(F.struct(query.alias("query"), text.alias("text"), query_tokens(query).alias("tokens")), score))


def ambiguous_halves(query: Column) -> Column:
    """The two things a query of 5 characters or more names, as struct(left, right), or null.

    They stand around the first separators.  Each must have a word that is no specification, and neither may be a brand
    alone.
    """
    lowered = F.lower(F.trim(query))
    parts = F.filter(F.transform(F.split(lowered, V.CLARIFY_SPLIT), lambda p: F.trim(p)), lambda p: p != "")
    left, right = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    brands = F.array(*[F.lit(b) for b in V.CLARIFY_BRANDS])

    def separate(part: Column) -> Column:
        return F.exists(split_words(part), lambda w: ~w.rlike(V.CLARIFY_SPEC)) & ~F.array_contains(brands, part)

    ok = (F.length(lowered) >= 5) & (F.size(parts) >= 2) & separate(left) & separate(right)
    return F.when(ok, F.struct(left.alias("left"), right.alias("right")))


def capitalised(text: Column) -> Column:
    """First letter upper-case, the rest lower-case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def clarification(query: Column) -> Column:
    """Three options (label, text, query) for an ambiguous query: either half, or as written; else null."""
    halves = ambiguous_halves(query)

    def option(label: Column, text: Column, q: Column) -> Column:
        return F.struct(label.alias("label"), text.alias("text"), q.alias("query"))

    def half(part: Column) -> Column:
        return option(capitalised(part), F.concat(F.lit("Искать только «"), part, F.lit("»")), part)

    literal = option(F.lit("Искать как написано"), F.concat(F.lit("Искать «"), query, F.lit("» по всему каталогу")), query)
    return F.when(halves.isNotNull(), F.array(half(halves["left"]), half(halves["right"]), literal))


def sentiment_label(label: Column) -> Column:
    """positive, negative or neutral from any model's label."""
    low = F.lower(label)
    return F.when(F.contains(low, F.lit("pos")), "positive").when(F.contains(low, F.lit("neg")), "negative").otherwise("neutral")


def image_query(text: Column) -> Column:
    """A model's answer as a query: first line, lead-ins and outer marks gone, at most 120 characters cut at a word."""
    def dropped(line: Column, lead: Column) -> Column:
        return F.when(F.startswith(line, lead), F.substr(line, F.length(lead) + 1)).otherwise(line)

    first = F.split(F.trim(text), "\\R")[0]
    # A fold names the line once for each lead-in; nested expressions would name it thrice at each level.
    line = F.aggregate(F.array(*map(F.lit, V.IMAGE_LEADS)), first, dropped)

    def shown(bare: Column) -> Column:
        cut = F.regexp_replace(F.substring(bare, 1, 120), r" [^ ]*$", "")
        return F.when(F.length(bare) > 120, cut).otherwise(bare)

    return let(F.btrim(line, F.lit(V.IMAGE_MARKS)), shown)


def aspects(items: Column) -> Column:
    """Of the first 6 aspects (label, mentions: string) those with a label, cut to 40 characters; no number counts 0."""
    cut = F.transform(F.slice(F.coalesce(items, F.array()), 1, 6), lambda a: F.struct(F.substring(F.trim(a["label"]), 1, 40).alias("label"), F.coalesce(a["mentions"].try_cast("int"), F.lit(0)).alias("mentions")))
    return F.filter(cut, lambda a: F.coalesce(a["label"], F.lit("")) != "")


def aspect_score(raw: Column) -> Column:
    """A model's score within 0 to 100; 0, none and no number count 50."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.nullif(raw.try_cast("int"), F.lit(0)), F.lit(50))))


def spelling_applied(raw: Column, fixed: Column) -> Column:
    """A spelling model's output without its closing marks, lower-case if the input did not begin upper-case."""
    bare = F.regexp_replace(F.trim(fixed), r"[.!?,;:]+$", "")
    first = F.substring(F.ltrim(raw), 1, 1)
    return F.when((first == F.upper(first)) & (first != F.lower(first)), bare).otherwise(F.lower(bare))
