"""Text functions and query normalisation against stated behaviour and plain-Python versions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bazaarium.functions import text
from bazaarium.functions.fuzzy import indel_ratio, lcs, token_set_ratio
from bazaarium.operators import normalize


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        done = [0]
        for j, y in enumerate(b):
            done.append(row[j] + 1 if x == y else max(done[-1], row[j + 1]))
        row = done
    return row[-1]


def plain_ratio(a, b):
    wa, wb = set(a.split()), set(b.split())
    if not wa or not wb:
        return 0.0
    both, x, y = (" ".join(sorted(s)) for s in (wa & wb, wa - wb, wb - wa))
    if both and (not x or not y):
        return 100.0
    gap = 1 if both else 0
    la, lb = len(both) + gap + len(x), len(both) + gap + len(y)
    best = 100 - 100 * (len(x) + len(y) - 2 * plain_lcs(x, y)) / (la + lb)
    if not both:
        return best
    return max(best, 100 - 100 * (gap + len(x)) / (len(both) + la), 100 - 100 * (gap + len(y)) / (len(both) + lb))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text("абвab ", max_size=12), st.text("абвab ", max_size=12)), min_size=1, max_size=30))
def test_fuzzy_against_plain(spark, pairs):
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lcs(F.col("a"), F.col("b")).alias("n"), token_set_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in rows:
        assert r.n == plain_lcs(r.a, r.b)
        assert r.r == pytest.approx(plain_ratio(r.a, r.b), abs=1e-9)


@pytest.mark.parametrize(("a", "b", "expected"), [("iphone 15", "Apple iPhone 15 128GB", 53.3333), ("iphone 15", "iphone 15 128gb", 100), ("red widget", "blue ring", 42.1053), ("red ring", "red widget Brand#17", 54.5455), ("", "x", 0)])
def test_token_set_ratio(spark, a, b, expected):
    assert one(spark, token_set_ratio(F.lit(a), F.lit(b))) == pytest.approx(expected, abs=1e-4)


def test_indel_ratio_on_the_cutoff(spark):
    assert one(spark, indel_ratio(F.lit("айвон"), F.lit("айфон"))) == 80.0


@pytest.mark.parametrize(
    ("raw", "expected", "note"),
    [("Айфон 15 Про", "iphone 15 pro", "перевод"), ("кроссовки найк", "кроссовки nike", "перевод"), ("наушники сони", "наушники sony", "перевод"), ("пылесос", "пылесос", ""), ("айвон 15", "iphone 15", "опечатка"), ("ps 5", "ps 5", ""), ("  iPhone 15!!  ", "iphone 15", ""), ("", "", "")],
)
def test_normalised(spark, raw, expected, note):
    got = normalize.normalized(spark.createDataFrame([(1, raw)], "query_id long, raw string")).first()
    assert got.normalized == expected
    assert note in " ".join(got.expansions)


def test_without_fixing_text_is_only_cleaned(spark):
    got = normalize.normalized(spark.createDataFrame([(1, "Айфон 15!")], "query_id long, raw string"), fix=False).first()
    assert (got.normalized, got.expansions, got.alternates) == ("айфон 15", [], [])


def test_synonyms(spark):
    q = spark.createDataFrame([(1, "беспроводные наушниках"), (2, "стол"), (3, "телефон ноутбук тв пк")], "query_id long, normalized string")
    got = {}
    for r in normalize.synonym_alternates(q).orderBy("query_id", "number").collect():
        got.setdefault(r.query_id, []).append(r.alternate)
    assert got[1] == ["беспроводные гарнитура"]
    assert 2 not in got
    assert got[3] == ["смартфон ноутбук тв пк", "мобильник ноутбук тв пк", "телефон лэптоп тв пк"]


@pytest.mark.parametrize(("query", "halves"), [("лодка и яблоко", ("лодка", "яблоко")), ("айфон + наушники", ("айфон", "наушники")), ("ноутбук asus 15 i5 16gb", None), ("телевизор, samsung", None), ("дом", None), ("", None), (None, None)])
def test_ambiguous(spark, query, halves):
    got = one(spark, text.ambiguous_halves(F.lit(query).cast("string")))
    assert (None if got is None else tuple(got)) == halves


def test_clarification_has_three_options(spark):
    options = one(spark, text.clarification(F.lit("лодка и яблоко")))
    assert [o.label for o in options] == ["Лодка", "Яблоко", "Искать как написано"]


def test_relevance_bounds(spark):
    def score(query, name, chars=None, rating=None, reviews=None):
        m = F.create_map(*[F.lit(x) for kv in (chars or {"a": "b"}).items() for x in kv])
        return one(spark, text.relevance(F.lit(query), F.lit(name), m, F.lit(rating).cast("double"), F.lit(reviews).cast("int")))

    assert score("", "x") == 0.0
    assert score("и в", "x") == 0.0
    assert score("iphone 15", "iphone 15 128gb", rating=5.0, reviews=100000) == 100.0
    assert score("red ring", "red widget Brand#17") == pytest.approx(54.5)
    assert score("abc 15", "xyz", {"Память": "15"}) > score("abc 15", "xyz", {"Прочее": "15"})


@pytest.mark.parametrize(("raw", "expected"), [("На фото красный чайник.\nещё", "красный чайник"), ("чайник", "чайник"), ("", ""), (None, None)])
def test_image_query(spark, raw, expected):
    assert one(spark, text.image_query(F.lit(raw).cast("string"))) == expected


def test_image_query_is_cut_at_a_word(spark):
    got = one(spark, text.image_query(F.lit("слово " * 40)))
    assert len(got) <= 120
    assert set(got.split()) == {"слово"}


@pytest.mark.parametrize(("raw", "expected"), [("0", 50), ("140", 100), ("-3", 0), ("71", 71), ("x", 50), (None, 50)])
def test_aspect_score(spark, raw, expected):
    assert one(spark, text.aspect_score(F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize(("raw", "fixed", "expected"), [("привет мир", "Привет, мир!", "привет, мир"), ("Привет", "Привет.", "Привет")])
def test_spelling_applied(spark, raw, fixed, expected):
    assert one(spark, text.spelling_applied(F.lit(raw), F.lit(fixed))) == expected


@pytest.mark.parametrize(("label", "expected"), [("POSITIVE", "positive"), ("neg", "negative"), ("LABEL_1", "neutral")])
def test_sentiment_label(spark, label, expected):
    assert one(spark, text.sentiment_label(F.lit(label))) == expected
