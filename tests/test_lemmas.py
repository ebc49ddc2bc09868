"""Dictionary forms and the synonyms that hang on them."""

import pytest

from bazaarium.functions.lemmas import declined, lemma_of
from bazaarium.operators.normalize import FORMS, synonym_alternates
from bazaarium.plans.payloads import DECLINED


@pytest.mark.parametrize("word, lemma", [*DECLINED, *FORMS.items()])
def test_lemmas(word, lemma):
    assert lemma_of(word) == lemma


def test_forms_collapse():
    assert lemma_of("наушниках") == lemma_of("наушники") == lemma_of("наушником")
    for word in ("пылесос", "куртка", "кабель", "обогреватель", "станция"):
        forms = declined(word)
        assert sum(lemma_of(f) == word for f in forms) >= 0.7 * len(forms), word


@pytest.mark.parametrize("text, found", [("ищу наушники", True), ("обзор наушников", True), ("чехол для смартфонами", True), ("стол", False), ("", False)])
def test_alternates_of_any_form(spark, text, found):
    queries = spark.createDataFrame([(1, text)], "query_id int, normalized string")
    assert (synonym_alternates(queries).count() > 0) == found


def test_alternates_are_capped(spark):
    queries = spark.createDataFrame([(1, "телефонами ноутбуков наушникам")], "query_id int, normalized string")
    assert synonym_alternates(queries, most=2).count() == 2
