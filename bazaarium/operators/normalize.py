"""Query normalisation: cleaning, typos, translation of brands, synonyms and clarification.

Every step over a dictionary works on the distinct tokens of all queries, joined back to them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarium import values as V
from bazaarium.functions import text
from bazaarium.functions.fuzzy import indel_ratio
from bazaarium.functions.lemmas import lemma, lemma_of

#: Terms that a typo may be corrected to, in order.
TERMS = tuple(sorted({*V.BRANDS, *V.BRANDS.values(), *V.PHRASES}))

#: Other forms of the words in synonym groups, as the SQL of the catalogue knows them.
FORMS = {
    "наушниках": "наушники", "наушником": "наушники", "наушников": "наушники", "гарнитуры": "гарнитура", "гарнитуру": "гарнитура",
    "телефона": "телефон", "телефоны": "телефон", "смартфоны": "смартфон", "смартфона": "смартфон", "ноутбуки": "ноутбук",
    "ноутбука": "ноутбук", "телевизоры": "телевизор", "телевизора": "телевизор", "компьютера": "компьютер", "компьютеры": "компьютер",
    "колонки": "колонка", "колонку": "колонка", "мыши": "мышь", "мышки": "мышка", "кроссовок": "кроссовки", "кед": "кеды",
    "кофеварки": "кофеварка", "кофеварку": "кофеварка", "кофемашины": "кофемашина", "кофемашину": "кофемашина", "мониторы": "монитор",
    "рюкзаки": "рюкзак", "рюкзака": "рюкзак", "видеокарты": "видеокарта", "видеокарту": "видеокарта", "планшеты": "планшет", "планшета": "планшет",
}


def _terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(TERMS)], "term string, place int")


def corrections(tokens: DataFrame) -> DataFrame:
    """(token, fixed, ratio) of distinct ``tokens.token``: the most similar term of ratio TYPO_CUTOFF or more, the first of equals.

    Tokens under TYPO_LEAST_CHARS characters and numbers stay.  Only terms whose length allows the ratio are compared:
    2 min / (a + b) bounds it, so a token joins the terms of a few lengths.
    """
    spark = tokens.sparkSession
    able = tokens.select("token").distinct().where((F.length("token") >= V.TYPO_LEAST_CHARS) & ~F.col("token").rlike(r"(?U)^\d+$"))
    share = V.TYPO_CUTOFF / (200 - V.TYPO_CUTOFF)
    lengths = F.sequence(F.ceil(F.length("token") * share).cast("int"), F.floor(F.length("token") / share).cast("int"))
    sized = able.withColumn("size", F.explode(lengths))
    terms = _terms(spark).withColumn("size", F.length("term"))
    # The terms are a fixed table.
    pairs = sized.join(F.broadcast(terms), "size").withColumn("ratio", indel_ratio(F.col("token"), F.col("term"))).where(F.col("ratio") >= V.TYPO_CUTOFF)
    best = F.max_by(F.struct("term", "ratio"), F.struct("ratio", -F.col("place")))
    return pairs.groupBy("token").agg(best.alias("b")).select("token", F.col("b.term").alias("fixed"), F.col("b.ratio").alias("ratio"))


def _by_token(queries: DataFrame, column: str) -> DataFrame:
    return queries.select("query_id", F.posexplode_outer(text.split_words(F.col(column))).alias("place", "token"))


def corrected(queries: DataFrame, column: str = "cleaned") -> DataFrame:
    """(query_id, fixed, notes): tokens with typos corrected, and what was."""
    tokens = _by_token(queries, column)
    found = corrections(tokens.where("token IS NOT NULL"))
    joined = tokens.join(found.select("token", F.col("fixed").alias("_fixed")), "token", "left")
    new = F.coalesce("_fixed", "token")
    item = F.struct("place", new.alias("token"), F.when(new != F.col("token"), F.concat(F.lit("опечатка: "), F.col("token"), F.lit(" → "), new)).alias("note"))
    grouped = joined.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), item))).alias("t"))
    notes = F.filter(F.transform("t", lambda x: x["note"]), lambda n: n.isNotNull())
    return grouped.select("query_id", F.array_join(F.transform("t", lambda x: x["token"]), " ").alias("fixed"), notes.alias("notes"))


def synonym_table(spark: SparkSession) -> DataFrame:
    """(lemma, synonym, group_place): what may stand for a word; the last group a word is in counts."""
    of = {member: group for group in V.SYNONYMS for member in group}
    rows = [(lemma_of(m), other, i) for m, group in of.items() for i, other in enumerate(group) if lemma_of(other) != lemma_of(m)]
    return spark.createDataFrame(rows, "lemma string, synonym string, group_place int")


def synonym_alternates(queries: DataFrame, column: str = "normalized", most: int = 3, lemmatise: Callable[[Column], Column] = lemma) -> DataFrame:
    """(query_id, alternate, note, number) of each query: one word swapped for a synonym at a time, the first ``most``.

    ``lemmatise`` may be any column function that gives a word's dictionary form; the default declines.
    """
    tokens = queries.select("query_id", F.col(column).alias("_whole"), text.split_words(F.col(column)).alias("_all"), F.posexplode(text.split_words(F.col(column))).alias("place", "token"))
    joined = tokens.withColumn("lemma", lemmatise(F.col("token"))).join(F.broadcast(synonym_table(queries.sparkSession)), "lemma")  # a fixed table
    swapped = F.array_join(F.transform("_all", lambda w, i: F.when(i == F.col("place"), F.col("synonym")).otherwise(w)), " ")
    made = joined.select("query_id", "place", "group_place", swapped.alias("alternate"), F.concat(F.lit("синоним: "), F.col("token"), F.lit(" → "), F.col("synonym")).alias("note"), "_whole").where("alternate <> _whole")
    once = made.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "alternate").orderBy("place", "group_place"))).where("_n = 1")
    order = W.partitionBy("query_id").orderBy("place", "group_place")
    return once.withColumn("number", F.row_number().over(order)).where(F.col("number") <= most).select("query_id", "alternate", "note", "number")


def normalized(queries: DataFrame, fix: bool = True, spelling: Callable[[Column], Column] | None = None, compose: bool = True, lemmatise: Callable[[Column], Column] = lemma) -> DataFrame:
    """(query_id, raw, normalized, expansions, alternates) of (query_id, raw).

    Without ``fix`` texts are only cleaned.  ``spelling`` may be any column function that corrects a text,
    ``lemmatise`` one that gives a word's dictionary form.
    """
    cleaned = queries.select("query_id", "raw", text.clean(F.col("raw"), compose).alias("cleaned"))
    empty = F.array().cast("array<string>")
    if not fix:
        return cleaned.select("query_id", "raw", F.col("cleaned").alias("normalized"), empty.alias("expansions"), empty.alias("alternates"))
    fixed = cleaned.join(corrected(cleaned), "query_id")
    spelled = spelling(F.col("fixed")) if spelling else F.col("fixed")
    fixed = fixed.withColumn("spelled", F.coalesce(F.nullif(spelled, F.lit("")), F.col("fixed"))).withColumn("normalized", text.translate(F.col("spelled")))

    def note(word: str, a: str, b: str) -> Column:
        return F.when(F.col(a) != F.col(b), F.concat(F.lit(f"{word}: «"), F.col(a), F.lit("» → «"), F.col(b), F.lit("»")))

    said = F.filter(F.array(note("опечатка", "fixed", "spelled"), note("перевод", "spelled", "normalized")), lambda n: n.isNotNull())
    found = synonym_alternates(fixed, lemmatise=lemmatise).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("number", "alternate", "note"))).alias("s"))
    out = fixed.join(found, "query_id", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<number: int, alternate: string, note: string>>")))
    return out.select("query_id", "raw", "normalized", F.concat("notes", said, F.transform("s", lambda x: x["note"])).alias("expansions"), F.transform("s", lambda x: x["alternate"]).alias("alternates"))


def clarified(queries: DataFrame) -> DataFrame:
    """(query_id, number, label, text, query): options of the queries that name two things."""
    options = queries.select("query_id", F.posexplode(text.clarification(F.col("raw"))).alias("number", "o"))
    return options.select("query_id", (F.col("number") + 1).alias("number"), "o.label", "o.text", "o.query")
