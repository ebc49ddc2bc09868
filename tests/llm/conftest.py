"""Small tables with every odd case, and the driver's smallest documents."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
SF = "/root/testdata/sf0.001"

LONG = "\n".join(f"line {n} of a very long text, with some words" for n in range(4000))
SHARED = "\n".join(f"shared passage line {n}" for n in range(30))
#: (doc_id, text, lang, source, n_chars): nulls, empty and blank texts, repeated rows, ties, a long text, odd characters.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a", 1), (1, "The quick brown fox jumps over the lazy dog", "en", "a", 1),
    (2, "the QUICK brown fox jumps over  the lazy dog", "en", "a", 2), (3, None, "en", "a", None), (4, "", None, None, 0), (5, " \t\n ", "de", "b", 4),
    (6, LONG, "en", "b", 6), (7, f"own first line\n{SHARED}\nown last line", "de", "b", 7), (8, f"another beginning\nand one more\n{SHARED}", "de", None, 8),
    (9, "naïve 漢字 🙂   x y <|endoftext|> done", None, "c", 9), (10, "word", "de", "c", 10), (11, "12 34 !!", "en", "c", 11), (12, "The quick brown fox jumps over the lazy dog", "en", "a", 1),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ["_id", "_print", "_mark", "_of", "_row", "_times", "cut", "row", "fp", "n", "size", "start", "component", "lines_removed", "words_before", "c0", "key", "piece", "score"]


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, COLUMNS).select("*", *[F.lit(n).alias(c) for n, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
