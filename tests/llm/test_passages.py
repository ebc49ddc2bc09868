"""op7_line_dedup and the pipeline's line stage on planted passages."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from bazaarium.llm import line_dedup, queries

SCHEMA = "doc_id long, text string"


def removed(spark, rows):
    out = line_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA), passages=True).collect()
    return {r.doc_id: (r.text, r.lines_removed) for r in out}


def prose(rng, lines, words, tag):
    return [" ".join(f"{tag}{rng.randrange(10**6)}" for _ in range(words)) for _ in range(lines)]


def test_planted_passages_of_all_lengths_go(spark):
    rng, rows, want = random.Random(1), [], {}
    for n in range(1, 31):
        passage = prose(rng, n, 51 // n + 1, f"p{n}x")
        for k in range(4):
            around = [prose(rng, rng.randrange(1, 6), 9, f"a{n}y{k}z") for _ in range(2)]
            i = 100 * k + n
            rows.append((i, "\n".join([*around[0], *passage, *around[1]])))
            want[i] = (rows[-1][1], 0) if k == 0 else ("\n".join([*around[0], *around[1]]), n)
    assert removed(spark, rows) == want


def test_short_ordinary_lines_stay(spark):
    rows = [(n, f"own text {n}\nAll rights reserved.\nShare this page\nmore of {n}") for n in range(1, 9)]
    plain = {r.doc_id: (r.text, r.lines_removed) for r in line_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert removed(spark, rows) == plain


def test_every_line_stays_at_its_first_place(spark, docs):
    out = line_dedup.deduplicated(docs, passages=True).collect()
    before, first = {r.doc_id: r.text for r in docs.collect()}, {}
    for i in sorted(before):
        for line in (before[i] or "").split("\n"):
            first.setdefault(line, i)
    left = defaultdict(set)
    for r in out:
        for line in (r.text or "").split("\n"):
            left[r.doc_id].add(line)
    assert all(line in left[i] for line, i in first.items() if line)


@pytest.mark.parametrize("n", [1, 3])
def test_query_removes_short_passages(spark, tmp_path, n):
    rng = random.Random(n)
    passage = prose(rng, n, 60, "p")
    rows = [(i, "\n".join([f"begin {i}", *passage, f"end {i}"])) for i in (1, 2)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.lines_removed for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: n}


def test_line_stage_keeps_words_of_their_own(spark):
    passage = "\n".join(prose(random.Random(4), 20, 12, "p"))
    table = [(1, passage, 0), (2, f"{passage}\na few words of its own", 0), (3, passage, 0), (4, "", 0)]
    out = corpus_pipeline.lines(spark, spark.createDataFrame(table, f"{SCHEMA}, n_chars long"), "").collect()
    assert {r.doc_id: r.text for r in out} == {1: passage, 2: "a few words of its own", 4: ""}
