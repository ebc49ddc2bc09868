"""Pre-tokens of words and what is remembered of them."""

import random
from array import array

from bazaarium.llm import byte_bpe, queries

WORDS = ["it's", "'s", "\n", "\tx", "", "a b", "é", "é!!", "²!", "x²..", "don't!!", "a'", "'!", "don't\n\ny", "x" * 70, "\x1cq", "1st", "--", "🙂", "Ġ", "á!", "ʰx?", "Ⅷ.", "_x_", "x_1", "x.\ny"]


def test_ids_are_the_librarys():
    bpe = byte_bpe.ByteBpe(queries.vocabulary(queries.BYTE_BPE))
    rng = random.Random(1)
    for _ in range(500):
        text = " ".join(rng.choices(WORDS, k=20))
        assert bpe.encode(text) == array(bpe.code, bpe.text_ids(text)).tobytes()


def test_words_that_differ_in_marks_are_looked_up_once():
    bpe = byte_bpe.ByteBpe(queries.vocabulary(queries.BYTE_BPE))
    seen, find = [], bpe.piece_ids
    bpe.piece_ids = lambda p: (seen.append(p), find(p))[1]
    bpe.encode("a laesoado! laesoado!! laesoado, laesoado onrere!")
    assert sorted(seen) == [" laesoado", " onrere", "!", "!!", ",", "a"]
