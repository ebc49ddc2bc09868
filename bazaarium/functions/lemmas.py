"""Dictionary forms of Russian nouns and adjectives, by declensions and by the endings of words like them.

Words of a vocabulary are declined by rule; a form of one of them leads back to it.  Any other word takes the rule that most
forms with its longest known ending follow: how many letters go and what comes in their place.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarium import values as V

#: Endings of all cases by that of the dictionary form, longer ones first; "к" stands for consonants that take и, "" for others.
DECLENSIONS = {
    "ая": ("ая", "ой", "ую", "ые", "ых", "ым", "ыми"), "ый": ("ый", "ого", "ому", "ым", "ом", "ая", "ой", "ую", "ое", "ые", "ых", "ыми"),
    "ка": ("ка", "ки", "ке", "ку", "кой", "кою", "ок", "ек", "кам", "ками", "ках"), "ия": ("ия", "ии", "ию", "ией", "ий", "иям", "иями", "иях"),
    "ие": ("ие", "ия", "ию", "ием", "ии", "ий", "иям", "иями", "иях"), "ки": ("ки", "ок", "ков", "кам", "ками", "ках", "к", "ка", "ку", "ком", "ке"),
    "а": ("а", "ы", "е", "у", "ой", "ою", "", "ам", "ами", "ах"), "я": ("я", "и", "е", "ю", "ей", "ь", "ям", "ями", "ях"), "о": ("о", "а", "у", "ом", "е", "", "ам", "ами", "ах"),
    "ы": ("ы", "", "ов", "ам", "ами", "ах", "а", "у", "ом", "е"), "ь": ("ь", "и", "я", "ю", "ью", "ем", "е", "ей", "ям", "ями", "ях"), "й": ("й", "я", "ю", "ем", "е", "и", "ев", "ям", "ями", "ях"),
    "к": ("", "а", "у", "ом", "ем", "е", "и", "ов", "ей", "ам", "ами", "ах"), "": ("", "а", "у", "ом", "е", "ы", "ов", "ам", "ами", "ах"),
}
SIBILANTS = "гкхжшчщ"
#: Goods whose forms show how words like them end, besides the words that have synonyms.
GOODS = (
    "холодильник", "чайник", "светильник", "пылесос", "утюг", "стол", "диван", "шкаф", "фонарь", "ковёр", "принтер", "роутер", "проектор", "процессор", "вентилятор", "кондиционер", "аккумулятор", "кабель", "увлажнитель", "обогреватель",
    "камера", "лампа", "посуда", "машина", "печь", "кровать", "модель", "куртка", "зарядка", "приставка", "плитка", "клавиатура", "сумка", "книга", "игрушка", "рубашка", "батарея", "антенна", "станция", "система", "кресло", "зеркало", "одеяло",
    "ботинки", "часы", "джинсы", "брюки", "очки", "освещение", "оборудование", "чехол", "экран", "штатив", "велосипед", "самокат", "беспроводная", "умный", "детский", "новый", "игровая",
)
LONGEST = 7


def declined(word: str) -> list[str]:
    """Forms of a word by the declension of its ending."""
    for ending in sorted(DECLENSIONS, key=len, reverse=True):
        if ending not in ("к", "") and word.endswith(ending) and len(word) > len(ending) + 1:
            return [word[: len(word) - len(ending)] + e for e in DECLENSIONS[ending]]
    return [word + e for e in DECLENSIONS["к" if word[-1] in SIBILANTS else ""]]


@cache
def _learned() -> tuple[dict[str, str], dict[str, tuple[int, str]]]:
    """Forms of the words that have synonyms, and the rule of each ending of two letters or more."""
    known = [w for group in V.SYNONYMS for w in group if any(c in "аеёиоуыэюя" for c in w)]
    forms = {form: word for word in reversed(known) for form in declined(word)} | {w: w for group in V.SYNONYMS for w in group}
    votes: dict[str, Counter] = defaultdict(Counter)
    for word in (*known, *GOODS):
        for form in declined(word):
            same = next((i for i, (a, b) in enumerate(zip(form, word, strict=False)) if a != b), min(len(form), len(word)))
            cut, add = len(form) - same, word[same:]
            for n in range(max(cut, 2), min(LONGEST, len(form)) + 1):
                votes[form[len(form) - n :]][cut, add] += 1
    rules = {ending: max(found, key=lambda r: (found[r], -r[0], r[1])) for ending, found in votes.items()}
    return forms, rules


def lemma_of(word: str) -> str:
    """Dictionary form of a word, in lower case; a word without Cyrillic letters or of a kind not known is its own."""
    low = word.lower().strip()
    forms, rules = _learned()
    if low in forms:
        return forms[low]
    if len(low) < 4 or not all("а" <= c <= "я" or c == "ё" for c in low):
        return low
    for n in range(min(LONGEST, len(low) - 2), 1, -1):
        rule = rules.get(low[len(low) - n :])
        if rule is not None:
            return low[: len(low) - rule[0]] + rule[1]
    return low


def lemma(word: Column) -> Column:
    """``lemma_of`` in batches: the rules are a dictionary of some thousand endings, which no expression looks up as fast."""

    @F.pandas_udf("string")
    def found(words: pd.Series) -> pd.Series:
        known = {w: lemma_of(w) for w in words.dropna().unique()}
        return words.map(known)

    return found(word)
