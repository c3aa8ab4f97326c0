"""Index terms: diacritics folded, English suffixes stripped by Porter's algorithm (1980).

Both have no built-in form; they run over *distinct* terms in Arrow batches and are joined back.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..session import ship


def fold(term: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", term.lower()) if not unicodedata.combining(c))


def _shape(stem: str) -> str:
    """The stem as runs of consonants (c) and vowels (v)."""
    out = ""
    for i, ch in enumerate(stem):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return len(stem) > 2 and _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _replace(word: str, rules: list[tuple[str, str]], least: int) -> str:
    """The first rule whose suffix fits, applied if the stem measures over ``least``."""
    for suffix, other in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + other if _measure(stem) > least else word
    return word


#: The suffixes of steps 2, 3 and 4, longest first where one ends in another.
_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = 2 if word.endswith("ed") else 3 if word.endswith("ing") else 0
        if cut and "v" in _shape(word[:-cut]):
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, _STEP2, 0)
    word = _replace(word, _STEP3, 0)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            word = word[: -len(suffix)] if _measure(word[: -len(suffix)]) > 1 else word
            break
    else:
        if word.endswith("ion") and word[-4:-3] in ("s", "t") and _measure(word[:-3]) > 1:
            word = word[:-3]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def _index_terms(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: None if t is None else stem(fold(t)))


def with_index_terms(rows: DataFrame, term: str = "term") -> DataFrame:
    """Adds ``index_term``; each distinct term is folded and stemmed once."""
    ship(rows.sparkSession)
    distinct = rows.select(term).distinct()
    return rows.join(distinct.withColumn("index_term", pandas_udf(_index_terms, StringType())(term)), term)
