"""Porter's suffix stripping (1980) and folding of accents, for indexes that match word forms.

A word is read as its pattern of vowels and consonants; the measure of a stem is how many times a run of vowels is followed
by a run of consonants in it. Every step takes the longest suffix of its table that the word has and puts another in its place
if what is left measures enough.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tarn.functions.text import tokens

#: Suffixes and what takes their place, where the stem has any measure at all.
DOUBLE = (
    "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate "
    "alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
)
SIMPLE = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
#: Suffixes that go where the stem measures two or more.
LAST = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def pattern(word: str) -> str:
    """The word in letters v and c; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in "aeiou" or letter == "y" and i and out[-1] == "c" else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", pattern(stem)))


def _short_end(word: str) -> bool:
    """Whether the word ends consonant, vowel, consonant, the last not w, x or y."""
    return pattern(word).endswith("cvc") and word[-1] not in "wxy"


def _exchanged(word: str, table: list[tuple[str, str]], least: int) -> str:
    """The longest suffix of ``table`` that the word has, exchanged if the stem measures ``least``."""
    for suffix, other in table:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            if suffix == "ion" and not stem.endswith(("s", "t")):
                return word
            return stem + other if measure(stem) >= least else word
    return word


def _table(pairs: str) -> list[tuple[str, str]]:
    return sorted((tuple((p + ":").split(":")[:2]) for p in pairs.split()), key=lambda p: -len(p[0]))


STEPS = [(_table(DOUBLE), 1), (_table(SIMPLE), 1), (_table(LAST), 2)]


def _inflections(word: str) -> str:
    """Plurals, past forms and participles, and a y at the end."""
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) else word
    else:
        for suffix in ("ed", "ing"):
            stem = word[: len(word) - len(suffix)]
            if word.endswith(suffix) and "v" in pattern(stem):
                twice = len(stem) > 1 and stem[-1] == stem[-2] and pattern(stem)[-1] == "c"
                if stem.endswith(("at", "bl", "iz")) or not twice and measure(stem) == 1 and _short_end(stem):
                    word = stem + "e"
                else:
                    word = stem[:-1] if twice and stem[-1] not in "lsz" else stem
                break
    return word[:-1] + "i" if word.endswith("y") and "v" in pattern(word[:-1]) else word


@functools.lru_cache(1 << 17)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of other letters than a to z, or of two at most, stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    word = _inflections(word)
    for table, least in STEPS:
        word = _exchanged(word, table, least)
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or m == 1 and not _short_end(word[:-1]):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


@functools.lru_cache(1 << 17)
def folded(word: str) -> str:
    """Without accents."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


@pandas_udf(T.ArrayType(T.StringType()))
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: [stem(folded(w)) for w in ws] if ws is not None else None)


def stemmed_tokens(text: Column) -> Column:
    """Stems of the word tokens, repeats kept."""
    return _stems(tokens(text))


def stemmed_query(text: Column) -> Column:
    """Distinct stems of a query."""
    return F.array_distinct(stemmed_tokens(text))
