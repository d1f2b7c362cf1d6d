"""Search terms: tokens, folding, and Porter stems."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Lower-case Latin letters with marks, and the letters without: what Unicode's decompositions begin with.
_LATIN = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if chr(c).islower()}
MARKED = "".join(k for k, v in _LATIN.items() if k != v and v.isascii())
PLAIN = "".join(_LATIN[k] for k in MARKED)


def terms(text: Column) -> Column:
    """Lower-case letter and digit runs without marks."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def query_tokens(text: str) -> list[list[str]]:
    """ASCII words of a query, each as the terms that must follow one another; all must match."""
    import re

    return [[t.lower() for t in word.split("_") if t] for word in re.findall("[A-Za-z0-9_]+", text or "") if word.strip("_")]


def _measure(stem: str) -> int:
    """Vowel runs that a consonant follows (m in Porter's paper)."""
    kinds = "".join("v" if _vowel(stem, i) else "c" for i in range(len(stem)))
    return sum(a == "v" and b == "c" for a, b in zip(kinds, kinds[1:], strict=False))


def _vowel(word: str, i: int) -> bool:
    return word[i] in "aeiou" or word[i] == "y" and i > 0 and not _vowel(word, i - 1)


def _has_vowel(stem: str) -> bool:
    return any(_vowel(stem, i) for i in range(len(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and not _vowel(word, len(word) - 1)


def _cvc(word: str) -> bool:
    n = len(word)
    return n > 2 and not _vowel(word, n - 3) and _vowel(word, n - 2) and not _vowel(word, n - 1) and word[-1] not in "wxy"


#: The suffix tables of Porter's steps 2, 3 and 4.
_STEP2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous",
    ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble",
)
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _swap(word: str, table: dict[str, str]) -> str:
    for end in sorted(table, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + table[end] if _measure(stem) > 0 else word
    return word


@lru_cache(100_000)
def porter(word: str) -> str:
    """Porter's stemmer, by his 1980 paper."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2), _STEP3)
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _cvc(stem):
            w = stem
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stem(words: pd.Series) -> pd.Series:
    """Stems; meant for distinct terms."""
    return words.map(porter, na_action="ignore")
