"""The Porter stemmer (Porter, 1980), applied to a vocabulary and never to each token."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Endings of the published steps, in the published order.
STEP2 = dict(zip("ational tional enci anci izer abli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti logi".split(), "ate tion ence ance ize able al ent e ous ize ate ate al ive ful ous al ive ble log".split(), strict=True))
STEP3 = dict(zip("icate ative alize iciti ical ful ness".split(), ["ic", "", "al", "ic", "ic", "", ""], strict=True))
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    out = ""
    for k, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _swap(word: str, endings: dict[str, str]) -> str:
    for e in sorted(endings, key=len, reverse=True):
        if word.endswith(e):
            stem = word[: -len(e)]
            return stem + endings[e] if _measure(stem) > 0 else word
    return word


def stem(word: str) -> str:
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif m := re.fullmatch("(.*)(ed|ing)", word):
        if "v" in _shape(m[1]):
            word = m[1]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP2), STEP3)
    for e in sorted(STEP4, key=len, reverse=True):
        if word.endswith(e):
            rest = word[: -len(e)]
            if _measure(rest) > 1 and (e != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short(rest)):
            word = rest
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@pandas_udf(T.StringType())
def porter_stem(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else stem(w))
