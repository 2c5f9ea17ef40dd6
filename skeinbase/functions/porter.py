"""Porter's stemmer of 1980, for words that no built-in function stems."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F



def _form(word: str) -> str:
    """c and v for each letter."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _m(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _cvc(stem: str) -> bool:
    return _form(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replace(word: str, rules: list[tuple[str, str]], least: int) -> str:
    for end, new in rules:
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + new if _m(stem) > least else word
    return word


_STEP2 = [tuple(x.split(":")) for x in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split()]
_STEP3 = [tuple(x.split(":")) for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split()]
_STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=len, reverse=True)


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _m(word[:-3]) > 0 else word
    elif (end := next((e for e in ("ed", "ing") if word.endswith(e) and "v" in _form(word[: -len(e)])), None)) is not None:
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _form(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _m(word) == 1 and _cvc(word):
            word += "e"
    if word.endswith("y") and "v" in _form(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, sorted(_STEP2, key=lambda r: -len(r[0])), 0)
    word = _replace(word, sorted(_STEP3, key=lambda r: -len(r[0])), 0)
    for end in _STEP4:
        if word.endswith(end):
            rest = word[: -len(end)]
            if _m(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e") and (_m(word[:-1]) > 1 or _m(word[:-1]) == 1 and not _cvc(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _m(word[:-1]) > 1:
        word = word[:-1]
    return word


def _stems(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def porter(words) -> Column:
    """The stems of a column of lower-case words, a batch at a time."""
    return F.pandas_udf(_stems, "string")(words)
