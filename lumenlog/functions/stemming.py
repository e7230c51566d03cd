"""English suffix stripping for the stemmed search mode, by the public rules of Porter (1980)."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_C, _V = "[^aeiou](?:[^aeiouy]*)", "[aeiouy](?:[aeiou]*)"
_MEASURED = re.compile(f"^(?:{_C})?{_V}{_C}")
_TWICE = re.compile(f"^(?:{_C})?{_V}{_C}{_V}{_C}")
_ONCE = re.compile(f"^(?:{_C})?{_V}{_C}(?:{_V})?$")
_VOWEL = re.compile(f"^(?:{_C})?[aeiouy]")
_SHORT = re.compile("^" + _C + "[aeiouy][^aeiouwxy]$")
#: Suffixes and what they become, where the stem before has a consonant after a vowel.
_SECOND = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")


def _swap(word: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + table[suffix] if _MEASURED.match(stem) else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _MEASURED.match(w[:-3]) else w
    else:
        for suffix in ("ed", "ing"):
            base = w[: -len(suffix)]
            if w.endswith(suffix) and _VOWEL.match(base):
                if base.endswith(("at", "bl", "iz")):
                    w = base + "e"
                elif len(base) > 1 and base[-1] == base[-2] and base[-1] not in "aeioulsz":
                    w = base[:-1]
                else:
                    w = base + "e" if _ONCE.match(base) and _SHORT.match(base) else base
                break
    if w.endswith("y") and _VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _SECOND), _THIRD)
    for suffix in _FOURTH:
        if w.endswith(suffix):
            if _TWICE.match(w[: -len(suffix)]):
                w = w[: -len(suffix)]
            break
    else:
        if w.endswith("ion") and w[-4:-3] in ("s", "t") and _TWICE.match(w[:-3]):
            w = w[:-3]
    if w.endswith("e"):
        base = w[:-1]
        if _TWICE.match(base) or (_MEASURED.match(base) and not (_ONCE.match(base) and _SHORT.match(base))):
            w = base
    return w[:-1] if w.endswith("ll") and _TWICE.match(w) else w


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: [stem(w) for w in ws])
