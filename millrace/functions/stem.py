"""English word stems after Porter's algorithm of 1980, for distinct words in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiou"

# Suffixes of the published steps 2, 3 and 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _kinds(word: str) -> str:
    """``c`` and ``v`` for each letter; a y after a consonant is a vowel."""
    out = ""
    for k, letter in enumerate(word):
        vowel = letter in VOWELS or letter == "y" and k > 0 and out[k - 1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _kinds(stem).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _short(word: str) -> bool:
    return len(word) > 2 and _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, table: dict[str, str], least: int) -> str:
    suffix = max((s for s in table if word.endswith(s)), key=len, default="")
    if suffix and _measure(word[: -len(suffix)]) >= least:
        return word[: -len(suffix)] + table[suffix]
    return word


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((n for end, n in (("ed", 2), ("ing", 3)) if word.endswith(end) and "v" in _kinds(word[:-n])), 0)
        if cut:
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP2, 1), STEP3, 1)
    suffix = max((s for s in STEP4 if word.endswith(s)), key=len, default="")
    rest = word[: len(word) - len(suffix)]
    if suffix and _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
        word = rest
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or _measure(rest) == 1 and not _short(rest):
            word = rest
    return word[:-1] if _measure(word) > 1 and _double(word) and word.endswith("l") else word


def stem_column(word: str) -> Column:
    @F.pandas_udf("string")
    def stemmed(words: pd.Series) -> pd.Series:
        return words.map(stem, na_action="ignore")

    return stemmed(F.col(word))
