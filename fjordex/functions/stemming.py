"""Porter's English stemmer, with the customary departures, as an Arrow UDF for distinct words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Irregular forms and suffix tables of the published algorithm with its departures.
IRREGULAR = {"skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "innings": "inning", "outings": "outing", "cannings": "canning"}
IRREGULAR |= {w: w for w in ("sky", "news", "inning", "outing", "canning", "howe", "proceed", "exceed", "succeed")}
DOUBLE = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "fulli": "ful", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
SINGLE = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
LAST = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """A ``c`` or ``v`` for each letter; a y after a consonant is a vowel."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def measure(stem: str) -> int:
    """How often consonants follow vowels."""
    return len(re.findall("v+c+", shape(stem)))


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant (the last not w, x or y), or is a vowel and a consonant."""
    s = shape(stem)
    return s == "vc" or (len(s) > 2 and s.endswith("cvc") and stem[-1] not in "wxy")


def _swap(word: str, table: dict[str, str], least: int) -> str:
    """The longest suffix of the table is replaced if enough is left before it."""
    for n in range(7, 1, -1):
        suffix = word[-n:]
        if len(suffix) == n and suffix in table:
            return word[:-n] + table[suffix] if measure(word[:-n]) > least else word
    return word


def _plural_and_past(w: str) -> str:
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w[-1] == "s" and w[-2] != "s":
        w = w[:-1]
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix) and "v" in shape(w[: -len(suffix)]):
            w = w[: -len(suffix)]
            if w.endswith(("at", "bl", "iz")):
                return w + "e"
            if len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "c":
                return w if w[-1] in "lsz" else w[:-1]
            return w + "e" if measure(w) == 1 and _short(w) else w
    return w


def stem(word: str) -> str:
    """The stem of one word, in lower case; ValueError for an empty one."""
    w = (word or "").strip().lower()
    if not w:
        raise ValueError("nothing to stem")
    if w in IRREGULAR or len(w) <= 2:
        return IRREGULAR.get(w, w)
    w = _plural_and_past(w)
    if len(w) > 2 and w[-1] == "y" and shape(w)[-2] == "c":
        w = w[:-1] + "i"
    before = w
    w = _swap(w, DOUBLE, 0)
    if before.endswith("alli") and w != before:
        w = _swap(w, DOUBLE, 0)
    w = _swap(w, SINGLE, 0)
    for n in range(5, 1, -1):
        if w[-n:] in LAST and len(w) >= n:
            cut = 3 if w[-n:] in ("sion", "tion") else n
            w = w[:-cut] if measure(w[:-cut]) > 1 else w
            break
    if w.endswith("e"):
        m = measure(w)
        if m > 1 or (m == 1 and not (len(w) > 2 and _short(w[:-1]))):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


@F.pandas_udf(T.StringType())
def _stem_udf(words: pd.Series) -> pd.Series:
    return words.map(lambda x: stem(x) if x and x.strip() else None)


def stemmed(word: Column) -> Column:
    """Stem of a word; null for null and blank. Meant for distinct words, to be joined back."""
    return _stem_udf(word)
