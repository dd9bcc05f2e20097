"""Soundex, in the variant that compares each code with the last one kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code of each letter that has one.
CODES = {"BFPV": "1", "CGJKQSXZ": "2", "DT": "3", "L": "4", "MN": "5", "R": "6"}


def soundex(word: Column) -> Column:
    """First letter and three digits; vowels do not separate equal codes, the first letter's own code counts for nothing.

    Null and the empty word give null.
    """
    letters, digits = ("".join(k for k in CODES), "".join(v * len(k) for k, v in CODES.items()))
    tail = F.translate(F.upper(F.substr(word, F.lit(2))), letters, digits)
    tail = F.regexp_replace(F.regexp_replace(tail, "[^1-6]", ""), r"([1-6])\1+", "$1")
    return F.when(F.length(word) > 0, F.concat(F.upper(F.substr(word, F.lit(1), F.lit(1))), F.rpad(F.substr(tail, F.lit(1), F.lit(3)), 3, "0")))
