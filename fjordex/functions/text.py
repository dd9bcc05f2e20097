"""Text analysis as Column expressions, with the same rules in Python for Arrow operators.

A *term* is a maximal run of letters, digits and underscores in the NFKC form
of a text, casefolded. Texts made only of characters on which NFKC and
casefold reduce to ``lower`` (ASCII, Latin-1 letters, common punctuation and
spaces) stay inside the JVM; only the others go through one Arrow UDF, and
rows that need it not are sent as nulls.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"\w+")
# Java pattern for a word: Python's \w for every code point Java 17 knows.
JWORD = r"[\p{L}\p{N}_]+"
# A text with any other character takes the exact Arrow path.
_UNSAFE = "[^\\x00-\\x7F\\u00C0-\\u00D6\\u00D8-\\u00F6\\u00F8-\\u00FF\\u00A0\\u00AB\\u00AD\\u00BB\\u00D7\\u00F7\\u2000-\\u200F\\u2010-\\u2015\\u2018-\\u201F\\u2026\\u202F\\u2060\\u3000\\uFEFF]"
_SAFE_WORD = r"[a-z0-9_ß-öø-ÿ]+"


# ASCII characters outside words become spaces, capitals small letters
_ASCII = {i: (chr(i).lower() if chr(i).isalnum() or chr(i) == "_" else " ") for i in range(128)}
_COMMON = ".,;:()\"-?'!/|=[]"


def py_terms(text: str | None) -> list[str]:
    """The terms of one text, in order; none for a null.

    Splitting at spaces is several times faster than a pattern; it is kept
    wherever what is left consists of word characters only.
    """
    if not text:
        return []
    if text.isascii():
        return text.translate(_ASCII).split()
    text = unicodedata.normalize("NFKC", text)
    if text.isascii():
        return text.translate(_ASCII).split()
    easy = text
    for c in _COMMON:
        easy = easy.replace(c, " ")
    parts = easy.casefold().split()
    if "".join(parts).isalnum():
        return parts
    found = WORD.findall(text)
    return "\0".join(found).casefold().split("\0") if found else []


@F.pandas_udf(T.StringType())
def nfkc_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def casefold_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


@F.pandas_udf(T.ArrayType(T.StringType()))
def _terms_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else py_terms(x))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def needs_exact(c: Column | str) -> Column:
    return _col(c).rlike(_UNSAFE)


def nfkc(c: Column | str) -> Column:
    """NFKC form; null stays null."""
    c = _col(c)
    # compatibility characters inside the safe range (spaces, ellipsis) also change
    changes = c.rlike("[^\\x00-\\x7F\\u00C0-\\u00D6\\u00D8-\\u00F6\\u00F8-\\u00FF\\u00AB\\u00BB\\u00D7\\u00F7\\u2010\\u2012-\\u2015\\u2018-\\u201F]")
    return F.coalesce(nfkc_udf(F.when(changes, c)), c)


def casefold(c: Column | str) -> Column:
    """Full case folding of a text; null stays null."""
    c = _col(c)
    return F.coalesce(casefold_udf(F.when(needs_exact(c), c)), F.replace(F.lower(c), F.lit("ß"), F.lit("ss")))


def terms(c: Column | str) -> Column:
    """Array of the terms of a text; an empty array for null or blank."""
    c = _col(c)
    # the sharp s folds to two letters and is a word character both before and after
    fast = F.regexp_extract_all(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit(_SAFE_WORD), F.lit(0))
    return F.coalesce(_terms_udf(F.when(needs_exact(c), c)), fast, F.array().cast("array<string>"))


def raw_tokens(c: Column | str) -> Column:
    """Maximal word runs as they stand, without normalisation."""
    return F.coalesce(F.regexp_extract_all(_col(c), F.lit(JWORD), F.lit(0)), F.array().cast("array<string>"))


_SPAN = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(_SPAN)
def _spans_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [{"token": m.group(), "begin": m.start(), "end": m.end()} for m in WORD.finditer(x or "")])


def token_spans(c: Column | str) -> Column:
    """Array of (token, begin, end) in code points over the text as it stands.

    A running offset is quadratic as a higher-order function, so this is an Arrow UDF.
    """
    return _spans_udf(_col(c))


def unigrams(c: Column | str) -> Column:
    """One token per code point; none for null or the empty text.

    A substring is found by counting from the start of the text, so one for each
    place is quadratic; splitting at the empty pattern goes through the text once.
    """
    c = _col(c)
    return F.when(F.length(c) > 0, F.split(c, F.lit(""), -1)).otherwise(F.array().cast("array<string>"))


def char_shingles(c: Column | str, k: int) -> Column:
    """Overlapping code point k-grams; a text no longer than k gives itself, the empty text nothing."""
    if k < 1:
        raise ValueError("k must be positive")
    c = F.coalesce(_col(c), F.lit(""))
    last = F.greatest(F.lit(1), F.length(c) - F.lit(k - 1))
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def word_shingles(tokens: Column, n: int) -> Column:
    """Word n-grams of a token array; fewer than n tokens give one short shingle."""
    last = F.greatest(F.lit(1), F.size(tokens) - F.lit(n - 1))
    return F.when(F.size(tokens) > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def word_shingle_spans(spans: Column, n: int) -> Column:
    """Word n-grams of an array of (token, begin, end), each with the part of the text that it covers."""
    last = F.greatest(F.lit(1), F.size(spans) - F.lit(n - 1))

    def gram(i: Column) -> Column:
        s = F.slice(spans, i, F.lit(n))
        return F.struct(F.array_join(F.transform(s, lambda x: x["token"]), " ").alias("shingle"), s[0]["begin"].alias("begin"), F.element_at(s, -1)["end"].alias("end"))

    return F.when(F.size(spans) > 0, F.transform(F.sequence(F.lit(1), last), gram)).otherwise(F.array().cast("array<struct<shingle:string,begin:int,end:int>>"))


def run_lengths(ordered: Column) -> Column:
    """Array of (term, tf) of a sorted array of terms, in the row and in time linear in its size.

    The runs of equal terms are found by their first places; null for null and the
    empty array. The argument is read several times and should be a column of its own.
    """
    n = F.size(ordered)
    first = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)))
    following = F.concat(F.slice(first, 2, n + 1), F.array(n + 1))
    runs = F.transform(F.arrays_zip(first.alias("a"), following.alias("b")), lambda x: F.struct(F.get(ordered, x["a"] - 1).alias("term"), (x["b"] - x["a"]).cast("long").alias("tf")))
    return F.when(n > 0, runs)
