"""Shared pieces: latest deliveries, skew-safe joins, item lists."""

from __future__ import annotations

import os
import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fjordex.functions.text import WORD
from fjordex.session import written

# A side of at most so many rows of fixed width is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000
# A group of more rows than this is hot and joined by broadcasting its one row.
HOT_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, order: str, *more: str | Column) -> DataFrame:
    """One row for each key: the last by ``order`` (nulls first), ties by the further columns.

    Rows without a key are dropped.
    """
    by = [F.col(order).desc_nulls_last(), *(F.col(c).desc_nulls_last() if isinstance(c, str) else c for c in more)]
    w = Window.partitionBy(key).orderBy(*by)
    return df.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_rows(df: DataFrame, key: str, order: str, *more: str) -> DataFrame:
    """As ``latest`` for wide rows: the keys that come more than once are found without the other columns, and only their rows are shuffled."""
    df = df.where(F.col(key).isNotNull())
    several = written(df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key), "repeated")
    n = several.count()
    if not n:
        return df
    return sized_join(df, several, key, n, "left_anti").unionByName(latest(sized_join(df, several, key, n, "left_semi"), key, order, *more))


def sized_join(left: DataFrame, right: DataFrame, on: list[str] | str, rows: int, how: str = "inner") -> DataFrame:
    """Broadcast the right side only if its counted rows are within the bound, else shuffle."""
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, how)


def attach_group(members: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Join members with the row of their group, however large a group is.

    The rows of groups larger than HOT_ROWS are at most members / HOT_ROWS, so
    they are broadcast; only groups within that bound meet in a shuffle.
    """
    hot = groups.where(F.col(size) > HOT_ROWS)
    if hot.isEmpty():
        return members.join(groups, keys)
    rest = members.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.where(F.col(size) <= HOT_ROWS), keys)
    return members.join(F.broadcast(hot), keys).unionByName(rest)


_PARTS = re.compile("[;|\n\r\v\f\x85  ]")
_PAIR = re.compile("[:=]")


def py_items(nfkc_text: str) -> list[tuple[str, str]] | None:
    """(name, value) of each item by their words, or None for a text that is no list."""
    found = []
    for part in _PARTS.split(nfkc_text):
        words = WORD.search(part)
        if not words:
            continue
        cut = _PAIR.search(part)
        if not cut or cut.start() < words.start():
            return None
        name, value = part[: cut.start()], part[cut.end() :]
        found.append((" ".join(WORD.findall(name)).casefold(), " ".join(WORD.findall(value)).casefold()))
    return found or None


def py_nfkc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def source_name(c: str) -> Column:
    """One spelling of a source: trimmed, lower case, words joined by underscores; null stays null."""
    return F.regexp_replace(F.lower(F.trim(F.col(c))), r"[\s\-]+", "_")


def tokenizer_path(name: str) -> str:
    """A vocabulary file; the folder is a parameter (environment FJORDEX_TOKENIZERS)."""
    return os.path.join(os.environ.get("FJORDEX_TOKENIZERS", "/opt/tokenizers"), name)
