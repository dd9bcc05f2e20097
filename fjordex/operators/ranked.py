"""Ranked N-of-M search: documents with at least N of the M distinct query terms, best scores first."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordex.functions.text import py_terms

# A ranker turns (multiplicity in the query, tf, df, number of documents) into the score of one posting.
Ranker = Callable[[Column, Column, Column, Column], Column]


def by_frequency(mult: Column, tf: Column, df: Column, n: Column) -> Column:
    return (mult * tf).cast("double")


def by_tfidf(mult: Column, tf: Column, df: Column, n: Column) -> Column:
    return (1 + F.log10(mult)) * (1 + F.log10(tf)) * F.log10(n / df)


def needed(threshold: float, m: int) -> int:
    """N of M for a match threshold, which is clamped to [0, 1]."""
    return max(1, min(m, int(max(0.0, min(1.0, threshold)) * m)))


def clamp(hits: int, most: int = 100) -> int:
    return max(1, min(most, hits))


def search(post: DataFrame, query: str | list[str], n_docs: int | None = None, ranker: Ranker = by_tfidf, threshold: float = 0.5, hits: int = 10, static: DataFrame | None = None, analyze: Callable[[str], list[str]] = py_terms) -> DataFrame:
    """(doc_id, score): the best documents, ties by the smaller id.

    ``static`` adds a quality (doc_id, quality) of each document; null counts
    as 0. Document frequencies are counted over the postings of the query's
    terms only. An empty query gives no row. Scores are compared at 6 decimals.
    """
    words = Counter(analyze(query) if isinstance(query, str) else query)
    if not words:
        return post.sparkSession.createDataFrame([], "doc_id long, score double")
    mult = F.create_map(*(F.lit(x) for w, c in words.items() for x in (w, float(c))))
    rows = post.where(F.col("term").isin(list(words)))
    if ranker is by_frequency:
        rows = rows.withColumn("df", F.lit(1.0))
        n_docs = 1
    else:
        # at most as many rows as the query has terms
        rows = rows.join(F.broadcast(rows.groupBy("term").agg(F.count("*").cast("double").alias("df"))), "term")
    score = ranker(mult[F.col("term")], F.col("tf").cast("double"), F.col("df"), F.lit(float(n_docs or 1)))
    found = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(score).alias("score")).where(F.col("n") >= needed(threshold, len(words)))
    if static is not None:
        found = found.join(static, "doc_id", "left").withColumn("score", F.col("score") + F.coalesce("quality", F.lit(0.0)))
    return found.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(clamp(hits))


def with_fields(found: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Late fetch: only winners (at most 100 rows) are joined to the documents."""
    return docs.join(F.broadcast(found), docs[id_col] == found["doc_id"]).drop(found["doc_id"])
