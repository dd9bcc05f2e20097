"""Ranking evaluation: metrics over (query_id, rank, relevant or gain) as windows and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _upto() -> WindowSpec:
    return Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _onward() -> WindowSpec:
    return Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)


def judged(rows: DataFrame) -> DataFrame:
    """(query_id, rank, relevant, gain) with dense ranks from 1.

    Rows without a rank are not in the ranking; repeated rows count once, and of
    several documents at one rank the smaller id comes first; a null judgment is
    not relevant and gains nothing.
    """
    d = rows.where("query_id is not null and hit_rank is not null").select("query_id", "hit_rank", "doc_id", F.coalesce("relevant", F.lit(False)).alias("relevant"), F.coalesce("gain", F.lit(0.0)).alias("gain"))
    d = d.groupBy("query_id", "hit_rank", "doc_id").agg(F.bool_or("relevant").alias("relevant"), F.max("gain").alias("gain"))
    w = Window.partitionBy("query_id").orderBy("hit_rank", "doc_id")
    return d.select("query_id", F.row_number().over(w).alias("rank"), "relevant", "gain")


def precision(j: DataFrame) -> DataFrame:
    return j.withColumn("precision", F.sum(F.col("relevant").cast("int")).over(_upto()) / F.col("rank"))


def interpolated(j: DataFrame) -> DataFrame:
    """Best precision at this rank or below it."""
    return precision(j).withColumn("interpolated", F.max("precision").over(_onward()))


def recall(j: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Recall at each rank; ``totals`` gives (query_id, total) relevant documents, else those in the ranking. Null where there is none."""
    hits = F.sum(F.col("relevant").cast("int")).over(_upto())
    if totals is None:
        total = F.sum(F.col("relevant").cast("int")).over(Window.partitionBy("query_id"))
    else:
        j, total = j.join(totals, "query_id"), F.col("total")
    return j.withColumn("recall", F.try_divide(hits, total))


def f_score(j: DataFrame, beta: float = 1.0) -> DataFrame:
    """F measure at each rank; null where precision and recall are both 0."""
    if beta < 0:
        raise ValueError("beta must not be negative")
    b = beta * beta
    r = recall(precision(j))
    return r.withColumn("f", F.try_divide((1 + b) * F.col("precision") * F.col("recall"), b * F.col("precision") + F.col("recall")))


def average_precision(j: DataFrame) -> DataFrame:
    """(query_id, ap): mean precision at the relevant ranks, 0 if there are none."""
    return precision(j).groupBy("query_id").agg(F.coalesce(F.avg(F.when(F.col("relevant"), F.col("precision"))), F.lit(0.0)).alias("ap"))


def dcg(j: DataFrame) -> DataFrame:
    return j.groupBy("query_id").agg(F.sum(F.col("gain") / F.log2(F.col("rank") + 1.0)).alias("dcg"))


def ndcg(j: DataFrame, perfect: DataFrame | None = None) -> DataFrame:
    """(query_id, dcg, ndcg): against the best order of the gains, or of ``perfect`` (query_id, gain) cut to the ranking's length; null if the ideal is 0."""
    pool = j.select("query_id", "gain") if perfect is None else perfect.select("query_id", "gain")
    w = Window.partitionBy("query_id").orderBy(F.col("gain").desc())
    ideal = pool.withColumn("rank", F.row_number().over(w)).join(j.groupBy("query_id").agg(F.max("rank").alias("last")), "query_id").where("rank <= last")
    ideal = dcg(ideal).withColumnRenamed("dcg", "ideal")
    return dcg(j).join(ideal, "query_id").select("query_id", "dcg", F.try_divide("dcg", "ideal").alias("ndcg"))


def reciprocal_rank(j: DataFrame) -> DataFrame:
    """(query_id, rr): 1 / rank of the first relevant document, 0 if there is none."""
    return j.groupBy("query_id").agg(F.coalesce(1.0 / F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0.0)).alias("rr"))


def kendall_tau(preferences: DataFrame, ranking: DataFrame) -> DataFrame:
    """(query_id, tau) of preference pairs (query_id, before, after) against a ranking (query_id, doc_id, rank).

    Pairs of which both are missing do not count; only the preferred missing is a
    disagreement, only the other an agreement; none counted gives 0.
    """
    a = ranking.select("query_id", F.col("doc_id").alias("before"), F.col("rank").alias("ra"))
    b = ranking.select("query_id", F.col("doc_id").alias("after"), F.col("rank").alias("rb"))
    rows = preferences.join(a, ["query_id", "before"], "left").join(b, ["query_id", "after"], "left")
    agree = F.when(F.col("ra").isNull() & F.col("rb").isNull(), 0).when(F.col("ra").isNull(), -1).when(F.col("rb").isNull(), 1).when(F.col("ra") < F.col("rb"), 1).otherwise(-1)
    counted = rows.withColumn("v", agree).groupBy("query_id").agg(F.sum("v").alias("s"), F.sum(F.abs("v")).alias("n"))
    return counted.select("query_id", F.coalesce(F.try_divide(F.col("s").cast("double"), F.col("n")), F.lit(0.0)).alias("tau"))
