"""Classifiers as relational plans: naive Bayes, Rocchio, nearest neighbours, logistic regression."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjordex.operators import vectors as V
from fjordex.session import forget, written


@dataclass
class NaiveBayes:
    """Multinomial model: log priors, and log posteriors with add-one smoothing; kept as tables."""

    priors: DataFrame  # label, prior
    posteriors: DataFrame  # label, term, posterior, for seen pairs
    unseen: DataFrame  # label, posterior of a known term that the label lacks
    vocabulary: DataFrame  # term

    @classmethod
    def train(cls, post: DataFrame, labels: DataFrame, label: str = "label", id_col: str = "doc_id") -> NaiveBayes:
        """``labels`` may give a document several labels; null labels are left out."""
        labels = labels.where(F.col(label).isNotNull()).select(id_col, F.col(label).alias("label")).distinct()
        sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
        total = sizes.agg(F.sum("n").alias("total"))
        priors = sizes.crossJoin(F.broadcast(total)).select("label", F.log(F.col("n") / F.col("total")).alias("prior"))
        counts = post.join(labels, id_col).groupBy("label", "term").agg(F.sum("tf").alias("n"))
        vocabulary = counts.select("term").distinct()
        size = vocabulary.agg(F.count("*").alias("v"))
        denom = counts.groupBy("label").agg(F.sum("n").alias("all")).crossJoin(F.broadcast(size)).select("label", (F.col("all") + F.col("v")).alias("denom"))
        posteriors = counts.join(F.broadcast(denom), "label").select("label", "term", F.log((F.col("n") + 1) / F.col("denom")).alias("posterior"))
        return cls(priors, posteriors, denom.select("label", F.log(1 / F.col("denom")).alias("unseen")), vocabulary)

    def stored(self) -> NaiveBayes:
        """The model as written tables, trained once."""
        return NaiveBayes(*(written(x, "bayes") for x in (self.priors, self.posteriors, self.unseen, self.vocabulary)))

    def classify(self, post: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """(id, label, score) for every label and every document with a known term.

        Instead of every (document, label, term), each document starts from
        the score it had if all its known terms were unseen, and seen terms
        add their difference. The model has one row for each term, with an array
        over the labels, so that a posting is joined once for all labels.
        """
        base = self.priors.join(self.unseen, "label", "left").select("label", "prior", F.coalesce("unseen", F.lit(0.0)).alias("unseen"))
        known = sorted((r.label, r.prior, r.unseen) for r in base.collect())  # one row for each label
        gain = self.posteriors.join(F.broadcast(self.unseen), "label").select("label", "term", (F.col("posterior") - F.col("unseen")).alias("gain"))
        scores = _summed(post.withColumnRenamed("tf", "_x"), gain, "gain", [x for x, _, _ in known], id_col, F.sum("_x").alias("_size"))
        total = [F.struct(F.lit(x).alias("label"), (F.lit(p) + F.col("_size") * F.lit(u) + F.col(f"_s{i}")).alias("score")) for i, (x, p, u) in enumerate(known)]
        if not total:
            return post.limit(0).select(id_col, F.lit("").alias("label"), F.lit(0.0).alias("score"))
        return scores.select(id_col, F.inline(F.array(*total)))


# A model of at most so many terms (times labels) is sent to the workers; a larger one is joined in a shuffle, where hot terms are split.
MODEL_CELLS = 4_000_000


def _summed(rows: DataFrame, model: DataFrame, value: str, labels: list, id_col: str, *more: Column) -> DataFrame:
    """(id, _s0, _s1, ...): for each label the sum of ``_x`` times the model's value over a document's terms.

    ``model`` has (label, term, value). It is brought to one row for each term
    and counted: a small one is broadcast, so that no posting is shuffled by its term;
    beyond that both meet by term, and the join splits the terms of very many postings.
    """
    cells = [F.coalesce(F.max(F.when(F.col("label") == x, F.col(value))), F.lit(0.0)).alias(f"_w{i}") for i, x in enumerate(labels)]
    wide = written(model.groupBy("term").agg(*cells) if cells else model.select("term").distinct(), "model")
    small = wide.count() * max(1, len(labels)) <= MODEL_CELLS
    met = rows.join(F.broadcast(wide) if small else wide, "term")
    return met.groupBy(id_col).agg(*(F.sum(F.col("_x") * F.col(f"_w{i}")).alias(f"_s{i}") for i in range(len(labels))), *more)


def best(scores: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The label of the greatest score of each document, ties by the label's order."""
    w = Window.partitionBy(id_col).orderBy(F.round("score", 6).desc(), "label")
    return scores.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def rocchio(training: DataFrame, members: DataFrame, unknown: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, label, score): cosine of each document with each label's centroid, where above 0.

    ``training`` holds unit vectors of the labelled documents, ``members`` (id, label).
    """
    c = written(V.normalized(V.centroids(training, members), "label"), "centroids")
    labels = sorted(r.label for r in c.select("label").distinct().collect())
    if not labels:
        return unknown.limit(0).select(id_col, F.lit("").alias("label"), F.lit(0.0).alias("score"))
    norm = F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("_norm")
    size = unknown.withColumnRenamed("weight", "_x").groupBy(id_col).agg(norm)
    scores = _summed(unknown.withColumnRenamed("weight", "_x"), c, "weight", labels, id_col).join(size, id_col)
    each = [F.struct(F.lit(x).alias("label"), F.try_divide(F.col(f"_s{i}"), F.col("_norm")).alias("score")) for i, x in enumerate(labels)]
    return scores.select(id_col, F.inline(F.array(*each))).where("score > 0")


def neighbours_vote(neighbours: DataFrame, labels: DataFrame, k: int = 3, weighted: bool = False) -> DataFrame:
    """(query_id, label, score): votes of the k nearest, normalised for each query.

    ``neighbours`` has (query_id, near_id, score), ``labels`` (near_id, label);
    a neighbour of several labels votes for each.
    """
    k = max(1, min(100, k))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "near_id")
    near = neighbours.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    votes = near.join(labels, "near_id").groupBy("query_id", "label").agg((F.sum("score") if weighted else F.count("*").cast("double")).alias("votes"))
    total = F.sum("votes").over(Window.partitionBy("query_id"))
    return votes.select("query_id", "label", F.try_divide("votes", total).alias("score"))


def logistic_regression(rows: DataFrame, epochs: int = 100, rate: float = 0.5, callback: Callable[[int, float], bool] | None = None, most_terms: int = MODEL_CELLS) -> DataFrame:
    """(term, weight): full-batch gradient descent from zero weights.

    ``rows`` is (doc_id, term, x, y): unit vectors in long form with the target y
    in {0, 1}. A bias term ``""`` of value 1 is added to every document; rows of
    a document without a target are left out. ``callback`` gets
    the epoch and the mean loss and may stop by returning False.

    The terms are counted. Up to ``most_terms`` the weights are one array that
    is sent to the workers in each epoch, which go through their documents once
    and return a sum for each term (combined in the task); beyond that an epoch is two
    joins with a table of weights, written anew in each epoch. Both give the same weights.
    """
    rows = rows.where("y is not null and doc_id is not null").select("doc_id", "term", F.col("x").cast("double").alias("x"), F.col("y").cast("int").alias("y"))
    bias = rows.select("doc_id", "y").distinct().select("doc_id", F.lit("").alias("term"), F.lit(1.0).alias("x"), "y")
    data = written(rows.unionByName(bias), "examples")
    names = data.select("term").distinct()
    descend = _by_arrays if names.count() <= most_terms else _by_joins
    return descend(data, names, max(1, epochs), rate, callback)


def _by_joins(data: DataFrame, names: DataFrame, epochs: int, rate: float, callback: Callable | None) -> DataFrame:
    n = data.select("doc_id").distinct().count()
    theta = written(names.withColumn("weight", F.lit(0.0)), "weights")
    for epoch in range(epochs):
        z = data.join(theta, "term").groupBy("doc_id", "y").agg(F.sum(F.col("x") * F.col("weight")).alias("z"))
        p = written(z.select("doc_id", "y", (1 / (1 + F.exp(-F.col("z")))).alias("p")), "responses")
        if callback:
            loss = p.agg(F.avg(-F.when(F.col("y") == 1, F.log("p")).otherwise(F.log1p(-F.col("p"))))).first()[0]
            if not callback(epoch, loss):
                return theta
        error = p.select("doc_id", (F.col("p") - F.col("y")).alias("e"))
        grad = data.join(error, "doc_id").groupBy("term").agg((F.sum(F.col("x") * F.col("e")) / n).alias("g"))
        new = written(theta.join(grad, "term").select("term", (F.col("weight") - rate * F.col("g")).alias("weight")), "weights")
        forget(theta, p)
        theta = new
    return theta


def _by_arrays(data: DataFrame, names: DataFrame, epochs: int, rate: float, callback: Callable | None) -> DataFrame:
    spark = data.sparkSession
    terms = sorted(r.term for r in names.collect())  # at most most_terms
    places = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, place int")
    # the places and values of a document lie in one row; how many those are is bounded by its size
    docs = data.join(F.broadcast(places), "term").groupBy("doc_id", "y").agg(F.collect_list("place").alias("at"), F.collect_list("x").alias("x"))
    docs = written(docs.select("y", "at", "x"), "documents")
    n = docs.count()
    weights = np.zeros(len(terms))
    for epoch in range(epochs if n else 0):
        shared = spark.sparkContext.broadcast(weights)

        def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = shared.value
            total, loss = np.zeros(len(w)), 0.0
            for b in batches:
                y = b.column(0).to_numpy().astype(float)
                at, x = (b.column(i).flatten().to_numpy() for i in (1, 2))
                row = np.repeat(np.arange(len(y)), np.diff(b.column(1).offsets.to_numpy()))
                p = 1 / (1 + np.exp(-np.bincount(row, x * w[at], minlength=len(y))))
                total += np.bincount(at, x * (p - y)[row], minlength=len(w))
                loss -= np.log(np.where(y == 1, p, 1 - p)).sum()
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([loss])], ["g", "loss"])

        # the arrays of the tasks are added up pairwise, so that few of them come to the driver
        sums = docs.select("y", "at", "x").mapInArrow(gradient, "g binary, loss double")
        parts = _added(sums).collect()
        if callback and not callback(epoch, sum(r.loss for r in parts) / n):
            break
        weights = weights - rate * sum(np.frombuffer(r.g) for r in parts) / n
        shared.unpersist()
    return written(spark.createDataFrame(pd.DataFrame({"term": pd.Series(terms, dtype=str), "weight": weights}), "term string, weight double"), "weights")


def _added(sums: DataFrame, most: int = 16) -> DataFrame:
    """Rows of (array in binary, loss), one from each task, added until at most ``most`` are left."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, loss = None, 0.0
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = np.frombuffer(x).copy() if g is None else g + np.frombuffer(x)
                loss += y
        if g is not None:
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary()), pa.array([loss])], ["g", "loss"])

    n = sums.rdd.getNumPartitions()
    while n > most:
        n = math.ceil(n / most)
        sums = sums.repartition(n).mapInArrow(add, "g binary, loss double")
    return sums


def logistic_scores(vectors: DataFrame, theta: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, score): the model's response to unit vectors; unknown terms count nothing."""
    bias = theta.where("term = ''").select(F.col("weight").alias("bias"))
    z = vectors.join(theta.where("term <> ''").withColumnRenamed("weight", "theta"), "term", "left").groupBy(id_col).agg(F.coalesce(F.sum(F.col("weight") * F.col("theta")), F.lit(0.0)).alias("z"))
    return z.crossJoin(F.broadcast(bias)).select(id_col, (1 / (1 + F.exp(-(F.col("z") + F.col("bias"))))).alias("score"))
