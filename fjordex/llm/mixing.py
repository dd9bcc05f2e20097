"""Mixing sources to target weights: Poisson replication with hash-seeded draws."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fjordex.session import written

# Share of its most possible repetition that the scarcest source is used to.
USE = 0.95
SEED = 20
_BINS, _REFINEMENTS = 512, 4


def top_rate(k: int) -> float:
    """No document needs a higher rate for its k-th copy: the chance of fewer copies is below that of the least draw, 2^-53."""
    return k + 10 * math.sqrt(k) + 60


def log_fewer(rate: np.ndarray, k: int) -> np.ndarray:
    """log P(N < k) of a Poisson variable."""
    if k <= 40:  # rates in question are below 170, where the terms are neither too small nor too large
        total = term = np.ones(len(rate))
        for i in range(1, k):
            term = term * rate / i
            total = total + term
        return np.log(total) - rate
    # from the greatest number down, by logarithms
    with np.errstate(divide="ignore"):
        log_rate = np.log(rate)
    total = term = np.zeros(len(rate))
    for i in range(k - 1, 0, -1):
        term = term + math.log(i) - log_rate
        total = np.logaddexp(total, term)
    return np.where(rate > 0, total + (k - 1) * log_rate - rate - math.lgamma(k), 0.0)


def least_rate(u: np.ndarray, k: int) -> np.ndarray:
    """The least rate at which the inverse Poisson distribution gives u at least k copies (by bisection)."""
    lo, hi, goal = np.zeros(len(u)), np.full(len(u), top_rate(k)), np.log(u)
    for _ in range(50):
        mid = (lo + hi) / 2
        enough = log_fewer(mid, k) <= goal
        hi = np.where(enough, mid, hi)
        lo = np.where(enough, lo, mid)
    return hi


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _rates(u: pd.Series, most: pd.Series) -> pd.Series:
    """For each document the rates from which it has 1, 2, ... copies, up to its source's cap."""
    x, m = u.to_numpy(), most.to_numpy()
    cols = [least_rate(x, k) for k in range(1, int(m.max(initial=0)) + 1)]
    return pd.Series([[float(c[i]) for c in cols[: int(m[i])]] for i in range(len(x))])


def plan(sizes: DataFrame, targets: DataFrame, use: float = USE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(copies, shares): (doc_id, source, n_tokens, copies) of every document, and a row for each source.

    ``sizes`` has (doc_id, source, n_tokens), ``targets`` a few rows (source,
    target_share, max_repeats). The total is the largest at which every
    source can hold its share with at most max_repeats copies of each document
    (times ``use``). Each document draws from the Poisson distribution of its
    source by a hash of its id, at most max_repeats; the rate is set so that
    the tokens drawn, not only their mean, meet the target, by refining a
    histogram of the rates at which copies appear (a fixed number of rows on the driver).
    Documents without tokens, and of null or unlisted sources, get no copy and are
    reported under their source with a target of 0; a source without
    documents can't hold its share, which is reported as it is.
    """
    t = targets.select("source", "target_share", F.col("max_repeats").cast("int").alias("max_repeats")).where("source is not null and target_share > 0 and max_repeats > 0")
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    docs = sizes.where("doc_id is not null").join(F.broadcast(t), "source", "left")
    docs = docs.withColumn("rates", _rates(u, F.when(F.col("n_tokens") > 0, F.coalesce("max_repeats", F.lit(0))).otherwise(0)))
    docs = written(docs.select("doc_id", "source", "n_tokens", "target_share", "max_repeats", "rates"), "draws")
    have = {r.source: (r.tokens, r.share, r.cap) for r in docs.where("target_share is not null").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.first("target_share").alias("share"), F.first("max_repeats").alias("cap")).collect()}
    have = {s: v for s, v in have.items() if v[0] > 0}
    total = min((use * cap * tokens / share for tokens, share, cap in have.values()), default=0.0)
    want = {s: share * total for s, (_, share, _) in have.items()}
    low, high, below = dict.fromkeys(have, 0.0), {s: top_rate(cap) for s, (_, _, cap) in have.items()}, dict.fromkeys(have, 0)
    spark = sizes.sparkSession
    points = docs.where("target_share is not null").select("source", "n_tokens", F.explode("rates").alias("rate"))
    for turn in range(_REFINEMENTS if have else 0):
        edges = spark.createDataFrame([(s, low[s], high[s]) for s in have], "source string, lo double, hi double")
        inside = points.join(F.broadcast(edges), "source").where("rate > lo and rate <= hi")
        bin_ = F.least(F.ceil((F.col("rate") - F.col("lo")) / (F.col("hi") - F.col("lo")) * _BINS), F.lit(_BINS)).cast("int")
        rows = inside.groupBy("source", bin_.alias("bin")).agg(F.sum("n_tokens").alias("tokens")).collect()
        for s in have:
            step = (high[s] - low[s]) / _BINS
            got, at = below[s], 0
            for b, n in sorted((r.bin, r.tokens) for r in rows if r.source == s):
                if got + n > want[s]:
                    # in the end, whichever side is nearer
                    at = b if turn == _REFINEMENTS - 1 and got + n - want[s] < want[s] - got else b - 1
                    break
                got, at = got + n, b
            if at >= _BINS:
                low[s] = high[s]
                continue
            below[s] = got
            low[s], high[s] = low[s] + step * at, min(low[s] + step * (at + 1), high[s])
    final = {s: low[s] for s in have}
    rates = spark.createDataFrame([(s, final[s], want[s] / have[s][0]) for s in have], "source string, rate double, mean_copies double")
    drawn = docs.join(F.broadcast(rates), "source", "left").withColumn("copies", F.coalesce(F.size(F.filter("rates", lambda r: r <= F.col("rate"))), F.lit(0)))
    drawn = written(drawn.select("doc_id", "source", "n_tokens", F.when(F.col("rate").isNull(), 0).otherwise(F.col("copies")).alias("copies")), "copies")
    per = drawn.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    # of a listed source without documents too there is a row
    per = per.join(F.broadcast(t), "source", "full").join(F.broadcast(rates.select("source", "mean_copies")), "source", "left")
    per = per.withColumn("all", F.sum("mixed_tokens").over(Window.partitionBy()))  # one row for each source
    shares = per.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.round(F.coalesce(F.try_divide("mixed_tokens", "all"), F.lit(0.0)), 6).alias("actual_share"), "max_repeats", "documents", "tokens", "copies", "mixed_tokens", "most_copies", F.round("mean_copies", 6).alias("mean_copies"))
    return drawn, shares


def mixture(copies: DataFrame, seed: int = SEED) -> DataFrame:
    """(shuffle_key, doc_id, copy, source, n_tokens): one row for each copy, in the order of a hash over the whole."""
    rows = copies.where("copies > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "source", "n_tokens")
    return rows.select(F.xxhash64(F.lit(seed + 1), "doc_id", "copy").alias("shuffle_key"), "doc_id", "copy", "source", "n_tokens").orderBy("shuffle_key", "doc_id", "copy")
