"""How distinctive each term is of its record: log-odds with an informative Dirichlet prior.

The rate of a term in the record is compared with its rate in all other
records; the collection's own counts are the prior, and the log-odds ratio is
divided by its standard error. The weight of the vector space model,
(1 + log10 tf) * log10(N / df), comes with it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjordex.functions.text import py_terms
from fjordex.llm.common import latest
from fjordex.session import written

# Terms whose counts go to every worker; all others are joined by a shuffle. A fixed bound of what is broadcast.
FREQUENT = 20_000
# Size of the prior in words.
PRIOR = 1000.0


def py_z(tf: float, cf: float, length: float, total: float, prior: float = PRIOR) -> float:
    a = prior * cf / total
    rest = cf - tf
    own = math.log((tf + a) / (length + prior - tf - a))
    other = math.log((rest + a) / (total - length + prior - rest - a))
    return (own - other) / math.sqrt(1 / (tf + a) + 1 / (rest + a))


def z_score(tf: Column, cf: Column, length: Column, total: float, prior: float = PRIOR) -> Column:
    a = F.lit(prior) * cf / F.lit(float(total))
    rest = cf - tf
    own = F.log((tf + a) / (length + prior - tf - a))
    other = F.log((rest + a) / (F.lit(float(total)) - length + prior - rest - a))
    return (own - other) / F.sqrt(F.lit(1.0) / (tf + a) + F.lit(1.0) / (rest + a))


def _tokenised(docs: DataFrame, id_col: str, body: str, order: str) -> DataFrame:
    """Written table: (doc_id, line) of each record with words, and (word, cf, df) counts combined in the same pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cf: Counter[str] = Counter()
        df: Counter[str] = Counter()
        names = ["doc_id", "line", "word", "cf", "df"]

        def out() -> pa.RecordBatch:
            words = list(cf)
            k = len(words)
            cols = [pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.array(words, pa.string()), pa.array([cf[w] for w in words], pa.int64()), pa.array([df[w] for w in words], pa.int64())]
            cf.clear()
            df.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        for b in batches:
            ids, lines = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = py_terms(text)
                if words:
                    cf.update(words)
                    df.update(set(words))
                    cf[""] += len(words)
                    df[""] += 1
                    ids.append(i)
                    lines.append(" ".join(words))
            k = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.string()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names)
            if len(cf) > 200_000:
                yield out()
        yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(body).alias("body"), F.col(order).alias("at"))
    rows = latest(rows, "doc_id", "at", "body").select("doc_id", "body").where("body is not null")
    return written(rows.mapInArrow(run, "doc_id long, line string, word string, cf long, df long"), "tokenised")


def distinctive_terms(docs: DataFrame, id_col: str = "doc_id", body: str = "body", order: str = "loaded_at", k: int = 3, by: str = "z", min_records: int = 2) -> DataFrame:
    """(doc_id, term, tf, df, z, weight, rank): the k best terms of each record.

    ``by`` is ``z`` (log-odds in standard errors) or ``weight``; both are
    compared at 9 decimals and ties go to the term that sorts first. Only terms
    in at least ``min_records`` records are ranked, so a record may have fewer
    than k terms or none. Null, blank and word-less bodies have none; of a
    record delivered again the last delivery counts.

    The counts of the most frequent terms are sent to the workers, which keep
    only the k best of them for each record; the other terms of all records
    meet their counts in a shuffle. Both ways are exact.
    """
    t = _tokenised(docs, id_col, body, order)
    counts = written(t.where("word is not null").groupBy("word").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df")), "counts")
    top = counts.where(F.col("df") >= min_records).orderBy(F.col("df").desc(), "word").limit(FREQUENT + 1).collect()
    known = {r.word: (r.df, r.cf) for r in top}
    n_records, total = known.pop("", None) or next(((r.df, r.cf) for r in counts.where("word = ''").collect()), (0, 0))
    lowest = min((d for d, _ in known.values()), default=0)
    everything = len(top) <= FREQUENT
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        log10, weights = math.log10, {w: math.log10(n_records / d) for w, (d, _) in known.items()}
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for i, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = line.split(" ")
                tf = Counter(words)
                size = len(words)
                best = []
                for w, n in tf.items():
                    g = weights.get(w)
                    if g is not None:
                        s = (g if n == 1 else (1 + log10(n)) * g) if by == "weight" else py_z(n, known[w][1], size, total)
                        best.append((-round(s, 9), w))
                    elif not everything:
                        for x, v in zip(out, (i, w, n, size, None, None)):
                            x.append(v)
                if len(best) > k:
                    best = sorted(best)[:k]
                for _, w in best:
                    for x, v in zip(out, (i, w, tf[w], size, *known[w])):
                        x.append(v)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(out, kinds)], ["doc_id", "term", "tf", "size", "df", "cf"])

    rows = t.where("line is not null").select("doc_id", "line").mapInArrow(run, "doc_id long, term string, tf int, size int, df long, cf long")
    if not everything:
        # one pass for both kinds: terms with a known count do not meet the counts, and nulls match nothing
        rare = counts.where((F.col("df") >= min_records) & (F.col("df") <= lowest)).select(F.col("word").alias("key"), F.col("df").alias("rdf"), F.col("cf").alias("rcf"))
        rows = written(rows, "weighed")
        open_rows = rows.where("df is null").select("doc_id", "term", "tf", "size").join(rare, F.col("term") == F.col("key")).select("doc_id", "term", "tf", "size", F.col("rdf").alias("df"), F.col("rcf").alias("cf"))
        rows = rows.where("df is not null").unionByName(open_rows)
    tf = F.col("tf").cast("double")
    rows = rows.withColumn("weight", F.round((1 + F.log10(tf)) * F.log10(F.lit(float(n_records)) / F.col("df")), 9))
    rows = rows.withColumn("z", F.round(z_score(tf, F.col("cf").cast("double"), F.col("size").cast("double"), float(total or 1)), 9))
    w = Window.partitionBy("doc_id").orderBy(F.col(by).desc(), "term")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("doc_id", "term", "tf", "df", "z", "weight", "rank")
