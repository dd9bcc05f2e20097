"""The k most similar vectors of every vector: an inverted multi-index.

Vectors are brought to unit length and cut into two halves, each with its own
k-means centroids; a cell is a pair of centroids. A query visits cells in
the order of the summed squared distances of its halves to the two centroids,
popped from a heap that starts at the nearest pair, until the cells hold
enough vectors, and all vectors of those cells are ranked by their exact
cosine. Cells are stored in blocks of about equal size; a query is sent to
the blocks that hold its cells, once each, and the best of each block are merged.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fjordex.llm.common import attach_group
from fjordex.session import written

# The centroids are fitted on at most so many vectors (chosen by hash); every vector is indexed.
SAMPLE = 16_384
PER_CELL = 8  # vectors in a cell, on average over all pairs of centroids
MOST_CENTROIDS = 2_048  # of each half, so that the counts of all cells fit a worker; cells of more vectors are split
# A query visits cells of at least so many vectors, and of more as the collection grows: in proportion to the root of its size.
CANDIDATES, CANDIDATES_AT = 400, 5_000
BLOCK = 16_384  # vectors in a block of cells
QUERIES = 32_768  # queries of a block in one task
ROUNDS = 12


def enough_of(n: int) -> int:
    """Candidates of a query among n different vectors."""
    return math.ceil(CANDIDATES * math.sqrt(max(1.0, n / CANDIDATES_AT)))


def by_place(c: np.ndarray) -> np.ndarray:
    """Centroids in an order in which neighbours are near: halves by their direction of greatest spread, over and over."""
    if len(c) < 3:
        return c
    x = c - c.mean(0)
    along = x @ np.linalg.svd(x, full_matrices=False)[2][0]
    order = np.argsort(along, kind="stable")
    half = len(c) // 2
    return np.concatenate([by_place(c[order[:half]]), by_place(c[order[half:]])])


def interleaved(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places of cells (i, j) on a curve that keeps squares of near cells together."""
    out = np.zeros(len(i), np.int64)
    for b in range(16):
        out |= ((i >> b) & 1) << (2 * b + 1) | ((j >> b) & 1) << (2 * b)
    return out


def kmeans(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=k)
        for j in np.flatnonzero(n):
            c[j] = x[near == j].mean(0)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = x[rng.choice(len(x), len(empty), replace=False)]
    return c


def traverse(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells i * K2 + j in the order of d1[i] + d2[j], those without vectors left out, until ``enough`` vectors are met."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    o1, o2 = o1.tolist(), o2.tolist()
    k1, k2 = len(s1), len(s2)
    heap = [(s1[0] + s2[0], 0, 0)]
    found, met = [], 0
    while heap and met < enough:
        _, a, b = heapq.heappop(heap)
        # each pair is reached once: along the row, and down the first column
        if b + 1 < k2:
            heapq.heappush(heap, (s1[a] + s2[b + 1], a, b + 1))
        if b == 0 and a + 1 < k1:
            heapq.heappush(heap, (s1[a + 1] + s2[0], a + 1, 0))
        cell = o1[a] * k2 + o2[b]
        n = counts[cell]
        if n:
            found.append(cell)
            met += n
    return found


def _usable(vectors: DataFrame, id_col: str, vector: str, dim: int, kind: str) -> DataFrame:
    """(doc_id, vector as bytes, 128-bit key of the vector) of rows with ``dim`` finite values, not all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), kind).reshape(-1, dim)
            norm = np.sqrt((raw.astype(np.float64) ** 2).sum(1))
            good = np.isfinite(norm) & (norm > 0)
            raw = np.ascontiguousarray(raw[good]) + raw.dtype.type(0)  # no negative zeros
            keys = [xxhash.xxh3_128_digest(r.tobytes()) for r in raw]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(keys, pa.binary())], ["doc_id", "raw", "key"])

    rows = vectors.select(F.col(id_col).cast("long").alias("doc_id"), F.col(vector).alias("v")).where((F.size("v") == dim) & F.col("doc_id").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    return rows.mapInArrow(run, "doc_id long, raw binary, key binary")


def unit_rows(raw: list[bytes], dim: int, kind: str = "f4") -> np.ndarray:
    """Vectors of unit length in double, made where they are compared: floats are moved in half the size."""
    x = np.frombuffer(b"".join(raw), kind).reshape(-1, dim).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def most_similar(vectors: DataFrame, id_col: str = "doc_id", vector: str = "embedding", dim: int = 96, k: int = 5, candidates: int | None = None) -> DataFrame:
    """(doc_id, neighbour_id, cosine, rank): the k most similar other records of every record with a usable vector.

    Usable are vectors of ``dim`` finite values, not all zero. An id counts once,
    with the vector whose hash is least should it have several. Cosines that
    agree to 12 decimals are ties and go to the smaller id. Records that share
    one vector are indexed once, with as many of the smallest ids as can be
    anyone's neighbours; each of them still gets its own neighbours. A query
    meets ``candidates`` vectors at least (default: by the size of the
    collection). Cells lie in blocks of bounded size, near ones together; a cell
    of more vectors than a block is split over several, and the queries of a
    block over several tasks, so that none holds more than BLOCK vectors and about QUERIES queries at once.
    """
    spark = vectors.sparkSession
    w = Window.partitionBy("doc_id").orderBy("key")
    kind = "f8" if isinstance(vectors.schema[vector].dataType.elementType, T.DoubleType) else "f4"
    rows = _usable(vectors, id_col, vector, dim, kind).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    rows = written(rows.withColumnRenamed("key", "cls"), "units")
    # the smallest ids of each vector, first within parts so that a vector shared by very many records is spread
    part = rows.select("cls", "doc_id").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    few = part.withColumn("r", F.row_number().over(Window.partitionBy("cls", "salt").orderBy("doc_id"))).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("doc_id"))).where(F.col("r") <= k + 1)
    ids = few.groupBy("cls").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    size = rows.groupBy("cls").agg(F.count("*").alias("members"), F.min("doc_id").alias("rep"))
    reps = size.join(ids, "cls")
    index = written(rows.join(reps.select("rep", "members", "ids"), rows.doc_id == F.col("rep")).select("cls", "rep", "raw"), "vectors")
    groups = written(reps, "groups")
    n = index.count()
    empty = "doc_id long, neighbour_id long, cosine double, rank int"
    if not n:
        return spark.createDataFrame([], empty)
    half = dim // 2
    enough = enough_of(n) if candidates is None else candidates
    sample = index.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("raw").toArrow().column(0).to_pylist()
    x = unit_rows(sample, dim, kind).astype(np.float32)
    cells = max(1, min(MOST_CENTROIDS, math.ceil(math.sqrt(n / PER_CELL))))
    books = spark.sparkContext.broadcast(tuple(by_place(kmeans(x[:, part], cells)) for part in (slice(None, half), slice(half, None))))
    k1, k2 = map(len, books.value)

    def distances(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        v = unit_rows(raw, dim, kind).astype(np.float32)
        return tuple(((a * a).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * a @ c.T) for a, c in zip((v[:, :half], v[:, half:]), books.value))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d1, d2 = distances(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d1.argmin(1).astype(np.int64) * k2 + d2.argmin(1))], ["rep", "raw", "cell"])

    placed = written(index.select("rep", "raw").mapInArrow(place, "rep long, raw binary, cell long"), "cells")
    held = placed.groupBy("cell").agg(F.count("*").alias("n")).toArrow()  # at most MOST_CENTROIDS ** 2 rows
    cell_ids, cell_n = held.column("cell").to_numpy(), held.column("n").to_numpy()
    order = np.argsort(interleaved(cell_ids // k2, cell_ids % k2))
    cell_ids, cell_n = cell_ids[order], cell_n[order]
    counts, first, parts = (np.zeros(k1 * k2, np.int32) for _ in range(3))
    counts[cell_ids] = cell_n
    large = cell_n > BLOCK
    blocks = (np.cumsum(np.where(large, 0, cell_n)) // BLOCK).astype(np.int32)
    first[cell_ids], parts[cell_ids] = blocks, 1
    size = -(-cell_n[large] // BLOCK)
    first[cell_ids[large]] = blocks.max(initial=0) + 1 + np.cumsum(size) - size
    parts[cell_ids[large]] = size
    shared = spark.sparkContext.broadcast((counts, first, parts))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, first, parts = shared.value
        for b in batches:
            raws = b.column(1).to_pylist()
            for at in range(0, b.num_rows, 1_000):
                these = raws[at : at + 1_000]
                d1, d2 = distances(these)
                out: tuple[list, list, list, list] = ([], [], [], [])
                for i, (rep, raw) in enumerate(zip(b.column(0).to_pylist()[at : at + 1_000], these)):
                    by: dict[int, list[int]] = {}
                    for c in traverse(d1[i], d2[i], counts, enough):
                        for p in range(parts[c]):
                            by.setdefault(int(first[c]) + p, []).append(c)
                    for where, cells in by.items():
                        for o, v in zip(out, (where, rep, raw, cells)):
                            o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int32()))], ["block", "query", "raw", "cells"])

    queries = placed.select("rep", "raw").mapInArrow(visit, "block int, query long, raw binary, cells array<int>")

    def with_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, parts = shared.value
        for b in batches:
            cell, rep = b.column(2).to_numpy(), b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(first[cell] + (rep % parts[cell]).astype(np.int32)), *b.columns], ["block", "rep", "raw", "cell"])

    data = placed.mapInArrow(with_block, "block int, rep long, raw binary, cell long")
    # the vectors of a block go to each task that some of its queries are in; how many visit it is told by every 16th query
    split = F.lit(1)
    if n > QUERIES:
        some = placed.where(F.pmod(F.xxhash64("rep"), F.lit(16)) == 0).select("rep", "raw").mapInArrow(visit, "block int, query long, raw binary, cells array<int>")
        many = {r.block: r.tasks for r in some.groupBy("block").agg(F.ceil(F.count("*") * 16 / QUERIES).cast("int").alias("tasks")).where("tasks > 1").collect()}
        if many:  # at most 16 visits of a query / QUERIES
            split = F.coalesce(F.create_map(*(F.lit(x) for kv in many.items() for x in kv))[F.col("block")], F.lit(1))
    queries = queries.withColumn("task", F.pmod(F.xxhash64("query"), split).cast("int"))
    data = data.withColumn("task", F.explode(F.sequence(F.lit(0), split - 1)))
    keep = k + 1

    def rank(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": np.zeros(0, np.int64), "near": np.zeros(0, np.int64), "cosine": np.zeros(0)})
        if not len(q) or not len(d):
            return none
        d = d.sort_values(["cell", "rep"])
        vec = unit_rows(d.raw, dim, kind)
        reps, cell = d.rep.to_numpy(), d.cell.to_numpy()
        names, starts = np.unique(cell, return_index=True)
        ends = np.r_[starts[1:], len(cell)]
        qv = unit_rows(q.raw, dim, kind)
        n_cells = np.array([len(c) for c in q.cells])
        asked = np.concatenate(q.cells.to_list())
        who = np.repeat(np.arange(len(q)), n_cells)
        order = np.argsort(asked, kind="stable")
        asked, who = asked[order], who[order]
        groups, first = np.unique(asked, return_index=True)
        last = np.r_[first[1:], len(asked)]
        at = np.searchsorted(names, groups)
        found_q, found_r, found_c = [], [], []
        for g in range(len(groups)):
            s, e = starts[at[g]], ends[at[g]]
            those = who[first[g] : last[g]]
            for i in range(0, len(those), 2_000):
                part = those[i : i + 2_000]
                c = np.round(qv[part] @ vec[s:e].T, 12)
                if e - s > keep:
                    cut = -np.partition(-c, keep - 1, axis=1)[:, keep - 1]
                    row, col = np.nonzero(c >= cut[:, None])
                else:
                    row, col = np.divmod(np.arange(c.size), e - s)
                found_q.append(part[row])
                found_r.append(reps[s:e][col])
                found_c.append(c[row, col])
        fq, fr, fc = np.concatenate(found_q), np.concatenate(found_r), np.concatenate(found_c)
        order = np.lexsort((fr, -fc, fq))
        fq, fr, fc = fq[order], fr[order], fc[order]
        begin = np.flatnonzero(np.r_[True, fq[1:] != fq[:-1]])
        nth = np.arange(len(fq)) - np.repeat(begin, np.diff(np.r_[begin, len(fq)]))
        top = nth < keep
        return pd.DataFrame({"query": q["query"].to_numpy()[fq[top]], "near": fr[top], "cosine": fc[top]})

    ranked = queries.groupBy("block", "task").cogroup(data.groupBy("block", "task")).applyInPandas(rank, "query long, near long, cosine double")
    w = Window.partitionBy("query").orderBy(F.col("cosine").desc(), "near")
    best = ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep).drop("r")
    # vectors to records: the smallest ids of each neighbouring vector, then the k + 1 best of them
    ids = groups.select(F.col("rep").alias("near"), "ids")
    docs = best.join(ids, "near").select("query", F.explode("ids").alias("neighbour_id"), "cosine")
    w = Window.partitionBy("query").orderBy(F.col("cosine").desc(), "neighbour_id")
    docs = docs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep)
    lists = docs.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "neighbour_id", "cosine"))).alias("list"))
    # written, since it is looked at for hot groups and then joined
    lists = written(lists.join(groups.select(F.col("rep").alias("query"), "cls", "members"), "query").select("cls", "members", "list"), "lists")
    mine = attach_group(rows.select("doc_id", "cls"), lists, ["cls"], "members")
    out = mine.select("doc_id", F.slice(F.filter("list", lambda x: x["neighbour_id"] != F.col("doc_id")), 1, k).alias("l"))
    return out.select("doc_id", F.posexplode("l").alias("p", "x")).select("doc_id", F.col("x.neighbour_id").alias("neighbour_id"), F.col("x.cosine").alias("cosine"), (F.col("p") + 1).alias("rank"))
