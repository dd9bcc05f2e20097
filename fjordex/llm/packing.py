"""Filling containers of fixed capacity: vector best-fit over tokens, documents and attention cost."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fjordex.llm.common import tokenizer_path
from fjordex.session import written

# Documents that are packed together; the hash of the id says where a document goes, so a shard has about so many at every size.
SHARD = 8_192
WEIGHTS = (1.0, 0.05, 0.05)  # tokens, documents, attention cost
# Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str) -> object:
    """A byte-level BPE of public ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", more: tuple[str, ...] = (), vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, n_tokens, further columns): size of every text; a null or empty text has none."""
    path = tokenizer_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(b.column(i) for i in range(2, b.num_columns))], ["doc_id", "n_tokens", *more])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("_text"), *more)
    schema = "doc_id long, n_tokens long" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in more)
    return cols.mapInArrow(run, schema)


def best_fit(tokens: np.ndarray, capacity: int, most_documents: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS, attention: float = 1.0) -> np.ndarray:
    """Bin of each item (none larger than the capacity), largest items first.

    The residuals of the bins are vectors: tokens, documents (``most_documents``;
    None is no limit), and attention cost, the sum of squared lengths, whose
    capacity is the share ``attention`` of the squared capacity. At 1 the cost
    can't exceed what the tokens allow and only counts in the choice; below 1 it
    keeps long items apart, and an item that is beyond it by itself has a bin alone. Of
    the bins that can take an item under every constraint the one is chosen
    whose weighted residual norm is least afterwards (``norm``) or whose weighted
    dot product with the item is greatest (``dot``); ties go to the older bin.
    """
    n = len(tokens)
    out = np.empty(n, np.int64)
    full = np.array([capacity, np.inf if most_documents is None else most_documents, attention * float(capacity) ** 2])
    w = np.array(weights)
    left = np.empty((n, 3))  # shares of the capacity that remain
    bins = 0
    live = np.zeros(0, np.int64)
    # bins with less room than the smallest item still to come are closed
    order = np.argsort(-tokens, kind="stable")
    smallest = tokens.min() / capacity if n else 0
    for step, i in enumerate(order):
        t = float(tokens[i])
        item = np.array([t, 1.0, t * t]) / full
        r = left[live]
        fits = (r >= item - 1e-12).all(1) if len(live) else np.zeros(0, bool)
        if fits.any():
            can = live[fits]
            r = r[fits]
            score = -(((r - item) ** 2) @ w) if rule == "norm" else (r * item) @ w
            b = can[score.argmax()]
        else:
            b, left[bins] = bins, 1.0
            live = np.append(live, b)
            bins += 1
        left[b] -= item
        out[i] = b
        if step % 64 == 63:
            live = live[(left[live, 0] >= smallest - 1e-12) & (left[live, 1] > 1e-9) & (left[live, 2] > 0)]
    return out


def pack(sizes: DataFrame, packs: DataFrame, tokens_each: int | None = None, attention: float = 1.0, rule: str = "norm") -> DataFrame:
    """(pack_name, container, doc_id, part, first_token, tokens) for every document and capacity.

    ``sizes`` has (doc_id, n_tokens), ``packs`` a few rows (pack_name,
    capacity_tokens). ``tokens_each`` limits the documents of a container to one
    for so many tokens of its capacity (None: no limit), ``attention`` its
    attention cost (see ``best_fit``). A text longer than the capacity fills containers of its
    own and only its remainder is packed with others; any other text stays
    whole. Texts without tokens are in no container; repeated rows are items of
    their own; capacities that are null or below 1 are left out.
    """
    sizes = written(sizes.where("n_tokens > 0 and doc_id is not null"), "sizes")
    shards = max(1, math.ceil(sizes.count() / SHARD))
    # a stated, fixed set of capacities; each document becomes an item of each of them
    caps = packs.select("pack_name", F.col("capacity_tokens").cast("long").alias("cap")).where("cap >= 1").collect()
    kinds = F.array(*(F.struct(F.lit(r.pack_name).alias("pack_name"), F.lit(r.cap).cast("long").alias("cap")) for r in caps)).cast("array<struct<pack_name:string,cap:bigint>>")
    items = sizes.withColumn("pack", F.explode(kinds)).select("doc_id", "n_tokens", "pack.*")
    items = items.withColumn("whole", F.floor(F.col("n_tokens") / F.col("cap")).cast("long"))
    own = items.where("whole > 0").select("pack_name", "cap", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("part"))
    # of texts with one id the rows are told apart by their number, which does not change when a task is run again
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy("pack_name", "doc_id", "part").orderBy("part")))
    own = own.select("pack_name", F.concat_ws("-", F.lit("d"), "doc_id", "nth", "part").alias("container"), "doc_id", F.col("part").cast("int").alias("part"), (F.col("part") * F.col("cap")).alias("first_token"), F.col("cap").alias("tokens"))
    rest = items.where("n_tokens > whole * cap").select("pack_name", "cap", "doc_id", F.col("whole").cast("int").alias("part"), (F.col("whole") * F.col("cap")).alias("first_token"), (F.col("n_tokens") - F.col("whole") * F.col("cap")).alias("tokens"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))

    def fill(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["doc_id", "part", "tokens"], kind="stable")
        cap = int(g.cap.iloc[0])
        bins = best_fit(g.tokens.to_numpy(), cap, None if tokens_each is None else max(1, cap // tokens_each), rule, attention=attention)
        g["container"] = [f"s-{s}-{b}" for s, b in zip(g.shard, bins)]
        return g[["pack_name", "container", "doc_id", "part", "first_token", "tokens"]]

    packed = rest.groupBy("pack_name", "shard").applyInPandas(fill, "pack_name string, container string, doc_id long, part int, first_token long, tokens long")
    return own.unionByName(packed)
