"""Duplicates hidden by formatting: commutative multiset hashing of normalised fields."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordex.functions.text import py_terms
from fjordex.llm.common import attach_group, latest, py_items, py_nfkc, sized_join
from fjordex.operators.graph import connected_components
from fjordex.session import written

_MOD = 1 << 128


def py_keys(body: str | None, exact: bool = False) -> tuple[bytes, bytes | None] | None:
    """(key of the words in order, key of the multiset of items or None); None for a text without words.

    Each item is hashed by itself and the 128-bit hashes are added, so the
    order of the items is of no account. With ``exact`` the keys are the whole
    canonical contents instead of hashes.
    """
    words = py_terms(body)
    if not words:
        return None
    line = " ".join(words)
    return (line.encode() if exact else xxhash.xxh3_128_digest(line)), item_key(body, exact)


def item_key(body: str, exact: bool = False) -> bytes | None:
    """Key of the multiset of items; None for a text that is no list."""
    text = py_nfkc(body)
    items = py_items(text) if ":" in text or "=" in text else None
    if items is None:
        return None
    if exact:
        return "\n".join(sorted(f"{n}\t{v}" for n, v in items)).encode()
    total = sum(xxhash.xxh3_128_intdigest(f"{n}\t{v}") for n, v in items) % _MOD
    return total.to_bytes(16, "big") + len(items).to_bytes(4, "big")


def fingerprints(docs: DataFrame, id_col: str, body: str, order: str, exact: bool = False) -> DataFrame:
    """(doc_id, at, wkey, ikey, mark) of the last delivery of each record that has words.

    The hashes are made in the scan, so that only fixed-width rows are shuffled;
    ``mark`` tells the body from others delivered at the same time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [py_keys(t, exact) for t in b.column(1).to_pylist()]
            w = pa.array([k and k[0] for k in keys], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), w, pa.array([k and k[1] for k in keys], pa.binary()), b.column(3)], ["doc_id", "at", "wkey", "ikey", "mark"])

    at = docs.schema[order].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(body).alias("body"), F.col(order).alias("at"), F.xxhash64(body).alias("mark")).mapInArrow(run, f"doc_id long, at {at}, wkey binary, ikey binary, mark long")
    return latest(rows, "doc_id", "at", "wkey", "ikey", "mark").where("wkey is not null")


def _unequal(docs: DataFrame, id_col: str, body: str, order: str, members: DataFrame) -> DataFrame:
    """Keys of groups whose members do not hold the same fields.

    For each key and field the number of members that hold it and the least and
    greatest number of times are aggregated (map-side first, so a group of any
    size is spread); all members are equal if every field is in all of them,
    equally often. Nothing is sorted and no member is compared with another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for text, wkey, ikey, size, isize in zip(*(b.column(i).to_pylist() for i in range(5))):
                if not text:
                    continue
                if size > 1:
                    for x, v in zip(out, (wkey, " ".join(py_terms(text)), 1, size)):
                        x.append(v)
                if isize > 1:
                    times: dict[str, int] = {}
                    for n, v in py_items(py_nfkc(text)) or ():
                        times[f"{n}\t{v}"] = times.get(f"{n}\t{v}", 0) + 1
                    for item, n in times.items():
                        for x, v in zip(out, (ikey, item, n, isize)):
                            x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64())], ["key", "field", "times", "size"])

    n = members.count()
    bodies = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct(F.col(order).alias("at")).alias("at"), F.xxhash64(body).alias("mark"), F.col(body).alias("body"))
    rows = sized_join(bodies, members.withColumn("at", F.struct("at")), ["doc_id", "at", "mark"], n).dropDuplicates(["doc_id"])
    fields = rows.select("body", "wkey", "ikey", "size", "isize").mapInArrow(run, "key binary, field string, times int, size long")
    per = fields.groupBy("key", "field").agg(F.count("*").alias("n"), F.min("times").alias("lo"), F.max("times").alias("hi"), F.max("size").alias("size"))
    return per.where("n <> size or lo <> hi").select("key").distinct()


def copy_classes(docs: DataFrame, id_col: str = "doc_id", body: str = "body", order: str = "loaded_at", exact: bool = False) -> DataFrame:
    """(doc_id, first_id, copies) for each record with words; first_id is the smallest of its class.

    Two bodies are copies if their words are the same in the same order, or if
    both are lists of the same ``name: value`` items in any order; a class is
    closed under both. Nulls, blanks and texts of punctuation only have no
    class; repeated deliveries of an id count once (the last); other columns
    are not looked at, so their names may clash with anything. Keys are 128-bit
    hashes whose groups are verified field by field; should one ever hold
    unequal bodies, the classes are made from the whole contents.
    """
    fp = written(fingerprints(docs, id_col, body, order, exact), "fingerprints")
    words = fp.groupBy("wkey").agg(F.min("doc_id").alias("wrep"), F.count("*").alias("size"))
    lists = fp.where("ikey is not null")
    # the key of a list is joined to the class of its words by the smallest ids
    listed = lists.groupBy("ikey", "wkey").agg(F.count("*").alias("n"))
    per_list = listed.groupBy("ikey").agg(F.sum("n").alias("isize"), F.count("*").alias("texts"))
    # each kind of group is made once; what follows reads it
    wide, multi = written(per_list.where("isize > 1"), "lists"), written(words.where("size > 1"), "texts")
    cls = attach_group(fp, multi, ["wkey"], "size").select("doc_id", "wrep", "size")
    big = attach_group(lists, wide, ["ikey"], "isize").select("doc_id", "isize", "texts")
    both = fp.join(cls, "doc_id", "left").join(big, "doc_id", "left").where("size is not null or isize is not null")
    both = written(both.select("doc_id", "at", "mark", "wkey", "ikey", F.coalesce("wrep", "doc_id").alias("wrep"), F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("isize", F.lit(1)).alias("isize"), F.coalesce("texts", F.lit(1)).alias("texts")), "copies")
    if not exact and not _unequal(docs, id_col, body, order, both.select("doc_id", "at", "mark", "wkey", "ikey", "size", "isize")).isEmpty():
        return copy_classes(docs, id_col, body, order, exact=True)
    several = both.where("texts > 1")
    edges = several.select("ikey", "wrep").distinct()
    low = edges.groupBy("ikey").agg(F.min("wrep").alias("low"))
    comp = connected_components(edges.join(low, "ikey").where("wrep <> low"), "wrep", "low").select(F.col("node").alias("wrep"), "component")
    final = written(both.join(comp, "wrep", "left").select("doc_id", F.coalesce("component", "wrep").alias("first_id")), "placed")
    sizes = written(final.groupBy("first_id").agg(F.count("*").alias("copies")), "classes")
    placed = attach_group(final, sizes, ["first_id"], "copies").select("doc_id", "first_id", "copies")
    alone = fp.join(both.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("first_id"), F.lit(1).cast("long").alias("copies"))
    return placed.unionByName(alone)
