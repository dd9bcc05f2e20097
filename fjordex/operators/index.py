"""The inverted index as tables: postings (term, doc_id, tf) and what follows from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjordex.functions.codecs import vbyte_size
from fjordex.functions.text import run_lengths, terms
from fjordex.session import written

Analyzer = Callable[[Column], Column]  # text -> array of tokens


def postings(docs: DataFrame, fields: list[str], analyzer: Analyzer = terms, id_col: str = "doc_id", unique_ids: bool = False) -> DataFrame:
    """(term, doc_id, tf): how often each term occurs in the named fields of each document.

    A null or missing text holds no term; a null id is no document. The terms of
    a document lie in one row, so they are counted there and no occurrence is
    ever shuffled. Rows of equal ids are one document: what they hold is added
    up in a shuffle of finished counts, which ``unique_ids`` spares where
    every id is known to have one row.
    """
    tokens = F.concat(*(analyzer(F.col(f)) for f in fields)) if len(fields) > 1 else analyzer(F.col(fields[0]))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sort_array(tokens).alias("tokens")).where("doc_id is not null")
    counted = rows.select("doc_id", F.explode(run_lengths(F.col("tokens"))).alias("x")).select("x.term", "doc_id", "x.tf")
    return counted if unique_ids else counted.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))


def positions(docs: DataFrame, fields: list[str], analyzer: Analyzer = terms, id_col: str = "doc_id") -> DataFrame:
    """(term, doc_id, field, pos): where each term stands; ``field`` is the place of its name in ``fields``.

    The index of phrase search. Null texts and ids hold nothing.
    """
    out = None
    for i, f in enumerate(fields):
        rows = docs.select(F.col(id_col).alias("doc_id"), F.lit(i).alias("field"), F.posexplode(analyzer(F.col(f))).alias("pos", "term")).where("doc_id is not null")
        out = rows if out is None else out.unionByName(rows)
    return out.select("term", "doc_id", "field", "pos")


def statistics(post: DataFrame) -> DataFrame:
    """(term, df, cf): documents with the term and its occurrences."""
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def lookup(post: DataFrame, term: str) -> DataFrame:
    """Postings of one (already analysed) term, by document."""
    return post.where(F.col("term") == term).select("doc_id", "tf").orderBy("doc_id")


def term_ids(docs: DataFrame, field: str, analyzer: Analyzer = terms, id_col: str = "doc_id") -> DataFrame:
    """(term, term_id): dense ids from 0 in the order of first appearance.

    Ids are dense over all terms, so this needs one global order; it is taken over the
    first appearances only (one row for each distinct term).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(analyzer(F.col(field))).alias("pos", "term"))
    first = rows.groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    return dense_ids(first, [F.col("at.doc_id"), F.col("at.pos")], "term_id").select("term", "term_id")


def dense_ids(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Ids 0, 1, ... in a global order: ranges are numbered in parallel and shifted by the sizes of those before.

    The bounds of the ranges come from a sample and differ from one reading to
    the next, so the ranged and numbered rows are written once, and sizes and ids
    are taken from that table. Only one count for each range comes to one place.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()  # range number * 2^33 + place in the range
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", at)
    local = written(ranged, "ranged")
    part, nth = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = local.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    # one row for each range
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    return local.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_shift") + nth).drop("_part", "_at", "_shift")


def _with_previous(post: DataFrame, order: str) -> DataFrame:
    """Postings with ``before``: the document of the posting that precedes it in its term's list, null for the first.

    A list may be as long as the collection, so lists are cut into ranges of
    (term, order), and each range looks up its neighbour's last posting (one row for each range).
    """
    ranged = written(post.repartitionByRange("term", order).withColumn("_part", F.spark_partition_id()), "ranged")
    last = ranged.groupBy("_part").agg(F.max(F.struct("term", F.col(order).alias("at"), "doc_id")).alias("_last"))
    earlier = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_last"))
    inside = F.lag("doc_id").over(Window.partitionBy("_part", "term").orderBy(order))
    across = F.when(F.col("_last.term") == F.col("term"), F.col("_last.doc_id"))
    rows = ranged.withColumn("_inside", inside).join(F.broadcast(earlier), "_part")
    return rows.withColumn("before", F.coalesce("_inside", across)).drop("_part", "_inside", "_last")


def gaps(post: DataFrame) -> DataFrame:
    """(term, doc_id, tf, gap, bytes): document gaps and the size of gap and tf in variable-byte code."""
    g = _with_previous(post, "doc_id").withColumn("gap", F.col("doc_id") - F.coalesce("before", F.lit(0))).drop("before")
    return g.withColumn("bytes", vbyte_size(F.col("gap")) + vbyte_size(F.col("tf")))


def out_of_order(post: DataFrame, order: str) -> DataFrame:
    """Postings that do not ascend by document in the stored order; a sound list has none."""
    return _with_previous(post, order).where("doc_id <= before").drop("before")
