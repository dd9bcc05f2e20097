"""Corpora from files (text, XML, CSV, TSV, JSON lines) and what is done to them on the way in."""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from fjordex.operators.index import dense_ids

Step = Callable[[DataFrame], DataFrame]


def _place() -> list[Column]:
    """Where a document stands: its file, for a path of several, and its place in it."""
    return [F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_line")]


def _text(spark: SparkSession, path: str) -> DataFrame:
    """One document a line: body, and after a tab meta; blank lines are none."""
    lines = spark.read.text(path).select("value", *_place())
    parts = F.split(F.regexp_replace("value", r"(?U)^\s+|\s+$", ""), "\t")
    rows = lines.select("_path", "_line", parts.alias("p")).where("p[0] <> ''")
    return rows.select("_path", "_line", F.col("p")[0].alias("body"), F.try_element_at("p", F.lit(2)).alias("meta"))


def _xml(spark: SparkSession, path: str) -> DataFrame:
    """One document for each <doc>: its direct text nodes, as they stand, joined by a space."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, source in zip(b._path, b.value):  # a whole file in one row
                for i, doc in enumerate(ET.fromstring(source).iter("doc")):
                    nodes = [doc.text, *(child.tail for child in doc)]
                    out.append((path, i, " ".join(x for x in nodes if x)))
            yield pd.DataFrame(out, columns=["_path", "_line", "body"])

    return spark.read.text(path, wholetext=True).select(_place()[0], "value").mapInPandas(run, "_path string, _line long, body string")


def _separated(sep: str) -> Callable[[SparkSession, str], DataFrame]:
    def load(spark: SparkSession, path: str) -> DataFrame:
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path, sep=sep)
        return rows.select(*_place(), *(F.col(f"`{c}`") for c in rows.columns))

    return load


def _json(spark: SparkSession, path: str) -> DataFrame:
    """One document for each line that begins with { and ends with }; a malformed one fails."""
    schema = spark.read.option("mode", "DROPMALFORMED").json(path).schema  # of the well-formed lines
    lines = spark.read.text(path).select(*_place(), "value").where(F.trim("value").startswith("{") & F.trim("value").endswith("}"))
    return lines.select("_path", "_line", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d")).select("_path", "_line", "d.*")


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {".txt": _text, ".xml": _xml, ".csv": _separated(","), ".tsv": _separated("\t"), ".json": _json}


def read_corpus(spark: SparkSession, paths: list[str], annotations: list[dict[str, str]] | None = None, pipeline: list[Step] | None = None) -> DataFrame:
    """(doc_id, fields): documents of several files with dense ids from 0, in the order of files and lines.

    The reader follows from the extension; ValueError for an unknown one, or if
    there are annotations but not one dict for each file. Annotations are
    constant fields that override a file's own. The pipeline may drop documents;
    ids are given afterwards.
    """
    if annotations is not None and len(annotations) != len(paths):
        raise ValueError("one set of annotations is needed for each file")
    whole = None
    for i, path in enumerate(paths):
        kind = os.path.splitext(path)[1].lower()
        if kind not in READERS:
            raise ValueError(f"no reader for {path}")
        rows = READERS[kind](spark, path).withColumn("_file", F.lit(i))
        for name, value in (annotations[i] if annotations else {}).items():
            rows = rows.withColumn(name, F.lit(value))
        whole = rows if whole is None else whole.unionByName(rows, allowMissingColumns=True)
    if whole is None:
        raise ValueError("no files")
    whole = run_pipeline(whole, pipeline or [])
    return with_ids(whole, [F.col("_file"), F.col("_path"), F.col("_line")]).drop("_file", "_path", "_line")


class AccessLog:
    """How many documents of a corpus, or postings of an index, the actions on observed tables touch, and which.

    Rows are recorded as they pass, so what a filter, a pruned file or a limit
    below spares is not in the log. Counts are kept of any table; the keys only of
    those observed with one, since they come to the driver: that is for tests and audits of single searches.
    """

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def observe(self, df: DataFrame, name: str, key: str | None = None) -> DataFrame:
        """The same rows, logged under a name; ``key`` says what a row is remembered by."""
        self._seen[name] = Observation(name)
        keys = [] if key is None else [F.collect_set(F.col(key).cast("string")).alias("keys")]
        return df.observe(self._seen[name], F.count(F.lit(1)).alias("rows"), *keys)

    def rows(self, name: str) -> int:
        """Rows that passed in the first action on the table; waits for it."""
        return self._seen[name].get["rows"]

    def history(self, name: str) -> set[str]:
        return set(self._seen[name].get["keys"])


def run_pipeline(docs: DataFrame, steps: list[Step]) -> DataFrame:
    """Steps in order; a step may change fields or drop documents."""
    for step in steps:
        docs = docs.transform(step)
    return docs


def with_ids(docs: DataFrame, order: list[Column], name: str = "doc_id") -> DataFrame:
    rows = dense_ids(docs, order, name)
    return rows.select(name, *(c for c in rows.columns if c != name))


def split_by(docs: DataFrame, field: str, separator: str = ",", label: str = "label") -> DataFrame:
    """A row for each document and value of a multi-valued field, values trimmed and lower case; a null field gives the value ""."""
    values = F.array_distinct(F.transform(F.split(F.coalesce(field, F.lit("")), re.escape(separator)), lambda x: F.lower(F.trim(x))))
    return docs.withColumn(label, F.explode(values))


def merge(parts: DataFrame, id_col: str = "doc_id", order: list[str | Column] | None = None) -> DataFrame:
    """Each document of several splits once; the first by ``order`` (default: all columns) wins."""
    w = Window.partitionBy(id_col).orderBy(*(order or parts.columns))
    return parts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def to_json(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, json): {"document_id", "fields"}; null fields are left out."""
    fields = [c for c in docs.columns if c != id_col]
    return docs.select(id_col, F.to_json(F.struct(F.col(id_col).alias("document_id"), F.struct(*fields).alias("fields"))).alias("json"))
