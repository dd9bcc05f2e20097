"""Frequency of every distinct term, kept up to date by signed deltas.

A collection lies in one folder: the states of its records (appended by each
load), the counts of its terms (in hash buckets, of which a load rewrites those
it touches), and a manifest for each version. A load is compared with the states of
its own records only and turned into signed texts (added +1; deleted -1;
changed: the old content -1 and the new +1; equal content nothing), those into
changes of the terms' occurrences and record counts, and these are merged into
the counts. A version becomes valid with its manifest, which is renamed into place; what
a failed load left behind is never read, and a load that is run again under the same name changes nothing.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordex.functions.text import py_terms
from fjordex.llm.common import latest, latest_rows, sized_join
from fjordex.session import scratch_path, written

# Terms of a bucket when the buckets are laid out; they are laid out anew when they hold four times as many.
BUCKET_TERMS = 200_000
# The row of this term, which no text can hold, counts the records with words and all their terms.
TOTAL = ""
_COUNTS = "term string, occurrences long, records long, bucket int"


def term_deltas(signed: DataFrame) -> DataFrame:
    """(term, occurrences, records) of (sign, body): summed changes, combined in the map stage before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cf: Counter[str] = Counter()
        df: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            keys = list(cf)
            cols = [pa.array(keys, pa.string()), pa.array([cf[k] for k in keys], pa.int64()), pa.array([df[k] for k in keys], pa.int64())]
            cf.clear()
            df.clear()
            return pa.RecordBatch.from_arrays(cols, ["term", "occurrences", "records"])

        for b in batches:
            for sign in (1, -1):
                c: Counter[str] = Counter()
                d: Counter[str] = Counter()
                for s, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    words = py_terms(body) if s == sign else None
                    if words:
                        c.update(words)
                        d.update(set(words))
                        c[TOTAL] += len(words)
                        d[TOTAL] += 1
                for t, n in c.items():
                    cf[t] += sign * n
                    df[t] += sign * d[t]
            if len(cf) > 200_000:
                yield out()
        yield out()

    rows = signed.select("sign", "body").mapInArrow(run, "term string, occurrences long, records long")
    return rows.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).where("occurrences <> 0 or records <> 0")


class Folder:
    """Files of a shared file system, by its own interface."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        at = self._path(self.path)
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def read(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first().value)

    def publish(self, name: str, content: dict) -> None:
        """Whole or not at all; RuntimeError if the name is taken."""
        draft, final = (self._path(f"{self.path}/{n}") for n in (f"_{uuid.uuid4().hex}", name))
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"{name} was published by another load")

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)


class TermCounts:
    """Persistent counts of the terms of a collection of records; opening a folder again goes on where it stands."""

    def __init__(self, spark: SparkSession, path: str | None = None, bucket_terms: int = BUCKET_TERMS):
        self.spark = spark
        self.path = path or scratch_path(spark, "term-counts")
        self.bucket_terms = bucket_terms
        self._folder = Folder(spark, self.path)
        versions = sorted(int(m[1]) for n in self._folder.names() if (m := re.fullmatch(r"manifest-(\d+)\.json", n)))
        # at: bucket -> folder that holds its counts; states: folders of record states, by load; schema of the states
        self.state = self._folder.read(f"manifest-{versions[-1]}.json") if versions else {"version": 0, "loads": [], "buckets": 0, "at": {}, "states": [], "schema": None}

    def load(self, deliveries: DataFrame, name: str, key: str = "doc_id", body: str = "body", order: str = "loaded_at") -> bool:
        """Bring in a load under a name of its own; False if it was brought in before.

        Of several deliveries of a record in the load the last counts. A null
        content takes the record away. Rows without a key are dropped.
        """
        if name in self.state["loads"]:
            return False
        signed, states = self.signed(deliveries, key, body, order)
        new = f"states-{len(self.state['loads'])}-{uuid.uuid4().hex[:8]}"
        states.write.parquet(f"{self.path}/{new}")
        at, buckets = self._merged(written(term_deltas(signed), "deltas"))
        manifest = {"version": self.state["version"] + 1, "loads": [*self.state["loads"], name], "buckets": buckets, "at": at, "states": [*self.state["states"], new], "schema": states.schema.jsonValue()}
        self._folder.publish(f"manifest-{manifest['version']}.json", manifest)
        self.state = manifest
        return True

    def signed(self, deliveries: DataFrame, key: str, body: str, order: str) -> tuple[DataFrame, DataFrame]:
        """((sign, body), (k, load, mark, body)): what a load adds and takes, and the new states of the records that it changes."""
        d = deliveries.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(order).alias("at"), F.col(body).alias("body"))
        d = latest_rows(d, "k", "at", "body")
        mark = F.when(F.col("body").isNotNull(), F.xxhash64("body"))
        now = d.select("k", "body", mark.alias("mark"))
        number = F.lit(len(self.state["loads"]))
        if not self.state["states"]:
            now = now.where("body is not null")
            return now.select(F.lit(1).alias("sign"), "body"), now.select("k", number.alias("load"), "mark", "body")
        # of the old states those of the load's records are read, and of each the last
        now = written(now, "load")
        n = now.count()
        old = sized_join(self._states(), now.select("k"), "k", n, "left_semi")
        old = written(latest(old, "k", "load"), "before").select("k", F.col("mark").alias("old_mark"), F.col("body").alias("old"))
        both = now.join(old, "k", "left").where("not (mark <=> old_mark) or not (body <=> old)")
        both = written(both.select("k", "mark", "body", "old"), "changes")
        pairs = F.array(F.struct(F.lit(1).alias("sign"), F.col("body").alias("body")), F.struct(F.lit(-1).alias("sign"), F.col("old").alias("body")))
        return both.select(F.inline(pairs)).where("body is not null"), both.select("k", number.alias("load"), "mark", "body")

    def _states(self) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(self.state["schema"])
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for p in self.state["states"]))

    def _merged(self, deltas: DataFrame) -> tuple[dict[str, str], int]:
        """Write the buckets that (term, occurrences, records) changes touch, merged with what they held; terms that fall to zero are dropped."""
        buckets, n = self.state["buckets"], deltas.count()
        held = self.read() if self.state["at"] else None
        most = 4 * self.bucket_terms * buckets
        size = 0 if held is None else held.count()
        grown = buckets == 0 or size + n > most
        if grown:  # buckets from the number of terms
            buckets = 1 << max(0, math.ceil(math.log2(max(1, (size + n) / self.bucket_terms))))
        new = deltas.select("term", "occurrences", "records", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"))
        touched = list(range(buckets)) if grown else [r.bucket for r in new.select("bucket").distinct().collect()]
        if not touched:
            return self.state["at"], buckets
        old = held if grown else self._read({b: p for b, p in self.state["at"].items() if int(b) in set(touched)})
        merged = new
        if old is not None:
            merged = new.unionByName(old.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")))
        merged = merged.groupBy("bucket", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).where("records > 0")
        folder = f"counts-{self.state['version'] + 1}-{uuid.uuid4().hex[:8]}"
        merged.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return ({} if grown else self.state["at"]) | {str(b): folder for b in touched}, buckets

    def _read(self, at: dict[str, str]) -> DataFrame | None:
        folders: dict[str, list[int]] = {}
        for b, p in at.items():
            folders.setdefault(p, []).append(int(b))
        out = None
        for p, buckets in folders.items():
            part = self.spark.read.schema(_COUNTS).parquet(f"{self.path}/{p}").where(F.col("bucket").isin(buckets))
            out = part if out is None else out.unionByName(part)
        return out

    def read(self) -> DataFrame:
        found = self._read(self.state["at"])
        return self.spark.createDataFrame([], _COUNTS) if found is None else found

    def vacuum(self) -> None:
        """Remove what no current bucket refers to; for use while nothing reads an older version."""
        used = {*self.state["at"].values(), *self.state["states"], f"manifest-{self.state['version']}.json"}
        for name in self._folder.names():
            if name not in used:
                self._folder.drop(name)

    def marked(self, rare_below: int = 3, common_percent: int = 15) -> DataFrame:
        """(term, occurrences, records, mark): mark is rare, common or null."""
        counts = self.read()
        total = counts.where(F.col("term") == TOTAL).select("records").first()
        n = total.records if total else 0
        mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * 100 > F.lit(n * common_percent), "common")
        return counts.where(F.col("term") != TOTAL).select("term", "occurrences", "records", mark.alias("mark"))


def count_deliveries(deliveries: DataFrame, key: str = "doc_id", body: str = "body", order: str = "loaded_at") -> TermCounts:
    """Counts of a table of deliveries, taken as two loads: up to the middle of its time span, and the rest.

    Records delivered again with equal content change nothing. Null and blank
    bodies hold no term; a null ``order`` belongs to the first load; an empty
    table gives empty counts.
    """
    span = deliveries.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).select(F.timestamp_micros(((F.unix_micros("lo") + F.unix_micros("hi")) / 2).cast("long")).alias("cut")).first()
    counts = TermCounts(deliveries.sparkSession)
    late = F.lit(False) if span.cut is None else F.coalesce(F.col(order) > F.lit(span.cut), F.lit(False))
    for name, part in (("early", ~late), ("late", late)):
        counts.load(deliveries.where(part), name, key, body, order)
    return counts
