"""Postings kept up to date from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fjordex.operators.index import postings


def stream_postings(docs: DataFrame, fields: list[str], path: str, checkpoint: str, id_col: str = "doc_id", buckets: int = 8) -> StreamingQuery:
    """Append the postings of each micro-batch to a table partitioned by a hash bucket of the term.

    A batch is written under its own number, so that a batch run again after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        post = postings(batch, fields, id_col=id_col).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
        post.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
