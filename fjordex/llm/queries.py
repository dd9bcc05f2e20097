"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fjordex.llm import abuse, distinctive, formatting, frequencies, lookalikes, mixing, nearduplicates, neighbours, packing, subjects
from fjordex.llm.checks import SQL  # noqa: F401 - read by the entry point
from fjordex.llm.common import source_name, table


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = subjects.tokenised(table(spark, sf_dir, "corpus_docs"))
    model, records = subjects.fit(tokens, table(spark, sf_dir, "subject_samples"), table(spark, sf_dir, "subject_areas"))
    return subjects.subjects(records, model)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "subject_samples").select("doc_id").distinct()
    return _subjects(spark, sf_dir).join(known, "doc_id", "left_anti").select("doc_id", "area")


def p1_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each area and their share of all (record, area) cases."""
    n = _subjects(spark, sf_dir).groupBy("area").agg(F.count("*").alias("records"), F.round(F.avg("score"), 4).alias("mean_score"))
    total = F.sum("records").over(Window.partitionBy())  # over one row for each area
    return n.select("area", "records", "mean_score", F.round(F.col("records") / total, 6).alias("share"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequencies.count_deliveries(table(spark, sf_dir, "corpus_docs")).marked().where("mark is not null").select("term", "mark")


def p2_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequencies.count_deliveries(table(spark, sf_dir, "corpus_docs")).marked()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = neighbours.most_similar(table(spark, sf_dir, "body_vectors"))
    return n.select(F.least("doc_id", "neighbour_id").alias("left_id"), F.greatest("doc_id", "neighbour_id").alias("right_id")).distinct()


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.most_similar(table(spark, sf_dir, "body_vectors")).withColumn("cosine", F.round("cosine", 9)).withColumn("rank", F.col("rank").cast("long"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.disguised(table(spark, sf_dir, "corpus_docs"), table(spark, sf_dir, "headings"), {"body": "part", "meta": "whole"})


def p4_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.consistent(table(spark, sf_dir, "corpus_docs"), ["body", "meta"])


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose body or meta looks like that of another record but is written in other characters."""
    return lookalikes.same_looking(table(spark, sf_dir, "corpus_docs"), ["body", "meta"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearduplicates.near_pairs(table(spark, sf_dir, "corpus_docs"), n=3, similarity=0.6, min_words=30)


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearduplicates.near_groups(table(spark, sf_dir, "corpus_docs"), n=3, similarity=0.6, min_words=30)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = formatting.copy_classes(table(spark, sf_dir, "corpus_docs"))
    return c.where("doc_id <> first_id").select("first_id", F.col("doc_id").alias("copy_id"))


def p6_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = formatting.copy_classes(table(spark, sf_dir, "corpus_docs"))
    return c.where("doc_id = first_id").select("first_id", "copies")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.distinctive_terms(table(spark, sf_dir, "corpus_docs"), by="weight").select("doc_id", "term")


def p7_log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = distinctive.distinctive_terms(table(spark, sf_dir, "corpus_docs"), by="z")
    return d.withColumn("z", F.round("z", 6)).withColumn("weight", F.round("weight", 6))


def _packed(spark: SparkSession, sf_dir: str, **limits: float) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_sizes"), **limits)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p8_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers that also take at most one document for 64 tokens of their capacity and half of its attention cost."""
    return _packed(spark, sf_dir, tokens_each=64, attention=0.5)


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each capacity: overfull containers, texts torn without need, texts with a part missing, and the texts packed."""
    packs = F.broadcast(table(spark, sf_dir, "pack_sizes").select("pack_name", "capacity_tokens"))
    rows = _packed(spark, sf_dir).join(packs, "pack_name")
    full = rows.groupBy("pack_name", "container").agg((F.sum("tokens") > F.max("capacity_tokens")).alias("over"))
    texts = rows.groupBy("pack_name", "doc_id", "capacity_tokens").agg(F.count("*").alias("parts"), F.sum("tokens").alias("tokens"), F.max(F.col("first_token") + F.col("tokens")).alias("reach"))
    count = lambda c: F.sum(c.cast("long")).alias
    texts = texts.groupBy("pack_name").agg(count((F.col("parts") > 1) & (F.col("tokens") <= F.col("capacity_tokens")))("torn"), count(F.col("reach") != F.col("tokens"))("gaps"), F.count("*").alias("documents"))
    return full.groupBy("pack_name").agg(count(F.col("over"))("overfull")).join(texts, "pack_name").select("pack_name", "overfull", "torn", "gaps", "documents")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of each capacity and the share of their room that is used."""
    packs = F.broadcast(table(spark, sf_dir, "pack_sizes").select("pack_name", "capacity_tokens"))
    n = _packed(spark, sf_dir).groupBy("pack_name").agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return n.join(packs, "pack_name").select("pack_name", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").withColumn("source", source_name("source"))
    return mixing.plan(packing.token_counts(docs, more=("source",)), table(spark, sf_dir, "source_targets"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_mixed(spark, sf_dir)[0])


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source: its documents, and whether no document is repeated too often and the share is within 0.02 of the target.

    Documents stay whole, so a share may also be off by what the largest document makes up of the mixture.
    """
    copies, shares = _mixed(spark, sf_dir)
    whole = copies.agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("all"), F.max(F.when(F.col("copies") > 0, F.col("n_tokens"))).alias("most"))
    s = shares.where("max_repeats is not null").crossJoin(F.broadcast(whole))  # one row
    within = F.coalesce(F.col("most_copies") <= F.col("max_repeats"), F.lit(True))
    near = F.abs(F.col("actual_share") - F.col("target_share")) <= 0.02 + F.coalesce(F.try_divide("most", "all"), F.lit(0.0))
    return s.select("source", F.coalesce("documents", F.lit(0)).alias("documents"), within.alias("within_repeats"), near.alias("near_target"))


def _abuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return abuse.scored(docs, abuse.fit(docs, table(spark, sf_dir, "review_labels")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "review_labels").select("doc_id").distinct()
    kinds = F.array(*(F.when(F.col(k), F.lit(k)) for k in abuse.KINDS))
    found = _abuse(spark, sf_dir).join(known, "doc_id", "left_anti").select("doc_id", F.explode(F.array_compact(kinds)).alias("kind"))
    return found.distinct()


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _abuse(spark, sf_dir)


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source (names brought to one spelling; null is its own row) and the rate of each kind."""
    rates = [F.round(F.avg(F.col(k).cast("double")), 6).alias(f"{k}_rate") for k in abuse.KINDS]
    return _abuse(spark, sf_dir).groupBy(source_name("source").alias("source")).agg(F.count("*").alias("documents"), *rates)


QUERIES = {f.__name__: f for f in (p1_found, p1_composition, p2_found, p2_frequencies, p3_found, p3_neighbours, p4_found, p4_consistent, p4_groups, p5_found, p5_groups, p6_found, p6_copies, p7_found, p7_log_odds, p8_containers, p8_fill, p8_limited, p8_invariants, p9_mixture, p9_shares, p9_invariants, p10_found, p10_scores, p10_rates)}
