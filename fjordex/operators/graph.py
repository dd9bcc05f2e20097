"""Link analysis and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordex.session import forget, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int | None = None) -> DataFrame:
    """(node, component): every node of an edge with the smallest id it is connected to.

    Alternating large-star and small-star steps: each round joins the edges with
    the smallest neighbour of each node, so the number of rounds grows with the
    logarithm of the longest path. Minima are pre-aggregated before the shuffle,
    and a node with very many neighbours is split by AQE's skew join. Lineage is
    cut by a written table each round. Null ends and self links are left out; an
    empty table of edges gives an empty result. It goes on until nothing changes; a
    ``max_rounds`` that is not enough for that is a RuntimeError.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state, rounds = None, 0
    while True:
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == state or now[0] == 0:
            break
        if max_rounds is not None and rounds == max_rounds:
            raise RuntimeError(f"components still change after {max_rounds} rounds")
        state, rounds = now, rounds + 1
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(e)
        e = new
    ends = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def pagerank(edges: DataFrame, nodes: DataFrame, alpha: float = 0.15, iterations: int = 20, src: str = "src", dst: str = "dst", node: str = "node", start: DataFrame | None = None) -> DataFrame:
    """(node, rank) after a fixed number of power iterations from the uniform vector.

    Repeated edges count once; edges of unlisted or null nodes are left out. With
    probability ``alpha`` the walk jumps anywhere, and from a node without edges
    always. An iteration is one join of the edges with the ranks and one
    aggregate, whose sums are made partially before the shuffle, so a node with
    very many links to it does not gather them in one task, and the join splits one with
    very many links from it. Ranks are written after each iteration, so that every plan reads three tables.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    v = written(nodes.select(F.col(node).alias("node")).where("node is not null").distinct(), "nodes")
    n = v.count()
    if not n:
        return v.withColumn("rank", F.lit(0.0))
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    e = e.join(v, e.src == v.node, "left_semi").join(v, e.dst == v.node, "left_semi")
    degree = e.groupBy("src").agg(F.count("*").alias("degree"))
    e = written(e, "links")
    # ranks come with the number of links, which is null for a node without
    ended = written(v.join(degree, v.node == degree.src, "left").select("node", "degree"), "degrees")
    x = written(ended.withColumn("rank", F.lit(1.0 / n)) if start is None else ended.join(start, "node").select("node", "degree", "rank"), "ranks")
    for _ in range(iterations):
        loose = F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("rank"))), F.lit(0.0))
        bound = F.coalesce(F.sum(F.when(F.col("degree").isNotNull(), F.col("rank"))), F.lit(0.0))
        free, held = x.agg(loose, bound).first()
        shares = e.join(x.select(F.col("node").alias("src"), (F.col("rank") / F.col("degree")).alias("part")), "src").groupBy("dst").agg(F.sum("part").alias("share"))
        rank = F.lit(alpha / n * held + free / n) + (1 - alpha) * F.coalesce("share", F.lit(0.0))
        new = written(ended.join(shares, ended.node == shares.dst, "left").select("node", "degree", rank.alias("rank")), "ranks")
        forget(x)
        x = new
    return x.select("node", "rank")
