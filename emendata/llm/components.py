"""Connected components by alternating large and small stars, cut by checkpoints; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emendata.llm.common import cut

#: Nodes (two ids each) that may be broadcast; beyond, a node's neighbours fall on SALTS tasks.
BROADCAST_NODES, SALTS = 300_000, 16


def _with(edges: DataFrame, nodes: DataFrame, small: bool) -> DataFrame:
    """edges with the row of their node a; a hub's edges are spread over several tasks."""
    if small:
        return edges.join(F.broadcast(nodes), "a")
    salted = nodes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(salted, ["a", "_salt"]).drop("_salt")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the least node of its component) for every node that has an edge (columns a, b)."""
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, small = None, 2 * now.count() <= BROADCAST_NODES
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _with(both.where("b > a"), least, small).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        parts = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))
        now = cut(_with(large, least, small).select(F.explode(parts).alias("e")).select("e.*").where("a != b").distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
