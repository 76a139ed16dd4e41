"""Paths in a tree by pointer doubling: each round joins ancestors to ancestors, so that depth d takes log d rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emendata.session import scratch


def _kept(df: DataFrame, name: str) -> DataFrame:
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def ancestors(nodes: DataFrame, node: str = "node", parent: str = "parent", most_rounds: int = 40) -> DataFrame:
    """node, ancestor and distance of every node and those above it, itself at distance 0. A root's parent is null."""
    jump = _kept(nodes.where(F.col(parent).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("up")), "jump")
    pairs, length = nodes.select(F.col(node).alias("node"), F.col(node).alias("ancestor"), F.lit(0).alias("distance")), 1
    for _ in range(most_rounds):
        # from within `length` of a node, and from what lies `length` above it, to within twice that
        further = pairs.join(jump.withColumnsRenamed({"node": "ancestor", "up": "next"}), "ancestor").select("node", F.col("next").alias("ancestor"), (F.col("distance") + length).alias("distance"))
        pairs = _kept(pairs.unionByName(further), "ancestors")
        jump = _kept(jump.alias("a").join(jump.alias("b"), F.col("a.up") == F.col("b.node")).select("a.node", "b.up"), "jump")
        length *= 2
        if jump.isEmpty():
            return pairs
    raise ValueError("the parents run in a circle")


def inclusive(nodes: DataFrame, value: str, node: str = "node", parent: str = "parent") -> DataFrame:
    """Node, depth, own and the sum of value over the node and all below it. Sums are made before the shuffle, so that a root's many rows come as few."""
    up = ancestors(nodes, node, parent)
    own = nodes.select(F.col(node).alias("node"), F.coalesce(value, F.lit(0)).alias("own"))
    sums = up.join(own, "node").groupBy("ancestor").agg(F.sum("own").alias("inclusive")).withColumnRenamed("ancestor", "node")
    depth = up.groupBy("node").agg(F.max("distance").cast("long").alias("depth"))
    return own.join(sums, "node").join(depth, "node").select("node", "depth", "own", "inclusive")
