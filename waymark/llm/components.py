"""Connected components of a link table, by hooking to the lowest neighbour and jumping to its parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

MAX_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every linked node, the component being its lowest node.

    Each round a node keeps the edge to its lowest neighbour below it, its parent;
    its other such neighbours are tied to that parent instead; and every edge then
    moves up to the parent of its lower end.  The table never grows, and stars,
    which most groups of copies are, are done in one round.  Self-links, repeated
    links and nulls are ignored.
    """
    edges = settle(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    for _ in range(MAX_ROUNDS):
        low = edges.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x"))
        several = low.where("m < x").select("u", "m")
        tied = edges.join(several, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(True).alias("moved"))
        parents = low.select("u", F.col("m").alias("v"))
        every = parents.withColumn("moved", F.lit(False)).unionByName(tied)
        up = parents.select(F.col("u").alias("v"), F.col("v").alias("w"))
        jumped = every.join(up, "v", "left").select("u", F.coalesce("w", "v").alias("v"), (F.col("moved") | F.col("w").isNotNull()).alias("moved"))
        state = settle(jumped)
        edges = state.select("u", "v")
        if state.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"components are not stable after {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
