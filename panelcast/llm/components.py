"""Connected components of an edge list, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import _base as B


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of an edge and the smallest node it is connected to.

    Large and small stars in turn (each node hands its larger, then its smaller neighbours to the
    smallest one it sees) until nothing changes; the rounds grow with the logarithm of a
    component's size. Every round ends in the shared folder. Minima are aggregated before
    shuffles and written before they are joined, so Spark can split the join on a node with many
    edges. Null nodes, self loops and repeated edges are harmless.
    """
    found = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col("u") > F.col("v")).distinct()
    found = B.checkpointed(found)
    mark = None
    while True:
        both = found.unionAll(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = B.checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        # large stars: the larger neighbours of u go to u's minimum
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") > F.col("v")).distinct()
        # small stars: u and its smaller neighbours go to their minimum
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        found = B.checkpointed(small.filter(F.col("u") > F.col("v")).distinct())
        now = found.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = found.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return found.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
