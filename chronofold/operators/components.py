"""Connected components by alternating star contraction.

Each round joins every node to the smallest label around it and re-hangs its other neighbours there, so the number of
rounds grows with the logarithm of the longest chain, not with its length. Hubs are safe: a node's neighbours are only
ever aggregated with ``min`` (map-side combined) and joined back, never gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v), u > v. large: larger neighbours move to the minimum; else smaller ones and the node itself."""
    around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select("u", F.least("u", "m").alias("m"))
        moved = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u != v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge list; ``component`` is the smallest node reachable.

    Edges with a null end count for nothing; self loops and repeated edges are harmless (a node with a self loop only is
    its own component); an empty list gives an empty result. Node columns may have any orderable type.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    start = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())  # the input is computed once
    alone = start.filter("u = v").select(F.col("u").alias("node"))
    work = start.filter("u != v")
    if work.isEmpty():
        return alone.select("node", F.col("node").alias("component"))
    seen = None
    for _ in range(max_rounds):
        work = cut(_star(_star(work, True), False))
        size = work.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if size == seen:
            break
        seen = size
    else:
        raise RuntimeError("connected_components did not converge")
    hung = work.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = hung.select(F.col("component").alias("node")).union(alone).distinct().join(hung.select("node"), "node", "left_anti")
    return hung.union(roots.select("node", F.col("node").alias("component")))
