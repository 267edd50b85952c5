"""Connected components of a graph of any size by alternating large and small stars, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerline.runtime import settle


def _state(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame, a: str, b: str, label: str = "stars") -> DataFrame:
    """(node, root) for every node with an edge to another one; root is the smallest node that can be reached.

    Edges are undirected; loops, repeats and edges with a null end are ignored, and an empty table gives an empty one. Each round
    points every node at the smallest neighbour known and writes the edges to the shared folder, so the plan stays short and a lost
    executor costs one round. No step gathers a node's neighbours: a hub is an aggregate joined back to its edges.
    """
    x, y = F.col(a), F.col(b)
    pairs = settle(edges.where(x != y).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct(), label)
    state = _state(pairs)
    while state[0]:
        # Large star: every larger neighbour of a node is linked to the smallest node around it.
        around = pairs.select(F.col("lo").alias("node"), F.col("hi").alias("other")).union(pairs.select("hi", "lo"))
        least = around.groupBy("node").agg(F.min("other").alias("low")).select(F.col("node").alias("lo"), F.least("node", "low").alias("low"))
        pairs = pairs.join(least, "lo").select("hi", F.col("low").alias("lo")).distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        low = pairs.groupBy("hi").agg(F.min("lo").alias("low"))
        moved = pairs.join(low, "hi").where("lo != low").select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
        pairs = settle(moved.union(low.select("hi", F.col("low").alias("lo"))).distinct(), label)
        before, state = state, _state(pairs)
        if state == before:
            break
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )
