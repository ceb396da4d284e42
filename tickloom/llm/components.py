"""Connected components of a link table, by alternating star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut, forget


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Relinks each node's larger (or smaller and own) neighbours to its least neighbour. edges: (u, v), u > v."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
    if large:
        both = both.union(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    least = both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
    moved = both.join(least, "n")
    if large:
        moved = moved.where("m > n").select(F.col("m").alias("u"), F.col("least").alias("v"))
    else:
        moved = moved.select(F.col("m").alias("u"), F.col("least").alias("v")).union(least.select(F.col("n").alias("u"), F.col("least").alias("v")))
    return moved.where("u > v").distinct()


def components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of pairs (a, b): root is the least node that is reachable.

    Each round contracts stars around larger, then around smaller neighbours; the diameter falls geometrically, and no node's
    links are ever gathered in one place. Rounds are cut by checkpoints in the shared folder. Loops and repeated pairs don't
    matter; no pairs give no rows.
    """
    edges = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    stamp = None
    for _ in range(max_rounds):
        edges = cut(_star(_star(edges, True), False))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("bigint")).alias("h")).first()
        if now == stamp:
            break
        stamp = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    forget(edges.sparkSession)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
