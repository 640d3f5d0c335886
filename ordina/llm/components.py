"""Connected components by alternating large-star and small-star steps over DataFrames.

Every step is a grouped minimum (combined before its shuffle) and an equi-join whose large
keys adaptive execution can split, so a node with very many neighbours does not meet in one
task. No link, node or component is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(links: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node that has a link to another node.

    ``component`` is the smallest node that can be reached. Nulls and loops are ignored,
    repeated links count once, no link gives an empty result.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a.isNotNull() & b.isNotNull() & (F.col("a") != F.col("b"))).distinct()
    edges = materialise(edges, "links")
    before = _digest(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = materialise(_small_star(_large_star(edges)), "stars")
        after = _digest(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each larger neighbour of a node on the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
