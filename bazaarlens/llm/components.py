"""Connected components of a graph that never leaves the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import signature
from bazaarlens.session import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node it reaches.

    Alternates two star operations (Kiveris et al., "Connected Components in MapReduce and
    Beyond"): each node hangs its larger, then its smaller neighbours on the smallest one it
    knows. The number of rounds grows with the logarithm of the longest path. The smallest
    neighbour is an aggregate that combines before the shuffle, and it is joined back instead of
    gathered, so a node with very many neighbours is split by adaptive execution. Every round is
    a written table, which cuts lineage. Loops are ignored; an empty frame gives an empty one.
    """
    now = written(
        edges.where("a <> b")
        .select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a"))
        .select("a", "b")
        .distinct(),
        "components",
    )
    mark = signature(now)
    while True:
        now = written(_small_star(_large_star(now)), "components")
        before, mark = mark, signature(now)
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, after each node hung its larger neighbours on its smallest one."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = both.where("v > u").join(least, "u")
    return hung.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b"))).distinct()
