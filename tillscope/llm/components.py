"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.session import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u")
    own = least.select("u", F.col("m").alias("v"))
    return own.unionByName(tied.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``node, root`` for every node of ``edges(u, v)`` bigint; ``root`` is the least node of the component.

    Each round is written to the shared folder, so a lost executor costs one round at most. Stars on hub nodes are
    equi-joins that adaptive execution may split; no component is gathered anywhere.
    """
    now = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            tied = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct())
        seen, now = mark, settle(_small_star(_large_star(now)))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
