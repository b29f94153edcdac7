"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelanes.session import materialise


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: every node's neighbours move to the smallest node around it.

    ``large`` moves the neighbours above the node, otherwise those below it.
    The smallest neighbour is a partial aggregate; a node with very many
    neighbours is a skewed join key, which adaptive execution splits.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = both if large else both.where("a > b")
    least = pairs.groupBy("a").agg(F.min("b").alias("_m")).withColumn("_m", F.least("a", "_m"))
    moved = pairs.join(least, "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        out = moved.where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(
            least.select("a", F.col("_m").alias("b"))
        )
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``label``, the smallest node of its component, for every node on an edge (``a``, ``b``).

    Large and small stars in turn until the edges no longer change; each round
    is written to the shared folder, so a lost executor costs one round.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    for _ in range(most_rounds):
        edges = materialise(_stars(_stars(edges, large=True), large=False))
        seen = edges.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.countDistinct("a").alias("d")
        ).first()
        if tuple(seen) == mark and seen["n"] == seen["d"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            )
        mark = tuple(seen)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
