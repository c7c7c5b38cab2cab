"""Connected components of an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.tables import cut, discard


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node only and none of these hangs on another: then nothing is left to do."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Alternating large-star and small-star steps: neighbours are re-hung on the smallest node
    known, so the number of rounds grows with the logarithm of the longest path and they always come to an end. A node's
    neighbourhood is only ever reduced by ``min`` (pre-aggregated before the shuffle) and
    joined, never gathered; in the joins its edges meet in one task unless Spark splits that partition. Each
    round's edges are written to the shared folder; a forest of stars, such as an earlier result, takes no round. Null ends and loops are ignored; an
    empty table gives an empty result.
    """
    pairs = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a <> b")
    current = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _is_forest_of_stars(current):
        # large star: every larger neighbour of a node moves to the smallest node around it
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node's smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        following = cut(small, "edges")
        discard(current)
        current = following
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
