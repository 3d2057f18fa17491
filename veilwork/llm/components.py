"""Connected components of an edge table, by alternating star operations.

Every round replaces edges by edges to smaller neighbours (first from all larger
neighbours of a node, then from all smaller ones) until each component is a star
around its smallest node.  A round is two joins on a node; hot nodes are
pre-aggregated for their minimum and split by adaptive skew joins.  The edges of
each round are written to the shared folder, and those of the round before deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from veilwork.llm.work import discard, written


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and a summary of them that tells whether a round changed anything."""
    seen = Observation()
    summary = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    table = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), summary), "edges")
    return table, (seen.get.get("n"), seen.get.get("s"))


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (the smallest node of its component) for the nodes of ``edges`` (a, b).

    Repeated edges, loops and both directions are allowed.  Nodes without an edge
    to another node are not in the result; an empty table gives an empty result.
    """
    current = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, before = _stored(current)
    while before[0]:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The minima are stored, so that the join with them can split hot nodes.
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = written(least, "minima")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large, "edges")
        small = written(large.groupBy("a").agg(F.min("b").alias("m")), "minima")
        moved = large.join(small, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following, after = _stored(moved.union(small.select("a", F.col("m").alias("b"))).distinct())
        discard(current, least, large, small)
        current = following
        if after == before:
            break
        before = after
    labels = current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
