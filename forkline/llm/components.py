"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forkline.session import stage


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, label`` for every node of ``edges`` (``a``, ``b``, integers): label is the smallest node it reaches.

    Each round hangs neighbours below the smallest node known near them, so a path halves. Every round is a written
    table; a node with very many neighbours is only ever aggregated or joined. The rounds end as soon as all edges
    are stars, which one aggregation by node tells; edges that are stars from the start take no round.
    Empty edges give no rows; loops and repeated edges are dropped; edges with a null end are dropped.
    """
    now = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("below")).union(now.select("b", F.lit(0)))
        held = ends.groupBy("node").agg(F.sum("below").alias("up"), F.min("below").alias("least"))
        # Stars: no node hangs below two others, or below one and above another.
        if held.where("up > 1 or (up = 1 and least = 0)").isEmpty():
            below = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
            tops = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            return below.union(tops)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        now = stage(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct(),
            "edges",
        )
    raise RuntimeError("components did not settle")
