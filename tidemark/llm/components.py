"""Connected components by alternating star contraction, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def _contract(edges: DataFrame, small: bool) -> DataFrame:
    """One round: every node hands its larger (``small``: its not larger) neighbours to its least neighbour.

    The least neighbour is a combining aggregate, so a node with very many neighbours is no single task.
    """
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # In the small round a > b, and a itself moves too.
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = both.join(least, "a")
    if small:
        pairs = moved.select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
    else:
        pairs = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("x"), "m")
    return pairs.where(F.col("x") != F.col("m")).select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame, label: str) -> DataFrame:
    """node and component (least node it reaches) of all nodes with a link; ``links`` has columns a and b."""
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = written(links.where(F.col("a") != F.col("b")).select(high, low).distinct(), f"{label}-edges")
    before = None
    while True:
        edges = written(_contract(_contract(edges, small=False), small=True), f"{label}-round")
        # The sum of hashes stands still once every edge leads to its component's least node.
        now = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("h")).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
