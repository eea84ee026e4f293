"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise


# The smallest neighbours are written before they are joined back: both sides of the join are
# then plain shuffles, and a node with very many neighbours can be split.
def _large_star(edges: DataFrame, label: str) -> DataFrame:
    """Join every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), label)
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, label: str) -> DataFrame:
    """Join a node and its smaller neighbours to the smallest of them; needs a > b."""
    least = materialise(edges.groupBy("a").agg(F.min("b").alias("m")), label)
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, label: str = "components", rounds: int = 40) -> DataFrame:
    """(a, b) long pairs to (node, root), root the smallest node reachable; roots are left out.

    Null ends and loops are ignored; repeated and reversed pairs do no harm. An empty table
    gives an empty one. Each round is two aggregations and two joins on edges alone and is
    written to the shared folder, so nothing reaches the driver but a count and a checksum.
    """
    now = (
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    now, seen = materialise(now, label), None
    for _ in range(rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if state[0] == 0 or state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        turned = materialise(_large_star(now, label).distinct(), label)
        now = materialise(_small_star(turned, label).distinct(), label)
    raise RuntimeError(f"components not settled after {rounds} rounds")
