"""Connected components of an edge table by alternating large and small stars, without collecting the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written


def connected_components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """node, root for every node of `edges` (a, b of one type); root is the least node that it reaches.

    Self-loops and repeated edges are allowed, null ends are not. Each round is one shuffle of the edges by node and
    one of the new ones; the number of rounds grows with the logarithm of the longest path. No edges give no rows.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), name)
    before = None
    for _ in range(most_rounds):
        # Large star: of each node, the larger neighbours move to its least neighbour (or itself).
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.filter("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        # Small star: of each node, its smaller neighbours and itself move to the least of them.
        first = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(first.hint("merge"), "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e")).select("e.*")
        old, now = now, written(small.filter("a != b").distinct(), name)
        release(old)
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
    raise RuntimeError("components did not settle")
