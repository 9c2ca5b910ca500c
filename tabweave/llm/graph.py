"""Connected components of an edge table, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pinned


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b), where
    ``component`` is the smallest node reachable.

    Alternates large stars (each node links its larger neighbours to the
    smallest node it sees) and small stars (the same for its smaller
    neighbours) until the edges are stars; each half is one aggregate and one
    join, nothing passes the driver but the counts that tell the end. Edges are
    pinned every round.
    """
    edges = pinned(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", "m")).distinct())
        after = pinned(small)
        # done when a round changes nothing
        changed = not after.exceptAll(edges).isEmpty() or not edges.exceptAll(after).isEmpty()
        edges = after
        if not changed:
            break
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(edges.select("b", "b")).distinct())
