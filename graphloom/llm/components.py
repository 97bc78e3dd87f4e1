"""Connected components of a graph given as edges, for near-duplicate groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) of every node of ``edges`` (a, b: longs, in any order, with repeats).

    Large-star and small-star steps in turn: each node tells its neighbours the smallest one it knows of, until
    nothing changes. The smallest neighbour is an aggregate with a partial sum before the shuffle, and the rows
    stay in proportion to the edges. Null ends and loops are left out; no edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    now = cut(edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # every larger neighbour of a node links to the smallest node around it
        large = both.filter(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).filter(a != b).distinct()
        # every node links its smaller neighbours, and itself, to the smallest
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        to_least = large.join(small_least, "a").select(b.alias("a"), F.col("m").alias("b")).filter(a != b)
        now = cut(to_least.unionByName(small_least.select("a", F.col("m").alias("b"))).distinct())
        n, total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == mark:
            break
        mark = (n, total)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(a.alias("node"), b.alias("component")).unionByName(now.select(b.alias("node"), b.alias("component"))).distinct()
