"""Work on the members of a bucket in bounded tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def block_pairs(member: Column, blocks: Column) -> Column:
    """Array of (one, two, side): the pairs of blocks in which a member of a bucket of ``blocks`` blocks meets the
    others. A member belongs to one block, by hash; ``side`` tells the two blocks of a pair apart."""
    mine = F.pmod(F.xxhash64(member), blocks).cast("int")
    return F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda other: F.struct(F.least(mine, other).alias("one"), F.greatest(mine, other).alias("two"), (mine > other).cast("int").alias("side")),
    )


def tree_edges(left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges that connect what the pairs (left, right) of 0..n-1 connect: fewer than n, at most three at a node."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    groups: dict[int, list[int]] = {}
    for x in range(n):
        groups.setdefault(root(x), []).append(x)
    return [(g[i], g[(i - 1) // 2]) for g in groups.values() for i in range(1, len(g))]
