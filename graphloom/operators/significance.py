"""Paired tests of two measurements: Student's t and the signed-rank test, with p-values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Pairs up to which the signed-rank statistic has its exact law, unless values tie.
MOST_EXACT = 50
#: Ranges of values that tasks sort.
RANGES = 256
#: Level of significance.
ALPHA = 0.05


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz) on the side where that converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d, out = 1.0, 0.0, 1.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        out *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (out - 1)


def t_tails(t: float, df: float) -> float:
    """The probability that Student's t with ``df`` degrees of freedom is as far from 0, on either side."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def signed_rank_tails(least: float, n: int, ties: float, exact: bool) -> float:
    """The probability of a smaller sum of ranks of at most ``least`` on either side. ``ties``: the sum of t^3 - t over the
    values that t pairs share. Exact: by the number of subsets of 1..n for each sum; else by the normal law."""
    if exact:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k]
        return min(1.0, 2 * float(ways[: int(least) + 1].sum() / ways.sum()))
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return math.erfc(abs(least - n * (n + 1) / 4) / spread / math.sqrt(2)) if spread else 1.0


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_tails(a, b) if a == a and b == b and a is not None else None for a, b in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def signed_rank_p(least: pd.Series, n: pd.Series, ties: pd.Series, exact: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_tails(w, int(m), k, bool(e)) if w == w and m == m and m else None for w, m, k, e in zip(least, n, ties, exact, strict=True)], dtype="float64")


def signed_ranks(pairs: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """group, n_ranked, positive, negative (sums of ranks), ties, exact: ranks of |x - y| within each group, ties by their
    mean; pairs without a difference have no rank.

    Equal differences are one row. Running counts are taken inside ranges of values, cut at approximate quantiles of each
    group, and moved up by the totals of the ranges before, so no task sorts a group."""
    d = F.col(x).cast("double") - F.col(y).cast("double")
    valid = pairs.select(F.col(group).alias("g"), d.alias("d")).filter("d is not null and d <> 0 and not isnan(d)")
    counts = valid.groupBy("g", F.abs("d").alias("v")).agg(F.count_if(F.col("d") > 0).alias("up"), F.count(F.lit(1)).alias("c"))
    shares = [k / RANGES for k in range(1, RANGES)]
    cuts = counts.groupBy(F.col("g").alias("cg")).agg(F.array_sort(F.array_distinct(F.percentile_approx("v", shares, 10 * RANGES))).alias("cuts"))
    placed = counts.join(cuts, F.col("g").eqNullSafe(F.col("cg"))).select("g", "v", "up", "c", F.size(F.filter("cuts", lambda k: k <= F.col("v"))).alias("range"))
    inside = F.coalesce(F.sum("c").over(Window.partitionBy("g", "range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = F.col("c").cast("double")
    parts = placed.withColumn("rank", inside + (c + 1) / 2).groupBy("g", "range").agg(
        F.sum("c").alias("c"), F.sum("up").alias("up"), F.sum(F.col("up") * F.col("rank")).alias("w"), F.sum(c * c * c - c).alias("ties")
    )
    # a row a range of each group
    before = F.coalesce(F.sum("c").over(Window.partitionBy("g").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = parts.withColumn("w", F.col("w") + F.col("up") * before).groupBy("g").agg(F.sum("c").alias("n"), F.sum("w").alias("w"), F.sum("ties").alias("ties"))
    n = F.col("n").cast("double")
    return whole.select(F.col("g").alias(group), F.col("n").alias("n_ranked"), F.col("w").alias("positive"), (n * (n + 1) / 2 - F.col("w")).alias("negative"), "ties", ((F.col("n") <= MOST_EXACT) & (F.col("ties") == 0)).alias("exact"))


def paired_tests(pairs: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """For each group: n_pairs, mean_delta, t, t_p, significant, w (the smaller sum of ranks), w_p. Pairs with a null are left
    out. Fewer than two pairs, or differences without spread, have no t; groups without a difference have no w. The law of w
    is exact up to ``MOST_EXACT`` pairs without ties and without equal measurements, else normal with a correction for ties."""
    d = F.col(x).cast("double") - F.col(y).cast("double")
    sums = pairs.groupBy(F.col(group).alias("g")).agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"), F.count_if(d == 0).alias("equal"))
    ranks = signed_ranks(pairs, group, x, y).withColumnRenamed(group, "rg")
    t = F.when((F.col("n") > 1) & (F.col("s") > 0), F.col("m") / (F.col("s") / F.sqrt("n")))
    enough = F.col("n") > 1
    least = F.when(enough, F.least("positive", "negative"))
    joined = sums.join(ranks, F.col("g").eqNullSafe(F.col("rg")), "left").withColumns({"t": t, "w": least, "exact": F.col("exact") & (F.col("equal") == 0)})
    tested = joined.withColumns({"t_p": t_p("t", (F.col("n") - 1).cast("double")), "w_p": signed_rank_p("w", "n_ranked", "ties", "exact")})
    return tested.select(
        F.col("g").alias(group), F.col("n").alias("n_pairs"), F.round("m", 6).alias("mean_delta"), F.round("t", 4).alias("t"), F.round("t_p", 6).alias("t_p"),
        F.coalesce(F.col("t_p") < ALPHA, F.lit(False)).alias("significant"), F.round("w", 4).alias("w"), F.round("w_p", 6).alias("w_p"),
    )
