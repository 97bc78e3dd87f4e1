"""Evaluation analytics as aggregates over ranked lists, sets and runs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def query_metrics(ranked: DataFrame, totals: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Metrics of each query at each k from ``ranked`` (query_id, rank, rel 0/1) and ``totals`` (query_id, n_relevant).

    Average precision and reciprocal rank use the whole list, so they repeat across k. The ideal of nDCG uses the
    relevant documents inside the top k only."""
    in_order = Window.partitionBy("query_id").orderBy("rank")
    hits = F.sum("rel").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = ranked.withColumn("precision_here", F.when(F.col("rel") > 0, hits / F.col("rank")))
    at = rows.crossJoin(F.broadcast(ranked.sparkSession.createDataFrame([(k,) for k in ks], "k int")))
    top = F.col("rank") <= F.col("k")
    rel = F.when(top, F.col("rel")).otherwise(0)
    grouped = at.groupBy("query_id", "k").agg(
        F.sum(rel).alias("hits"),
        F.coalesce(F.avg("precision_here"), F.lit(0.0)).alias("ap"),
        F.coalesce(1 / F.min(F.when(F.col("rel") > 0, F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.sum(rel / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    joined = grouped.join(totals, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("hits"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    n = F.coalesce("n_relevant", F.lit(0))
    return joined.select(
        "query_id",
        "k",
        (F.col("hits") > 0).cast("double").alias("hit_rate"),
        F.when(n > 0, F.least(F.lit(1.0), F.col("hits") / n)).otherwise(0.0).alias("recall_full"),
        (F.col("hits") / F.col("k")).alias("precision"),
        "ap",
        "rr",
        F.when(F.col("hits") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
    )


METRICS = ("hit_rate", "recall_full", "precision", "ap", "rr", "ndcg")


def metric_table(per_query: DataFrame, scope: str) -> DataFrame:
    """Macro averages over all queries and by ``scope``, for each k: one pass by grouping sets."""
    means = [F.round(F.avg(m), 6).alias(m) for m in METRICS]
    sets = per_query.groupingSets([[F.col("k")], [F.col("k"), F.col(scope)]], F.col("k"), F.col(scope))
    rows = sets.agg(F.grouping(scope).alias("over_all"), F.count(F.lit(1)).alias("n_queries"), *means)
    return rows.select("k", F.when(F.col("over_all") == 1, "all").otherwise(F.col(scope).cast("string")).alias("scope"), "n_queries", *METRICS)


def set_scores(rows: DataFrame, predicted: str, gold: str) -> DataFrame:
    """recall (1 for empty gold) and f1 (1 if both are empty, 0 if one is) of two array columns."""
    both = F.size(F.array_intersect(predicted, gold))
    n_pred, n_gold = F.size(F.array_distinct(predicted)), F.size(F.array_distinct(gold))
    recall = F.when(n_gold == 0, 1.0).otherwise(both / n_gold)
    f1 = F.when((n_pred == 0) & (n_gold == 0), 1.0).when((n_pred == 0) | (n_gold == 0), 0.0).otherwise(2 * both / (n_pred + n_gold))
    return rows.withColumns({"recall": F.round(recall, 6), "f1": F.round(f1, 6)})


def rates_by(rows: DataFrame, cohort: str, status: Column, value: Column) -> DataFrame:
    """Counts and rates of each status over all rows, and the mean of ``value`` over the valid ones."""
    marked = rows.select(cohort, status.alias("status"), value.alias("value"))
    n = F.count(F.lit(1))
    counted = {s: F.count_if(F.col("status") == s) for s in ("valid", "mismatch", "infra")}
    return marked.groupBy(cohort).agg(
        n.alias("n_rows"),
        *(c.alias(f"n_{s}") for s, c in counted.items()),
        F.round(counted["valid"] / n, 6).alias("valid_rate"),
        F.round(F.coalesce(F.avg(F.when(F.col("status") == "valid", F.col("value"))), F.lit(0.0)), 6).alias("mean_valid"),
    )


def run_deltas(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str, regression: float) -> DataFrame:
    """Change of ``value`` between two runs on the same keys, and whether it fell by more than ``regression``."""
    joined = before.withColumnRenamed(value, "before").join(after.withColumnRenamed(value, "after"), list(keys))
    delta = F.round(F.col("after") - F.col("before"), 6)
    return joined.select(*keys, delta.alias("delta"), (delta < -regression).alias("regressed"))


def regression_threshold(rows: DataFrame, group: str, value: str, floor: float) -> DataFrame:
    """Twice the sample deviation, at least ``floor``; the floor for fewer than two rows."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_runs"), F.round(F.greatest(F.lit(floor), F.coalesce(2 * F.stddev_samp(value), F.lit(floor))), 4).alias("threshold"))


#: Groups of fewer rows are sorted whole; of larger ones only the rows between two approximate percentiles, which lie
#: this share below and above the place looked for.
SMALL_GROUP, MARGIN = 10_000, 0.002


def nearest_rank(rows: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """The value at place round(share * (n - 1)), half to even, of the sorted values of each group."""
    valid = rows.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    # the error of the sketch is a tenth of the margin
    near = F.percentile_approx("v", [max(0.0, share - MARGIN), min(1.0, share + MARGIN)], int(10 / MARGIN))
    whole = valid.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), near.alias("near"))
    small = F.col("n") < SMALL_GROUP
    bounds = whole.select(F.col("g").alias("bg"), "n", F.when(small, F.col("least")).otherwise(F.col("near")[0]).alias("low"), F.when(small, F.col("most")).otherwise(F.col("near")[1]).alias("high"))
    met = valid.join(bounds, F.col("g").eqNullSafe(F.col("bg")))
    below = met.groupBy("g").agg(F.count_if(F.col("v") < F.col("low")).alias("below")).withColumnRenamed("g", "ug")
    # ranks from counts of distinct values between the bounds: ties are one row
    counts = met.filter(F.col("v").between(F.col("low"), F.col("high"))).groupBy("g", "n", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumn("inside", upto).join(below, F.col("g").eqNullSafe(F.col("ug"))).withColumn("upto", F.col("inside") + F.col("below"))
    place = F.bround(share * (F.col("n") - 1), 0)
    return placed.filter((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place)).select(F.col("g").alias(group), F.col("n").alias("n_rows"), F.col("v").alias("percentile"))


#: Ranges of values that tasks sort.
VALUE_RANGES = 256


def rank_biserial(rows: DataFrame, group: Column, value: str) -> DataFrame:
    """2U / (nx ny) - 1 of the rows where ``group`` holds against the others, ties by half. Sums over ranks are taken
    inside ranges of values, cut at approximate quantiles, and moved up by the totals of the ranges before."""
    valid = rows.filter(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.coalesce(group, F.lit(False)).alias("first"))
    shares = [k / VALUE_RANGES for k in range(1, VALUE_RANGES)]
    # some hundred numbers, sorted
    cuts = F.broadcast(valid.agg(F.array_sort(F.array_distinct(F.coalesce(F.percentile_approx("v", shares, 10 * VALUE_RANGES), F.array().cast(f"array<{rows.schema[value].dataType.simpleString()}>")))).alias("cuts")))
    counts = valid.groupBy("v").agg(F.count_if("first").alias("x"), F.count_if(~F.col("first")).alias("y"))
    placed = counts.crossJoin(cuts).select("v", "x", "y", F.size(F.filter("cuts", lambda c: c <= F.col("v"))).alias("range"))
    below = F.coalesce(F.sum("y").over(Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = placed.select("range", "x", "y", (F.col("x") * (below + F.col("y") / 2)).alias("u")).groupBy("range").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("u").alias("u"))
    # one row a range
    before = F.coalesce(F.sum("y").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = parts.select("x", "y", (F.col("u") + F.col("x") * before).alias("u")).agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"), F.sum("u").alias("u"))
    return sums.select("nx", "ny", F.round(2 * F.col("u") / (F.col("nx") * F.col("ny")) - 1, 6).alias("effect"))


def mode_wins(rows: DataFrame, case: str, mode: str, modes: Sequence[str], value: str, least: float, most: float) -> DataFrame:
    """Case by mode matrix, and for the first two modes whether the first wins (at least ``least`` against at most
    ``most``)."""
    wide = rows.groupBy(case).pivot(mode, list(modes)).agg(F.round(F.avg(value), 6))
    a, b = F.col(f"`{modes[0]}`"), F.col(f"`{modes[1]}`")
    return wide.select(case, *(F.col(f"`{m}`").alias(f"mode_{m}") for m in modes), F.coalesce((a >= least) & (b <= most), F.lit(False)).alias("first_wins"))


def paired_t(pairs: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Paired t statistic of x - y in each group; null for fewer than two pairs or no spread."""
    d = F.col(x) - F.col(y)
    out = pairs.groupBy(group).agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    t = F.when((F.col("n") > 1) & (F.col("s") > 0), F.round(F.col("m") / (F.col("s") / F.sqrt("n")), 4))
    return out.select(group, "n", F.round("m", 6).alias("mean_delta"), t.alias("t"))


#: Distinct values of a group that one task of the bootstrap holds, about.
BOOTSTRAP_BUCKET = 4096


def bootstrap_mean(rows: DataFrame, group: str, value: str, resamples: int = 1000, seed: int = 42, share: float = 0.95) -> DataFrame:
    """Percentile interval of the mean by resampling, each resample as large as its group.

    Counts of exact distinct values are dealt into buckets by hash, a power of two a group. A bucket's share of each
    resample comes from halving the resample down a tree of buckets by binomial draws, whose seeds are those of the
    tree's nodes, so each task finds its own share and all shares add up. The mean is that of the rows themselves."""
    import numpy as np
    import pandas as pd

    valid = rows.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    whole = valid.groupBy("g").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("v").alias("mean"))
    counts = valid.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    need = F.greatest(F.lit(0.0), F.ceil(F.log2(F.count(F.lit(1)) / BOOTSTRAP_BUCKET))).cast("int")
    depths = counts.groupBy(F.col("g").alias("dg")).agg(need.alias("depth"))
    placed = counts.join(depths, F.col("g").eqNullSafe(F.col("dg"))).drop("dg")
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("v"), F.pow(F.lit(2.0), F.col("depth")).cast("long")))

    # rows below each node on the way from the root to a bucket
    sizes = placed.groupBy("g", "depth", "bucket").agg(F.sum("c").alias("n"))
    steps = sizes.select("*", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("level"))
    steps = steps.withColumn("node", F.expr("shiftright(bucket, depth - level)"))
    nodes = steps.groupBy(F.col("g").alias("ng"), F.col("level").alias("nl"), F.col("node").alias("nn")).agg(F.sum("n").alias("below"))
    met = steps.join(nodes, F.col("g").eqNullSafe(F.col("ng")) & (F.col("level") == F.col("nl")) & (F.col("node") == F.col("nn")))
    paths = met.groupBy(F.col("g").alias("pg"), F.col("bucket").alias("pb")).agg(F.sort_array(F.collect_list(F.struct("level", "below"))).getField("below").alias("path"))
    dealt = placed.join(paths, F.col("g").eqNullSafe(F.col("pg")) & (F.col("bucket") == F.col("pb"))).drop("pg", "pb", "depth")

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("v")
        v, c, bucket, path = frame["v"].to_numpy(), frame["c"].to_numpy(), int(frame["bucket"].iloc[0]), frame["path"].iloc[0]
        depth, n = len(path) - 1, int(c.sum())
        taken = np.full(resamples, path[0], np.int64)
        for level in range(1, depth + 1):
            node = bucket >> (depth - level)
            left = path[level] if node % 2 == 0 else path[level - 1] - path[level]
            drawn = np.random.default_rng([seed, level, node >> 1]).binomial(taken, left / path[level - 1])
            taken = drawn if node % 2 == 0 else taken - drawn
        rng = np.random.default_rng([seed, depth + 1, bucket])
        if n <= 8 * len(v):
            each = np.repeat(v, c)
            sums = [each[rng.integers(0, n, m)].sum() for m in taken.tolist()]
        else:
            sums = [float(rng.multinomial(m, c / n) @ v) for m in taken.tolist()]
        return pd.DataFrame({"g": frame["g"].iloc[:1], "resample": [list(range(resamples))], "total": [sums]})

    kind = rows.schema[group].dataType.simpleString()
    sums = dealt.groupBy("g", "bucket").applyInPandas(draw, f"g {kind}, resample array<int>, total array<double>")
    sums = sums.select("g", F.inline(F.arrays_zip("resample", "total"))).groupBy("g", "resample").agg(F.sum("total").alias("total"))
    totals = sums.groupBy(F.col("g").alias("tg")).agg(F.sort_array(F.collect_list("total")).alias("totals"))
    alpha = (1 - share) / 2
    low, high = max(0, math.floor(alpha * resamples)), min(resamples - 1, math.ceil((1 - alpha) * resamples) - 1)
    at = {name: F.element_at("totals", place + 1) / F.col("n_rows") for name, place in (("low", low), ("high", high))}
    return whole.join(totals, F.col("g").eqNullSafe(F.col("tg"))).select(F.col("g").alias(group), "n_rows", "mean", at["low"].alias("low"), at["high"].alias("high"))


def scoped_means(rows: DataFrame, scopes: Sequence[str], values: Sequence[str]) -> DataFrame:
    """scope, value, n_rows and means: over all rows and by each scope on its own."""
    columns = [F.col(c) for c in scopes]
    sets = rows.groupingSets([[], *([c] for c in columns)], *columns)
    made = sets.agg(*(F.grouping(c).alias(f"no_{c}") for c in scopes), F.count(F.lit(1)).alias("n_rows"), *(F.round(F.avg(v), 6).alias(v) for v in values))
    scope, value = F.lit("all"), F.lit("all")
    for c in scopes:
        here = F.col(f"no_{c}") == 0
        scope, value = F.when(here, c).otherwise(scope), F.when(here, F.coalesce(F.col(c).cast("string"), F.lit("unknown"))).otherwise(value)
    return made.select(scope.alias("scope"), value.alias("value"), "n_rows", *values)


def latency_summary(rows: DataFrame, group: str, value: str, share: float = 0.95) -> DataFrame:
    """Mean, nearest-rank percentile and maximum of each group."""
    plain = rows.groupBy(group).agg(F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("most"))
    return plain.join(nearest_rank(rows, group, value, share), group).select(group, "n_rows", "mean", F.col("percentile").alias("p95"), "most")


def ratio_of_sums(rows: DataFrame, group: str, part: Column, whole: Column) -> DataFrame:
    """Sum of the parts over the sum of the wholes in each group; 1 where there is no whole."""
    sums = rows.groupBy(group).agg(F.sum(part).alias("part"), F.sum(whole).alias("whole"))
    return sums.select(group, "part", "whole", F.round(F.when(F.col("whole") > 0, F.col("part") / F.col("whole")).otherwise(1.0), 6).alias("ratio"))


def group_effect(rows: DataFrame, group: Column, value: str) -> DataFrame:
    """Difference of the means of the rows where ``group`` holds and the others, and the rank-biserial effect."""
    means = rows.filter(F.col(value).isNotNull()).agg(F.avg(F.when(group, F.col(value))).alias("x"), F.avg(F.when(~group, F.col(value))).alias("y"))
    return rank_biserial(rows, group, value).crossJoin(means).select("nx", "ny", F.round(F.col("x") - F.col("y"), 6).alias("mean_delta"), "effect")


def error_report(rows: DataFrame, case: str, mode: str, modes: Sequence[str], value: str, least: float, most: float) -> DataFrame:
    """winner, loser, n_wins, cases: for each ordered pair of modes the cases that the first wins, in order."""
    wide = rows.groupBy(case).pivot(mode, list(modes)).agg(F.round(F.avg(value), 6))
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("winner"), F.lit(b).alias("loser"), F.coalesce((F.col(f"`{a}`") >= least) & (F.col(f"`{b}`") <= most), F.lit(False)).alias("won")) for a in modes for b in modes if a != b)))
    won = wide.select(case, pairs.alias("p")).select(case, "p.*").filter("won")
    return won.groupBy("winner", "loser").agg(F.count(F.lit(1)).alias("n_wins"), F.array_sort(F.collect_list(case)).alias("cases"))
