"""Queries of paired tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import significance
from graphloom.plans.registry import query
from graphloom.sources.model import Model


@query(
    """WITH RECURSIVE w AS (
        SELECT event_type || ':' || user_id % 5 AS grp, avg(value) FILTER (event_id % 2 = 0) AS a, avg(value) FILTER (event_id % 2 = 1) AS b, event_type FROM events GROUP BY user_id, event_type),
    pairs AS (SELECT grp, CASE WHEN event_type = 'view' THEN round(a / 10) ELSE a END AS x, CASE WHEN event_type = 'view' THEN round(b / 10) ELSE b END AS y FROM w),
    d AS (SELECT grp, x - y AS d FROM pairs WHERE x - y IS NOT NULL),
    sums AS (SELECT grp, count(*) AS n, avg(d) AS m, CASE WHEN count(*) > 1 AND stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END AS t, count(*) - 1 AS df, count(*) FILTER (d = 0) AS equal FROM d GROUP BY 1),
    tails AS (SELECT *, atan(abs(t) / sqrt(df)) AS a FROM sums),
    tested AS (SELECT *, CASE WHEN t IS NOT NULL THEN 1 - CASE WHEN df % 2 = 1
            THEN 2 / pi() * (a + sin(a) * coalesce(list_sum(list_transform(range(0, (df - 1) // 2), lambda j: exp(lgamma(j + 1.0) + lgamma(1.5) - lgamma(j + 1.5)) * pow(cos(a), 2 * j + 1))), 0))
            ELSE sin(a) * list_sum(list_transform(range(0, df // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1.0)) * pow(cos(a), 2 * j))) END END AS t_p FROM tails),
    ranked AS (SELECT grp, d, rank() OVER (PARTITION BY grp ORDER BY abs(d)) + (count(*) OVER (PARTITION BY grp, abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY grp, abs(d)) AS c FROM d WHERE d <> 0),
    ranks AS (SELECT grp, count(*) AS k, coalesce(sum(r) FILTER (d > 0), 0) AS up, coalesce(sum(r) FILTER (d < 0), 0) AS down, sum(c * c - 1) AS ties FROM ranked GROUP BY 1),
    ways AS (SELECT 0 AS k, list_transform(range(0, 1276), lambda s: CASE WHEN s = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS f
             UNION ALL SELECT k + 1, list_transform(range(0, 1276), lambda s: f[s + 1] + CASE WHEN s > k THEN f[s - k] ELSE 0 END) FROM ways WHERE k < 50),
    signed AS (SELECT grp, least(up, down) AS w, CASE WHEN k <= 50 AND ties = 0 AND equal = 0 THEN least(1, 2 * list_sum(f[1:least(up, down)::BIGINT + 1]) / pow(2, k))
                      ELSE 1 - 2 / sqrt(pi()) * coalesce(list_sum(list_transform(range(0, 120), lambda j: pow(-1, j) * exp((2 * j + 1) * ln(z) - lgamma(j + 1.0)) / (2 * j + 1))), 0) END AS w_p
               FROM (SELECT *, abs(least(up, down) - k * (k + 1) / 4) / sqrt(k * (k + 1) * (2 * k + 1) / 24 - ties / 48) / sqrt(2) AS z FROM ranks JOIN sums USING (grp)) LEFT JOIN ways USING (k))
    SELECT grp, n AS n_pairs, round(m, 6) AS mean_delta, round(t, 4) AS t, round(t_p, 6) AS t_p, coalesce(t_p < 0.05, false) AS significant,
           CASE WHEN n > 1 THEN round(w, 4) END AS w, CASE WHEN n > 1 THEN round(w_p, 6) END AS w_p
    FROM tested LEFT JOIN signed USING (grp)"""
)
def paired_significance(m: Model) -> DataFrame:
    """The two halves of the events of each user, by type and a fifth of the users; views are rounded, so that they tie."""
    half = F.pmod("event_id", F.lit(2))
    means = m.table("events").groupBy("user_id", "event_type").agg(F.avg(F.when(half == 0, F.col("value"))).alias("a"), F.avg(F.when(half == 1, F.col("value"))).alias("b"))
    rounded = {x: F.when(F.col("event_type") == "view", F.round(F.col(c) / 10)).otherwise(F.col(c)) for x, c in (("x", "a"), ("y", "b"))}
    pairs = means.select(F.concat_ws(":", "event_type", F.col("user_id") % 5).alias("grp"), *(c.alias(x) for x, c in rounded.items()))
    return significance.paired_tests(pairs, "grp", "x", "y")
