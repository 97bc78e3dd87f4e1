"""Queries on advice payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import payload
from graphloom.plans.catalogue import GENERIC_SQL
from graphloom.plans.registry import query
from graphloom.sources.model import Model


@query(
    """WITH s AS (SELECT career_code, list_sort(list(DISTINCT item_name) FILTER (priority_group IN ('1-URGENT', '2-HIGH'))) AS must, list_sort(list(DISTINCT item_name) FILTER (priority_group NOT IN ('1-URGENT', '2-HIGH'))) AS may
                 FROM need JOIN competency USING (item_code) GROUP BY 1),
    c AS (SELECT career_code, career_name, career_code % 5 AS k, coalesce(must, []) AS must, coalesce(may, []) AS may, coalesce(url, '') AS url, GENERIC AS generic
          FROM career LEFT JOIN s USING (career_code) LEFT JOIN pages ON page_id = career_code),
    p AS (SELECT *, CASE k WHEN 0 THEN list_concat(must, may) WHEN 1 THEN must WHEN 2 THEN may ELSE [] END AS missing, CASE k WHEN 1 THEN may WHEN 2 THEN must ELSE [] END AS weak,
                 CASE WHEN k IN (1, 2) THEN list_concat(must, CASE WHEN k = 1 THEN [upper(career_name)] ELSE [] END) ELSE [] END AS titles FROM c)
    SELECT career_code, array_to_string(missing, '|') AS missing, array_to_string(weak, '|') AS weak, CASE WHEN k = 1 THEN 3 ELSE 0 END AS n_months, CASE WHEN k = 1 THEN '1|9|3' ELSE '' END AS months,
           CASE WHEN k = 1 THEN array_to_string(list_transform(list_filter(range(1, len(titles) + 1), lambda i: i % 3 = 1), lambda i: titles[i]), '|') ELSE '' END AS first_month,
           CASE WHEN k = 2 THEN array_to_string(titles, '|') WHEN k = 1 THEN array_to_string(list_concat(list_concat(list_transform(list_filter(range(1, len(titles) + 1), lambda i: i % 3 = 1), lambda i: titles[i]),
               list_transform(list_filter(range(1, len(titles) + 1), lambda i: i % 3 = 2), lambda i: titles[i])), list_transform(list_filter(range(1, len(titles) + 1), lambda i: i % 3 = 0), lambda i: titles[i])), '|') ELSE '' END AS recommended,
           CASE WHEN k IN (1, 2) AND NOT generic THEN CAST(len(titles) AS INT) ELSE 0 END AS n_urls, CASE k WHEN 0 THEN 6 WHEN 1 THEN career_code END AS estimated_months, CASE WHEN k = 2 THEN career_name ELSE '' END AS summary_vi FROM p""".replace("GENERIC", GENERIC_SQL.format(u="url")),
    model=True,
)
def advice_payloads(m: Model) -> DataFrame:
    """Payloads of five shapes, written as JSON text from the needs and pages of careers, in one form."""
    must = F.col("priority_group").isin("1-URGENT", "2-HIGH")
    skills = m.need.join(m.competency, "item_code").groupBy("career_code").agg(
        F.sort_array(F.collect_set(F.when(must, F.col("item_name")))).alias("must"), F.sort_array(F.collect_set(F.when(~must, F.col("item_name")))).alias("may")
    )
    none = F.array().cast("array<string>")
    rows = m.career.join(skills, "career_code", "left").join(m.table("pages").select(F.col("page_id").alias("career_code"), "url"), "career_code", "left")
    rows = rows.withColumns({"must": F.coalesce("must", none), "may": F.coalesce("may", none), "url": F.coalesce("url", F.lit(""))})
    k = F.col("career_code") % 5

    def listed(names, title):
        return F.transform(names, lambda n: F.struct(n.alias(title), F.lit(" ").alias("platform"), F.col("url").alias("url")))

    shapes = [
        F.to_json(F.struct(F.concat("must", "may").alias("skills_gap"), F.lit("6").alias("estimated_months"))),
        F.concat(
            F.lit('{"roadmap": [{"milestone": null}, {"month": " 9", "courses": "no"}, {"month": "x", "topics": 1}], '),
            F.substring(F.to_json(F.struct(F.struct(F.col("must").alias("mandatory"), F.col("may").alias("optional")).alias("skills_gap"), listed(F.concat("must", F.array(F.upper("career_name"))), "course_name").alias("recommended_courses"), F.col("career_code").alias("estimated_months"))), 2, 1 << 30),
        ),
        F.to_json(F.struct(F.struct(F.col("may").alias("missing"), F.col("must").alias("weak")).alias("skills_gap"), listed(F.col("must"), "name").alias("recommended_courses"), F.concat(F.lit(" "), "career_name").alias("summary_vi"))),
        F.concat(F.lit("no JSON: "), "career_name"),
    ]
    body = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        body = F.when(k == i, shape).otherwise(body)
    found = payload.normalised(rows.select("career_code", body.alias("body")), "body")
    months = F.transform("roadmap", lambda x: x["month"].cast("string"))
    first = F.transform(F.coalesce(F.get(F.col("roadmap"), F.lit(0))["courses"], F.array().cast(f"array<{payload.COURSE}>")), lambda c: c["title"])
    titles = F.transform("recommended_courses", lambda c: c["title"])
    return found.select(
        "career_code", F.array_join("skills_gap.missing", "|").alias("missing"), F.array_join("skills_gap.weak", "|").alias("weak"), F.size("roadmap").alias("n_months"), F.array_join(months, "|").alias("months"), F.array_join(first, "|").alias("first_month"),
        F.array_join(titles, "|").alias("recommended"), F.size(F.filter("recommended_courses", lambda c: c["url"].isNotNull())).alias("n_urls"), "estimated_months", "summary_vi",
    )
