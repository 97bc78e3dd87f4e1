"""Queries on the quality of answers. A case is a career that someone is on the way to; its answer is made of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import quality
from graphloom.plans.registry import query
from graphloom.sources.model import Model

CASES_SQL = """gold AS (SELECT career_code AS case_id, list_sort(list(DISTINCT item_name)) AS gold, list_sort(list(DISTINCT item_name) FILTER (priority_group < '3')) AS graph_context,
                    list_sort(list(DISTINCT item_name) FILTER (kind IN ('PROMO', 'SMALL'))) AS vector_context, list_sort(list(DISTINCT item_name) FILTER (kind <> 'LARGE')) AS gold_answer
             FROM need JOIN competency USING (item_code) GROUP BY 1),
    pred AS (SELECT career_code AS case_id, list_sort(list(DISTINCT item_name)) AS predicted FROM known JOIN competency USING (item_code) GROUP BY 1),
    joined AS (SELECT case_id, ['pathfinding', 'course_rec', 'skills_gap'][case_id % 3 + 1] AS intent, ['vector_only', 'graph_only', 'late', 'tight'][case_id % 4 + 1] AS mode,
                      gold, coalesce(graph_context, []) AS graph_context, coalesce(vector_context, []) AS vector_context, coalesce(gold_answer, []) AS gold_answer,
                      CASE WHEN case_id % 7 = 0 THEN [] ELSE predicted END AS predicted FROM gold JOIN pred USING (case_id)),
    cases AS (SELECT *, CASE case_id % 5 WHEN 0 THEN 'Nothing to say' WHEN 1 THEN 'You know ' || coalesce(array_to_string(predicted[1:2], ' and '), '') || '. Learn ' || upper(array_to_string(gold[-2:], ' and ')) || '!'
                             WHEN 2 THEN 'See [Course: X' || case_id || '] for ' || gold[1] || '. Then ' || gold[-1] || ' or [Course: y].' WHEN 3 THEN '' ELSE array_to_string(gold, ', ') END AS reply FROM joined),
    vocabulary AS (SELECT *, list_distinct(list_concat(graph_context, vector_context)) AS full_context, list_distinct(list_concat(graph_context, vector_context, predicted, gold)) AS vocab FROM cases),
    marked AS (SELECT *, CASE WHEN reply = '' THEN [] ELSE list_distinct(list_concat(list_filter(vocab, lambda v: length(v) >= 2 AND contains(lower(trim(reply)), v)),
                   list_transform(regexp_extract_all(reply, '(?i)\\[Course:\\s*([^\\]]+)\\]', 1), lambda c: lower(trim(c))))) END AS found FROM vocabulary),
    scored AS (SELECT *, CASE WHEN len(found) > 0 THEN found ELSE predicted END AS m FROM marked)"""


def cases(m: Model) -> DataFrame:
    def names(condition: Column | None = None) -> Column:
        return F.array_sort(F.collect_set(F.col("item_name") if condition is None else F.when(condition, F.col("item_name"))))

    need = m.need.join(m.competency, "item_code").groupBy(F.col("career_code").alias("case_id"))
    gold = need.agg(
        names().alias("gold"), names(F.col("priority_group") < "3").alias("graph_context"), names(F.col("kind").isin("PROMO", "SMALL")).alias("vector_context"), names(F.col("kind") != "LARGE").alias("gold_answer")
    )
    pred = m.known.join(m.competency, "item_code").groupBy(F.col("career_code").alias("case_id")).agg(names().alias("predicted"))
    case = F.col("case_id")
    intents, modes = (F.array(*(F.lit(x) for x in xs)) for xs in (("pathfinding", "course_rec", "skills_gap"), ("vector_only", "graph_only", "late", "tight")))
    rows = gold.join(pred, "case_id").withColumns(
        {
            "intent": F.get(intents, (case % 3).cast("int")),
            "mode": F.get(modes, (case % 4).cast("int")),
            "predicted": F.when(case % 7 == 0, F.array().cast("array<string>")).otherwise(F.col("predicted")),
        }
    )
    two = F.array_join(F.slice("predicted", 1, 2), " and ")
    last = F.array_join(F.slice("gold", F.greatest(F.size("gold") - 1, F.lit(1)), F.lit(2)), " and ")
    reply = (
        F.when(case % 5 == 0, "Nothing to say")
        .when(case % 5 == 1, F.concat(F.lit("You know "), two, F.lit(". Learn "), F.upper(last), F.lit("!")))
        .when(case % 5 == 2, F.concat(F.lit("See [Course: X"), case, F.lit("] for "), F.element_at("gold", 1), F.lit(". Then "), F.element_at("gold", -1), F.lit(" or [Course: y].")))
        .when(case % 5 == 3, "")
        .otherwise(F.array_join("gold", ", "))
    )
    return rows.withColumn("reply", reply)


F1_SQL = "CASE WHEN len({p}) = 0 AND len({g}) = 0 THEN 1.0 WHEN len({p}) = 0 OR len({g}) = 0 THEN 0.0 ELSE 2 * len(list_intersect({p}, {g})) / (len({p}) + len({g})) END"
RATE_SQL = "CASE WHEN len(m) > 0 THEN len(list_intersect(m, {a})) / len(m) END"
ONLY_SQL = "CASE WHEN len(m) > 0 THEN len(list_filter(m, lambda x: list_contains({a}, x) AND NOT list_contains({b}, x))) / len(m) END"


@query(
    f"""WITH {CASES_SQL}
    SELECT case_id, round(CASE WHEN len(m) > 0 THEN len(list_intersect(m, full_context)) / len(m) WHEN length(trim(reply)) >= 8 THEN 1.0 ELSE 0.0 END, 6) AS faithfulness,
           round({F1_SQL.format(p="predicted", g="gold")}, 6) AS skill_accuracy,
           round(CASE WHEN len(m) > 0 THEN (len(m) - len(list_intersect(m, full_context))) / len(m) ELSE 0.0 END, 6) AS hallucination_rate,
           len(m) AS n_mentions, len(m) - len(list_intersect(m, full_context)) AS n_hallucinated, len(m) = 0 AS no_mention_case FROM scored""",
    model=True,
)
def quality_v1(m: Model) -> DataFrame:
    return quality.scores_v1(cases(m), ["case_id"], empty_reply_penalty=True)


#: Sentences that make a claim: two mentions or more of what the graph holds.
CLAIM_SQL = """sentences AS (SELECT case_id, graph_context, unnest(list_filter(list_transform(string_split_regex(reply, '[.!?\\n]+'), lambda x: trim(x)), lambda x: x <> '')) AS s FROM cases WHERE len(graph_context) > 0),
    claimed AS (SELECT case_id, graph_context, list_distinct(list_concat(list_filter(graph_context, lambda v: length(v) >= 2 AND contains(lower(s), v)),
                    list_transform(regexp_extract_all(s, '(?i)\\[Course:\\s*([^\\]]+)\\]', 1), lambda c: lower(trim(c))))) AS c FROM sentences),
    claims AS (SELECT case_id, avg(CASE WHEN len(list_filter(c, lambda x: NOT list_contains(graph_context, x))) = 0 THEN 1.0 ELSE 0.0 END) AS claim_grounding_rate FROM claimed WHERE len(c) >= 2 GROUP BY 1)"""

V2_SQL = f"""{CASES_SQL}, {CLAIM_SQL},
    v2 AS (SELECT case_id, intent, mode, round({F1_SQL.format(p="predicted", g="gold")}, 6) AS ontology_f1, round({F1_SQL.format(p="m", g="gold")}, 6) AS answer_entity_f1,
           round({RATE_SQL.format(a="full_context")}, 6) AS full_grounding_rate, round({RATE_SQL.format(a="graph_context")}, 6) AS graph_grounding_rate,
           round({ONLY_SQL.format(a="graph_context", b="vector_context")}, 6) AS exclusive_graph_rate, round({ONLY_SQL.format(a="vector_context", b="graph_context")}, 6) AS vector_only_rate,
           round(CASE WHEN len(m) > 0 THEN 1 - len(list_intersect(m, graph_context)) / len(m) ELSE 0.0 END, 6) AS hallucination_rate,
           round(len(list_intersect(predicted, gold)) / len(gold), 6) AS code_recall, round(claim_grounding_rate, 6) AS claim_grounding_rate, len(m) AS n_mentions
           FROM scored LEFT JOIN claims USING (case_id))"""


@query(f"WITH {V2_SQL} SELECT * EXCLUDE (intent, mode) FROM v2", model=True)
def quality_v2(m: Model) -> DataFrame:
    return quality.scores_v2(cases(m), ["case_id"])


@query(
    f"""WITH {V2_SQL}
    SELECT CASE WHEN grouping(intent) = 1 THEN 'all' ELSE intent END AS intent, CASE WHEN grouping(mode) = 1 THEN 'all' ELSE mode END AS mode, count(*) AS n_cases,
           {", ".join(f"coalesce(round(avg({s}), 4), 0.0) AS {s}" for s in quality.V2_SCORES)}
    FROM v2 GROUP BY GROUPING SETS ((), (intent), (intent, mode))""",
    model=True,
)
def quality_by_intent_and_mode(m: Model) -> DataFrame:
    return quality.roll_up(quality.scores_v2(cases(m), ["case_id", "intent", "mode"]), ["intent", "mode"], quality.V2_SCORES)


@query(
    f"""WITH {V2_SQL}
    SELECT * FROM (SELECT case_id, concat_ws(',', CASE WHEN ontology_f1 < 0.35 THEN 'low_skill_f1' END, CASE WHEN hallucination_rate > 0.15 OR coalesce(graph_grounding_rate, 1) < 0.6 THEN 'off_graph' END,
                   CASE WHEN n_mentions = 0 THEN 'no_mention' END) AS tags FROM v2) WHERE tags <> ''""",
    model=True,
)
def answer_error_tags(m: Model) -> DataFrame:
    return quality.error_tags(quality.scores_v2(cases(m), ["case_id"]), ["case_id"])


LAYER_SQL = f"""{CASES_SQL},
    wide AS (SELECT *, list_distinct(list_concat(vocab, gold_answer)) AS vocab2 FROM vocabulary),
    said AS (SELECT *, CASE WHEN reply = '' THEN [] ELSE list_distinct(list_concat(list_filter(vocab2, lambda v: length(v) >= 2 AND contains(lower(trim(reply)), v)),
                   list_transform(regexp_extract_all(reply, '(?i)\\[Course:\\s*([^\\]]+)\\]', 1), lambda c: lower(trim(c))))) END AS found FROM wide),
    meant AS (SELECT *, CASE WHEN len(found) > 0 THEN found ELSE predicted END AS m FROM said),
    layers AS (SELECT case_id, intent, mode, round(len(list_intersect(predicted, gold)) / len(gold), 6) AS retrieval_recall,
           CASE WHEN len(list_intersect(predicted, gold)) > 0 THEN 1.0 ELSE 0.0 END AS retrieval_hit, round({F1_SQL.format(p="m", g="gold_answer")}, 6) AS answer_f1,
           round(CASE WHEN mode <> 'vector_only' THEN {RATE_SQL.format(a="graph_context")} END, 6) AS graph_grounding_rate,
           round(CASE WHEN mode <> 'vector_only' THEN coalesce(1 - {RATE_SQL.format(a="graph_context")}, 0.0) END, 6) AS off_graph_rate,
           round(CASE WHEN mode <> 'graph_only' THEN {ONLY_SQL.format(a="vector_context", b="graph_context")} END, 6) AS vector_only_rate FROM meant)"""


@query(f"WITH {LAYER_SQL} SELECT * FROM layers", model=True)
def quality_layers(m: Model) -> DataFrame:
    return quality.layer_scores(cases(m), ["case_id", "intent", "mode"])


@query(
    f"""WITH {LAYER_SQL}
    SELECT CASE WHEN grouping(mode) = 1 THEN 'all' ELSE mode END AS mode, CASE WHEN grouping(intent) = 1 THEN 'all' ELSE intent END AS intent, count(*) AS n_cases,
           {", ".join(f"round(avg({s}), 4) AS {s}" for s in quality.LAYER_SCORES)}
    FROM layers GROUP BY GROUPING SETS ((), (mode), (mode, intent))""",
    model=True,
)
def quality_layer_summary(m: Model) -> DataFrame:
    scored = quality.layer_scores(cases(m), ["case_id", "intent", "mode"])
    return quality.roll_up(scored, ["mode", "intent"], quality.LAYER_SCORES, empty=None)


@query(
    """WITH rows_ AS (SELECT k.career_code, 'known' AS bucket, item_name AS name FROM known k JOIN competency USING (item_code)
        UNION ALL SELECT career_code, CASE WHEN priority_group < '4' THEN 'missing' ELSE 'weak' END, item_name FROM need JOIN competency USING (item_code)
            WHERE career_code IN (SELECT career_code FROM known JOIN competency USING (item_code))),
    b AS (SELECT career_code, coalesce(list_sort(list(DISTINCT name) FILTER (bucket = 'known')), []) AS known, coalesce(list_sort(list(DISTINCT name) FILTER (bucket = 'missing')), []) AS missing,
                 coalesce(list_sort(list(DISTINCT name) FILTER (bucket = 'weak')), []) AS weak FROM rows_ GROUP BY 1)
    SELECT career_code, array_to_string(known, ';') AS known, array_to_string(list_filter(missing, lambda x: NOT list_contains(known, x)), ';') AS missing,
           array_to_string(list_filter(weak, lambda x: NOT list_contains(known, x) AND NOT list_contains(missing, x)), ';') AS weak FROM b""",
    model=True,
)
def gap_label_buckets(m: Model) -> DataFrame:
    names = m.competency.select("item_code", F.col("item_name").alias("name"))
    known = m.known.join(names, "item_code").select("career_code", F.lit("known").alias("bucket"), "name")
    mine = m.need.join(known.select("career_code").distinct(), "career_code", "left_semi").join(names, "item_code")
    rows = known.unionByName(mine.select("career_code", F.when(F.col("priority_group") < "4", "missing").otherwise("weak").alias("bucket"), "name"))
    made = quality.gap_buckets(rows, "career_code")
    return made.select("career_code", *(F.array_join(c, ";").alias(c) for c in ("known", "missing", "weak")))


@query(
    r"""WITH w AS (SELECT item_id, list_distinct(list_filter(list_transform(list_concat(['B' || item_id], list_filter(regexp_extract_all(text, '[\p{L}\p{N}_#+.]+'), lambda x: length(x) >= 3)), lambda x: lower(trim(x))), lambda x: x <> '')) AS e FROM benchmark)
    SELECT item_id, len(e) AS n_entities, sha256(array_to_string(list_sort(e), ' ')) AS entities_sha256 FROM w"""
)
def text_entities(m: Model) -> DataFrame:
    docs = m.table("benchmark").withColumn("title", F.concat(F.lit("B"), "item_id"))
    made = quality.document_entities(docs, "item_id", ["title"], "text")
    return made.select("item_id", F.size("entities").alias("n_entities"), F.sha2(F.array_join("entities", " "), 256).alias("entities_sha256"))
