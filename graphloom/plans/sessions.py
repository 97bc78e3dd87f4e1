"""Queries on sessions as dialogues. Commands and enumerations stand in for some of the texts, by conversation and turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import dialogue
from graphloom.plans.registry import query
from graphloom.sources.model import TYPE_CODES, Model

#: What users say in place of their texts, by (conv_id * 5 + turn * 3) % 16; others keep their text.
SAID = {0: "không", 1: "Xem tổng kết nhé", 2: "gợi ý khóa học", 3: "hot gear, Small Ring; go", 4: "bỏ qua tất cả", 5: "", 6: "lộ trình SQL", 7: "none", 8: "thế còn Docker ?", 9: "old bolt", 10: "khóa Python nào"}
#: What the router made of them, by (conv_id + turn) % 6; others are for the dialogue.
ROUTED = {0: "slot_fill", 1: "course_rec", 2: "competency_relation"}


def dialogue_messages(m: Model) -> DataFrame:
    """User turns with intent, has_career, profiled and the types that the career of the session needs."""
    said = F.element_at(F.create_map(*(F.lit(x) for pair in SAID.items() for x in pair)), ((F.col("conv_id") * 5 + F.col("turn") * 3) % 16).cast("int"))
    routed = F.element_at(F.create_map(*(F.lit(x) for pair in ROUTED.items() for x in pair)), ((F.col("conv_id") + F.col("turn")) % 6).cast("int"))
    turns = m.table("conversations").filter("role = 'user'").select("conv_id", "turn", F.coalesce(said, "text").alias("text"), F.coalesce(routed, F.lit("competency_slot_fill")).alias("intent"))
    careers = m.career.select(F.col("career_code").alias("conv_id"), F.lit(True).alias("known_career"))
    # a session of every 17th conversation has no career; every second one has a profile
    typed = dialogue.typed_needs(m.need, m.competency).withColumnRenamed("career_code", "conv_id")
    joined = turns.join(careers, "conv_id", "left").join(typed, "conv_id", "left")
    return joined.select("conv_id", "turn", "text", "intent", (F.col("known_career").isNotNull() & (F.col("conv_id") % 17 != 0)).alias("has_career"), (F.col("conv_id") % 2 == 0).alias("profiled"), "needed")


def skill_names(m: Model) -> dict[str, str]:
    """The catalogue of skills by name in lower case; one alias besides."""
    names = {r.item_name.lower(): r.item_name for r in m.competency.select("item_name").distinct().collect()}
    return {**names, "go": "go language"}


_CASES = {name: " ".join(f"WHEN {k} THEN '{v}'" for k, v in table.items()) for name, table in (("said", SAID), ("routed", ROUTED))}
_TYPES = ", ".join(f"'{t}'" for t in TYPE_CODES)


def _has(text: str, pattern: str) -> str:
    # no text of this query has letters with marks beside a word's end
    return f"regexp_matches({text}, '(?i){pattern}')"


_NEXT = "list_first(list_filter(range(m.from_here, 8), lambda i: i = 7 OR list_contains(m.needed, [{types}][i + 1])))".replace("{types}", _TYPES)

#: One step of the recursion is one message: the route from the state before it, then what the collection does.
DIALOGUE_SQL = rf"""
said AS (
    SELECT conv_id, turn, coalesce(CASE (conv_id * 5 + turn * 3) % 16 {_CASES['said']} END, text) AS raw, coalesce(CASE (conv_id + turn) % 6 {_CASES['routed']} END, 'competency_slot_fill') AS intent
    FROM conversations WHERE role = 'user'),
typed AS (SELECT career_code, list(DISTINCT type_code) AS needed FROM need JOIN competency USING (item_code) WHERE type_code IS NOT NULL GROUP BY 1),
texts AS (SELECT *, trim(coalesce(raw, '')) AS t, strip_accents(replace(replace(trim(coalesce(raw, '')), 'đ', 'd'), 'Đ', 'D')) AS p FROM said),
names AS (SELECT list(DISTINCT item_name) AS all_names FROM competency),
found AS (
    SELECT *, list_sort(list_distinct(list_concat(list_filter(all_names, lambda n: contains(lower(t), n)), CASE WHEN regexp_matches(lower(t), '(^|[^a-z0-9])go($|[^a-z0-9])') THEN ['go language'] ELSE [] END))) AS names,
           list_transform(regexp_split_to_array(t, '{dialogue.LIST_SIGNS}'), lambda x: trim(x)) AS parts, nullif(regexp_extract(t, '(?i){dialogue.HINT}', 1), '') AS hint
    FROM texts CROSS JOIN names),
signs AS (
    SELECT conv_id, turn, intent, t = '' AS empty, {_has('p', dialogue.EXIT)} AS exits, {_has('p', dialogue.QUESTION)} AS asks, {_has('t', dialogue.SKIP)} AS skips, {_has('t', dialogue.COURSES)} AS courses,
           {_has('t', dialogue.COURSE_FOLLOW_UP)} AS follows, {_has('t', dialogue.COURSE_FOLLOW_UP)} AND hint IS NULL AND len(names) = 0 AS bulk,
           {_has('t', dialogue.ROADMAP)} AND NOT (hint IS NOT NULL AND {_has('t', dialogue.SINGLE_COURSE)}) AS roadmap, hint,
           CASE WHEN t = '' OR {_has('p', dialogue.COURSE_PIVOT)} OR (length(t) > 80 AND NOT {_has('t', dialogue.RELATION_FOLLOW_UP)}) THEN NULL
                ELSE coalesce(hint, names[1], CASE WHEN {_has('t', dialogue.RELATION_FOLLOW_UP)} OR len(regexp_split_to_array(t, '\s+')) <= 4
                    THEN nullif(trim(regexp_replace(regexp_replace(t, '(?i){dialogue.RELATION_FOLLOW_UP}', ''), '^[ ?.]+|[ ?.]+$', '', 'g')), '') END) END AS relation,
           CASE WHEN len(names) > 0 THEN names WHEN NOT regexp_matches(t, '{dialogue.LIST_SIGNS}') THEN []
                ELSE list_distinct(list_filter(parts, lambda x: length(x) BETWEEN 2 AND 30 AND NOT {_has('x', dialogue.SKIP)} AND NOT {_has('strip_accents(x)', dialogue.QUESTION)} AND length(x) - length(replace(x, ' ', '')) < 4)) END AS skills
    FROM found),
numbered AS (
    SELECT s.*, career_code IS NOT NULL AND conv_id % 17 <> 0 AS has_career, conv_id % 2 = 0 AS profiled, coalesce(needed, []) AS needed, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n
    FROM signs s LEFT JOIN career ON career_code = conv_id LEFT JOIN typed USING (career_code)),
steps AS (
    SELECT conv_id, NULL::BIGINT AS turn, 0::BIGINT AS n, NULL::VARCHAR AS route, NULL::VARCHAR AS action, 'idle' AS phase, 0::BIGINT AS idx, [[], [], [], [], [], [], [], []]::VARCHAR[][] AS known FROM (SELECT DISTINCT conv_id FROM numbered)
    UNION ALL
    SELECT conv_id, turn, n, route, action, CASE WHEN action = 'courses' THEN 'course' ELSE phase END, idx, known FROM (
        SELECT conv_id, turn, n, route, phase, idx, known,
               CASE WHEN NOT here THEN 'none' WHEN phase = 'gap_summary' THEN CASE WHEN courses THEN 'courses' ELSE 'summary' END
                    WHEN phase = 'course' THEN CASE WHEN courses THEN 'courses' ELSE 'none' END
                    WHEN empty OR moves THEN 'prompt' WHEN asks AND NOT skips THEN 'none' ELSE 'unrecognised' END AS action
        FROM (
            SELECT * EXCLUDE (phase, idx), CASE WHEN open AND moves THEN {_NEXT.replace('m.from_here', 'idx + 1').replace('m.', '')} ELSE idx END AS idx,
                   CASE WHEN open AND ((moves AND {_NEXT.replace('m.from_here', 'idx + 1').replace('m.', '')} = 7) OR idx = 7) THEN 'gap_summary' ELSE phase END AS phase
            FROM (
                SELECT * EXCLUDE (known), open AND idx < 7 AND NOT empty AND (skips OR (NOT asks AND len(skills) > 0)) AS moves,
                       CASE WHEN open AND idx < 7 AND NOT empty AND NOT skips AND NOT asks AND len(skills) > 0
                            THEN list_transform(known, lambda x, i: CASE WHEN i = idx + 1 THEN list_concat(x, skills) ELSE x END) ELSE known END AS known
                FROM (
                    SELECT * EXCLUDE (idx, phase), CASE WHEN open THEN {_NEXT.replace('m.from_here', 'idx').replace('m.', '')} ELSE idx END AS idx, CASE WHEN open THEN 'collecting' ELSE phase END AS phase
                    FROM (
                        SELECT * EXCLUDE (phase), CASE WHEN here AND exits AND NOT empty THEN 'gap_summary' ELSE phase END AS phase, here AND NOT (exits AND NOT empty) AND phase IN ('idle', 'collecting') AS open
                        FROM (SELECT *, route = 'competency_slot_fill' AND has_career AS here FROM (
                            SELECT m.*, s.phase, s.idx, s.known,
                                   CASE WHEN s.route = 'competency_relation' AND relation IS NOT NULL THEN 'competency_relation'
                                        WHEN s.phase = 'collecting' AND has_career AND exits THEN 'competency_slot_fill'
                                        WHEN s.phase = 'collecting' AND has_career AND (s.idx > 0 OR len(flatten(s.known)) > 0) AND intent IN ('slot_fill', 'competency_slot_fill') AND NOT asks THEN 'competency_slot_fill'
                                        WHEN profiled AND roadmap THEN 'roadmap_followup'
                                        WHEN has_career AND s.phase IN ('gap_summary', 'course') AND bulk THEN 'competency_slot_fill'
                                        WHEN has_career AND follows AND (s.phase IN ('gap_summary', 'course') OR s.route IN ('pathfinding', 'competency_slot_fill')) AND hint IS NOT NULL THEN 'course_rec'
                                        ELSE intent END AS route
                            FROM steps s JOIN numbered m ON s.conv_id = m.conv_id AND m.n = s.n + 1)))))))
)"""


@query(
    f"""WITH RECURSIVE {DIALOGUE_SQL}
    SELECT conv_id, turn, route, action <> 'none' AS handled, action, phase, CASE WHEN phase = 'collecting' AND idx < 7 THEN [{_TYPES}][idx + 1] END AS type_code,
           list_sum(list_transform(known, lambda x: len(list_distinct(list_transform(x, lambda y: lower(y)))))) AS n_known, least(n, {dialogue.WINDOW}) AS n_window
    FROM steps WHERE n > 0""",
    model=True,
)
def session_dialogue(m: Model) -> DataFrame:
    """Replay of all sessions: route, action and state after each message of a user."""
    return dialogue.replayed(dialogue.with_signs(dialogue_messages(m), skill_names(m)))
