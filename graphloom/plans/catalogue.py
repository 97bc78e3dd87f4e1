"""Queries on the graph, sessions, retrieval, metrics, datasets and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import datasets, graph, metrics, retrieval, sessions
from graphloom.plans.registry import query
from graphloom.sources.model import KINDS, PRIORITY, Model

def _case(column: str, order: dict[str, int], other: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in order.items()) + f" ELSE {other} END"


PRIORITY_SQL = _case("priority_group", PRIORITY, 999)
KIND_SQL = _case("kind", {k: i for i, k in enumerate(KINDS)}, 99)

# graph patterns


@query(
    f"""WITH ranked AS (
        SELECT *, row_number() OVER (PARTITION BY career_code ORDER BY is_seed DESC, {PRIORITY_SQL}, {KIND_SQL}, item_name NULLS LAST, item_code) AS rank
        FROM (SELECT *, item_code IN (SELECT item_code FROM seed_item) AS is_seed FROM need JOIN competency USING (item_code)))
    SELECT c.career_code, career_name, industry, rank, item_code, item_name, kind, priority_group, coalesce(is_seed, false) AS is_seed
    FROM career c LEFT JOIN ranked r ON r.career_code = c.career_code AND rank <= 5""",
    model=True,
)
def pathfinding_topk(m: Model) -> DataFrame:
    return graph.pathfinding(m.career, m.need, m.competency, 5, seeds=m.seed_item)


@query(
    f"""WITH ranked AS (
        SELECT *, row_number() OVER (PARTITION BY career_code, kind ORDER BY {PRIORITY_SQL}, {KIND_SQL}, item_name NULLS LAST, item_code) AS rank
        FROM need JOIN competency USING (item_code))
    SELECT c.career_code, career_name, industry, rank, item_code, item_name, kind, priority_group, false AS is_seed
    FROM career c LEFT JOIN ranked r ON r.career_code = c.career_code AND rank <= 2""",
    model=True,
)
def pathfinding_by_type(m: Model) -> DataFrame:
    return graph.pathfinding(m.career, m.need, m.competency, 2, per_kind=True)


#: Whether a URL names no single page; ``u`` is its column.
GENERIC_SQL = r"""list_transform([string_split(regexp_replace(CASE WHEN contains(trim(coalesce({u}, '')), '://') THEN trim({u}) ELSE 'https://' || trim(coalesce({u}, '')) END, '[?#].*$', ''), '://')[2]],
    lambda x: trim(coalesce({u}, '')) = '' OR string_split(x, '/')[1] = '' OR len(list_filter(string_split(x, '/')[2:], lambda s: s <> '')) = 0
        OR (len(list_filter(string_split(x, '/')[2:], lambda s: s <> '')) = 1
            AND lower(list_filter(string_split(x, '/')[2:], lambda s: s <> '')[1]) IN ('courses', 'course', 'learn', 'browse', 'catalog', 'training', 'certification', 'certifications'))
        OR (len(list_filter(string_split(x, '/')[2:], lambda s: s <> '')) = 2 AND lower(list_filter(string_split(x, '/')[2:], lambda s: s <> '')[1]) IN ('en-us', 'en', 'vi', 'vi-vn')
            AND lower(list_filter(string_split(x, '/')[2:], lambda s: s <> '')[2]) IN ('courses', 'course', 'learn', 'browse', 'catalog', 'training', 'certification', 'certifications')))[1]"""

TOP_COURSES_SQL = """marked_course AS (SELECT *, GENERIC AS generic, course_code IN (SELECT course_code FROM seed_course) AS is_seed FROM course),
    top_courses AS (
    SELECT * FROM (SELECT item_code, row_number() OVER (PARTITION BY item_code ORDER BY generic, coverage_level DESC, is_seed DESC, coalesce(course_name, ''), course_code) AS rank,
                          course_code, course_name, organization, level, coverage_level, is_seed
                   FROM teach JOIN marked_course USING (course_code)) WHERE rank <= {k})""".replace("GENERIC", GENERIC_SQL.format(u="url"))


@query(f"WITH {TOP_COURSES_SQL.format(k=3)} SELECT * FROM top_courses", model=True)
def course_rec(m: Model) -> DataFrame:
    return graph.top_courses(m.teach, m.course, 3, m.seed_course)


@query(
    """WITH good AS (SELECT * FROM teach WHERE coverage_level >= 49),
    bare AS (SELECT item_code FROM competency WHERE item_code NOT IN (SELECT item_code FROM good)),
    rows_ AS (SELECT b.item_code, r.dst AS via_code, course_code, course_name, coverage_level
              FROM bare b JOIN relation r ON r.src = b.item_code AND rel_type = 'BUILT_ON' JOIN good g ON g.item_code = r.dst JOIN course USING (course_code))
    SELECT item_code, rank, via_code, course_code, course_name, coverage_level FROM (
        SELECT *, row_number() OVER (PARTITION BY item_code ORDER BY coverage_level DESC, course_name, course_code, via_code) AS rank FROM rows_)
    WHERE rank <= 8""",
    model=True,
)
def course_rec_fallback(m: Model) -> DataFrame:
    return graph.course_fallback(m.teach, m.course, m.competency, m.relation, 49, 8)


@query(
    f"""WITH {TOP_COURSES_SQL.format(k=2)}
    SELECT career_code, item_code, rank, course_code, course_name, coverage_level FROM need JOIN top_courses USING (item_code)""",
    model=True,
)
def career_skill_courses(m: Model) -> DataFrame:
    return graph.career_skill_courses(m.need, m.teach, m.course, 2, m.seed_course)


@query(
    """WITH counts AS (
        SELECT subject, career_code, count(*) AS n_items FROM competency JOIN need USING (item_code)
        WHERE item_code IN (SELECT item_code FROM teach) GROUP BY 1, 2)
    SELECT subject, rank, career_code, career_name, n_items FROM (
        SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n_items DESC, career_code) AS rank FROM counts)
    JOIN career USING (career_code) WHERE rank <= 15""",
    model=True,
)
def subject_to_careers(m: Model) -> DataFrame:
    return graph.subject_careers(m.competency, m.teach, m.need, m.career, 15)


@query(
    """WITH edges AS (SELECT src AS item_code, 'outgoing' AS seen, rel_type FROM relation UNION ALL SELECT dst, 'incoming', rel_type FROM relation),
    counts AS (SELECT item_code, count(*) FILTER (seen = CASE WHEN rel_type = 'VALIDATES' AND type_code = 'CT_PLAT' THEN 'incoming' ELSE 'outgoing' END) AS n_read,
                      count(*) FILTER (seen <> CASE WHEN rel_type = 'VALIDATES' AND type_code = 'CT_PLAT' THEN 'incoming' ELSE 'outgoing' END) AS n_against
               FROM edges JOIN competency USING (item_code) GROUP BY 1)
    SELECT item_code, item_name, coalesce(n_read, 0) AS n_read, coalesce(n_against, 0) AS n_against,
           CASE WHEN coalesce(n_read, 0) > 0 THEN 'full' WHEN coalesce(n_against, 0) > 0 THEN 'partial' ELSE 'none' END AS coverage
    FROM competency LEFT JOIN counts USING (item_code)""",
    model=True,
)
def relations_both_directions(m: Model) -> DataFrame:
    return graph.relation_coverage_of_items(m.competency, m.relation, m.anchor_direction)


@query(
    """SELECT src AS item_code, rel_type, dst AS prerequisite_code, item_name AS prerequisite_name
    FROM relation JOIN registry USING (rel_type) JOIN competency ON item_code = dst
    WHERE ordering AND src IN (SELECT item_code FROM known)""",
    model=True,
)
def prerequisite_batch(m: Model) -> DataFrame:
    return graph.prerequisites(m.known, m.relation, m.registry, m.competency)


@query("SELECT career_code, item_code, priority_group FROM need JOIN known USING (career_code, item_code)", model=True)
def skills_gap_known(m: Model) -> DataFrame:
    return graph.gap_split(m.need, m.known, missing=False)


@query(
    """SELECT career_code, item_code, priority_group FROM need n WHERE career_code IN (SELECT career_code FROM known)
    AND NOT EXISTS (SELECT 1 FROM known k WHERE k.career_code = n.career_code AND k.item_code = n.item_code)""",
    model=True,
)
def skills_gap_missing(m: Model) -> DataFrame:
    return graph.gap_split(m.need, m.known, missing=True)


@query(
    """SELECT n.career_code, kind, count(*) FILTER (k.item_code IS NOT NULL) AS n_known, count(*) FILTER (k.item_code IS NULL) AS n_missing
    FROM need n JOIN competency c ON c.item_code = n.item_code LEFT JOIN known k ON k.career_code = n.career_code AND k.item_code = n.item_code
    WHERE n.career_code IN (SELECT career_code FROM known) GROUP BY 1, 2""",
    model=True,
)
def gap_by_type(m: Model) -> DataFrame:
    return graph.gap_by_kind(m.need, m.known, m.competency)


@query(
    """WITH flags AS (SELECT item_code, item_code IN (SELECT src FROM relation) AS has FROM (SELECT DISTINCT item_code FROM need))
    SELECT count(*) AS n_items, count(*) FILTER (has) AS n_covered, round(count(*) FILTER (has) / greatest(count(*), 1), 6) AS ratio,
           round(count(*) FILTER (has) / greatest(count(*), 1), 6) >= 0.5 AS passed FROM flags""",
    model=True,
)
def relation_coverage(m: Model) -> DataFrame:
    return graph.coverage_ratio(m.need, m.relation, 0.5)


@query("SELECT item_code, career_code FROM known WHERE item_code NOT IN (SELECT item_code FROM competency)", model=True)
def dangling_endpoints(m: Model) -> DataFrame:
    return graph.dangling(m.known, "item_code", m.competency, "item_code")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(m: Model) -> DataFrame:
    return graph.duplicate_keys(m.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    """WITH e AS (SELECT DISTINCT src, dst FROM relation WHERE rel_type = 'REQUIRES')
    SELECT 2 AS length, a.src || '>' || a.dst AS nodes FROM e a JOIN e b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst
    UNION ALL
    SELECT 3, a.src || '>' || a.dst || '>' || b.dst FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst AND c.dst = a.src
    WHERE a.dst > a.src AND b.dst > a.src AND b.dst <> a.dst
    UNION ALL
    SELECT 4, a.src || '>' || a.dst || '>' || b.dst || '>' || c.dst
    FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst JOIN e d ON d.src = c.dst AND d.dst = a.src
    WHERE a.dst > a.src AND b.dst > a.src AND b.dst <> a.dst AND c.dst > a.src AND c.dst <> a.dst AND c.dst <> b.dst""",
    model=True,
)
def requires_cycles(m: Model) -> DataFrame:
    return graph.short_cycles(m.relation.filter(F.col("rel_type") == "REQUIRES"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM relation WHERE rel_type = 'REQUIRES' AND dst % 6 = 3),
    reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON r.dst = e.src),
    own AS (SELECT a.src AS item_code, least(a.src, min(a.dst)) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1, a.src)
    SELECT * FROM own""",
    model=True,
)
def requires_cycle_nodes(m: Model) -> DataFrame:
    """Competencies on a cycle of any length, and the smallest of the ones that they are tied to."""
    return graph.nodes_on_cycles(m.relation.filter(F.col("rel_type") == "REQUIRES"))


@query(
    """SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, l_quantity, l_shipdate FROM (
        SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate DESC NULLS LAST, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS rn FROM lineitem)
    WHERE rn = 1"""
)
def edge_upsert_latest(m: Model) -> DataFrame:
    rows = graph.upsert_latest(m.table("lineitem"), ["l_suppkey", "l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity"])
    return rows.select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


@query(
    """SELECT 'NEED_' || kind AS rel_type, count(*) AS n_edges FROM need JOIN competency USING (item_code) GROUP BY 1
    UNION ALL SELECT 'TEACH_' || kind, count(*) FROM teach JOIN competency USING (item_code) GROUP BY 1
    UNION ALL SELECT rel_type, count(*) FROM relation GROUP BY 1""",
    model=True,
)
def rel_type_counts(m: Model) -> DataFrame:
    kind = m.competency.select("item_code", "kind")
    need = m.need.join(kind, "item_code").select(F.concat(F.lit("NEED_"), "kind").alias("rel_type"))
    teach = m.teach.join(kind, "item_code").select(F.concat(F.lit("TEACH_"), "kind").alias("rel_type"))
    return need.unionByName(teach).unionByName(m.relation.select("rel_type")).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n_edges"))


@query()
def topo_sort(m: Model) -> DataFrame:
    """Missing competencies of each career, prerequisites first."""
    gap = graph.gap_split(m.need, m.known, missing=True)
    nodes = gap.join(m.competency.select("item_code", "item_name"), "item_code").select("career_code", "item_code", "item_name", graph.priority_rank(F.col("priority_group")).alias("sort_rank"))
    ordering = m.relation.join(F.broadcast(m.registry.filter("ordering").select("rel_type")), "rel_type")
    edges = ordering.select(F.col("src").alias("item_code"), F.col("dst").alias("prerequisite_code")).distinct()
    return graph.topological_order(nodes, edges, "career_code")


@query(
    f"""WITH {TOP_COURSES_SQL.format(k=12)}
    SELECT item_code, course_code, rank, CAST((rank - 1) % 6 + 1 AS INT) AS month FROM top_courses""",
    model=True,
)
def month_allocation(m: Model) -> DataFrame:
    return graph.month_allocation(graph.top_courses(m.teach, m.course, 12, m.seed_course), "item_code", 6)


@query(
    """WITH gap AS (SELECT career_code, item_code FROM need n WHERE career_code IN (SELECT career_code FROM known)
        AND NOT EXISTS (SELECT 1 FROM known k WHERE k.career_code = n.career_code AND k.item_code = n.item_code)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY career_code ORDER BY item_code) AS rn, count(*) OVER (PARTITION BY career_code) AS n FROM gap)
    SELECT career_code, item_code, CAST(floor((rn - 1) / ceil(n / 6)) + 1 AS INT) AS month FROM placed""",
    model=True,
)
def roadmap_months(m: Model) -> DataFrame:
    gap = graph.gap_split(m.need, m.known, missing=True).select("career_code", "item_code")
    return graph.chunk_months(gap, "career_code", ["item_code"], 6)


@query(
    f"""WITH {TOP_COURSES_SQL.format(k=3)},
    taught AS (SELECT item_code, string_agg(course_name, ', ' ORDER BY rank) AS c FROM top_courses GROUP BY 1),
    related AS (SELECT src AS item_code, string_agg(rel_type || ' ' || dst, chr(10) ORDER BY rn) AS r FROM (
        SELECT *, row_number() OVER (PARTITION BY src ORDER BY rel_type, dst) AS rn FROM relation) WHERE rn <= 8 GROUP BY 1)
    SELECT item_code, concat_ws(chr(10), 'Competency: ' || item_name, 'Kind: ' || kind, 'Courses: ' || c, r) AS index_text
    FROM competency LEFT JOIN taught USING (item_code) LEFT JOIN related USING (item_code)""",
    model=True,
)
def competency_corpus(m: Model) -> DataFrame:
    return datasets.competency_texts(m.competency, graph.top_courses(m.teach, m.course, 3, m.seed_course), m.relation, 8)


# sessions


def _messages(m: Model) -> DataFrame:
    return m.table("conversations")


@query(
    """SELECT conv_id, turn, text, user_turn, (SELECT text FROM conversations u WHERE u.conv_id = a.conv_id AND u.turn = a.user_turn) AS user_text
    FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_turn
          FROM conversations) a WHERE role = 'assistant'"""
)
def asof_user_before_assistant(m: Model) -> DataFrame:
    return sessions.previous_user_message(_messages(m))


@query(
    """SELECT conv_id, count(*) AS n_messages, substr(arg_min(text, turn) FILTER (role = 'user'), 1, 60) AS preview FROM conversations GROUP BY 1"""
)
def session_preview_counts(m: Model) -> DataFrame:
    return sessions.session_previews(_messages(m), 60)


@query(
    """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end FROM conversations) WHERE from_end <= 3"""
)
def last_n_messages(m: Model) -> DataFrame:
    return sessions.last_messages(_messages(m), 3)


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(m: Model) -> DataFrame:
    return sessions.latest(m.table("events"), "user_id", F.struct("ts", "event_id"), ["event_id", "event_type", "value"])


@query(
    """WITH c AS (
        SELECT *, coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w, 0) AS n_asked,
               coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER w, 0) AS n_answered
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT conv_id, turn, role, CAST(n_asked AS BIGINT) AS n_asked, CAST(n_answered AS BIGINT) AS n_answered,
           CASE WHEN n_asked = 0 THEN 'idle' WHEN n_answered < 2 THEN 'collecting' WHEN n_answered < 4 THEN 'gap_summary' ELSE 'course' END AS phase FROM c"""
)
def session_phases(m: Model) -> DataFrame:
    return sessions.phases(_messages(m))


@query(
    """WITH f AS (SELECT event_id // 8 AS conv_id, event_id % 8 AS turn, CASE WHEN event_type = 'click' THEN 1 ELSE -1 END AS rating
                  FROM events WHERE event_type IN ('click', 'error')),
    r AS (SELECT conv_id, turn, rating, CASE WHEN rating = -1 THEN 'negative' WHEN length(text) < 80 THEN 'short' WHEN rating IS NULL THEN 'unrated' END AS reason
          FROM conversations LEFT JOIN f USING (conv_id, turn) WHERE role = 'assistant')
    SELECT * FROM r WHERE reason IS NOT NULL"""
)
def feedback_review_queue(m: Model) -> DataFrame:
    events = m.table("events").filter(F.col("event_type").isin("click", "error"))
    feedback = events.select(F.expr("event_id div 8").alias("conv_id"), (F.col("event_id") % 8).alias("turn"), F.when(F.col("event_type") == "click", 1).otherwise(-1).alias("rating"))
    return sessions.feedback_queue(_messages(m), feedback)


@query(
    """WITH p AS (
        SELECT conv_id, turn, text, (SELECT text FROM conversations u WHERE u.conv_id = a.conv_id AND u.turn = a.user_turn) AS user_text
        FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_turn
              FROM conversations) a WHERE role = 'assistant')
    SELECT conv_id, turn, substr(sha256(user_text), 1, 16) AS dedup_key, length(user_text) AS n_question, length(text) AS n_answer
    FROM p WHERE user_text IS NOT NULL AND length(text) >= 20 AND length(user_text) >= 20"""
)
def training_pairs(m: Model) -> DataFrame:
    return datasets.training_rows(sessions.previous_user_message(_messages(m)))


# retrieval


def _vector_queries(m: Model) -> DataFrame:
    return m.table("embeddings").filter(F.col("vec_id") % 100 == 0)


KNN_SQL = """knn AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
        SELECT q.vec_id AS query_id, q.label AS query_label, v.vec_id AS doc_id, v.label,
               round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 4) AS score
        FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)) WHERE rank <= {k})"""


@query(f"WITH {KNN_SQL.format(k=5)} SELECT * FROM knn")
def knn_cosine(m: Model) -> DataFrame:
    return retrieval.knn(m.table("embeddings"), _vector_queries(m), 5)


@query(
    f"""WITH {KNN_SQL.format(k=10)},
    rels AS (SELECT query_id, query_label, rank, CASE WHEN label = query_label THEN 1 ELSE 0 END AS rel FROM knn),
    totals AS (SELECT q.vec_id AS query_id, count(*) FILTER (v.label = q.label) AS n_relevant
               FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id GROUP BY 1),
    run AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM rels),
    ks AS (SELECT * FROM (VALUES (3), (10)) AS t(k)),
    per AS (SELECT query_id, query_label, k, sum(rel) FILTER (rank <= k) AS hits, coalesce(avg(so_far / rank) FILTER (rel = 1), 0) AS ap,
                   coalesce(1 / min(rank) FILTER (rel = 1), 0) AS rr, sum(rel / log2(rank + 1)) FILTER (rank <= k) AS dcg
            FROM run CROSS JOIN ks GROUP BY 1, 2, 3),
    full_ AS (SELECT p.*, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END AS hit_rate, CASE WHEN n_relevant > 0 THEN least(1.0, hits / n_relevant) ELSE 0 END AS recall_full,
                     hits / k AS precision_, CASE WHEN hits > 0 THEN dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) AS r(i) WHERE i <= hits) ELSE 0 END AS ndcg
              FROM per p JOIN totals USING (query_id))
    SELECT k, CASE WHEN grouping(query_label) = 1 THEN 'all' ELSE CAST(query_label AS VARCHAR) END AS scope, count(*) AS n_queries,
           round(avg(hit_rate), 6) AS hit_rate, round(avg(recall_full), 6) AS recall_full, round(avg(precision_), 6) AS "precision",
           round(avg(ap), 6) AS ap, round(avg(rr), 6) AS rr, round(avg(ndcg), 6) AS ndcg
    FROM full_ GROUP BY GROUPING SETS ((k), (k, query_label))"""
)
def ir_metrics_grouping_sets(m: Model) -> DataFrame:
    vectors, asked = m.table("embeddings"), _vector_queries(m)
    ranked = retrieval.knn(vectors, asked, 10).select("query_id", "rank", F.coalesce((F.col("label") == F.col("query_label")).cast("int"), F.lit(0)).alias("rel"))
    by_label = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    totals = asked.join(by_label, "label").select(F.col("vec_id").alias("query_id"), (F.col("n") - 1).alias("n_relevant"), F.col("label").alias("query_label"))
    per_query = metrics.query_metrics(ranked, totals.select("query_id", "n_relevant"), (3, 10)).join(totals.select("query_id", "query_label"), "query_id")
    return metrics.metric_table(per_query, "query_label")


def _bm25(m: Model, k: int) -> DataFrame:
    return retrieval.bm25(m.table("documents"), m.table("benchmark").select(F.col("item_id").alias("query_id"), "text"), k)


TOKENS_SQL = r"""CASE WHEN len(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 1)) > 0
    THEN list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 1)
    ELSE list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9+#.]+'), lambda w: length(w) > 1) END""".replace("{{", "{").replace("}}", "}")
BM25_SQL = f"""d AS (SELECT doc_id, {TOKENS_SQL} AS toks FROM documents),
    corpus AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
    terms AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d),
    tfs AS (SELECT doc_id, dl, term, count(*) AS tf FROM terms GROUP BY 1, 2, 3),
    idfs AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tfs CROSS JOIN corpus GROUP BY term, n),
    weights AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM idfs) ELSE raw END AS idf FROM idfs),
    asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS_SQL}) AS term FROM benchmark) GROUP BY 1, 2),
    scored AS (SELECT query_id, doc_id, count(*) AS n_terms, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
               FROM asked JOIN weights USING (term) JOIN tfs USING (term) CROSS JOIN corpus GROUP BY 1, 2)"""


@query(
    f"""WITH {BM25_SQL}
    SELECT query_id, doc_id, n_terms, score, rank FROM (
        SELECT query_id, doc_id, n_terms, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, doc_id) AS rank
        FROM scored WHERE score > 0) WHERE rank <= 5"""
)
def bm25_topk(m: Model) -> DataFrame:
    return retrieval.top_k(_bm25(m, 5), 5, F.desc("score"))


RRF_SQL = f"""{BM25_SQL},
    arm0 AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20),
    arm1 AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_terms DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20),
    fused AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score, min(arm * 1000 + rank) AS first_
              FROM (SELECT *, 0 AS arm FROM arm0 UNION ALL SELECT *, 1 FROM arm1) GROUP BY 1, 2),
    rrf AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_, doc_id) AS rank, score FROM fused) WHERE rank <= 10)"""


def _rrf(m: Model) -> DataFrame:
    return retrieval.fused(retrieval.two_lists(_bm25(m, 20), 20), 10)


@query(f"WITH {RRF_SQL} SELECT * FROM rrf")
def rrf_fuse(m: Model) -> DataFrame:
    return _rrf(m)


@query(
    f"""WITH {RRF_SQL},
    boosted AS (SELECT query_id, doc_id, rank AS before, round(score + CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 0.15 ELSE 0 END, 9) AS score FROM rrf)
    SELECT query_id, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before, doc_id) AS rank FROM boosted) WHERE rank <= 5"""
)
def graph_boost(m: Model) -> DataFrame:
    return retrieval.boosted(_rrf(m), m.table("labels").filter("quality = 1"), 5)


@query(
    f"""WITH {RRF_SQL},
    marked AS (SELECT r.*, lang = 'en' AS edge FROM rrf r JOIN documents USING (doc_id)),
    seen AS (SELECT *, sum(CASE WHEN edge THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS s FROM marked)
    SELECT query_id, doc_id, rank, score, new_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS new_rank FROM seen WHERE NOT edge OR s <= 2) WHERE new_rank <= 5"""
)
def edge_cap(m: Model) -> DataFrame:
    marked = _rrf(m).join(m.table("documents").select("doc_id", "lang"), "doc_id")
    return retrieval.capped(marked, F.col("lang") == "en", 5).select("query_id", "doc_id", "rank", "score", "new_rank")


# evaluation


@query(
    """WITH gold AS (SELECT career_code, list_sort(list(item_code)) AS gold FROM need GROUP BY 1), pred AS (SELECT career_code, list(item_code) AS pred FROM known GROUP BY 1),
    s AS (SELECT career_code, len(gold) AS n_gold, len(pred) AS n_pred, len(list_intersect(gold, pred)) AS n_both FROM gold JOIN pred USING (career_code))
    SELECT career_code, n_gold, n_pred, round(n_both / n_gold, 6) AS recall, round(2 * n_both / (n_pred + n_gold), 6) AS f1 FROM s""",
    model=True,
)
def set_f1(m: Model) -> DataFrame:
    gold = m.need.groupBy("career_code").agg(F.collect_set("item_code").alias("gold"))
    pred = m.known.groupBy("career_code").agg(F.collect_set("item_code").alias("pred"))
    scored = metrics.set_scores(gold.join(pred, "career_code"), "pred", "gold")
    return scored.select("career_code", F.size("gold").alias("n_gold"), F.size("pred").alias("n_pred"), "recall", "f1")


@query(
    """WITH s AS (SELECT lang, quality, CASE WHEN toxic = 1 THEN 'infra' WHEN n_chars < 500 THEN 'mismatch' ELSE 'valid' END AS status FROM labels JOIN documents USING (doc_id))
    SELECT lang, count(*) AS n_rows, count(*) FILTER (status = 'valid') AS n_valid, count(*) FILTER (status = 'mismatch') AS n_mismatch,
           count(*) FILTER (status = 'infra') AS n_infra, round(count(*) FILTER (status = 'valid') / count(*), 6) AS valid_rate,
           round(coalesce(avg(quality) FILTER (status = 'valid'), 0), 6) AS mean_valid FROM s GROUP BY 1"""
)
def status_rates_by_cohort(m: Model) -> DataFrame:
    rows = m.table("labels").join(m.table("documents").select("doc_id", "lang", "n_chars"), "doc_id")
    status = F.when(F.col("toxic") == 1, "infra").when(F.col("n_chars") < 500, "mismatch").otherwise("valid")
    return metrics.rates_by(rows, "lang", status, F.col("quality"))


HALF = "event_id % 2"


@query(
    """WITH a AS (SELECT user_id, event_type, round(avg(value), 6) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2),
    b AS (SELECT user_id, event_type, round(avg(value), 6) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
    SELECT user_id, event_type, round(b.v - a.v, 6) AS delta, round(b.v - a.v, 6) < -0.15 AS regressed FROM a JOIN b USING (user_id, event_type)"""
)
def run_compare(m: Model) -> DataFrame:
    runs = [m.table("events").filter(F.expr(f"{HALF} = {k}")).groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("v")) for k in (0, 1)]
    return metrics.run_deltas(runs[0], runs[1], ["user_id", "event_type"], "v", 0.15)


@query("SELECT event_type, count(*) AS n_runs, round(greatest(0.05, coalesce(2 * stddev_samp(value), 0.05)), 4) AS threshold FROM events GROUP BY 1")
def regression_threshold(m: Model) -> DataFrame:
    return metrics.regression_threshold(m.table("events"), "event_type", "value", 0.05)


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, n AS n_rows, value AS percentile FROM r WHERE i = round_even(0.95 * (n - 1), 0)"""
)
def nearest_rank_p95(m: Model) -> DataFrame:
    return metrics.nearest_rank(m.table("events"), "event_type", "value", 0.95)


@query(
    """WITH r AS (SELECT toxic = 1 AS x, n_chars AS v FROM labels JOIN documents USING (doc_id) WHERE n_chars IS NOT NULL),
    c AS (SELECT v, count(*) FILTER (x) AS x, count(*) FILTER (NOT x) AS y FROM r GROUP BY 1),
    s AS (SELECT x, y, x * (coalesce(sum(y) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + y / 2) AS u FROM c)
    SELECT CAST(sum(x) AS BIGINT) AS nx, CAST(sum(y) AS BIGINT) AS ny, round(2 * sum(u) / (sum(x) * sum(y)) - 1, 6) AS effect FROM s"""
)
def rank_biserial(m: Model) -> DataFrame:
    rows = m.table("labels").join(m.table("documents").select("doc_id", "n_chars"), "doc_id")
    return metrics.rank_biserial(rows, F.col("toxic") == 1, "n_chars")


@query(
    """SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS mode_click, round(avg(value) FILTER (event_type = 'view'), 6) AS mode_view,
           coalesce(round(avg(value) FILTER (event_type = 'click'), 6) >= 50 AND round(avg(value) FILTER (event_type = 'view'), 6) <= 50, false) AS first_wins
    FROM events GROUP BY 1"""
)
def mode_pivot_wins(m: Model) -> DataFrame:
    return metrics.mode_wins(m.table("events"), "user_id", "event_type", ["click", "view"], "value", 50, 50)


@query(
    """WITH w AS (SELECT user_id, event_type, avg(value) FILTER (event_id % 2 = 0) AS x, avg(value) FILTER (event_id % 2 = 1) AS y FROM events GROUP BY 1, 2),
    d AS (SELECT event_type, count(x - y) AS n, avg(x - y) AS m, stddev_samp(x - y) AS s FROM w GROUP BY 1)
    SELECT event_type, n, round(m, 6) AS mean_delta, CASE WHEN n > 1 AND s > 0 THEN round(m / (s / sqrt(n)), 4) END AS t FROM d"""
)
def paired_t_test(m: Model) -> DataFrame:
    pairs = m.table("events").groupBy("user_id", "event_type").agg(F.avg(F.when(F.expr(f"{HALF} = 0"), F.col("value"))).alias("x"), F.avg(F.when(F.expr(f"{HALF} = 1"), F.col("value"))).alias("y"))
    return metrics.paired_t(pairs, "event_type", "x", "y")


@query()
def bootstrap_ci(m: Model) -> DataFrame:
    return metrics.bootstrap_mean(m.table("events"), "event_type", "value")


@query(
    """SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source,
           count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))"""
)
def corpus_counts(m: Model) -> DataFrame:
    lang, source = F.col("lang"), F.col("source")
    sets = m.table("documents").groupingSets([[], [lang], [source], [lang, source]], lang, source)
    counted = sets.agg(F.grouping("lang").alias("no_lang"), F.grouping("source").alias("no_source"), F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))
    names = [F.when(F.col(f"no_{c}") == 1, "all").otherwise(F.col(c)).alias(c) for c in ("lang", "source")]
    return counted.select(*names, "n_docs", "n_chars")


# datasets


@query(
    """WITH h AS (SELECT sha256(coalesce(text, '')) AS text_sha256, doc_id, CASE source WHEN 'src1' THEN 2 WHEN 'src2' THEN 1 ELSE 0 END AS priority FROM documents)
    SELECT text_sha256, doc_id, priority, n_rows FROM (
        SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY priority DESC, doc_id) AS rn, count(*) OVER (PARTITION BY text_sha256) AS n_rows FROM h) WHERE rn = 1"""
)
def priority_dedupe(m: Model) -> DataFrame:
    priority = F.when(F.col("source") == "src1", 2).when(F.col("source") == "src2", 1).otherwise(0)
    return datasets.priority_dedupe(m.table("documents"), "text", "doc_id", priority)


@query(
    """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)
    SELECT source, doc_id, CASE WHEN n >= 4 AND rn <= greatest(1, floor(n * 0.15)) THEN 'val' ELSE 'train' END AS split FROM r"""
)
def grouped_split(m: Model) -> DataFrame:
    return datasets.grouped_split(m.table("documents"), "source", "doc_id", 0.15)


@query(
    """WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents),
    q AS (SELECT *, greatest(1, CAST(round_even(n * 100 / (SELECT count(*) FROM documents), 0) AS BIGINT)) AS quota FROM r)
    SELECT lang, doc_id, rn, quota FROM q WHERE rn <= quota"""
)
def stratified_quota(m: Model) -> DataFrame:
    return datasets.stratified_sample(m.table("documents"), "lang", "doc_id", 100)


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def ordered_dedupe(m: Model) -> DataFrame:
    return datasets.ordered_dedupe(m.table("events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query(
    """WITH r AS (SELECT doc_id, length(text) AS n, count(*) OVER (PARTITION BY doc_id) AS n_key, count(*) OVER (PARTITION BY sha256(coalesce(text, ''))) AS n_text FROM documents),
    e AS (SELECT doc_id, concat_ws(',', CASE WHEN coalesce(n, 0) = 0 THEN 'missing_text' END, CASE WHEN n < 200 THEN 'short_text' END,
                                   CASE WHEN n_key > 1 THEN 'duplicate_key' END, CASE WHEN n_text > 1 THEN 'duplicate_text' END) AS errors FROM r)
    SELECT * FROM e WHERE errors <> ''"""
)
def gold_validation(m: Model) -> DataFrame:
    return datasets.validation_errors(m.table("documents"), "doc_id", "text")


# pages


@query(f"SELECT page_id, {GENERIC_SQL.format(u='url')} AS generic FROM pages")
def generic_url(m: Model) -> DataFrame:
    return m.table("pages").select("page_id", T.is_generic_url(F.col("url")).alias("generic"))


@query(
    """WITH l AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1) AS links FROM pages)
    SELECT page_id, len(links) AS n_links, len(list_distinct(links)) AS n_distinct, len(list_filter(links, lambda x: starts_with(x, 'http'))) AS n_absolute FROM l"""
)
def citation_counts(m: Model) -> DataFrame:
    found = m.table("pages").select("page_id", T.links(F.col("html")).alias("links"))
    return found.select("page_id", F.size("links").alias("n_links"), F.size(F.array_distinct("links")).alias("n_distinct"), F.size(F.filter("links", lambda x: x.startswith("http"))).alias("n_absolute"))


@query(
    r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?\n]+'), lambda x: trim(x)), lambda x: length(x) > 0) AS s FROM documents)
    SELECT doc_id, len(s) AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM s"""
)
def sentence_counts(m: Model) -> DataFrame:
    s = m.table("documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).alias("longest"))
