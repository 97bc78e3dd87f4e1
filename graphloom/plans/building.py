"""Queries on ingest, datasets, retrieval end to end, plans and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import datasets, graph, ingest, metrics, retrieval, sessions
from graphloom.plans.catalogue import BM25_SQL, KIND_SQL, KNN_SQL, PRIORITY_SQL, TOP_COURSES_SQL, _bm25
from graphloom.plans.registry import query
from graphloom.sources.model import TYPE_CODES, Model

# ingest

SUPPLEMENT_SQL = """rows_ AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 2 THEN NULL ELSE 'R' || (o_orderkey // 6) END AS relation_id FROM orders),
    base AS (SELECT * FROM rows_ WHERE o_orderkey % 3 = 0), extra AS (SELECT * FROM rows_ WHERE o_orderkey % 3 <> 0)"""


@query(
    f"""WITH {SUPPLEMENT_SQL},
    new AS (SELECT *, row_number() OVER (PARTITION BY relation_id ORDER BY o_orderkey) AS rn FROM extra WHERE relation_id IS NOT NULL AND relation_id NOT IN (SELECT relation_id FROM base WHERE relation_id IS NOT NULL))
    SELECT * FROM base UNION ALL SELECT * FROM extra WHERE relation_id IS NULL UNION ALL SELECT o_orderkey, relation_id FROM new WHERE rn = 1"""
)
def relation_supplement(m: Model) -> DataFrame:
    rows = m.table("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 >= 2, F.concat(F.lit("R"), F.expr("o_orderkey div 6"))).alias("relation_id"))
    return ingest.merge_supplement(rows.filter("o_orderkey % 3 = 0"), rows.filter("o_orderkey % 3 <> 0"), "relation_id", ["o_orderkey"])


#: Edge rows of a workbook: some with blank or unknown types, ends that there are not, and repeats.
EDGE_SQL = """sheet AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE o_custkey + CASE WHEN l_orderkey % 41 = 0 THEN 1000000000 ELSE 0 END END AS career_code, l_partkey AS item_code,
                         CASE WHEN l_orderkey % 17 = 0 THEN ' ' WHEN l_orderkey % 19 = 0 THEN 'CT_NONE' WHEN l_orderkey % 23 = 0 THEN ' ' || type_code || ' ' ELSE type_code END AS type_code, o_orderpriority AS priority_group
                  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN competency ON item_code = l_partkey)"""


def edge_sheet(m: Model) -> DataFrame:
    rows = m.table("lineitem").join(m.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(m.competency, F.col("l_partkey") == F.col("item_code"))
    k = F.col("l_orderkey")
    career = F.when(k % 50 != 0, F.col("o_custkey") + F.when(k % 41 == 0, 1_000_000_000).otherwise(0))
    code = F.when(k % 17 == 0, " ").when(k % 19 == 0, "CT_NONE").when(k % 23 == 0, F.concat(F.lit(" "), "type_code", F.lit(" "))).otherwise(F.col("type_code"))
    return rows.select("l_orderkey", "l_linenumber", career.alias("career_code"), "item_code", code.alias("type_code"), F.col("o_orderpriority").alias("priority_group"))


@query(
    f"""WITH {EDGE_SQL},
    good AS (SELECT * REPLACE (trim(type_code) AS type_code) FROM sheet WHERE career_code IS NOT NULL AND trim(type_code) IN ('CT_LANG', 'CT_FRAM', 'CT_PLAT', 'CT_TOOL', 'CT_KNOW', 'CT_SOFT', 'CT_CERT')
             AND NOT EXISTS (SELECT 1 FROM need d WHERE d.career_code = sheet.career_code AND d.item_code = sheet.item_code AND d.career_code % 97 = 0)
             AND career_code IN (SELECT career_code FROM career)),
    last AS (SELECT *, row_number() OVER (PARTITION BY career_code, item_code, type_code ORDER BY l_orderkey DESC, l_linenumber DESC) AS rn FROM good)
    SELECT * EXCLUDE (rn) FROM last WHERE rn = 1""",
    model=True,
)
def typed_need_edges(m: Model) -> DataFrame:
    return ingest.typed_edges(edge_sheet(m), m.career, m.competency, ("career_code", "item_code"), ["l_orderkey", "l_linenumber"], TYPE_CODES, m.need.filter("career_code % 97 = 0"))


TEACH_SHEET = "CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN ' teach ' WHEN 2 THEN 'TEACH' ELSE 'OTHER' END"


@query(f"SELECT l_suppkey, l_partkey, count(*) AS n_rows FROM (SELECT *, {TEACH_SHEET} AS t FROM lineitem) WHERE t IS NULL OR upper(trim(t)) = 'TEACH' GROUP BY 1, 2")
def teach_rows(m: Model) -> DataFrame:
    rows = m.table("lineitem").withColumn("relation_type", F.expr(TEACH_SHEET))
    return ingest.of_relation(rows, "TEACH").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT DISTINCT k.career_code, k.item_code FROM known k JOIN competency c ON c.item_code = k.item_code", model=True)
def optional_edges(m: Model) -> DataFrame:
    """Edges whose target there is; the rows of others stay without an edge."""
    return m.known.join(m.competency.select("item_code"), "item_code", "left_semi").select("career_code", "item_code")


@query(
    """SELECT DISTINCT career_code, d.dimension, d.name FROM (
        SELECT career_code, unnest([{'dimension': 'industry', 'name': trim(industry)}, {'dimension': 'taxonomy', 'name': trim(taxonomy)}]) AS d FROM career) WHERE d.name <> ''""",
    model=True,
)
def career_dimensions(m: Model) -> DataFrame:
    return ingest.dimension_links(m.career, "career_code", ["industry", "taxonomy"])


@query("SELECT 'industry' AS dimension, trim(industry) AS name FROM career GROUP BY 2 UNION ALL SELECT 'taxonomy', trim(taxonomy) FROM career GROUP BY 2", model=True)
def dimension_nodes(m: Model) -> DataFrame:
    return ingest.dimension_nodes(m.career, ["industry", "taxonomy"])


RELATION_SHEET_SQL = """sheet AS (SELECT src AS from_item_code_, CASE WHEN src % 29 = 0 THEN ' ' ELSE CAST(src AS VARCHAR) END AS from_item_code, CAST(dst AS VARCHAR) AS to_item_code,
        CASE WHEN dst % 31 = 0 THEN '' WHEN dst % 37 = 0 THEN 'knows' ELSE ' ' || lower(rel_type) END AS relation_type, a.type_code AS from_type_code, b.type_code AS to_type_code
    FROM relation JOIN competency a ON a.item_code = src JOIN competency b ON b.item_code = dst)"""


@query(
    f"""WITH {RELATION_SHEET_SQL},
    marked AS (SELECT s.*, upper(trim(relation_type)) AS rel, r.from_types, r.to_types FROM sheet s LEFT JOIN registry r ON r.rel_type = upper(trim(relation_type)))
    SELECT * FROM (SELECT from_item_code, to_item_code, relation_type, from_type_code, to_type_code, concat_ws('; ', CASE WHEN rel = '' THEN 'missing relation_type' END,
        CASE WHEN rel <> '' AND from_types IS NULL THEN 'unknown relation_type: ' || rel END,
        CASE WHEN NOT list_contains(from_types, from_type_code) THEN rel || ': from_type_code ' || from_type_code END,
        CASE WHEN NOT list_contains(to_types, to_type_code) THEN rel || ': to_type_code ' || to_type_code END,
        CASE WHEN from_types IS NOT NULL AND trim(from_item_code) = '' THEN 'missing from_item_code' END) AS errors FROM marked) WHERE errors <> ''""",
    model=True,
)
def relation_row_errors(m: Model) -> DataFrame:
    types = m.competency.select("item_code", "type_code")
    rows = m.relation.join(types.toDF("src", "from_type_code"), "src").join(types.toDF("dst", "to_type_code"), "dst")
    sheet = rows.select(
        F.when(F.col("src") % 29 == 0, " ").otherwise(F.col("src").cast("string")).alias("from_item_code"),
        F.col("dst").cast("string").alias("to_item_code"),
        F.when(F.col("dst") % 31 == 0, "").when(F.col("dst") % 37 == 0, "knows").otherwise(F.concat(F.lit(" "), F.lower("rel_type"))).alias("relation_type"),
        "from_type_code",
        "to_type_code",
    )
    return ingest.row_errors(sheet, m.registry)


@query(
    """SELECT type_code, rel_type, list_contains(anchor_types, type_code) AS "primary", exposed FROM registry
    CROSS JOIN (SELECT unnest(['CT_LANG', 'CT_FRAM', 'CT_PLAT', 'CT_TOOL', 'CT_KNOW', 'CT_SOFT', 'CT_CERT']) AS type_code)
    WHERE list_contains(anchor_types, type_code) OR list_contains(from_types, type_code) OR list_contains(to_types, type_code)""",
    model=True,
)
def anchor_relation_types(m: Model) -> DataFrame:
    return ingest.types_for_anchor(m.registry, TYPE_CODES)


@query(
    """SELECT user_id, event_id, value, 'pending' AS status FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('click', 'error')) WHERE rn = 1"""
)
def feedback_upsert(m: Model) -> DataFrame:
    rows = m.table("events").filter(F.col("event_type").isin("click", "error")).select("user_id", "event_id", "value", "ts", F.lit("approved").alias("status"))
    return ingest.upsert_feedback(rows, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "value", "status")


# sessions


@query(
    """SELECT conv_id, turn, role, created FROM conversations JOIN (SELECT event_id // 8 AS conv_id, event_id % 8 AS turn, event_id AS created FROM events WHERE event_type = 'click') USING (conv_id, turn)
    WHERE role = 'assistant' ORDER BY created DESC, conv_id, turn LIMIT 200"""
)
def approved_examples(m: Model) -> DataFrame:
    events = m.table("events").filter("event_type = 'click'")
    feedback = events.select(F.expr("event_id div 8").alias("conv_id"), (F.col("event_id") % 8).alias("turn"), F.col("event_id").alias("created"), F.lit("approved").alias("status"))
    return sessions.approved_examples(m.table("conversations").select("conv_id", "turn", "role"), feedback, 200)


@query(
    """WITH s AS (SELECT user_id AS conv_id, min(event_id) AS created, max(event_id) AS updated FROM events GROUP BY 1)
    SELECT conv_id, created, updated, coalesce(n, 0) AS n_messages FROM s LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) USING (conv_id) WHERE created >= 10"""
)
def recent_sessions(m: Model) -> DataFrame:
    touched = m.table("events").groupBy(F.col("user_id").alias("conv_id")).agg(F.min("event_id").alias("created"), F.max("event_id").alias("updated"))
    return sessions.recent_sessions(m.table("conversations"), touched, F.lit(10)).select("conv_id", "created", "updated", "n_messages")


@query(
    f"""WITH {KNN_SQL.format(k=1000000).replace("ON q.vec_id % 100 = 0", "ON v.label = 1 AND q.vec_id % 100 = 0")} SELECT query_id, doc_id, rank, score FROM knn WHERE rank <= 2"""
)
def exemplars(m: Model) -> DataFrame:
    """The two approved examples nearest to each query."""
    vectors = m.table("embeddings")
    return retrieval.knn(vectors.filter("label = 1"), vectors.filter("vec_id % 100 = 0"), 2).select("query_id", "doc_id", "rank", "score")


# retrieval


#: The text of a benchmark item and the vector of its number ask for documents, whose vectors have theirs.
HYBRID_SQL = f"""{BM25_SQL},
    near AS (SELECT item_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 4) AS cos
             FROM benchmark JOIN embeddings q ON q.vec_id = item_id JOIN embeddings v ON true),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, doc_id) AS r FROM near) WHERE r <= 60),
    arm0 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM top JOIN documents USING (doc_id) WHERE trim(coalesce(text, '')) <> ''),
    arm1 AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 60),
    fused AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score, min(arm * 1000 + rank) AS first_
              FROM (SELECT *, 0 AS arm FROM arm0 UNION ALL SELECT *, 1 FROM arm1) GROUP BY 1, 2)"""


def vector_hits(m: Model, k: int) -> DataFrame:
    """query_id, doc_id, rank, score: documents by the cosine of their vector and that of a benchmark item."""
    vectors = m.table("embeddings")
    # numbers of queries are negative, so that a document may be the item of its own number
    asked = m.table("benchmark").join(vectors, F.col("item_id") == F.col("vec_id")).select((-F.col("item_id") - 1).alias("vec_id"), "embedding", "label")
    hits = retrieval.knn(vectors, asked, k).select((-F.col("query_id") - 1).alias("query_id"), "doc_id", "rank", "score")
    return retrieval.vector_arm(hits, m.table("documents").select("doc_id", "text"))


@query(
    f"""WITH {HYBRID_SQL},
    wide AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_, doc_id) AS rank FROM fused),
    lifted AS (SELECT query_id, doc_id, rank AS before, round(score + CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 0.15 ELSE 0 END, 9) AS score FROM wide WHERE rank <= 120),
    ordered AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before, doc_id) AS rank FROM lifted),
    marked AS (SELECT o.*, lang = 'en' AS edge FROM ordered o JOIN documents USING (doc_id)),
    seen AS (SELECT *, sum(CASE WHEN edge THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS s FROM marked WHERE rank <= 120)
    SELECT query_id, doc_id, rank, score FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM seen WHERE NOT edge OR s <= 2) WHERE rank <= 8"""
)
def retrieve_hybrid(m: Model) -> DataFrame:
    """The vector arm and the lexical arm over pools of 60, fused, boosted and capped."""
    second = retrieval.top_k(_bm25(m, 60), 60, F.desc("score"))
    edges = m.table("documents").select("doc_id", "lang")
    return retrieval.retrieve(vector_hits(m, 60), second, m.table("labels").filter("quality = 1"), F.col("lang") == "en", edges, 8)


@query(
    f"""WITH {KNN_SQL.format(k=20)},
    kept AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS rank FROM knn JOIN documents USING (doc_id) WHERE trim(coalesce(text, '')) <> '')
    SELECT query_id, doc_id, rank, score FROM kept WHERE rank <= 3"""
)
def retrieve_vector_only(m: Model) -> DataFrame:
    """Without a lexical arm and a boost; hits without a text are left out."""
    vectors = m.table("embeddings")
    hits = retrieval.knn(vectors, vectors.filter("vec_id % 100 = 0"), 20).select("query_id", "doc_id", "rank", "score")
    arm = retrieval.vector_arm(hits, m.table("documents").select("doc_id", "text"))
    return retrieval.retrieve(arm, None, None, F.lit(False), m.table("documents").select("doc_id"), 3)


@query(
    """SELECT src, rel_type, dst, a.item_name || ' ' || lower(replace(rel_type, '_', ' ')) || ' ' || b.item_name AS text
    FROM relation JOIN competency a ON a.item_code = src JOIN competency b ON b.item_code = dst WHERE rel_type IN ('BUILT_ON', 'VALIDATES', 'REQUIRES')""",
    model=True,
)
def edge_documents(m: Model) -> DataFrame:
    return retrieval.edge_documents(m.relation, m.competency).drop("edge_id")


@query()
def edge_document_ids(m: Model) -> DataFrame:
    return retrieval.edge_documents(m.relation, m.competency).select("edge_id", "src", "rel_type", "dst")


@query(
    f"""WITH {KNN_SQL.format(k=6)},
    hits AS (SELECT query_id, rank, ['career', 'competency', 'course', 'page'][doc_id % 4 + 1] AS doc_type, CASE WHEN doc_id % 9 = 0 THEN '' ELSE CAST(doc_id // 3 AS VARCHAR) END AS code, [CAST(doc_id % 5 AS VARCHAR), CAST(doc_id % 7 AS VARCHAR)] AS items FROM knn),
    codes AS (SELECT query_id, rank, 0 AS pos, doc_type AS kind, code FROM hits WHERE doc_type <> 'page' UNION ALL SELECT query_id, rank, 1, 'competency', items[1] FROM hits WHERE doc_type = 'course'
              UNION ALL SELECT query_id, rank, 2, 'competency', items[2] FROM hits WHERE doc_type = 'course'),
    first_ AS (SELECT query_id, kind, code, min(rank * 10 + pos) AS f FROM codes WHERE code <> '' GROUP BY 1, 2, 3)
    SELECT query_id, kind, code, row_number() OVER (PARTITION BY query_id, kind ORDER BY f, code) AS place FROM first_"""
)
def vector_seed_codes(m: Model) -> DataFrame:
    vectors = m.table("embeddings")
    ranked = retrieval.knn(vectors, vectors.filter("vec_id % 100 = 0"), 6)
    d = F.col("doc_id")
    kinds = F.get(F.array(*(F.lit(k) for k in ("career", "competency", "course", "page"))), (d % 4).cast("int"))
    code = F.when(d % 9 == 0, "").otherwise(F.expr("doc_id div 3").cast("string"))
    hits = ranked.select("query_id", "rank", kinds.alias("doc_type"), code.alias("code"), F.array((d % 5).cast("string"), (d % 7).cast("string")).alias("items"))
    return retrieval.seed_codes(hits)


@query("SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN 'c' || doc_id ELSE ' ' END), ''), CASE WHEN doc_id % 3 = 1 THEN CAST(doc_id AS VARCHAR) END, substr(coalesce(text, ''), 1, 120)) AS doc_key FROM documents")
def document_keys(m: Model) -> DataFrame:
    chunk = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("c"), "doc_id")).otherwise(" ")
    own = F.when(F.col("doc_id") % 3 == 1, F.col("doc_id"))
    return m.table("documents").select("doc_id", retrieval.doc_key(chunk, own, F.lit(None).cast("string"), F.col("text")).alias("doc_key"))


# datasets


@query(
    """WITH b AS (SELECT lang || '|' || source AS stratum, count(*) AS n FROM documents GROUP BY 1),
    p AS (SELECT *, row_number() OVER (ORDER BY n DESC, stratum) AS place, count(*) OVER () AS last, sum(n) OVER () AS total FROM b),
    w AS (SELECT *, CASE WHEN place = last THEN n ELSE least(n, greatest(1, CAST(round_even(120 * n / total, 0) AS BIGINT))) END AS want FROM p),
    q AS (SELECT stratum, greatest(0, least(want, 120 - coalesce(sum(want) OVER (ORDER BY n DESC, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota FROM w),
    r AS (SELECT doc_id, lang || '|' || source AS stratum, md5(CAST(doc_id AS VARCHAR)) AS h, row_number() OVER (PARTITION BY lang, source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents),
    m AS (SELECT doc_id, stratum, row_number() OVER (ORDER BY CASE WHEN rn <= quota THEN 0 ELSE 1 END, h, doc_id) AS place FROM r JOIN q USING (stratum))
    SELECT doc_id, stratum FROM m WHERE place <= 120"""
)
def stratified_top_up(m: Model) -> DataFrame:
    return datasets.topped_up_sample(m.table("documents"), ["lang", "source"], "doc_id", 120)


GOLD_SQL = """g AS (SELECT doc_id AS position, 'g' || (doc_id - doc_id % 2 * (doc_id % 3)) AS id, ['', 'course_rec', 'skills_gap', 'other'][doc_id % 4 + 1] AS intent, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE text END AS question,
                     CASE WHEN doc_id % 13 <> 0 THEN source END AS gold_source, CASE WHEN doc_id % 5 = 0 THEN [] ELSE ['c'] END AS careers, CASE WHEN doc_id % 6 <> 0 THEN ['k'] END AS courses FROM documents)"""


@query(
    f"""WITH {GOLD_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) AS place FROM g)
    SELECT * FROM (SELECT position, id, concat_ws('; ', CASE WHEN trim(coalesce(question, '')) = '' THEN 'missing question' END, CASE WHEN trim(coalesce(gold_source, '')) = '' THEN 'missing gold_source' END,
        CASE WHEN place > 1 THEN 'duplicate id' END, CASE WHEN intent = '' AND len(careers) = 0 THEN 'no expected careers' END, CASE WHEN intent = 'course_rec' AND courses IS NULL THEN 'no expected courses' END,
        CASE WHEN intent = 'skills_gap' AND len(careers) = 0 THEN 'no career' END) AS errors FROM r) WHERE errors <> ''"""
)
def gold_case_errors(m: Model) -> DataFrame:
    d = F.col("doc_id")
    rows = m.table("documents").select(
        d.alias("position"),
        F.concat(F.lit("g"), d - d % 2 * (d % 3)).alias("id"),
        F.get(F.array(*(F.lit(x) for x in ("", "course_rec", "skills_gap", "other"))), (d % 4).cast("int")).alias("intent"),
        F.when(d % 11 == 0, " ").otherwise(F.col("text")).alias("question"),
        F.when(d % 13 != 0, F.col("source")).alias("gold_source"),
        F.when(d % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("c"))).alias("careers"),
        F.when(d % 6 != 0, F.array(F.lit("k"))).alias("courses"),
    )
    return datasets.gold_errors(rows)


@query(
    """SELECT entity, arg_min(item_id, k) AS item_id, arg_min(text, k) AS text FROM (
        SELECT item_id % 7 AS entity, item_id, text, (CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 0 ELSE 1 END) * 1e12 + length(text) * 1e6 + item_id AS k FROM benchmark) GROUP BY 1"""
)
def representative_queries(m: Model) -> DataFrame:
    rows = m.table("benchmark").withColumn("entity", F.col("item_id") % 7)
    return datasets.representative(rows, "entity", "text", "item_id")


@query(
    """SELECT item_code, t.place, replace(t.text, '{name}', item_name) AS text FROM competency
    CROSS JOIN (VALUES (0, 'Which courses teach {name}?'), (1, 'How do I learn {name}, and why {name}?')) AS t(place, text)""",
    model=True,
)
def template_questions(m: Model) -> DataFrame:
    return datasets.from_templates(m.competency, ["Which courses teach {name}?", "How do I learn {name}, and why {name}?"], "item_code", "item_name")


@query("SELECT doc_id FROM documents WHERE (CASE WHEN doc_id % 2 = 0 THEN [lang, source] ELSE [lang] END) @> ['en'] AND NOT list_has_any(CASE WHEN doc_id % 2 = 0 THEN [lang, source] ELSE [lang] END, ['src1', 'src2'])")
def tag_filter(m: Model) -> DataFrame:
    tags = F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(F.array("lang"))
    include, exclude = F.array(F.lit("en")), F.array(F.lit("src1"), F.lit("src2"))
    return m.table("documents").filter((F.size(F.array_except(include, tags)) == 0) & ~F.arrays_overlap(tags, exclude)).select("doc_id")


# plans and reports


@query(
    f"""WITH missing AS (SELECT career_code, item_code FROM need n WHERE career_code IN (SELECT career_code FROM known) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.career_code = n.career_code AND k.item_code = n.item_code)),
    gone AS (SELECT DISTINCT career_code, lower(trim(item_name)) AS low FROM missing JOIN competency USING (item_code)),
    mine AS (SELECT n.*, item_name FROM need n JOIN known USING (career_code, item_code) JOIN competency USING (item_code)),
    r AS (SELECT career_code, item_code, item_name, row_number() OVER (PARTITION BY career_code ORDER BY {PRIORITY_SQL}, item_name, item_code) AS rank FROM mine x
          WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.career_code = x.career_code AND g.low = lower(trim(x.item_name))))
    SELECT career_code, rank, item_code, item_name FROM r WHERE rank <= 3""",
    model=True,
)
def weak_skills(m: Model) -> DataFrame:
    return graph.weak_skills(m.need, m.known, m.competency, graph.gap_split(m.need, m.known, missing=True))


@query(
    f"""WITH {TOP_COURSES_SQL.format(k=1)},
    r AS (SELECT career_code, kind, item_name, row_number() OVER (PARTITION BY career_code, kind ORDER BY {PRIORITY_SQL}, item_name, item_code) AS rank FROM need JOIN competency USING (item_code)),
    lines AS (SELECT career_code, {KIND_SQL} AS place, kind || ': ' || string_agg(item_name, ', ' ORDER BY rank) AS line FROM r WHERE rank <= 12 GROUP BY 1, kind),
    named AS (SELECT DISTINCT career_code, course_name FROM need JOIN top_courses USING (item_code)),
    taught AS (SELECT career_code, 1000 AS place, 'Courses: ' || string_agg(course_name, ', ' ORDER BY course_name) AS line FROM (SELECT *, row_number() OVER (PARTITION BY career_code ORDER BY course_name) AS rn FROM named) WHERE rn <= 8 GROUP BY 1),
    whole AS (SELECT career_code, string_agg(line, chr(10) ORDER BY place) AS l FROM (SELECT * FROM lines UNION ALL SELECT * FROM taught) GROUP BY 1)
    SELECT career_code, concat_ws(chr(10), career_name, l) AS context FROM career LEFT JOIN whole USING (career_code)""",
    model=True,
)
def career_context(m: Model) -> DataFrame:
    return graph.context_lines(m.career, m.need, m.competency, graph.top_courses(m.teach, m.course, 1, m.seed_course))


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, n AS n_rows, round(mean, 6) AS mean, value AS p95, most FROM r JOIN (SELECT event_type, avg(value) AS mean, max(value) AS most FROM events GROUP BY 1) USING (event_type) WHERE i = round_even(0.95 * (n - 1), 0)"""
)
def latency_summary(m: Model) -> DataFrame:
    return metrics.latency_summary(m.table("events"), "event_type", "value")


@query(
    """WITH r AS (SELECT toxic, quality, lang, n_chars FROM labels JOIN documents USING (doc_id))
    SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(toxic) = 0 THEN 'toxic' ELSE 'all' END AS scope, CASE WHEN grouping(lang) = 0 THEN lang WHEN grouping(toxic) = 0 THEN coalesce(CAST(toxic AS VARCHAR), 'unknown') ELSE 'all' END AS value,
           count(*) AS n_rows, round(avg(quality), 6) AS quality, round(avg(n_chars), 6) AS n_chars FROM r GROUP BY GROUPING SETS ((), (lang), (toxic))"""
)
def scoped_means(m: Model) -> DataFrame:
    rows = m.table("labels").join(m.table("documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return metrics.scoped_means(rows, ["lang", "toxic"], ["quality", "n_chars"])


@query(
    """WITH l AS (SELECT page_id % 10 AS shard, len(list_filter(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1), lambda x: starts_with(x, 'http'))) AS a, len(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1)) AS b FROM pages)
    SELECT shard, CAST(sum(a) AS BIGINT) AS part, CAST(sum(b) AS BIGINT) AS whole, round(CASE WHEN sum(b) > 0 THEN sum(a) / sum(b) ELSE 1.0 END, 6) AS ratio FROM l GROUP BY 1"""
)
def citation_ratio(m: Model) -> DataFrame:
    from graphloom.functions import text as T

    rows = m.table("pages").select((F.col("page_id") % 10).alias("shard"), T.links(F.col("html")).alias("l"))
    return metrics.ratio_of_sums(rows, "shard", F.size(F.filter("l", lambda x: x.startswith("http"))).cast("long"), F.size("l").cast("long"))


@query(
    """WITH r AS (SELECT toxic = 1 AS x, n_chars AS v FROM labels JOIN documents USING (doc_id) WHERE n_chars IS NOT NULL),
    c AS (SELECT v, count(*) FILTER (x) AS x, count(*) FILTER (NOT x) AS y FROM r GROUP BY 1),
    s AS (SELECT x, y, x * (coalesce(sum(y) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + y / 2) AS u FROM c)
    SELECT CAST(sum(x) AS BIGINT) AS nx, CAST(sum(y) AS BIGINT) AS ny, (SELECT round(avg(v) FILTER (x) - avg(v) FILTER (NOT x), 6) FROM r) AS mean_delta, round(2 * sum(u) / (sum(x) * sum(y)) - 1, 6) AS effect FROM s"""
)
def group_effect(m: Model) -> DataFrame:
    rows = m.table("labels").join(m.table("documents").select("doc_id", "n_chars"), "doc_id")
    return metrics.group_effect(rows, F.col("toxic") == 1, "n_chars")


@query(
    """WITH w AS (SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'view'), 6) AS view, round(avg(value) FILTER (event_type = 'error'), 6) AS error FROM events GROUP BY 1),
    p AS (SELECT 'click' AS winner, 'view' AS loser, user_id FROM w WHERE click >= 50 AND view <= 50 UNION ALL SELECT 'click', 'error', user_id FROM w WHERE click >= 50 AND error <= 50
          UNION ALL SELECT 'view', 'click', user_id FROM w WHERE view >= 50 AND click <= 50 UNION ALL SELECT 'view', 'error', user_id FROM w WHERE view >= 50 AND error <= 50
          UNION ALL SELECT 'error', 'click', user_id FROM w WHERE error >= 50 AND click <= 50 UNION ALL SELECT 'error', 'view', user_id FROM w WHERE error >= 50 AND view <= 50)
    SELECT winner, loser, count(*) AS n_wins, string_agg(user_id, ',' ORDER BY user_id) AS cases FROM p GROUP BY 1, 2"""
)
def error_report(m: Model) -> DataFrame:
    made = metrics.error_report(m.table("events"), "user_id", "event_type", ["click", "view", "error"], "value", 50, 50)
    return made.withColumn("cases", F.array_join(F.col("cases").cast("array<string>"), ","))


@query()
def plan_months(m: Model) -> DataFrame:
    """Six months of courses for each person with a gap; the topics of a month are names of what is missing."""
    gap = graph.gap_split(m.need, m.known, missing=True).join(m.competency.select("item_code", "item_name"), "item_code")
    numbered = graph.chunk_months(gap, "career_code", ["item_code"], 6)
    best = graph.top_courses(m.teach, m.course, 2, m.seed_course)
    listed = gap.select("career_code", "item_code", "item_name").join(best, "item_code")
    courses = listed.select("career_code", F.col("item_name").alias("skill"), (F.col("item_code") * 10 + F.col("rank")).alias("place"), F.col("course_name").alias("title"))
    topics = numbered.select("career_code", (F.col("month") - 1).alias("month"), F.col("item_name").alias("topic")).distinct()
    return graph.allocate_months(courses, topics, "career_code", 6, 2)


@query(
    """WITH listed AS (SELECT s_suppkey AS key, CASE s_suppkey % 3 WHEN 0 THEN upper(s_name) WHEN 1 THEN 'All of ' || s_name ELSE substr(s_name, 10) END AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'a.org/courses' ELSE 'a.org/x' END AS url FROM supplier),
    graph_ AS (SELECT lower(trim(course_name)) AS low, arg_min(coalesce(url, ''), course_code) AS url, min(course_code) AS position FROM course WHERE course_code % 5 <> 0 GROUP BY 1),
    met AS (SELECT key, title, l.url, arg_min(g.url, CASE WHEN low = lower(trim(title)) THEN -1 ELSE position END) AS found FROM listed l LEFT JOIN graph_ g ON contains(low, lower(trim(title))) OR contains(lower(trim(title)), low) GROUP BY 1, 2, 3)
    SELECT key, title, coalesce(nullif(trim(found), ''), CASE WHEN url <> 'a.org/courses' THEN url END) AS url FROM met""",
    model=True,
)
def overlaid_urls(m: Model) -> DataFrame:
    form = F.col("course_code") % 3
    title = F.when(form == 0, F.upper("course_name")).when(form == 1, F.concat(F.lit("All of "), "course_name")).otherwise(F.substring("course_name", 10, 100))
    listed = m.course.select(F.col("course_code").alias("key"), title.alias("title"), F.when(F.col("course_code") % 2 == 0, "a.org/courses").otherwise("a.org/x").alias("url"))
    known = m.course.filter("course_code % 5 <> 0").select(F.col("course_name").alias("title"), F.coalesce("url", F.lit("")).alias("url"), F.col("course_code").alias("position"))
    return graph.overlay_urls(listed, known)
