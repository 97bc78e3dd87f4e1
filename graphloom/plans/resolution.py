"""Queries from free text to entities. The texts asked are a stated set: those of the rows whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import graph, resolve, retrieval
from graphloom.plans.catalogue import TOP_COURSES_SQL
from graphloom.plans.registry import query
from graphloom.sources.model import Model


def turn(key: str, n: int) -> Column:
    """Which of ``n`` forms the row of a stated set takes."""
    return F.pmod(F.expr(f"{key} div 100"), F.lit(n))


CAREER_NEEDLES_SQL = """needles AS (SELECT CASE (c_custkey // 100) % 4 WHEN 0 THEN ' ' || upper(c_name) WHEN 1 THEN substr(c_name, 9) WHEN 2 THEN 'see ' || c_name || ' please'
                           ELSE 'nobody ' || c_custkey END AS needle FROM customer WHERE c_custkey % 100 = 0)"""


def career_needles(m: Model) -> DataFrame:
    form, name = turn("career_code", 4), F.col("career_name")
    text = F.when(form == 0, F.concat(F.lit(" "), F.upper(name))).when(form == 1, F.substring(name, 9, 100)).when(form == 2, F.concat(F.lit("see "), name, F.lit(" please"))).otherwise(F.concat(F.lit("nobody "), "career_code"))
    return m.career.filter("career_code % 100 = 0").select(text.alias("needle"))


@query(
    f"""WITH {CAREER_NEEDLES_SQL},
    tiers AS (
        SELECT needle, career_code, career_name,
               CASE WHEN lower(trim(career_name)) = lower(trim(needle)) THEN 0 WHEN contains(lower(trim(career_name)), lower(trim(needle))) THEN 1
                    WHEN contains(lower(trim(needle)), lower(trim(career_name))) THEN 2 END AS tier
        FROM career CROSS JOIN needles)
    SELECT needle, career_code, career_name, tier FROM (
        SELECT *, row_number() OVER (PARTITION BY needle ORDER BY tier, length(career_name), career_code) AS rn FROM tiers WHERE tier IS NOT NULL)
    WHERE rn = 1""",
    model=True,
)
def career_name_tier(m: Model) -> DataFrame:
    return resolve.best_match(m.career, career_needles(m), "career_code", "career_name")


ASKED_SQL = """asked AS (SELECT p_partkey AS query_id, CASE (p_partkey // 100) % 5 WHEN 0 THEN upper(substr(p_name, 1, 1)) || substr(p_name, 2)
                           WHEN 1 THEN 'which course teaches ' || upper(string_split(p_name, ' ')[2]) || ' or SQL' WHEN 2 THEN substr(p_name, 1, 4)
                           WHEN 3 THEN 'qz' || p_partkey ELSE substr(p_name, 1, 3) || substr(p_name, 5) END AS text FROM part WHERE p_partkey % 100 = 0)"""


def asked_items(m: Model) -> DataFrame:
    form, name = turn("item_code", 5), F.col("item_name")
    word = F.element_at(F.split(name, " "), 2)
    text = (
        F.when(form == 0, F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 100)))
        .when(form == 1, F.concat(F.lit("which course teaches "), F.upper(word), F.lit(" or SQL")))
        .when(form == 2, F.substring(name, 1, 4))
        .when(form == 3, F.concat(F.lit("qz"), "item_code"))
        .otherwise(F.concat(F.substring(name, 1, 3), F.substring(name, 5, 100)))
    )
    return m.competency.filter("item_code % 100 = 0").select(F.col("item_code").alias("query_id"), text.alias("text"))


#: First search term of each question that a name holds: acronyms, or the text itself.
MATCH_SQL = f"""{ASKED_SQL},
    terms AS (SELECT query_id, text, unnest(CASE WHEN len(regexp_extract_all(text, '\\b[A-Z]{{3,}}\\b')) > 0
                  THEN list_distinct(list_concat(regexp_extract_all(text, '\\bSQL\\b'), regexp_extract_all(text, '\\b[A-Z]{{3,}}\\b'))) ELSE [trim(text)] END) AS term FROM asked),
    placed AS (SELECT *, CASE WHEN term = 'SQL' THEN 0 ELSE 1 END AS place FROM terms),
    met AS (SELECT query_id, term, place, item_code, item_name, row_number() OVER (
                PARTITION BY query_id, term ORDER BY lower(trim(item_name)) <> lower(trim(term)), length(item_name) DESC, item_code) AS rn
            FROM placed JOIN competency ON lower(trim(item_name)) = lower(trim(term)) OR (length(trim(term)) >= 2 AND contains(lower(trim(item_name)), lower(trim(term))))),
    matched AS (SELECT query_id, term, item_code, item_name FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rp FROM met WHERE rn = 1) WHERE rp = 1)"""


@query(f"WITH {MATCH_SQL} SELECT * FROM matched", model=True)
def competency_match(m: Model) -> DataFrame:
    return resolve.match_competencies(m.competency, asked_items(m))


@query(
    f"""WITH {MATCH_SQL}, {TOP_COURSES_SQL.format(k=4)}
    SELECT query_id, term, item_code, item_name, rank, course_code, course_name, organization, level, coverage_level, is_seed FROM matched LEFT JOIN top_courses USING (item_code)""",
    model=True,
)
def course_rec_text(m: Model) -> DataFrame:
    """The courses of the competency that each question asks for."""
    found = resolve.match_competencies(m.competency, asked_items(m))
    return found.join(graph.top_courses(m.teach, m.course, 4, m.seed_course), "item_code", "left").select(
        "query_id", "term", "item_code", "item_name", "rank", "course_code", "course_name", "organization", "level", "coverage_level", "is_seed"
    )


@query(
    f"""WITH {MATCH_SQL}, {TOP_COURSES_SQL.format(k=1000000)}
    SELECT query_id, item_code, row_number() OVER (PARTITION BY query_id ORDER BY t.rank) AS place, course_code, coverage_level
    FROM matched JOIN competency USING (item_code) JOIN top_courses t USING (item_code) WHERE 'TEACH_' || kind = 'TEACH_SMALL'""",
    model=True,
)
def course_rec_by_type(m: Model) -> DataFrame:
    """The same for one relation type, without a fuzzy step."""
    small = m.competency.filter(F.concat(F.lit("TEACH_"), "kind") == "TEACH_SMALL").select("item_code")
    found = resolve.match_competencies(m.competency, asked_items(m)).join(small, "item_code")
    courses = found.join(graph.top_courses(m.teach, m.course, 1_000_000, m.seed_course), "item_code")
    return courses.select("query_id", "item_code", F.col("rank").alias("place"), "course_code", "coverage_level")


@query()
def course_rec_fuzzy(m: Model) -> DataFrame:
    """The most similar name for the questions that no name fits."""
    asked = asked_items(m)
    rest = asked.join(resolve.match_competencies(m.competency, asked).select("query_id"), "query_id", "left_anti")
    names = m.competency.select(F.col("item_code").alias("code"), F.col("item_name").alias("name"))
    return resolve.fuzzy_top(rest.select(F.col("text").alias("needle")), names, 78.0)


@query()
def fuzzy_top1(m: Model) -> DataFrame:
    names = m.competency.select(F.col("item_code").alias("code"), F.col("item_name").alias("name"))
    return resolve.fuzzy_top(asked_items(m).select(F.col("text").alias("needle")), names, 60.0)


@query()
def career_suggestions(m: Model) -> DataFrame:
    """Career names to offer for what was typed."""
    return resolve.suggestions(career_needles(m), m.career.select(F.col("career_name").alias("name")))


# aliases

ALIASES_SQL = """alias_table AS (SELECT DISTINCT ['career', 'competency', 'soft_skill', 'subject'][item_id % 4 + 1] AS kind,
                                 lower(string_split(text, ' ')[item_id % 3 + 1]) AS alias, 'B' || item_id AS canonical FROM benchmark
                    WHERE length(string_split(text, ' ')[item_id % 3 + 1]) >= CASE item_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 3 END)"""


def aliases(m: Model) -> DataFrame:
    """A catalogue: one of the first words of each benchmark item."""
    word = F.get(F.split("text", " "), (F.col("item_id") % 3).cast("int"))
    kind = F.get(F.array(*(F.lit(k) for k in resolve.LEAST_ALIAS)), (F.col("item_id") % 4).cast("int"))
    return m.table("benchmark").select(kind.alias("kind"), F.lower(word).alias("alias"), F.concat(F.lit("B"), "item_id").alias("canonical"))


@query(
    f"""WITH {ALIASES_SQL}
    SELECT doc_id, kind, canonical, min(alias) AS alias FROM documents JOIN alias_table
      ON CASE WHEN length(alias) >= 4 THEN contains(lower(text), alias)
              ELSE regexp_matches(lower(text), '(^|[^a-z0-9])' || regexp_escape(alias) || '($|[^a-z0-9])') END
    GROUP BY ALL"""
)
def alias_scan(m: Model) -> DataFrame:
    return resolve.alias_scan(m.table("documents"), aliases(m))


@query(
    f"""WITH {ALIASES_SQL},
    hits AS (SELECT doc_id, kind, canonical, alias, row_number() OVER (PARTITION BY doc_id, kind ORDER BY length(alias) DESC, alias, canonical) AS rn
             FROM documents JOIN alias_table ON CASE WHEN length(alias) >= 4 THEN contains(lower(text), alias)
                  ELSE regexp_matches(lower(text), '(^|[^a-z0-9])' || regexp_escape(alias) || '($|[^a-z0-9])') END),
    capped AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, rn) AS place FROM hits WHERE rn <= CASE kind WHEN 'career' THEN 6 ELSE 4 END),
    names AS (SELECT doc_id, string_agg(canonical, ' | ' ORDER BY place) AS n FROM capped GROUP BY 1)
    SELECT doc_id AS query_id, CASE WHEN n IS NULL THEN text ELSE text || chr(10) || n END AS expanded FROM documents LEFT JOIN names USING (doc_id)"""
)
def query_expansion(m: Model) -> DataFrame:
    found = resolve.alias_scan(m.table("documents"), aliases(m))
    return retrieval.expanded_query(m.table("documents"), found, {"career": 6, "competency": 4, "soft_skill": 4, "subject": 4})


RESOLVE_SQL = """needles AS (SELECT item_code, CASE (item_code // 100) % 3 WHEN 0 THEN ' p_' || item_code WHEN 1 THEN string_split(item_name, ' ')[2] || ' ' || string_split(item_name, ' ')[1]
                                ELSE 'P_none' || item_code END AS needle, CASE WHEN (item_code // 100) % 2 = 0 THEN 'CT_FRAM' END AS hint FROM competency WHERE item_code % 100 = 0)"""


def typed_needles(m: Model) -> DataFrame:
    form, words = turn("item_code", 3), F.split("item_name", " ")
    text = F.when(form == 0, F.concat(F.lit(" p_"), "item_code")).when(form == 1, F.concat_ws(" ", words[1], words[0])).otherwise(F.concat(F.lit("P_none"), "item_code"))
    return m.competency.filter("item_code % 100 = 0").select(text.alias("needle"), F.when(turn("item_code", 2) == 0, "CT_FRAM").alias("hint")).distinct()


def coded_catalogue(m: Model) -> DataFrame:
    return m.competency.select(F.concat(F.lit("P_"), "item_code").alias("code"), F.col("item_name").alias("name"), "type_code")


def turned_names(m: Model) -> DataFrame:
    """Aliases: the words of each name the other way round."""
    words = F.split("item_name", " ")
    return m.competency.select(F.concat_ws(" ", words[1], words[0]).alias("alias"), F.col("item_name").alias("canonical")).distinct()


@query(
    f"""WITH {RESOLVE_SQL}, asked AS (SELECT DISTINCT needle, hint FROM needles),
    exact AS (SELECT needle, 'P_' || item_code AS code, item_name AS name, type_code, 100.0 AS score, 'exact' AS source FROM asked JOIN competency ON upper(trim(needle)) = 'P_' || item_code),
    by_alias AS (SELECT needle, 'P_' || item_code AS code, item_name AS name, type_code, CASE WHEN hint = type_code THEN 105.0 ELSE 95.0 END AS score, 'alias' AS source
                 FROM asked JOIN competency ON needle = string_split(item_name, ' ')[2] || ' ' || string_split(item_name, ' ')[1]),
    candidates AS (SELECT needle, code, name, type_code, max(score) AS score, source FROM (SELECT * FROM exact UNION ALL SELECT * FROM by_alias) GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY score DESC, name, code) AS rank FROM candidates)
    SELECT * FROM ranked WHERE rank <= 5""",
    model=True,
)
def competency_resolve_direct(m: Model) -> DataFrame:
    return resolve.best_candidates(resolve.exact_and_alias(typed_needles(m), coded_catalogue(m), turned_names(m)))


@query()
def competency_resolve(m: Model) -> DataFrame:
    return resolve.resolve_competencies(typed_needles(m), coded_catalogue(m), turned_names(m))


@query()
def ambiguous_competencies(m: Model) -> DataFrame:
    return resolve.ambiguous(resolve.resolve_competencies(typed_needles(m), coded_catalogue(m), turned_names(m)))


@query(
    """WITH needles AS (SELECT c_custkey AS k, c_name AS name, CASE (c_custkey // 100) % 4 WHEN 0 THEN upper(c_name) WHEN 1 THEN 'alias of ' || c_custkey WHEN 2 THEN 'ab' || (c_custkey // 100) ELSE 'none' || c_custkey END AS needle
                        FROM customer WHERE c_custkey % 100 = 0)
    SELECT needle, name, CASE (k // 100) % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'alias' ELSE 'abbreviation' END AS source FROM needles
    WHERE (k // 100) % 4 IN (0, 1) OR ((k // 100) % 4 = 2 AND length(needle) <= 6)"""
)
def career_match(m: Model) -> DataFrame:
    form = turn("career_code", 4)
    text = F.when(form == 0, F.upper("career_name")).when(form == 1, F.concat(F.lit("alias of "), "career_code")).when(form == 2, F.concat(F.lit("ab"), F.expr("career_code div 100"))).otherwise(F.concat(F.lit("none"), "career_code"))
    needles = m.career.filter("career_code % 100 = 0").select(text.alias("needle"))
    named = F.col("career_name").alias("canonical")
    long = m.career.select(F.concat(F.lit("Alias of "), "career_code").alias("alias"), named)
    short = m.career.filter("career_code % 100 = 0").select(F.concat(F.lit("AB"), F.expr("career_code div 100")).alias("alias"), named)
    return resolve.match_careers(needles, m.career.select(F.col("career_name").alias("name")), long, short, threshold=None)


KNOWN_SQL = """typed AS (SELECT career_code AS owner, CASE item_code % 4 WHEN 0 THEN 'p_' || item_code WHEN 1 THEN ' Tool: ' || upper(item_name) WHEN 2 THEN 'form ' || (item_code % 7) ELSE 'none' END AS token
                         FROM known JOIN competency USING (item_code)),
    index AS (SELECT item_name AS label, max('P_' || item_code) AS code FROM competency GROUP BY 1)"""


@query(
    f"""WITH {KNOWN_SQL}
    SELECT DISTINCT owner, code FROM (
        SELECT owner, upper(token) AS code FROM typed WHERE regexp_matches(upper(trim(token)), '^[A-Z]{{1,3}}_[A-Z0-9_]+$')
        UNION ALL SELECT owner, unnest(CASE WHEN token = 'form 1' THEN ['P_1', 'P_2'] ELSE ['P_3'] END) FROM typed WHERE token IN ('form 1', 'form 2')
        UNION ALL SELECT owner, code FROM typed JOIN index ON label = lower(substr(token, 8)) WHERE starts_with(token, ' Tool: '))""",
    model=True,
)
def known_skill_codes(m: Model) -> DataFrame:
    form = F.col("item_code") % 4
    token = F.when(form == 0, F.concat(F.lit("p_"), "item_code")).when(form == 1, F.concat(F.lit(" Tool: "), F.upper("item_name"))).when(form == 2, F.concat(F.lit("form "), F.col("item_code") % 7)).otherwise("none")
    typed = m.known.join(m.competency, "item_code").select(F.col("career_code").alias("owner"), token.alias("token"))
    form_map = m.spark.createDataFrame([("form 1", ["P_1", "P_2"]), ("form 2", ["P_3"])], "token string, codes array<string>")
    no_aliases = m.spark.createDataFrame([], "alias string, canonical string")
    return resolve.known_codes(typed, form_map, no_aliases, coded_catalogue(m), T.label)


@query(
    """SELECT doc_id, substr(regexp_replace(lower(lang || ' ' || source || ' ' || coalesce(text, '')), '[^a-z0-9]+', '_', 'g'), 1, 24) AS slug,
           trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS plain, strip_accents(text) AS unmarked FROM documents"""
)
def text_forms(m: Model) -> DataFrame:
    named = F.concat_ws(" ", "lang", "source", F.coalesce("text", F.lit("")))
    return m.table("documents").select("doc_id", T.slug(named, 24).alias("slug"), T.normalised(F.col("text")).alias("plain"), T.without_marks(F.col("text")).alias("unmarked"))
