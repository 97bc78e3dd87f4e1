"""What is said about a graph answer: notes, blocks, badges, citations, routes of a question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T

#: Wording of notes and badges.
HAS_NOTE, FIRST_NOTE = "Đã có %s", "Nên học %s trước %s"
CORE_BADGE, GROUP_BADGE, COVERAGE_BADGE = "Cốt lõi", "Nhóm %s", "Bao phủ %s"
#: Patterns of citations and of graph tokens that a reply should not show.
CITATION = r"(?i)\[Course:\s*([^\]]+)\]"
RELATION_LINE = r"(?im)^\s*(?:###?\s*)?(?:liên quan|outgoing|incoming).*$"
RELATION_TOKEN = r"(?i)\b(?:BUILT_ON|VALIDATES|SUPPORTS|REQUIRES(?:_KNOWLEDGE)?|PREFERS_LANG)\b"
ITEM_CODE = r"\([A-Z]_[A-Z0-9_]+\)"
#: A question asks for relations of competencies, compares them, or asks for courses (with weights).
RELATION_SIGNS = (
    r"(can|phai|nen)\s+(hoc|biet|co)\s+.*(truoc|tien quyet)",
    r"(chung chi|cert)\s+.*(nao|gi)",
    r"(lien quan|chung nhan|validates?).*(platform|nen tang)",
    r"(ho tro|supports?).*(ngon ngu|language)",
    r"dung\s+(ngon ngu|language)\s+gi",
    r"built\s*on|xay\s+tren",
    r"prerequisite|tien quyet|hoc truoc|can biet gi",
    r"validate|chung nhan",
    r"(ngon ngu|language)\s+nao",
)
COMPARISONS = (r"truoc\s+hay", r"hay\s+.*\s+truoc", r"so\s+voi", r"cai nao truoc")
COURSE_SIGNS = (
    (r"khoa\s*hoc|\bkhoa\b|\bcourse\b", 2.0),
    (r"goi\s*y|de\s*xuat|recommend", 1.5),
    (r"hoc\s+.+\s+(tu\s+dau|cho\s+nguoi\s+moi|beginner)", 1.5),
    (r"hoc\s+\w+.*\s+cho\b", 1.5),
    (r"tai\s*lieu|\bresource\b|lo\s*trinh\s+hoc", 1.0),
)


def prerequisite_notes(missing: DataFrame, known: DataFrame, ordered: DataFrame) -> DataFrame:
    """What the missing competencies (career_code, item_code, item_name) are ordered after outside the gap: a note that
    it is there, or that it comes first. ``ordered``: item_code, prerequisite_code, prerequisite_name."""
    keys = ["career_code", "prerequisite_code"]
    rows = missing.join(ordered.select("item_code", "prerequisite_code", "prerequisite_name").distinct(), "item_code")
    outside = rows.join(missing.select("career_code", F.col("item_code").alias("prerequisite_code")), keys, "left_anti")
    has = known.select("career_code", F.col("item_code").alias("prerequisite_code"), F.lit(True).alias("has"))
    name = F.coalesce("prerequisite_name", F.col("prerequisite_code").cast("string"))
    note = F.when(F.col("has"), F.format_string(HAS_NOTE, name)).otherwise(F.format_string(FIRST_NOTE, name, "item_name"))
    return outside.join(has, keys, "left").select("career_code", "item_code", "prerequisite_code", F.coalesce("has", F.lit(False)).alias("has"), note.alias("note"))


def merged_gaps(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """One competency for each of ``keys``, kind and code, or lower-case name where it has no code: the first by
    ``position``. Gaps that were found type by type become one list."""
    same = F.coalesce(F.col("item_code").cast("string"), F.lower("item_name"))
    first = F.min_by(F.struct("item_code", "item_name", position), F.col(position))
    return rows.groupBy(*keys, "kind", same.alias("same")).agg(first.alias("f")).select(*keys, "kind", "f.*")


def course_blocks(asked: DataFrame, skills: DataFrame, courses: DataFrame, owner: str) -> DataFrame:
    """A block for each skill asked for (``owner``, place, skill), in the order asked, also where no course is known.
    A skill of the owner has the same name, or the same without regard to case; ``courses``: item_code, rank, course_name."""
    wanted = asked.select(owner, "place", F.trim("skill").alias("skill")).filter("skill <> ''").withColumn("low_name", F.lower("skill"))
    named = skills.select(owner, F.lower("item_name").alias("low_name"), "item_code", "item_name", "priority_group")
    met = wanted.join(named, [owner, "low_name"], "left")
    best = F.min_by(F.struct("item_code", "priority_group"), F.struct(F.col("item_name") != F.col("skill"), "item_code"))
    chosen = met.groupBy(owner, "place", "skill").agg(best.alias("b")).select(owner, "place", "skill", "b.*")
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "course_name"))), lambda c: c["course_name"])
    listed = courses.groupBy("item_code").agg(F.array_join(names, "|").alias("courses"))
    return chosen.join(listed, "item_code", "left").select(owner, "place", "skill", "priority_group", F.col("courses").isNotNull().alias("found"), F.coalesce("courses", F.lit("")).alias("courses"))


def lines_by_kind(rows: DataFrame, owner: str, order: Sequence[Column], kind_rank: Column) -> DataFrame:
    """The names of each owner and kind in one line, the kinds numbered in a fixed order; other kinds come last by name."""
    placed = rows.withColumn("at", F.struct(*order))
    names = F.transform(F.array_sort(F.collect_list(F.struct("at", "item_name"))), lambda r: r["item_name"])
    lines = placed.groupBy(owner, "kind").agg(F.array_join(names, "|").alias("names"))
    return lines.select(owner, F.row_number().over(Window.partitionBy(owner).orderBy(kind_rank, "kind")).alias("place"), "kind", "names")


def priority_badge(priority: Column) -> Column:
    return F.when(priority == 1, CORE_BADGE).when(priority.isNotNull(), F.format_string(GROUP_BADGE, priority.cast("string")))


def coverage_badge(level: Column) -> Column:
    return F.when(level.isNotNull(), F.format_string(COVERAGE_BADGE, level.cast("string")))


def confidence(found: Column, n_items: Column, fallback: Column, route: Column) -> Column:
    """How far an answer can be trusted, from 0 to 1."""
    score = F.when(found, 0.45).otherwise(0.0) + F.least(F.lit(0.35), 0.05 * F.greatest(n_items, F.lit(0)))
    score += F.when(route == "high", 0.15).when(route == "low", -0.1).otherwise(0.0) - F.when(fallback, 0.25).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def citations(text: Column) -> Column:
    """The course codes that a text cites, in upper case, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), 1), lambda c: F.upper(stripped(c)))


def without_citations(text: Column, allowed: Column) -> Column:
    """The text without citations of codes that are not allowed; as it is where no codes are known."""
    whole = F.regexp_extract_all(text, F.lit(CITATION), 0)
    keep = F.transform(F.arrays_zip(whole.alias("w"), citations(text).alias("c")), lambda p: F.when(F.array_contains(allowed, p["c"]), p["w"]).otherwise(""))
    between = F.split(text, CITATION, -1)
    joined = F.array_join(F.zip_with(between, keep, lambda b, k: F.concat(b, F.coalesce(k, F.lit("")))), "")
    return F.when(F.size(allowed) > 0, stripped(F.regexp_replace(joined, r"\n{3,}", "\n\n"))).otherwise(text)


def without_graph_tokens(text: Column) -> Column:
    """A reply on relations without escapes, section heads, relation types and item codes."""
    out = F.replace(F.replace(text, F.lit("\\_"), F.lit("_")), F.lit("\\*"), F.lit("*"))
    for pattern in (RELATION_LINE, RELATION_TOKEN, ITEM_CODE):
        out = F.regexp_replace(out, pattern, "")
    return stripped(F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), "  +", " "))


def difficulty(question: Column, entities: Column) -> Column:
    """trivial where the question holds one of the entities word for word, else paraphrased; unknown without a question."""
    plain = lambda c: T.normalised(T.without_marks(F.coalesce(c, F.lit(""))))
    held = F.exists(entities, lambda e: (F.length(plain(e)) >= 2) & plain(question).contains(plain(e)))
    return F.when(plain(question) == "", "unknown").when(F.coalesce(held, F.lit(False)), "trivial").otherwise("paraphrased")


def fits_any(name: Column, code: Column, terms: Sequence[str], codes: Sequence[int]) -> Column:
    """The name holds one of the terms or is part of one, without regard to case, or the code is one of ``codes``. An
    empty name is part of every term; a null one fits none."""
    low = F.lower(name)
    fits = code.isin(*codes) if codes else F.lit(False)
    for term in terms:
        fits |= low.contains(term.lower()) | F.lit(term.lower()).contains(low)
    return F.coalesce(fits, F.lit(False))


def route_scores(texts: DataFrame, text: str, n_competencies: Column, n_careers: Column, threshold: float = 3.0) -> DataFrame:
    """``texts`` with relation (a sign of a question on relations), comparison, course_score, relation_score and routed.
    The number of competencies and careers that a text names comes from an alias scan."""
    probe = F.lower(T.without_marks(F.coalesce(text, F.lit(""))))
    long = F.length(T.trimmed(F.coalesce(text, F.lit(""))))
    signs = lambda patterns: F.greatest(F.lit(False), *(F.rlike(probe, F.lit(T.ascii_pattern(p))) for p in patterns))
    rows = texts.withColumns({"relation": (long >= 6) & signs(RELATION_SIGNS), "comparison": signs(COMPARISONS), "n_items": n_competencies, "n_careers": n_careers})
    rel, cmp, items, careers = F.col("relation"), F.col("comparison"), F.col("n_items"), F.col("n_careers")
    add = lambda condition, points: F.when(condition, points).otherwise(0.0)
    course = sum((add(F.rlike(probe, F.lit(T.ascii_pattern(p))), points) for p, points in COURSE_SIGNS), F.lit(0.0)) - add(rel, 2.0) - add(cmp, 2.0)
    base = add(rel, 3.0) + add((items >= 2) & (rel | cmp), 2.0) + add((items >= 1) & cmp, 2.0) + add(items >= 1, 1.0)
    rows = rows.withColumns({"course_score": F.when(long > 0, course).otherwise(0.0), "base": F.when(long >= 4, base).otherwise(0.0)})
    # a career in the text speaks against relations, unless much else speaks for them
    rows = rows.withColumn("base", F.when(long >= 4, F.col("base") - add((careers > 0) & (F.col("base") < 3), 1.0) + add((careers > 0) & (items >= 2) & rel, 1.0)).otherwise(0.0))
    capped = (long >= 4) & (F.col("course_score") >= 2) & (F.col("base") < 4)
    score = F.when(capped, F.least(F.col("base"), F.lit(threshold - 0.5))).otherwise(F.col("base"))
    routed = (F.col("relation_score") >= threshold) & ((F.col("course_score") < 2) | rel)
    return rows.withColumn("relation_score", score).withColumn("routed", routed).drop("base")


def chosen_meaning(asked: DataFrame, candidates: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """The meaning of an ambiguous abbreviation: the first candidate (abbreviation, place, meaning, keys) one of whose
    keys is in the context, else the default, else the first candidate; null for an unknown abbreviation."""
    rows = asked.join(candidates, "abbreviation", "left")
    hit = F.exists("keys", lambda k: (F.length(k) > 0) & T.normalised(F.coalesce("context", F.lit(""))).contains(T.normalised(k)))
    best = rows.groupBy(key, "abbreviation").agg(F.min_by("meaning", F.when(hit, F.col("place"))).alias("by_context"), F.min_by("meaning", "place").alias("first"), F.max(hit).alias("met"))
    given = best.join(defaults.select("abbreviation", "default"), "abbreviation", "left")
    return given.select(key, F.when(F.col("met"), F.col("by_context")).otherwise(F.coalesce("default", "first")).alias("meaning"))


def paraphrases(rows: DataFrame, key: str, name: str, names: str, templates: Sequence[str], most: int) -> DataFrame:
    """key, place, text: templates with ``{k}``, each with the next of the names in ``names``, in turn; the name itself
    where there are none."""
    listed = F.array(*(F.lit(t) for t in templates[:most]))
    each = rows.select(key, F.when(F.size(names) > 0, F.col(names)).otherwise(F.array(name)).alias("ks"), F.posexplode(listed).alias("place", "template"))
    return each.select(key, "place", F.replace("template", F.lit("{k}"), F.get("ks", F.pmod("place", F.size("ks")))).alias("text"))


def route_fields(raw: Column) -> Column:
    """intent and career of a router's JSON reply, with or without a code fence or words around its object; null
    fields where it is no JSON."""
    bare = stripped(raw)
    unfenced = F.when(bare.startswith("```"), stripped(F.regexp_replace(bare, r"(?im)^```(?:json)?\s*|\s*```$", ""))).otherwise(bare)
    whole = F.coalesce(F.nullif(F.regexp_extract(unfenced, r"(?s)\{.*\}", 0), F.lit("")), unfenced)
    found = F.from_json(whole, "intent string, entities struct<career string>")
    return F.struct(found["intent"].alias("intent"), found["entities"]["career"].alias("career"))
