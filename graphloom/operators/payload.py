"""Advice payloads of several shapes, as one: what a model, a cache or a table gave is JSON of no fixed schema, read as VARIANT.

Every field is taken by its type in the value, so a field of another type counts as absent; a text is a value's own form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import is_generic_url

#: The platform of a course that names none.
NO_PLATFORM = "Gợi ý chung"
#: Keys of older shapes whose lists are missing skills.
OLD_MISSING = ("mandatory", "required", "recommended")

COURSE = "struct<title: string, platform: string, url: string>"


def json(text: Column) -> Column:
    """The VARIANT of a JSON text; null for what is none."""
    return F.try_parse_json(text)


def field(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def is_a(value: Column, kind: str) -> Column:
    """Whether a VARIANT is an OBJECT, ARRAY, STRING and so on; not for null."""
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def truthy(value: Column) -> Column:
    """Whether a VARIANT is neither null, false, 0 nor empty."""
    text = value.cast("string")
    plain = value.isNotNull() & ~F.is_variant_null(value) & ~text.isin("", "false", "0", "0.0", "[]", "{}")
    return F.coalesce(plain, F.lit(False))


def listed(value: Column) -> Column:
    """The elements of a VARIANT list; none of another value."""
    return F.coalesce(F.when(is_a(value, "ARRAY"), value.try_cast("array<variant>")), F.array().cast("array<variant>"))


def texts(value: Column) -> Column:
    """The elements of a list as texts, without nulls and empty ones. A text by itself gives its characters, as a sequence."""
    own = F.transform(F.filter(listed(value), truthy), lambda v: v.cast("string"))
    letters = F.filter(F.split(value.try_cast("string"), ""), lambda c: c != "")
    return F.when(is_a(value, "STRING"), letters).otherwise(own)


def first_truthy(value: Column, *names: str) -> Column:
    """The first of some fields that is neither null nor empty."""
    out = F.lit(None).cast("variant")
    for name in reversed(names):
        out = F.when(truthy(field(value, f"$.{name}")), field(value, f"$.{name}")).otherwise(out)
    return out


def skills_gap(gap: Column) -> Column:
    """missing, weak, soft_skills, certifications: of a list, which is what is missing; of an object with missing or weak; or of
    an older one, whose mandatory, required and recommended skills are missing and whose optional ones are weak."""
    of = {c: texts(field(gap, f"$.{c}")) for c in ("missing", "weak", "soft_skills", "certifications")}
    none = F.array().cast("array<string>")
    # a key counts if it is there, whatever its value
    keys = F.coalesce(F.when(is_a(gap, "OBJECT"), F.json_object_keys(F.to_json(gap))), none)
    new = F.array_contains(keys, "missing") | F.array_contains(keys, "weak")
    old = F.concat(*(texts(field(gap, f"$.{c}")) for c in OLD_MISSING))
    whole = is_a(gap, "ARRAY")
    missing = F.when(whole, texts(gap)).when(new, of["missing"]).otherwise(old)
    weak = F.when(whole, none).when(new, of["weak"]).otherwise(texts(first_truthy(gap, "optional", "weak")))
    rest = {c: F.when(whole, none).otherwise(of[c]) for c in ("soft_skills", "certifications")}
    return F.struct(missing.alias("missing"), weak.alias("weak"), *(c.alias(n) for n, c in rest.items()))


def course(item: Column) -> Column:
    """title, platform, url of a course object by any of their names; null without a title. A URL that names no page of its own is left out."""
    title = F.trim(F.coalesce(first_truthy(item, "title", "course_name", "name").cast("string"), F.lit("")))
    platform = F.trim(F.coalesce(first_truthy(item, "platform", "organization", "provider").cast("string"), F.lit("")))
    url = F.trim(F.coalesce(first_truthy(item, "url").cast("string"), F.lit("")))
    out = F.struct(title.alias("title"), F.when(platform == "", NO_PLATFORM).otherwise(platform).alias("platform"), F.when((url != "") & ~is_generic_url(url), url).alias("url"))
    return F.when(is_a(item, "OBJECT") & (title != ""), out)


def courses(value: Column) -> Column:
    return F.filter(F.transform(listed(value), course), lambda c: c.isNotNull())


def month(value: Column, place: Column) -> Column:
    """A whole number, or a text of one; else the place in the list. A yes counts as 1, as it does where numbers are read."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit(""))
    text = F.trim(value.cast("string"))
    number = F.when(kind == "BOOLEAN", F.when(text == "true", 1).otherwise(0)).when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))
    return F.coalesce(number, place).cast("long")


def roadmap(value: Column) -> Column:
    """month, topics, milestone, courses of each object of a list."""
    placed = F.transform(listed(value), lambda v, i: F.struct(v.alias("v"), (i + 1).alias("place")))
    good = F.filter(placed, lambda p: is_a(p["v"], "OBJECT"))

    def entry(p: Column) -> Column:
        v = p["v"]
        topics = F.transform(listed(field(v, "$.topics")), lambda t: t.cast("string"))
        return F.struct(month(field(v, "$.month"), p["place"]).alias("month"), topics.alias("topics"), F.coalesce(field(v, "$.milestone").cast("string"), F.lit("")).alias("milestone"), courses(field(v, "$.courses")).alias("courses"))

    return F.transform(good, entry)


def dealt(months: Column, flat: Column) -> Column:
    """Courses of a flat list over months that have none: month i gets every n-th from the i-th on."""
    n = F.size(months)

    def entry(m: Column, i: Column) -> Column:
        return m.withField("courses", F.filter(flat, lambda c, j: F.pmod(j, n) == i))

    has = F.exists(months, lambda m: F.size(m["courses"]) > 0)
    return F.when((n > 0) & (F.size(flat) > 0) & ~has, F.transform(months, entry)).otherwise(months)


def distinct_titles(found: Column) -> Column:
    """The first course of each title, in any case."""
    low = F.transform(found, lambda c: F.lower(c["title"]))
    return F.filter(found, lambda c, i: F.array_position(low, F.lower(c["title"])) == i + 1)


def normalised(payloads: DataFrame, column: str, raw: Column | None = None) -> DataFrame:
    """``payloads`` without ``column`` (JSON text) and with skills_gap, roadmap, recommended_courses, estimated_months, summary_vi,
    raw_response, id, session_id, profile_id, created_at. What is no object gives empty values; ``raw`` is the answer's text.

    Each part is a column of its own plan step, so that no part of a payload is parsed or walked twice."""
    own = [c for c in payloads.columns if c != column]
    src = F.col("__src")
    step = payloads.withColumn("__src", json(F.col(column)))
    step = step.withColumns({
        "__months": roadmap(field(src, "$.roadmap")), "__flat": courses(field(src, "$.recommended_courses")), "__gap": skills_gap(field(src, "$.skills_gap")),
        "__summary": F.trim(F.coalesce(first_truthy(src, "summary_vi", "raw_response").cast("string"), raw if raw is not None else F.lit(None).cast("string"), F.lit(""))),
        "__stored": F.trim(F.coalesce(first_truthy(src, "raw_response").cast("string"), F.lit(""))), "__estimate": field(src, "$.estimated_months"),
    })
    step = step.withColumn("__months", dealt(F.col("__months"), F.col("__flat")))
    step = step.withColumn("__listed", distinct_titles(F.flatten(F.transform("__months", lambda m: m["courses"]))))
    kind, text = F.coalesce(F.schema_of_variant("__estimate"), F.lit("")), F.trim(F.col("__estimate").cast("string"))
    # a number loses its fraction; a text must be whole
    estimate = F.when(kind == "STRING", F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))).when(kind == "BOOLEAN", F.when(text == "true", 1).otherwise(0)).otherwise(text.try_cast("double").try_cast("long"))
    return step.select(
        *own, F.col("__gap").alias("skills_gap"), F.col("__months").alias("roadmap"), F.when(F.size("__listed") > 0, F.col("__listed")).otherwise(F.col("__flat")).alias("recommended_courses"),
        estimate.alias("estimated_months"), F.col("__summary").alias("summary_vi"), F.when(F.col("__stored") != "", F.col("__stored")).when(F.col("__summary") != "", F.col("__summary")).alias("raw_response"),
        *(field(src, f"$.{c}").cast("string").alias(f"payload_{c}") for c in ("id", "session_id", "profile_id", "created_at")),
    )
