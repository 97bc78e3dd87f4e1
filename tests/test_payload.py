"""Payloads of every shape against a plain reading of the same JSON."""

import json
import random

from graphloom.operators import payload


def read(spark, *values):
    rows = [(i, v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)]
    found = payload.normalised(spark.createDataFrame(rows, "k int, body string"), "body").orderBy("k").collect()
    return [r.asDict(recursive=True) for r in found]


def gaps(spark, *values):
    return [r["skills_gap"] for r in read(spark, *({"skills_gap": v} for v in values))]


def gap(missing=(), weak=(), soft=(), cert=()):
    return {"missing": list(missing), "weak": list(weak), "soft_skills": list(soft), "certifications": list(cert)}


def test_gaps_of_every_shape(spark):
    assert gaps(
        spark, ["SQL", "", None, "Python", 3], {"mandatory": ["A"], "required": ["B"], "recommended": ["C"], "optional": ["D"], "soft_skills": ["E"]},
        {"missing": ["X"], "mandatory": ["Y"], "certifications": ["Z", 0, False]}, {"weak": ["W"], "optional": ["V"]}, "text", 5, None, {"missing": None}, {}, {"optional": [], "soft_skills": "ab"},
    ) == [gap(["SQL", "Python", "3"]), gap(["A", "B", "C"], ["D"], ["E"]), gap(["X"], cert=["Z"]), gap(weak=["W"]), gap(), gap(), gap(), gap(), gap(), gap(soft=["a", "b"])]


def test_months_take_numbers_texts_or_their_place(spark):
    found = read(spark, {"roadmap": [{"month": 3, "topics": ["a", 1], "milestone": "m"}, "no", {"month": " 7 "}, {"month": "x", "topics": "t", "milestone": None}, {"month": 2.5}, {"month": None}, {"month": True}]})[0]
    assert [(m["month"], m["topics"], m["milestone"]) for m in found["roadmap"]] == [(3, ["a", "1"], "m"), (7, [], ""), (4, [], ""), (5, [], ""), (6, [], ""), (1, [], "")]


def test_courses_by_any_name_and_without_generic_urls(spark):
    found = read(spark, {"recommended_courses": [
        {"title": " SQL ", "platform": "P", "url": "https://a.b/x/y"}, {"course_name": "N", "organization": "O", "url": "https://a.b/courses"}, {"name": "M", "provider": " "}, {"title": ""}, "x", {"title": None, "name": "K", "url": 7},
    ]})[0]
    none = payload.NO_PLATFORM
    # the number 7 is a host without a path
    assert [(c["title"], c["platform"], c["url"]) for c in found["recommended_courses"]] == [("SQL", "P", "https://a.b/x/y"), ("N", "O", None), ("M", none, None), ("K", none, None)]


def test_flat_courses_are_dealt_to_months_that_have_none(spark):
    flat = [{"title": t} for t in ("A", "B", "a", "D", "E")]
    one, two = read(spark, {"roadmap": [{}, {}], "recommended_courses": flat}, {"roadmap": [{}, {"courses": [{"title": "Q"}, {"title": "q"}]}], "recommended_courses": flat})
    assert [[c["title"] for c in m["courses"]] for m in one["roadmap"]] == [["A", "a", "E"], ["B", "D"]]
    assert [c["title"] for c in one["recommended_courses"]] == ["A", "E", "B", "D"]
    assert [[c["title"] for c in m["courses"]] for m in two["roadmap"]] == [[], ["Q", "q"]] and [c["title"] for c in two["recommended_courses"]] == ["Q"]


def test_summaries_estimates_and_what_is_no_object(spark):
    found = read(spark, {"summary_vi": " S ", "raw_response": "R", "estimated_months": "6", "id": 5, "session_id": "s"}, {"raw_response": "R", "estimated_months": 6.9}, {"estimated_months": "x"}, "[1]", "not json", None, "{}")
    assert [(r["summary_vi"], r["raw_response"], r["estimated_months"], r["payload_id"], r["payload_session_id"]) for r in found] == [
        ("S", "R", 6, "5", "s"), ("R", "R", 6, None, None), *[("", None, None, None, None)] * 5,
    ]
    assert found[4]["skills_gap"] == gap() and found[4]["roadmap"] == [] and found[4]["recommended_courses"] == []


def test_random_gaps_against_a_plain_reading(spark):
    rng = random.Random(4)
    keys = ["missing", "weak", "mandatory", "required", "recommended", "optional", "soft_skills", "certifications"]
    values = [{k: rng.choice([None, [], ["a"], ["b", "", None, "c"], [1, 0, True]]) for k in rng.sample(keys, rng.randrange(0, 6))} for _ in range(60)]

    def plain(g):
        def of(x):
            return ["true" if v is True else str(v) for v in x or [] if v]

        rest = {k: of(g.get(k)) for k in ("soft_skills", "certifications")}
        if "missing" in g or "weak" in g:
            return {"missing": of(g.get("missing")), "weak": of(g.get("weak")), **rest}
        return {"missing": [x for k in ("mandatory", "required", "recommended") for x in of(g.get(k))], "weak": of(g.get("optional")), **rest}

    assert gaps(spark, *values) == [plain(g) for g in values]
