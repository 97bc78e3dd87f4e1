"""Notes, citations, routes and reports on small rows."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom import plans
from graphloom.operators import advice, reports, resolve


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_confidence_bounds_and_weights(spark):
    lit = F.lit
    row = one(
        spark,
        advice.confidence(lit(True), lit(3), lit(False), lit("high")),
        advice.confidence(lit(True), lit(100), lit(False), lit("high")),
        advice.confidence(lit(False), lit(0), lit(True), lit("low")),
        advice.confidence(lit(None).cast("boolean"), lit(2), lit(False), lit(None).cast("string")),
    )
    assert list(row) == [0.75, 0.95, 0.0, 0.1]


def test_citations_are_counted_and_stripped(spark):
    text = F.lit("A [Course: c1] b\n\n\n\n[COURSE:C9 ] c")
    allowed = F.array(F.lit("C1"))
    row = one(spark, advice.citations(text), advice.without_citations(text, allowed), advice.without_citations(text, F.array().cast("array<string>")), advice.citations(F.lit(None).cast("string")))
    assert row[0] == ["C1", "C9"]
    assert row[1] == "A [Course: c1] b\n\n c"
    assert row[2].endswith("[COURSE:C9 ] c") and row[3] == []


def test_graph_tokens_leave_the_reply(spark):
    row = one(spark, advice.without_graph_tokens(F.lit("### Outgoing: 3\nReact BUILT_ON JS (F_REACT)  ok\\_x\n\n\n\nend")), advice.without_graph_tokens(F.lit("")))
    assert row[0] == "React JS ok_x\n\nend" and row[1] == ""


def test_difficulty(spark):
    row = one(
        spark,
        advice.difficulty(F.lit("  Khóa   HỌC Java "), F.array(F.lit("khoa hoc"))),
        advice.difficulty(F.lit("about x"), F.array(F.lit("x"), F.lit(None))),
        advice.difficulty(F.lit(None).cast("string"), F.array(F.lit("x"))),
        advice.difficulty(F.lit("some"), F.lit(None).cast("array<string>")),
    )
    assert list(row) == ["trivial", "paraphrased", "unknown", "paraphrased"]


def test_routes(spark):
    rows = spark.createDataFrame([(1, "Cần học gì trước React?", 2, 0), (2, "Gợi ý khóa học cho Java", 1, 0), (3, "Java hay C trước", 2, 1), (4, None, 0, 0), (5, "abc", 1, 0)], "id int, t string, n int, c int")
    got = {r["id"]: r for r in advice.route_scores(rows, "t", F.col("n"), F.col("c")).collect()}
    assert (got[1]["relation"], got[1]["relation_score"], got[1]["routed"]) == (True, 6.0, True)
    assert (got[2]["course_score"], got[2]["relation_score"], got[2]["routed"]) == (3.5, 1.0, False)
    assert (got[3]["comparison"], got[3]["relation_score"], got[3]["routed"]) == (True, 5.0, True)
    assert got[4]["relation_score"] == got[5]["relation_score"] == 0.0 and not got[4]["routed"]


def test_ambiguous_abbreviations(spark):
    asked = spark.createDataFrame([(1, "BA", "work in a  BANK"), (2, "BA", ""), (3, "DA", None), (4, "ZZ", "bank")], "k int, abbreviation string, context string")
    candidates = spark.createDataFrame([("BA", 0, "Analyst", ["software"]), ("BA", 1, "Banker", ["a bank"]), ("DA", 0, "Data", ["data"])], "abbreviation string, place int, meaning string, keys array<string>")
    defaults = spark.createDataFrame([("BA", "Analyst")], "abbreviation string, default string")
    got = dict(tuple(r) for r in advice.chosen_meaning(asked, candidates, defaults, "k").collect())
    assert got == {1: "Banker", 2: "Analyst", 3: "Data", 4: None}


def test_terms_fit_both_ways(spark):
    rows = spark.createDataFrame([("Toán", 1), ("Toán cao cấp A1", 2), ("x", 3), ("", 4), (None, 5), ("y", 9)], "n string, c int")
    got = {r["c"] for r in rows.filter(advice.fits_any(F.col("n"), F.col("c"), ["toán cao cấp"], [9])).collect()}
    assert got == {1, 2, 4, 9}


def test_route_json(spark):
    rows = spark.createDataFrame([("```json\n{\"intent\": \"a\", \"entities\": {\"career\": \"b\"}}\n```",), ("x {\"intent\": \"c\"} y",), ("none",), (None,)], "raw string")
    got = [tuple(r["r"]) for r in rows.select(advice.route_fields(F.col("raw")).alias("r")).collect()]
    assert got == [("a", "b"), ("c", None), (None, None), (None, None)]


def test_blocks_keep_order_and_empty_ones(spark):
    asked = spark.createDataFrame([(1, 1, " sql "), (1, 2, "Go"), (1, 3, " "), (1, 4, "None")], "o int, place int, skill string")
    skills = spark.createDataFrame([(1, 10, "SQL", "1"), (1, 11, "sql", "2"), (1, 12, "Go", "3"), (2, 13, "None", "4")], "o int, item_code int, item_name string, priority_group string")
    courses = spark.createDataFrame([(11, 2, "B"), (11, 1, "A"), (10, 1, "X")], "item_code int, rank int, course_name string")
    got = sorted(tuple(r) for r in advice.course_blocks(asked, skills, courses, "o").collect())
    assert got == [(1, 1, "sql", "2", True, "A|B"), (1, 2, "Go", "3", False, ""), (1, 4, "None", None, False, "")]


def test_merged_gaps_by_code_or_name(spark):
    rows = spark.createDataFrame([(1, "T", 5, "A", 2), (1, "T", 5, "B", 1), (1, "T", None, "Go", 3), (1, "T", None, "GO", 4), (1, "U", 5, "A", 5)], "o int, kind string, item_code int, item_name string, place int")
    got = sorted((r["kind"], r["item_name"], r["place"]) for r in advice.merged_gaps(rows, ["o"], "place").collect())
    assert got == [("T", "B", 1), ("T", "Go", 3), ("U", "A", 5)]


def test_sources_and_gold(spark):
    rows = spark.createDataFrame([(1, "excel_derived", ["a"], None), (2, None, [], " "), (3, "derived_from_retrieval_v2", None, "x"), (4, "other", None, None)], "id int, gold_source string, l array<string>, n string")
    ids = lambda df: {r["id"] for r in df.collect()}
    assert ids(reports.of_source(rows, "independent")) == {1} and ids(reports.of_source(rows, "derived")) == {2, 3}
    assert ids(reports.of_source(rows, None)) == {1, 2, 3, 4} and ids(reports.with_gold(rows, ["l"], ["n"])) == {1, 3}
    with pytest.raises(ValueError):
        reports.of_source(rows, "new")


def test_cases_of_two_schemas(spark):
    names = "id int, question string, query string, intent string, expected_intent string, expected_careers array<string>, career string, expected_career string, expected_skills array<string>, gold_skills array<string>, expected_courses array<string>, gold_course_codes array<string>, competency string"
    rows = spark.createDataFrame([
        (1, "", "q", None, None, [], "", "E", None, ["s"], None, ["c"], None),
        (2, "a", "q", "course_rec", "gap", ["x"], "y", None, [], None, [], None, "SQL"),
        (3, None, None, "gap", None, None, None, None, None, None, None, None, "SQL"),
    ], names)
    got = [tuple(r) for r in reports.one_schema(rows).orderBy("id").collect()]
    assert got[0] == (1, "q", "pathfinding", "pathfinding", ["E"], ["s"], ["c"])
    assert got[1] == (2, "a", "course_rec", "gap", ["x"], ["SQL"], []) and got[2] == (3, "", "gap", "gap", [], [], [])


def test_first_names_once_each(spark):
    rows = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 0), (1, "", 0), (1, "c", 9), (2, None, 1)], "o int, n string, p int")
    assert [tuple(r) for r in reports.first_names(rows, "o", "n", [F.col("p")], 2).collect()] == [(1, ["a", "b"])]


def test_exports_need_a_graph_and_a_review(spark):
    rows = spark.createDataFrame([(1, "a", True, None, None), (2, "a", True, "low", None), (3, "a", None, None, "approved"), (4, "a", True, "high", "approved"), (5, "a", True, None, "rejected"), (6, "b", True, None, "approved")], "id int, intent string, found boolean, confidence string, status string")
    ids = lambda df: {r["id"] for r in df.collect()}
    assert ids(reports.chat_export(rows, ["a"], True)) == {4} and ids(reports.chat_export(rows, ["a"], False)) == {1, 4}


def test_empty_tables_give_no_rows(spark):
    run = spark.createDataFrame([], "case_id int, mode string, quality double, matched boolean, hint boolean")
    assert reports.by_match(run, "case_id", "mode", "quality").count() == 0 == reports.breakdown(run, ["mode"], "quality").count()
    assert [tuple(r) for r in reports.profile(run, ["mode"]).collect()] == [("mode", 0, 0, 0)]


def test_routes_end_words_and_lines_as_their_sql_does(spark):
    said = ["Hoc gi tot cho chößß", "hoc x choßen", "ǎn hǒc Java chǒ\rai", "hoc a b cho c", " 　abc　"]
    rows = spark.createDataFrame(list(enumerate(said)), "k int, said string")
    got = {r.k: r for r in advice.route_scores(rows, "said", F.lit(1), F.lit(0)).collect()}
    # a sharp s ends a word, other line ends are signs like others, and space characters of any script do not count
    assert [got[k].course_score for k in range(5)] == [1.5, 1.5, 1.5, 1.5, 0.0]
    assert got[4].relation_score == 0.0


def test_mapped_names_meet_once_a_subject(spark):
    named = spark.createDataFrame([(1, 5, "a")], "k int, place int, name string")
    subjects = spark.range(300).select(F.lit(1).alias("k"), (F.col("id") + 3).cast("int").alias("place"), F.lit("s").alias("subject"))
    mapping = spark.range(300).select(F.lit("s").alias("subject"), (F.col("id") + 7).cast("int").alias("at"), F.concat(F.lit(" n"), F.col("id") % 2, F.lit(" ")).alias("name"))
    found = resolve.with_mapped(named, subjects, mapping, "k")
    assert sorted(map(tuple, found.collect())) == [(1, "a", 0, 5, 0), (1, "n0", 1, 3, 7), (1, "n1", 1, 3, 8)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join") :]
    assert joined.count("Aggregate [") == 2


def test_gold_pathfinding_with_codes_from_a_million_on(spark, tmp_path):
    """The SQL makes one number of priority and code: codes that reach into the next priority change the order."""
    duck = duckdb.connect()
    for path in Path("/root/testdata/sf0.001").glob("*.parquet"):
        key = {"part": "p_partkey", "lineitem": "l_partkey"}.get(path.stem)
        chosen = f"* REPLACE ({key} * 250000 AS {key})" if key else "*"
        duck.execute(f"COPY (SELECT {chosen} FROM '{path}') TO '{tmp_path / path.name}' (FORMAT parquet)")
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{tmp_path / path.name}'")
    want = duck.execute(plans.ORACLE_SQL["gold_pathfinding"]).fetchall()
    assert sorted(map(tuple, plans.QUERIES["gold_pathfinding"](spark, str(tmp_path)).collect())) == sorted(want)
