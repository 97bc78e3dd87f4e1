"""Files, ingest, datasets and plans against literal cases and plain loops."""

import hashlib
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import datasets, graph, ingest, quality, retrieval
from graphloom.sources import files


def test_json_lines(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"a": 1, "b": "x"}\n\n  \n{"a": 2}\nnot json\n')
    rows = files.read_jsonl(spark, str(path), "a long, b string").collect()
    assert [(r.a, r.b) for r in rows] == [(1, "x"), (2, None), (None, None)]
    with pytest.raises(Exception, match="rows.jsonl:5: malformed line"):
        files.read_jsonl(spark, str(path), "a long, b string", strict=True).collect()
    path.write_text('{"a": 1, "b": "x"}\n\n{"a": 2}')
    assert files.read_jsonl(spark, str(path), "a long, b string", strict=True).count() == 2
    files.write_jsonl(spark.createDataFrame([(1, None), (2, "é")], "a long, b string"), str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted((x["a"], x["b"]) for x in lines) == [(1, None), (2, "é")]


def test_strict_json_lines_over_many_splits(spark, tmp_path):
    for name, bad in (("a", 777), ("b", None), ("c", 1)):
        lines = [json.dumps({"a": i, "b": "x" * (i % 50)}) for i in range(1, 1001)]
        if bad:
            lines[bad - 1] = '{"a": '
            lines[899] = "}"
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n" * 3)
    path = str(tmp_path / "*.jsonl")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        splits = files.numbered_splits(spark, path).collect()
        # many splits a file, none of them long
        assert len(splits) > 20 and max(r.n_lines for r in splits) < 400
        assert sorted((r.file.rsplit("/", 1)[1], r.line) for r in files.malformed_lines(spark, path).collect()) == [("a.jsonl", 777), ("c.jsonl", 1)]
        with pytest.raises(ValueError, match="a.jsonl:777: malformed line.*c.jsonl:1: malformed line"):
            files.read_jsonl(spark, path, "a long, b string", strict=True)
        assert files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "a long, b string", strict=True).count() == 1000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_messages_of_a_folder(spark, tmp_path):
    good = {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}], "meta": {"intent": "course_rec"}}
    (tmp_path / "ft_generator_pathfinding.jsonl").write_text("\n".join(json.dumps(x) for x in (good, {"messages": "no list"}, {"meta": {}})))
    (tmp_path / "ft_generator_course_rec.jsonl").write_text(json.dumps({"messages": []}) + "\n")
    (tmp_path / "other.jsonl").write_text(json.dumps(good))
    rows = files.read_messages(spark, str(tmp_path / "ft_generator_*.jsonl")).orderBy("file_name").collect()
    assert [(r.file_name, len(r.messages)) for r in rows] == [("ft_generator_course_rec.jsonl", 0), ("ft_generator_pathfinding.jsonl", 2)]


def test_documents_and_csv(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert sorted(r.a for r in files.read_documents(spark, str(tmp_path / "list.json"), "a long").collect()) == [1, 2]
    (tmp_path / "broken.json").write_text("{broken")
    assert files.read_documents(spark, str(tmp_path / "broken.json"), "a long").count() == 0
    frame = spark.createDataFrame([(1, "a,b", 2.5)], "k long, s string, v double")
    files.write_csv(frame, str(tmp_path / "csv"), ["v", "s"])
    # a part without rows is a file with a header alone
    parts = [part.read_text().splitlines() for part in (tmp_path / "csv").glob("*.csv")]
    assert all(lines[0] == "v,s" for lines in parts) and [line for lines in parts for line in lines[1:]] == ['2.5,"a,b"']
    assert files.read_csv(spark, str(tmp_path / "csv"), "v double, s string").collect() == [(2.5, "a,b")]


def test_supplement_and_edges(spark):
    base = spark.createDataFrame([("r1", 1), (None, 2)], "id string, n int")
    extra = spark.createDataFrame([("r1", 3), ("r2", 4), ("r2", 5), (" ", 6), (None, 7)], "id string, n int")
    assert sorted(r.n for r in ingest.merge_supplement(base, extra, "id", ["n"]).collect()) == [1, 2, 4, 6, 7]
    assert sorted(r.n for r in ingest.append_missing(base, extra.dropna(), ["id"]).collect()) == [1, 2, 4, 5, 6]
    assert [r.n for r in ingest.delete_keys(extra.dropna(), base.dropna(), ["id"]).filter("n < 5").collect()] == [4]
    rows = [("c1", "i1", "CT_LANG", 1), ("c1", "i1", " CT_LANG ", 2), ("c1", "i2", "", 3), ("c9", "i1", "CT_LANG", 4), ("c1", "i1", "CT_FRAM", 5), ("c2", "i1", "CT_LANG", 6), ("", "i1", "CT_LANG", 7)]
    sheet = spark.createDataFrame(rows, "c string, i string, type_code string, at int")
    careers, items = spark.createDataFrame([("c1",), ("c2",)], "c string"), spark.createDataFrame([("i1", "CT_LANG")], "i string, type_code string")
    denied = spark.createDataFrame([("c2", "i1")], "c string, i string")
    got = ingest.typed_edges(sheet, careers, items, ("c", "i"), ["at"], ["CT_LANG", "CT_FRAM"], denied).collect()
    assert [tuple(r) for r in got] == [("c1", "i1", "CT_LANG", 2)]


def test_ids_by_name(spark):
    rows = spark.createDataFrame([("edge", str(k)) for k in range(40)] + [("course", "é")], "t string, k string")
    for r in rows.select("t", "k", retrieval.name_uuid(F.col("t"), F.col("k")).alias("u")).collect():
        assert r.u == str(uuid.uuid5(uuid.NAMESPACE_DNS, f"{r.t}:{r.k}"))


def test_training_rows_of_sources(spark):
    def row(question, meta, file_name, user='{"career_name": "Dev"}'):
        return ([("system", "Suggest a course"), ("user", f"{user}\nQuestion: {question}"), ("assistant", "a")], meta, file_name)

    rows = [
        row("What now?", {"source": "synthetic"}, "x.jsonl"), row("What now?", {"source": "chat"}, "x.jsonl"), row("What then?", {"message_id": "3"}, "ft_generator_skills_gap.jsonl"),
        row("What now?", {"career": "QA", "intent": "pathfinding"}, "y.jsonl"), row("What now?", None, "x.jsonl", user="nothing"),
    ]
    frame = spark.createDataFrame(rows, f"messages {files.MESSAGES}, meta map<string, string>, file_name string")
    got = {(r.intent, r.entity): r for r in datasets.merge_training_rows(frame).collect()}
    assert set(got) == {("course_rec", "dev"), ("skills_gap", "dev"), ("pathfinding", "qa"), ("course_rec", "unknown")}
    assert got["course_rec", "dev"].meta["source"] == "chat"
    assert got["course_rec", "dev"].key == "hash:" + hashlib.sha256(b"dev\nWhat now?").hexdigest()[:16]
    bad = spark.createDataFrame([(1, rows[0][0]), (2, rows[0][0][:2]), (3, [rows[0][0][1], rows[0][0][0], ("assistant", " ")])], f"k int, messages {files.MESSAGES}")
    assert {r.k: r.errors for r in datasets.message_errors(bad, "k").collect()} == {2: "too_few_messages,role_order", 3: "role_order,empty_content"}


def plain_plan(pool, topics, months, per_month):
    """Month by month, as a person would fill them in."""
    skills, cursor, out = list(dict.fromkeys(s for s, _ in pool)), 0, []
    for month in range(months):
        chosen = []
        for topic in [t for m, t in topics if m == month]:
            for skill in skills:
                if skill in topic or topic in skill:
                    chosen += [t for s, t in pool if s == skill and t not in chosen]
        chosen = list(dict.fromkeys(chosen)) or (list(dict.fromkeys(t for s, t in pool if s == skills[min(month, len(skills) - 1)])) if skills else [])
        chosen = chosen[:per_month]
        while len(chosen) < per_month and cursor < len(pool):
            if pool[cursor][1] not in chosen:
                chosen.append(pool[cursor][1])
            cursor += 1
        out += [(month, k, t) for k, t in enumerate(chosen)]
    return out


def test_plans_are_those_of_a_plain_loop(spark):
    rng = random.Random(7)
    skills = ["sql", "python", "git", "c"]
    pools = {g: [(rng.choice(skills), f"course {rng.randint(0, 9)}") for _ in range(rng.randint(1, 12))] for g in range(30)}
    topics = {g: [(rng.randint(0, 5), rng.choice([*skills, "advanced sql", "other"])) for _ in range(rng.randint(0, 6))] for g in range(30)}
    courses = spark.createDataFrame([(g, s, k, t) for g, pool in pools.items() for k, (s, t) in enumerate(pool)], "g long, skill string, place long, title string")
    asked = spark.createDataFrame([(g, m, t) for g, ts in topics.items() for m, t in ts], "g long, month int, topic string")
    got = {}
    for r in graph.allocate_months(courses, asked.coalesce(1), "g", 6, 2).orderBy("g", "month", "place").collect():
        got.setdefault(r.g, []).append((r.month, r.place, r.title))
    for g, pool in pools.items():
        assert got[g] == plain_plan(pool, topics[g], 6, 2), g


def test_scores_without_mentions(spark):
    rows = [(1, "", [], ["a1"], ["a1"], []), (2, "Tool: Python. and c++ [Course: X1]", ["Python"], ["python", "java"], ["tool: python"], ["c++"]), (3, None, ["b1"], [], [], [])]
    cases = spark.createDataFrame(rows, "k int, reply string, predicted array<string>, gold array<string>, graph_context array<string>, vector_context array<string>")
    v2 = {r.k: r for r in quality.scores_v2(cases, ["k"]).collect()}
    assert (v2[1].full_grounding_rate, v2[1].hallucination_rate, v2[1].claim_grounding_rate) == (None, 0.0, None)
    assert (v2[2].n_mentions, v2[2].graph_grounding_rate, v2[2].vector_only_rate, v2[2].ontology_f1) == (3, 0.333333, 0.333333, 0.666667)
    assert (v2[3].n_mentions, v2[3].full_grounding_rate, v2[3].code_recall) == (1, 0.0, 1.0)
    legacy = {r.k: r.full_grounding_rate for r in quality.scores_v2(cases, ["k"], quality.LEGACY_ONE).collect()}
    assert legacy[1] == 1.0
    for policy, penalty, want in ((quality.LEGACY_ONE, False, 1.0), (quality.LEGACY_ONE, True, 0.0), (quality.EXCLUDE, False, 0.0), (quality.PENALIZE, False, 0.0)):
        assert {r.k: r.faithfulness for r in quality.scores_v1(cases, ["k"], policy, penalty).collect()}[1] == want


def test_plain_letters_and_labels(spark):
    rows = spark.createDataFrame([("Đường Học Máy", "Tool:  Git "), ("café", "domain"), (None, None)], "a string, b string").select(T.without_marks(F.col("a")), T.label(F.col("b")), T.slug(F.col("b"), 6)).collect()
    assert [tuple(r) for r in rows] == [("Duong Hoc May", "git", "tool_g"), ("cafe", "domain", "domain"), (None, "", None)]
