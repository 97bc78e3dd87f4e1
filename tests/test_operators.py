"""Literal cases of single operators."""

import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import plans
from graphloom.functions import similarity
from graphloom.functions import text as T
from graphloom.operators import datasets, graph, metrics, resolve, retrieval, sessions
from graphloom.plans import resolution
from graphloom.sources.model import Model
from graphloom.streaming import replay

SF = "/root/testdata/sf0.001"


def test_fusion_puts_the_shared_document_first(spark):
    lists = [spark.createDataFrame([(1, d, r) for r, d in enumerate(docs, 1)], "query_id int, doc_id string, rank int") for docs in ("ab", "bc")]
    fused = retrieval.rrf(*lists, k=3).orderBy("rank").collect()
    assert fused[0].doc_id == "b" and {r.doc_id for r in fused} == set("abc")


def test_both_lists_come_from_one_pass_over_the_texts(spark, capsys):
    docs = spark.createDataFrame([(i, " ".join(["alpha"] * (i % 4) + ["beta"] * (i % 3) + [f"pad{i}"] * (i % 5))) for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "beta pad7"), (3, "none")], "query_id long, text string")
    scores = retrieval.bm25(docs, asked, 4)
    lists = [retrieval.top_k(scores, 4, F.desc(c)) for c in ("score", "n_terms")]
    one = retrieval.two_lists(scores, 4)
    for arm, rows in enumerate(lists):
        want = sorted(tuple(r) for r in rows.select("query_id", "doc_id", "rank").collect())
        assert want and sorted(tuple(r) for r in one.filter(F.col("arm") == arm).select("query_id", "doc_id", "rank").collect()) == want
    fused = retrieval.fused(one, 3)
    assert sorted(map(tuple, fused.collect())) == sorted(map(tuple, retrieval.rrf(*lists, k=3).collect()))
    capsys.readouterr()
    retrieval.fused(one, 3).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1



def test_metrics_of_small_lists(spark):
    lists = {1: [1, 0, 0, 0, 0], 2: [0, 0, 1, 0], 3: [0, 1, 0], 4: [1, 1, 0], 5: [0, 0]}
    ranked = spark.createDataFrame([(q, r, x) for q, xs in lists.items() for r, x in enumerate(xs, 1)], "query_id int, rank int, rel int")
    totals = spark.createDataFrame([(1, 1), (2, 4), (3, 1), (4, 2)], "query_id int, n_relevant long")
    rows = {(r.query_id, r.k): r for r in metrics.query_metrics(ranked, totals, (3, 5)).collect()}
    assert rows[1, 5].precision == 0.2
    assert math.isclose(rows[2, 5].rr, 1 / 3) and rows[2, 5].recall_full == 0.25
    assert math.isclose(rows[3, 3].ndcg, 1 / math.log2(3))
    assert rows[4, 5].ndcg == 1 and rows[4, 5].ap == 1
    assert rows[5, 3].ndcg == rows[5, 3].ap == rows[5, 3].recall_full == 0


def test_set_scores_of_empty_sets(spark):
    rows = spark.createDataFrame([([], []), ([], ["a"]), (["a"], []), (["a", "b"], ["b"])], "p array<string>, g array<string>")
    got = [(r.recall, r.f1) for r in metrics.set_scores(rows, "p", "g").collect()]
    assert got == [(1, 1), (0, 0), (1, 0), (1, 0.666667)]


def test_cap_and_boost(spark):
    ranked = spark.createDataFrame([(1, d, d, 1 / (60 + d)) for d in range(1, 7)], "query_id int, doc_id int, rank int, score double")
    kept = retrieval.capped(ranked, F.col("doc_id") <= 3, 4).orderBy("new_rank").collect()
    assert [r.doc_id for r in kept] == [1, 2, 4, 5]
    assert retrieval.capped(ranked, F.col("doc_id") <= 3, 4, cap=-1).count() == 4
    lifted = retrieval.boosted(ranked, spark.createDataFrame([(5,), (4,)], "doc_id int"), 3).orderBy("rank").collect()
    assert [r.doc_id for r in lifted] == [4, 5, 1]


def test_gap_split(spark):
    need = spark.createDataFrame([(1, c, "x") for c in (10, 11, 12)] + [(2, 10, "x")], "career_code int, item_code int, priority_group string")
    known = spark.createDataFrame([(1, 10)], "career_code int, item_code int")
    assert [r.item_code for r in graph.gap_split(need, known, missing=False).collect()] == [10]
    assert sorted(r.item_code for r in graph.gap_split(need, known, missing=True).collect()) == [11, 12]


def test_topological_order(spark):
    nodes = spark.createDataFrame([(1, c, n, 0) for c, n in ((1, "b"), (2, "c"), (3, "a"))] + [(2, 1, "y", 0), (2, 2, "x", 0)], "career_code long, item_code long, item_name string, sort_rank int")
    edges = spark.createDataFrame([(1, 3), (2, 1), (3, 9)], "item_code long, prerequisite_code long")
    rows = graph.topological_order(nodes, edges, "career_code").orderBy("career_code", "position").collect()
    assert [(r.career_code, r.item_code) for r in rows] == [(1, 3), (1, 1), (1, 2), (2, 1), (2, 2)]
    cycle = spark.createDataFrame([(1, 2), (2, 1)], "item_code long, prerequisite_code long")
    rows = graph.topological_order(nodes, cycle, "career_code").filter("career_code = 1").orderBy("position").collect()
    assert [r.item_code for r in rows] == [3, 1, 2]  # by name


def test_topological_order_is_that_of_a_plain_loop(spark):
    rng = random.Random(3)
    names = {c: rng.choice("abcd") for c in range(60)}
    ranks = {c: rng.randint(0, 2) for c in range(60)}
    gaps = {g: sorted(rng.sample(range(60), rng.randint(1, 30))) for g in range(25)}
    edges = {(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(60)) if a > b or rng.random() < 0.05}
    nodes = spark.createDataFrame([(g, c, names[c], ranks[c]) for g, cs in gaps.items() for c in cs], "career_code long, item_code long, item_name string, sort_rank int")
    got = graph.topological_order(nodes, spark.createDataFrame(sorted(edges), "item_code long, prerequisite_code long"), "career_code").orderBy("career_code", "position").collect()
    for g, cs in gaps.items():
        key = lambda c: (ranks[c], names[c], c)
        after = {c: {p for i, p in edges if i == c and p in cs} for c in cs}
        left, order = set(cs), []
        while free := sorted((c for c in left if not after[c] & left), key=key):
            order.append(free[0])
            left.discard(free[0])
        assert [r.item_code for r in got if r.career_code == g] == (sorted(cs, key=key) if left else order)


def test_cycles_of_any_length(spark):
    edges = [(k, k + 1) for k in range(10, 30)] + [(30, 10), (1, 2), (2, 1), (2, 10), (30, 40), (40, 41), (50, 50), (60, 61), (61, 62), (62, 60), (62, 1)]
    got = {r.item_code: r.component for r in graph.nodes_on_cycles(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: 10 for k in range(10, 31)} | {1: 1, 2: 1} | {60: 60, 61: 60, 62: 60}
    assert graph.nodes_on_cycles(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")).count() == 0


def plain_parts(edges):
    """Strongly connected parts of two nodes or more, by reach from every node."""
    after = {}
    for a, b in edges:
        if a != b:
            after.setdefault(a, set()).add(b)
    reach = {}
    for start in after:
        seen, stack = set(), [start]
        while stack:
            for b in after.get(stack.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        reach[start] = seen
    out = {}
    for a in after:
        part = [b for b in reach[a] if a in reach.get(b, ())]
        if a in reach[a]:
            out[a] = min([a, *part])
    return out


def test_cycles_of_random_graphs_and_long_chains(spark, monkeypatch):
    rng = random.Random(6)
    for n, m in ((40, 60),):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        got = {r.item_code: r.component for r in graph.nodes_on_cycles(spark.createDataFrame(edges, "src long, dst long")).collect()}
        assert got == plain_parts(edges)
    # a cycle of 400 nodes in any order, and a chain of as many: rounds follow the logarithm
    names = list(range(400))
    rng.shuffle(names)
    edges = list(zip(names, [*names[1:], names[0]], strict=True)) + [(k, k + 1) for k in range(10_000, 10_400)]
    rounds = []
    contracted = graph.contracted
    monkeypatch.setattr(graph, "contracted", lambda e, s: rounds.append(contracted(e, s)) or rounds[-1])
    got = {r.item_code: r.component for r in graph.nodes_on_cycles(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == dict.fromkeys(range(400), 0)
    assert sum(len(r[1]) for r in rounds) < 30


def test_percentiles_and_effects_against_plain_sorts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    groups = {"many": rng.normal(size=30_001), "ties": rng.integers(0, 5, 20_000).astype(float), "few": rng.random(31), None: rng.random(7)}
    frame = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("few", None)], "g string, x double")
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {r.g: (r.n_rows, r.percentile) for r in metrics.nearest_rank(frame, "g", "x", share).collect()}
        assert got == {g: (len(vs), float(np.sort(vs)[round(share * (len(vs) - 1))])) for g, vs in groups.items()}
    monkeypatch.setattr(metrics, "VALUE_RANGES", 16)
    x, y = rng.normal(0.2, 1, 3000).round(2), rng.normal(0, 1, 2000).round(2)
    rows = spark.createDataFrame([(True, float(v)) for v in x] + [(False, float(v)) for v in y], "a boolean, v double")
    found = metrics.rank_biserial(rows, F.col("a"), "v").first()
    u = (x[:, None] > y[None, :]).sum() + 0.5 * (x[:, None] == y[None, :]).sum()
    assert (found.nx, found.ny) == (3000, 2000) and math.isclose(found.effect, 2 * u / (len(x) * len(y)) - 1, abs_tol=1e-6)


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [0.0, 0.0], 0), (3, [1.0, 0.0, 0.0], 0), (4, [2.0, 0.1], None), (5, [], 1), (6, None, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = retrieval.knn(vectors, vectors.filter("vec_id in (0, 2)"), 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id, r.score) for r in got] == [(0, 4, 0.9988), (0, 1, 0.7071), (0, 2, 0.0), (2, 0, 0.0), (2, 1, 0.0), (2, 3, 0.0)]


def test_strict_priorities_do_not_rank_text(spark):
    rows = spark.createDataFrame([("1-URGENT",), ("3",), (None,)], "p string")
    strict = [r[0] for r in rows.select(graph.priority_rank(F.col("p"), strict_numeric=True)).collect()]
    assert strict == [999, 3, 999]
    assert [r[0] for r in rows.select(graph.priority_rank(F.col("p"))).collect()] == [1, 999, 999]


def test_generic_urls(spark):
    urls = {
        "": True, "example.com": True, "https://a.org/courses": True, "https://a.org/en/learn/": True, "a.org/learn/python": False, "https://a.org/python?x=1": False,
        "https://a.org/en": False, "https://a.org/training": True, "https://a.org/vi-vn/Certifications": True, "https://a.org/fr/learn": False, "https:///x": True, "a.org/search": False, " ": True,
    }
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.g for r in rows.select("url", T.is_generic_url(F.col("url")).alias("g")).collect()} == urls


def test_tokens(spark):
    rows = spark.createDataFrame([("Wörld of C++ and a b2b",), ("c++ !",), ("học_máy 漢字 é",), (None,)], "t string").select(retrieval.tokens(F.col("t"))).collect()
    assert [r[0] for r in rows] == [["wörld", "of", "and", "b2b"], ["c++"], ["học_máy", "漢字"], []]


def test_cosine_of_odd_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0], [1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = [r[0] for r in rows.select(retrieval.cosine(F.col("a"), F.col("b"))).collect()]
    assert math.isclose(got[0], math.sqrt(0.5)) and got[1:] == [0, 0]


def test_as_of_without_user_turn(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "a"), (1, 1, "user", "b"), (1, 2, "system", "c"), (1, 3, "assistant", "d")], "conv_id int, turn int, role string, text string")
    got = {r.turn: r.user_turn for r in sessions.previous_user_message(rows).collect()}
    assert got == {0: None, 3: 1}


def test_fuzzy_and_ambiguous(spark):
    names = spark.createDataFrame([(1, "small ring"), (2, "red widget"), (3, "small rings")], "code long, name string")
    needles = spark.createDataFrame([("ring small",), ("zzz",)], "needle string")
    ranked = resolve.fuzzy_top(needles, names, 60.0, k=2)
    best = ranked.orderBy("rank").collect()
    assert best[0].code == 1 and best[0].score == 95
    assert [r.ambiguous for r in resolve.ambiguous(ranked, 5.0).collect()] == [95 - best[1].score < 5]


def test_split_has_no_small_validation(spark):
    rows = spark.createDataFrame([("a", i) for i in range(3)] + [("b", i) for i in range(40)], "g string, k int")
    got = datasets.grouped_split(rows, "g", "k", 0.15).groupBy("g", "split").count().collect()
    assert {(r.g, r.split): r["count"] for r in got} == {("a", "train"): 3, ("b", "train"): 34, ("b", "val"): 6}


def test_streams_agree_with_batches(spark, tmp_path):
    events = replay.stream_table(spark, SF, "events")
    replay.event_counts(events).writeStream.outputMode("complete").format("memory").queryName("event_counts").start().processAllAvailable()
    assert spark.table("event_counts").agg(F.sum("n_events")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
    messages = replay.stream_table(spark, SF, "conversations").select("conv_id", "role")
    replay.phase_updates(messages).writeStream.outputMode("update").format("memory").queryName("phases").start().processAllAvailable()
    assert spark.table("phases").agg(F.sum("n_asked")).first()[0] == spark.read.parquet(f"{SF}/conversations.parquet").filter("role = 'user'").count()
    for query in spark.streams.active:
        query.stop()


def test_nothing_imports_the_llm_subpackage():
    top = Path(graph.__file__).parents[1]
    for path in top.rglob("*.py"):
        if "llm" not in path.relative_to(top).parts:
            assert "graphloom.llm" not in path.read_text()


def test_bootstrap_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = {"fine": rng.random(600) ** 3, "ties": rng.integers(0, 3, 900) / 7, None: rng.normal(0, 0.01, 50), "one": np.array([0.12345])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("fine", None)]
    frame = spark.createDataFrame(rows, "g string, x double")
    whole = {r.g: r for r in metrics.bootstrap_mean(frame, "g", "x").collect()}
    # buckets of few values: many tasks share each resample
    monkeypatch.setattr(metrics, "BOOTSTRAP_BUCKET", 40, raising=False)
    cut = {r.g: r for r in metrics.bootstrap_mean(frame, "g", "x").collect()}
    for found in (whole, cut):
        assert set(found) == set(values)
        for g, vs in values.items():
            means = np.sort([rng.choice(vs, len(vs)).mean() for _ in range(4000)])
            near, r = 0.2 * vs.std() / math.sqrt(len(vs)) + 1e-9, found[g]
            assert r.n_rows == len(vs) and math.isclose(r["mean"], vs.mean(), rel_tol=1e-12, abs_tol=1e-12)
            assert abs(r.low - means[100]) < near and abs(r.high - means[3899]) < near
    # two rows of 0 and 1: all values are multiples of a half, as each resample has two rows
    pair = metrics.bootstrap_mean(spark.createDataFrame([(1, 0.0), (1, 1.0)], "g int, x double"), "g", "x").first()
    assert (pair.n_rows, pair["mean"], pair.low, pair.high) == (2, 0.5, 0.0, 1.0)


def test_longest_common_parts():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 9))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert similarity.common_length(a, b) == table[-1][-1]
    assert similarity.weighted_ratio("ring small", "small ring") == 95 and similarity.weighted_ratio("abc", "abc") == 100
    assert similarity.partial_ratio("ell", "hello world") == 100 and similarity.weighted_ratio("", "a") == 0


def fuzzy_strings():
    rng = random.Random(9)
    words = ["small", "ring", "widget", "blue", "gear", "gizmo", "Hot", "bolt", "c++", "é"]
    names = [" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(60)]
    typos = [n[: k % len(n)] + n[k % len(n) + 1 :] for k, n in enumerate(names[:25])]
    return names, [*typos, *names[25:30], "zzzz", "", "small ring of blue gears and bolts"]


def check_fuzzy_top(spark, names, needles, cutoff):
    """All pairs of the strings against the join."""
    catalogue = spark.createDataFrame(list(enumerate(names)), "code long, name string")
    got = {r.needle: (r.code, r.name, r.score) for r in resolve.fuzzy_top(spark.createDataFrame([(n,) for n in needles], "needle string"), catalogue, cutoff).collect()}
    last = {n: k for k, n in enumerate(names)}
    want = {}
    for needle in {n for n in needles if n is not None and n.strip()}:
        score, name = min((-round(similarity.weighted_ratio(needle, n), 6), n) for n in last if n is not None and n.strip())
        if -score >= cutoff:
            want[needle] = (last[name], name, -score)
    assert got == want


def test_fuzzy_join_keeps_pairs_without_common_letter_pairs(spark):
    for needle, name, score in (("c programming", "c quantum flux manifold theory", 85.5), ("go developer", "go zzzxxxqqqwwwvvv kkk", 85.5), ("ab1c2de3f4gh5i6", "ab7c8de9f0ghxiy", 60.0)):
        found = resolve.fuzzy_top(spark.createDataFrame([(needle,)], "needle string"), spark.createDataFrame([(1, name)], "code long, name string"), 60.0).collect()
        assert [(r.name, round(r.score, 6)) for r in found] == [(name, score)]


@pytest.mark.parametrize("cutoff", [20.0, 50.0, 60.0, 78.0, 86.0, 95.0, 100.0])
def test_fuzzy_join_of_random_strings_is_that_of_all_pairs(spark, cutoff):
    rng = random.Random(int(cutoff))

    def string():
        letters = rng.choice(["ab ", "abcdef ", "abcdefghij 12", "aA é\t "])
        return "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 6, 12, 25, 60])))

    names = [string() for _ in range(150)]
    needles = [string() for _ in range(40)] + [n[1:] + "x" for n in names[:20]] + names[20:25]
    check_fuzzy_top(spark, [*names, None, "  "], [*needles, None], cutoff)


def test_fuzzy_tops_are_those_of_all_pairs(spark):
    check_fuzzy_top(spark, *fuzzy_strings(), 60.0)


def test_fuzzy_queries_are_those_of_all_pairs(spark):
    model = Model(spark, "/root/testdata/sf0.01")
    names = [(r.item_name, r.item_code) for r in model.competency.collect()]
    last = {n: max(c for m, c in names if m == n) for n in {n for n, _ in names}}
    asked = {r.text for r in resolution.asked_items(model).collect()}
    want = {}
    for needle in asked:
        score, name = min((-round(similarity.weighted_ratio(needle, n), 6), n) for n in last)
        if -score >= 60:
            want[needle] = (1, last[name], name, -score)
    assert {r.needle: (r["rank"], r.code, r.name, r.score) for r in plans.QUERIES["fuzzy_top1"](spark, "/root/testdata/sf0.01").collect()} == want
    assert len(want) >= 10
    typed = {r.needle.strip() for r in resolution.career_needles(model).collect()}
    careers = {r.career_name.strip() for r in model.career.collect()}
    got = {}
    for r in plans.QUERIES["career_suggestions"](spark, "/root/testdata/sf0.01").orderBy("rank").collect():
        got.setdefault(r.needle, []).append((r.name, r.score))
    for needle in typed:
        same = [(n, 1.0) for n in careers if n.lower() == needle.lower()]
        scored = sorted((-round(similarity.suggestion_score(needle, n), 6), n) for n in careers)
        assert got.get(needle, []) == (same or [(n, -s) for s, n in scored if s <= -0.25][:6]), needle


def test_suggestions_are_those_of_all_pairs(spark):
    names, needles = fuzzy_strings()
    got = {}
    for r in resolve.suggestions(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(n,) for n in names], "name string"), k=3).orderBy("rank").collect():
        got.setdefault(r.needle, []).append(r.name)
    for needle in {n.strip() for n in needles} - {"", "zzzz"}:
        same = [n for n in set(names) if n.lower() == needle.lower()]
        scored = sorted((-round(similarity.suggestion_score(needle, n), 6), n) for n in set(names))
        assert got[needle] == (same or [n for s, n in scored if s <= -0.25][:3]), needle
    assert "zzzz" not in got and "" not in got


def test_resolution_by_tier(spark):
    catalogue = spark.createDataFrame([("A_1", "Python", "CT_LANG"), ("A_2", "PyTorch", "CT_FRAM"), ("A_3", "Python", "CT_TOOL")], "code string, name string, type_code string")
    aliases = spark.createDataFrame([("py", "python")], "alias string, canonical string")
    asked = spark.createDataFrame([("a_2", None), ("PY ", "CT_LANG"), ("pythn", "CT_TOOL"), ("qqqq", None), ("", None)], "needle string, hint string")
    rows = {}
    for r in resolve.resolve_competencies(asked, catalogue, aliases).orderBy("rank").collect():
        rows.setdefault(r.needle, []).append((r.code, r.score, r.source))
    assert rows["a_2"] == [("A_2", 100.0, "exact")]
    assert rows["PY "][:2] == [("A_1", 105.0, "alias"), ("A_3", 95.0, "alias")]
    best = similarity.weighted_ratio("pythn", "Python")
    assert rows["pythn"] == [("A_3", round(best, 6) + 15, "fuzzy")]  # the last row of the name
    assert set(rows) == {"a_2", "PY ", "pythn"}


def test_containing_is_a_nested_loop(spark):
    rng = random.Random(2)
    holders = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(80)]
    parts = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(0, 5))) for _ in range(60)})
    got = resolve.containing(spark.createDataFrame(list(enumerate(holders)), "k int, h string"), spark.createDataFrame([(p,) for p in parts], "p string"), "h", "p").collect()
    assert sorted((r.k, r.p) for r in got) == sorted((k, p) for k, h in enumerate(holders) for p in parts if p and p in h)


def test_search_terms_and_short_names(spark):
    texts = ["Learn python and SQL, SQL", "what about CBAP", "short text", "", None, "a very long question about nothing that any of the known words would ever be able to match at all"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(resolve.search_terms(F.col("t"))).collect()
    assert [r[0] for r in rows] == [["python", "SQL"], ["CBAP"], ["short text"], [], [], ["question", "nothing", "about"]]
    pairs = [("CBAP", "C", True), ("learn C now", "c", False), ("C", "c", False), ("go", "Golang", False), ("x", "", True), ("use c++", "C+", True)]
    rows = spark.createDataFrame(pairs, "n string, c string, want boolean").select(resolve.spurious(F.col("n"), F.col("c")), "want").collect()
    assert [r[0] for r in rows] == [r[1] for r in rows]


def test_alias_scan_rules(spark):
    texts = spark.createDataFrame([(1, "JavaScript and go"), (2, "gopher java"), (3, "GO"), (4, None)], "doc_id int, text string")
    aliases = spark.createDataFrame([("competency", "go", "Go"), ("competency", "java", "Java"), ("competency", "javas", "Java"), ("career", "g", "G"), ("competency", "", "none")], "kind string, alias string, canonical string")
    got = sorted((r.doc_id, r.canonical, r.alias) for r in resolve.alias_scan(texts, aliases).collect())
    assert got == [(1, "Go", "go"), (1, "Java", "javas"), (2, "Java", "java"), (3, "Go", "go")]


def test_names_that_are_often_there_meet_a_text_once(spark):
    """Postings are made of different texts, none of them is broadcast, and a part with a run that no holder has meets none."""
    names = spark.range(3000).select(F.col("id").alias("item_code"), F.concat(F.lit("Name "), F.col("id") % 3).alias("item_name"))
    got = resolve.match_competencies(names, spark.createDataFrame([(1, "name 2"), (2, "NAME"), (3, "nabe 2")], "query_id int, text string"))
    assert sorted(got.select("query_id", "item_code").collect()) == [(1, 2), (2, 0)]
    best = resolve.best_match(names, spark.createDataFrame([("see name 1 now",), ("e 2",), ("e 3",)], "needle string"), "item_code", "item_name")
    assert sorted(best.select("needle", "item_code", "tier").collect()) == [("e 2", 2, 1), ("see name 1 now", 1, 2)]
    pairs = resolve.containing(names, spark.createDataFrame([("ame",)], "p string"), "item_name", "p")
    assert pairs.count() == 3000
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") >= 2 and "strategy=merge" in plan
    exploded = [line for line in plan.split("\n") if "Aggregate [item_name" in line]
    assert exploded, plan


def test_suggestions_compare_few_names_and_are_those_of_all_pairs(monkeypatch):
    rng = random.Random(3)
    names = sorted({f"Customer#{rng.randrange(10**6):09d}" for _ in range(3000)} | {"Cust", "nobody", "ño 12", "2"})
    low = [n.lower() for n in names]
    sizes, calls, plain = np.array([len(n) for n in low]), [], similarity.suggestion_score
    monkeypatch.setattr(similarity, "suggestion_score", lambda a, b: calls.append(1) or plain(a, b))
    needles = ["#000123", "see Customer#000000200 please", "nobody 300", "2", "xyz", f"see {names[7]} please", "NOBODY"]
    for needle in needles:
        got = resolve.best_offers(needle, names, sizes, lambda c: np.array([n.count(c) for n in low]), 6, 0.25)
        scores = [(-round(plain(needle, n), 6), n) for n in names]
        assert got == [(-s, n) for s, n in sorted(x for x in scores if x[0] <= -0.25)[:6]], needle
    assert len(calls) < 0.4 * len(names) * len(needles)


def test_offered_names_are_those_of_all_pairs(monkeypatch):
    rng = random.Random(4)
    tables = [
        [f"Customer#{i:09d}" for i in rng.sample(range(10**6), 400)],
        ["".join(rng.choice("abAB ") for _ in range(rng.randint(1, 9))).strip() or "b" for _ in range(300)],
        [f"{rng.choice(['İx', 'ΑΣ', 'straße', 'Éa'])}{i}" for i in range(40)] + ["a" * rng.randint(190, 260) + str(i) for i in range(20)] + ["x\ny", "a\nb", "b"],
    ]
    for names in ({*table} for table in tables):
        block = resolve.OfferedNames(names)
        needles = ["#000123", "see Customer#000000200 please", "nobody 300", "2", "xyz", "a", "ab", "ba b", "b\nx", "\n", "ας", "i", "straSSE1", "customer"]
        needles += [name[1:] + "q" for name in sorted(names)[:5]] + [name[1:] for name in sorted(names)[-5:] if name[1:]]
        for probed in (100_000, 20):
            monkeypatch.setattr(resolve, "PROBED", probed)
            held = block.holders({needle.lower() for needle in needles}, 6)
            for needle in needles:
                scored = sorted((-round(similarity.suggestion_score(needle, n), 6), n) for n in names)
                assert block.first(needle, held[needle.lower()], 6, 0.25) == [(-s, n) for s, n in scored if s <= -0.25][:6], needle


def test_suggestions_look_at_few_of_many_names(monkeypatch):
    """The work of a needle hardly grows with the names."""
    met = []
    plain, push = similarity.suggestion_score, resolve.heapq.heappush
    monkeypatch.setattr(similarity, "suggestion_score", lambda a, b: met.append(b) or plain(a, b))
    monkeypatch.setattr(resolve.heapq, "heappush", lambda heap, node: met.append(node) or push(heap, node))
    most = []
    for n in (2_000, 50_000):
        block = resolve.OfferedNames(f"Customer#{7 * i:09d}" for i in range(n))
        needles = ["#000007000", "see Customer#000000200 please", "nobody 300", "nobody 13900"]
        held, counts = block.holders({needle.lower() for needle in needles}, 6), []
        for needle in needles:
            met.clear()
            assert len(block.first(needle, held[needle.lower()], 6, 0.25)) == 6
            counts.append(len(met))
        most.append(max(counts))
    assert most[1] < 0.1 * 50_000 and most[1] < 6 * most[0]


def test_edges_are_gathered_in_tasks_of_a_bounded_size(spark, tmp_path, monkeypatch):
    from graphloom.sources import model

    lines = [(o, p % 13, (p * o) % 5, float(p % 7)) for o in range(40) for p in range(20)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, o % 9, f"{o % 4}") for o in range(40)], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(model, "EDGES_A_TASK", 50, raising=False)
    m = model.Model(spark, str(tmp_path))
    teach, need = {}, {}
    for o, p, s, q in lines:
        teach[s, p] = max(teach.get((s, p), 0), int(q))
        need[o % 9, p] = min(need.get((o % 9, p), "9"), f"{o % 4}")
    for frame, want in ((m.teach, teach), (m.need, need)):
        rows = frame.collect()
        assert {(r[0], r[1]): r[2] for r in rows} == want and len(rows) == len(want)
        assert frame.rdd.getNumPartitions() == 16


def test_neighbours_meet_in_groups_of_a_bounded_size(spark, monkeypatch, capsys):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3 if i % 7 else 2)] if i % 11 else None, i % 3) for i in range(90)]
    for name, size in (("SIDE", 8), ("VECTOR_BLOCK", 4), ("QUERY_BLOCK", 3)):
        monkeypatch.setattr(retrieval, name, size, raising=False)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")

    def cosine(a, b):
        norm = math.sqrt(sum(x * x for x in a or [])) * math.sqrt(sum(x * x for x in b or []))
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / norm, 4) + 0.0 if norm and len(a) == len(b) else 0.0

    met = retrieval.knn(vectors, vectors.filter("vec_id % 4 = 0"), 5)
    got = {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 4)) for r in met.collect()}
    for q, v, _ in rows[::4]:
        best = sorted((-cosine(v, w), i) for i, w, _ in rows if i != q)[:5]
        assert [got[q, n + 1] for n in range(5)] == [(i, -s) for s, i in best]
    assert len(got) == 5 * len(rows[::4])
    # a product of both sides would fill batches of 10,000 pairs of matrices
    capsys.readouterr()
    retrieval.knn(vectors, vectors.filter("vec_id % 4 = 0"), 5).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_plans_of_months_are_made_without_data_frames(spark, capsys):
    courses = spark.createDataFrame([(1, "SQL", 2, "B"), (1, "Java", 1, "A"), (1, "Java", 3, "C"), (1, None, 4, "D"), (2, "Go", 1, "G")], "career_code long, skill string, place long, title string")
    topics = spark.createDataFrame([(1, 0, "java/spring"), (1, 1, None), (1, 2, "none"), (3, 0, "java")], "career_code long, month int, topic string")
    made = graph.allocate_months(courses, topics, "career_code", 3, 2)
    got = sorted((r.career_code, r.month, r.place, r.title) for r in made.collect())
    want = [(1, 0, 0, "a"), (1, 0, 1, "c"), (1, 1, 0, "b"), (1, 1, 1, "a"), (1, 2, 0, "d"), (1, 2, 1, "b"), (2, 0, 0, "g"), (2, 1, 0, "g"), (2, 2, 0, "g")]
    assert got == want
    capsys.readouterr()
    graph.allocate_months(courses, topics, "career_code", 3, 2).explain()
    assert "Pandas" not in capsys.readouterr().out
