"""The stored collection of vectors against all comparisons."""

import random

import numpy as np
import pytest

from graphloom.operators import vector_collection
from graphloom.operators.vector_collection import VectorCollection
from graphloom.sources.snapshots import Snapshots

KIND = "point_id long, doc_type string, vector array<float>"


@pytest.fixture
def collection(spark, tmp_path):
    return VectorCollection(Snapshots(spark, f"file://{tmp_path}/vectors"))


def plain(points, queries, k, kinds=None):
    held = [(i, v) for i, kind, v in points if kinds is None or kind in kinds]
    ids, x = np.array([i for i, _ in held]), np.array([v for _, v in held], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q, v in queries:
        v = np.array(v, np.float32).astype(float)
        scores = np.round(x @ (v / np.linalg.norm(v)), 4) + 0.0
        out[q] = [(int(ids[j]), float(scores[j])) for j in np.lexsort((ids, -scores))[:k]]
    return out


def found(collection, queries, k, kinds=None):
    frame = collection.store.spark.createDataFrame(queries, "query_id long, vector array<float>")
    out = {}
    for r in collection.search(frame, k, kinds).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.point_id, r.score))
    return out


def test_search_in_cells_reaches_its_recall_and_reads_a_share(spark, collection):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16)) * 4
    points = [(i, "abc"[i % 3], (centres[i % 12] + rng.standard_normal(16)).tolist()) for i in range(3000)]
    collection.replace(spark.createDataFrame(points, KIND), cells=12)
    queries = [(i, v) for i, _, v in points[:60]]
    got, want = found(collection, queries, 10), plain(points, queries, 10)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 600
    share = collection.share_read(spark.createDataFrame(queries, "query_id long, vector array<float>"))
    assert share < 0.4
    kinds = found(collection, queries, 10, ["a"])
    want = plain(points, queries, 10, {"a"})
    assert sum(len({i for i, _ in kinds[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 600
    assert {r.doc_type: r.n_points for r in collection.counts().collect()} == dict.fromkeys("abc", 1000)
    # kinds have cells of their own, so a kind that is far from a query is found too
    one = collection.search(spark.createDataFrame(queries[:1], "query_id long, vector array<float>"), 5, ["a"])
    assert {r.doc_type for r in one.collect()} == {"a"}


def test_recall_on_the_table(spark, collection):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    points = [(r.vec_id, str(r.label), r.embedding) for r in table.collect()]
    collection.replace(spark.createDataFrame(points, KIND), cells=8)
    queries = [(i, v) for i, _, v in points[::10]]
    got, want = found(collection, queries, 10), plain(points, queries, 10)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 10 * len(want)


def test_a_collection_is_replaced_as_a_whole(spark, collection, monkeypatch):
    monkeypatch.setattr(vector_collection, "SIDE", 7)
    rng = random.Random(2)
    points = [(i, "a" if i % 2 else "", [rng.gauss(0, 1) for _ in range(4)]) for i in range(50)] + [(60, "a", [1.0, 2.0, 3.0, 4.0]), (61, "b", [2.0, 4.0, 6.0, 8.0])]
    odd = [(70, "a", None), (71, "a", [0.0] * 4), (72, "a", [1.0]), (73, "a", [float("nan")] * 4), (74, "a", []), (None, "a", [1.0] * 4), (75, "a", [None, 1.0, 1.0, 1.0])]
    collection.replace(spark.createDataFrame(points + odd, KIND), cells=1)
    queries = [(i, v) for i, _, v in points[:20]] + [(99, [1.0, 2.0, 3.0, 4.0])]
    assert found(collection, queries, 5) == plain(points, queries, 5)
    assert [i for i, _ in found(collection, queries, 5)[99][:2]] == [60, 61]
    assert found(collection, [(1, None), (2, [0.0] * 4), (3, [1.0])], 5) == {}
    before = collection.points()
    n = before.count()
    collection.replace(spark.createDataFrame(points[:3], KIND))
    assert collection.points().count() == 3 and before.count() == n
    collection.replace(spark.createDataFrame([], KIND))
    assert collection.points().count() == 0 and found(collection, queries, 5) == {}
