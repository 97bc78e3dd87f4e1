"""Whitening, search by learned partitions and turn repair against plain versions."""

import hashlib
import heapq
import math
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import partition_search, queries, turn_repair, whitening

SF = "/root/testdata/sf0.01"


# whitening


def plain_whitening(vectors, k):
    x = np.array([[math.floor(256 * float(c)) for c in v] for v in vectors], np.int64)
    u = np.unique(x, axis=0)
    centred = u - u.mean(axis=0)
    e, q = np.linalg.eigh(centred.T @ centred / len(u))
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    deviation = [sum((len(u) * int(c) - int(s)) ** 2 for c, s in zip(row, u.sum(axis=0), strict=True)) for row in x]
    return len(u), deviation, (x - u.mean(axis=0)) @ q / np.sqrt(e), e / np.trace(centred.T @ centred / len(u))


def test_whitening_of_the_table(spark):
    rows = queries.QUERIES["op11_lanczos_whitening"](spark, SF).collect()
    table = sorted(duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall())
    n, deviation, white, explained = plain_whitening([v for _, v in table], 4)
    found = {(r.vec_id, r.component): r for r in rows}
    assert len(found) == len(rows) == 4 * len(table)
    for j in range(4):
        got = np.array([found[k, j + 1].whitened for k, _ in table])
        assert np.abs(got * np.sign(got @ white[:, j]) - white[:, j]).max() < 1e-8
    for (k, _), d in zip(table, deviation, strict=True):
        for j in range(4):
            r = found[k, j + 1]
            assert (r.n, r.deviation) == (n, d)
            assert abs(r.explained - explained[j]) < 1e-12 and r.identity_error < 1e-10


def test_whitening_leaves_out_bad_vectors_and_counts_copies_once(spark):
    rng = random.Random(1)
    good = [[rng.gauss(0, 3) for _ in range(5)] for i in range(40)]
    rows = [(i, v, "x", 1) for i, v in enumerate(good)] + [(100 + i, good[0], "x", 1) for i in range(60)]
    rows += [(200, None, "x", 1), (201, [1.0, None, 1.0, 1.0, 1.0], "x", 1), (202, [1.0, float("nan"), 0.0, 0.0, 0.0], "x", 1), (203, [float("inf")] * 5, "x", 1), (None, good[1], "x", 1)]
    rows += [(300, [1.0, 2.0], "x", 1), (301, [2.0, 2.0], "x", 1), (302, [], "x", 1), (303, [-0.0, 7.0], "x", 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string, n int")
    found = whitening.whiten_embeddings(frame).collect()
    five = [r for r in found if r.vec_id is None or r.vec_id < 200]
    assert len(five) == 4 * 101 and {r.n for r in five} == {40}
    assert {r.vec_id for r in found if r.vec_id is not None and r.vec_id >= 200} == {300, 301, 303}
    n, deviation, _, explained = plain_whitening(good, 4)
    assert {r.deviation for r in five if r.vec_id == 7} == {deviation[7]}
    assert all(abs(r.explained - explained[r.component - 1]) < 1e-10 for r in five)


def test_whitening_of_one_vector_or_none_gives_no_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten_embeddings(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten_embeddings(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0


@pytest.mark.parametrize("size", [10, 2**20, 2**45, 2**55])
def test_deviations_are_exact_at_every_size(size):
    rng = random.Random(size)
    x = np.array([[rng.randrange(-size, size) for _ in range(7)] for _ in range(20)], np.int64)
    sums = [rng.randrange(-size, size) * 3 for _ in range(7)]
    want = [sum((11 * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    assert whitening.deviations(x, 11, np.array(sums, object)) == want


@pytest.mark.parametrize("dim, block, basis", [(1, 16, 1024), (3, 2, 1024), (40, 4, 24), (150, 8, 64), (300, 16, 96)])
def test_leading_pairs_equal_a_full_solution(dim, block, basis):
    rng = np.random.default_rng(dim)
    a = rng.standard_normal((dim, 2 * dim)) * (1 + np.arange(2 * dim)) ** -0.6
    m = a @ a.T
    values, vectors, _ = whitening.leading_pairs(lambda q: m @ q, dim, 4, block, basis)
    want, q = np.linalg.eigh(m)
    k = min(4, dim)
    assert np.allclose(values, want[::-1][:k], rtol=1e-12)
    assert np.abs(np.abs((q[:, ::-1][:, :k] * vectors).sum(axis=0)) - 1).max() < 1e-12


def test_leading_pairs_restart_where_the_space_is_invariant():
    # the first block spans little of a matrix of rank 2, and equal eigenvalues stop it at once
    m = np.diag([3.0, 3.0] + [0.0] * 24)
    values, vectors, _ = whitening.leading_pairs(lambda q: m @ q, 26, 4, block=2)
    assert np.allclose(values, [3, 3, 0, 0], atol=1e-12) and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)


# search


def plain_search(rows, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q, v in rows:
        if q % 100 == 0:
            score = np.sqrt(((x - np.array(v, float)) ** 2).sum(axis=1))
            score[ids == q] = np.inf
            order = np.lexsort((ids, score))[: min(k, (ids != q).sum())]
            out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def grouped(found):
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_search_of_the_table_reaches_its_recall(spark):
    rows = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.1/embeddings.parquet'").fetchall()
    rows += [(i + 10_000, [c + 0.001 * (i % 7) for c in v]) for i, v in rows]
    found = grouped(partition_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect())
    want = plain_search(rows, 10)
    assert found.keys() == want.keys()
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    assert all(len(v) == 10 and v == sorted(v, key=lambda x: (x[1], x[0])) for v in found.values())
    at = dict(rows)
    for q, near in found.items():
        assert all(abs(math.dist(at[q], at[i]) - s) < 1e-12 for i, s in near)


def test_search_is_exact_with_one_part_and_handles_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(-3, 3) / 2 for _ in range(4)]) for i in range(1, 400)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(0, 900, 50)] + [(2000, [0.5, 0.5, 0.5, 0.5]), (2100, [0.1, 0.2, 0.3, 1e-3])]
    rows = [(i, v) for i, v in rows if any(v)]
    odd = [(3000, None), (3100, [0.0] * 4), (3200, [1.0, None, 1.0, 1.0]), (3300, [1.0, float("nan"), 1.0, 1.0]), (3400, [float("inf")] * 4), (None, [0.5] * 4), (3500, []), (3600, [-0.0] * 4), (2000, [0.5] * 4)]
    other = [(5000, [1.0, 2.0]), (5001, [1.0, 2.5]), (5100, [9.0, 9.0, 9.0])]
    frame = spark.createDataFrame([(*r, 1, "a") for r in rows + odd + other], "vec_id long, embedding array<double>, rank int, x string")
    found = grouped(partition_search.nearest(frame, F.col("vec_id") % 100 == 0).collect())
    assert found == {**plain_search(rows, 10), 5000: [(5001, 0.5)]}
    assert partition_search.nearest(frame.filter("vec_id < 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_search_splits_large_parts_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(partition_search, "rows_a_matrix", lambda dim: 37)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(0, 600)] + [(10_000 + 10 * i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(500)]
    found = grouped(partition_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect())
    assert found == plain_search(rows, 10)


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((8, 6)) * 20
    x = np.repeat(centres, 50, axis=0) + rng.standard_normal((400, 6))
    near = partition_search.near_rows(x, np.arange(400), 10)
    part = partition_search.balanced_parts(near, 8)
    assert np.bincount(part).tolist() == [50] * 8
    assert (part[:, None] == part[near]).mean() > 0.95
    router = partition_search.fitted(x[rng.permutation(400)], 8, 10)
    assert router.probes <= 3


def test_as_many_parts_as_there_may_be():
    x = np.random.default_rng(6).standard_normal((4 * partition_search.MOST_PARTS, 4))
    part = partition_search.balanced_parts(partition_search.near_rows(x, np.arange(len(x)), 10), partition_search.MOST_PARTS)
    assert np.bincount(part).tolist() == [4] * partition_search.MOST_PARTS


def test_near_rows_hold_no_more_than_they_return():
    x = np.random.default_rng(7).standard_normal((6000, 4))
    tracemalloc.start()
    partition_search.near_rows(x, np.arange(len(x)), 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20


# turns


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        out += [(turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def plain_repair(rows):
    """Best first over all edits, without signatures."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, turns = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in turns)):
            break
        due = "assistant" if state == 2 else "user"
        heapq.heappush(heap, (cost + 3, audit + "I", i, step[state, due[0]], (*turns, (due, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, turns))
            if faults[i] in ("", "truncated"):
                short = 3 if faults[i] else 0
                heapq.heappush(heap, (cost + 3 + short, audit + "R", i + 1, step[state, due[0]], (*turns, (due, text))))
                if (state, role[:1]) in step:
                    heapq.heappush(heap, (cost + short, audit + "K", i + 1, step[state, role[:1]], (*turns, (role, text))))
    known = {t for t, _, _ in rows if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    sha = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in turns).encode()).hexdigest()
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha


def check_repair(found, rows):
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    got = {r.conv_id: r for r in found}
    assert got.keys() == by_conv.keys() and len(found) == len(got)
    for conv, mine in by_conv.items():
        assert tuple(got[conv])[1:] == plain_repair(plain_damage(mine)), conv


def test_repair_of_the_table(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    check_repair(queries.QUERIES["op13_signature_repair"](spark, SF).collect(), rows)


def test_repair_of_odd_rows(spark):
    rng = random.Random(8)
    roles, texts = ["user", "assistant", "system", "tool", "User", "", None], ["Yes.", "No", "", " \t", "Why?\n", None, "a!b", "é." * 300]
    rows = [(conv, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for conv in [None, *range(60)] for _ in range(rng.randrange(1, 14))]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, pos int")
    check_repair(turn_repair.repair(turn_repair.damaged(frame)).collect(), rows)
    assert turn_repair.repair(turn_repair.damaged(frame.filter("false"))).count() == 0


def test_long_conversations_are_repaired_piece_by_piece(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "PIECE", 7)
    rng = random.Random(9)
    rows = [(conv, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", "No", f"t{t}.", ""])) for conv in range(12) for t in range(rng.randrange(1, 120))]
    check_repair(turn_repair.repair(turn_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect(), rows)


def test_pieces_joined_end_to_end_equal_one_piece():
    rng = random.Random(0)
    for _ in range(200):
        s = "".join(rng.choice("suaoSUAOxuaua") for _ in range(rng.randrange(0, 30)))
        n = rng.randrange(1, 6)
        pieces = [s[i : i + n] for i in range(0, len(s), n)] or [""]
        options = [
            [{"first": f, "last": last, "cost": c, "audit": a} for f in ((0,) if i == 0 else range(4)) for last, (c, a) in turn_repair.cheapest(p, f, i == len(pieces) - 1).items()]
            for i, p in enumerate(pieces)
        ]
        cost, audit = turn_repair.best_chain(options)
        assert (cost, "".join(audit)) == min(turn_repair.cheapest(s, 0, True).values())
