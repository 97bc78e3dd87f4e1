"""Operators 1, 5 and 7 against brute force, and the components that they share."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import cap_filters, components, edit_fingerprint, ngram_join

DOCS = "doc_id long, text string, kept string, cls int"


class Sets:
    def __init__(self, keys):
        self.up = {k: k for k in keys}

    def root(self, k):
        while self.up[k] != k:
            k = self.up[k]
        return k

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(k, k + 1) for k in range(400, 480)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    sets = Sets(range(600))
    for a, b in edges:
        sets.join(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    want = {k: sets.root(k) for e in edges for k in e if e[0] != e[1]}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    sets, links = Sets(docs), dict.fromkeys(docs, 0)
    g = {k: grams(t) for k, t in docs.items()}
    for a in docs:
        for b in docs:
            if a < b and g[a] and g[b] and len(g[a] & g[b]) >= 0.8 * len(g[a] | g[b]):
                links[a] += 1
                links[b] += 1
                sets.join(a, b)
    return links, {k: sets.root(k) for k in docs}


def near_copies(n, words=120, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(words)] = rng.choice(vocabulary)
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("block", [400, 7])
def test_ngram_join_is_brute_force(spark, block):
    rng = random.Random(3)
    texts = near_copies(40) + [near_copies(1, seed=9)[0]] * 6 + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    texts += ["", None, "  \n", "one two", "One  TWO", "one two three four five", "x " * 5000]
    docs = dict(enumerate(texts))
    got = {r.doc_id: r for r in ngram_join.join_documents(spark.createDataFrame([(k, t, "a", 1) for k, t in docs.items()], DOCS), block=block).collect()}
    links, component = brute(docs)
    assert {k: r.n_links for k, r in got.items()} == links
    assert {k: r.component_id for k, r in got.items()} == component
    assert all(r.kept == (r.component_id == k) for k, r in got.items())
    assert got[45].class_id == 40


def test_ngram_join_of_odd_rows(spark):
    rows = [(None, "a b c d e f g", "", 0), (1, "a b c d e f g", "", 0), (2, "z", None, None), (2, "z", None, None), (None, None, None, None)]
    got = ngram_join.join_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r.doc_id), r.n_links) for r in got) == [("1", 1), ("2", 1), ("2", 1), ("None", 0), ("None", 1)]
    assert ngram_join.join_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_band_choice():
    assert ngram_join.choose_bands(0.8, 0.999, 5) == 18
    assert 1 - (1 - 0.8**5) ** 18 >= 0.999 > 1 - (1 - 0.8**5) ** 17


# embeddings


def vectors(n, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    near = base + rng.standard_normal((n, dim)) * rng.uniform(0.1, 0.5, (n, 1))
    return np.concatenate([base, near]).astype(np.float32)


def test_caps_link_what_brute_force_links(spark):
    x = vectors(300)
    group = (x[0] + np.random.default_rng(5).standard_normal((60, 64)) * 0.15).astype(np.float32)
    x = np.concatenate([x, group, x[:5]])
    labels = [k % 3 if k < 600 else 0 for k in range(len(x))]
    rows = [(k, v.tolist(), label) for k, (v, label) in enumerate(zip(x, labels, strict=True))]
    got = {r.vec_id: r for r in cap_filters.dedup_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=25).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(linked, False)
    assert all(got[k].n_links <= linked[k].sum() for k in got)
    assert sum(r.n_links for r in got.values()) >= 0.99 * linked.sum()
    sets = Sets(range(len(x)))
    for a, b in zip(*np.nonzero(linked), strict=True):
        sets.join(int(a), int(b))
    assert sum(got[k].component_id != sets.root(k) for k in got) <= 3
    assert got[660].n_links >= 1  # a copy


@pytest.mark.parametrize("dim", [1, 2, 3, 5, 8, 12, 16, 19, 20, 24, 32, 64, 256])
@pytest.mark.parametrize("members", [50, 20_000])
def test_pairs_at_the_threshold_share_a_filter(dim, members):
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((500, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((500, dim))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = x if dim == 1 else 0.93 * x + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    codes = cap_filters.CodeSet(dim, 0.93, members)
    met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(codes.decode(x), codes.decode(y), strict=True)]
    assert np.mean(met) >= 0.985


@pytest.mark.parametrize("dim", [24, 64, 256])
@pytest.mark.parametrize("members", [1000, 60_000, 1_000_000])
def test_work_of_a_vector_grows_with_the_root_of_its_label(dim, members):
    """Words that a vector meets, others in its filters that it is compared with, and filters that are shuffled."""
    x = np.random.default_rng(dim).standard_normal((300, dim))
    codes = cap_filters.CodeSet(dim, 0.93, members)
    filters = np.mean([len(row) for row in codes.decode(x / np.linalg.norm(x, axis=1, keepdims=True))])
    words = sum(len(c) for code in codes.codes for c in code.codes)
    assert filters <= 25
    assert words + members * filters**2 / (codes.span * len(codes.codes)) <= 60 * members**0.5


@pytest.mark.parametrize("dim", [2, 7, 16, 24])
def test_links_of_short_vectors(spark, dim):
    x = vectors(120, dim, seed=dim)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    got = {r.vec_id: r for r in cap_filters.dedup_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.93
    np.fill_diagonal(linked, False)
    assert all(got[k].n_links <= linked[k].sum() for k in got)
    assert sum(r.n_links for r in got.values()) >= 0.99 * linked.sum()


def test_caps_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.0], None), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1),
        (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [0.0, 1.0], 1), (11, [1e-40, 0.0], 1), (None, [1.0, 0.0], 1),
    ]
    got = {r.vec_id: r for r in cap_filters.dedup_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert {k: r.n_links for k, r in got.items()} == {0: 3, 1: 3, 11: 3, None: 3} | dict.fromkeys((2, 3, 4, 5, 6, 7, 8, 9, 10), 0)
    assert {k for k, r in got.items() if r.kept} == {0, 2, 3, 4, 5, 6, 7, 8, 9, 10}
    assert cap_filters.dedup_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_list_decoding_finds_all_exceeding_filters():
    code = cap_filters.ProductCode(12, words=20, parts=3, height=0.35)
    x = np.random.default_rng(1).standard_normal((30, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turned = x @ code.rotation
    a, b, c = (turned[:, p : p + 4] @ code.codes[p // 4].T for p in (0, 4, 8))
    sums = (a[:, :, None, None] + b[:, None, :, None] + c[:, None, None, :]).reshape(30, -1)
    for row, found in zip(sums, code.decode(x), strict=True):
        least = min(code.least, row.max() - 1e-9)
        assert set(found.tolist()) == set(np.flatnonzero(row >= least).tolist())


# fingerprints


def test_edits_against_brute_force(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcde fgh\n") for _ in range(rng.randint(0, 900))) for _ in range(80)] + ["", None, "é漢😀" * 50]
    rows = [(k, t, "a", 1) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in edit_fingerprint.fingerprint_edits(spark.createDataFrame(rows, DOCS).repartition(4), parts=5).collect()}
    order = sorted(got, reverse=True)
    assert len(got) == len(rows)
    alone = {r.doc_id: r.fingerprint for r in edit_fingerprint.fingerprint_documents(spark.createDataFrame(rows, DOCS)).collect()}
    for k, after in zip(order, [*order[1:], order[0]], strict=True):
        text, following = texts[k] or "", texts[after] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        assert got[k].n_chars == len(text)
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[k].fingerprint == alone[k]
        assert got[k].near_next == pytest.approx(edit_fingerprint.likeness(edit_fingerprint.read_shown(alone[k]), edit_fingerprint.read_shown(alone[after])))
    long = [r for r in got.values() if r.n_chars > 200]
    assert min(r.near_edited for r in long) > 0.45 > max(r.near_next for r in long)


def test_walk_is_the_step_by_step_walk():
    e = edit_fingerprint.EditEmbedding(slots=16)
    text = "the walk over these characters, é漢😀 too " * 5
    codes = np.array([ord(c) for c in text], np.uint32)
    kind = (edit_fingerprint._mixed(codes, 1) >> np.uint64(40)).astype(np.int64) & (edit_fingerprint.CLASSES - 1)
    at, step, shown = 0, 0, {}
    while at < len(text):
        shown[step] = at
        moves = e.advance[kind[at] * edit_fingerprint.PERIOD + step % edit_fingerprint.PERIOD] == 1
        at, step = at + int(moves), step + 1
    values = e.fingerprints([text])[0]
    spoken = e.speaks[np.searchsorted(e.places, step)]
    for slot, place in enumerate(spoken):
        want = edit_fingerprint.EMPTY if place < 0 else int(edit_fingerprint._mixed(codes[[shown[int(place)]]], 2)[0] >> np.uint64(44)) & 15
        assert values[slot] == want


def test_fingerprint_groups(spark):
    texts = near_copies(6, words=200) + [near_copies(1, words=200, seed=s)[0] for s in (31, 32, 33)] + ["", None]
    got = {r.doc_id: r.component_id for r in edit_fingerprint.near_duplicates(spark.createDataFrame([(k, t, "", 0) for k, t in enumerate(texts)], DOCS), threshold=0.7).collect()}
    assert [got[k] for k in range(9)] == [0] * 6 + [6, 7, 8]
    assert got[9] == got[10] == 9


def test_fingerprint_links_are_those_of_all_pairs(spark):
    texts = [t for s in range(12) for t in near_copies(5, words=150, seed=s)] + ["", None, "same", "same"]
    frame = spark.createDataFrame([(k, t, "", 0) for k, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in edit_fingerprint.near_duplicates(frame, block=7).collect()}
    prints = np.stack([edit_fingerprint.read_shown(got[k].fingerprint) for k in range(len(texts))])
    linked = np.stack([edit_fingerprint.likeness(p, prints) for p in prints]) >= edit_fingerprint.THRESHOLD
    np.fill_diagonal(linked, False)
    assert linked.sum() > 20 and all(got[k].n_links <= linked[k].sum() for k in got)
    assert sum(r.n_links for r in got.values()) >= 0.98 * linked.sum()


def test_short_texts_share_no_buckets_and_no_links_by_chance(spark):
    rng = random.Random(11)
    for n in (1, 3, 5, 10, 20, 50):
        texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ,.") for _ in range(n)) for _ in range(400)]
        prints = edit_fingerprint.embedding(edit_fingerprint.SLOTS).fingerprints(texts)
        values, has = edit_fingerprint.band_values(prints)
        largest = max((c for b in range(values.shape[1]) for c in Counter(values[has[:, b], b].tolist()).values()), default=0)
        assert largest <= 12, n
        frame = spark.createDataFrame([(k, t, "", 0) for k, t in enumerate(texts)], DOCS)
        got = {r.doc_id: r for r in edit_fingerprint.near_duplicates(frame).collect()}
        prints_of = Counter(r.fingerprint for r in got.values())
        assert sum(r.n_links > prints_of[r.fingerprint] - 1 for r in got.values()) <= 2, n


@pytest.mark.parametrize("n", [40, 80, 150, 400])
def test_recall_of_like_fingerprints_at_every_length(n):
    rng = random.Random(n)
    e, found, met = edit_fingerprint.embedding(edit_fingerprint.SLOTS), 0, 0
    for _ in range(150):
        text = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)]
        other = list(text)
        for _ in range(max(1, n // 40)):
            k = rng.randrange(len(other))
            rng.choice([lambda: other.insert(k, "x"), lambda: other.pop(k), lambda: other.__setitem__(k, "y")])()
        prints = e.fingerprints(["".join(text), "".join(other)])
        if edit_fingerprint.likeness(prints[0], prints[1]) >= 0.8:
            values, has = edit_fingerprint.band_values(prints)
            found += 1
            met += bool(((values[0] == values[1]) & has[0] & has[1]).any())
    assert found >= 10 and met >= 0.97 * found


def test_edits_of_repeated_and_null_ids(spark):
    rows = [(None, "same text again and again", "", 0)] * 20 + [(3, t, "", 0) for t in ("b", "a", "b", None)]
    got = edit_fingerprint.fingerprint_edits(spark.createDataFrame(rows, DOCS).repartition(3), parts=6).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((d, len(t or "")) for d, t, _, _ in rows)
    assert sum(r.near_next == 1.0 for r in got if r.doc_id is None) == 19


def test_edited_texts_are_walked_step_by_step(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh é") for _ in range(n)) for n in (5, 90, 400, 40)]
    e = edit_fingerprint.embedding(edit_fingerprint.SLOTS)
    got = {r.doc_id: r for r in edit_fingerprint.fingerprint_edits(spark.createDataFrame([(k, t, "", 0) for k, t in enumerate(texts)], DOCS), parts=3).collect()}
    for k, following in ((3, 2), (2, 1), (1, 0), (0, 3)):
        edited = edit_fingerprint.edited_text(texts[k], texts[following])
        at, step, places = 0, 0, {}
        codes = np.array([ord(c) for c in edited], np.uint32)
        kind = (edit_fingerprint._mixed(codes, 1) >> np.uint64(40)).astype(np.int64) & (edit_fingerprint.CLASSES - 1)
        while at < len(edited):
            places[step] = at
            at, step = at + int(e.advance[kind[at] * edit_fingerprint.PERIOD + step % edit_fingerprint.PERIOD] == 1), step + 1
        spoken = e.speaks[np.searchsorted(e.places, step)]
        want = "".join("-" if p < 0 else f"{int(edit_fingerprint._mixed(codes[[places[int(p)]]], 2)[0] >> np.uint64(44)) & 15:x}" for p in spoken)
        assert got[k].edited_fingerprint == want
        assert got[k].near_edited == pytest.approx(edit_fingerprint.likeness(edit_fingerprint.read_shown(got[k].fingerprint), edit_fingerprint.read_shown(want)))


def test_fingerprints_of_one_row_and_none(spark):
    row = edit_fingerprint.fingerprint_edits(spark.createDataFrame([(None, "abcdef", "", 0)], DOCS)).collect()
    assert [(r.doc_id, r.near_next, r.edited_sha256) for r in row] == [(None, 1.0, hashlib.sha256(b"abcdab").hexdigest())]
    assert edit_fingerprint.fingerprint_edits(spark.createDataFrame([], DOCS)).count() == 0
    same = edit_fingerprint.fingerprint_edits(spark.createDataFrame([(4, "abc", "", 0)] * 3, DOCS))
    assert same.count() == 3 and same.select(F.min("near_next")).first()[0] == 1


def test_fingerprints_of_many_buckets_are_compared_at_once(spark, monkeypatch):
    prints = edit_fingerprint.embedding(edit_fingerprint.SLOTS).fingerprints([t for s in range(40) for t in near_copies(3, words=150, seed=s)])
    calls = Counter()
    plain = edit_fingerprint.band_values
    monkeypatch.setattr(edit_fingerprint, "band_values", lambda *a: calls.update(["n"]) or plain(*a))
    starts, side = np.arange(0, 121, 3), np.zeros(120, int)
    pairs = list(edit_fingerprint.bucket_pairs(starts, side, np.zeros(40, bool)))
    assert sum(len(left) for left, _, _ in pairs) == 120
    values, has = plain(prints)
    for left, right, bucket in pairs:
        for band in (0, 1, 5):
            met = edit_fingerprint.first_met(prints, left, right, np.full(len(left), band), 0.8)
            for a, b, ok in zip(left, right, met, strict=True):
                equal = (values[a] == values[b]) & has[a] & has[b]
                alike = bool(edit_fingerprint.likeness(prints[a], prints[b]) >= 0.8)
                if equal[band]:
                    assert ok == (alike and not equal[:band].any())
    assert calls["n"] == 3
