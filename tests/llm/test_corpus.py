"""Operators 2, 3, 8 and 9, and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import chat, line_dedup, sharding, toxicity
from graphloom.llm.line_dedup import CuckooFilter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, shard_ string, n_lines int"

# chat

PARTS = ["</s>", "<s>", "[INST]", "[/INST]", " [/INST]", "<<SYS>>", "\n<</SYS>>\n", "<|role|>", "<|text|>", "<|end|>", "\\", "<", "/", "s>", "[", "]", " ", "\n", "a", "é"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "<|text|>"]), st.lists(st.sampled_from(PARTS), max_size=8).map("".join)), max_size=5))
def test_any_conversation_is_read_back(turns):
    rendered = [chat.format_turn(role, text) for role, text in turns]
    assert chat.parse("".join(r[0] for r in rendered)) == turns
    for (_, text), (formatted, begin, end, _) in zip(turns, rendered, strict=True):
        assert chat.unescape(formatted[begin:end]) == text


def test_parser_rejects_what_is_no_conversation():
    for text in ("hello", "[INST] a", "<s>a<s>", "[INST] a</s>", "<<SYS>>\na<</SYS>>\n"):
        with pytest.raises(chat.GrammarError):
            chat.parse(text)


def test_conversation_digests(spark):
    rows = [(1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", None), (2, 0, None, "x\\"), (2, None, "assistant", "first"), (3, 0, "assistant", ""), (None, 5, "user", "é")]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(frame)).collect()}
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: -1 if r[1] is None else r[1]):
        by[r[0]].append((r[2] or "", r[3] or ""))
    assert set(got) == set(by)
    for k, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k].n_turns == len(turns) and got[k].loss_chars == len(loss)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.conversation_digests(chat.format_conversations(frame.limit(0))).count() == 0


# line dedup


def test_cuckoo_filter():
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    made = line_dedup.build_filter(keys)
    assert made.contains(keys).all()
    others = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 20_000)
    assert made.contains(others).mean() < 0.01
    made.delete(keys[:2500])
    assert made.contains(keys[2500:]).all() and made.contains(keys[:2500]).mean() < 0.01
    assert CuckooFilter.from_bytes(made.to_bytes()).contains(keys[2500:]).all()


def brute_lines(docs):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(strip))
    holders = defaultdict(set)
    for k, text in docs:
        for line in (text or "").split("\n"):
            holders[key(line)].add(k)
    out = []
    for k, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(holders[key(x)]) < 5 or k == max(holders[key(x)])]
        out.append((k, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def line_docs():
    rng = random.Random(8)
    shared = ["Shared line number one that is long enough to count", "  ANOTHER shared line with spaces around its long text\t", "é" * 40, "short shared"]
    docs = [(k, "\n".join(rng.choice([*shared, f"own line {k} {rng.random()} with a lot of text after it"]) for _ in range(rng.randint(1, 6)))) for k in range(40)]
    return [*docs, (100, None), (101, ""), (102, "\n\n"), (103, shared[0].upper()), (103, shared[0].upper())]


def test_line_dedup_is_brute_force(spark):
    docs = line_docs()
    frame = spark.createDataFrame([(k, t, "s", 7) for k, t in docs], DOCS)
    got = line_dedup.dedup_lines(frame)
    assert got.columns == ["doc_id", "text", "shard_", "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()) == brute_lines(docs)
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0


def test_deleted_documents_leave_the_index_as_it_was(spark):
    docs = [d for d in line_docs() if d[0] < 100]
    frame = spark.createDataFrame([(k, t, "s", 7) for k, t in docs], DOCS)
    old, new = frame.filter("doc_id < 25"), frame.filter("doc_id >= 25")
    first = line_dedup.create_index(old, shards=3)
    both = line_dedup.insert_documents(first, new)
    assert sorted(both.references.collect()) == sorted(line_dedup.create_index(frame, shards=3).references.select(both.references.columns).collect())
    found = line_dedup.dedup_lines(frame, index=both)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()) == brute_lines(docs)
    back = line_dedup.delete_documents(both, new)
    assert sorted(back.references.collect()) == sorted(first.references.select(back.references.columns).collect())
    rest = line_dedup.dedup_lines(old, index=back)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in rest.collect()) == brute_lines([d for d in docs if d[0] < 25])


def test_an_index_grows_with_what_is_inserted(spark):
    rng = random.Random(5)
    few = [(k, f"a line that the first six documents share, number one of {0}") for k in range(6)]
    many = [(k, "\n".join(f"a line that many documents share, with the number {n}" for n in rng.sample(range(700), 100))) for k in range(100, 200)]
    first, second = (spark.createDataFrame([(k, t, "s", 0) for k, t in rows], DOCS) for rows in (few, many))
    index = line_dedup.create_index(first)
    both = line_dedup.insert_documents(index, second)  # the filter of the only shard is far too small
    found = line_dedup.dedup_lines(first.unionByName(second), index=both)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()) == brute_lines(few + many)
    back = line_dedup.delete_documents(both, second)
    rest = line_dedup.dedup_lines(first, index=back)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in rest.collect()) == brute_lines(few)


def test_an_index_splits_its_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    docs = line_docs()[:40]
    frame = spark.createDataFrame([(k, t, "s", 7) for k, t in docs], DOCS)
    index = line_dedup.create_index(frame.filter("doc_id < 3"))
    grown = line_dedup.insert_documents(index, frame.filter("doc_id >= 3"))
    assert grown.shards > index.shards
    found = line_dedup.dedup_lines(frame, index=grown)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()) == brute_lines(docs)


# sharding


def test_hypergeometric_law(spark):
    u = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    got = np.array([r[0] for r in u.select(F.expr(sharding.hypergeometric("30", "200", "50", "u"))).collect()])
    want = np.random.default_rng(1).hypergeometric(30, 170, 50, 200_000)
    assert abs(got.mean() - 7.5) < 0.01 and abs(got.std() - want.std()) < 0.05
    for good, total, drawn, value in ((0, 10, 5, 0), (10, 10, 5, 5), (3, 10, 10, 3), (3, 10, 0, 0), (0, 0, 0, 0)):
        assert spark.range(1).select(F.expr(sharding.hypergeometric(str(good), str(total), str(drawn), "0.7"))).first()[0] == value


def test_matrix_sums(spark):
    sizes = spark.createDataFrame([(p, n) for p, n in enumerate([5, 0, 17, 40, 1, 9, 30])], "part int, n long").filter("n > 0")
    rows = {r.part: r.counts for r in sharding.communication_matrix(sizes, 4, 3, 3).collect()}
    assert {p: sum(c) for p, c in rows.items()} == {0: 5, 2: 17, 3: 40, 4: 1, 5: 9, 6: 30}
    assert [sum(c) for c in zip(*rows.values(), strict=True)] == [26, 26, 25, 25]


def test_shards(spark):
    rows = [(k % 50, f"text {k % 60}", "s", k) for k in range(205)] + [(None, None, None, None)] * 3 + [(7, "é", "t", 0)]
    frame = spark.createDataFrame(rows, DOCS).repartition(6)
    got = sharding.shuffle_to_shards(frame, shards=4, bucket_rows=10).collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(len(s) for s in slots.values()) == [52, 52, 52, 53]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    digests = sharding.shard_documents(frame, shards=4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in digests) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    assert sharding.shuffle_to_shards(frame.limit(0)).count() == 0


def test_columns_of_any_name_pass_through_shards(spark):
    names = ["__bucket", "__ends", "__rank", "__n", "__first", "__part", "__key", "__all"]
    frame = spark.range(40).select("id", *(F.col("id").alias(n) for n in names), F.lit("x").alias("shard"), F.lit("y").alias("Slot")).repartition(3)
    got = sharding.shuffle_to_shards(frame, shards=3, bucket_rows=4)
    assert got.columns == ["id", *names, "shard", "slot"]
    rows = got.collect()
    assert sorted(r.id for r in rows) == list(range(40)) and all(r[n] == r.id for r in rows for n in names)


def test_matrix_of_many_parts(spark):
    sizes = spark.createDataFrame([(p, p % 7 + 1) for p in range(700)], "part int, n long")
    rows = sharding.communication_matrix(sizes, 3, 5, 10).collect()
    assert {r.part: sum(r.counts) for r in rows} == {p: p % 7 + 1 for p in range(700)}
    total = sum(p % 7 + 1 for p in range(700))
    assert sorted(sum(r.counts[s] for r in rows) for s in range(3)) == sorted(total // 3 + (s < total % 3) for s in range(3))


# toxicity


def toxic_rows(n, seed=0):
    rng = random.Random(seed)
    syllables = ["the", "an", "er", "ti", "on", "sh", "re", "wh"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs = []
    for k in range(n):
        words = [word() for _ in range(rng.randint(10, 200))]
        toxic = k % 3 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["scum", "gruk" + word()])
        docs.append((k, " ".join(words), int(toxic)))
    return docs


def test_toxicity_learns(spark):
    rows = toxic_rows(400)
    docs = spark.createDataFrame([(k, t, "x", 0) for k, t, _ in rows] + [(1000, None, "x", 0), (1001, "", "x", 0)], DOCS)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(5, None)], "doc_id long, toxic int")
    scored = toxicity.score_documents(docs, labels).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()
    truth = {k: y for k, _, y in rows}
    for r in scored:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in scored if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    assert {r.predicted for r in scored if r.doc_id >= 1000} == {0}


def test_toxicity_learns_from_the_whole_sample(monkeypatch):
    # long texts of both labels that share all frequent words
    words = [f"word{k}" for k in range(300)]
    texts = [" ".join([*words, *(f"own{i}x{k}" for k in range(20))]) for i in range(100)]
    labels = [i % 2 for i in range(100)]
    used, telling = [], toxicity.telling
    monkeypatch.setattr(toxicity, "telling", lambda held, y, clean: used.append(y) or telling(held, y, clean))
    toxicity.train(texts, labels, epochs=1)
    learn = np.setdiff1d(np.arange(100), np.random.default_rng(3).permutation(100)[::5])
    for y in used:
        assert Counter(y.tolist()) == Counter(labels[i] for i in learn)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "x", 0)], DOCS)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.score_documents(docs, labels).collect()] == [(0.0, 0)]


def test_gradients():
    rng = np.random.default_rng(0)
    empty = toxicity.HashIndex(np.empty(0, np.uint64))
    net = toxicity.Network(empty, empty)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    d = toxicity.WORD_DIM + toxicity.CHAR_DIM
    x = rng.standard_normal((6, 3, d)) * 0.3
    inside = np.ones((3, 6), bool)
    project = lambda: {s: x @ net.p[f"W{s}"] + net.p[f"B{s}"] for s in "fb"}
    weights = rng.standard_normal(3)
    _, kept = net.logits(project(), inside, keep=True)
    g, _ = net.backward(x, weights, kept)
    for name in ("Wf", "Uf", "Bb", "Ub", "A", "a", "o"):
        at = tuple(rng.integers(s) for s in net.p[name].shape)
        value, e = net.p[name][at], 1e-4
        net.p[name][at] = value + e
        up = net.logits(project(), inside) @ weights
        net.p[name][at] = value - e
        down = net.logits(project(), inside) @ weights
        net.p[name][at] = value
        assert g[name][at] == pytest.approx((up - down) / (2 * e), rel=0.05, abs=2e-3), name


def small_network(seed=5):
    """A network in double precision over some words and their runs."""
    words = ["scum", "tree", "house", "river", "grukon", "stone,"]
    word, runs = np.zeros(len(words), np.uint64), np.zeros((len(words), 41), np.uint64)
    for rows, w, r in toxicity.token_arrays(words):
        word[rows], runs[rows, : r.shape[1]] = w, r
    some = np.unique(runs[runs > 0])[::2]
    net = toxicity.Network(toxicity.HashIndex(word[:4]), toxicity.HashIndex(some), seed)
    rng = np.random.default_rng(seed)
    net.p = {k: rng.standard_normal(v.shape) * 0.4 for k, v in net.p.items()}
    net.p["word"][0], net.p["char"][0] = 0, 0
    return words, word, runs, net


def plain_logit(net, inputs):
    """One window, token by token."""
    h, gate, clip = toxicity.HIDDEN, lambda v: np.clip(0.25 * v + 0.5, 0, 1), lambda v: np.clip(v, -1, 1)
    states = {}
    for side in "fb":
        state, states[side] = np.zeros(h), [None] * len(inputs)
        for t in range(len(inputs)) if side == "f" else reversed(range(len(inputs))):
            x = inputs[t] @ net.p[f"W{side}"] + net.p[f"B{side}"]
            u = net.p[f"U{side}"]
            z, r = gate(x[:h] + state @ u[:, :h]), gate(x[h : 2 * h] + state @ u[:, h : 2 * h])
            new = clip(x[2 * h :] + (r * state) @ u[:, 2 * h :])
            state = (1 - z) * state + z * new
            states[side][t] = state
    both = [np.concatenate([f, b]) for f, b in zip(states["f"], states["b"], strict=True)]
    energy = np.array([clip(s @ net.p["A"]) @ net.p["a"] for s in both])
    return both, energy


def test_windowed_scores_are_those_of_a_plain_loop():
    words, word, runs, net = small_network()
    rng = random.Random(3)
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 5, 32, 33, 90)] + [" \n\t"]
    number = {w: i for i, w in enumerate(words)}

    def own_input(token):
        i = number[token]
        table = [net.p["char"][k] for k in net.runs.find(runs[i])]
        return np.concatenate([net.p["word"][net.words.find(word[i : i + 1])[0]], np.max(table, axis=0)])

    for text, got in zip(texts, toxicity.Scorer(net).logits(texts), strict=True):
        tokens, logits = text.split(), []
        count = max(1, -(-(len(tokens) - (toxicity.WINDOW - toxicity.STRIDE)) // toxicity.STRIDE))
        for k in range(count):
            part = tokens[k * toxicity.STRIDE : k * toxicity.STRIDE + toxicity.WINDOW]
            padding = [np.zeros(toxicity.WORD_DIM + toxicity.CHAR_DIM)] * (toxicity.WINDOW - len(part))
            both, energy = plain_logit(net, [own_input(t) for t in part] + padding)
            n = len(part) or toxicity.WINDOW  # a window of padding alone attends to all of it
            weight = np.exp(energy[:n] - energy[:n].max())
            logits.append(sum(w * (s @ net.p["o"]) for w, s in zip(weight / weight.sum(), both, strict=False)) + net.p["c"][0])
        assert got == pytest.approx(max(logits), abs=1e-4), text


def test_embedding_gradients():
    words, word, runs, net = small_network()
    token = np.random.default_rng(2).integers(0, len(words), (6, 3))
    inside, weights = np.ones((3, 6), bool), np.array([0.7, -1.1, 0.4])

    def forward(keep=False):
        x, from_run = net.inputs(net.words.find(word), net.runs.find(runs))
        project = {s: (x @ net.p[f"W{s}"] + net.p[f"B{s}"])[token] for s in "fb"}
        return x, from_run, net.logits(project, inside, keep=keep)

    x, from_run, (_, kept) = forward(keep=True)
    _, dx = net.backward(x[token], weights, kept)
    by_token = np.zeros_like(x)
    np.add.at(by_token, token.ravel(), dx.reshape(-1, x.shape[1]))
    g = net.embedding_gradients(net.words.find(word), from_run, by_token)
    checked = 0
    for name in ("word", "char"):
        for at in zip(*np.nonzero(g[name]), strict=True):
            value, e = net.p[name][at], 1e-3
            net.p[name][at] = value + e
            up = forward()[2] @ weights
            net.p[name][at] = value - e
            down = forward()[2] @ weights
            net.p[name][at] = value
            assert g[name][at] == pytest.approx((up - down) / (2 * e), rel=0.05, abs=1e-3), (name, at)
            checked += 1
    assert checked > 10


def test_hash_index_keeps_every_key():
    keys = np.unique(np.random.default_rng(4).integers(1, 1 << 63, 50_000).astype(np.uint64) | np.uint64(1))
    keys = np.concatenate([keys, keys[:100] ^ np.uint64(2)])  # neighbours on one slot
    index = toxicity.HashIndex(keys)
    assert (index.find(keys) == np.arange(1, len(keys) + 1)).all()
    assert not index.find(np.array([0, 12, 1 << 40], np.uint64)).any()
    assert not toxicity.HashIndex(np.empty(0, np.uint64)).find(keys[:5]).any()


def test_words_of_both_labels_have_embeddings():
    held = [np.array([1, 9], np.uint64)] * 40 + [np.array([2, 9], np.uint64)] * 40
    y = np.array([1] * 40 + [0] * 40)
    keys, odds = toxicity.telling(held, y, clean=True)
    assert dict(zip(keys.tolist(), np.sign(odds).tolist(), strict=True)) == {1: 1, 2: -1}
    assert toxicity.telling(held, y, clean=False)[0].tolist() == [1]


def test_training_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1000)
    monkeypatch.setattr(toxicity, "SAMPLE_TEXT_BYTES", 300)
    docs = spark.createDataFrame([(k, "x" * (400 if k % 7 == 0 else 90), "", 0) for k in range(100)] + [(None, "y", "", 0)], DOCS)
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)] + [(None, 1)], "doc_id long, toxic int")
    sample = toxicity.training_sample(docs, labels, 50, 5)
    assert sum(y for _, y in sample) == 11 and 1 <= sum(1 - y for _, y in sample) <= 5
    assert max(len(t) for t, _ in sample) == 90


def test_toxicity_of_odd_tables(spark):
    labels = spark.createDataFrame([(k, y) for k, _, y in toxic_rows(60)], "doc_id long, toxic int")
    rows = [(k, t, "x", 0) for k, t, _ in toxic_rows(60)] + [(None, "scum", "x", 1), (None, None, "x", 2)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("Score", F.lit("mine"))
    scored = toxicity.score_documents(docs, labels)
    assert scored.columns == ["doc_id", "text", "shard_", "n_lines", "score", "predicted"] and scored.count() == 62
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_every_token_is_in_a_window():
    place, inside, doc = toxicity.windows(np.array([0, 5, 32, 33, 56, 57, 500]))
    ends = np.cumsum([0, 5, 32, 33, 56, 57, 500])
    for d in range(7):
        mine = place[(doc == d)][inside[doc == d]]
        assert set(mine.tolist()) == set(range(ends[d - 1] if d else 0, ends[d]))


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "packing"]
    marked = docs.withColumns({"score": F.lit("mine"), "n_dropped": F.lit(1)})
    for _, stage in corpus_pipeline.STAGES[1:3]:
        assert stage(spark, marked, SF).columns == marked.columns
    ids = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    grams = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, t in rows.items() if (w := t.lower().split())}
    gone = set(rows) - ids
    for k in gone:
        assert any(len(grams[k] & grams[o]) >= 0.8 * len(grams[k] | grams[o]) for o in grams if o != k)
    stay = sorted(ids & set(grams))
    assert not any(len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) for i, a in enumerate(stay) for b in stay[i + 1 :])
    packed = corpus_pipeline.run(spark, SF)
    clash = docs.limit(30).withColumns({n: F.lit(5) for n in ("__t1", "__t2", "__id", "__g1", "n_dropped", "predicted")}).withColumn("score", F.lit("mine"))
    odd = clash.unionByName(clash.limit(2).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string")}))
    for _, stage in corpus_pipeline.STAGES[:3]:
        rows = stage(spark, odd, SF)
        assert rows.columns == odd.columns and stage(spark, odd.limit(0), SF).count() == 0
        assert {(r["__t1"], r["n_dropped"], r["predicted"], r["score"]) for r in rows.collect()} == {(5, 5, 5, "mine")}
    assert corpus_pipeline.pack(spark, odd, SF).filter("doc_id is null").count() == 2
    assert packed.count() > 0 and {r.doc_id for r in packed.select("doc_id").distinct().collect()} <= ids
