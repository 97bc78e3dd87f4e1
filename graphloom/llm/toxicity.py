"""Operator 2: toxicity by a bidirectional gated recurrent network with attention pooling.

A token is what stands between white space. Its input joins a word embedding and the maximum over the
embeddings of its character runs, so parts of unseen words still tell. A forward and a
backward recurrent layer read windows of ``WINDOW`` tokens, every ``STRIDE`` tokens; attention pools a window
into one logit, and a document's score comes from its strongest window. All windows of every text are scored.

Training runs in numpy on the driver, over a sample of labelled documents bounded in rows by ``sample_positive``
and ``sample_negative`` (the rows with the smallest hash of their id) and in bytes by ``SAMPLE_BYTES`` a label;
texts of more than ``SAMPLE_TEXT_BYTES`` do not teach, but are scored like all others. Words that speak for either
label and runs that speak for label 1 have embeddings, which start at their log odds in the sample; then all weights
are trained by Adam on the strongest window of each document and one other of clean ones. The threshold comes from
sample documents that training has not seen. The weights (some megabytes, bounded by the sample) are broadcast, and
documents are scored where they lie, without a shuffle, in slices of bounded size.

The gates use clipped lines in place of the logistic function and the hyperbolic tangent: they are as good
here and several times faster.

Defined cases: a null or empty text is one window of padding; without labels of both kinds in the sample
every score is the share of toxic labels (0 without any label); of several labels of a document the largest
counts, null labels do not count; repeated rows get equal scores; an empty table gives no rows; columns other
than doc_id and text are never inputs.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import new_name, only
from .tokens import blocks, slices, texts_of

WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM = 8, 4, 4
RUNS = (4, 5)
SAMPLE_POSITIVE, SAMPLE_NEGATIVE = 1000, 2000
EPOCHS, BATCH, RATE = 5, 48, 0.006
#: Bytes of texts a label in the sample, and of the longest text in it.
SAMPLE_BYTES, SAMPLE_TEXT_BYTES = 16 << 20, 1 << 20
#: A word or character run has an embedding if so many sample documents hold it and its log odds for label 1 are so
#: high; a word also if so many hold it and its log odds for label 0 are as high. All others share the zero embedding.
SUPPORT, CLEAN_SUPPORT, LEAST_ODDS = 3, 30, 0.5
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…¿¡–—"


def token_arrays(tokens: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of tokens as (their numbers, word hashes, hashes of their character runs with 0 for none)."""
    plain = [f"^{t.lower().strip(MARKS) or t}$" for t in tokens]
    sizes = np.array([len(t) for t in plain])
    widths = np.where(sizes <= 24, 24, 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(int))
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        for some in np.array_split(rows, -(-len(rows) * int(width) // 400_000)):
            codes = np.array([plain[i] for i in some], dtype=f"U{width}").view(np.uint32).reshape(len(some), width).astype(np.uint64)
            word = np.zeros(len(some), np.uint64)
            for column in codes.T:
                word = np.where(column > 0, (word ^ column) * np.uint64(0x100000001B3) + np.uint64(7), word)
            runs = []
            for n in RUNS:
                value = np.zeros((len(some), width - n + 1), np.uint64)
                for k in range(n):
                    value = (value ^ codes[:, k : width - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                runs.append(np.where(codes[:, n - 1 :] > 0, value, np.uint64(0)))
            yield some, word * np.uint64(0x9E3779B97F4A7C15), np.concatenate(runs, axis=1)


class HashIndex:
    """Numbers from 1 for distinct 64-bit keys other than 0, in their order; 0 for all others."""

    def __init__(self, keys: np.ndarray):
        bits = max(16, int(len(keys) * 4).bit_length())
        keys = keys.astype(np.uint64)
        order = np.argsort(keys, kind="stable")
        self.size, self.shift = len(keys) + 1, np.uint64(64 - bits)
        # keys in order, found by their first bits; as many empty places follow as the fullest run of first bits has
        counts = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.most = int(counts.max(initial=0))
        self.starts = (np.cumsum(counts) - counts).astype(np.int32)
        self.keys = np.concatenate([keys[order], np.zeros(self.most, np.uint64)])
        self.numbers = np.concatenate([order + 1, np.zeros(self.most, np.int64)]).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out, at = np.zeros(hashes.shape, np.int32), self.starts[hashes >> self.shift]
        for step in range(self.most):
            out = np.where(self.keys[at + step] == hashes, self.numbers[at + step], out)
        return out


class Vocabulary:
    """Numbers for tokens, in the order they come; number 0 is padding."""

    def __init__(self):
        self.numbers: dict[str, int] = {}

    def add(self, tokens: set[str]) -> list[str]:
        new = sorted(t for t in tokens if t not in self.numbers)
        for t in new:
            self.numbers[t] = len(self.numbers) + 1
        return new


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of these many tokens, laid end to end: positions of each window's tokens, whether they are
    within the document, and the document of each window."""
    count = np.maximum(1, -(-(lengths - (WINDOW - STRIDE)) // STRIDE))
    doc = np.repeat(np.arange(len(lengths)), count)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begins = np.cumsum(lengths) - lengths
    place = first[:, None] * STRIDE + np.arange(WINDOW)[None, :]
    inside = place < lengths[doc][:, None]
    return np.where(inside, begins[doc][:, None] + place, 0), inside, doc


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * x + 0.5, 0, 1)


def _clip(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -1, 1)


class Network:
    def __init__(self, words: HashIndex, runs: HashIndex, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.words, self.runs = words, runs
        d, h = WORD_DIM + CHAR_DIM, HIDDEN

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"word": normal(words.size, WORD_DIM, scale=0.05), "char": normal(runs.size, CHAR_DIM, scale=0.05)}
        for side in "fb":
            self.p[f"W{side}"] = normal(d, 3 * h, scale=0.4)
            self.p[f"U{side}"] = normal(h, 3 * h, scale=0.2)
            self.p[f"B{side}"] = np.zeros(3 * h, np.float32)
        self.p |= {"A": normal(2 * h, h, scale=0.4), "a": normal(h, scale=0.4), "o": normal(2 * h, scale=0.4), "c": np.zeros(1, np.float32)}
        self.shift = 0.0

    # the input of a token

    def inputs(self, word: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of tokens given as numbers of their word and runs, and for each character dimension the run whose
        embedding gave the maximum."""
        if not runs.any():
            return np.concatenate([self.p["word"][word], np.zeros((len(word), CHAR_DIM), np.float32)], axis=1), np.zeros((len(word), CHAR_DIM), np.int64)
        table = self.p["char"][runs]
        best = table.argmax(axis=1)
        top = np.take_along_axis(table, best[:, None, :], axis=1)[:, 0]
        return np.concatenate([self.p["word"][word], top], axis=1), np.take_along_axis(runs, best, axis=1)

    def embedding_gradients(self, word: np.ndarray, from_run: np.ndarray, by_token: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the embeddings from those of the inputs of tokens (their words, and the runs that gave each
        character dimension). The shared zero embedding stays."""
        g = {"word": np.zeros_like(self.p["word"]), "char": np.zeros_like(self.p["char"])}
        np.add.at(g["word"], word, by_token[:, :WORD_DIM])
        for k in range(CHAR_DIM):
            np.add.at(g["char"][:, k], from_run[:, k], by_token[:, WORD_DIM + k])
        g["word"][0], g["char"][0] = 0, 0
        return g

    # windows

    def _scan(self, x: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """``x``: projected inputs, step by step (steps, windows, 3h). The states after each step."""
        h3, h = 3 * HIDDEN, HIDDEN
        u = self.p[f"U{side}"]
        state = np.zeros((x.shape[1], h), np.float32)
        states, kept = np.empty((x.shape[0], x.shape[1], h), np.float32), []
        for t in range(x.shape[0]) if side == "f" else range(x.shape[0] - 1, -1, -1):
            gates = x[t, :, : 2 * h] + state @ u[:, : 2 * h]
            opened = _gate(gates)
            z, r = opened[:, :h], opened[:, h:]
            pre = x[t, :, 2 * h : h3] + (r * state) @ u[:, 2 * h :]
            new = _clip(pre)
            if keep:
                kept.append((t, state, z, r, pre, new, np.abs(gates) < 2))
            state = state + z * (new - state)
            states[t] = state
        return states, kept

    def logits(self, project: dict[str, np.ndarray], inside: np.ndarray, keep: bool = False):
        """``project``: for each side the projected inputs of the windows (steps, windows, 3h)."""
        (sf, kf), (sb, kb) = (self._scan(project[s], s, keep) for s in "fb")
        both = np.concatenate([sf, sb], axis=2)
        hidden = _clip(both @ self.p["A"])
        energy = hidden @ self.p["a"]
        energy = np.where(inside.T | ~inside.any(axis=1)[None, :], energy, -1e9)
        weight = np.exp(energy - energy.max(axis=0))
        weight /= weight.sum(axis=0)
        # a window's logit is the mean of its tokens' logits under attention
        own = both @ self.p["o"]
        out = (weight * own).sum(axis=0) + self.p["c"][0]
        return (out, (both, hidden, weight, own, kf, kb)) if keep else out

    def backward(self, x: np.ndarray, gradient: np.ndarray, kept: tuple) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights, and of the inputs ``x`` (steps, windows, d)."""
        both, hidden, weight, own, kf, kb = kept
        g: dict[str, np.ndarray] = {"c": np.array([gradient.sum()], np.float32)}
        mean = (weight * own).sum(axis=0)
        d_own = weight * gradient
        d_energy = weight * (own - mean) * gradient
        g["o"] = np.einsum("tn,tnk->k", d_own, both)
        g["a"] = np.einsum("tn,tnk->k", d_energy, hidden)
        d_hidden = d_energy[:, :, None] * self.p["a"] * (np.abs(hidden) < 1)
        g["A"] = np.einsum("tnk,tnh->kh", both, d_hidden)
        d_both = d_own[:, :, None] * self.p["o"] + d_hidden @ self.p["A"].T
        dx = np.zeros_like(x)
        h = HIDDEN
        for side, steps, part in (("f", kf, d_both[:, :, :h]), ("b", kb, d_both[:, :, h:])):
            u, w = self.p[f"U{side}"], self.p[f"W{side}"]
            gu, gw, gb = np.zeros_like(u), np.zeros_like(w), np.zeros(3 * h, np.float32)
            carry = np.zeros((x.shape[1], h), np.float32)
            for t, before, z, r, pre, new, open_ in reversed(steps):
                ds = part[t] + carry
                d_new = ds * z * (np.abs(pre) < 1)
                d_z = ds * (new - before)
                d_rs = d_new @ u[:, 2 * h :].T
                d_gates = np.concatenate([d_z, d_rs * before], axis=1) * 0.25 * open_
                carry = ds * (1 - z) + d_rs * r + d_gates @ u[:, : 2 * h].T
                gu[:, : 2 * h] += before.T @ d_gates
                gu[:, 2 * h :] += (r * before).T @ d_new
                d_all = np.concatenate([d_gates, d_new], axis=1)
                gw += x[t].T @ d_all
                gb += d_all.sum(axis=0)
                dx[t] += d_all @ w.T
            g[f"U{side}"], g[f"W{side}"], g[f"B{side}"] = gu, gw, gb
        return g, dx


class Scorer:
    """Scores texts. Projected inputs of tokens are kept up to about ``limit`` tokens."""

    def __init__(self, network: Network, limit: int = 150_000):
        self.net, self.limit = network, limit
        self._reset()

    def _reset(self) -> None:
        self.vocabulary = Vocabulary()
        self.tables = {s: np.tile(self.net.p[f"B{s}"], (1024, 1)) for s in "fb"}

    def _admit(self, used: set[str]) -> None:
        new = self.vocabulary.add(used)
        size = len(self.vocabulary.numbers) + 1
        for s, table in self.tables.items():
            if size > len(table):
                self.tables[s] = np.concatenate([table, np.tile(self.net.p[f"B{s}"], (size - len(table) + size // 2 + 1024, 1))])
        if new:
            first = size - len(new)
            for rows, word, runs in token_arrays(new):
                x, _ = self.net.inputs(self.net.words.find(word), self.net.runs.find(runs))
                for s, table in self.tables.items():
                    table[first + rows] = x @ self.net.p[f"W{s}"] + self.net.p[f"B{s}"]

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [t.split() for t in texts]
        used = set().union(*split)
        if len(self.vocabulary.numbers) + len(used) > self.limit:
            self._reset()
        self._admit(used)
        get = self.vocabulary.numbers.__getitem__
        lengths = np.array([len(s) for s in split])
        numbers = np.fromiter((n for s in split for n in map(get, s)), np.int64, int(lengths.sum()))
        return numbers, lengths

    def window_logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Logits of all windows, the text of each, and the numbers of their tokens."""
        numbers, lengths = self._numbers(texts)
        place, inside, doc = windows(lengths)
        token = np.where(inside, numbers[place] if len(numbers) else 0, 0)
        out = np.empty(len(doc), np.float32)
        for begin in range(0, len(doc), 2048):
            part = token[begin : begin + 2048].T
            out[begin : begin + 2048] = self.net.logits({s: self.tables[s][part] for s in "fb"}, inside[begin : begin + 2048])
        return out, doc, (token, inside)

    def logits(self, texts: list[str]) -> np.ndarray:
        """The strongest window of each text."""
        out = np.empty(len(texts), np.float64)
        for begin, end in blocks(texts, 1_000_000):
            values, doc, _ = self.window_logits(texts[begin:end])
            starts = np.searchsorted(doc, np.arange(end - begin))
            out[begin:end] = np.maximum.reduceat(values, starts)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts) - self.net.shift, -40, 40)))


def telling(held: list[np.ndarray], labels: np.ndarray, clean: bool, prior: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that speak for label 1, or with ``clean`` for either label, by rising log odds, and these. ``held``:
    the distinct hashes of each document. Both labels weigh alike, and the odds are drawn to even by ``prior`` documents."""
    keys, at = np.unique(np.concatenate(held), return_inverse=True)
    owner = np.repeat(labels, [len(h) for h in held])
    hits = [np.bincount(at[owner == y], minlength=len(keys)) / max(1, (labels == y).sum()) for y in (0, 1)]
    total = np.bincount(at, minlength=len(keys))
    share = hits[1] / (hits[0] + hits[1])
    share = (total * share + prior * 0.5) / (total + prior)
    odds = np.log(share / (1 - share))
    good = (total >= SUPPORT) & (odds >= LEAST_ODDS)
    if clean:
        good |= (total >= CLEAN_SUPPORT) & (odds <= -LEAST_ODDS)
    good = np.flatnonzero(good & (keys != 0))
    good = good[np.argsort(odds[good], kind="stable")]
    return keys[good], np.clip(odds[good], -3, 3).astype(np.float32)


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.01 * (x * x - self.v[k])
            self.p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6)


def train(texts: list[str], labels: list[int], seed: int = 3, epochs: int = EPOCHS, rate: float = RATE) -> Network:
    """A network for texts of both labels. Every fifth text only sets the threshold."""
    y = np.array(labels)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    test, learn = order[::5], np.setdiff1d(order, order[::5])
    if len(set(y[learn].tolist())) < 2:
        test, learn = order, order

    # a vocabulary of its own: the embeddings change, so nothing projected is kept
    split = [texts[i].split() for i in learn]
    vocabulary = Vocabulary()
    new = vocabulary.add(set().union(*split))
    # the runs of token i stand from ends[i] to ends[i + 1]
    word_hash, owners, hashes = np.zeros(len(new) + 1, np.uint64), [], []
    for rows, w, r in token_arrays(new):
        word_hash[rows + 1] = w
        at, column = np.nonzero(r)
        owners.append((rows[at] + 1).astype(np.int32))
        hashes.append(r[at, column])
    owner = np.concatenate([np.empty(0, np.int32), *owners])
    order = np.argsort(owner, kind="stable")
    owner, run_hash = owner[order], np.concatenate([np.empty(0, np.uint64), *hashes])[order]
    del owners, hashes, order
    ends = np.searchsorted(owner, np.arange(len(new) + 2))
    numbers = [np.array([vocabulary.numbers[t] for t in s], np.int32) for s in split]
    seen = [np.unique(n) for n in numbers]
    word_keys, word_odds = telling([np.unique(word_hash[s]) for s in seen], y[learn], clean=True)
    run_keys, run_odds = telling([np.unique(np.concatenate([np.empty(0, np.uint64), *(run_hash[ends[i] : ends[i + 1]] for i in s.tolist())])) for s in seen], y[learn], clean=False)
    net = Network(HashIndex(word_keys), HashIndex(run_keys), seed)
    net.p["word"][1:, 0], net.p["char"][1:, 0] = word_odds, run_odds
    net.p["word"][0], net.p["char"][0] = 0, 0
    word = net.words.find(word_hash)
    # of each token the runs that have an embedding
    found = net.runs.find(run_hash)
    owner, found = owner[found > 0], found[found > 0]
    first = np.searchsorted(owner, np.arange(len(new) + 1))
    place_in_token = np.arange(len(owner)) - first[owner]
    runs = np.zeros((len(new) + 1, max(1, int(place_in_token.max(initial=0)) + 1)), np.int32)
    runs[owner, place_in_token] = found
    del run_hash, owner, found, split

    lengths = np.array([len(n) for n in numbers])
    place, inside, doc = windows(lengths)
    flat = np.concatenate([*numbers, np.zeros(1, np.int32)])
    token = np.where(inside, flat[np.minimum(place, len(flat) - 1)], 0)
    del place, flat, numbers
    starts, adam = np.searchsorted(doc, np.arange(len(learn) + 1)), Adam(net.p, rate)
    truth = y[learn].astype(np.float32)
    balance = np.where(truth == 1, 0.5 / max(truth.mean(), 1e-6), 0.5 / max(1 - truth.mean(), 1e-6))

    def project(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray], np.ndarray]:
        used, local = np.unique(token[rows], return_inverse=True)
        x, from_run = net.inputs(word[used], runs[used])
        x[used == 0] = 0
        local = local.reshape(len(rows), WINDOW).T
        return used, local, {s: (x @ net.p[f"W{s}"] + net.p[f"B{s}"])[local] for s in "fb"}, (x, from_run)

    for epoch in range(epochs):
        strongest = np.empty(len(doc), np.float32)
        for begin in range(0, len(doc), 2048):
            rows = np.arange(begin, min(begin + 2048, len(doc)))
            strongest[rows] = net.logits(project(rows)[2], inside[rows])
        # per document the strongest window, and one at random that is only used where the label is 0
        top = np.array([starts[i] + int(strongest[starts[i] : starts[i + 1]].argmax()) for i in range(len(learn))])
        other = starts[:-1] + (rng.random(len(learn)) * np.diff(starts)).astype(int)
        clean = np.flatnonzero(truth == 0)
        rows_all = np.concatenate([top, other[clean]])
        target = np.concatenate([truth, np.zeros(len(clean), np.float32)])
        scale = np.concatenate([balance, balance[clean]])
        shuffled = rng.permutation(len(rows_all))
        now = rate * (1 - 0.7 * epoch / max(1, epochs - 1))
        for begin in range(0, len(shuffled), BATCH):
            pick = shuffled[begin : begin + BATCH]
            rows = rows_all[pick]
            used, local, projected, (x, from_run) = project(rows)
            out, kept = net.logits(projected, inside[rows], keep=True)
            error = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - target[pick]) * scale[pick] / len(pick)
            g, dx = net.backward(x[local], error.astype(np.float32), kept)
            by_token = np.zeros_like(x)
            np.add.at(by_token, local.ravel(), dx.reshape(-1, x.shape[1]))
            by_token[used == 0] = 0
            adam.step(g | net.embedding_gradients(word[used], from_run, by_token), now)

    net.shift = threshold(Scorer(net).logits([texts[i] for i in test]), y[test])
    return net


def threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """A cut in the widest gap among those with the fewest errors, a wrong clean document counting twice; it lies
    nearer to the upper end of the gap, so that clean documents have more room."""
    order = np.argsort(logits)
    values, truth = logits[order], labels[order]
    cuts = np.concatenate([[values[0] - 2], 0.7 * values[1:] + 0.3 * values[:-1], [values[-1] + 2]])
    missed = np.concatenate([[0], np.cumsum(truth == 1)])
    wrong = (truth == 0).sum() - np.concatenate([[0], np.cumsum(truth == 0)])
    cost = missed + 2 * wrong
    gaps = np.concatenate([[0], np.diff(values), [0]])
    best = np.flatnonzero(cost == cost.min())
    return float(cuts[best[gaps[best].argmax()]])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, positive: int, negative: int) -> list[tuple[str, int]]:
    """(text, label) of at most so many labelled documents of each label outside the held-out fold, within the bounds
    on bytes: by rising hash, until the bytes are used up."""
    known = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit(29)), "doc_id"]
    picked = [known.filter(F.col("toxic") == y).orderBy(*order).limit(n) for y, n in ((1, positive), (0, negative))]
    # no more rows than the bounds of the sample
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(F.octet_length("text") <= SAMPLE_TEXT_BYTES)
    texts = texts.join(chosen, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    used = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = texts.withColumn("used", used).filter(F.col("used") <= SAMPLE_BYTES).orderBy("doc_id").select("text", "toxic").collect()
    return [(r.text, int(r.toxic)) for r in rows]


_SCORERS: dict[str, Scorer] = {}


def score_documents(
    docs: DataFrame, labels: DataFrame, sample_positive: int = SAMPLE_POSITIVE, sample_negative: int = SAMPLE_NEGATIVE
) -> DataFrame:
    """All columns of ``docs`` (doc_id, text and others), and score and predicted; columns of these names are replaced."""
    sample = training_sample(docs, labels, sample_positive, sample_negative)
    share = sum(y for _, y in sample) / len(sample) if sample else 0.0
    docs = docs.drop("score", "predicted")
    if share in (0.0, 1.0):
        score = F.lit(float(share))
        return docs.select("*", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
    net = train([t for t, _ in sample], [y for _, y in sample])
    shared = docs.sparkSession.sparkContext.broadcast(net)
    name = hashlib.sha256(pickle.dumps(net.p)).hexdigest()
    text = new_name(docs, "scored_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity", _SCORERS)
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(shared.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for begin, end in slices(column):
                scores = pa.array(_SCORERS[name].scores(texts_of(column, begin, end)), pa.float64())
                yield pa.RecordBatch.from_arrays([*(c.slice(begin, end - begin) for c in batch.columns[:-1]), scores], [*batch.schema.names[:-1], "score"])

    rows = docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    scored = rows.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
