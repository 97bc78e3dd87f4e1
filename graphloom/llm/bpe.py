"""Operator 4: byte-level BPE encoding and decoding by a two-tier lookup.

A match of the split pattern that is a whole token is found by a minimal perfect hash of the vocabulary.
Any other match is merged from its bytes: a heap holds the ranks of neighbouring pairs and the bytes are
linked, so a merge costs the logarithm of the length. The vocabulary (some 50,000 tokens, one megabyte) is
read once on the driver and broadcast; its size does not depend on the data. Rows are not shuffled.

Defined cases: a null text is an empty one: no ids, empty bytes; very long matches cost n log n; repeated
rows are encoded each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import only

MASK = (1 << 64) - 1


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token, rank), by rank. Ranks are gapless from 0."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class PerfectHash:
    """Minimal perfect hash by displacement: n keys to n slots. Buckets of keys are placed largest first; each
    stores the displacement that puts its keys on free slots. A bucket of one key stores its slot."""

    def __init__(self, keys: list[bytes], load: int = 4):
        self.n, self.buckets = len(keys), max(1, len(keys) // load)
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            groups[h % self.buckets].append(i)
        self.shift = [0] * self.buckets
        self.slots: list[int] = [-1] * self.n
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        free = None
        for b in order:
            group = groups[b]
            if len(group) > 1:
                d = 1
                while True:
                    at = [self._slot(hashes[i], d) for i in group]
                    if len(set(at)) == len(at) and all(self.slots[s] < 0 for s in at):
                        break
                    d += 1
                self.shift[b] = d
                for i, s in zip(group, at, strict=True):
                    self.slots[s] = i
            elif group:
                free = free or [s for s in range(self.n) if self.slots[s] < 0]
                s = free.pop()
                self.shift[b] = -1 - s
                self.slots[s] = group[0]

    def _slot(self, h: int, d: int) -> int:
        return (((h ^ (d * 0x9E3779B97F4A7C15)) & MASK) * 0xD6E8FEB86659FD93 & MASK) % self.n

    def find(self, key: bytes) -> int:
        """The number of ``key`` if it is one of the keys, else that of some other key."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        return self.slots[-1 - d if d < 0 else self._slot(h, d)]


class ByteBpe:
    """Encoder of single matches."""

    def __init__(self, vocabulary: list[bytes], table: PerfectHash, limit: int = 500_000):
        self.vocabulary, self.table, self.limit = vocabulary, table, limit
        self.ranks = {t: i for i, t in enumerate(vocabulary)}
        self.seen: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """The lowest rank merges first, the leftmost of equal ones."""
        n, ranks = len(data), self.ranks
        after, before, end, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = []
        for i in range(n - 1):
            if (rank := ranks.get(data[i : i + 2])) is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or end[j] != stop or end[i] != j:
                continue
            alive[j] = False
            end[i], after[i] = stop, after[j]
            if (k := after[j]) < n:
                before[k] = i
                if (rank := ranks.get(data[i : end[k]])) is not None:
                    heapq.heappush(heap, (rank, i, end[k]))
            if (h := before[i]) >= 0 and (rank := ranks.get(data[h:stop])) is not None:
                heapq.heappush(heap, (rank, h, stop))
        return [ranks[data[i : end[i]]] for i in range(n) if alive[i]]

    def match(self, match: str) -> bytes:
        ids = self.seen.get(match)
        if ids is None:
            tokens.trim(self.seen, self.limit)
            data = match.encode()
            found = self.table.find(data)
            ids = self.seen[match] = tokens.packed([found] if self.vocabulary[found] == data else self.merge(data))
        return ids


class TextEncoder:
    """Ids of a text, as packed bytes: those of each match of the pattern."""

    def __init__(self, bpe: ByteBpe, split: str):
        self.bpe, self.findall = bpe, tokens.pattern(split).findall

    def __call__(self, text: str) -> bytes:
        body = text[1:] if text[:1] == " " else text
        if body.isalpha():
            return self.bpe.match(text)
        return b"".join(map(self.bpe.match, self.findall(text)))


class Decoder:
    """Bytes of ids."""

    def __init__(self, vocabulary: list[bytes]):
        self.get = vocabulary.__getitem__

    def __call__(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.get, ids.tolist()))


_CODECS: dict[str, tuple[tokens.PieceCache, Decoder, list[bytes]]] = {}


def codec(name: str, vocabulary: list[bytes], table: PerfectHash, split: str) -> tuple[tokens.PieceCache, Decoder, list[bytes]]:
    """One codec for each vocabulary and Python process."""
    only("byte BPE", _CODECS)
    if name not in _CODECS:
        decimal = [b"%d" % i for i in range(len(vocabulary))]
        _CODECS[name] = tokens.PieceCache(TextEncoder(ByteBpe(vocabulary, table), split)), Decoder(vocabulary), decimal
    return _CODECS[name]


def encode_documents(docs: DataFrame, ranks_path: str, split: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document (columns doc_id, text) and, if ``with_ids``,
    ids and decoded (the bytes that the ids decode to)."""
    vocabulary = load_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, PerfectHash(vocabulary)))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, decode, decimal = codec(ranks_path + split, *shared.value, split)
        sha256 = hashlib.sha256
        for batch in batches:
            for begin, end in tokens.slices(batch.column(1)):
                n, coded, plain, all_ids, all_bytes = [], [], [], [], []
                for raw in cache.encode(tokens.texts_of(batch.column(1), begin, end)):
                    ids = np.frombuffer(raw, dtype="<u4")
                    n.append(len(ids))
                    numbers = ids.tolist()
                    coded.append(sha256(b",".join(map(decimal.__getitem__, numbers))).hexdigest())
                    data = decode(ids)
                    plain.append(sha256(data).hexdigest())
                    if with_ids:
                        all_ids.append(numbers)
                        all_bytes.append(data)
                arrays = [batch.column(0).slice(begin, end - begin), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_bytes, pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, schema)
