"""Operator 1: n-gram Jaccard join by MinHash banding.

Words are the lower-cased pieces between white space; a document's set holds its runs of five words, or all
its words as one run if it has fewer. Documents with equal sets form a class, so copies are joined once.
Each class has ``bands`` x ``rows`` MinHash values; the number of bands is the smallest that finds a pair at
the threshold with the target recall. Classes are shuffled by band hash. A bucket whose classes all share a
bucket of one earlier band is dropped, since the pairs in it are found there. What stays is verified on
the full sets inside the bucket's tasks; a pair in several buckets counts in the first band it shares.
Tasks return counts of links by class and a small tree of edges for each linked group, never the pairs.

A bucket of more than ``block`` classes is cut into blocks and each pair of blocks is a task of its own,
so a task's memory is bounded whatever a group's size. A class that many documents share is one row here,
so a hot group of copies shrinks before any shuffle of sets.

Defined cases: null and empty texts, and texts of white space alone, have no words: they link with nothing
and each is a class of its own; very long texts count whole; repeated rows are copies; a null doc_id is
allowed and stays null (such a row can link but has no id of its own: its class takes the smallest id there
is); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import cut, only, text_key, written
from .components import connected_components
from .groups import block_pairs, tree_edges

WORDS, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.999, 5
#: Classes in a block of a large bucket.
BLOCK = 400
NO_ID = (1 << 63) - 1  # stands for a null id: any other id is smaller


def choose_bands(threshold: float, recall: float, rows: int) -> int:
    """The fewest bands of ``rows`` values that find a pair at the threshold with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    LIMIT = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = WordHashes()


def shingles(text: str, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of ``words`` words."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    n = max(1, len(hashes) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(hashes))):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= hashes[k : k + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out)


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.odd = (rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        self.add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
        self.mix = rng.integers(0, 1 << 62, rows, dtype=np.uint64) | np.uint64(1)

    def signature(self, values: np.ndarray) -> np.ndarray:
        """One 64-bit hash a band."""
        low = (values ^ (values >> np.uint64(32))).astype(np.uint32)
        least = np.full(len(self.odd), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 1024):  # so that the table stays in the cache
            part = low[at : at + 1024]
            table = part[None, :] * self.odd[:, None]
            table ^= table >> np.uint32(15)
            table += self.add[:, None]
            np.minimum(least, table.min(axis=1), out=least)
        parts = (least.reshape(self.bands, self.rows).astype(np.uint64) * self.mix).sum(axis=1, dtype=np.uint64)
        parts ^= parts >> np.uint64(31)
        return (parts * np.uint64(0x94D049BB133111EB)).view(np.int64)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int64), pa.int64())


def signatures(docs: DataFrame, words: int, minhash: MinHash) -> DataFrame:
    """doc_id, t1, t2 (key of the text), s1, s2 (key of the set), n_grams, bands, one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("n-gram join", _WORDS)
        for batch in batches:
            for begin, end in tokens.slices(batch.column(3)):
                s1, s2, n, bands = [], [], [], []
                for text in tokens.texts_of(batch.column(3), begin, end):
                    grams = shingles(text, words)
                    a, b = divmod(xxhash.xxh3_128_intdigest(grams.tobytes()), 1 << 64)
                    s1.append(a - (1 << 63))
                    s2.append(b - (1 << 63))
                    n.append(len(grams))
                    bands.append(minhash.signature(grams) if len(grams) else np.empty(0, np.int64))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands)))
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(begin, end - begin) for c in batch.columns[:3]), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(n, pa.int32()), lists],
                    ["doc_id", "t1", "t2", "s1", "s2", "n_grams", "bands"],
                )

    key = text_key(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key["a"].alias("t1"), key["b"].alias("t2"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, t1 long, t2 long, s1 long, s2 long, n_grams int, bands array<long>")


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """The columns of ``docs`` (without text) and grams: the set as bytes."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("n-gram join", _WORDS)
        for batch in batches:
            column = batch.column(len(names))
            for begin, end in tokens.slices(column):
                grams = pa.array([shingles(t, words).tobytes() for t in tokens.texts_of(column, begin, end)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(begin, end - begin) for c in batch.columns[:-1]), grams], [*names, "grams"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return docs.select(*names, "text").mapInArrow(run, schema + ", grams binary")


def linked_pairs(grams: list[np.ndarray], bands: np.ndarray, band: int, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose first equal band is ``band`` and whose sets are similar enough. Where sides are
    given, only pairs across them."""
    n = len(grams)
    sizes = np.array([len(g) for g in grams])
    # rows by size: a partner is at most 1/threshold times larger
    order = np.argsort(sizes, kind="stable")
    values = np.concatenate([grams[i] for i in order]) if n else np.empty(0, np.uint64)
    _, codes = np.unique(values, return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(sizes[order])])
    out_a, out_b = [], []
    width = int(codes.max()) + 1 if len(codes) else 0
    mark = np.zeros(width, bool)
    reach = np.searchsorted(sizes[order], np.floor(sizes[order] / threshold + 1e-9), side="right")
    for i in range(n - 1):
        stop = int(reach[i])
        if stop <= i + 1:
            continue
        a = order[i]
        others = order[i + 1 : stop]
        ok = ~(bands[others, :band] == bands[a, :band]).any(axis=1) if band else np.ones(len(others), bool)
        if side is not None:
            ok &= side[others] != side[a]
        picked = np.flatnonzero(ok)
        if not len(picked):
            continue
        own = codes[ends[i] : ends[i + 1]]
        mark[own] = True
        if len(picked) * 4 > stop - i - 1:
            hits = np.add.reduceat(mark[codes[ends[i + 1] : ends[stop]]].astype(np.int32), (ends[i + 1 : stop] - ends[i + 1]))[picked]
        else:
            hits = np.array([int(mark[codes[ends[i + 1 + k] : ends[i + 2 + k]]].sum()) for k in picked])
        mark[own] = False
        union = len(own) + sizes[others[picked]] - hits
        good = picked[hits >= threshold * union - 1e-9]
        out_a += [a] * len(good)
        out_b += others[good].tolist()
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """``members``: bucket, one, two (blocks), band, side, cls, copies, bands, grams. Returns rows (cls, links, other):
    links in documents that a class has here, and edges (other not null)."""

    def group(rows: list[tuple], across: bool) -> Iterator[tuple[int, int, int | None]]:
        cls = np.array([r[0] for r in rows])
        copies = np.array([r[2] for r in rows])
        side = np.array([r[1] for r in rows]) if across else None
        left, right = linked_pairs([np.frombuffer(r[4], np.uint64) for r in rows], np.stack([r[3] for r in rows]), rows[0][5], side, threshold)
        links = np.zeros(len(rows), np.int64)
        np.add.at(links, left, copies[right])
        np.add.at(links, right, copies[left])
        for i in np.flatnonzero(links):
            yield int(cls[i]), int(links[i]), None
        for a, b in tree_edges(left, right, len(rows)):
            yield int(cls[a]), 0, int(cls[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = [], None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cls", "links", "other"])

        for batch in batches:
            buckets, ones, twos, bands_, sides, classes, copies = (batch.column(i).to_pylist() for i in range(7))
            lists, grams = batch.column(7), batch.column(8)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i in range(batch.num_rows):
                now = (buckets[i], ones[i], twos[i])
                if now != key:
                    if len(held) > 1:
                        out.extend(group(held, key[1] != key[2]))
                    held, key = [], now
                held.append((classes[i], sides[i], copies[i], values[offsets[i] : offsets[i + 1]], grams[i].as_py(), bands_[i]))
            if len(out) > 20_000:
                yield flush()
        if len(held) > 1:
            out.extend(group(held, key[1] != key[2]))
        yield flush()

    return members.select("bucket", "one", "two", "band", "side", "cls", "copies", "bands", "grams").mapInArrow(run, "cls long, links long, other long")


def join_documents(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, block: int = BLOCK, with_keys: bool = False) -> DataFrame:
    """doc_id, class_id (smallest doc_id with an equal set), n_links (other documents linked, copies included),
    component_id (smallest doc_id reachable by links), kept (the document of that id): one row for each row of ``docs``. With
    ``with_keys`` also t1 and t2, which stand for the text (``text_key``)."""
    bands = choose_bands(threshold, recall, rows)
    signed = written(signatures(docs, words, MinHash(bands, rows)), "signatures")
    full = signed.filter("n_grams > 0")

    # the text of the smallest (doc_id, text key) stands for the class
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "t1", "t2"))
    classes = full.groupBy("s1", "s2").agg(first.alias("f"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands"))
    classes = cut(classes.select("s1", "s2", F.col("f.id").alias("cls_doc"), F.col("f.t1").alias("t1"), F.col("f.t2").alias("t2"), "copies", "bands", F.xxhash64("s1", "s2").alias("cls")))

    # buckets of at least two classes: counted by their hashes alone, so the shuffle of all classes is narrow
    spread = classes.select("cls", F.posexplode("bands").alias("band", "h")).select("cls", "band", F.xxhash64("band", "h").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = cut(spread.join(shared, "bucket"))
    # one whose classes share a bucket of an earlier band adds no pair
    same = [F.min(F.col("bands")[k]).eqNullSafe(F.max(F.col("bands")[k])) & (F.max("band") > k) for k in range(bands)]
    whole = members.join(classes.select("cls", "bands"), "cls").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), (F.greatest(*same) if bands > 1 else same[0]).alias("seen"))
    buckets = whole.filter("n > 1 and not seen").select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    # a member meets the members of every block: once for each pair of blocks that holds its own
    placed = members.join(buckets, "bucket").select("cls", "band", "bucket", F.inline(block_pairs(F.col("cls"), F.col("blocks"))))
    placed = cut(placed)

    wanted = placed.select("cls").distinct().join(classes, "cls").select("cls", "cls_doc", "t1", "t2", "copies", "bands")
    key = text_key(F.coalesce(F.col("text").cast("string"), F.lit("")))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("cls_doc"), key["a"].alias("t1"), key["b"].alias("t2"), F.col("text").cast("string").alias("text"))
    found = texts.join(wanted.hint("shuffle_hash"), ["cls_doc", "t1", "t2"]).select("cls", "copies", "bands", "text")
    # a row that is repeated with its id gives its set once
    held = cut(sets_of(found, words).dropDuplicates(["cls"]))
    ready = placed.join(held, "cls")
    grouped = ready.repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two", "cls")
    checked = cut(verify(grouped, threshold))

    links = checked.groupBy("cls").agg(F.sum("links").alias("links"))
    parts = connected_components(checked.filter("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    named = classes.select("cls", "s1", "s2", "cls_doc", "copies").join(links, "cls", "left").join(parts.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("cls_doc").alias("component_doc"))
    named = named.join(least, "component").select("s1", "s2", "cls_doc", "component_doc", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))

    def back(c: str) -> Column:
        return F.when(F.col(c) == NO_ID, F.lit(None)).otherwise(F.col(c))

    keys = ["t1", "t2"] if with_keys else []
    linked = full.select("doc_id", "s1", "s2", *(F.col(k).alias(f"own_{k}") for k in keys)).join(named, ["s1", "s2"]).select("doc_id", back("cls_doc").alias("class_id"), "n_links", back("component_doc").alias("component_id"), *(F.col(f"own_{k}").alias(k) for k in keys))
    alone = signed.filter("n_grams = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"), *keys)
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
