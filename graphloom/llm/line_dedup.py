"""Operator 8: line dedup with sharded cuckoo filters backed by exact reference counts.

State: a table of references (key, doc_id, lines), one row for each document and line key, and a cuckoo
filter for each shard of the keys, which holds the keys that at least ``min_docs`` documents refer to. The
filters answer most lines without a join: a line that no filter knows is kept. What passes is checked
against the exact counts. References are added when documents arrive and subtracted when they are deleted,
and the filters take insertions and deletions alike, so deleting a batch leaves the state before it. A shard
whose filter has no room left is built anew from the exact counts, and when the references outgrow the number
of shards by two, all are dealt to more shards.

Lines travel as 128-bit keys, not as text. A key that many documents hold is spread over many tasks by a
salt when lines meet the filters; where they meet the counts, keys so frequent that their number is bounded
are broadcast and all others joined by shuffle.

Defined cases: null and empty texts have one empty line; keys shorter than ``min_chars`` are never dropped;
repeated doc_ids count as one document; rows with a null doc_id refer to one document that comes before all
others; repeated rows are each treated alike; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_name, written

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys that a shard's filter is made for.
SHARD_KEYS = 200_000
#: Copies of each filter, so that the lines of one shard are spread over as many tasks.
SALTS = 16
#: A key is broadcast if it has more than one in so many of all references; there are no more such keys than this, and
#: a row of the broadcast takes some 40 bytes.
HOT_SHARE = 100_000
#: Characters stripped from both ends of a line.
SPACES = "\\x20\\x09-\\x0D"

LEAST = -(1 << 63)


def line_key(line: Column) -> Column:
    """Stripped of white space at both ends, ASCII letters in lower case."""
    stripped = F.regexp_replace(line, f"^[{SPACES}]+|[{SPACES}]+$", "")
    return F.translate(stripped, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(text: Column, min_chars: int) -> Column:
    """For each line the 128-bit key, or null if the key is short."""

    def keyed(line: Column) -> Column:
        # white space at the ends only makes a line longer, so short lines need no key
        return F.when(F.length(line) >= min_chars, F.transform(F.array(line_key(line)), lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("k1"), F.xxhash64(F.lit(7), k).alias("k2"))))[0])

    return F.transform(text_lines(text), keyed)


class CuckooFilter:
    """Four 16-bit fingerprints a bucket; a fingerprint lies in one of two buckets. Supports deletion."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        self.n = 1 << max(3, (int(capacity / 0.9) // self.SLOTS + 1).bit_length())
        self.table = np.zeros((self.n, self.SLOTS), np.uint16) if table is None else table

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy()
        out = cls(0, table)
        out.n = len(table)
        return out

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        prints = (mixed >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = ((mixed >> np.uint64(16)) & np.uint64(self.n - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        hashed = (prints.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(7)
        return bucket ^ (hashed & np.uint64(self.n - 1)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> None:
        """Distinct keys, each inserted once. Raises ``OverflowError`` if there is no room; the filter is then of no use."""
        rng = np.random.default_rng(11)
        for p, a, b in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            if not (self._put(a, p) or self._put(b, p)):
                at = a
                for _ in range(self.KICKS):
                    slot = int(rng.integers(self.SLOTS))
                    p, self.table[at, slot] = int(self.table[at, slot]), p
                    at = int(self._other(np.array([at]), np.array([p], np.uint16))[0])
                    if self._put(at, p):
                        break
                else:
                    raise OverflowError("cuckoo filter is full")

    def _put(self, bucket: int, print_: int) -> bool:
        row = self.table[bucket]
        for slot in range(self.SLOTS):
            if not row[slot]:
                row[slot] = print_
                return True
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Keys that were inserted before."""
        for p, a, b in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for bucket in (a, b):
                hit = np.flatnonzero(self.table[bucket] == p)
                if len(hit):
                    self.table[bucket, hit[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, a, b = self._places(keys)
        return ((self.table[a] == prints[:, None]) | (self.table[b] == prints[:, None])).any(axis=1)


def build_filter(keys: np.ndarray) -> CuckooFilter:
    room = max(16, len(keys))
    while True:
        made = CuckooFilter(room)
        try:
            made.insert(keys)
            return made
        except OverflowError:
            room *= 2


@dataclass
class LineIndex:
    """references: shard, k1, k2, doc_id, n_lines; filters: shard, filter (bytes)."""

    references: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int

    @property
    def spark(self) -> SparkSession:
        return self.references.sparkSession

    def counts(self) -> DataFrame:
        """Keys of at least ``min_docs`` documents: k1, k2, n_docs, last_doc."""
        counted = self.references.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        return counted.filter(F.col("n_docs") >= self.min_docs)


def line_references(docs: DataFrame, shards: int, min_chars: int) -> DataFrame:
    """One row for each document and key: shard, k1, k2, doc_id, n_lines."""
    keys = F.filter(keyed_lines(F.col("text"), min_chars), lambda k: k.isNotNull())
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc_id"), F.explode(keys).alias("k"))
    counted = rows.groupBy(F.col("k.k1").alias("k1"), F.col("k.k2").alias("k2"), "doc_id").agg(F.count(F.lit(1)).alias("n_lines"))
    return counted.select(F.pmod("k1", F.lit(shards)).cast("int").alias("shard"), "k1", "k2", "doc_id", "n_lines")


def make_filters(frequent: DataFrame, shards: int, before: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """shard, filter: the keys ``frequent`` (k1) inserted into the filters ``before``, or new ones, and ``gone`` deleted.
    Of a shard of ``before`` that has no room for its new keys the filter is null."""
    order = {"filter": 0, "gone": 1, "new": 2}
    none = F.lit(None).cast("binary")
    rows = frequent.select(F.pmod("k1", F.lit(shards)).cast("int").alias("shard"), F.lit(order["new"]).alias("kind"), "k1", none.alias("filter"))
    if gone is not None:
        rows = rows.unionByName(gone.select(F.pmod("k1", F.lit(shards)).cast("int").alias("shard"), F.lit(order["gone"]).alias("kind"), "k1", none.alias("filter")))
    if before is not None:
        rows = rows.unionByName(before.select("shard", F.lit(order["filter"]).alias("kind"), F.lit(0).cast("long").alias("k1"), "filter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, old, parts = None, None, {1: [], 2: []}

        def close() -> pa.RecordBatch:
            new, lost = (np.concatenate([*parts[k], np.empty(0, np.int64)]) for k in (2, 1))
            if old is None:
                made = build_filter(new).to_bytes()
            else:
                changed = CuckooFilter.from_bytes(old)
                changed.delete(lost)
                try:
                    changed.insert(new)
                    made = changed.to_bytes()
                except OverflowError:
                    made = None
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([made], pa.binary())], ["shard", "filter"])

        for batch in batches:
            shards_, kinds, keys = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero((np.diff(shards_) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(shards_)], strict=True):
                if a == b:
                    continue
                if shard != shards_[a]:
                    if shard is not None:
                        yield close()
                    shard, old, parts = shards_[a], None, {1: [], 2: []}
                if kinds[a] == 0:
                    old = batch.column(3)[int(a)].as_py()
                else:
                    parts[int(kinds[a])].append(keys[a:b])
        if shard is not None:
            yield close()

    dealt = rows.repartition(max(1, min(shards, 4096)), "shard").sortWithinPartitions("shard", "kind", "k1")
    return dealt.mapInArrow(run, "shard int, filter binary")


def shards_for(references: int, min_docs: int) -> int:
    """Shards for so many references: a key in a filter has at least ``min_docs`` of them."""
    return max(1, -(-references // (SHARD_KEYS * min_docs)))


def in_shards(rows: DataFrame, shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int"))


def create_index(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shards: int | None = None) -> LineIndex:
    """The index of ``docs`` (columns doc_id, text). The number of shards follows the number of references."""
    references = written(line_references(docs, 1, min_chars).drop("shard"), "line-references")
    if shards is None:
        shards = shards_for(references.count(), min_docs)
    references = in_shards(references, shards)
    index = LineIndex(references, references, shards, min_docs, min_chars)
    index.filters = written(make_filters(index.counts().select("k1").distinct(), shards), "line-filters")
    return index


def _updated(index: LineIndex, references: DataFrame) -> LineIndex:
    """The index with other references; keys that cross ``min_docs`` are inserted into or deleted from the filters."""
    stored = written(references.drop("shard"), "line-references")
    shards = max(index.shards, shards_for(stored.count(), index.min_docs))
    if shards < 2 * index.shards:
        shards = index.shards
    after = LineIndex(in_shards(stored, shards), index.filters, shards, index.min_docs, index.min_chars)
    now = after.counts().select("k1").distinct()
    if shards > index.shards:
        after.filters = written(make_filters(now, shards), "line-filters")
        return after
    was = index.counts().select("k1").distinct()
    new, gone = now.join(was, "k1", "left_anti"), was.join(now, "k1", "left_anti")
    made = written(make_filters(new, shards, index.filters, gone), "line-filters")
    full = made.filter("filter is null").select("shard")
    if not full.isEmpty():
        again = in_shards(now, shards).join(full, "shard", "left_semi").select("k1")
        made = written(made.filter("filter is not null").unionByName(make_filters(again, shards)), "line-filters")
    after.filters = made
    return after


def insert_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    """Adds the references of ``docs``; those of a doc_id that is already there are summed."""
    both = index.references.unionByName(line_references(docs, index.shards, index.min_chars))
    return _updated(index, both.groupBy("shard", "k1", "k2", "doc_id").agg(F.sum("n_lines").alias("n_lines")))


def delete_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    """Subtracts the references of ``docs``, which were inserted with these texts."""
    less = line_references(docs, index.shards, index.min_chars).withColumn("n_lines", -F.col("n_lines"))
    both = index.references.unionByName(less).groupBy("shard", "k1", "k2", "doc_id").agg(F.sum("n_lines").alias("n_lines"))
    return _updated(index, both.filter("n_lines > 0"))


def probe(index: LineIndex, lines: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of ``lines`` (shard, k1, k2, doc_id) whose key a filter may hold."""
    none = F.lit(None).cast("binary")
    rows = lines.select("shard", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), "k1", "k2", "doc_id", none.alias("filter"))
    copies = index.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("doc_id"), "filter")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, None
        for batch in batches:
            places = batch.column(0).to_numpy().astype(np.int64) * salts + batch.column(1).to_numpy()
            known = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(places) != 0) | (np.diff(known) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(places)], strict=True):
                if a == b:
                    continue
                if places[a] != place:
                    place, held = places[a], None
                if known[a]:
                    held = CuckooFilter.from_bytes(batch.column(5)[int(a)].as_py())
                elif held is not None:
                    hit = held.contains(batch.column(2).to_numpy()[a:b])
                    if hit.any():
                        yield pa.RecordBatch.from_arrays([c.slice(int(a), int(b - a)).filter(pa.array(hit)) for c in batch.columns[2:5]], ["k1", "k2", "doc_id"])

    tasks = max(1, min(4096, index.shards * salts))
    dealt = rows.unionByName(copies).repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())
    return dealt.mapInArrow(run, "k1 long, k2 long, doc_id long")


def dropped_keys(index: LineIndex) -> DataFrame:
    """doc_id, k1, k2 of the lines that go: those of frequent keys outside the largest doc_id."""
    passed = probe(index, index.references)
    counts = index.counts()
    total = index.references.count()
    hot = counts.filter(F.col("n_docs") * HOT_SHARE > total)  # no more than HOT_SHARE rows
    rest = counts.filter(F.col("n_docs") * HOT_SHARE <= total)
    # lines of hot keys must not travel to the join by key
    cold = passed.join(F.broadcast(hot.select("k1", "k2")), ["k1", "k2"], "left_anti")
    checked = [passed.join(F.broadcast(hot), ["k1", "k2"]), cold.join(rest, ["k1", "k2"])]
    return checked[0].unionByName(checked[1]).filter(F.col("doc_id") < F.col("last_doc")).select("doc_id", "k1", "k2")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, index: LineIndex | None = None) -> DataFrame:
    """``docs`` (columns doc_id, text and others) with the text that stays, and n_lines and n_dropped.

    Columns of ``docs`` named n_lines or n_dropped are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    index = index or create_index(docs, min_docs, min_chars)
    key, gone = new_name(docs, "id"), new_name(docs, "gone")
    # drops come by document: no row is larger than its document has lines. They lie in about as many lists as the
    # root of their number, so that a line is compared with few of them
    drops = dropped_keys(index).groupBy(F.col("doc_id").alias(key)).agg(F.collect_set(F.struct("k1", "k2")).alias(gone))
    width = F.ceil(F.sqrt(F.size(gone))).cast("int")
    drops = drops.select(key, F.transform(F.sequence(F.lit(0), width - 1), lambda w: F.filter(F.col(gone), lambda k: F.pmod(k["k1"], width) == w)).alias(gone))
    joined = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))).join(drops.hint("shuffle_hash"), key, "left")
    lines = text_lines(F.col("text"))
    stays = F.filter(
        F.arrays_zip(lines.alias("line"), keyed_lines(F.col("text"), min_chars).alias("key")),
        lambda x: x["key"].isNull() | ~F.array_contains(F.get(F.col(gone), F.pmod(x["key"]["k1"], F.size(gone)).cast("int")), x["key"]),
    )
    kept = F.when(F.col(gone).isNull(), lines).otherwise(F.transform(stays, lambda x: x["line"]))
    out, text = new_name(docs, "kept"), F.col("text")
    rows = joined.withColumn(out, kept)
    n = F.size(lines)
    columns = [F.when(F.col(gone).isNull(), text).otherwise(F.array_join(out, "\n")).alias("text") if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*columns, n.cast("long").alias("n_lines"), (n - F.size(out)).cast("long").alias("n_dropped"))
