"""Operator 5: document fingerprints by a randomised edit embedding.

All texts share one random walk: at step j the embedding shows the character under a pointer, and a random
bit of (j, class of that character) decides whether the pointer moves on. Two texts that differ by few edits
fall into step again soon after each edit, so their embeddings differ in few places: edit distance becomes
Hamming distance. A fingerprint samples the embedding at ``slots`` places: each step belongs to a slot and has
a random priority, and the step of the lowest priority below the embedding's length speaks for its slot. The
choice depends on the length alone, and little on it, so texts of similar length sample the same steps.
The likeness of two fingerprints is the share of their used slots that agree.

Near duplicates are found by bands of sampled slots and verified on the whole fingerprints, in tasks bounded
as in the other joins; bands travel as hashes, and a fingerprint joins the buckets that hold more than it.
For edits, documents are put in order by ranges of doc_id. All but the last row of a range have their next document
beside them; the last rows and the first ones, two a range, meet in a second, small step.

Defined cases: a null text is an empty one; an empty fingerprint (all slots unused) is like another empty one
(1) and unlike all others (0); of equal doc_ids the greater text hash comes first; a null doc_id comes after
all others; a table of one row has itself as next document; an empty table gives no rows; other columns are
not read. Texts of any length are walked to their end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, only, written
from .components import connected_components
from .groups import block_pairs, tree_edges
from .tokens import blocks, slices, texts_of

SLOTS, CLASSES, PERIOD = 128, 64, 1 << 14
#: More steps than the walk over any string takes: a string has less than 2^31 characters, at two steps each on average.
LONGEST = 1 << 40
#: Characters whose walks are held at once.
WALK_CHARS = 3_000_000
BANDS, BAND_SLOTS, THRESHOLD, BLOCK = 40, 8, 0.8, 400
#: Used slots without which a fingerprint says too little of its text to be like any but its equals.
LEAST_USED = 32
#: Rows of buckets, and pairs of them, that a task compares at once.
ROWS, PAIRS = 8_000, 100_000
EMPTY = 16
SYMBOLS = np.frombuffer(b"0123456789abcdef-", np.uint8)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(seed)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(odd)
    return x ^ (x >> np.uint64(31))


class EditEmbedding:
    def __init__(self, slots: int = SLOTS, seed: int = 41):
        self.slots = slots
        rng = np.random.default_rng(seed)
        bits = rng.integers(0, 2, (CLASSES, PERIOD)).astype(bool)
        bits[:, -1] = True  # every class moves on at least once a period
        steps = np.arange(PERIOD)
        following = np.where(bits, steps, PERIOD)
        following = np.minimum.accumulate(following[:, ::-1], axis=1)[:, ::-1]
        # steps until the pointer has moved on
        self.advance = (following - steps + 1).astype(np.int32).ravel()
        self._sample(rng)

    def _sample(self, rng: np.random.Generator) -> None:
        """places: the steps that ever speak for a slot; speaks[k]: the step of each slot (or -1) once the first k
        places are below the length. New lowest priorities come at rates 1/t, so few steps are drawn."""
        found: list[tuple[int, int]] = []
        for slot in range(self.slots):
            # among the steps of one slot, the gap to the next lower priority is geometric in the lowest so far
            at, low = int(rng.geometric(1 / self.slots)) - 1, float(rng.random())
            while at < LONGEST:
                found.append((at, slot))
                at += int(min(rng.geometric(max(low / self.slots, 1e-12)), LONGEST))
                low *= float(rng.random())
        found.sort()
        self.places = np.array([p for p, _ in found], np.int64)
        self.speaks = np.full((len(found) + 1, self.slots), -1, np.int64)
        for k, (at, slot) in enumerate(found, 1):
            self.speaks[k] = self.speaks[k - 1]
            self.speaks[k, slot] = at

    def fingerprints(self, texts: list[str]) -> np.ndarray:
        """One row of slot values a text: 0 to 15, or 16 for an unused slot."""
        out = np.full((len(texts), self.slots), EMPTY, np.uint8)
        order = sorted((i for i in range(len(texts)) if texts[i]), key=lambda i: -len(texts[i]))
        for begin, end in blocks([texts[i] for i in order], WALK_CHARS):
            self._walk([texts[i] for i in order[begin:end]], order[begin:end], out)
        return out

    def _walk(self, texts: list[str], rows: list[int], out: np.ndarray) -> None:
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        sizes = np.array([len(c) for c in codes])
        longest = int(sizes[0])
        # character i of all texts that have one lies in the run from starts[i]
        alive = len(codes) - np.cumsum(np.bincount(sizes, minlength=longest + 1))[:longest]
        starts = np.concatenate([[0], np.cumsum(alive)])
        turned = np.empty(int(starts[-1]), np.int32)
        for d, c in enumerate(codes):
            turned[starts[: len(c)] + d] = ((_mixed(c, 1) >> np.uint64(40)).astype(np.int32) & (CLASSES - 1)) * PERIOD
        # a walk of so many characters may take more steps than 32 bits count
        kind = np.int64 if longest > 1 << 28 else np.int32
        entered = np.empty(int(starts[-1]), kind)
        step = np.zeros(len(codes), kind)
        advance, mask = self.advance, PERIOD - 1
        begins = starts.tolist()
        for i, n in enumerate(alive.tolist()):
            run = slice(begins[i], begins[i + 1])
            now = step[:n]
            entered[run] = now
            now += advance[turned[run] + (now & mask)]
        for d, c in enumerate(codes):
            spoken = self.speaks[np.searchsorted(self.places, step[d])]
            used = spoken >= 0
            shown = np.searchsorted(entered[starts[: len(c)] + d], spoken[used], side="right") - 1
            out[rows[d], used] = (_mixed(c[shown], 2) >> np.uint64(44)).astype(np.uint8) & 15


_EMBEDDINGS: dict[int, EditEmbedding] = {}


def embedding(slots: int) -> EditEmbedding:
    only("edit fingerprints", _EMBEDDINGS)
    if slots not in _EMBEDDINGS:
        _EMBEDDINGS[slots] = EditEmbedding(slots)
    return _EMBEDDINGS[slots]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the slots used by either side that agree; 1 where neither uses any."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=-1)
    same = ((a == b) & (a != EMPTY)).sum(axis=-1)
    return np.where(used == 0, 1.0, same / np.maximum(used, 1))


def shown(prints: np.ndarray) -> list[str]:
    """One character a slot: a hexadecimal digit, or a dash for an unused slot."""
    data, width = SYMBOLS[prints].tobytes().decode("ascii"), prints.shape[1]
    return [data[i : i + width] for i in range(0, len(data), width)]


def read_shown(text: str) -> np.ndarray:
    values = np.frombuffer(text.encode("ascii"), np.uint8)
    return np.where(values == ord("-"), EMPTY, np.where(values >= 97, values - 87, values - 48)).astype(np.uint8)


def fingerprint_documents(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, n_chars, fingerprint of each row of ``docs`` (columns doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(1)):
                texts = texts_of(batch.column(1), begin, end)
                prints = shown(embedding(slots).fingerprints(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array([len(t) for t in texts], pa.int64()), pa.array(prints)], ["doc_id", "n_chars", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def edited_text(text: str, following: str) -> str:
    """The last third (rounded down) replaced by as many characters, or all, of the start of the next text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


EDIT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_bands int"
EDIT_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()]


def compare(doc_ids: list, texts: list[str], following: list[str], slots: int) -> list[pa.Array]:
    """The columns of ``EDIT_SCHEMA`` for documents and the texts that follow them."""
    edits = [edited_text(text, after) for text, after in zip(texts, following, strict=True)]
    # equal texts are walked once
    distinct = {text: i for i, text in enumerate(dict.fromkeys([*texts, *following, *edits]))}
    prints = embedding(slots).fingerprints(list(distinct))
    plain, after, changed = (prints[[distinct[t] for t in part]] for part in (texts, following, edits))
    return [
        pa.array(doc_ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
        pa.array(shown(plain), pa.string()),
        pa.array(shown(changed), pa.string()),
        pa.array(likeness(plain, changed), pa.float64()),
        pa.array(likeness(plain, after), pa.float64()),
        pa.array(equal_bands(band_values(plain), band_values(changed)).sum(axis=1).astype(np.int32), pa.int32()),
    ]


def fingerprint_edits(docs: DataFrame, slots: int = SLOTS, parts: int | None = None) -> DataFrame:
    """Each document (doc_id, text) against its edited text and the next document by descending doc_id."""
    spark = docs.sparkSession
    names = [c.split(" ")[0] for c in EDIT_SCHEMA.split(", ")]
    n_parts = parts or max(1, 2 * docs.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose next one is in the same part; of each part its first and last row (end 0 and 1), to be matched."""
        part, held, first = TaskContext.get().partitionId(), [], True

        def ends(end: int, doc_id: int | None, text: str) -> pa.RecordBatch:
            empty = [pa.nulls(1, kind) for kind in EDIT_TYPES[1:]]
            return pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), *empty, pa.array([part], pa.int32()), pa.array([end], pa.int32()), pa.array([text])], [*names, "part", "end", "text"])

        def whole(rows: list[tuple]) -> pa.RecordBatch:
            n = len(rows) - 1
            columns = compare([r[0] for r in rows[:-1]], [r[1] for r in rows[:-1]], [r[1] for r in rows[1:]], slots)
            return pa.RecordBatch.from_arrays([*columns, pa.array([part] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], [*names, "part", "end", "text"])

        for batch in batches:
            for begin, end in slices(batch.column(1)):
                held += zip(batch.column(0).slice(begin, end - begin).to_pylist(), texts_of(batch.column(1), begin, end), strict=True)
                if first:
                    yield ends(0, *held[0])
                    first = False
                if len(held) > 1:
                    yield whole(held)
                    held = held[-1:]
        if held:
            yield ends(1, *held[-1])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.monotonically_increasing_id().alias("at"))
    # the place is the last key, so rows that are alike in all else are dealt over ranges too
    order = [F.col("doc_id").desc_nulls_last(), F.desc("t1"), F.desc("t2"), F.col("at")]
    laid = rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    met = written(laid.mapInArrow(run, EDIT_SCHEMA + ", part int, end int, text string"), "edits")

    ends = met.filter("end is not null").select("part", "end", "doc_id", "text")
    # one row a part
    around = Window.orderBy("part")
    everything = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order_of = ends.filter("end = 0").select("part", F.coalesce(F.lead("part").over(around), F.min("part").over(everything)).alias("next_part"))
    firsts = ends.filter("end = 0").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    seams = ends.filter("end = 1").join(order_of, "part").join(firsts, "next_part").select("doc_id", "text", "following")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays(compare(*([batch.column(k)[i].as_py()] for k in range(3)), slots), names)

    return met.filter("end is null").select(*names).unionByName(seams.mapInArrow(match, EDIT_SCHEMA))


def levels_of(slots: int) -> list[int]:
    """Numbers of slots that bands are drawn from: all of them, and halves down to ``LEAST_USED``."""
    out = [slots]
    while out[-1] // 2 >= LEAST_USED:
        out.append(out[-1] // 2)
    return out


@lru_cache(maxsize=4)
def slots_of_bands(slots: int, bands: int, band_slots: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The slots in the order in which they are first used, and the places in that order that each band of each level takes."""
    order = np.argsort((embedding(slots).speaks >= 0).argmax(axis=0), kind="stable")
    picks = []
    for level, size in enumerate(levels_of(slots)):
        rng = np.random.default_rng([97, level])
        picks += [rng.choice(size, min(band_slots, size), replace=False) for _ in range(bands)]
    return order, picks


def band_values(prints: np.ndarray, threshold: float = THRESHOLD, bands: int = BANDS, band_slots: int = BAND_SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value of each band of sampled slots, and whether the fingerprint has that band; equal values mean equal slots.

    A longer text uses all the slots of a shorter one. So bands of each level are drawn from the slots that are used first,
    and a fingerprint has those of the level that its used slots fill, without a band that holds an unused slot. Two
    that are alike by ``threshold`` use numbers of slots that share a level."""
    slots = prints.shape[1]
    order, picks = slots_of_bands(slots, bands, band_slots)
    used = (prints != EMPTY).sum(axis=1)
    levels = levels_of(slots)
    values, has = np.zeros((len(prints), bands * len(levels)), np.int64), np.zeros((len(prints), bands * len(levels)), bool)
    for level, size in enumerate(levels):
        here = (used >= LEAST_USED) & (used >= np.floor(threshold * size)) & ((size == slots) | (used < 2 * size))
        rows = np.flatnonzero(here)
        if not len(rows):
            continue
        for b in range(level * bands, (level + 1) * bands):
            picked = prints[rows[:, None], order[picks[b]]]
            value = np.full(len(rows), b, np.uint64)
            for column in picked.T.astype(np.uint64):
                value = _mixed(value * np.uint64(31) + column, b)
            values[rows, b], has[rows, b] = value.view(np.int64), (picked != EMPTY).all(axis=1)
    return values, has


def equal_bands(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which bands both have, with equal values."""
    return (one[0] == two[0]) & one[1] & two[1]


def bucket_pairs(starts: np.ndarray, side: np.ndarray, across: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Left and right rows and the bucket of all pairs inside buckets, some ``PAIRS`` at a time: bucket i has the rows from
    starts[i] to starts[i + 1]; where ``across`` holds only pairs of two sides."""
    left, right, bucket, n = [], [], [], 0
    for i, (begin, end) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        if across[i]:
            one = np.flatnonzero(side[begin:end] == 0)
            two = np.flatnonzero(side[begin:end] == 1)
            a, b = np.repeat(one, len(two)), np.tile(two, len(one))
        else:
            a, b = pairs_of(end - begin) if end - begin <= 64 else np.triu_indices(end - begin, 1)
        left.append(a + begin)
        right.append(b + begin)
        bucket.append(np.full(len(a), i))
        n += len(a)
        if n >= PAIRS:
            yield np.concatenate(left), np.concatenate(right), np.concatenate(bucket)
            left, right, bucket, n = [], [], [], 0
    if n:
        yield np.concatenate(left), np.concatenate(right), np.concatenate(bucket)


def group_starts(keys: list[np.ndarray]) -> np.ndarray:
    """The first rows of the runs of rows with equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


@lru_cache(maxsize=64)
def pairs_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def first_met(prints: np.ndarray, left: np.ndarray, right: np.ndarray, band: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows, each with a band that both have in common, are alike enough and have no equal band before it.
    Bands of many buckets' rows are found at once."""
    ok = np.zeros(len(left), bool)
    for begin in range(0, len(left), PAIRS):
        part = slice(begin, begin + PAIRS)
        ok[part] = likeness(prints[left[part]], prints[right[part]]) >= threshold
    later = np.flatnonzero(ok & (band > 0))
    rows, place = np.unique(np.concatenate([left[later], right[later]]), return_inverse=True)
    values, has = band_values(prints[rows], threshold)
    for begin in range(0, len(later), PAIRS // 8):
        at = later[begin : begin + PAIRS // 8]
        one, two = (place[k + begin : k + begin + len(at)] for k in (0, len(later)))
        equal = equal_bands((values[one], has[one]), (values[two], has[two]))
        ok[at] = equal.argmax(axis=1) == band[at]
    return ok


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, slots: int = SLOTS, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint, n_links (other documents whose fingerprints are alike by ``threshold`` or more, equal ones
    included), component_id (smallest doc_id that links reach): one row for each row of ``docs``. Texts of a few characters,
    whose fingerprints use fewer than ``LEAST_USED`` slots, link with equal ones only."""
    rows = written(fingerprint_documents(docs, slots), "fingerprints")
    classes = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).withColumn("cls", F.xxhash64("fingerprint"))

    def band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values, has = band_values(np.stack([read_shown(t) for t in batch.column(1).to_pylist()]), threshold)
                row, band = np.nonzero(has)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(band, pa.int32()), pa.array(values[row, band])], ["cls", "band", "h"])

    spread = cut(classes.select("cls", "fingerprint").mapInArrow(band_rows, "cls long, band int, h long"))
    buckets = spread.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    placed = spread.join(buckets, ["band", "h"]).select("cls", "band", "h", F.inline(block_pairs(F.col("cls"), F.col("blocks"))))
    members = placed.join(classes.select("cls", "fingerprint", "copies"), "cls").select("band", "h", "one", "two", "side", "cls", "copies", "fingerprint")

    def linked(table: pa.Table) -> pa.RecordBatch:
        """Links and a tree of edges of the classes in the whole buckets of a table."""
        columns = [c.to_numpy() for c in table.select(range(7)).columns]
        prints = read_shown("".join(table.column(7).to_pylist())).reshape(len(table), -1)
        starts = np.append(group_starts(columns[:4]), len(table))
        first = starts[:-1]
        classes_here, own = np.unique(columns[5], return_inverse=True)
        links, tree = np.zeros(len(classes_here), np.int64), []
        for left, right, bucket in bucket_pairs(starts, columns[4], columns[2][first] != columns[3][first]):
            met = first_met(prints, left, right, columns[0][first[bucket]], threshold)
            left, right = left[met], right[met]
            np.add.at(links, own[left], columns[6][right])
            np.add.at(links, own[right], columns[6][left])
            tree += tree_edges(own[left], own[right], len(classes_here))
        some = np.flatnonzero(links)
        edges = np.array(tree, np.int64).reshape(-1, 2)
        others = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(classes_here[edges[:, 1]])])
        counts = np.concatenate([links[some], np.zeros(len(edges), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(classes_here[np.concatenate([some, edges[:, 0]])]), pa.array(counts), others], ["cls", "links", "other"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS:
                continue
            table = pa.Table.from_batches(held)
            # the last bucket may go on in the next batch
            whole = int(group_starts([table.column(k).to_numpy() for k in range(4)])[-1])
            if whole:
                yield linked(table.slice(0, whole))
            held = table.slice(whole).to_batches()
        if sum(b.num_rows for b in held):
            yield linked(pa.Table.from_batches(held))

    dealt = members.repartition("band", "h", "one", "two").sortWithinPartitions("band", "h", "one", "two", "cls")
    checked = cut(dealt.mapInArrow(verify, "cls long, links long, other long"))
    links = checked.groupBy("cls").agg(F.sum("links").alias("links"))
    parts = connected_components(checked.filter("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    named = classes.join(links, "cls", "left").join(parts.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("fingerprint", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", "n_links", "component_id")
