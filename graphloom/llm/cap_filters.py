"""Operator 7: embedding near-dedup by spherical-cap filters.

A filter is a direction; it holds the unit vectors within a cap around it. The directions are a random product code:
after a shared random rotation a vector is cut into ``parts`` and each part has its own random code words; a direction
joins one word of every part. A vector's filters are found by list decoding: partial sums over the parts are dropped as
soon as the best words of the remaining parts could not lift them over the threshold. Words of one part need a tenth of the
filters that a product of two needs for the same recall, so codes have one part up to labels of ``MOST_SINGLE`` vectors.
The number of words and the height of the caps follow from the dimension, the threshold and the size of the largest label,
so that decoding a vector and comparing it with those in its caps cost about the same: both grow with the root of a label.
Vectors are joined on (label, dimension, filter) and pairs are verified by their cosine.

Equal vectors of a label form a class, so copies are one row in the join. A pair that shares several filters
counts in the smallest one. A bucket of more than ``block`` classes is cut into blocks and each pair of
blocks is a task's group of its own, so memory is bounded whatever the size of a label or group. Tasks return
counts of links and a small tree of edges, never the pairs.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows with a
null label link with nothing; vectors of different length never link; repeated rows are vectors of their own
that link with each other; a null vec_id stays null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, only
from .components import connected_components
from .groups import block_pairs, tree_edges
from .tokens import trim

THRESHOLD = 0.93
#: Shared filters that a pair at the threshold has on average in one code. A code of one part spreads them evenly over
#: pairs, so one is enough; in few components it is less even, and a product of two parts is uneven, for which two
#: independent codes make up. Recall at exactly the threshold: tests ask for 0.985.
SHARED, SHARED_SHORT = {1: 8, 2: 24}, 16
CODES = {1: 1, 2: 2}
#: Vectors of fewer components have codes of one part: a product of parts so short leaves most vectors without filters.
PRODUCT_DIM = 20
#: Vectors of a label up to which codes have one part, and unlike ones that a vector then meets in products of two.
MOST_SINGLE, STRANGERS = 1 << 24, 1 << 12
#: Code words of a part. Within these the number follows the largest label.
LEAST_WORDS, MOST_WORDS = 64, 1 << 16
BLOCK = 512
NO_ID = (1 << 63) - 1  # stands for a null id: any other id is smaller


def cap_share(dim: int, cosine: float) -> float:
    """Share of the unit sphere within a cap of this height."""
    if dim == 1:
        return 0.5
    angles = np.linspace(0, math.pi, 20_001)
    weights = np.sin(angles) ** (dim - 2)
    return float(weights[angles <= math.acos(cosine)].sum() / weights.sum())


def cap_height(dim: int, share: float) -> float:
    """Height of the cap that holds this share of the unit sphere."""
    if dim == 1:
        return 0.5
    angles = np.linspace(0, math.pi, 200_001)
    weights = np.cumsum(np.sin(angles) ** (dim - 2))
    return math.cos(angles[np.searchsorted(weights, share * weights[-1])])


def sizing(dim: int, threshold: float, members: int) -> tuple[int, int, float]:
    """Parts, code words of each, and height of the caps, for labels of up to ``members`` vectors.

    Of two vectors at the threshold the second is in a cap of the first with a chance that falls with the height, so
    the filters a vector needs and the height depend on each other; a few rounds settle them."""
    parts = 2 if dim >= PRODUCT_DIM and members > MOST_SINGLE else 1
    wanted = SHARED[parts] if dim >= PRODUCT_DIM else SHARED_SHORT
    filters, words, height = 2.0 * wanted, LEAST_WORDS, threshold
    for _ in range(6):
        # with one part a vector meets all words, and in its caps half of members * filters**2 / words others, as pairs are met once
        need = filters * math.sqrt(members / 2) if parts == 1 else filters * math.sqrt(members / STRANGERS)
        words = min(MOST_WORDS, max(LEAST_WORDS, 1 << math.ceil(math.log2(max(1.0, need)))))
        if parts == 1:
            # in very few dimensions a cap as wide as the threshold holds many words: fewer of them will do
            words = min(words, max(LEAST_WORDS, 1 << math.ceil(math.log2(2 * wanted / max(cap_share(dim, threshold), 1e-9)))))
        height = cap_height(dim, min(0.45, filters / words**parts))
        if parts == 1:
            height = min(height, threshold)
        inside = min(0.999, height + (1 - height**2) / (height * dim))
        spread = math.sqrt(max(1e-12, (1 - threshold**2) * (1 - inside**2) / max(dim - 2, 1)))
        chance = 0.5 * math.erfc((height - threshold * inside) / spread / math.sqrt(2))
        filters = wanted / max(chance, 0.02)
    return parts, words, height


class ProductCode:
    """Filter directions for vectors of one length."""

    def __init__(self, dim: int, words: int, parts: int, height: float, seed: int = 23):
        rng = np.random.default_rng([seed, dim])
        self.dim, self.words = dim, words
        self.parts = min(parts, dim)
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = np.linspace(0, dim, self.parts + 1).astype(int)
        self.codes = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            code = rng.standard_normal((words, b - a))
            self.codes.append(code / np.linalg.norm(code, axis=1, keepdims=True))
        # the direction is the sum of the words over the root of their number
        self.least = height * math.sqrt(self.parts)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each row of unit vectors the ascending numbers of all filters that it exceeds. A row that exceeds
        none takes the best one, so that it is never left out."""
        turned = unit @ self.rotation
        scores = [turned[:, a:b] @ code.T for a, b, code in zip(self.cuts[:-1], self.cuts[1:], self.codes, strict=True)]
        best = np.stack([s.max(axis=1) for s in scores], axis=1)
        # what the parts after each part can add at most
        later = np.concatenate([np.cumsum(best[:, ::-1], axis=1)[:, ::-1][:, 1:], np.zeros((len(unit), 1))], axis=1)
        least = np.minimum(self.least, best.sum(axis=1) - 1e-9)
        if len(scores) == 1:
            row, word = np.nonzero(scores[0] >= least[:, None])
            return np.split(word, np.cumsum(np.bincount(row, minlength=len(unit)))[:-1])
        out = []
        for i in range(len(unit)):
            sums, numbers = np.zeros(1), np.zeros(1, np.int64)
            for p, score in enumerate(scores):
                # words that no sum so far could lift over what is left
                words = np.flatnonzero(score[i] >= least[i] - later[i, p] - sums.max())
                grown = sums[:, None] + score[i][words][None, :]
                at, word = np.nonzero(grown >= least[i] - later[i, p])
                sums, numbers = grown[at, word], numbers[at] * self.words + words[word]
            out.append(np.sort(numbers))
        return out


class CodeSet:
    """Several independent codes; filter numbers of different codes differ."""

    def __init__(self, dim: int, threshold: float, members: int):
        parts, words, height = sizing(dim, threshold, members)
        self.codes = [ProductCode(dim, words, parts, height, seed=23 + k) for k in range(CODES[parts])]
        self.span = words**parts
        #: Rows decoded at once, so that their scores take some tens of megabytes.
        self.rows = max(1, (1 << 22) // words)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for begin in range(0, len(unit), self.rows):
            found = [code.decode(unit[begin : begin + self.rows]) for code in self.codes]
            out += [np.concatenate([numbers + k * self.span for k, numbers in enumerate(row)]) for row in zip(*found, strict=True)]
        return out


_CODES: dict[tuple, CodeSet] = {}


def code_set(dim: int, threshold: float, members: int) -> CodeSet:
    if (dim, threshold, members) not in _CODES:
        only("embedding caps", _CODES)
        trim(_CODES, 8)
        _CODES[dim, threshold, members] = CodeSet(dim, threshold, members)
    return _CODES[dim, threshold, members]


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow on the way."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable(vector: Column, label: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def with_filters(classes: DataFrame, settings: tuple) -> DataFrame:
    """cls, filters of each class (columns cls, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, values = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy(zero_copy_only=False)
            dims = np.diff(offsets)
            found: list = [None] * len(dims)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                for some in np.array_split(rows, -(-len(rows) // 2048)):
                    unit = _unit(np.stack([values[offsets[i] : offsets[i + 1]] for i in some]))
                    for i, filters in zip(some, code_set(int(dim), *settings).decode(unit), strict=True):
                        found[i] = filters
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["cls", "filters"])

    return classes.select("cls", "vector").mapInArrow(run, "cls long, filters array<long>")


def first_shared(filters: list[np.ndarray], here: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether no filter smaller than ``here`` holds both ends of each pair."""
    earlier = [f[: np.searchsorted(f, here)] for f in filters]
    if len(left) < 64:
        sets = {i: set(earlier[i].tolist()) for i in {*left.tolist(), *right.tolist()}}
        return np.array([sets[a].isdisjoint(sets[b]) for a, b in zip(left.tolist(), right.tolist(), strict=True)], bool)
    used, codes = np.unique(np.concatenate(earlier), return_inverse=True)
    if not len(used):
        return np.ones(len(left), bool)
    common = np.bincount(codes) > 1
    column = np.cumsum(common) - 1
    held = np.zeros((len(filters), int(common.sum())), np.float32)
    held[np.repeat(np.arange(len(filters)), [len(e) for e in earlier])[common[codes]], column[codes[common[codes]]]] = 1
    return (held @ held.T)[left, right] == 0


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """``members``: bucket, one, two, side, filter, cls, copies, filters, vector. Returns cls, links, other."""

    def group(rows: pa.RecordBatch, across: bool) -> pa.RecordBatch | None:
        side, cls, copies = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("side", "cls", "copies"))
        unit = _unit(rows.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(cls), -1))
        if across:
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            left, right = np.nonzero(unit[one] @ unit[two].T >= threshold)
            left, right = one[left], two[right]
        else:
            left, right = np.nonzero(np.triu(unit @ unit.T >= threshold, 1))
        if not len(left):
            return None
        ends, at = np.unique(np.concatenate([left, right]), return_inverse=True)
        numbers = rows.column("filters").take(pa.array(ends))
        filters = np.split(numbers.flatten().to_numpy(), numbers.offsets.to_numpy()[1:-1] - numbers.offsets[0].as_py())
        first = first_shared(filters, rows.column("filter")[0].as_py(), at[: len(left)], at[len(left) :])
        left, right = left[first], right[first]
        links = np.zeros(len(cls), np.int64)
        np.add.at(links, left, copies[right])
        np.add.at(links, right, copies[left])
        some, tree = np.flatnonzero(links), np.array(tree_edges(left, right, len(cls)), np.int64).reshape(-1, 2)
        ends = np.concatenate([cls[some], cls[tree[:, 0]]]), np.concatenate([links[some], np.zeros(len(tree), np.int64)])
        other = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(cls[tree[:, 1]], pa.int64())])
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in ends), other], ["cls", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def met() -> Iterator[pa.RecordBatch]:
            if sum(len(part) for part in held) > 1:
                found = group(pa.Table.from_batches(held).combine_chunks().to_batches()[0], last[1] != last[2])
                if found is not None:
                    yield found

        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "one", "two")], axis=1)
            begins = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for begin, end in zip(begins[:-1], begins[1:], strict=True):
                if begin < end:
                    if (now := tuple(key[begin].tolist())) != last:
                        yield from met()
                        held, last = [], now
                    held.append(batch.slice(begin, end - begin))
        yield from met()

    columns = ("bucket", "one", "two", "side", "filter", "cls", "copies", "filters", "vector")
    dealt = members.select(*columns).repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two", "cls")
    return dealt.mapInArrow(run, "cls long, links long, other long")


def dedup_embeddings(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    block: int = BLOCK,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").alias("vector"),
        F.col("label").alias("label"),
        usable(F.col("embedding"), F.col("label")).alias("ok"),
    ).withColumns({"v1": F.xxhash64("vector", "label"), "v2": F.xxhash64(F.lit(3), "label", "vector")})
    first = F.min(F.coalesce("vec_id", F.lit(NO_ID)))
    grouped = rows.filter("ok").groupBy("v1", "v2", "label").agg(first.alias("cls_id"), F.count(F.lit(1)).alias("copies"), F.any_value("vector").alias("vector"))
    classes = cut(grouped.withColumn("cls", F.xxhash64("v1", "v2")))
    largest = classes.groupBy("label", F.size("vector")).count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    settings = (threshold, 1 << (int(largest) - 1).bit_length())
    decoded = cut(with_filters(classes, settings))
    seen = classes.select("cls", "label", F.size("vector").alias("dim")).join(decoded, "cls").select("cls", "label", "dim", F.explode("filters").alias("filter"))
    buckets = seen.groupBy("label", "dim", "filter").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = buckets.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    placed = seen.join(buckets, ["label", "dim", "filter"]).select("cls", "filter", F.xxhash64("label", "dim", "filter").alias("bucket"), F.inline(block_pairs(F.col("cls"), F.col("blocks"))))
    members = placed.join(classes.select("cls", "copies", "vector").join(decoded, "cls"), "cls")
    checked = cut(verify(members, threshold))

    links = checked.groupBy("cls").agg(F.sum("links").alias("links"))
    parts_of = connected_components(checked.filter("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    named = classes.select("cls", "v1", "v2", "label", "cls_id", "copies").join(links, "cls", "left").join(parts_of.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("cls_id").alias("least_id"))
    named = named.join(least, "component").select("v1", "v2", "label", F.when(F.col("least_id") != NO_ID, F.col("least_id")).alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = rows.filter("ok").select("vec_id", "v1", "v2", "label").join(named, ["v1", "v2", "label"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
