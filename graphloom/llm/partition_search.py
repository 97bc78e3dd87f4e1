"""Operator 12: approximate nearest neighbours by learned partitions.

Fit, on at most ``SAMPLE`` distinct vectors, the first by hash: the graph of their nearest neighbours is cut into parts of
equal size by recursive bisection (second eigenvector of the walk on the graph, split at its median, then swaps across
the cut as long as it gets smaller). A network of one hidden layer learns, from a vector, how its neighbours are dealt
over the parts. Rows of the sample that are kept from training tell how many of the most probable parts a query must
visit to meet a share ``TARGET`` of its neighbours.

Index: every vector of the table belongs to its most probable part; parts are cut by hash into blocks of bounded bytes.
A query goes to all blocks of its most probable parts, where a task compares blocks of both sides by a matrix product
and then exactly, and leaves the best of each query. The number of parts grows with the table up to ``MOST_PARTS``;
beyond ``MOST_PARTS * ROWS_A_PART`` distinct vectors a query's work grows with the table.

Equal vectors are one entry of the index, with the smallest k + 1 of their ids, and equal query vectors are searched
once: copies, however many, take no more room than that. No part, block, partner or candidate is dropped.

Cases. Vectors that are null, zero or hold null or non-finite entries take no part, nor do rows without an id. Vectors of
different lengths are no neighbours of each other. Rows that share id and vector count once. Equal distances go to the smaller
id; a query is not its own neighbour, in any of its rows. With fewer candidates than k all are returned; an empty table or no
queries give no rows; other columns are not read, whatever their names. Squares beyond doubles give infinite distances.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import as_bytes, finite_vectors, rows_a_matrix

#: Distinct vectors that the index is fitted on, at most, and of these the share that is kept from training.
SAMPLE, HELD_OUT = 16_384, 0.125
#: Distinct vectors to a part, and parts at most.
ROWS_A_PART, MOST_PARTS = 1024, 256
#: Neighbours in the graph, width of the hidden layer, passes over the sample and rows of a step of training.
NEAR, HIDDEN, EPOCHS, STEP = 10, 128, 30, 128
#: Share of the neighbours of held-out rows that the visited parts must hold.
TARGET = 0.95
#: Queries that meet a block at once.
QUERY_ROWS = 128
#: Tasks over which the queries of one vector are spread.
SALTS = 32


@dataclass(frozen=True)
class Router:
    """A network from vectors to parts; ``probes`` of the most probable ones are to be visited."""

    parts: int
    probes: int
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]

    def logits(self, matrix: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.zeros((len(matrix), 1))
        first, bias, second, last = self.layers
        return np.maximum((matrix - self.mean) / self.scale @ first + bias, 0) @ second + last

    def order(self, matrix: np.ndarray) -> np.ndarray:
        """The most probable parts of each row, as many as are to be visited, best first."""
        return np.argsort(-self.logits(matrix), axis=1, kind="stable")[:, : self.probes]


def near_rows(matrix: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Of each row number in ``queries`` the ``k`` nearest other rows, by matrix products."""
    squares = (matrix**2).sum(axis=1)
    found = []
    for begin in range(0, len(queries), 128):
        rows = queries[begin : begin + 128]
        far = squares[None, :] - 2 * matrix[rows] @ matrix.T
        far[np.arange(len(rows)), rows] = np.inf
        # a copy, as a slice would hold the numbers of all rows
        found.append((np.argpartition(far, k - 1, axis=1) if k < len(matrix) else np.argsort(far, axis=1))[:, :k].copy())
    return np.concatenate(found)


def bisected(source: np.ndarray, target: np.ndarray, weight: np.ndarray, n: int, random: np.random.Generator) -> np.ndarray:
    """Sides (0 or 1) of nodes 0..n-1 of a symmetric graph, of equal size, with few edges between them."""
    degree = np.bincount(source, weight, n) + 1e-9
    root = np.sqrt(degree)
    root /= np.linalg.norm(root)
    scaled = weight / np.sqrt(degree[source] * degree[target])
    v = random.standard_normal(n)
    for _ in range(60):
        v -= root * (root @ v)
        v = (v + np.bincount(source, scaled * v[target], n)) / 2
        v /= np.linalg.norm(v) + 1e-300
    side = np.zeros(n, np.int64)
    side[np.argsort(v / np.sqrt(degree), kind="stable")[n // 2 :]] = 1

    def cost(sides: np.ndarray) -> float:
        return weight[sides[source] != sides[target]].sum()

    now, share = cost(side), 1.0
    for _ in range(40):
        across = side[source] != side[target]
        gain = np.bincount(source, np.where(across, weight, -weight), n)
        left, right = (np.flatnonzero(side == s) for s in (0, 1))
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        helpful = int((gain[left[:m]] + gain[right[:m]] > 0).sum())
        m = int(np.ceil(helpful * share))
        if not m:
            break
        moved = side.copy()
        moved[left[:m]], moved[right[:m]] = 1, 0
        if (after := cost(moved)) < now:
            side, now = moved, after
        elif m == 1:
            break
        else:
            share /= 2
    return side


def balanced_parts(near: np.ndarray, parts: int, seed: int = 12) -> np.ndarray:
    """A part (0..parts-1, a power of two) of each node of a graph of nearest neighbours; sizes differ by rounding only."""
    random, n = np.random.default_rng(seed), len(near)
    source, target = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    source, target = np.concatenate([source, target]), np.concatenate([target, source])
    part, weight = np.zeros(n, np.int64), np.ones(len(source))
    while parts > 1:
        new = np.empty(n, np.int64)
        inside = part[source] == part[target]
        edge_part = part[source]
        for p in np.unique(part).tolist():
            nodes, edges = np.flatnonzero(part == p), inside & (edge_part == p)
            place = np.full(n, -1)
            place[nodes] = np.arange(len(nodes))
            new[nodes] = 2 * p + bisected(place[source[edges]], place[target[edges]], weight[edges], len(nodes), random)
        part, parts = new, parts // 2
    return part


def trained(matrix: np.ndarray, goal: np.ndarray, seed: int = 12) -> tuple[np.ndarray, ...]:
    """Weights of the network, by Adam on the cross entropy between its parts and ``goal`` (rows sum to 1)."""
    random, (n, dim), parts = np.random.default_rng(seed), matrix.shape, goal.shape[1]
    layers = [random.standard_normal((dim, HIDDEN)) * np.sqrt(2 / dim), np.zeros(HIDDEN), random.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
    moments, squares, steps = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for epoch in range(EPOCHS):
        rate, order = 3e-3 * (1 - epoch / EPOCHS), random.permutation(n)
        for begin in range(0, n, STEP):
            rows = order[begin : begin + STEP]
            x = matrix[rows]
            hidden = np.maximum(x @ layers[0] + layers[1], 0)
            out = hidden @ layers[2] + layers[3]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            wrong = (out / out.sum(axis=1, keepdims=True) - goal[rows]) / len(rows)
            back = (wrong @ layers[2].T) * (hidden > 0)
            steps += 1
            for i, g in enumerate((x.T @ back, back.sum(axis=0), hidden.T @ wrong, wrong.sum(axis=0))):
                moments[i] = 0.9 * moments[i] + 0.1 * g
                squares[i] = 0.999 * squares[i] + 0.001 * g * g
                layers[i] = layers[i] - rate * (moments[i] / (1 - 0.9**steps)) / (np.sqrt(squares[i] / (1 - 0.999**steps)) + 1e-8)
    return tuple(layers)


def fitted(matrix: np.ndarray, parts: int, k: int, seed: int = 12) -> Router:
    """A router fitted on the rows of ``matrix``, which are distinct and in random order."""
    mean, scale = matrix.mean(axis=0), matrix.std(axis=0) + 1e-12
    none = Router(1, 1, mean, scale, ())
    held = np.arange(int(len(matrix) * HELD_OUT))
    if parts < 2 or len(held) < 32:
        return none
    rest = np.arange(len(held), len(matrix))
    near = near_rows(matrix[rest], np.arange(len(rest)), min(NEAR, len(rest) - 1))
    part = balanced_parts(near, parts, seed)
    goal = np.zeros((len(rest), parts))
    np.add.at(goal, (np.arange(len(rest))[:, None], part[near]), 1 / (near.shape[1] + 1))
    goal[np.arange(len(rest)), part] += 1 / (near.shape[1] + 1)
    layers = trained((matrix[rest] - mean) / scale, goal, seed)
    router = Router(parts, parts, mean, scale, layers)
    # at which place of a held-out row's parts its neighbours lie, where the index puts them
    lies = router.order(matrix)[:, 0]
    places = np.argsort(router.order(matrix[held]), axis=1)
    met = np.take_along_axis(places, lies[near_rows(matrix, held, min(k, len(matrix) - 1))], axis=1)
    recall = np.array([(met < t).mean() for t in range(1, parts + 1)])
    return Router(parts, int(np.argmax(recall >= TARGET)) + 1, mean, scale, layers)


def fitted_in_a_task(sample: DataFrame, dim: int, parts: int, k: int) -> Router:
    """``fitted`` on the rows (x) of a bounded sample, in order, by one task; the driver gets the router alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [x for batch in batches for x in batch.column(0).to_pylist()]
        if data:
            router = fitted(as_matrix(data, dim), parts, k)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(router)], pa.binary())], ["router"])

    return pickle.loads(sample.coalesce(1).mapInArrow(run, "router binary").first().router)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, x of the vectors that take part. ``x``: their entries as bytes, in single precision where that is exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, matrix in finite_vectors(batch.column(1)):
                some = matrix.any(axis=1)
                rows, matrix = rows[some], matrix[some] + 0.0
                with np.errstate(over="ignore"):
                    short = (matrix.astype("<f4") == matrix).all(axis=1)
                for which, kind in ((short, "<f4"), (~short, "<f8")):
                    ids = batch.column(0).take(pa.array(rows[which]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([dim] * len(ids), pa.int32()), pa.array(as_bytes(matrix[which].astype(kind)), pa.binary())], ["vec_id", "dim", "x"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null")
    return rows.mapInArrow(run, "vec_id long, dim int, x binary")


def as_matrix(data: list[bytes], dim: int) -> np.ndarray:
    """Doubles of vectors in bytes of either precision."""
    out = np.empty((len(data), dim))
    sizes = np.fromiter(map(len, data), np.int64, len(data)) // dim
    for width, kind in ((4, "<f4"), (8, "<f8")):
        rows = np.flatnonzero(sizes == width)
        if len(rows):
            out[rows] = np.frombuffer(b"".join(data[i] for i in rows), kind).reshape(-1, dim)
    return out


def routed(rows: DataFrame, dim: int, router: Router, probes: int) -> DataFrame:
    """``rows`` (with x) and part: a row for each of the ``probes`` most probable parts."""
    shared, at, names = rows.sparkSession.sparkContext.broadcast(router), rows.columns.index("x"), [*rows.columns, "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, rows_a_matrix(dim)):
                part = batch.slice(begin, rows_a_matrix(dim))
                order = shared.value.order(as_matrix(part.column(at).to_pylist(), dim))[:, :probes]
                again = part.take(pa.array(np.repeat(np.arange(len(order)), order.shape[1])))
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(order.ravel(), pa.int32())], names)

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", part int")


def search_block(dim: int, k: int):
    """A function of the entries of a block (ids, x) and the queries that meet it (query, x): the k nearest rows of each."""

    def run(entries: pa.Table, asked: pa.Table) -> pa.Table:
        ids, b = entries.column("ids").to_pylist(), as_matrix(entries.column("x").to_pylist(), dim)
        queries, a = asked.column("query").to_numpy(), as_matrix(asked.column("x").to_pylist(), dim)
        out: tuple[list, list, list] = ([], [], [])
        with np.errstate(over="ignore", invalid="ignore"):
            squares = (b * b).sum(axis=1)
        for begin in range(0, len(a) if len(b) else 0, QUERY_ROWS):
            part = a[begin : begin + QUERY_ROWS]
            with np.errstate(over="ignore", invalid="ignore"):
                size = (part * part).sum(axis=1)
                rough = size[:, None] - 2 * part @ b.T + squares
                rough[~np.isfinite(rough)] = -1.0  # these are looked at exactly
                last = np.partition(rough, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
                # what rounding of the products can hide
                near = rough <= (last + 1e-12 * dim * (size + squares.max()))[:, None]
                row, column = np.nonzero(near)
                score = np.empty(len(row))
                for i in range(0, len(row), max(1, (1 << 20) // dim)):
                    some = slice(i, i + max(1, (1 << 20) // dim))
                    score[some] = np.sqrt(((part[row[some]] - b[column[some]]) ** 2).sum(axis=1))
            many = np.fromiter((len(ids[c]) for c in column), np.int64, len(column))
            row, score = np.repeat(row, many), np.repeat(score, many)
            names = np.fromiter((v for c in column for v in ids[c]), np.int64, len(row))
            order = np.lexsort((names, score, row))
            row, score, names = row[order], score[order], names[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            keep = place < k
            for held, values in zip(out, (queries[begin + row[keep]], names[keep], score[keep]), strict=True):
                held.append(values)
        columns = [np.concatenate(x) if x else np.empty(0) for x in out]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: of each row of ``vectors`` (vec_id, embedding) that is a query (a condition on vec_id)
    the ``k`` nearest other rows found, by Euclidean distance in double precision, which ``score`` is."""
    spark, rows = vectors.sparkSession, usable(vectors)
    # one entry a vector: its smallest ids, as queries leave one out
    place = F.row_number().over(Window.partitionBy("dim", "x").orderBy("vec_id"))
    few = rows.distinct().withColumn("place", place).filter(F.col("place") <= k + 1)
    table = written(few.groupBy("dim", "x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    asked = rows.filter(is_query).distinct()
    # queries of equal vectors are asked under the smallest id
    asked = written(asked.groupBy("dim", "x").agg(F.min("vec_id").alias("query")).join(asked, ["dim", "x"]).select("dim", "query", F.when(F.col("vec_id") == F.col("query"), F.col("x")).alias("x"), "vec_id"), "queries")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim, n in [(r.dim, r.n) for r in table.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect()]:
        entries, mine = table.filter(F.col("dim") == dim), asked.filter(F.col("dim") == dim)
        parts = min(MOST_PARTS, 2 ** max(0, round(np.log2(n / ROWS_A_PART))))
        # the sample is the first by hash, which says nothing of the vectors
        sample = entries.select("x").orderBy(F.xxhash64("x"), "x").limit(SAMPLE)
        router = fitted_in_a_task(sample, dim, parts, k) if parts > 1 else Router(1, 1, np.zeros(dim), np.ones(dim), ())
        index = written(routed(entries.select("ids", "x"), dim, router, 1), "index")
        visits = written(routed(mine.filter("x is not null").select("query", "x"), dim, router, router.probes), "visits")
        # blocks of bounded bytes on both sides: every block of a part meets every block of its queries
        block = rows_a_matrix(dim)
        sizes = index.groupBy("part").agg(F.count(F.lit(1)).alias("n")).join(visits.groupBy("part").agg(F.count(F.lit(1)).alias("m")), "part")
        # a row a part
        sizes = F.broadcast(sizes.select("part", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil(F.col("m") / block).cast("int").alias("sides")))
        many = {c: F.explode(F.sequence(F.lit(0), F.col(n) - 1)) for c, n in (("block", "blocks"), ("side", "sides"))}
        left = index.join(sizes, "part").select("part", F.pmod(F.xxhash64("x"), "blocks").cast("int").alias("block"), many["side"].alias("side"), "ids", "x")
        right = visits.join(sizes, "part").select("part", many["block"].alias("block"), F.pmod(F.xxhash64("x"), "sides").cast("int").alias("side"), "query", "x")
        met = left.groupBy("part", "block", "side").cogroup(right.groupBy("part", "block", "side")).applyInArrow(search_block(dim, k + 1), "query long, vec_id long, score double")
        first = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
        best = met.withColumn("place", first).filter(F.col("place") <= k + 1).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
        # many ids may ask for one vector: they are spread
        spread = best.select("query", "found", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        named = mine.select("query", F.col("vec_id").alias("query_id"), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt")).join(spread, ["query", "salt"])
        others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
        out = out.unionByName(named.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score"))
    return out
