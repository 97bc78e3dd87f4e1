"""Operator 11: embedding whitening by a matrix-free block Lanczos method.

Entries are fixed-point integers, floor(256 c). The fit list holds each distinct integer vector once, so copies, however
many, weigh like one vector. Its covariance is never formed: a pass over the list gives the product with a block of
directions, as tasks centre their vectors, multiply them out and add up, and the sums of tasks are added by direction.
The driver holds the basis alone (dimension by ``MOST_BASIS`` doubles at most).

Each new block is the product of the last one without its parts in the whole basis (full reorthogonalisation, twice).
Directions that vanish there are a breakdown and restart from random ones orthogonal to the basis. The residuals of the
leading Ritz pairs, which follow from products that are known, say when to stop. A basis that is full shrinks to its
leading Ritz vectors, whose products are known too. The trace is the exact sum of the deviations of the list.

Cases. Rows whose vector is null or holds null, NaN or infinite entries are left out. Vectors of each length are fitted
by themselves; an empty vector has no components. Components without variance (below 1e-12 of the trace) are not
returned, so a list of one vector gives no rows. Entries beyond 64 bits take the nearest value there. Null and
repeated ids are rows like others; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import written
from .vectors import as_bytes, finite_vectors, rows_a_matrix

#: Steps of the fixed-point grid in a unit.
SCALE = 256
#: Directions of a block and of the whole basis, at most.
BLOCK, MOST_BASIS = 16, 1024
#: Residual of a component, as a share of the largest eigenvalue, at which it is found.
RESIDUAL = 1e-13
#: Share of the trace below which a component has no variance.
NO_VARIANCE = 1e-12

EXACT = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Whitening:
    """What is fitted for the vectors of one length: ``components`` has a unit column for each of ``eigenvalues``."""

    dim: int
    n: int
    sums: tuple[int, ...]
    trace: float
    eigenvalues: np.ndarray
    components: np.ndarray
    identity_error: float
    passes: int


def on_grid(matrix: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * matrix), -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """The sum of (n x - S)^2 of each row, exact: in 64 bits where they suffice, else by Python's integers."""
    reach = n * int(np.abs(x.astype(object)).max()) + max(abs(int(s)) for s in sums) if x.size else 0
    if x.shape[1] * reach * reach < 2**63:
        c = n * x - sums.astype(np.int64)
        return (c * c).sum(axis=1).tolist()
    if reach < 2**50:
        # c = 2^25 high + low: each of the three sums of products fits
        c = n * x - sums.astype(np.int64)
        high, low = c >> 25, c & (2**25 - 1)
        parts = ((high * high).sum(axis=1, dtype=object), (high * low).sum(axis=1, dtype=object), (low * low).sum(axis=1, dtype=object))
        return [(int(a) << 50) + (int(b) << 26) + int(c) for a, b, c in zip(*parts, strict=True)]
    c = n * x.astype(object) - sums.astype(object)
    return [int(v) for v in (c * c).sum(axis=1)]


def exact_column(numbers: list[int]) -> pa.Array:
    if max(map(abs, numbers), default=0) < 2**63:
        return pa.array(numbers, pa.int64()).cast(EXACT)
    return pa.array(list(map(Decimal, numbers)), EXACT)


def fit_list(vectors: DataFrame) -> DataFrame:
    """dim, width, data: the distinct integer vectors, in matrices of integers of ``width`` bytes, as a written table."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, matrix in finite_vectors(batch.column(0)):
                if not dim or not len(matrix):
                    continue
                x = on_grid(matrix)
                most = np.maximum(x.max(axis=1), -(x.min(axis=1) + 1))
                # the fewest bytes that hold all entries, so that equal vectors have equal bytes
                width = np.select([most < 2**7, most < 2**15, most < 2**31], [1, 2, 4], 8)
                for w in np.unique(width).tolist():
                    data = as_bytes(x[width == w].astype(f"<i{w}"))
                    yield pa.RecordBatch.from_arrays([pa.array([dim] * len(data), pa.int32()), pa.array(data, pa.binary())], ["dim", "x"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, data = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = np.fromiter(map(len, data), np.int64, len(data)) // dims
            for dim, width in {*zip(dims.tolist(), sizes.tolist(), strict=True)}:
                rows = np.flatnonzero((dims == dim) & (sizes == width))
                step = rows_a_matrix(dim)
                blocks = [b"".join(data[i] for i in rows[begin : begin + step]) for begin in range(0, len(rows), step)]
                for block in blocks:
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([width], pa.int32()), pa.array([block], pa.binary())], ["dim", "width", "data"])

    distinct = vectors.select("embedding").mapInArrow(encode, "dim int, x binary").distinct()
    return written(distinct.mapInArrow(pack, "dim int, width int, data binary"), "fit-list")


def integer_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for dim, width, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield np.frombuffer(data, f"<i{width}").reshape(-1, dim).astype(np.int64)


def exact_sums(blocks: DataFrame, dim: int, of: Callable[[np.ndarray], list[int]]) -> list[int]:
    """The sums of the integers that ``of`` gives for each block, added up by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for x in integer_blocks(batches):
            total = [a + b for a, b in zip(total or [0] * len(now), now, strict=True)] if (now := of(x)) else total
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), exact_column(total)], ["i", "s"])

    rows = blocks.mapInArrow(run, "i int, s decimal(38, 0)").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    return [int(r.s) for r in rows]


def float_sums(blocks: DataFrame, height: int, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of the matrices (height by width) that ``of`` gives for each block: tasks add up theirs, then rows are added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in integer_blocks(batches):
            total = of(x) if total is None else total + of(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), *(pa.array(total[:, j]) for j in range(width))], ["i", *(f"v{j}" for j in range(width))])

    schema = ", ".join(["i int", *(f"v{j} double" for j in range(width))])
    rows = blocks.mapInArrow(run, schema).groupBy("i").agg(*(F.sum(f"v{j}").alias(f"v{j}") for j in range(width))).orderBy("i").collect()
    return np.array([r[1:] for r in rows], np.float64).reshape(height, width)


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, block: int = BLOCK, most_basis: int = MOST_BASIS, seed: int = 11) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, their unit eigenvectors and the number of products.

    ``product`` gives the matrix times a block of columns; nothing else is known of the matrix."""
    random, wanted, block = np.random.default_rng(seed), min(wanted, dim), min(block, dim)
    keep = min(dim, wanted + block)
    most_basis = min(dim, max(most_basis, keep + 2 * block))
    basis, images = np.empty((dim, 0)), np.empty((dim, 0))
    new, passes, best, stale = random.standard_normal((dim, block)), 0, np.inf, 0
    while True:
        new = orthonormal(new, basis, random)
        basis, images, passes = np.hstack([basis, new]), np.hstack([images, product(new)]), passes + 1
        small = basis.T @ images
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        ritz = basis @ vectors[:, :wanted]
        residuals = images @ vectors[:, :wanted] - ritz * values[:wanted]
        worst = np.linalg.norm(residuals, axis=0).max(initial=0.0) if basis.shape[1] >= wanted else np.inf
        # rounding keeps residuals of long bases above the limit: they are as good as doubles allow once they stop falling
        best, stale = (worst, 0) if worst < 0.5 * best else (best, stale + 1)
        limit = max(abs(values[0]), abs(values[-1]))
        if worst <= RESIDUAL * limit or basis.shape[1] == dim or (stale >= 8 and worst <= 1e4 * RESIDUAL * limit):
            return values[:wanted], ritz / np.linalg.norm(ritz, axis=0), passes
        new = images[:, -new.shape[1] :]
        if basis.shape[1] + block > most_basis:
            if basis.shape[1] + block <= dim or most_basis < dim:
                new = images @ vectors[:, :block] - basis @ (vectors[:, :block] * values[:block])
                basis, images = basis @ vectors[:, :keep], images @ vectors[:, :keep]
            else:
                new = new[:, : dim - basis.shape[1]]


def orthonormal(new: np.ndarray, basis: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """``new`` without its parts in ``basis``, as orthonormal columns; a column that vanishes becomes a random one."""
    room = new[:, : basis.shape[0] - basis.shape[1]]
    out = np.empty((basis.shape[0], 0))
    for column in room.T:
        held = np.hstack([basis, out])
        # what rounding leaves of a column that lies in the basis is no direction
        least = 1e-10 * np.linalg.norm(column)
        for _ in range(4):
            column = column - held @ (held.T @ column)
            column = column - held @ (held.T @ column)
            size = np.linalg.norm(column)
            if size > least and size > 0:
                break
            column, least = random.standard_normal(basis.shape[0]), 1e-10
        column = column / size
        column = column - held @ (held.T @ column)
        out = np.hstack([out, (column / np.linalg.norm(column))[:, None]])
    return out


def fit(vectors: DataFrame, k: int = 4) -> list[Whitening]:
    """A whitening to ``k`` components for each length of the vectors (embedding) of the table."""
    table = fit_list(vectors)
    found = []
    for dim in [r.dim for r in table.select("dim").distinct().orderBy("dim").collect()]:
        blocks = table.filter(F.col("dim") == dim)

        def counts(x: np.ndarray) -> list[int]:
            whole = x.astype(object) if np.abs(x.astype(np.float64)).max() * len(x) >= 2.0**62 else x
            return [len(x), *(int(s) for s in whole.sum(axis=0))]

        n, *sums = exact_sums(blocks, dim, counts)
        exact, mean = np.array(sums, object), np.array([s / n for s in sums], np.float64)

        def spread(x: np.ndarray, n: int = n, exact: np.ndarray = exact) -> list[int]:
            return [sum(deviations(x, n, exact))]

        trace = exact_sums(blocks, dim, spread)[0] / n**3

        def product(q: np.ndarray, blocks: DataFrame = blocks, dim: int = dim, mean: np.ndarray = mean, n: int = n) -> np.ndarray:
            def image(x: np.ndarray) -> np.ndarray:
                centred = x - mean
                return centred.T @ (centred @ q)

            return float_sums(blocks, dim, q.shape[1], image) / n

        values, components, passes = leading_pairs(product, dim, k) if trace > 0 else (np.empty(0), np.empty((dim, 0)), 0)
        good = values > NO_VARIANCE * trace
        values, components = values[good], components[:, good]
        error = 0.0
        if len(values):
            scaled = components / np.sqrt(values)

            def moments(x: np.ndarray, mean: np.ndarray = mean, scaled: np.ndarray = scaled) -> np.ndarray:
                white = (x - mean) @ scaled
                return np.vstack([white.T @ white, white.sum(axis=0)])

            sums_of = float_sums(blocks, len(values) + 1, len(values), moments) / n
            error = float(np.abs(sums_of[:-1] - np.outer(sums_of[-1], sums_of[-1]) - np.eye(len(values))).max())
        found.append(Whitening(dim, n, tuple(sums), trace, values, components, error, passes))
    return found


def whiten(vectors: DataFrame, fitted: list[Whitening]) -> DataFrame:
    """vec_id, n, deviation (exact), whitened, explained (arrays by component), identity_error of each vector
    (vec_id, embedding) whose length was fitted. Vectors are read where they lie."""
    kind = vectors.schema["vec_id"].dataType
    shared = vectors.sparkSession.sparkContext.broadcast({w.dim: w for w in fitted})
    names = ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, matrix in finite_vectors(batch.column(1)):
                w = shared.value.get(dim)
                if w is None or not len(rows):
                    continue
                x = on_grid(matrix)
                white = (x - np.array([s / w.n for s in w.sums])) @ w.components / np.sqrt(w.eigenvalues)
                m, k = white.shape
                offsets = pa.array(np.arange(m + 1) * k, pa.int32())
                share = pa.array(np.tile(w.eigenvalues / w.trace if w.trace else w.eigenvalues, m))
                columns = [
                    batch.column(0).take(pa.array(rows)).cast(id_type), pa.array([w.n] * m, pa.int64()), exact_column(deviations(x, w.n, np.array(w.sums, object))),
                    pa.ListArray.from_arrays(offsets, pa.array(white.ravel())), pa.ListArray.from_arrays(offsets, share), pa.array([w.identity_error] * m),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    id_type = to_arrow_type(kind)
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind.simpleString()}, n long, deviation decimal(38, 0), whitened array<double>, explained array<double>, identity_error double")


def whiten_embeddings(vectors: DataFrame, k: int = 4) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation (null beyond 64 bits), whitened, explained,
    identity_error."""
    rows = whiten(vectors, fit(vectors, k))
    out = rows.select("vec_id", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "x"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "x.whitened", "x.explained", "identity_error")
