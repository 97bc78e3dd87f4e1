"""A stored collection of vectors: an inverted file of learnt cells, partitioned by kind of document, with exact reranking.

``replace`` puts a whole new collection in the place of the last one, as one version of a snapshot. Each kind has centroids of
its own, learnt by k-means on at most ``SAMPLE`` of its points, the first by hash; every point lies in the cell of its nearest centroid. ``ASKED``
points of all kinds tell how many cells of each kind a query must visit to meet a share ``TARGET`` of its neighbours. A search reads the
folders of its kind and of the cells that its queries visit, and compares by cosine in double precision.

Points whose vector is null, zero, not finite or of another length than most lie in no cell and are not found. Ids are longs; a null
kind is an empty one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.snapshots import Snapshots

SAMPLE, ASKED, ROUNDS, TARGET = 16_384, 512, 12, 0.97
#: Points to a cell, about, and cells at most: a search's work grows with its cells' size beyond that.
CELL, MOST_CELLS = 1024, 1024
#: Points and queries that meet in a task at once.
SIDE = 8192
DIGITS = 4


@dataclass(frozen=True)
class Cells:
    centroids: np.ndarray
    probes: int

    def order(self, x: np.ndarray) -> np.ndarray:
        """The nearest cells of each row, as many as are to be visited."""
        return np.argsort(-(x @ self.centroids.T), axis=1, kind="stable")[:, : self.probes]


def learnt(x: np.ndarray, n: int, asked: np.ndarray, k: int = 10, seed: int = 5) -> Cells:
    """``n`` centroids of the unit rows of ``x``, by k-means on the sphere, and the cells to visit, for ``asked`` at least."""
    centroids = x[np.random.default_rng(seed).permutation(len(x))[:n]]
    for _ in range(ROUNDS if n > 1 else 0):
        own = np.concatenate([np.argmax(x[i : i + 1024] @ centroids.T, axis=1) for i in range(0, len(x), 1024)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        # a cell that lost its points keeps its place
        centroids = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centroids)
    cells = Cells(centroids, len(centroids))
    if len(centroids) == 1 or not len(asked):
        return cells
    lies, k, met = cells.order(x)[:, 0], min(k, len(x)), []
    for begin in range(0, len(asked), 64):
        part = asked[begin : begin + 64]
        scores = part @ x.T
        # a query that is a point does not look for itself
        scores[scores > 1 - 1e-12] = -2
        near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        places = np.argsort(np.argsort(-(part @ centroids.T), axis=1), axis=1)
        met.append(np.take_along_axis(places, lies[near], axis=1))
    places = np.concatenate(met)
    recall = np.array([(places < t).mean() for t in range(1, len(centroids) + 1)])
    return Cells(centroids, int(np.argmax(recall >= TARGET)) + 1)


def unit_rows(column: pa.Array | pa.ChunkedArray, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and unit vectors of those that can be compared."""
    vectors = column.to_pylist()
    rows = [i for i, v in enumerate(vectors) if v and (dim is None or len(v) == dim) and all(c is not None for c in v)]
    if not rows:
        return np.empty(0, np.int64), np.empty((0, dim or 0))
    x = np.array([vectors[i] for i in rows], np.float64)
    size = np.linalg.norm(x, axis=1)
    good = np.isfinite(size) & (size > 0)
    return np.array(rows)[good], x[good] / size[good, None]


def kind_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


@dataclass(frozen=True)
class VectorCollection:
    """The collection in the folder of ``store``."""

    store: Snapshots

    def replace(self, points: DataFrame, cells: int | None = None) -> int:
        """Puts ``points`` (point_id, doc_type, vector) in the place of all that was there."""
        spark = points.sparkSession
        chosen = points.select(F.col("point_id").cast("long").alias("point_id"), kind_of("doc_type"), F.col("vector").cast("array<double>").alias("vector")).filter("point_id is not null")
        usual = chosen.filter("vector is not null").groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
        dim = usual.dim if usual is not None else 1
        sizes = {r.doc_type: cells or max(1, min(MOST_CELLS, r.n // CELL)) for r in chosen.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n")).collect()}
        first = F.row_number().over(Window.partitionBy("doc_type").orderBy(F.xxhash64("vector"), "vector"))
        sample = chosen.filter(F.size("vector") == dim).withColumn("place", first).filter(F.col("place") <= SAMPLE).select("doc_type", "vector")

        asked = chosen.filter(F.size("vector") == dim).select("vector").orderBy(F.xxhash64(F.lit(2), "vector"), "vector").limit(ASKED).collect()
        _, queries = unit_rows(pa.array([r.vector for r in asked], pa.list_(pa.float64())), dim)

        def learn(key: tuple, held: pa.Table) -> pa.Table:
            kind = key[0].as_py()
            _, x = unit_rows(held.column("vector"), dim)
            rows = [(kind, pickle.dumps(learnt(x, min(sizes[kind], len(x)), queries)))] if len(x) else []
            return pa.table([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["doc_type", "cells"])

        found = {r.doc_type: pickle.loads(r.cells) for r in sample.groupBy("doc_type").applyInArrow(learn, "doc_type string, cells binary").collect()}
        shared = spark.sparkContext.broadcast(found)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, x = unit_rows(batch.column(2), dim)
                kinds = np.array(batch.column(1).to_pylist(), object)[rows]
                own = np.full(len(rows), -1)
                for kind, cells in shared.value.items():
                    mine = np.flatnonzero(kinds == kind)
                    if len(mine):
                        own[mine] = cells.order(x[mine])[:, 0]
                kept = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(own, pa.int32()), pa.array([v.tobytes() for v in x], pa.binary())], ["point_id", "doc_type", "cell", "x"])

        def write(path: str) -> None:
            placed = chosen.mapInArrow(place, "point_id long, doc_type string, cell int, x binary")
            # a large cell is dealt to several files, so that no task writes it alone
            dealt = placed.withColumn("part", F.pmod(F.xxhash64("point_id"), F.lit(8)))
            dealt.repartition("doc_type", "cell", "part").drop("part").write.partitionBy("doc_type", "cell").parquet(f"{path}/points")
            # a row a kind
            spark.createDataFrame([(kind, pickle.dumps(c)) for kind, c in found.items()], "doc_type string, cells binary").coalesce(1).write.parquet(f"{path}/cells")

        return self.store.publish(write, dim=dim)

    def cells(self) -> dict[str, Cells]:
        """The cells of each kind."""
        rows = self.store.spark.read.schema("doc_type string, cells binary").parquet(f"{self.store.data()}/cells").collect()
        return {r.doc_type: pickle.loads(r.cells) for r in rows}

    def points(self) -> DataFrame:
        """point_id, x, doc_type, cell as stored; a version without points has no rows."""
        rows = self.store.spark.read.schema("point_id long, x binary, doc_type string, cell int").parquet(f"{self.store.data()}/points")
        return rows.withColumn("doc_type", kind_of("doc_type"))

    def counts(self) -> DataFrame:
        """doc_type, n_points."""
        return self.points().groupBy("doc_type").agg(F.count(F.lit(1)).alias("n_points"))

    def visits(self, queries: DataFrame, doc_types: Sequence[str] | None = None) -> DataFrame:
        """query_id, x, doc_type, cell: the cells that each query (query_id, vector) visits, kind by kind."""
        known = {kind: c for kind, c in self.cells().items() if doc_types is None or kind in doc_types}
        dim = self.store.entry(self.store.versions()[-1])["dim"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, x = unit_rows(batch.column(1), dim)
                data = [v.tobytes() for v in x]
                for kind, cells in known.items() if len(rows) else ():
                    order = cells.order(x)
                    again = np.repeat(np.arange(len(rows)), order.shape[1])
                    ids = batch.column(0).take(pa.array(rows[again], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([data[i] for i in again], pa.binary()), pa.array([kind] * len(again)), pa.array(order.ravel(), pa.int32())], ["query_id", "x", "doc_type", "cell"])

        chosen = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
        return chosen.mapInArrow(run, "query_id long, x binary, doc_type string, cell int")

    def search(self, queries: DataFrame, k: int, doc_types: Sequence[str] | None = None) -> DataFrame:
        """query_id, rank, point_id, doc_type, score: the ``k`` points of the highest cosine of each query of a stated set, of
        some kinds or of all; ties by point_id. Scores are rounded to 4 digits before they are compared."""
        visits = self.visits(queries, doc_types)
        # numbers of cells, of which a kind has at most ``MOST_CELLS``: with the kinds they name the folders to read
        seen = [r.cell for r in visits.select("cell").distinct().collect()]
        points = self.points().filter(F.col("cell").isin(*seen) if seen else F.lit(False))
        if doc_types is not None:
            points = points.filter(F.col("doc_type").isin(*doc_types))
        place = ["doc_type", "cell"]
        sizes = points.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).join(visits.groupBy(*place).agg(F.count(F.lit(1)).alias("m")), place)
        # a row a cell
        sizes = F.broadcast(sizes.select(*place, *(F.ceil(F.col(c) / SIDE).cast("int").alias(a) for c, a in (("n", "blocks"), ("m", "sides")))))
        each = {c: F.explode(F.sequence(F.lit(0), F.col(n) - 1)) for c, n in (("block", "blocks"), ("side", "sides"))}
        left = points.join(sizes, place).select(*place, F.pmod(F.xxhash64("point_id"), "blocks").cast("int").alias("block"), each["side"].alias("side"), "point_id", "x")
        right = visits.join(sizes, place).select(*place, each["block"].alias("block"), F.pmod(F.xxhash64("query_id"), "sides").cast("int").alias("side"), "query_id", "x")

        def run(key: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if held.num_rows and asked.num_rows:
                b = np.frombuffer(b"".join(held.column("x").to_pylist())).reshape(held.num_rows, -1)
                a = np.frombuffer(b"".join(asked.column("x").to_pylist())).reshape(asked.num_rows, -1)
                ids, kind, queries = held.column("point_id").to_numpy(), key[0].as_py(), asked.column("query_id").to_pylist()
                for begin in range(0, len(a), 256):
                    scores = np.round(a[begin : begin + 256] @ b.T, DIGITS) + 0.0
                    first = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
                    out += [(queries[begin + i], int(ids[j]), kind, float(scores[i, j])) for i in range(len(scores)) for j in first[i]]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64())
            return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["query_id", "point_id", "doc_type", "score"])

        met = left.groupBy(*place, "block", "side").cogroup(right.groupBy(*place, "block", "side")).applyInArrow(run, "query_id long, point_id long, doc_type string, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id"))
        return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "point_id", "doc_type", "score")

    def share_read(self, queries: DataFrame) -> float:
        """Comparisons that a search makes, of those with all points."""
        sizes = self.points().groupBy("doc_type", "cell").agg(F.count(F.lit(1)).alias("n"))
        visits = self.visits(queries)
        made = visits.groupBy("doc_type", "cell").agg(F.count(F.lit(1)).alias("m")).join(sizes, ["doc_type", "cell"]).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]
        return made / max(1, self.points().count() * visits.select("query_id").distinct().count())
