"""Vectors of a table as matrices, for operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that one matrix of doubles takes in a task.
MATRIX_BYTES = 8 << 20


def rows_a_matrix(dim: int) -> int:
    return max(1, MATRIX_BYTES // (8 * max(1, dim)))


def finite_vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dim, rows, matrix of doubles of the vectors of each length: those that are not null and hold finite entries only."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
    for dim in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        for begin in range(0, len(rows), rows_a_matrix(dim)):
            part = rows[begin : begin + rows_a_matrix(dim)]
            matrix = values[starts[part][:, None] + np.arange(dim)]
            good = np.isfinite(matrix).all(axis=1)
            yield dim, part[good], matrix[good]


def as_bytes(matrix: np.ndarray) -> list[bytes]:
    """The bytes of each row."""
    data, width = np.ascontiguousarray(matrix).tobytes(), matrix.shape[1] * matrix.itemsize
    return [data[i * width : (i + 1) * width] for i in range(len(matrix))]
