"""Triangular factors of tall tables, batch by batch."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "part long, line int, entries array<double>"
ROWS = 4096  # rows stacked below a factor at once


def rows_of(column: pa.Array) -> Iterator[np.ndarray]:
    """Blocks of rows of an array<double> column without nulls."""
    for i in range(0, len(column), ROWS):
        part = column.slice(i, ROWS)
        if len(part):
            yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def stacked(factor: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    """The triangular factor of ``block`` below ``factor``: nothing is squared."""
    return np.linalg.qr(block if factor is None else np.vstack([factor, block]), mode="r")


def lines(part: int, factor: np.ndarray | None) -> pa.RecordBatch:
    """A factor as rows of SCHEMA."""
    given = [] if factor is None else factor.tolist()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part] * len(given), pa.int64()),
            pa.array(range(len(given)), pa.int32()),
            pa.array(given, pa.list_(pa.float64())),
        ],
        ["part", "line", "entries"],
    )
