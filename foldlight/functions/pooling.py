"""Pooling of adjacent violators in one sorted run of blocks."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "chunk long, low double, high double, weight double, mean double"


def pooled(blocks: pa.Table) -> pa.Table:
    """Blocks of one chunk, in any order, to blocks of rising means."""
    order = np.argsort(blocks["low"].to_numpy())
    low, high, weight, mean = (blocks[c].to_numpy()[order].tolist() for c in ("low", "high", "weight", "mean"))
    stack: list[tuple[float, float, float, float]] = []
    for a, b, w, m in zip(low, high, weight, mean, strict=True):
        while stack and stack[-1][3] > m:
            a, _, other, level = stack.pop()
            m = (m * w + level * other) / (w + other)
            w += other
        stack.append((a, b, w, m))
    columns = [pa.array(c, pa.float64()) for c in zip(*stack, strict=True)]
    chunk = pa.array([blocks["chunk"][0].as_py()] * len(stack), pa.int64())
    return pa.Table.from_arrays([chunk, *columns], ["chunk", "low", "high", "weight", "mean"])
