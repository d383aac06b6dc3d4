"""Words of Arrow text columns as NumPy arrays, and hashes of words and word windows.

A word is a longest run of bytes outside ``[\\x20\\x09-\\x0D]``. UTF-8 bytes of
other characters are all 0x80 or more, so words are found on bytes. Hashes are
polynomials over 64-bit integers with random coefficients per byte, mixed at
the end; ``lane`` picks one of two independent functions.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 1 << 20  # bytes or words hashed at once
CHUNK = 4 << 20  # bytes of text handled at once, unless one text is longer
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MASK = (1 << 64) - 1


def kept(key: str, make: Callable[[], Any]) -> Any:
    """A value made once per worker process (functions shipped by value lose their globals)."""
    store = sys.__dict__.setdefault("_foldlight_kept", {})
    if key not in store:
        store[key] = make()
    return store[key]


def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


def tidy(run: Callable) -> Callable:
    """``run`` over batches, after which the worker gives freed memory back to the system.

    A worker process serves many tasks, and without this it keeps the peak of each.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = kept("trim", _trim)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int) -> np.ndarray:
    out = np.empty(BLOCK + 1, np.uint64)
    out[0] = 1
    size = 1
    while size < len(out):  # doubling: base^(size+i) = base^size * base^i
        step = np.uint64(pow(base, size, 1 << 64))
        more = min(size, len(out) - size)
        out[size : size + more] = out[:more] * step
        size += more
    return out


def _tables(lane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = BASES[lane]
    inverse = pow(base, -1, 1 << 64)
    return (
        np.random.default_rng(lane + 1).integers(1, 1 << 63, 256, np.uint64),
        _powers(base),
        _powers(inverse),
    )


def tables(lane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficient of each byte, powers, inverse powers)."""
    return kept(f"tables{lane}", lambda: _tables(lane))


def _space() -> np.ndarray:
    word = np.ones(256, bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    return word


def _fold() -> np.ndarray:
    low = np.arange(256)
    low[65:91] += 32
    return low


@dataclass
class Words:
    """Words of some texts: ``data[starts[i]:ends[i]]``; text t has words ``first[t]:first[t+1]``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lane: int = 0, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``lower`` folds A-Z."""
        table, power, inverse = tables(lane)
        if lower:
            table = table[kept("fold", _fold)]
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(out):
            begin = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, begin + BLOCK, "right")))
            stop = self.ends[j - 1]
            if stop - begin <= BLOCK:
                sums = np.zeros(stop - begin + 1, np.uint64)
                np.cumsum(table[self.data[begin:stop]] * power[: stop - begin], out=sums[1:])
                at = self.starts[i:j] - begin
                out[i:j] = (sums[self.ends[i:j] - begin] - sums[at]) * inverse[at]
            else:  # one word longer than a block
                total, scale = 0, 1
                for k in range(begin, stop, BLOCK):
                    part = self.data[k : min(stop, k + BLOCK)]
                    total += int((table[part] * power[: len(part)]).sum(dtype=np.uint64)) * scale
                    scale = scale * pow(BASES[lane], BLOCK, 1 << 64) & MASK
                out[i] = total & MASK
            i = j
        return mix(out + (self.ends - self.starts).astype(np.uint64))


def windows(values: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """A hash of each run of ``size`` values, in order of start; ignores text boundaries."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    _, power, inverse = tables(lane)
    out = np.empty(n, np.uint64)
    step = BLOCK - size
    for i in range(0, n, step):
        part = values[i : i + step + size - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=sums[1:])
        m = min(step, n - i)
        out[i : i + m] = (sums[size : size + m] - sums[:m]) * inverse[:m]
    return mix(out)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    offsets = offsets.astype(np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array) -> Words:
    data, offsets = buffers(texts)
    inside = kept("space", _space)[data]
    edge = np.empty(len(data), bool)
    heads = offsets[:-1][offsets[:-1] < len(data)]
    edge[:1] = True
    np.logical_not(inside[:-1], out=edge[1:])
    edge[heads] = True
    starts = np.flatnonzero(edge & inside)
    edge[-1:] = True
    np.logical_not(inside[1:], out=edge[:-1])
    edge[heads[heads > 0] - 1] = True
    ends = np.flatnonzero(edge & inside) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def chunks(batch: pa.RecordBatch | pa.Table, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about CHUNK bytes of text each, or one longer text."""
    parts = batch.to_batches() if isinstance(batch, pa.Table) else [batch]
    for part in parts:
        texts = part.column(column)
        sizes = np.diff(buffers(texts)[1])
        cuts = (np.cumsum(sizes) - 1) // CHUNK if len(sizes) else sizes
        edges = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist(), len(sizes)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                yield part.slice(a, b - a)
