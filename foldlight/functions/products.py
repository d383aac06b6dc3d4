"""Largest inner products of some rows with blocks of items in falling order of norm."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = 512  # rows whose products are held at once
SLACK = 1 + 1e-9  # rounding of norms and products


class Best:
    """The n largest products found so far of each of some rows."""

    def __init__(self, rows: np.ndarray, items: list[np.ndarray], scores: list[np.ndarray], n: int) -> None:
        self.rows, self.items, self.scores, self.n = rows, items, scores, n
        self.norms = np.sqrt((rows * rows).sum(axis=1))
        self.scored = np.zeros(len(rows), np.int64)

    def least(self) -> np.ndarray:
        """What a product must reach to count: the n-th score, or nothing while fewer are found."""
        return np.array([s[self.n - 1] if len(s) >= self.n else -np.inf for s in self.scores])

    def open(self, norm: float) -> np.ndarray:
        """Rows that an item of at most this norm can still change."""
        return np.flatnonzero(norm * self.norms * SLACK >= self.least())

    def add(self, ids: np.ndarray, block: np.ndarray, norm: float) -> None:
        """Score a block for the rows still open; equal scores go to the smaller id."""
        some = self.open(norm)
        if not len(some):
            return
        products = self.rows[some] @ block.T
        self.scored[some] += len(ids)
        enough = self.least()[some]
        if len(ids) >= self.n:
            enough = np.maximum(enough, np.partition(products, -self.n, axis=1)[:, -self.n])
        for r, line, least in zip(some, products, enough, strict=True):
            hit = np.flatnonzero(line >= least)
            if len(hit):
                found = np.concatenate([self.items[r], ids[hit]])
                scores = np.concatenate([self.scores[r], line[hit]])
                order = np.lexsort((found, -scores))[: self.n]
                self.items[r], self.scores[r] = found[order], scores[order]
