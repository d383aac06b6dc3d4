"""Repeatable pseudo-random numbers from a row key.

The number depends on the seed and the key only, so folds and samples stay the
same after a lost executor, a different partitioning or a second scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as P

RANGE = 2**32


def hash32(seed: int, key: Sequence[str]) -> Column:
    """First 32 bits of md5(seed:key...) as a long."""
    # concat_ws would skip nulls, and (a, null, b) would meet (a, b, null)
    parts = [P.coalesce(P.col(k).cast("string"), P.lit("\0")) for k in key]
    text = P.concat_ws(":", P.lit(str(seed)), *parts)
    return P.conv(P.substring(P.md5(text), 1, 8), 16, 10).cast("long")


def unit_interval(seed: int, key: Sequence[str]) -> Column:
    """Uniform double in [0, 1)."""
    return hash32(seed, key) / P.lit(float(RANGE))


def bucket(seed: int, key: Sequence[str], n: int) -> Column:
    """Uniform int in 0 .. n-1."""
    return (hash32(seed, key) % n).cast("int")
