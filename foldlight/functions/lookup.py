"""Values of a dictionary beside the rows of a table."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as P


def with_lookup(df: DataFrame, column: str, values: Mapping[Any, float], name: str) -> DataFrame:
    """Add ``name``: the value of ``column`` in the dictionary, null where it has none.

    The dictionary becomes a broadcast table, so thousands of entries are one hash join
    and its size is that of the dictionary the caller holds.
    """
    kind = df.schema[column].dataType.simpleString()
    rows = [(key, float(value)) for key, value in values.items()]
    entries = df.sparkSession.createDataFrame(rows, f"_key {kind}, `{name}` double")
    same = P.col(column).eqNullSafe(P.col("_key"))
    return df.join(P.broadcast(entries), same, "left").drop("_key")
