"""Column expressions over feature columns (array<double> or ml vector)."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as P


def is_vector(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, VectorUDT)


def as_vector(df: DataFrame, name: str = "features") -> DataFrame:
    """Same table with ``name`` as an ml vector."""
    return df if is_vector(df, name) else df.withColumn(name, array_to_vector(P.col(name)))


def as_array(df: DataFrame, name: str = "features") -> DataFrame:
    """Same table with ``name`` as array<double>."""
    return df.withColumn(name, vector_to_array(P.col(name))) if is_vector(df, name) else df


def doubles(values: Sequence[float]) -> Column:
    """Literal array<double>; one string in the plan, parsed once when it is optimized."""
    return P.from_json(P.lit(json.dumps([float(v) for v in values])), "array<double>")


def points(rows: Sequence[Sequence[float]]) -> Column:
    """Literal array<array<double>>."""
    text = json.dumps([[float(v) for v in row] for row in rows])
    return P.from_json(P.lit(text), "array<array<double>>")


def dot(a: Column, b: Column) -> Column:
    return P.aggregate(P.zip_with(a, b, lambda x, y: x * y), P.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return P.aggregate(
        P.zip_with(a, b, lambda x, y: (x - y) * (x - y)), P.lit(0.0), lambda s, x: s + x
    )


def features_of(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    """Pack numeric columns into one array<double> column."""
    return df.withColumn(name, P.array(*[P.col(c).cast("double") for c in columns]))
