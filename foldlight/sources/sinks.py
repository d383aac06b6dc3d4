"""Sinks: factor text files, models and report tables."""

from __future__ import annotations

from typing import TypeVar

from pyspark.ml.recommendation import ALSModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.ml.util import JavaMLWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as P

from foldlight.operators.recommend import item_factors, user_factors
from foldlight.operators.regress import IsotonicTableModel

M = TypeVar("M", bound=JavaMLWritable | IsotonicTableModel)

TABLE_FORMS = {IsotonicRegressionModel: IsotonicTableModel}


def _factor_line() -> Column:
    numbers = P.concat_ws(", ", P.transform("features", lambda x: x.cast("string")))
    return P.concat(P.col("id").cast("string"), P.lit(",["), numbers, P.lit("]"))


def write_factors(model: ALSModel, folder: str) -> None:
    """K1: text folders ``userFeatures`` and ``productFeatures``, lines ``id,[f1, f2, ...]``."""
    for name, factors in (
        ("userFeatures", user_factors(model)),
        ("productFeatures", item_factors(model)),
    ):
        factors.select(_factor_line().alias("value")).write.text(f"{folder}/{name}")


def save_model(model: M, path: str) -> None:
    """K2: write a fitted model, replacing one at the same path."""
    model.write().overwrite().save(path)


def load_model(kind: type[M], path: str) -> M:
    """K2: read a model that :func:`save_model` wrote; an isotonic one keeps its boundaries as a table."""
    return TABLE_FORMS.get(kind, kind).load(path)


def write_report(df: DataFrame, path: str) -> None:
    """K3: write a result table."""
    df.write.mode("overwrite").parquet(path)
