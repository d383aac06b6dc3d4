"""Forests whose bootstrap comes from row keys.

How often a tree draws a row is a Poisson number read from the md5 of seed, tree and row key. A
retried task, another partitioning or a second scan draws the same rows, and SQL can draw them again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as P

from foldlight.functions.hashing import RANGE, hash32
from foldlight.functions.vectors import as_vector

TREE, DRAWS = "_tree", "_draws"


def poisson_steps(mean: float = 1.0) -> list[int]:
    """Lowest hash for at least 1, 2, ... draws: the Poisson distribution over the 32-bit range."""
    steps, below, k = [], 0.0, 0
    while True:
        below += math.exp(-mean) * mean**k / math.factorial(k)
        k += 1
        step = math.floor(below * RANGE)
        if step >= RANGE - 1 or (steps and step == steps[-1]):
            return steps
        steps.append(step)


def draws(seed: int, key: Sequence[str], mean: float = 1.0) -> Column:
    """How often the row is drawn, as a long."""
    return _steps_up_to(hash32(seed, key), poisson_steps(mean))


def _steps_up_to(number: Column, steps: list[int]) -> Column:
    return reduce(add, [(number >= s).cast("long") for s in steps])


@dataclass
class HashedForest:
    """One model per tree, and what is needed to draw the rows of each tree again."""

    trees: list[Model]
    key: list[str]
    seed: int
    classes: int = 0  # 0 for regression

    def drawn(self, df: DataFrame, tree: int) -> DataFrame:
        """The rows that a tree saw, with ``_draws``."""
        return _drawn(df, self.key, self.seed, tree)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``, and for classes ``probability``.

        Trees count alike. A class forest averages the class shares of its trees; of equal
        shares the lowest class wins. A regression forest averages the predictions.
        """
        kept = df.columns
        value = vector_to_array("probability") if self.classes else P.col("prediction")
        df = as_vector(df)
        for t, tree in enumerate(self.trees):
            scored = tree.transform(df).withColumn(f"_tree_{t}", value)
            df = scored.drop("rawPrediction", "probability", "prediction")
        values = [P.col(f"_tree_{t}") for t in range(len(self.trees))]
        if not self.classes:
            return df.select(*kept, (reduce(add, values) / len(values)).alias("prediction"))
        shares = [reduce(add, [v[c] for v in values]) / len(values) for c in range(self.classes)]
        df = df.select(*kept, P.array(*shares).alias("probability"))
        best = P.array_position("probability", P.array_max("probability")) - 1
        return df.withColumn("prediction", best.cast("double"))


def _drawn(df: DataFrame, key: Sequence[str], seed: int, tree: int) -> DataFrame:
    steps = poisson_steps()
    numbered = df.withColumn(TREE, P.lit(tree)).withColumn("_hash", hash32(seed, [TREE, *key]))
    # the lowest step alone decides whether a row is drawn, so the filter hashes once
    chosen = numbered.filter(P.col("_hash") >= steps[0])
    return chosen.withColumn(DRAWS, _steps_up_to(P.col("_hash"), steps)).drop(TREE, "_hash")


def _grow(estimator, df: DataFrame, key: Sequence[str], trees: int, seed: int) -> list[Model]:
    models = []
    for t in range(trees):
        rows = _drawn(df, key, seed, t).withColumn(DRAWS, P.col(DRAWS).cast("double"))
        models.append(estimator.copy({estimator.seed: seed + t}).fit(rows))
    return models


def fit_hashed_forest_regressor(
    df: DataFrame,
    key: Sequence[str],
    trees: int = 3,
    depth: int = 4,
    bins: int = 32,
    seed: int = 12345,
    subset: str = "onethird",
) -> HashedForest:
    """Variance trees, each over the rows that its hashes draw; one fit a tree.

    ``key`` names a row. Rows of one key, null keys among them, are drawn together. The draws
    depend on nothing else; candidate thresholds of large tables come from Spark's own sample.
    """
    tree = RandomForestRegressor(
        numTrees=1, bootstrap=False, maxDepth=depth, maxBins=bins, featureSubsetStrategy=subset, weightCol=DRAWS
    )
    return HashedForest(_grow(tree, as_vector(df), key, trees, seed), list(key), seed)


def fit_hashed_forest_classifier(
    df: DataFrame,
    key: Sequence[str],
    trees: int = 3,
    depth: int = 5,
    bins: int = 32,
    seed: int = 12345,
    subset: str = "sqrt",
) -> HashedForest:
    """M1: gini trees, drawn as in ``fit_hashed_forest_regressor``. Labels are 0, 1, ... as doubles.

    Every tree knows all classes, also those of which it drew no row.
    """
    classes = int(df.agg(P.max("label")).head()[0]) + 1
    label = P.col("label").alias("label", metadata={"ml_attr": {"type": "nominal", "num_vals": classes}})
    rows = as_vector(df).withColumn("label", label)
    tree = RandomForestClassifier(
        numTrees=1, bootstrap=False, maxDepth=depth, maxBins=bins, featureSubsetStrategy=subset, weightCol=DRAWS
    )
    return HashedForest(_grow(tree, rows, key, trees, seed), list(key), seed, classes)
