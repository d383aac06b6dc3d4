"""Regressors."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    DecisionTreeRegressor,
    GBTRegressionModel,
    GBTRegressor,
    LinearRegression,
    LinearRegressionModel,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as P

from foldlight.functions import pooling
from foldlight.functions.vectors import as_vector, is_vector
from foldlight.operators.running import with_row_id
from foldlight.session import enable_checkpoints, materialize, spread


def _fit(estimator: Estimator, df: DataFrame) -> Model:
    return estimator.fit(as_vector(df, "features"))


def _fit_trees(estimator: Estimator, df: DataFrame) -> Model:
    """Trees keep their rows between passes, one block a part: as many parts as the rows need."""
    needed = dict.fromkeys(estimator.getOrDefault(c) for c in ("featuresCol", "labelCol"))
    if estimator.isSet("weightCol"):
        needed[estimator.getOrDefault("weightCol")] = None
    return _fit(estimator, spread(df.select(*needed)))


def fit_linear_regression(
    df: DataFrame, fit_intercept: bool = False, **params
) -> LinearRegressionModel:
    """Least squares by the normal equations: one pass over the rows."""
    return _fit(LinearRegression(solver="normal", fitIntercept=fit_intercept, **params), df)


def fit_decision_tree_regressor(
    df: DataFrame, depth: int = 5, bins: int = 32, **params
) -> DecisionTreeRegressionModel:
    """R2: variance tree."""
    return _fit_trees(DecisionTreeRegressor(maxDepth=depth, maxBins=bins, **params), df)


def fit_random_forest_regressor(
    df: DataFrame, trees: int = 3, depth: int = 4, bins: int = 32, seed: int = 12345, **params
) -> RandomForestRegressionModel:
    """Forest of variance trees."""
    forest = RandomForestRegressor(
        numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed, **params
    )
    return _fit_trees(forest, df)


def fit_boosted_trees_regressor(
    df: DataFrame, rounds: int = 20, depth: int = 5, **params
) -> GBTRegressionModel:
    """Boosted trees on squared error, with as many rounds as Spark's estimator has by itself.

    The reference's example has three and says to use more in practice: a round after the first counts a tenth.
    """
    enable_checkpoints(df.sparkSession)
    return _fit_trees(GBTRegressor(maxIter=rounds, maxDepth=depth, **params), df)


class IsotonicTableModel(Model, HasFeaturesCol, HasPredictionCol):
    """R5 as a model whose (boundary, prediction) rows stay a table, fitted, saved, loaded and applied by Spark."""

    def __init__(self, boundaries: DataFrame) -> None:
        super().__init__()
        self._setDefault(featuresCol="feature", predictionCol="prediction")
        self.boundaries = boundaries

    def setPredictionCol(self, value: str) -> IsotonicTableModel:
        return self._set(predictionCol=value)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = dataset.withColumn("_feature", _value(dataset, self.getFeaturesCol()))
        return interpolate(self.boundaries, rows, "_feature", self.getPredictionCol()).drop("_feature")

    def write(self) -> MLWriter:
        return _IsotonicTableWriter(self)

    @classmethod
    def load(cls, path: str) -> IsotonicTableModel:
        """A saved table, or what Spark's own isotonic model saved: one row with all boundaries."""
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        if metadata["class"].startswith("org.apache.spark."):
            pairs = P.explode(P.arrays_zip("boundaries", "predictions")).alias("p")
            rows = spark.read.parquet(f"{path}/data").select(pairs)
            boundaries = rows.select(P.col("p.boundaries").alias("boundary"), P.col("p.predictions").alias("prediction"))
        else:
            boundaries = spark.read.schema("boundary double, prediction double").parquet(f"{path}/boundaries")
        model = cls(boundaries)
        for name in ("featuresCol", "predictionCol"):
            if name in metadata["paramMap"]:
                model._set(**{name: metadata["paramMap"][name]})
        return model


class _IsotonicTableWriter(MLWriter):
    def __init__(self, model: IsotonicTableModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.boundaries.write.parquet(f"{path}/boundaries")


def fit_isotonic(
    df: DataFrame,
    increasing: bool = True,
    feature: str = "feature",
    label: str = "label",
    weight: str | None = None,
) -> IsotonicTableModel:
    """Weighted isotonic regression of ``label`` on one numeric feature.

    Rows with an equal feature value have one common fit, so they are merged to
    their weighted mean first and pooled as in ``isotonic_boundaries``, for any number of distinct values.
    A vector feature column with one entry is accepted too. A value without feature or label is an error.
    """
    points = _points(df, feature, label, weight)
    known = P.col("feature").isNotNull() & P.col("label").isNotNull()
    error = P.raise_error("isotonic regression needs a feature and a label").cast("double")
    points = points.withColumn("label", P.when(known, P.col("label")).otherwise(error))
    return IsotonicTableModel(_pooled_points(points, increasing))


def _value(df: DataFrame, feature: str) -> Column:
    """One numeric feature as double, or the first entry of a vector or array."""
    if df.schema[feature].dataType.typeName() in ("double", "float", "integer", "long"):
        return P.col(feature).cast("double")
    return (vector_to_array(P.col(feature)) if is_vector(df, feature) else P.col(feature))[0].cast("double")


def _points(df: DataFrame, feature: str, label: str, weight: str | None) -> DataFrame:
    """(feature, label, weight) with one row per distinct feature value: weighted mean and sum of weights."""
    w = P.col(weight).cast("double") if weight else P.lit(1.0)
    return df.groupBy(_value(df, feature).alias("feature")).agg(
        (P.sum(w * P.col(label)) / P.sum(w)).alias("label"), P.sum(w).alias("weight")
    )


def isotonic_boundaries(
    df: DataFrame,
    increasing: bool = True,
    feature: str = "feature",
    label: str = "label",
    weight: str | None = None,
    chunk: int = 200_000,
) -> DataFrame:
    """R5 as a table: (boundary, prediction) of the weighted isotonic regression, never on the driver.

    One row per distinct feature value is numbered in order and cut into chunks of ``chunk``
    blocks; each chunk pools its adjacent violators. While the last block of a chunk lies above the first
    of the next one, the blocks left are numbered again and cut half a chunk further, so that these two meet. Pooling
    gives one result in whatever order violators are merged. Rows without feature or label, or without a positive
    weight, are left out; an empty table gives an empty result.
    """
    points = _points(df.filter(P.col(feature).isNotNull() & P.col(label).isNotNull()), feature, label, weight)
    return _pooled_points(points, increasing, chunk)


def _pooled_points(points: DataFrame, increasing: bool = True, chunk: int = 200_000) -> DataFrame:
    """(boundary, prediction) from one row (feature, label, weight) per feature value."""
    if chunk < 2:
        raise ValueError("a chunk holds two blocks at least")
    sign = 1.0 if increasing else -1.0
    blocks = points.filter("weight > 0").select(
        P.col("feature").alias("low"), P.col("feature").alias("high"), "weight", (sign * P.col("label")).alias("mean")
    )
    shift = 0
    while True:
        numbered = with_row_id(blocks, ["low"], "_id")
        chunks = numbered.withColumn("chunk", P.floor((P.col("_id") + shift) / chunk).cast("long"))
        cut = chunks.select("chunk", "low", "high", "weight", "mean")
        blocks = materialize(cut.groupBy("chunk").applyInArrow(pooling.pooled, pooling.SCHEMA), "blocks")
        ends = blocks.groupBy("chunk").agg(P.min_by("mean", "low").alias("first"), P.max_by("mean", "low").alias("last"))
        after = ends.select((P.col("chunk") - 1).alias("chunk"), P.col("first").alias("next"))
        if ends.join(after, "chunk").filter(P.col("last") > P.col("next")).isEmpty():
            break
        blocks = blocks.drop("chunk")
        shift = 0 if shift else max(1, chunk // 2)
    ends = P.when(P.col("low") < P.col("high"), P.array("low", "high")).otherwise(P.array("low"))
    return blocks.select(P.explode(ends).alias("boundary"), (sign * P.col("mean")).alias("prediction"))


def interpolate(
    boundaries: DataFrame, df: DataFrame, feature: str = "feature", name: str = "prediction"
) -> DataFrame:
    """R6 for a table of boundaries: ``df`` with ``name``, linear between boundaries and flat outside.

    Distinct values and boundaries are sorted together in ranges that are written once; a range takes the nearest
    boundary before and after it from one row per range, so no window spans the table. The boundary after a value
    is the last one passed in falling order: a frame open at its end is read again for every row. Null features
    have a null prediction.
    """
    values = df.select(P.col(feature).cast("double").alias("x")).filter("x IS NOT NULL").distinct()
    both = values.select("x", P.lit(None).cast("double").alias("y")).unionAll(
        boundaries.select(P.col("boundary").alias("x"), P.col("prediction").alias("y"))
    )
    parts = materialize(both.repartitionByRange("x").withColumn("_part", P.spark_partition_id()), "ranges")
    known = P.when(P.col("y").isNotNull(), P.struct("x", "y"))
    per_part = parts.groupBy("_part").agg(P.min(known).alias("first"), P.max(known).alias("last"))
    ranges = Window.partitionBy(P.lit(0)).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = P.last("last", ignorenulls=True).over(ranges.orderBy("_part"))
    after = P.last("first", ignorenulls=True).over(ranges.orderBy(P.desc("_part")))
    borders = per_part.select("_part", before.alias("_before"), after.alias("_after"))
    inside = Window.partitionBy("_part").rangeBetween(Window.unboundedPreceding, 0)
    left = P.last(known, ignorenulls=True).over(inside.orderBy("x"))
    right = P.last(known, ignorenulls=True).over(inside.orderBy(P.desc("x")))
    near = parts.withColumns({"_left": left, "_right": right}).filter("y IS NULL").join(borders, "_part", "left")
    near = near.select("x", P.coalesce("_left", "_before").alias("a"), P.coalesce("_right", "_after").alias("b"))
    share = (P.col("x") - P.col("a.x")) / (P.col("b.x") - P.col("a.x"))
    line = P.col("a.y") + (P.col("b.y") - P.col("a.y")) * share
    inner = P.when(P.col("a.x") == P.col("b.x"), P.col("a.y")).otherwise(line)
    flat = P.when(P.col("a").isNull(), P.col("b.y")).when(P.col("b").isNull(), P.col("a.y")).otherwise(inner)
    found = near.select(P.col("x").alias("_x"), flat.alias(name))
    return df.join(found, P.col(feature).cast("double") == P.col("_x"), "left").drop("_x")


def predict(model: Model, df: DataFrame, label: str = "label", keep: tuple[str, ...] = ()):
    """(prediction, label) per row."""
    features = model.getOrDefault("featuresCol")
    if df.schema[features].dataType.typeName() == "array":
        df = as_vector(df, features)
    return model.transform(df).select(*keep, "prediction", P.col(label).alias("label"))
