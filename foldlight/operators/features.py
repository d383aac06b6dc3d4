"""Feature transforms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.feature import (
    PCA,
    ElementwiseProduct,
    IndexToString,
    PCAModel,
    StringIndexer,
    StringIndexerModel,
    UnivariateFeatureSelector,
    UnivariateFeatureSelectorModel,
    VectorIndexer,
    VectorIndexerModel,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as P

from foldlight.functions import triangles
from foldlight.functions.vectors import as_array, as_vector, dot, doubles
from foldlight.session import materialize


def label_indexer(label: str = "label", name: str = "indexed_label") -> StringIndexer:
    """T1 as a pipeline stage: label text to 0 .. n-1 by falling frequency."""
    return StringIndexer(inputCol=label, outputCol=name)


def index_labels(
    df: DataFrame, label: str = "label", name: str = "indexed_label"
) -> tuple[StringIndexerModel, DataFrame]:
    """Fitted indexer and indexed table; equal frequencies go by text order."""
    model = label_indexer(label, name).fit(df)
    return model, model.transform(df)


def index_features(
    df: DataFrame,
    max_categories: int = 4,
    features: str = "features",
    name: str = "indexed_features",
) -> tuple[VectorIndexerModel, DataFrame]:
    """Features with at most ``max_categories`` values become category numbers."""
    vectors = as_vector(df, features)
    model = VectorIndexer(inputCol=features, outputCol=name, maxCategories=max_categories).fit(
        vectors
    )
    return model, model.transform(vectors)


def label_restorer(
    labels: Sequence[str], prediction: str = "prediction", name: str = "predicted_label"
) -> IndexToString:
    """T3 as a pipeline stage."""
    return IndexToString(inputCol=prediction, outputCol=name, labels=list(labels))


def restore_labels(
    df: DataFrame,
    labels: Sequence[str],
    prediction: str = "prediction",
    name: str = "predicted_label",
) -> DataFrame:
    """Index prediction back to label text."""
    return label_restorer(labels, prediction, name).transform(df)


def build_pipeline(stages: Sequence[Estimator | Transformer | Model]) -> Pipeline:
    """T4: stages run in order; fitted stages are kept as they are."""
    return Pipeline(stages=list(stages))


def elementwise_product(
    df: DataFrame, weights: Sequence[float], features: str = "features", name: str = "product"
) -> DataFrame:
    """T5: every feature times its weight."""
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense([float(w) for w in weights]), inputCol=features, outputCol=name
    )
    return scale.transform(as_vector(df, features))


def select_by_chi_square(
    df: DataFrame,
    n: int = 5,
    features: str = "features",
    label: str = "label",
    name: str = "selected",
) -> tuple[UnivariateFeatureSelectorModel, DataFrame]:
    """Keep the n features with the smallest p against the label."""
    vectors = as_vector(df, features)
    selector = UnivariateFeatureSelector(
        featuresCol=features, labelCol=label, outputCol=name, selectionMode="numTopFeatures"
    )
    selector.setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(n)
    model = selector.fit(vectors)
    return model, model.transform(vectors)


def _signs(columns: np.ndarray) -> np.ndarray:
    """+1 or -1 per column, so that its largest part becomes positive."""
    largest = np.abs(columns).argmax(axis=0)
    return np.where(columns[largest, np.arange(columns.shape[1])] < 0, -1.0, 1.0)


def _long(spark, matrix: np.ndarray, value: str) -> DataFrame:
    rows = [
        (i, j, float(matrix[i, j])) for i in range(matrix.shape[0]) for j in range(matrix.shape[1])
    ]
    return spark.createDataFrame(rows, f"feature int, component int, {value} double")


def principal_components(
    df: DataFrame, k: int = 3, features: str = "features", name: str = "projected"
) -> tuple[PCAModel, DataFrame]:
    """Fitted model and its components as (feature, component, loading).

    The sign of a component is free; in the table its largest part is positive.
    """
    model = PCA(k=k, inputCol=features, outputCol=name).fit(as_vector(df, features))
    loadings = model.pc.toArray()
    return model, _long(df.sparkSession, loadings * _signs(loadings), "loading")


def project(
    df: DataFrame, model: PCAModel, features: str = "features", name: str = "projected"
) -> DataFrame:
    """Rows times components, not centred; signs as in the components table."""
    loadings = model.pc.toArray()
    signs = doubles(_signs(loadings))
    scored = as_array(model.transform(as_vector(df, features)), model.getOutputCol())
    return scored.withColumn(
        name, P.zip_with(P.col(model.getOutputCol()), signs, lambda x, s: x * s)
    )


FAN_IN_BYTES = 64 << 20  # of triangular factors that meet in one task


def triangular_factor(df: DataFrame, features: str = "features") -> np.ndarray:
    """R of A = QR for the rows of ``df``, by a tree of small factors; 0 x 0 for an empty table.

    Each task reduces its rows batch by batch to one features x features triangle; triangles
    are stacked and reduced in groups until one group is left. Rows without features are left out.
    """

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = None
        for batch in batches:
            for block in triangles.rows_of(batch.column("entries")):
                factor = triangles.stacked(factor, block)
        yield triangles.lines(TaskContext.get().partitionId(), factor)

    def reduce_group(group: pa.Table) -> pa.Table:
        factor = None
        for block in triangles.rows_of(group.column("entries").combine_chunks()):
            factor = triangles.stacked(factor, block)
        return pa.Table.from_batches([triangles.lines(group["part"][0].as_py(), factor)])

    rows = as_array(df.select(P.col(features).alias("entries")), "entries").filter("entries IS NOT NULL")
    level = materialize(rows.mapInArrow(reduce_rows, triangles.SCHEMA), "triangles")
    while True:
        size, parts, last = level.agg(P.max(P.size("entries")), P.count_distinct("part"), P.max("part")).first()
        fan_in = max(2, FAN_IN_BYTES // (8 * (size or 1) ** 2))
        if parts <= fan_in:
            found = level.select("entries").toArrow()["entries"].combine_chunks()
            factor = np.zeros((0, 0))
            for block in triangles.rows_of(found):
                factor = triangles.stacked(factor if factor.size else None, block)
            return factor
        width = max(fan_in, 2)
        grouped = level.withColumn("part", P.floor(P.col("part") / width).cast("long"))
        level = materialize(grouped.groupBy("part").applyInArrow(reduce_group, triangles.SCHEMA), "triangles")


def singular_values(
    df: DataFrame, k: int = 3, r_cond: float = 1e-9, features: str = "features"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """U (input rows with a ``u`` column), s (component, value), V (feature, component).

    One pass reduces the rows to a triangle of features x features entries, whose singular
    values are those of the table; since no product of rows is formed, values down to some 1e-15 times the
    largest are told from zero. U = A V / s is a row expression over the input. Values not above ``r_cond``
    times the largest are left out.
    """
    spark = df.sparkSession
    factor = triangular_factor(df, features)
    _, s, rows = np.linalg.svd(factor) if factor.size else (None, np.zeros(0), np.zeros((0, 0)))
    s = s[:k]
    s = s[s > r_cond * max(s[:1], default=0.0)]
    v = rows.T[:, : len(s)]
    v = v * _signs(v) if v.size else v
    values = spark.createDataFrame(
        [(i, float(x)) for i, x in enumerate(s)], "component int, singular_value double"
    )
    right = _long(spark, v, "loading")
    arrays = as_array(df, features)
    parts = [dot(P.col(features), doubles(v[:, j] / s[j])) for j in range(len(s))]
    left = arrays.withColumn("u", P.array(*parts).cast("array<double>"))
    return left, values, right


def reduce_features(
    df: DataFrame, k: int, features: str = "features"
) -> DataFrame:
    """The same table with its features replaced by k components."""
    model, _ = principal_components(df, k, features, "_projected")
    return project(df, model, features, "_projected").drop(features).withColumnRenamed(
        "_projected", features
    )
