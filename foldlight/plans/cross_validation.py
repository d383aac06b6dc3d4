"""Cross-validated model comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as P

from foldlight.functions.vectors import as_vector
from foldlight.operators.evaluate import binary_areas, macro_metrics, threshold_curves
from foldlight.operators.features import reduce_features
from foldlight.operators.reshape import fold_counts, fold_summary
from foldlight.operators.sampling import k_fold
from foldlight.session import materialize

SCORES = ("f_measure", "precision", "recall", "accuracy")


def _scored(
    model: Model,
    rows: DataFrame,
    label: str,
    prediction: str,
    keep: Sequence[str],
    positive: int,
) -> DataFrame:
    out = model.transform(rows)
    # the score of the positive class; null where there are not exactly two classes
    value = P.lit(None)
    for source in ("probability", "rawPrediction"):
        if source in out.columns:
            score = vector_to_array(source)
            value = P.when(P.size(score) == 2, score[positive])
            break
    return out.select(
        "fold",
        *keep,
        P.col(label).cast("double").alias("label"),
        P.col(prediction).cast("double").alias("prediction"),
        value.cast("double").alias("score"),
    )


def score_folds(
    estimator: Estimator,
    folded: DataFrame,
    k: int,
    label: str = "label",
    prediction: str = "prediction",
    keep: Sequence[str] = (),
    parallelism: int = 5,
    training_rows: bool = False,
    positive: int = 1,
) -> DataFrame:
    """Fit on k - 1 folds, score the rest, for each fold; one written table of all scores.

    ``positive`` is the place of class 1 in the model's score vector. With
    ``training_rows`` each model scores the rows it was fitted on instead,
    to pick thresholds without looking at the validation fold.

    ``folded`` has an int ``fold`` column. It is written once, ordered by fold
    inside each file, so that every fit and every scoring pass reads prepared
    columns and skips the pages of the folds it does not need. Errors of a fold
    are raised.
    """
    if "features" in folded.columns:
        folded = as_vector(folded)
    kept = materialize(folded.sortWithinPartitions("fold"), "folds")

    def fit(i: int) -> Model:
        return estimator.fit(kept.filter(P.col("fold") != i))

    with ThreadPool(min(parallelism, k)) as pool:
        models = pool.map(inheritable_thread_target(folded.sparkSession)(fit), range(k))

    def rows(i: int) -> DataFrame:
        if training_rows:
            return kept.filter(P.col("fold") != i).withColumn("fold", P.lit(i))
        return kept.filter(P.col("fold") == i)

    parts = [_scored(m, rows(i), label, prediction, keep, positive) for i, m in enumerate(models)]
    return materialize(reduce(DataFrame.unionAll, parts), "scored")


def fold_scores(scored: DataFrame, classes: Sequence[float] | None = None) -> DataFrame:
    """Rows, macro scores, accuracy and (binary data) area under ROC of each fold."""
    result = fold_counts(scored).join(macro_metrics(scored, classes, by=["fold"]), "fold")
    binary = scored.filter(P.col("score").isNotNull())
    if binary.isEmpty():
        return result.withColumn("area_under_roc", P.lit(None).cast("double"))
    areas = binary_areas(threshold_curves(binary, by=["fold"]), by=["fold"])
    return result.join(areas.select("fold", "area_under_roc"), "fold", "left")


def cross_validate(
    estimator: Estimator,
    df: DataFrame,
    k: int = 10,
    seed: int = 77678969,
    key: Sequence[str] = ("id",),
    classes: Sequence[float] | None = None,
    label: str = "label",
    prediction: str = "prediction",
    keep: Sequence[str] | None = None,
    parallelism: int = 5,
    positive: int = 1,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored rows, per-fold scores, their means).

    The scored rows carry the ``keep`` columns, the key if not given.
    """
    folded = k_fold(df, k, seed, key)
    kept = tuple(key) if keep is None else tuple(keep)
    scored = score_folds(
        estimator, folded, k, label, prediction, kept, parallelism, positive=positive
    )
    per_fold = fold_scores(scored, classes)
    return scored, per_fold, fold_summary(per_fold, (*SCORES, "area_under_roc"))


def grid_search(
    estimator: Estimator,
    grid: Mapping[str, Sequence[Any]],
    df: DataFrame,
    k: int = 10,
    seed: int = 77678969,
    key: Sequence[str] = ("id",),
    stage: Estimator | None = None,
    label: str = "label",
    metric: str = "accuracy",
    parallelism: int = 4,
) -> tuple[Model, DataFrame]:
    """Best model and a table (setting..., mean, deviation), one row per setting.

    ``grid`` maps parameter names of ``stage`` (default: the estimator itself) to
    values. All settings see the same folds.
    """
    target = stage if stage is not None else estimator
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder.addGrid(target.getParam(name), list(values))
    settings = builder.build()
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=settings,
        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName=metric),
        numFolds=k,
        foldCol="fold",
        parallelism=parallelism,
    )
    folded = k_fold(df, k, seed, key)
    if "features" in folded.columns:
        folded = as_vector(folded)
    model = search.fit(materialize(folded.sortWithinPartitions("fold"), "folds"))
    rows = [
        (*[setting[target.getParam(n)] for n in grid], float(mean), float(std))
        for setting, mean, std in zip(settings, model.avgMetrics, model.stdMetrics, strict=True)
    ]
    table = df.sparkSession.createDataFrame(rows, [*grid, f"mean_{metric}", f"std_{metric}"])
    return model.bestModel, table


def with_reduced_forms(data_sets: Mapping[str, DataFrame], k: int) -> dict[str, DataFrame]:
    """Each data set raw and after reduction to k principal components."""
    forms = dict(data_sets)
    for name, df in data_sets.items():
        forms[f"pca_{name}"] = reduce_features(df, k)
    return forms


def compare_data_sets(
    estimator: Estimator, data_sets: Mapping[str, DataFrame], **options: Any
) -> DataFrame:
    """:func:`cross_validate` on several named inputs, one row of means per input."""
    results = [
        cross_validate(estimator, df, **options)[2].select(P.lit(name).alias("data_set"), "*")
        for name, df in data_sets.items()
    ]
    return reduce(DataFrame.unionAll, results)
