"""The class-feature jobs: from a table (label, features) to its report tables.

Each job takes what ``read_class_features`` gives. Such a table has no row key,
so its rows are numbered once in input order and folds go by the number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as P

from foldlight.functions.vectors import as_vector
from foldlight.operators.cluster import fit_kmeans
from foldlight.operators.features import (
    build_pipeline,
    index_features,
    index_labels,
    label_restorer,
)
from foldlight.operators.reshape import fold_summary
from foldlight.operators.running import with_file_row_id
from foldlight.operators.sampling import k_fold
from foldlight.plans.cross_validation import (
    SCORES,
    cross_validate,
    fold_scores,
    grid_search,
    score_folds,
)
from foldlight.plans.thresholds import search_from_scores

ROW = ("row_id",)
# The fold seeds of the jobs.
SEED = 77678969
SVM_SEED = 8762387863872386238
BAYES_SEED = 457687989080


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its ``row_id``, given or new."""
    return df if "row_id" in df.columns else with_file_row_id(df)


def _behind_indexers(df: DataFrame, classifier) -> tuple[Pipeline, int]:
    """Indexers fitted on all rows, the classifier, and the way back to label text.

    Also gives the place of label 1 among the indexed labels.
    """
    vectors = as_vector(df)
    labels, _ = index_labels(vectors)
    indexer, _ = index_features(vectors, 4)
    classifier.setLabelCol("indexed_label").setFeaturesCol("indexed_features")
    stages = [labels, indexer, classifier, label_restorer(labels.labels)]
    positive = [float(name) for name in labels.labels].index(1.0) if "1.0" in labels.labels else 1
    return build_pipeline(stages), positive


def _indexed_job(df: DataFrame, classifier, k: int) -> tuple[DataFrame, DataFrame]:
    df = numbered(df)
    pipeline, positive = _behind_indexers(df, classifier)
    _, per_fold, summary = cross_validate(
        pipeline, df, k, SEED, ROW, prediction="predicted_label", keep=(), positive=positive
    )
    return per_fold, summary


def forest_job(df: DataFrame, k: int = 10, **forest) -> tuple[DataFrame, DataFrame]:
    """Cross-validated random forest behind label and feature indexers: per fold, means."""
    return _indexed_job(df, RandomForestClassifier(**forest), k)


def logistic_pipeline_job(df: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Cross-validated logistic regression (10 steps) behind the same indexers."""
    return _indexed_job(df, LogisticRegression(maxIter=10), k)


def logistic_job(df: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Cross-validated plain logistic regression: per fold, means."""
    _, per_fold, summary = cross_validate(
        LogisticRegression(), numbered(df), k, BAYES_SEED, ROW, keep=()
    )
    return per_fold, summary


def elastic_logistic_job(df: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Cross-validated elastic-net logistic regression: per fold, means."""
    estimator = LogisticRegression(maxIter=10, regParam=0.7, elasticNetParam=0.8)
    _, per_fold, summary = cross_validate(estimator, numbered(df), k, BAYES_SEED, ROW, keep=())
    return per_fold, summary


def naive_bayes_job(df: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Cross-validated multinomial naive Bayes: per fold, means."""
    _, per_fold, summary = cross_validate(
        NaiveBayes(smoothing=1.0), numbered(df), k, BAYES_SEED, ROW, keep=()
    )
    return per_fold, summary


def svm_job(
    df: DataFrame, classes: Sequence[float] = (0.0, 1.0, 2.0), k: int = 10, iterations: int = 100
) -> tuple[DataFrame, DataFrame]:
    """Cross-validated linear SVM, one against the rest beyond two classes."""
    svm = LinearSVC(maxIter=iterations, regParam=0.01)
    estimator = svm if len(classes) == 2 else OneVsRest(classifier=svm)
    _, per_fold, summary = cross_validate(
        estimator, numbered(df), k, SVM_SEED, ROW, classes=classes, keep=()
    )
    return per_fold, summary


def svm_threshold_job(
    df: DataFrame,
    k: int = 10,
    min_f1: float | None = None,
    iterations: int = 100,
    from_training: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Threshold search of a binary SVM: best threshold with its means, per fold, means.

    Each fold is fitted once. Without ``min_f1`` every fold proposes one
    threshold, with it all thresholds above that F1. ``from_training`` lets the
    training rows of a fold propose instead of its validation rows.
    """
    folded = k_fold(numbered(df), k, SVM_SEED, ROW)
    svm = LinearSVC(maxIter=iterations, regParam=0.01)
    scored = score_folds(svm, folded, k)
    proposing = score_folds(svm, folded, k, training_rows=True) if from_training else None
    best = search_from_scores(scored, k, min_f1, proposing)
    at = best.select(P.col("threshold")).scalar()
    decided = scored.withColumn("prediction", (P.col("score") > at).cast("double"))
    per_fold = fold_scores(decided, [0.0, 1.0])
    return best, per_fold, fold_summary(per_fold, (*SCORES, "area_under_roc"))


def forest_grid_job(df: DataFrame, k: int = 10) -> tuple[Model, DataFrame]:
    """Grid search over a forest behind the indexers: best model, mean accuracy per setting."""
    df = numbered(df)
    forest = RandomForestClassifier()
    pipeline, _ = _behind_indexers(df, forest)
    grid = {"maxDepth": [2, 4, 6], "maxBins": [20, 60], "numTrees": [5, 20]}
    return grid_search(pipeline, grid, df, k, SEED, ROW, stage=forest, label="indexed_label")


def kmeans_job(df: DataFrame, k: int = 2, iterations: int = 100) -> tuple[KMeansModel, DataFrame]:
    """k-means on the features: model and within-cluster cost, which the fit has summed already."""
    model = fit_kmeans(df.select("features"), k, iterations)
    cost = float(model.summary.trainingCost)
    return model, df.sparkSession.createDataFrame([(cost,)], "cost double")
