"""Classifiers. Each ``fit_*`` returns a fitted Spark ML model."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    GBTClassificationModel,
    GBTClassifier,
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    LogisticRegressionModel,
    NaiveBayes,
    NaiveBayesModel,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as P

from foldlight.functions.vectors import as_vector
from foldlight.session import enable_checkpoints


def _fit(estimator: Estimator, df: DataFrame) -> Model:
    return estimator.fit(as_vector(df, estimator.getOrDefault("featuresCol")))


def fit_random_forest_classifier(
    df: DataFrame,
    trees: int = 3,
    depth: int = 5,
    bins: int = 32,
    seed: int = 12345,
    **params,
) -> RandomForestClassificationModel:
    """M1: gini forest with an automatic feature subset per split."""
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed, impurity="gini", **params
    )
    return _fit(forest, df)


def fit_logistic_regression(
    df: DataFrame,
    iterations: int = 100,
    reg: float = 0.0,
    elastic_net: float = 0.0,
    tol: float = 1e-6,
    family: str = "auto",
    **params,
) -> LogisticRegressionModel:
    """M2: binary or multinomial logistic regression, optionally elastic-net."""
    regression = LogisticRegression(
        maxIter=iterations,
        regParam=reg,
        elasticNetParam=elastic_net,
        tol=tol,
        family=family,
        **params,
    )
    return _fit(regression, df)


def objective_history(model: LogisticRegressionModel, df: DataFrame) -> DataFrame:
    """M3: training loss after each step as (step, loss); ``df`` names the session."""
    losses = [(i, float(v)) for i, v in enumerate(model.summary.objectiveHistory)]
    return df.sparkSession.createDataFrame(losses, "step int, loss double")


def fit_linear_svm(
    df: DataFrame, iterations: int = 100, reg: float = 0.01, classes: int = 2, **params
) -> LinearSVCModel | OneVsRestModel:
    """M4: linear support vector machine; one against the rest for more than two classes."""
    svm = LinearSVC(maxIter=iterations, regParam=reg, **params)
    return _fit(svm if classes == 2 else OneVsRest(classifier=svm, parallelism=4), df)


def fit_naive_bayes(
    df: DataFrame, smoothing: float = 1.0, model_type: str = "multinomial", **params
) -> NaiveBayesModel:
    """M5: multinomial naive Bayes; features must not be negative."""
    return _fit(NaiveBayes(smoothing=smoothing, modelType=model_type, **params), df)


def fit_decision_tree_classifier(
    df: DataFrame, depth: int = 5, bins: int = 32, **params
) -> DecisionTreeClassificationModel:
    """M6: gini tree."""
    tree = DecisionTreeClassifier(maxDepth=depth, maxBins=bins, impurity="gini", **params)
    return _fit(tree, df)


def fit_boosted_trees_classifier(
    df: DataFrame, rounds: int = 3, depth: int = 5, **params
) -> GBTClassificationModel:
    """M7: binary boosted trees on log loss."""
    enable_checkpoints(df.sparkSession)
    return _fit(GBTClassifier(maxIter=rounds, maxDepth=depth, **params), df)


def _second(name: str) -> Column:
    return vector_to_array(P.col(name))[1]


def score(model: Model, df: DataFrame, raw: bool = True) -> DataFrame:
    """M8: ``prediction`` plus a ``score`` column.

    ``raw`` gives what is left when the threshold is cleared: the probability of
    class 1, or the margin for models without probabilities. Otherwise the score
    is the predicted class.
    """
    names = {p.name for p in model.params}
    scored = model.transform(as_vector(df, model.getOrDefault("featuresCol")))
    if not raw:
        return scored.withColumn("score", P.col("prediction"))
    source = "probabilityCol" if "probabilityCol" in names else "rawPredictionCol"
    return scored.withColumn("score", _second(model.getOrDefault(source)))


def apply_threshold(df: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """M9: class 1 where the score is above the threshold."""
    return df.withColumn("prediction", (P.col(score) > P.lit(float(threshold))).cast("double"))


def logistic_summary(
    model: LogisticRegressionModel, df: DataFrame
) -> tuple[DataFrame, float, DataFrame, DataFrame]:
    """Predictions, area under ROC, F and precision by threshold on ``df``."""
    summary = model.evaluate(as_vector(df, model.getFeaturesCol()))
    return (
        summary.predictions,
        summary.areaUnderROC,
        summary.fMeasureByThreshold,
        summary.precisionByThreshold,
    )
