"""Fitted models without a closed form: scores on held-out rows, no SQL."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.sql import functions as P

from foldlight.functions.vectors import as_vector
from foldlight.operators import classify, cluster, evaluate, features, recommend, regress, sampling
from foldlight.operators.reshape import rates_and_predictions
from foldlight.plans import cross_validation, ranking, thresholds
from foldlight.plans.catalog.checked_models import letter_counts, trade_edges, user_item_ratings
from foldlight.plans.catalog.registry import (
    FOLD_SEED,
    embedding_rows,
    priced_rows,
    quality_rows,
    query,
)


def halves(df, key):
    """Training and test part (0.7 / 0.3)."""
    split = sampling.random_split(df, [0.7, 0.3], 11, key)
    return (
        split.filter("split = 0").drop("split"),
        split.filter("split = 1").drop("split"),
    )


def class_scores(model, test):
    scored = model.transform(as_vector(test))
    return evaluate.per_class_metrics(scored.select("label", "prediction"))


def score_areas(model, test):
    scored = classify.score(model, test).select("label", "score")
    return evaluate.binary_areas(evaluate.threshold_curves(scored))


@query("m1_random_forest_classifier")
def m1_random_forest_classifier(spark, folder):
    train, test = halves(quality_rows(spark, folder), ["doc_id"])
    return class_scores(classify.fit_random_forest_classifier(train), test)


@query("m2_logistic_regression_elastic_net")
def m2_logistic_regression_elastic_net(spark, folder):
    train, test = halves(quality_rows(spark, folder), ["doc_id"])
    model = classify.fit_logistic_regression(train, iterations=10, reg=0.01, elastic_net=0.8)
    return score_areas(model, test)


@query("m2_logistic_regression_ten_classes")
def m2_logistic_regression_ten_classes(spark, folder):
    train, test = halves(embedding_rows(spark, folder), ["vec_id"])
    return class_scores(classify.fit_logistic_regression(train, iterations=20), test)


@query("m3_objective_history")
def m3_objective_history(spark, folder):
    rows = quality_rows(spark, folder)
    model = classify.fit_logistic_regression(rows, iterations=20, reg=0.1, tol=1e-4)
    return classify.objective_history(model, rows)


@query("m4_linear_svm")
def m4_linear_svm(spark, folder):
    train, test = halves(quality_rows(spark, folder), ["doc_id"])
    return score_areas(classify.fit_linear_svm(train, iterations=100), test)


@query("m4_linear_svm_one_against_rest")
def m4_linear_svm_one_against_rest(spark, folder):
    train, test = halves(embedding_rows(spark, folder), ["vec_id"])
    return class_scores(classify.fit_linear_svm(train, iterations=100, classes=10), test)


@query("m6_decision_tree_classifier")
def m6_decision_tree_classifier(spark, folder):
    train, test = halves(quality_rows(spark, folder), ["doc_id"])
    return class_scores(classify.fit_decision_tree_classifier(train), test)


@query("m7_boosted_trees_classifier")
def m7_boosted_trees_classifier(spark, folder):
    train, test = halves(quality_rows(spark, folder), ["doc_id"])
    return score_areas(classify.fit_boosted_trees_classifier(train), test)


@query("m8_score")
def m8_score(spark, folder):
    train, test = halves(quality_rows(spark, folder), ["doc_id"])
    model = classify.fit_logistic_regression(train)
    return classify.score(model, test).select("doc_id", "label", "prediction", "score")


@query("e10_logistic_summary")
def e10_logistic_summary(spark, folder):
    train, test = halves(quality_rows(spark, folder), ["doc_id"])
    model = classify.fit_logistic_regression(train, iterations=10)
    _, _, f_measure, precision = classify.logistic_summary(model, test)
    return f_measure.join(precision, "threshold")


@query("t4_pipeline")
def t4_pipeline(spark, folder):
    """Label indexer, feature indexer, forest and label restorer, scored as label text."""
    rows = as_vector(embedding_rows(spark, folder))
    labels, _ = features.index_labels(rows)
    indexer, _ = features.index_features(rows, 4)
    forest = RandomForestClassifier(
        labelCol="indexed_label", featuresCol="indexed_features", seed=12345
    )
    stages = [labels, indexer, forest, features.label_restorer(labels.labels)]
    model = features.build_pipeline(stages).fit(rows)
    return model.transform(rows).groupBy("label", "predicted_label").agg(
        P.count(P.lit(1)).alias("n")
    )


@query("r2_decision_tree_regressor")
def r2_decision_tree_regressor(spark, folder):
    rows = priced_rows(spark, folder)
    return evaluate.regression_metrics(
        regress.predict(regress.fit_decision_tree_regressor(rows), rows)
    )


@query("r3_random_forest_regressor")
def r3_random_forest_regressor(spark, folder):
    rows = priced_rows(spark, folder)
    return evaluate.regression_metrics(
        regress.predict(regress.fit_random_forest_regressor(rows), rows)
    )


@query("r4_boosted_trees_regressor")
def r4_boosted_trees_regressor(spark, folder):
    rows = priced_rows(spark, folder)
    return evaluate.regression_metrics(
        regress.predict(regress.fit_boosted_trees_regressor(rows), rows)
    )


@query("c5_gaussian_mixture")
def c5_gaussian_mixture(spark, folder):
    rows = features.reduce_features(embedding_rows(spark, folder), 4)
    return cluster.mixture_parts(cluster.fit_gaussian_mixture(rows, 2, iterations=20))


@query("c6_topics")
def c6_topics(spark, folder):
    docs = letter_counts(spark, folder)
    return cluster.topic_words(cluster.fit_topics(docs, 3, iterations=20), docs)


@query("c7_power_iteration_clusters")
def c7_power_iteration_clusters(spark, folder):
    return cluster.power_iteration_clusters(trade_edges(spark, folder), 2, 10)


@query("l1_ranking_evaluation")
def l1_ranking_evaluation(spark, folder):
    scores, _ = ranking.evaluate_recommendations(
        user_item_ratings(spark, folder), shift=10.0, rank=10, iterations=10, reg=0.01
    )
    return scores


@query("l1_regression_evaluation")
def l1_regression_evaluation(spark, folder):
    rated = user_item_ratings(spark, folder)
    model = recommend.fit_als(rated, rank=10, iterations=10, reg=0.01)
    predicted = recommend.predict_ratings(model, rated)
    return evaluate.regression_metrics(
        rates_and_predictions(rated, predicted)
    )


@query("n1_cross_validate_logistic")
def n1_cross_validate_logistic(spark, folder):
    _, per_fold, _ = cross_validation.cross_validate(
        LogisticRegression(maxIter=10), quality_rows(spark, folder), k=10, key=["doc_id"]
    )
    return per_fold


@query("n2_grid_search")
def n2_grid_search(spark, folder):
    _, settings = cross_validation.grid_search(
        RandomForestClassifier(seed=12345),
        {"maxDepth": [2, 4, 6], "maxBins": [20, 60], "numTrees": [5, 20]},
        quality_rows(spark, folder),
        k=10,
        seed=FOLD_SEED,
        key=["doc_id"],
    )
    return settings


@query("n5_svm_threshold_search")
def n5_svm_threshold_search(spark, folder):
    """Fit each fold once, then search the threshold over the scored table."""
    folded = sampling.k_fold(quality_rows(spark, folder), 10, FOLD_SEED, ["doc_id"])
    scored = cross_validation.score_folds(LinearSVC(maxIter=100, regParam=0.01), folded, 10)
    return thresholds.search_from_scores(scored, 10)


@query("n6_compare_data_sets")
def n6_compare_data_sets(spark, folder):
    forms = cross_validation.with_reduced_forms({"embeddings": embedding_rows(spark, folder)}, 8)
    return cross_validation.compare_data_sets(
        LogisticRegression(maxIter=10), forms, k=10, key=["vec_id"]
    )
