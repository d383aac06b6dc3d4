"""Invariants: partitioning, folds, skewed keys, optimality of fits, second opinions."""

import math
import random

import numpy as np
import pytest
from pyspark.mllib.evaluation import (
    BinaryClassificationMetrics,
    MulticlassMetrics,
    MultilabelMetrics,
    RankingMetrics,
    RegressionMetrics,
)
from pyspark.sql import functions as P

from foldlight.functions.vectors import as_vector
from foldlight.operators import (
    classify,
    cluster,
    evaluate,
    recommend,
    reshape,
    running,
    sampling,
    stats,
)
from foldlight.plans import ranking
from foldlight.plans.catalog import registry
from foldlight.plans.catalog.checked_models import user_item_ratings
from foldlight.sources.readers import table

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def orders(spark):
    return table(spark, FOLDER, "orders").select("o_orderkey", "o_orderpriority").cache()


def test_folds_do_not_depend_on_partitioning(orders):
    one = sampling.k_fold(orders.repartition(1), 10, 5, ["o_orderkey"])
    eight = sampling.k_fold(orders.repartition(8), 10, 5, ["o_orderkey"])
    assert rows_of(one) == rows_of(eight)


def test_folds_are_even_and_exhaustive(orders):
    folded = sampling.k_fold(orders, 10, 77678969, ["o_orderkey"])
    counts = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}
    n = orders.count()
    assert set(counts) == set(range(10))
    assert sum(counts.values()) == n
    assert all(abs(c - n / 10) < 5 * math.sqrt(n / 10) for c in counts.values())


def test_seeds_differ(orders):
    a = sampling.k_fold(orders, 10, 1, ["o_orderkey"])
    b = sampling.k_fold(orders, 10, 2, ["o_orderkey"])
    assert rows_of(a) != rows_of(b)


def test_split_parts_are_disjoint(orders):
    split = sampling.random_split(orders, [7, 3], 11, ["o_orderkey"])
    parts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert set(parts) == {0, 1}
    assert abs(parts[0] / orders.count() - 0.7) < 0.06


def test_exact_sample_with_a_hot_stratum(spark):
    # stratum 0 holds most rows; few hash slices force the ranking of a shared slice
    df = spark.range(3000).select(
        P.col("id"), P.when(P.col("id") % 3 > 0, 0).otherwise(P.col("id") % 7 + 1).alias("s")
    )
    fractions = {i: 0.05 + 0.1 * i for i in range(8)}
    want = {
        r["s"]: math.ceil(fractions[r["s"]] * r["count"])
        for r in df.groupBy("s").count().collect()
    }
    for slices in (4, 65536):
        out = sampling.stratified_sample_exact(df, "s", fractions, 3, ["id"], slices)
        got = {r["s"]: r["count"] for r in out.groupBy("s").count().collect()}
        assert got == want
        assert out.distinct().count() == out.count()
    a = sampling.stratified_sample_exact(df, "s", fractions, 3, ["id"], 4)
    assert rows_of(a) == rows_of(out)


def test_holdout_rest_with_nulls_and_duplicates(spark):
    df = spark.createDataFrame(
        [(1, "a"), (1, "a"), (2, None), (2, None), (3, "c"), (3, "c"), (None, "d")],
        "x int, y string",
    )
    sample = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    assert rows_of(reshape.holdout_rest(df, sample)) == [(3, "c"), (3, "c"), (None, "d")]


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    rng = random.Random(4)
    # group 0 is hot
    data = [(0 if rng.random() < 0.5 else rng.randrange(1, 5), i, rng.randrange(9)) for i in range(800)]
    df = spark.createDataFrame(data, "g int, o int, v long")
    out = running.running_totals(df.repartition(5), ["o"], ["v"], ["g"], descending)
    got = {(r["g"], r["o"]): (r["v_before"], r["v_all"]) for r in out.collect()}
    for g, o, _ in data:
        group = [(b, c) for a, b, c in data if a == g]
        before = sum(c for b, c in group if (b > o if descending else b < o))
        assert got[g, o] == (before, sum(c for _, c in group))


def test_running_totals_with_a_null_group(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 1, 7)], "g string, o int, v long")
    out = running.running_totals(df, ["o"], ["v"], ["g"])
    assert rows_of(out.select("g", "o", "v_before", "v_all")) == sorted(
        [(None, 1, 0, 11), (None, 2, 5, 11), ("a", 1, 0, 7)], key=str
    )


def test_row_ids(spark):
    df = spark.range(997).select((P.col("id") * 7919 % 997).alias("k"), P.col("id").alias("v"))
    out = running.with_row_id(df.repartition(6), ["k"])
    assert [(r["row_id"], r["k"]) for r in out.orderBy("row_id").collect()] == [
        (i, i) for i in range(997)
    ]


def test_hot_user_is_split_over_chunks(spark):
    hot = [(1, i, 5.0) for i in range(400)]
    rest = [(u, u, 5.0 if u % 2 else 0.0) for u in range(2, 40)]
    df = spark.createDataFrame(hot + rest, "user int, item int, rating double")
    lists = reshape.item_lists(df, 0.0, chunks=8).collect()
    mine = [r for r in lists if r["user"] == 1]
    assert len(mine) == 8
    assert sorted(i for r in mine for i in r["items"]) == list(range(400))
    assert max(len(r["items"]) for r in mine) < 100
    others = {r["user"]: r["items"] for r in lists if r["user"] != 1}
    assert others == {u: [u] if u % 2 else [] for u in range(2, 40)}


def test_repeated_pairs_weigh_like_the_plain_join(spark):
    ratings = spark.createDataFrame([(1, 1, 2.0), (1, 1, 4.0), (2, 1, 1.0)], "user int, item int, rating double")
    predictions = spark.createDataFrame(
        [(1, 1, 3.0), (1, 1, 3.0), (1, 1, 5.0), (2, 1, 1.5)], "user int, item int, prediction double"
    )
    joined = reshape.rates_and_predictions(ratings, predictions)
    plain = ratings.join(predictions, ["user", "item"])
    assert joined.agg(P.sum("copies")).head()[0] == plain.count() == 7
    want = plain.agg(P.avg((P.col("prediction") - P.col("rating")) ** 2)).head()[0]
    assert reshape.mean_squared_error(joined, weight="copies").head()["mse"] == pytest.approx(want)


def test_multiclass_second_opinion(spark):
    ruled = registry.ruled_lines(spark, FOLDER).cache()
    old = MulticlassMetrics(ruled.select("prediction", "label").rdd.map(tuple))
    for r in evaluate.per_class_metrics(ruled).collect():
        assert r["precision"] == pytest.approx(old.precision(r["class"]))
        assert r["recall"] == pytest.approx(old.recall(r["class"]))
        assert r["f_measure"] == pytest.approx(old.fMeasure(r["class"]))
        assert r["fpr"] == pytest.approx(old.falsePositiveRate(r["class"]))
    weighted = evaluate.weighted_metrics(ruled).head()
    assert weighted["weighted_precision"] == pytest.approx(old.weightedPrecision)
    assert weighted["weighted_f_measure"] == pytest.approx(old.weightedFMeasure())
    assert weighted["weighted_fpr"] == pytest.approx(old.weightedFalsePositiveRate)
    cells = evaluate.confusion_matrix(ruled).orderBy("label", "prediction").collect()
    assert [r["n"] for r in cells] == [int(v) for v in old.confusionMatrix().toArray().flatten()]


def test_binary_second_opinion(spark):
    scored = registry.scored_events(spark, FOLDER)
    old = BinaryClassificationMetrics(scored.select("score", "label").rdd.map(tuple))
    areas = evaluate.binary_areas(evaluate.threshold_curves(scored)).head()
    assert areas["area_under_roc"] == pytest.approx(old.areaUnderROC)
    assert areas["area_under_pr"] == pytest.approx(old.areaUnderPR)


def test_curve_ends(spark):
    scored = spark.createDataFrame([(0.9, 1.0), (0.5, 0.0), (0.5, 1.0), (0.1, 0.0)], "score double, label double")
    curves = evaluate.threshold_curves(scored)
    roc = [(r["fpr"], r["tpr"]) for r in evaluate.roc_curve(curves).collect()]
    assert sorted(roc) == [(0, 0), (0, 0.5), (0.5, 1), (1, 1), (1, 1)]
    pr = [(r["recall"], r["precision"]) for r in evaluate.pr_curve(curves).collect()]
    assert sorted(pr) == sorted([(0, 1), (0.5, 1), (1, 2 / 3), (1, 0.5)])
    first = evaluate.pr_curve(curves, first_precision=0.25).filter("threshold is null").head()
    assert first["precision"] == 0.25
    assert evaluate.area_under_pr(curves).head()[0] == pytest.approx(0.5 + 0.5 * (1 + 2 / 3) / 2)
    assert evaluate.area_under_roc(curves).head()[0] == pytest.approx(0.875)


def test_one_class_only(spark):
    scored = spark.createDataFrame([(0.9, 1.0), (0.5, 1.0)], "score double, label double")
    row = evaluate.binary_areas(evaluate.threshold_curves(scored)).head()
    assert row["area_under_roc"] == 0.0


def test_missing_class_adds_zero(spark):
    df = spark.createDataFrame(
        [(0, 0.0, 0.0), (0, 1.0, 1.0), (1, 0.0, 0.0)], "fold int, label double, prediction double"
    )
    rows = {r["fold"]: r["f_measure"] for r in evaluate.macro_metrics(df, by=["fold"]).collect()}
    assert rows == {0: 1.0, 1: 0.5}
    fixed = evaluate.macro_metrics(df, [0, 1, 2], ["fold"]).orderBy("fold").collect()
    assert [r["f_measure"] for r in fixed] == pytest.approx([2 / 3, 1 / 3])


def test_multilabel_second_opinion(spark):
    data = [([0.0, 1.0], [0.0, 1.0]), ([2.0], [1.0, 2.0]), ([], [1.0]), ([0.0, 1.0, 2.0], [2.0])]
    df = spark.createDataFrame(data, "predicted array<double>, actual array<double>")
    old = MultilabelMetrics(df.rdd.map(tuple))
    assert evaluate.multilabel_metrics(df).head()["f1"] == pytest.approx(old.f1Measure())
    micro = evaluate.multilabel_micro(df).head()
    assert micro["hamming_loss"] == pytest.approx(old.hammingLoss)
    for r in evaluate.multilabel_by_class(df).collect():
        assert r["f1"] == pytest.approx(old.f1Measure(r["class"]))


def test_ranking_second_opinion(spark):
    rated = registry.ratings(spark, FOLDER).cache()
    truth = reshape.items_by_user(rated, 12.0)
    top = recommend.top_items(registry.recency(spark, FOLDER), 10)
    got = evaluate.ranking_metrics(reshape.relevant_documents(truth, top)).head()
    liked, users = {}, set()
    for r in rated.collect():
        users.add(r["user"])
        if r["rating"] > 12:
            liked.setdefault(r["user"], []).append(r["item"])
    lists = {}
    for r in top.orderBy("user", "rank").collect():
        lists.setdefault(r["user"], []).append(r["item"])
    old = RankingMetrics(
        spark.sparkContext.parallelize([(lists[u], liked.get(u, [])) for u in sorted(users)])
    )
    for k in (1, 3, 5):
        assert got[f"precision_at_{k}"] == pytest.approx(old.precisionAt(k))
        assert got[f"ndcg_at_{k}"] == pytest.approx(old.ndcgAt(k))
    assert got["mean_average_precision"] == pytest.approx(old.meanAveragePrecision)


def test_regression_second_opinion(spark):
    rng = random.Random(1)
    data = [(rng.gauss(5, 2), rng.gauss(5, 2)) for _ in range(300)]
    df = spark.createDataFrame(data, "prediction double, label double")
    old = RegressionMetrics(df.rdd.map(tuple))
    got = evaluate.regression_metrics(df).head()
    assert got["rmse"] == pytest.approx(old.rootMeanSquaredError)
    assert got["mae"] == pytest.approx(old.meanAbsoluteError)
    assert got["r2"] == pytest.approx(old.r2)
    assert got["explained_variance"] == pytest.approx(old.explainedVariance)


def test_spearman_with_ties(spark):
    rng = random.Random(2)
    data = [(float(rng.randrange(4)), float(rng.randrange(6))) for _ in range(200)]
    df = spark.createDataFrame(data, "x double, y double")
    x, y = np.array(data).T

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    want = np.corrcoef(ranks(x), ranks(y))[0, 1]
    assert stats.correlation(df, "x", "y", "spearman").head()[0] == pytest.approx(want)
    packed = df.select(P.array("x", "y").alias("features"))
    cells = stats.correlation_matrix(packed, "spearman").filter("i = 0 and j = 1").head()
    assert cells["correlation"] == pytest.approx(want)


def test_kolmogorov_smirnov_second_opinion(spark):
    from pyspark.ml.stat import KolmogorovSmirnovTest

    balances = table(spark, FOLDER, "customer").select("c_acctbal")
    got = stats.kolmogorov_smirnov(balances, "c_acctbal", "norm", 4500.0, 3200.0).head()
    old = KolmogorovSmirnovTest.test(balances, "c_acctbal", "norm", 4500.0, 3200.0).head()
    assert got["statistic"] == pytest.approx(old["statistic"])
    assert got["p_value"] == pytest.approx(old["pValue"], abs=1e-6)


def test_welch_p_value(spark):
    # two groups of three: t = -1.2247, 4 degrees, p by hand from the t distribution
    df = spark.createDataFrame(
        [(False, 1.0), (False, 2.0), (False, 3.0), (True, 2.0), (True, 3.0), (True, 4.0)],
        "label boolean, value double",
    )
    row = stats.welch_test(df).head()
    t = -1 / math.sqrt(2 / 3)
    assert row["t"] == pytest.approx(t)
    assert row["degrees"] == pytest.approx(4)
    x = 4 / (4 + t * t)
    want = 1 - math.sqrt(1 - x) * (1 + x / 2)
    assert row["p_value"] == pytest.approx(want)


def test_cost_does_not_rise_with_k(spark):
    rows = registry.embedding_rows(spark, FOLDER).cache()
    costs = [
        cluster.within_cluster_cost(
            rows, cluster.centers(cluster.fit_bisecting_kmeans(rows, k))
        ).head()[0]
        for k in (2, 4, 8)
    ]
    assert costs == sorted(costs, reverse=True)


def test_factor_model_is_a_ridge_optimum(spark):
    """Given the item factors, the user factors of the last half step solve a ridge regression."""
    rated = user_item_ratings(spark, FOLDER)
    reg = 0.1
    model = recommend.fit_als(rated, rank=4, iterations=6, reg=reg)
    users = {r["id"]: np.array(r["features"]) for r in recommend.user_factors(model).collect()}
    items = {r["id"]: np.array(r["features"]) for r in recommend.item_factors(model).collect()}
    seen = {}
    for r in rated.collect():
        seen.setdefault(r["user"], []).append((items[r["item"]], r["rating"]))
    for user, rows in seen.items():
        v = np.array([a for a, _ in rows])
        y = np.array([b for _, b in rows])
        want = np.linalg.solve(v.T @ v + reg * len(y) * np.eye(4), v.T @ y)
        assert users[user] == pytest.approx(want, abs=1e-2, rel=1e-2)


def test_ranking_workflow(spark):
    scores, regression = ranking.evaluate_recommendations(
        user_item_ratings(spark, FOLDER), shift=10.0, rank=8, iterations=5
    )
    row = scores.head()
    assert row["precision_at_1"] > 0.5
    assert regression.head()["r2"] > 0.5


def test_loss_falls(spark):
    rows = registry.quality_rows(spark, FOLDER)
    model = classify.fit_logistic_regression(rows, iterations=20, reg=0.1, tol=1e-4)
    losses = [r["loss"] for r in classify.objective_history(model, rows).orderBy("step").collect()]
    assert losses == sorted(losses, reverse=True)
    assert len(losses) > 2


def test_score_forms(spark):
    rows = registry.quality_rows(spark, FOLDER).cache()
    for model in (classify.fit_logistic_regression(rows), classify.fit_linear_svm(rows, 20)):
        raw = classify.score(model, rows)
        cut = 0.5 if "probability" in raw.columns else 0.0
        decided = classify.apply_threshold(raw.withColumnRenamed("prediction", "said"), cut)
        assert decided.filter("said != prediction").count() == 0
        plain = classify.score(model, rows, raw=False)
        assert plain.filter("score != prediction").count() == 0


def test_logistic_summary(spark):
    rows = as_vector(registry.quality_rows(spark, "/root/testdata/sf0.01")).cache()
    model = classify.fit_logistic_regression(rows, iterations=10)
    predictions, area, f_measure, precision = classify.logistic_summary(model, rows)
    scored = classify.score(model, rows).select("label", "score")
    curves = evaluate.threshold_curves(scored)
    assert predictions.count() == rows.count()
    assert f_measure.count() > 1 and precision.count() == f_measure.count()
    assert evaluate.area_under_roc(curves).head()[0] == pytest.approx(area)


def test_topic_table_is_positive(spark):
    data = [(i, [float((i * j) % 5 + 1) for j in range(11)]) for i in range(12)]
    docs = spark.createDataFrame(data, "doc_id long, features array<double>")
    rows = cluster.topic_words(cluster.fit_topics(docs, 3, iterations=5), docs).collect()
    assert len(rows) == 33
    assert all(r["weight"] > 0 for r in rows)
