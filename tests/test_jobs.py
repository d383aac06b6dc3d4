"""The class-feature jobs on tables read back from a class-feature CSV."""

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as P

from foldlight.plans import cross_validation, jobs, thresholds
from foldlight.plans.catalog import registry
from foldlight.sources import readers

FOLDER = "/root/testdata/sf0.001"


def as_csv(spark, rows, path):
    n = len(rows.head()["features"])
    rows.select(
        P.col("label").alias("ClassId"), *[P.col("features")[i].alias(f"f{i}") for i in range(n)]
    ).write.option("header", True).csv(path)
    return readers.read_class_features(spark, path).cache()


@pytest.fixture(scope="module")
def binary(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("binary") / "csv")
    return as_csv(spark, registry.quality_rows(spark, "/root/testdata/sf0.01"), path)


@pytest.fixture(scope="module")
def classes(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("classes") / "csv")
    rows = registry.embedding_rows(spark, FOLDER).filter("label < 3")
    return as_csv(spark, rows, path)


def majority(df):
    counts = [r["count"] for r in df.groupBy("label").count().collect()]
    return max(counts) / sum(counts)


def check(df, per_fold, summary, k, binary_data):
    folds = per_fold.collect()
    assert len(folds) == k
    assert sum(r["validation_rows"] for r in folds) == df.count()
    row = summary.head()
    assert row["folds"] == k
    # the classes of the embeddings cannot be told apart, so only bounds hold there
    assert row["accuracy"] >= (majority(df) - 0.05 if binary_data else 0.1)
    for name in ("f_measure", "precision", "recall", "accuracy"):
        assert 0 <= row[name] <= 1
    if binary_data:
        assert row["area_under_roc"] > 0.8
    else:
        assert row["area_under_roc"] is None


def test_forest(binary):
    check(binary, *jobs.forest_job(binary, 3, numTrees=5, seed=1), 3, True)


def test_forest_three_classes(classes):
    check(classes, *jobs.forest_job(classes, 3, numTrees=5, seed=1), 3, False)


def test_logistic_pipeline(binary):
    check(binary, *jobs.logistic_pipeline_job(binary, 3), 3, True)


def test_logistic(binary):
    check(binary, *jobs.logistic_job(binary, 3), 3, True)


def test_elastic_logistic(binary):
    per_fold, summary = jobs.elastic_logistic_job(binary, 3)
    assert summary.head()["folds"] == 3


def test_naive_bayes(binary):
    per_fold, summary = jobs.naive_bayes_job(binary, 3)
    assert summary.head()["accuracy"] >= majority(binary) - 0.05


def test_svm_three_classes(classes):
    check(classes, *jobs.svm_job(classes, k=2, iterations=5), 2, False)


@pytest.mark.parametrize("min_f1, from_training", [(None, False), (0.8, False), (None, True)])
def test_svm_threshold(binary, min_f1, from_training):
    best, per_fold, summary = jobs.svm_threshold_job(binary, 3, min_f1, 20, from_training)
    found, means = best.head(), summary.head()
    assert means["f_measure"] == pytest.approx(found["f_measure"])
    assert means["accuracy"] == pytest.approx(found["accuracy"])
    assert means["area_under_roc"] > 0.8


def test_kmeans_job(binary):
    model, cost = jobs.kmeans_job(binary)
    assert len(model.clusterCenters()) == 2
    assert cost.head()["cost"] == pytest.approx(model.summary.trainingCost, rel=1e-3)


def test_grid_job(binary):
    grid = {"maxDepth": [2, 4], "numTrees": [3]}
    model, table = cross_validation.grid_search(
        RandomForestClassifier(seed=1), grid, jobs.numbered(binary), k=3, key=jobs.ROW
    )
    rows = table.collect()
    assert {r["maxDepth"] for r in rows} == {2, 4}
    assert model.getMaxDepth() == max(rows, key=lambda r: r["mean_accuracy"])["maxDepth"]


def test_threshold_scores_match_plain_counting(spark):
    scored = registry.scored_events(spark, FOLDER, 3).cache()
    candidates = spark.createDataFrame([(5.0,), (10.55,), (-1.0,), (1e6,)], "threshold double")
    got = {
        (r["fold"], r["threshold"]): r
        for r in thresholds.threshold_scores(scored, candidates, 3).collect()
    }
    data = scored.toPandas()
    assert len(got) == 12
    for (fold, threshold), row in got.items():
        part = data[data.fold == fold]
        said = part.score > threshold
        truth = part.label > 0.5
        f = []
        for a, b in ((said, truth), (~said, ~truth)):
            tp = float((a & b).sum())
            p = tp / a.sum() if a.sum() else 0.0
            r = tp / b.sum() if b.sum() else 0.0
            f.append(2 * p * r / (p + r) if p + r else 0.0)
        assert row["f_measure"] == pytest.approx(sum(f) / 2)
        assert row["accuracy"] == pytest.approx((said == truth).mean())
