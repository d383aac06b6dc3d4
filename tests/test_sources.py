"""Readers, sinks and model round trips."""

from types import SimpleNamespace

import pytest
from pyspark.errors import PySparkException
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    GBTClassificationModel,
    LinearSVCModel,
    LogisticRegressionModel,
    NaiveBayesModel,
    RandomForestClassificationModel,
)
from pyspark.ml.clustering import (
    BisectingKMeansModel,
    DistributedLDAModel,
    GaussianMixtureModel,
    KMeansModel,
)
from pyspark.ml.recommendation import ALSModel
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    GBTRegressionModel,
    IsotonicRegressionModel,
    LinearRegressionModel,
    RandomForestRegressionModel,
)
from pyspark.sql import functions as P

from foldlight.functions.vectors import as_vector
from foldlight.operators import classify, cluster, recommend, regress
from foldlight.plans.catalog import registry
from foldlight.plans.catalog.checked_models import letter_counts, user_item_ratings
from foldlight.session import scratch_dir
from foldlight.sources import readers, sinks

FOLDER = "/root/testdata/sf0.001"


def text(tmp_path, content):
    path = tmp_path / "in.txt"
    path.write_text(content)
    return str(path)


def test_class_features_drop_every_header(spark, tmp_path):
    path = text(tmp_path, "ClassId,a,b\n0,0.12,3.0\nClassId,a,b\n1,1e-3,-2\n")
    rows = readers.read_class_features(spark, path).collect()
    assert [(r["label"], r["features"]) for r in rows] == [(0, [0.12, 3]), (1, [0.001, -2])]
    assert readers.read_feature_vectors(spark, path).columns == ["features"]


def test_bad_number_fails_or_is_dropped(spark, tmp_path):
    path = text(tmp_path, "0,1.0\n1,x\n2,3.0\n")
    with pytest.raises(PySparkException):
        readers.read_class_features(spark, path).collect()
    kept = readers.read_class_features(spark, path, mode="drop").collect()
    assert [r["label"] for r in kept] == [0, 2]
    with pytest.raises(ValueError):
        readers.read_class_features(spark, path, mode="other")


def test_libsvm(spark, tmp_path):
    path = text(tmp_path, "1 1:0.5 3:2\n0 2:-1\n")
    sparse = readers.read_libsvm(spark, path, 4).collect()
    assert [r["features"].size for r in sparse] == [4, 4]
    dense = readers.read_libsvm(spark, path, dense=True).collect()
    assert [r["features"] for r in dense] == [[0.5, 0, 2], [0, -1, 0]]


def test_number_rows_trim(spark, tmp_path):
    rows = readers.read_number_rows(spark, text(tmp_path, "1 2 3 \n4 5 6\n\n")).collect()
    assert [r["features"] for r in rows] == [[1, 2, 3], [4, 5, 6]]


def test_label_comma_numbers_keep_the_last_feature(spark, tmp_path):
    rows = readers.read_label_comma_numbers(spark, text(tmp_path, "-0.4,1 2 3\n")).collect()
    assert [(r["label"], r["features"]) for r in rows] == [(-0.4, [1, 2, 3])]


@pytest.mark.parametrize("sep, line", [(",", "1,2,3.5"), ("::", "1::2::3.5::1424380312")])
def test_ratings(spark, tmp_path, sep, line):
    rows = readers.read_ratings(spark, text(tmp_path, line + "\n"), sep)
    assert rows.dtypes == [("user", "int"), ("item", "int"), ("rating", "double")]
    assert [tuple(r) for r in rows.collect()] == [(1, 2, 3.5)]


def test_baskets_keep_order(spark, tmp_path):
    rows = readers.read_baskets(spark, text(tmp_path, "z y x\nr\n")).collect()
    assert [r["items"] for r in rows] == [["z", "y", "x"], ["r"]]


def test_in_memory_rows(spark):
    df = readers.rows(spark, [(1, "a"), (2, "b")], "key int, value string", partitions=2)
    assert df.rdd.getNumPartitions() == 2
    assert df.count() == 2


def session_like(named, master):
    conf = SimpleNamespace(get=lambda key, default=None: named)
    return SimpleNamespace(
        conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app-1")
    )


def test_scratch_folder_comes_from_the_session():
    assert scratch_dir(session_like("/shared/scratch/", "yarn")) == "/shared/scratch"
    with pytest.raises(RuntimeError):
        scratch_dir(session_like(None, "yarn"))
    made = scratch_dir(session_like(None, "local[2]"))
    assert made == scratch_dir(session_like(None, "local[2]"))


def test_factor_files(spark, tmp_path):
    model = recommend.fit_als(user_item_ratings(spark, FOLDER), rank=3, iterations=2)
    sinks.write_factors(model, str(tmp_path / "out"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out" / "userFeatures")).collect()]
    assert len(lines) == recommend.user_factors(model).count()
    want = {r["id"]: r["features"] for r in recommend.user_factors(model).collect()}
    for line in lines:
        key, numbers = line.split(",", 1)
        got = [float(x) for x in numbers.strip("[]").split(", ")]
        assert got == pytest.approx(want[int(key)], rel=1e-6)


def _fits(spark):
    docs = as_vector(registry.quality_rows(spark, FOLDER)).cache()
    yield docs, classify.fit_logistic_regression(docs), LogisticRegressionModel
    yield docs, classify.fit_linear_svm(docs, 10), LinearSVCModel
    yield docs, classify.fit_naive_bayes(docs), NaiveBayesModel
    yield docs, classify.fit_decision_tree_classifier(docs), DecisionTreeClassificationModel
    yield docs, classify.fit_random_forest_classifier(docs), RandomForestClassificationModel
    yield docs, classify.fit_boosted_trees_classifier(docs, 2), GBTClassificationModel
    yield docs, regress.fit_linear_regression(docs), LinearRegressionModel
    yield docs, regress.fit_decision_tree_regressor(docs), DecisionTreeRegressionModel
    yield docs, regress.fit_random_forest_regressor(docs), RandomForestRegressionModel
    yield docs, regress.fit_boosted_trees_regressor(docs, 2), GBTRegressionModel
    one = docs.withColumn("feature", P.col("doc_id").cast("double"))
    yield one, regress.fit_isotonic(one), IsotonicRegressionModel
    yield docs, cluster.fit_kmeans(docs, 2), KMeansModel
    yield docs, cluster.fit_bisecting_kmeans(docs, 2), BisectingKMeansModel
    yield docs, cluster.fit_gaussian_mixture(docs, 2, 5), GaussianMixtureModel
    rated = user_item_ratings(spark, FOLDER)
    yield rated, recommend.fit_als(rated, 3, 2), ALSModel


def test_saved_models_predict_the_same(spark, tmp_path):
    for i, (rows, model, kind) in enumerate(_fits(spark)):
        path = str(tmp_path / f"m{i}")
        sinks.save_model(model, path)
        sinks.save_model(model, path)
        again = sinks.load_model(kind, path)
        keys = ["user", "item"] if kind is ALSModel else ["doc_id"]
        a = model.transform(rows).select(*keys, "prediction").orderBy(*keys).collect()
        b = again.transform(rows).select(*keys, "prediction").orderBy(*keys).collect()
        assert a == b and a, kind


def test_saved_topics_are_the_same(spark, tmp_path):
    docs = letter_counts(spark, FOLDER)
    model = cluster.fit_topics(docs, 2, iterations=2)
    sinks.save_model(model, str(tmp_path / "topics"))
    again = sinks.load_model(DistributedLDAModel, str(tmp_path / "topics"))
    a = {(r["word"], r["topic"]): r["weight"] for r in cluster.topic_words(model, docs).collect()}
    b = {(r["word"], r["topic"]): r["weight"] for r in cluster.topic_words(again, docs).collect()}
    assert a == pytest.approx(b)
