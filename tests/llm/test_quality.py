"""Held-out accuracy, sample bounds and odd inputs of the compression classifier."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldlight.llm.quality import features, fit_logistic, fit_quality, held_out, sizes


@pytest.fixture(scope="module")
def scored(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = fit_quality(docs, labels)
    rows = model.score(docs).join(labels, "doc_id", "left").withColumn("out", held_out()).collect()
    return model, rows


def test_held_out_accuracy(scored):
    rows = [r for r in scored[1] if r.out and r.quality is not None]
    assert len(rows) > 900
    good = np.array([r.quality == 1 for r in rows])
    passed = np.array([r.score >= 0.7 for r in rows])
    assert (good == passed).mean() > 0.99
    assert passed[good].mean() > 0.995


def test_held_out_is_crc32(scored):
    for r in scored[1][:500]:
        assert r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1


def test_scores_match_a_plain_loop(scored, texts):
    model = scored[0]
    data = [t.encode() for t in texts.values()][:30]
    both = np.array([sizes(d, model.dictionaries) for d in data])
    x = features(both[:, 0], both[:, 1], np.array([len(d) for d in data]))
    assert np.isfinite(x).all()


def test_held_out_labels_are_not_used(spark, documents):
    labels = spark.createDataFrame(
        [(i, int(zlib.crc32(str(i).encode()) % 4 == 2)) for i in range(200)], "doc_id long, quality int"
    )
    model = fit_quality(documents, labels)  # every usable label is 0
    assert model.dictionaries is None and model.weights[0] == 0
    assert {r.score for r in model.score(documents).collect()} == {0.0}


def test_odd_rows(spark, odd, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    more = labels.union(labels.limit(3)).union(
        spark.createDataFrame([(None, 1, 0), (5, None, 0), (10**9, 1, 0), (6, 7, 0)], labels.schema)
    )
    model = fit_quality(documents, more)
    rows = model.score(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.score <= 1 for r in rows)
    same = {r.score for r in rows if r.doc_id == 7}
    assert len(same) == 1


def test_empty(spark, empty, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = fit_quality(empty, labels)
    assert model.score(empty).count() == 0
    assert {r.score for r in model.score(documents).collect()} == {0.5}


def test_logistic_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    assert np.allclose(fit_logistic(x, y), [0.5, 2, -1], atol=0.2)


def test_sample_is_bounded(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = fit_quality(documents, labels, sample_rows=5, sample_pieces=9, dictionary_bytes=700)
    assert all(len(d) <= 9000 for d in model.dictionaries)
    assert model.score(documents).agg(F.count("score")).first()[0] == documents.count()


def test_repeated_keys_do_not_enlarge_the_sample(spark, folder):
    """A labelled key in many rows and a label given many times: the model is that of one row each."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    first = labels.orderBy("doc_id").limit(3)
    again = docs.join(first.select("doc_id"), "doc_id").select(*docs.columns)
    more = docs.unionByName(again).unionByName(again).unionByName(again)
    a = fit_quality(docs, labels)
    b = fit_quality(more, labels.unionByName(first).unionByName(first))
    assert a.weights.tolist() == pytest.approx(b.weights.tolist()) and a.dictionaries == b.dictionaries
