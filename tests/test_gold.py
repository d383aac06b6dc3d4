"""Literal inputs with results known by hand or from published examples."""

import itertools
import math
import re
import subprocess
import sys
from datetime import datetime

import numpy as np
import pytest

from foldlight.functions import tails
from foldlight.operators import cluster, evaluate, features, patterns, sampling, stats

THREE = [[1.12, 2.05, 3.12], [5.56, 6.28, 8.94], [10.2, 8.0, 20.5]]


def vectors(spark, rows, label=None):
    data = [(float(label[i]) if label else 0.0, [float(x) for x in r]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "label double, features array<double>")


def test_column_stats(spark):
    out = stats.column_stats(vectors(spark, [[1, 10, 100], [2, 20, 200], [3, 30, 300]]))
    rows = out.orderBy("feature").collect()
    assert [r["mean"] for r in rows] == [2, 20, 200]
    assert [round(r["variance"], 6) for r in rows] == [1, 100, 10000]
    assert [r["non_zeros"] for r in rows] == [3, 3, 3]


def test_correlation_pair(spark):
    df = spark.createDataFrame(
        list(zip([1.0, 2.0, 3.0, 3.0, 5.0], [11.0, 22.0, 33.0, 33.0, 555.0], strict=True)), "x double, y double"
    )
    assert stats.correlation(df, "x", "y").head()[0] == pytest.approx(0.8500286768773)
    assert stats.correlation(df, "x", "y", "spearman").head()[0] == pytest.approx(1.0)


@pytest.mark.parametrize(
    "method, want",
    [("pearson", (0.9788834659, 0.9903895696, 0.9977483233)), ("spearman", (1.0, 1.0, 1.0))],
)
def test_correlation_matrix(spark, method, want):
    df = vectors(spark, [[1, 10, 100], [2, 20, 200], [5, 33, 366]])
    cells = {(r.i, r.j): r.correlation for r in stats.correlation_matrix(df, method).collect()}
    got = (cells[0, 1], cells[0, 2], cells[1, 2])
    assert got == pytest.approx(want)
    assert cells[2, 1] == pytest.approx(cells[1, 2])


def test_chi_square_fit(spark):
    df = spark.createDataFrame(
        list(enumerate([0.1, 0.15, 0.2, 0.3, 0.25])), "category int, w double"
    )
    row = stats.chi_square_fit(df, "category", weight="w").head()
    assert row["statistic"] == pytest.approx(0.125)
    assert row["degrees"] == 4
    assert row["p_value"] == pytest.approx(0.998126379)
    given = stats.chi_square_fit(df, "category", dict.fromkeys(range(5), 3.0), weight="w").head()
    assert given["statistic"] == pytest.approx(0.125)
    assert given["p_value"] == pytest.approx(0.998126379)


def test_chi_square_independence(spark):
    cells = [(i, j, float(v)) for i, r in enumerate([(1, 2), (3, 4), (5, 6)]) for j, v in enumerate(r)]
    df = spark.createDataFrame(cells, "i int, j int, w double")
    row = stats.chi_square_independence(df, "i", "j", "w").head()
    assert row["statistic"] == pytest.approx(0.141414141)
    assert row["degrees"] == 2
    assert row["p_value"] == pytest.approx(0.931734785)


def test_chi_square_independence_with_empty_cells(spark):
    rows = [("a", "x")] * 4 + [("b", "y")] * 3 + [("b", "x")] * 2
    df = spark.createDataFrame(rows, "r string, c string")
    table = np.array([[4.0, 0.0], [2.0, 3.0]])
    e = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    row = stats.chi_square_independence(df, "r", "c").head()
    assert row["statistic"] == pytest.approx(((table - e) ** 2 / e).sum())
    assert row["degrees"] == 1


def test_chi_square_features(spark):
    df = vectors(spark, [[1, 0, 3], [1, 2, 0], [-1, 0, -0.5]], [1, 1, -1])
    rows = stats.chi_square_features(df).orderBy("feature").collect()
    assert [r["statistic"] for r in rows] == pytest.approx([3, 0.75, 3])


def test_kolmogorov_smirnov(spark):
    df = spark.createDataFrame([(v,) for v in [0.1, 0.15, 0.2, 0.3, 0.25]], "x double")
    row = stats.kolmogorov_smirnov(df, "x", "norm", 0.0, 1.0).head()
    assert row["statistic"] == pytest.approx(0.539827837)
    assert row["p_value"] == pytest.approx(0.068214631)


def test_normal_cdf(spark):
    xs = [-40.0, -8.0, -7.0, -3.3, -1.0, -0.1, 0.0, 0.4, 2.0, 5.0, 7.5, 39.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(tails.normal_cdf(df.x)).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], rel=1e-12)


def test_tail_helpers_travel_without_the_package(tmp_path):
    from pyspark import cloudpickle

    path = tmp_path / "f"
    path.write_bytes(cloudpickle.dumps(tails.chi2_tail))
    code = f"import pickle; print(pickle.load(open({str(path)!r}, 'rb'))(0.125, 4))"
    out = subprocess.run([sys.executable, "-c", code], cwd="/", capture_output=True, text=True)
    assert float(out.stdout) == pytest.approx(0.998126379), out.stderr


def test_kernel_density(spark):
    sample = [float(v) for v in (1, 1, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 9)]
    df = spark.createDataFrame([(v,) for v in sample], "x double")
    rows = stats.kernel_density(df, "x", [-1, 2, 5], 3.0).orderBy("point").collect()
    assert [r["density"] for r in rows] == pytest.approx([0.0414594402, 0.0790201693, 0.0896292013])


def test_elementwise_product(spark):
    out = features.elementwise_product(vectors(spark, [[1, 2, 3], [4, 5, 6]]), [0, 1, 2])
    assert sorted(list(r["product"]) for r in out.collect()) == [[0, 2, 6], [0, 5, 12]]


def test_singular_values(spark):
    left, values, right = features.singular_values(vectors(spark, THREE), 3)
    s = np.array([r[1] for r in values.orderBy("component").collect()])
    assert s == pytest.approx([27.3384, 2.4372, 0.6561], abs=1e-4)
    v = np.zeros((3, 3))
    for r in right.collect():
        v[r["feature"], r["component"]] = r["loading"]
    for r in left.collect():
        assert (np.array(r["u"]) * s) @ v.T == pytest.approx(r["features"])


def test_principal_components(spark):
    df = vectors(spark, THREE)
    model, table = features.principal_components(df, 3)
    first = [r["loading"] for r in table.filter("component = 0").orderBy("feature").collect()]
    assert first == pytest.approx([0.437420, 0.277749, 0.855289], abs=1e-6)
    for r in features.project(df, model).collect():
        assert r["projected"][0] == pytest.approx(np.dot(r["features"], first))


def test_rules_from_itemsets(spark):
    sets = spark.createDataFrame(
        [(["a"], 15), (["b"], 35), (["a", "b"], 12)], "items array<string>, freq long"
    )
    rules = patterns.association_rules(sets, 0.8).collect()
    assert [(r.antecedent, r.consequent, r.confidence) for r in rules] == [(["a"], ["b"], 0.8)]


def test_frequent_itemsets_and_rules(spark):
    lines = [
        "r z h k p", "z y x w v u t s", "s x o n r", "x z y m t s q e", "z", "x z y r q t p",
    ]
    df = spark.createDataFrame([(line.split(" "),) for line in lines], "items array<string>")
    sets = patterns.frequent_itemsets(df, 0.2, partitions=10)
    assert sets.count() == 54
    rules = patterns.basket_rules(df, 0.2, 0.8)
    assert rules.count() == 85
    same = patterns.association_rules(sets, 0.8)
    key = lambda r: (tuple(r["antecedent"]), tuple(r["consequent"]), round(r["confidence"], 9))
    assert {key(r) for r in rules.collect()} == {key(r) for r in same.collect()}


def test_frequent_sequences(spark):
    data = [([[1, 2], [3]],), ([[1], [3, 2], [1, 2]],), ([[1, 2], [5]],), ([[6]],)]
    df = spark.createDataFrame(data, "sequence array<array<int>>")
    got = {str(r["sequence"]): r["freq"] for r in patterns.frequent_sequences(df, 0.5, 5).collect()}
    assert got == {"[[1]]": 3, "[[2]]": 3, "[[3]]": 2, "[[1, 2]]": 3, "[[1], [3]]": 2}


def test_longer_sequences_by_brute_force(spark, tmp_path):
    """All patterns of up to five items that half of the users hold, each tried on every user."""
    from foldlight.plans.catalog import QUERIES

    days = [
        ["ab", "c", "a", "bc", "a"], ["ab", "bc", "ac", "b"], ["a", "c", "ab", "abc"], ["c", "b", "ab", "a", "c"],
        ["abc", "abc"], ["b"],
    ]
    rows = [
        (u, datetime(2024, 1, 1 + d), t) for u, own in enumerate(days) for d, step in enumerate(own) for t in step
    ]
    spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string").write.parquet(
        f"{tmp_path}/events.parquet"
    )
    steps = ["a", "b", "c", "ab", "ac", "bc", "abc"]

    def holds(own, pattern):
        at = iter(own)
        return all(any(set(p) <= set(step) for step in at) for p in pattern)

    want = {}
    for n in range(1, 6):
        for pattern in itertools.product(steps, repeat=n):
            freq = sum(holds(own, pattern) for own in days)
            if sum(map(len, pattern)) <= 5 and freq >= 3:
                want[" > ".join("+".join(p) for p in pattern)] = freq
    got = QUERIES["g4_frequent_sequences_of_five"](spark, str(tmp_path)).collect()
    assert {r["pattern"]: r["freq"] for r in got} == want and len(got) == len(want)
    assert max(len(re.findall("[abc]", p)) for p in want) > 2


def test_bisecting_kmeans(spark):
    df = vectors(spark, [[v, v] for b in (0, 10, 20, 30) for v in (b + 0.1, b + 0.3)])
    points = cluster.centers(cluster.fit_bisecting_kmeans(df, 4))
    assert sorted(p[0] for p in points) == pytest.approx([0.2, 10.2, 20.2, 30.2])
    assert cluster.within_cluster_cost(df, points).head()[0] == pytest.approx(0.16)


def test_kmeans(spark):
    df = vectors(spark, [[v] * 3 for v in (0.0, 0.1, 0.2, 9.0, 9.1, 9.2)])
    model = cluster.fit_kmeans(df, 2)
    points = sorted(cluster.centers(model))
    assert points[0] == pytest.approx([0.1] * 3)
    assert points[1] == pytest.approx([9.1] * 3)
    assert cluster.within_cluster_cost(df, points).head()[0] == pytest.approx(0.12)
    got = [r["cluster"] for r in cluster.assign_clusters(df, points).orderBy("features").collect()]
    assert got == [0, 0, 0, 1, 1, 1]


def test_power_iteration_shape(spark):
    edges = [(0, 1, 0.9), (1, 2, 0.9), (2, 3, 0.9), (3, 4, 0.1), (4, 5, 0.9)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    out = cluster.power_iteration_clusters(df, 2, 10).collect()
    assert sorted(r["id"] for r in out) == [0, 1, 2, 3, 4, 5]
    assert {r["cluster"] for r in out} <= {0, 1}


def test_stratified_sample_exact(spark):
    df = spark.createDataFrame(
        [(1, "a"), (1, "b"), (2, "c"), (2, "d"), (2, "e"), (3, "f")], "key int, value string"
    )
    out = sampling.stratified_sample_exact(df, "key", {1: 0.1, 2: 0.6, 3: 0.3}, 7, ["value"])
    assert {r["key"]: r["count"] for r in out.groupBy("key").count().collect()} == {1: 1, 2: 2, 3: 1}


def test_multilabel(spark):
    data = [
        ([0.0, 1.0], [0.0, 2.0]),
        ([0.0, 2.0], [0.0, 1.0]),
        ([], [0.0]),
        ([2.0], [2.0]),
        ([2.0, 0.0], [2.0, 0.0]),
        ([0.0, 1.0, 2.0], [0.0, 1.0]),
        ([1.0], [1.0, 2.0]),
    ]
    df = spark.createDataFrame(data, "predicted array<double>, actual array<double>")
    per_row = evaluate.multilabel_metrics(df).head()
    assert tuple(per_row) == pytest.approx((0.666667, 0.642857, 0.638095, 0.547619), abs=1e-6)
    micro = evaluate.multilabel_micro(df).head().asDict()
    assert micro == pytest.approx(
        {
            "micro_precision": 0.727273,
            "micro_recall": 0.666667,
            "micro_f1": 0.695652,
            "hamming_loss": 0.333333,
            "subset_accuracy": 0.285714,
        },
        abs=1e-6,
    )
    assert evaluate.multilabel_by_class(df).count() == 3
