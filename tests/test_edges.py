"""Constant columns, nulls, unlisted values, short lines and large dictionaries."""

import math
import os

import pytest
from pyspark.sql import functions as F

from foldlight.functions.hashing import hash32
from foldlight.operators import evaluate, features, running, sampling, stats
from foldlight.operators.patterns import baskets_from_rows, sequences_from_rows
from foldlight.plans import jobs
from foldlight.sources import readers
from foldlight.streaming import welch


def test_keys_with_nulls_differ(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None), (None, "a", "b")], "x string, y string, z string")
    assert df.select(hash32(1, ["x", "y", "z"])).distinct().count() == 3


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation_with_a_constant(spark, method):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "x double, y double")
    assert math.isnan(stats.correlation(df, "x", "y", method).head()[0])


def test_unlisted_category(spark):
    df = spark.createDataFrame([("a",)] * 10 + [("b",)] * 10 + [("other",)] * 10, "c string")
    row = stats.chi_square_fit(df, "c", {"a": 1, "b": 1}).head()
    assert row.statistic == math.inf and row.p_value == 0.0
    nulls = spark.createDataFrame([("a",)] * 3 + [(None,)], "c string")
    assert stats.chi_square_fit(nulls, "c", {"a": 1, "b": 1}).head().statistic == math.inf
    missing = df.filter("c = 'a'")
    assert stats.chi_square_fit(missing, "c", {"a": 1, "b": 1}).head().statistic == pytest.approx(10.0)


def test_null_category_is_left_out(spark):
    rows = [("x", "p")] * 8 + [("x", "q")] * 3 + [("y", "p")] * 2 + [("y", "q")] * 9
    whole = spark.createDataFrame(rows, "r string, c string")
    more = whole.union(spark.createDataFrame([(None, "p"), ("x", None)], whole.schema))
    assert stats.chi_square_independence(more, "r", "c").head() == stats.chi_square_independence(whole, "r", "c").head()


def test_welch_of_constant_groups(spark):
    df = spark.createDataFrame([(g, 1.0 + g) for g in (False, True) for _ in range(4)], "label boolean, value double")
    row = stats.welch_test(df).head()
    assert (row.t, row.degrees, row.p_value) == (None, None, None)


def test_stream_survives_a_constant_prefix(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i, lines in enumerate((["true, 1", "true, 1", "false, 1", "false, 1"], ["true, 2", "false, 5", "true, 4"])):
        (inbox / f"{i}.txt").write_text("\n".join(lines))
        os.utime(inbox / f"{i}.txt", (1000 + i, 1000 + i))
    run = welch.streaming_welch(readers.stream_samples(spark, str(inbox), 1))
    run.query.awaitTermination()
    rows = sorted(run.results(spark).collect(), key=lambda r: r.batch_id)
    assert rows[0].p_value is None and rows[1].p_value is not None


def test_ignored_batches_count(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i in range(5):
        (inbox / f"{i}.txt").write_text("true, 1\ntrue, 2\nfalse, 1\nfalse, 3")
    stream = readers.stream_samples(spark, str(inbox), 1)
    running_, reason = welch.stop_when_significant(
        lambda watch: welch.streaming_welch(stream, peace_period=2, on_result=watch), alpha=0.0, max_batches=3
    )
    assert reason == "batches" and [r.batch_id for r in running_.results(spark).collect()] == [2]


def test_regression_with_weights_and_constant_labels(spark):
    rows = [(1.0, 2.0, 1), (3.0, 2.5, 3), (4.0, 4.0, 2), (1e9, 1e9 + 1, 1)]
    df = spark.createDataFrame(rows, "label double, prediction double, copies long")
    plain = df.select("label", "prediction", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")
    got = evaluate.regression_metrics(df, weight="copies").head()
    want = evaluate.regression_metrics(plain).head()
    assert list(got) == pytest.approx(list(want))
    by = evaluate.regression_metrics(df.withColumn("g", F.lit(None).cast("int")), ["g"], "copies").head()
    assert list(by)[1:] == pytest.approx(list(want))
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 0.5)], "label double, prediction double")
    assert evaluate.regression_metrics(same).head().r2 is None


def test_many_strata(spark):
    strata = {f"s{i}": 0.5 for i in range(10_000)}
    df = spark.range(40_000).select("id", F.concat(F.lit("s"), F.col("id") % 20_000).alias("s"))
    exact = sampling.stratified_sample_exact(df, "s", strata, 3, ["id"])
    assert exact.count() == 10_000
    some = sampling.stratified_sample(df, "s", strata, 3, ["id"]).count()
    assert 9_500 < some < 10_500


def test_singular_values_take_one_pass(spark):
    def jobs_of(columns):
        rows = [([float((i * j) % 7 + (i == j)) for j in range(columns)],) for i in range(60)]
        df = spark.createDataFrame(rows, "features array<double>")
        group = f"svd{columns}"
        spark.sparkContext.setJobGroup(group, group)
        _, values, _ = features.singular_values(df, 3)
        values.collect()
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs_of(300) == jobs_of(20)


@pytest.mark.parametrize("mode", ["drop", "fail"])
def test_bad_lines(spark, tmp_path, mode):
    def file(name, text):
        path = tmp_path / name
        path.write_text(text)
        return str(path)

    cases = [
        (readers.read_label_comma_numbers, file("a", "1,2 3\n5\n,\n2,4 4\n"), 2),
        (readers.read_ratings, file("b", "1,2,3\n1,2\n99999999999,1,2\nx,1,2\n4,5,6,7\n"), 2),
        (readers.read_class_features, file("c", "ClassId,a,b\n0,1,2\n1\n1,2,3,4\n1,5,6\n"), 2),
        (readers.read_feature_vectors, file("d", "0,1,2\n1\n1,5,6\n"), 2),
    ]
    for read, path, left in cases:
        if mode == "drop":
            assert len(read(spark, path, mode=mode).collect()) == left
        else:
            with pytest.raises(Exception):
                read(spark, path, mode=mode).collect()


def test_file_rows_are_numbered_in_input_order(spark, tmp_path):
    rows = spark.range(5_000).select(F.concat_ws(",", F.lit("1"), F.col("id").cast("string")).alias("value"))
    rows.coalesce(1).write.text(str(tmp_path / "f"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        df = readers.read_class_features(spark, str(tmp_path / "f"))
        assert df.rdd.getNumPartitions() > 3
        out = running.with_file_row_id(df).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(out) == 5_000 and all(r.row_id == r.features[0] for r in out)
    plain = running.with_file_row_id(spark.range(0, 100, 1, 7))
    assert all(r.row_id == r.id for r in plain.collect())


def test_equal_rows_spread_over_folds(spark):
    df = spark.createDataFrame([(1.0, [1.0, 2.0])] * 900 + [(0.0, [float(i), 1.0]) for i in range(100)], "label double, features array<double>")
    folded = sampling.k_fold(jobs.numbered(df), 10, jobs.SEED, jobs.ROW)
    sizes = [r["count"] for r in folded.groupBy("fold").count().collect()]
    assert len(sizes) == 10 and min(sizes) > 60 and max(sizes) < 140


def test_shuffles_of_the_list_builders(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    df = lines.selectExpr("l_orderkey AS b", "l_linenumber AS s", "l_partkey AS i").repartition(4)
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (
        baskets_from_rows(df, ["b"], "i"), sequences_from_rows(df, ["b"], "s", "i"))]
    assert [p.count("hashpartitioning(") for p in plans] == [1, 2]


def test_kolmogorov_tail_is_smooth():
    from foldlight.functions.tails import _ks_exact, _ks_series, ks_tail

    # published quantiles: P(D > d) for n = 20, 50, 100 at the 5 % and 1 % points
    for n, d, p in ((20, 0.29408, 0.05), (50, 0.18841, 0.05), (100, 0.13403, 0.05), (100, 0.16081, 0.01)):
        assert ks_tail(d, n) == pytest.approx(p, abs=3e-4)
    for n in (100, 300):  # the two forms agree
        for i in range(8, 40):
            d = i / 20 / math.sqrt(n)
            assert _ks_series(d, n) == pytest.approx(1 - _ks_exact(d, n), abs=1e-5)
    for n in (7, 99, 100, 2000, 10**6, 10**12):
        at = [ks_tail(x / math.sqrt(n), n) for x in [i / 500 for i in range(100, 1500)]]
        assert all(a >= b - 1e-9 for a, b in zip(at, at[1:])) and max(a - b for a, b in zip(at, at[1:])) < 0.01
    assert ks_tail(1e-8, 10**12) == pytest.approx(1.0)
    assert ks_tail(0.041, 2000) == pytest.approx(0.002334, abs=1e-5)
    assert ks_tail(0.0, 5) == 1.0 and ks_tail(1.0, 10**6) == 0.0


def test_nearest_centres(spark):
    from foldlight.operators import cluster

    rows = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [9.0, 9.0]), (4, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "id int, features array<double>").repartition(2)
    centres = [[0.0, 0.0], [1.0, 0.0], [9.0, 8.0]]
    got = {r.id: r.cluster for r in cluster.assign_clusters(df, centres).collect()}
    assert got == {0: 0, 1: 1, 2: None, 3: 2, 4: 0}
    assert cluster.within_cluster_cost(df, centres).head().cost == pytest.approx(1.25)
    assert cluster.within_cluster_cost(df.filter("false"), centres).head().cost is None


def test_confusion_grid(spark):
    rows = [("g", 0.0, 1.0), ("g", 0.0, 0.0), ("g", 0.0, 0.0), (None, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, label double, prediction double")
    got = {tuple(r)[:3]: r.n for r in evaluate.confusion_matrix(df, ["g"]).collect()}
    assert got == {("g", 0.0, 0.0): 2, ("g", 0.0, 1.0): 1, ("g", 1.0, 0.0): 0, ("g", 1.0, 1.0): 0, (None, 2.0, 2.0): 1}
    whole = evaluate.confusion_matrix(df, classes=[0.0, 1.0, 2.0])
    assert whole.count() == 9 and whole.agg(F.sum("n")).head()[0] == 4


def test_scope_removes_its_folders(spark):
    from pathlib import Path

    from foldlight.session import scratch_scope

    df = spark.createDataFrame([(float(i % 7),) for i in range(100)], "x double")
    with scratch_scope(spark) as paths:
        assert stats.kolmogorov_smirnov(df, "x").count() == 1
        written = [Path(p.removeprefix("file:")) for p in paths]
        assert written and all(p.exists() for p in written)
    assert not any(p.exists() for p in written)
