"""Forms whose work must not meet in one place: triangles, pooled blocks, bounded products, id-lists."""

import itertools
from datetime import date
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldlight.operators import cluster, features, forests, recommend, regress, sequences


def table_of(spark, rows, parts=7):
    return spark.createDataFrame([([float(x) for x in r],) for r in rows], "features array<double>").repartition(parts)


@pytest.mark.parametrize("rank", [1, 2, 4])
def test_rank_deficient_rows(spark, rank):
    rng = np.random.default_rng(rank)
    for _ in range(4):
        rows = rng.normal(size=(300, rank)) @ rng.normal(size=(rank, 5))
        _, values, _ = features.singular_values(table_of(spark, rows), 5)
        got = [r.singular_value for r in values.orderBy("component").collect()]
        assert got == pytest.approx(np.linalg.svd(rows)[1][:rank])


def test_badly_conditioned_rows(spark):
    """Values down to 1e-8 of the largest, which squares would lose in rounding."""
    rng = np.random.default_rng(5)
    u, _ = np.linalg.qr(rng.normal(size=(400, 4)))
    v, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    want = [1.0, 1e-3, 1e-7, 1e-8]
    rows = u @ np.diag(want) @ v.T
    left, values, right = features.singular_values(table_of(spark, rows), 4)
    assert [r.singular_value for r in values.orderBy("component").collect()] == pytest.approx(want, rel=1e-6)
    s, loadings = np.array(want), np.zeros((4, 4))
    for r in right.collect():
        loadings[r.feature, r.component] = r.loading
    for r in left.limit(50).collect():
        assert np.array(r.u) * s @ loadings.T == pytest.approx(r.features, abs=1e-12)
    _, values, _ = features.singular_values(table_of(spark, rows), 4, r_cond=1e-5)
    assert values.count() == 2


def test_triangles_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(features, "FAN_IN_BYTES", 8 * 3 * 9)
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(500, 3))
    factor = features.triangular_factor(table_of(spark, rows, 23))
    assert np.abs(factor.T @ factor) == pytest.approx(np.abs(rows.T @ rows))


def test_singular_values_of_odd_tables(spark):
    schema = "features array<double>"
    left, values, right = features.singular_values(spark.createDataFrame([], schema), 3)
    assert (left.count(), values.count(), right.count()) == (0, 0, 0)
    zeros = spark.createDataFrame([([0.0, 0.0],)] * 5 + [(None,)], schema)
    left, values, _ = features.singular_values(zeros, 2)
    assert values.count() == 0 and left.count() == 6
    one = spark.createDataFrame([([3.0, 4.0],), (None,)], schema)
    left, values, _ = features.singular_values(one, 2)
    assert values.first().singular_value == pytest.approx(5.0) and left.count() == 2


def plain_isotonic(x, y, w):
    blocks = []
    for a, b, c in sorted(zip(x, y, w, strict=True)):
        blocks.append([a, a, c, b * c])
        while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] > blocks[-1][3] / blocks[-1][2]:
            _, high, more, total = blocks.pop()
            blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + more, blocks[-1][3] + total]
    out = {}
    for low, high, c, total in blocks:
        out |= {low: total / c, high: total / c}
    return out


@pytest.mark.parametrize("shape,chunk", [("rising", 64), ("falling", 7), ("noise", 2), ("saw", 16), ("cliff", 7)])
def test_isotonic_blocks(spark, shape, chunk):
    rng = np.random.default_rng(chunk)
    x = np.arange(60.0)
    y = {
        "rising": x,
        "falling": -x,
        "noise": rng.normal(size=60),
        "saw": x % 9 + x / 20,
        "cliff": np.where(x < 45, x, -100.0),
    }[shape]
    w = rng.integers(1, 9, 60).astype(float)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), w.tolist(), strict=True)), "feature double, label double, weight double")
    for sign in (1, -1):
        rows = df.withColumn("label", sign * F.col("label"))
        found = regress.isotonic_boundaries(rows, sign == 1, weight="weight", chunk=chunk)
        got = {r.boundary: sign * r.prediction for r in found.collect()}
        assert got == pytest.approx(plain_isotonic(x, y, w))


def test_isotonic_predictions_are_those_of_the_estimator(spark):
    rng = np.random.default_rng(9)
    rows = [(float(a), float(a + rng.normal(0, 9))) for a in rng.integers(0, 40, 400)]
    df = spark.createDataFrame(rows, "feature double, label double")
    asked = spark.createDataFrame([(float(a),) for a in np.arange(-3, 45, 0.37)] * 2 + [(None,)], "feature double")
    got = regress.interpolate(regress.isotonic_boundaries(df, chunk=5), asked)
    want = regress.fit_isotonic(df).transform(asked.na.drop())
    assert got.filter("feature IS NULL").select("prediction").collect() == [(None,)]
    pairs = zip(*(sorted(map(tuple, d.select("feature", "prediction").collect())) for d in (got.na.drop(), want)), strict=True)
    assert all(a == pytest.approx(b) for a, b in pairs)


def test_isotonic_predictions_read_each_row_of_a_range_once(spark):
    """No window frame is open at its end: Spark reads such a frame again for every row, the square of a range."""
    rng = np.random.default_rng(4)
    x, at = np.unique(rng.integers(0, 3000, 1500)) / 3.0, rng.integers(-300, 3300, 3000) / 3.0
    boundaries = spark.createDataFrame([(float(a), float(a * a)) for a in x], "boundary double, prediction double")
    asked = spark.createDataFrame([(float(a),) for a in at], "feature double")
    found = regress.interpolate(boundaries, asked)
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    rows = found.collect()
    assert len(rows) == 3000
    assert [r.prediction for r in rows] == pytest.approx(np.interp([r.feature for r in rows], x, x * x).tolist())


def test_isotonic_of_odd_tables(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, None), (2.0, 5.0), (2.0, 7.0)], "feature double, label double")
    assert [tuple(r) for r in regress.isotonic_boundaries(df).collect()] == [(2.0, 6.0)]
    empty = regress.isotonic_boundaries(df.filter("false"))
    assert empty.count() == 0
    assert [r.prediction for r in regress.interpolate(empty, df).collect()] == [None] * 4


def test_isotonic_model_is_saved_and_applied_as_a_table(spark, tmp_path, monkeypatch):
    """A fitted, saved and loaded model never has its boundaries on the driver, and predicts as Spark's own does."""
    from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
    from pyspark.sql.classic.dataframe import DataFrame

    from foldlight.functions.vectors import as_vector
    from foldlight.sources import sinks

    def only_lines(read):
        def checked(df, *args):
            assert df.columns == ["value"], "collected"  # the lines of a model's metadata
            return read(df, *args)

        return checked

    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(a + rng.normal(0, 5))) for i, a in enumerate(rng.integers(0, 300, 2000))]
    df = spark.createDataFrame(rows, "id long, feature double, label double")
    merged = df.groupBy("feature").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("w"))
    own = IsotonicRegression(featuresCol="feature", weightCol="w").fit(merged)
    want = {r.id: r.prediction for r in own.transform(df).collect()}
    sinks.save_model(own, str(tmp_path / "own"))
    with monkeypatch.context() as m:
        for name in ("collect", "toPandas", "toArrow"):
            m.setattr(DataFrame, name, only_lines(getattr(DataFrame, name)))
        model = regress.fit_isotonic(df)
        sinks.save_model(model, str(tmp_path / "table"))
        again = sinks.load_model(IsotonicRegressionModel, str(tmp_path / "table")).setPredictionCol("again")
        both = again.transform(model.transform(df))
    assert both.filter("again = prediction").count() == 2000
    assert {r.id: r.prediction for r in both.collect()} == pytest.approx(want)
    old = sinks.load_model(IsotonicRegressionModel, str(tmp_path / "own"))
    assert {r.id: r.prediction for r in old.transform(df).collect()} == pytest.approx(want)
    vectors = as_vector(df.withColumn("feature", F.array("feature")), "feature")
    found = regress.fit_isotonic(vectors).transform(vectors)
    assert {r.id: r.prediction for r in found.collect()} == pytest.approx(want)
    with pytest.raises(Exception, match="needs a feature and a label"):
        regress.fit_isotonic(df.withColumn("label", F.lit(None).cast("double")))


def test_million_rising_points_stay_a_table(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(*_):
        raise AssertionError("collected")

    rows = spark.range(1_000_000).select(F.col("id").cast("double").alias("feature"), (F.col("id") * 2.0).alias("label"))
    for name in ("collect", "toPandas", "toArrow"):
        monkeypatch.setattr(DataFrame, name, refuse)
    assert regress.isotonic_boundaries(rows).count() == 1_000_000


def factors(spark, matrix):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(matrix)], "id int, features array<float>")


@pytest.mark.parametrize("slice_bytes", [1, 32 << 20])
def test_top_products(spark, slice_bytes):
    rng = np.random.default_rng(11)
    items = rng.normal(size=(6000, 8)) * (0.9985 ** np.arange(6000))[:, None]
    users = rng.normal(size=(150, 8))
    items[17] = items[5] = items[3]  # ties
    u, v = factors(spark, users), factors(spark, rng.permutation(items))
    scores = {r.id: np.array(r.features) for r in u.collect()}
    places = {r.id: np.array(r.features) for r in v.collect()}
    matrix = np.array([places[i] for i in range(6000)])
    scored = 0
    for r in recommend.top_products(u.repartition(3), v.repartition(4), 10, slice_bytes).collect():
        line = matrix @ scores[r.user]
        want = sorted(range(6000), key=lambda i: (-line[i], i))[:10]
        assert [x.item for x in r.recommendations] == want
        assert [x.rating for x in r.recommendations] == pytest.approx(line[want], rel=1e-5)
        scored += r.scored
    assert 0 < scored < 150 * 6000 / (10 if slice_bytes > 1 else 5)


def test_top_products_equal_the_estimator(spark):
    rated = spark.range(3000).select(
        (F.col("id") % 60).cast("int").alias("user"), (F.col("id") * 7 % 97).cast("int").alias("item"), (F.col("id") % 5 + 1.0).alias("rating")
    )
    model = recommend.fit_als(rated, rank=5, iterations=3, reg=0.1)
    want = {r.user: [x.rating for x in r.recommendations] for r in model.recommendForAllUsers(10).collect()}
    got = {r.user: [x.rating for x in r.recommendations] for r in recommend.recommend_for_all_users(model, 10).collect()}
    assert got.keys() == want.keys() and all(got[u] == pytest.approx(want[u], rel=1e-4) for u in want)


def test_few_and_no_items(spark):
    u, v = factors(spark, np.ones((3, 2))), factors(spark, np.ones((2, 2)))
    assert [[x.item for x in r.recommendations] for r in recommend.top_products(u, v, 10).collect()] == [[0, 1]] * 3
    assert recommend.top_products(u, v.filter("false"), 10).count() == 0
    assert recommend.top_products(u.filter("false"), v, 10).count() == 0


def test_topic_tables_follow_plain_steps(spark):
    """One step from the tables' own weights, by NumPy, is the next step; the objective never falls."""
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 4, size=(30, 12))
    rows = [(d, w, int(n)) for (d, w), n in np.ndenumerate(counts)] + [(0, 99, 0), (1, None, None)]
    df = spark.createDataFrame(rows, "doc int, word int, n int")
    k, alpha, eta = 3, 1.5, 1.1
    found = [cluster.fit_topic_tables(df, k, steps, alpha=alpha, eta=eta) for steps in (3, 4)]

    def matrix(table, size, name):
        out = np.zeros((size, k))
        for r in table.collect():
            out[r[name], r.topic] = r.weight
        return out

    word, doc = matrix(found[0].words, 12, "word"), matrix(found[0].docs, 30, "doc")
    phi = (word + eta - 1) / (word.sum(axis=0) + 12 * (eta - 1))
    theta = (doc + alpha - 1) / (doc.sum(axis=1, keepdims=True) + k * (alpha - 1))
    product = theta[:, None, :] * phi[None, :, :]
    share = counts[:, :, None] * product / product.sum(axis=2, keepdims=True)
    assert matrix(found[1].words, 12, "word") == pytest.approx(share.sum(axis=0))
    assert matrix(found[1].docs, 30, "doc") == pytest.approx(share.sum(axis=1))
    value = (counts * np.log(product.sum(axis=2))).sum() + (eta - 1) * np.log(phi).sum() + (alpha - 1) * np.log(theta).sum()
    assert found[0].objective[-1] == pytest.approx(value) == pytest.approx(found[1].objective[3])
    assert all(b >= a - 1e-9 * abs(a) for a, b in zip(found[1].objective, found[1].objective[1:], strict=False))


def test_topic_tables_of_nothing(spark):
    found = cluster.fit_topic_tables(spark.createDataFrame([(1, 1, 0)], "doc int, word int, n int"), 2, 3)
    assert found.words.count() == 0 and found.docs.count() == 0 and found.objective == []


def holds(own, pattern):
    at = iter(own)
    return all(any(set(p) <= set(step) for step in at) for p in pattern)


@pytest.mark.parametrize("support, longest", [(0.5, 4), (0.3, 3), (1.0, 5)])
def test_sequences_by_lists(spark, support, longest):
    days = [["ab", "c", "a", "bc"], ["ab", "bc", "ac"], ["a", "c", "abc"], ["c", "b", "ab", "a"], ["abc", "abc"], ["b"]]
    rows = [(u, d, t) for u, own in enumerate(days) for d, step in enumerate(own) for t in step]
    df = spark.createDataFrame(rows + rows[:7], "user long, day int, kind string")
    steps = ["a", "b", "c", "ab", "ac", "bc", "abc"]
    want = {}
    for n in range(1, longest + 1):
        for pattern in itertools.product(steps, repeat=n):
            freq = sum(holds(own, pattern) for own in days)
            if sum(map(len, pattern)) <= longest and freq >= support * len(days):
                want[" > ".join("+".join(p) for p in pattern)] = freq
    got = sequences.frequent_sequences_by_lists(df, ["user"], "day", "kind", support, longest).collect()
    assert {" > ".join("+".join(s) for s in r["sequence"]): r["freq"] for r in got} == want
    assert len(got) == len(want)


def test_sequences_by_lists_of_odd_tables(spark):
    shape = "a string, b string, owner int, step date, item int"
    day = [date(2024, 1, d) for d in (1, 2, 3)]
    rows = [
        (None, "x", 1, day[0], 7), (None, "x", 1, day[1], 8), (None, "x", 2, day[1], 7),  # one sequence with a null in its key
        ("p", "x", 3, day[0], 7), ("p", "x", 3, day[2], 8),
        ("q", "x", 4, None, 7), ("q", "x", 4, day[1], None),  # holds nothing, counts
        ("r", None, 5, day[0], 8), ("r", None, 5, None, 8),
    ]
    mine = lambda df: {
        str(r["sequence"]): r["freq"]
        for r in sequences.frequent_sequences_by_lists(df, ["a", "b"], "step", "item", 0.5).collect()
    }
    assert mine(spark.createDataFrame(rows, shape)) == {"[[7]]": 2, "[[8]]": 3, "[[7], [8]]": 2}
    assert mine(spark.createDataFrame([], shape)) == {}
    assert mine(spark.createDataFrame([("a", "b", 1, None, None)], shape)) == {}


def test_sequences_by_lists_move_few_rows(spark, monkeypatch):
    """The look-up is made once, and of the longest prefixes, the most by far, no row is written."""
    rng = Random(7)
    days = [["".join(k for k in "abc" if rng.random() < 0.7) for _ in range(14)] for _ in range(12)]
    df = spark.createDataFrame(
        [(u, d, t) for u, own in enumerate(days) for d, step in enumerate(own) for t in step], "user long, day int, kind string"
    )
    written = {}
    write = sequences.materialize

    def keep(df, name):
        written.setdefault(name, []).append(write(df, name))
        return written[name][-1]

    monkeypatch.setattr(sequences, "materialize", keep)
    got = sequences.frequent_sequences_by_lists(df, ["user"], "day", "kind", 0.8).collect()
    items = lambda r: sum(map(len, r["sequence"]))
    of_four = sum(r["freq"] for r in got if items(r) == 4)
    shorter = sum(r["freq"] for r in got if items(r) < 4)
    assert len(written["marks"]) == 1
    rows = {name: sum(t.count() for t in tables) for name, tables in written.items()}
    assert of_four > 2_000 and shorter < 0.5 * of_four
    # a prefix meets itemsets of at most three sizes, in one row each
    assert rows["met"] <= 3 * shorter and max(rows.values()) < of_four


@pytest.mark.parametrize("slots", [1, 2])
def test_sequences_by_lists_in_slices(spark, monkeypatch, slots):
    """Itemsets whose next steps lie in several rows, and joins that sort, give the same patterns."""
    rng = Random(11)
    rows = [(u if u else None, d, rng.choice("abcde")) for u in range(9) for d in range(8) for _ in range(4)]
    df = spark.createDataFrame(rows, "user long, day int, kind string")
    mine = lambda: sorted(
        (str(r["sequence"]), r["freq"])
        for r in sequences.frequent_sequences_by_lists(df, ["user"], "day", "kind", 0.6, 4).collect()
    )
    whole = mine()
    monkeypatch.setattr(sequences, "SLOTS", slots)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        assert mine() == whole
    finally:
        spark.conf.set(name, before)
    lists = {}
    for u, d, t in rows:
        lists.setdefault(u, {}).setdefault(d, set()).add(t)
    own = [[day[d] for d in sorted(day)] for day in lists.values()]
    steps = [c for k in range(1, 5) for c in itertools.combinations("abcde", k)]
    want = [(list(c),) for c in steps]
    want += [(list(x), list(y)) for x in steps for y in steps if len(x) + len(y) <= 4]
    freqs = {str(list(p)): sum(holds(o, p) for o in own) for p in want}
    assert {p: n for p, n in whole if p in freqs} == {p: n for p, n in freqs.items() if n >= 6}
    assert len(whole) > len(want) // 4 and any(p not in freqs for p, _ in whole)


def test_next_steps_of_many_lists(spark):
    """Lists in slots of one key answer like lists of their own, also across ranges."""
    rng = Random(5)
    listed = {(o, n): sorted(rng.sample(range(3_000), 700)) for o in ("hot", "warm") for n in range(3)}
    listed |= {(f"u{u}", n): sorted(rng.sample(range(40), 4)) for u in range(30) for n in (0, 2)}
    steps = spark.createDataFrame(
        [(o, n, s) for (o, n), own in listed.items() for s in own], "owner string, slot int, step int"
    )
    asked = sorted({(o, rng.randrange(-1, max(own) + 2)) for (o, _), own in listed.items() for _ in range(40)})
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        got = sequences.next_steps(spark.createDataFrame(asked, "owner string, after int"), steps, ["owner"], 3).collect()
    finally:
        spark.conf.set(name, before)
    first = lambda own, after: min((s for s in own if s > after), default=None)
    want = {(o, after): [first(listed.get((o, n), []), after) for n in range(3)] for o, after in asked}
    assert {(r["owner"], r["after"]): r["next"] for r in got} == want and len(got) == len(want)


def test_next_steps_of_a_hot_owner(spark, monkeypatch):
    """A list that spans many ranges gives the same steps, and no probe meets more than its range."""
    rng = Random(3)
    listed = {("hot", "a"): sorted(rng.sample(range(9_000), 4_000))}
    listed |= {(f"u{n}", k): sorted(rng.sample(range(60), 5)) for n in range(40) for k in "ab"}
    probes = [(o, [k], rng.randrange(-1, max(steps) + 2)) for (o, k), steps in listed.items() for _ in range(30)]
    probes += [("hot", ["a"], listed["hot", "a"][-1]), ("nobody", ["a"], 4), ("hot", ["b"], 4)]
    steps = spark.createDataFrame(
        [(o, [k], s) for (o, k), own in listed.items() for s in own], "owner string, items array<string>, step int"
    )
    asked = spark.createDataFrame(probes, "owner string, items array<string>, after int")
    cut = []
    write = sequences.materialize

    def keep(df, name):
        cut.append(write(df, name))
        return cut[-1]

    monkeypatch.setattr(sequences, "materialize", keep)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        got = sequences.next_steps(asked, steps).collect()
        per_range = cut[0].filter("owner = 'hot'").groupBy("_part").count().collect()
    finally:
        spark.conf.set(name, before)
    want = {
        (o, k[0], after): min((s for s in listed.get((o, k[0]), []) if s > after), default=None)
        for o, k, after in probes
    }
    assert {(r["owner"], r["items"][0], r["after"]): r["next"] for r in got} == want and len(got) == len(want)
    assert len(per_range) > 4 and max(r["count"] for r in per_range) < 2_000


def test_draws_are_poisson_and_follow_the_key(spark):
    rows = spark.range(20_000).select("id", forests.draws(5, ["id"]).alias("n"), forests.draws(6, ["id"]).alias("m"))
    got = rows.agg(F.avg("n"), F.variance("n"), F.corr("n", "m"), F.avg((F.col("n") == 0).cast("int"))).head()
    assert got[0] == pytest.approx(1, abs=0.03) and got[1] == pytest.approx(1, abs=0.05)
    assert abs(got[2]) < 0.03 and got[3] == pytest.approx(np.exp(-1), abs=0.015)


def noisy_rows(spark, n=400):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 3))
    y = np.round(x[:, 0] * 2 + (x[:, 1] > 0) * 3 + rng.normal(size=n), 3)
    rows = [(i if i else None, float(v), [float(c) for c in r]) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id int, label double, features array<double>")


def test_hashed_forest_is_the_same_however_rows_lie(spark):
    df = noisy_rows(spark)
    found = []
    for rows in (df.coalesce(1), df.repartition(9, "label")):
        forest = forests.fit_hashed_forest_regressor(rows, ["id"], 3, 4)
        found.append({r["label"]: r["prediction"] for r in forest.transform(df).collect()})
        assert "_tree_0" not in forest.transform(df).columns
    assert found[0].keys() == found[1].keys()
    assert all(found[1][k] == pytest.approx(v) for k, v in found[0].items())
    trees = [m.toDebugString for m in forest.trees]
    assert len(set(trees)) == 3
    for t, tree in enumerate(forest.trees):
        leaves = {}
        for r in tree.transform(features.as_vector(forest.drawn(df, t))).collect():
            leaves.setdefault(r["prediction"], []).extend([r["label"]] * r["_draws"])
        assert len(leaves) > 4
        assert all(np.mean(own) == pytest.approx(leaf) for leaf, own in leaves.items())


def test_hashed_forest_of_classes(spark):
    """A class of one row, which some trees never draw, is known to all."""
    df = noisy_rows(spark).withColumn("label", F.when(F.col("id") == 7, 3.0).otherwise((F.col("label") > 1).cast("double")))
    forest = forests.fit_hashed_forest_classifier(df, ["id"], 4, 3)
    scored = forest.transform(df).collect()
    assert all(len(r["probability"]) == 4 and sum(r["probability"]) == pytest.approx(1) for r in scored)
    assert np.mean([r["prediction"] == r["label"] for r in scored]) > 0.8
    assert all(r["prediction"] == max(range(4), key=lambda c: (r["probability"][c], -c)) for r in scored)


def test_tree_rows_are_dealt_into_parts_that_do_not_grow(spark, monkeypatch):
    """A part that trees keep between passes has a bounded number of rows, however few parts the input has."""
    from foldlight import session

    rows = spark.range(0, 2000, 1, 1).select(
        (F.col("id") % 50).cast("double").alias("label"), F.array((F.col("id") % 50).cast("double")).alias("features")
    )
    assert session.spread(rows, 2000).rdd.getNumPartitions() == 1
    parts = session.spread(rows, 300)
    assert parts.rdd.getNumPartitions() == 7 and parts.count() == 2000
    dealt = []

    def counted(df):
        dealt.append(df.columns)
        return session.spread(df, 300)

    monkeypatch.setattr(regress, "spread", counted)
    for fit in (regress.fit_boosted_trees_regressor, regress.fit_decision_tree_regressor, regress.fit_random_forest_regressor):
        assert regress.predict(fit(rows), rows).count() == 2000
    assert dealt == [["features", "label"]] * 3


def test_boosting_goes_on_after_the_first_rounds(spark):
    """A call without a number of rounds has those of Spark's estimator; they lower the error."""
    from pyspark.ml.regression import GBTRegressor

    x = F.col("id").cast("double")
    rows = spark.range(0, 400, 1, 2).select((F.sin(x / 9) * 5 + x / 50).alias("label"), F.array(x, x % 7).alias("features"))
    whole = regress.fit_boosted_trees_regressor(rows, depth=2)
    assert len(whole.trees) == GBTRegressor().getMaxIter() == 20
    few = regress.fit_boosted_trees_regressor(rows, rounds=3, depth=2)
    assert len(few.trees) == 3

    def squares(model):
        found = regress.predict(model, rows)
        return found.agg(F.sum((F.col("prediction") - F.col("label")) ** 2).alias("s")).first().s

    assert squares(whole) < 0.9 * squares(few)


def test_topic_steps_write_no_row_per_word_of_a_document(spark, monkeypatch):
    """Only the counts themselves are written at that size, once; each step writes words and documents."""
    written = []
    real = cluster.materialize

    def noted(df, name):
        written.append(name)
        return real(df, name)

    monkeypatch.setattr(cluster, "materialize", noted)
    counts = spark.createDataFrame([(d, w, float(1 + (d * w) % 3)) for d in range(9) for w in range(5)], "doc long, word int, n double")
    found = cluster.fit_topic_tables(counts, 2, iterations=3)
    assert written == ["counts"] + ["words", "docs"] * 4
    assert len(found.objective) == 4 and found.objective == sorted(found.objective)
    want = {r.word: r.n for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    assert {r.word: r.n for r in found.words.groupBy("word").agg(F.sum("weight").alias("n")).collect()} == pytest.approx(want)


def test_segments_read_together_are_aligned_as_one_by_one(monkeypatch):
    import public_tokenizers

    from foldlight.llm.token_alignment import Aligner

    both = Aligner(*(public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")))
    words = [" unwhtsch", " Ciónaé", " é", " ¨", " ª½", " a", " x9z", " $$$", " (9)", " Ünïß.###", ",", ".\nThe", " 日本", " \n", " ĳ ſ"]
    alone = dict(zip(words, both.align(words), strict=True))
    assert dict(both.aligned(words)) == alone
    calls = []
    real = both.align
    monkeypatch.setattr(both, "align", lambda part: calls.append(len(part)) or real(part))
    plain = [f" w{i}öst" for i in range(500)]
    assert dict(both.aligned(plain)) == dict(zip(plain, real(plain), strict=True)) and not calls
