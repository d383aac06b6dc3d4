"""Fitted models whose result, or an exact property of it, can be written in SQL."""

from __future__ import annotations

from pyspark.ml.classification import NaiveBayes
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as P

from foldlight.functions.vectors import as_vector, points, squared_distance
from foldlight.operators import classify, cluster, recommend, regress
from foldlight.plans import cross_validation
from foldlight.plans.catalog.registry import (
    FOLD_SEED,
    LINE_KEY,
    SQL_FEATURES,
    SQL_LABEL,
    embedding_rows,
    line_features,
    query,
    ratings,
    rounded,
    sql_hash,
    sql_rounded,
)
from foldlight.plans.catalog.scores import MACRO, PER_CLASS
from foldlight.sources.readers import table

# -- naive Bayes -------------------------------------------------------------------

NB_FOLDS = 10
F = [f"f{i}" for i in range(4)]
SQL_NB = f"""
x AS (
  SELECT CAST({sql_hash(FOLD_SEED, *LINE_KEY)} % {NB_FOLDS} AS INT) AS fold, {SQL_LABEL} AS label,
    {', '.join(f'{f} AS f{i}' for i, f in enumerate(SQL_FEATURES))}
  FROM lineitem),
per_fold AS (
  SELECT fold, label, count(*) AS n, {', '.join(f'sum({f}) AS {f}' for f in F)}
  FROM x GROUP BY ALL),
training AS (
  SELECT k.fold, label, sum(n) AS n, {', '.join(f'sum(p.{f}) AS {f}' for f in F)}
  FROM (SELECT DISTINCT fold FROM x) k JOIN per_fold p ON p.fold <> k.fold GROUP BY ALL),
weights AS (
  SELECT fold, label, ln(n + 1) - ln(sum(n) OVER (PARTITION BY fold) + count(*) OVER (PARTITION BY fold)) AS prior,
    {', '.join(f'ln({f} + 1) - ln(f0 + f1 + f2 + f3 + 4) AS w{i}' for i, f in enumerate(F))}
  FROM training),
wide AS (
  SELECT fold, {', '.join(f'max({c}) FILTER (label = {k}) AS {c}_{k}' for k in range(3) for c in ('prior', 'w0', 'w1', 'w2', 'w3'))}
  FROM weights GROUP BY fold),
margins AS (
  SELECT x.fold, label, {', '.join(f'prior_{k} + ' + ' + '.join(f'f{i} * w{i}_{k}' for i in range(4)) + f' AS m{k}' for k in range(3))}
  FROM x JOIN wide ON wide.fold = x.fold),
ruled AS (
  SELECT fold, label, CASE WHEN m0 >= m1 AND m0 >= m2 THEN 0.0::DOUBLE
    WHEN m1 >= m2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS prediction FROM margins)"""
SCORES = ("f_measure", "precision", "recall", "accuracy")


def bayes_folds(spark, folder):
    return cross_validation.cross_validate(
        NaiveBayes(smoothing=1.0),
        line_features(spark, folder),
        k=NB_FOLDS,
        seed=FOLD_SEED,
        key=LINE_KEY,
        classes=[0.0, 1.0, 2.0],
        keep=(),
    )


@query(
    "n1_cross_validate_naive_bayes",
    f"""WITH {SQL_NB}, {PER_CLASS}, {MACRO}, c AS (SELECT fold, count(*) AS n FROM ruled GROUP BY 1)
    SELECT c.fold, n AS validation_rows, CAST(sum(n) OVER () - n AS BIGINT) AS training_rows,
      {sql_rounded(8, *SCORES)} FROM macro JOIN c ON c.fold = macro.fold""",
)
def n1_cross_validate_naive_bayes(spark, folder):
    _, per_fold, _ = bayes_folds(spark, folder)
    return per_fold.select("fold", "validation_rows", "training_rows", *rounded(8, *SCORES))


@query(
    "n1_fold_predictions",
    f"""WITH {SQL_NB} SELECT fold, label, prediction, count(*) AS n FROM ruled GROUP BY ALL""",
)
def n1_fold_predictions(spark, folder):
    scored, _, _ = bayes_folds(spark, folder)
    return scored.groupBy("fold", "label", "prediction").agg(P.count(P.lit(1)).alias("n"))


@query(
    "m5_fit_naive_bayes",
    f"""WITH x AS (SELECT {SQL_LABEL} AS label, {', '.join(f'{f} AS f{i}' for i, f in enumerate(SQL_FEATURES))} FROM lineitem),
    s AS (SELECT label, count(*) AS n, {', '.join(f'sum({f}) AS {f}' for f in F)} FROM x GROUP BY 1)
    SELECT label, round(ln(n + 1) - ln(sum(n) OVER () + 3), 8) AS prior,
      {', '.join(f'round(ln({f} + 1) - ln(f0 + f1 + f2 + f3 + 4), 8) AS w{i}' for i, f in enumerate(F))} FROM s""",
)
def m5_fit_naive_bayes(spark, folder):
    model = classify.fit_naive_bayes(line_features(spark, folder))
    theta = model.theta.toArray()
    rows = [
        (float(c), float(model.pi[c]), *[float(v) for v in theta[c]]) for c in range(len(theta))
    ]
    names = ["prior", *[f"w{i}" for i in range(theta.shape[1])]]
    weights = spark.createDataFrame(rows, ["label", *names])
    return weights.select("label", *rounded(8, *names))


# -- least squares and isotonic regression --------------------------------------------


def prices(spark, folder):
    return table(spark, folder, "lineitem").select(
        (P.col("l_extendedprice") / 1000.0).alias("label"),
        P.array("l_quantity").alias("features"),
        "l_linenumber",
    )


@query(
    "r1_fit_linear_regression",
    """WITH x AS (SELECT l_quantity AS x, l_extendedprice / 1000.0::DOUBLE AS y FROM lineitem)
    SELECT round(regr_slope(y, x), 7) AS slope, round(regr_intercept(y, x), 6) AS intercept,
      round(sum(x * y) / sum(x * x), 7) AS slope_through_zero FROM x""",
)
def r1_fit_linear_regression(spark, folder):
    rows = prices(spark, folder)
    free = regress.fit_linear_regression(rows, fit_intercept=True)
    zero = regress.fit_linear_regression(rows)
    line = [(float(free.coefficients[0]), float(free.intercept), float(zero.coefficients[0]))]
    table_ = spark.createDataFrame(
        line, "slope double, intercept double, slope_through_zero double"
    )
    return table_.select(
        *rounded(7, "slope"), *rounded(6, "intercept"), *rounded(7, "slope_through_zero")
    )


@query(
    "r6_predict",
    """WITH x AS (SELECT l_linenumber, l_quantity AS x, l_extendedprice / 1000.0::DOUBLE AS y FROM lineitem),
    m AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM x)
    SELECT l_linenumber, count(*) AS n, round(sum(a * x + b), 4) AS predicted,
      round(avg((a * x + b - y) ** 2), 5) AS mse FROM x, m GROUP BY 1""",
)
def r6_predict(spark, folder):
    rows = prices(spark, folder)
    model = regress.fit_linear_regression(rows, fit_intercept=True)
    predicted = regress.predict(model, rows, keep=("l_linenumber",))
    gap = P.col("prediction") - P.col("label")
    return predicted.groupBy("l_linenumber").agg(
        P.count(P.lit(1)).alias("n"),
        P.round(P.sum("prediction"), 4).alias("predicted"),
        P.round(P.avg(gap * gap), 5).alias("mse"),
    )


@query(
    "r5_fit_isotonic",
    """WITH p AS (SELECT l_quantity AS x, sum(l_extendedprice / 1000.0::DOUBLE) AS s, count(*) AS w FROM lineitem GROUP BY 1),
    blocks AS (SELECT a.x AS lo, b.x AS hi, sum(p.s) / sum(p.w) AS m
      FROM p a JOIN p b ON a.x <= b.x JOIN p ON p.x BETWEEN a.x AND b.x GROUP BY ALL),
    lows AS (SELECT p.x, lo, min(m) AS m FROM p JOIN blocks ON lo <= p.x AND p.x <= hi GROUP BY ALL)
    SELECT x AS feature, round(max(m), 6) AS prediction FROM lows GROUP BY x""",
)
def r5_fit_isotonic(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        P.col("l_quantity").alias("feature"), (P.col("l_extendedprice") / 1000.0).alias("label")
    )
    points = rows.select("feature").distinct()
    boundaries = regress.isotonic_boundaries(rows)
    return regress.interpolate(boundaries, points).select("feature", *rounded(6, "prediction"))


# -- trees: the best single split over all rows -------------------------------------------

SPLIT_FEATURES = ("l_quantity", "l_linenumber", "l_discount")


def _split_sql(target: str, gain: str, leaf: str) -> str:
    """Best split by ``gain`` of the left and right totals, then the leaf value of each row.

    ``target`` gives the totals per feature value as columns n, s0, s1, ...
    """
    values = " UNION ALL ".join(
        f"SELECT {i} AS f, CAST({c} AS DOUBLE) AS v, {target} FROM lineitem GROUP BY {c}"
        for i, c in enumerate(SPLIT_FEATURES)
    )
    return f"""
    by_value AS ({values}),
    left_side AS (
      SELECT f, v, sum(n) OVER w AS n, sum(s0) OVER w AS s0, sum(s1) OVER w AS s1, sum(s2) OVER w AS s2,
        sum(n) OVER t AS nt, sum(s0) OVER t AS t0, sum(s1) OVER t AS t1, sum(s2) OVER t AS t2
      FROM by_value WINDOW w AS (PARTITION BY f ORDER BY v), t AS (PARTITION BY f)),
    sides AS (
      SELECT f, v, n, s0, s1, s2, nt - n AS m, t0 - s0 AS r0, t1 - s1 AS r1, t2 - s2 AS r2
      FROM left_side WHERE n < nt),
    best AS (SELECT * FROM sides ORDER BY {gain} DESC LIMIT 1),
    leaves AS (
      SELECT CASE WHEN CASE f WHEN 0 THEN l_quantity WHEN 1 THEN l_linenumber ELSE l_discount END <= v
        THEN {leaf.format(a='s0', b='s1', c='s2', n='n')}
        ELSE {leaf.format(a='r0', b='r1', c='r2', n='m')} END AS value
      FROM lineitem, best)
    SELECT round(value, 8) AS value, count(*) AS n FROM leaves GROUP BY 1"""


GINI = "(s0 ** 2 + s1 ** 2 + s2 ** 2) / n + (r0 ** 2 + r1 ** 2 + r2 ** 2) / m"
VARIANCE = "s0 ** 2 / n + r0 ** 2 / m"
SIZE = "l_quantity * l_linenumber"
CLASS_TOTALS = (
    f"count(*) AS n, count(*) FILTER ({SIZE} < 50) AS s0, "
    f"count(*) FILTER ({SIZE} >= 50 AND {SIZE} < 150) AS s1, count(*) FILTER ({SIZE} >= 150) AS s2"
)
PRICE_TOTALS = (
    "count(*) AS n, sum(l_extendedprice / 1000.0::DOUBLE) AS s0, 0 AS s1, 0 AS s2"
)
SIGN_TOTALS = (
    "count(*) AS n, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END) AS s0, 0 AS s1, 0 AS s2"
)
SQL_CLASS_STUMP = f"WITH {_split_sql(CLASS_TOTALS, GINI, '{b} / {n}')}"
SQL_PRICE_STUMP = f"WITH {_split_sql(PRICE_TOTALS, VARIANCE, '{a} / {n}')}"


def split_rows(spark, folder, label):
    return as_vector(
        table(spark, folder, "lineitem").select(
            label.alias("label"),
            P.array(*[P.col(c).cast("double") for c in SPLIT_FEATURES]).alias("features"),
        )
    )


def leaf_counts(df, value):
    return df.groupBy(P.round(value, 8).alias("value")).agg(P.count(P.lit(1)).alias("n"))


def _class_rows(spark, folder):
    size = P.expr(SIZE)
    return split_rows(spark, folder, P.when(size < 50, 0.0).when(size < 150, 1.0).otherwise(2.0))


def _price_rows(spark, folder):
    return split_rows(spark, folder, P.col("l_extendedprice") / 1000.0)


def _middle():
    """Probability of the second class."""
    return vector_to_array("probability")[1]


@query("m6_best_split_of_tree", SQL_CLASS_STUMP)
def m6_best_split_of_tree(spark, folder):
    rows = _class_rows(spark, folder)
    model = classify.fit_decision_tree_classifier(rows, depth=1, bins=64)
    return leaf_counts(model.transform(rows), _middle())


@query("m1_best_split_of_forest", SQL_CLASS_STUMP)
def m1_best_split_of_forest(spark, folder):
    """Without row and feature sampling all trees of a forest find the same split."""
    rows = _class_rows(spark, folder)
    model = classify.fit_random_forest_classifier(
        rows, trees=3, depth=1, bins=64, bootstrap=False, featureSubsetStrategy="all"
    )
    return leaf_counts(model.transform(rows), _middle())


@query("r2_best_split_of_tree", SQL_PRICE_STUMP)
def r2_best_split_of_tree(spark, folder):
    rows = _price_rows(spark, folder)
    model = regress.fit_decision_tree_regressor(rows, depth=1, bins=64)
    return leaf_counts(model.transform(rows), P.col("prediction"))


@query("r3_best_split_of_forest", SQL_PRICE_STUMP)
def r3_best_split_of_forest(spark, folder):
    rows = _price_rows(spark, folder)
    model = regress.fit_random_forest_regressor(
        rows, trees=3, depth=1, bins=64, bootstrap=False, featureSubsetStrategy="all"
    )
    return leaf_counts(model.transform(rows), P.col("prediction"))


@query("r4_first_boosting_round", SQL_PRICE_STUMP)
def r4_first_boosting_round(spark, folder):
    rows = _price_rows(spark, folder)
    model = regress.fit_boosted_trees_regressor(rows, rounds=1, depth=1, maxBins=64)
    return leaf_counts(model.transform(rows), P.col("prediction"))


@query("m7_first_boosting_round", f"WITH {_split_sql(SIGN_TOTALS, VARIANCE, '{a} / {n}')}")
def m7_first_boosting_round(spark, folder):
    """The first round fits a variance tree to -1 / +1; its leaf means are the margins."""
    rows = split_rows(spark, folder, (P.col("l_linestatus") == "O").cast("double"))
    model = classify.fit_boosted_trees_classifier(rows, rounds=1, depth=1, maxBins=64)
    return leaf_counts(model.transform(rows), vector_to_array("rawPrediction")[1])


# -- logistic regression -----------------------------------------------------------------


@query(
    "m2_logistic_calibration",
    f"SELECT {SQL_LABEL} AS label, count(*) AS rows, CAST(count(*) AS DOUBLE) AS expected FROM lineitem GROUP BY 1",
)
def m2_logistic_calibration(spark, folder):
    """At the unpenalized optimum the predicted class probabilities add up to the class sizes."""
    rows = line_features(spark, folder).select("label", "features")
    model = classify.fit_logistic_regression(
        rows, iterations=200, tol=1e-12, family="multinomial"
    )
    scored = model.transform(as_vector(rows)).select(
        "label", vector_to_array("probability").alias("p")
    )
    sides = scored.select(
        P.posexplode("p").alias("k", "probability"), P.col("label").alias("true_label")
    )
    hit = (P.col("true_label") == P.col("k")).cast("long")
    return sides.groupBy(P.col("k").cast("double").alias("label")).agg(
        P.sum(hit).alias("rows"), P.round(P.sum("probability"), 1).alias("expected")
    )


# -- clusters ------------------------------------------------------------------------------


def class_centres(spark, folder):
    """Mean embedding of each label: labels x 64 numbers."""
    rows = as_vector(embedding_rows(spark, folder))
    means = rows.groupBy("label").agg(Summarizer.mean(P.col("features")).alias("m"))
    return [list(r["m"]) for r in means.orderBy("label").collect()]


SQL_NEAREST = """
e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label AS cluster, i, avg(v) AS m FROM e GROUP BY ALL),
d AS (SELECT vec_id, cluster, sum((v - m) ** 2) AS d FROM e JOIN c ON c.i = e.i GROUP BY ALL),
nearest AS (SELECT vec_id, CAST(arg_min(cluster, d) AS INT) AS cluster, min(d) AS d FROM d GROUP BY 1)"""


@query("c2_assign_clusters", f"WITH {SQL_NEAREST} SELECT vec_id, cluster FROM nearest")
def c2_assign_clusters(spark, folder):
    assigned = cluster.assign_clusters(
        embedding_rows(spark, folder), class_centres(spark, folder)
    )
    return assigned.select("vec_id", "cluster")


@query("c3_within_cluster_cost", f"WITH {SQL_NEAREST} SELECT round(sum(d), 6) AS cost FROM nearest")
def c3_within_cluster_cost(spark, folder):
    cost = cluster.within_cluster_cost(
        embedding_rows(spark, folder), class_centres(spark, folder)
    )
    return cost.select(*rounded(6, "cost"))


SQL_TOTAL = """SELECT round(sum(s), 3) AS total FROM (
  SELECT var_pop(v) * count(*) AS s
  FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
  GROUP BY i)"""


def split_of_squares(model, rows):
    """Cost around the centres plus the spread of the centres; equals the total sum of squares
    about the mean exactly when every centre is the mean of its own rows."""
    centres = cluster.centers(model)
    scored = model.transform(as_vector(rows)).select(
        "prediction", vector_to_array("features").alias("x")
    )
    centre = P.element_at(points(centres), P.col("prediction") + 1)
    summed = scored.select("x", centre.alias("c")).select(
        squared_distance(P.col("x"), P.col("c")).alias("within"),
        P.aggregate("c", P.lit(0.0), lambda s, v: s + v * v).alias("squares"),
        "c",
    )
    # |c - mean|^2 summed over the rows = sum |c|^2 - rows * |mean c|^2
    mean_c = vector_to_array(Summarizer.mean(array_to_vector(P.col("c"))))
    rest = P.aggregate(mean_c, P.lit(0.0), lambda s, v: s + v * v)
    return summed.agg(
        P.round(P.sum("within") + P.sum("squares") - P.count(P.lit(1)) * rest, 3).alias("total")
    )


@query("c1_kmeans_sum_of_squares", SQL_TOTAL)
def c1_kmeans_sum_of_squares(spark, folder):
    rows = embedding_rows(spark, folder).select("features")
    return split_of_squares(cluster.fit_kmeans(rows, 10, iterations=100), rows)


@query("c4_bisecting_sum_of_squares", SQL_TOTAL)
def c4_bisecting_sum_of_squares(spark, folder):
    rows = embedding_rows(spark, folder).select("features")
    return split_of_squares(cluster.fit_bisecting_kmeans(rows, 4, iterations=100), rows)


@query(
    "c5_mixture_moments",
    """SELECT round(avg(l_quantity), 6) AS mean0, round(avg(l_extendedprice / 1000.0::DOUBLE), 6) AS mean1,
      round(var_pop(l_quantity), 4) AS var0, round(var_pop(l_extendedprice / 1000.0::DOUBLE), 4) AS var1,
      round(covar_pop(l_quantity, l_extendedprice / 1000.0::DOUBLE), 4) + 0.0 AS covar FROM lineitem""",
)
def c5_mixture_moments(spark, folder):
    """Each step of the fit keeps the mean and covariance of the data in the whole mixture."""
    rows = table(spark, folder, "lineitem").select(
        P.array(P.col("l_quantity"), P.col("l_extendedprice") / 1000.0).alias("features")
    )
    parts = cluster.mixture_parts(cluster.fit_gaussian_mixture(rows, 2, iterations=10))
    w, m, c = P.col("weight"), P.col("mean"), P.col("covariance")
    sums = parts.agg(
        P.sum(w * m[0]).alias("mean0"),
        P.sum(w * m[1]).alias("mean1"),
        P.sum(w * (c[0][0] + m[0] * m[0])).alias("s00"),
        P.sum(w * (c[1][1] + m[1] * m[1])).alias("s11"),
        P.sum(w * (c[0][1] + m[0] * m[1])).alias("s01"),
    )
    m0, m1 = P.col("mean0"), P.col("mean1")
    moments = sums.select(
        "mean0",
        "mean1",
        (P.col("s00") - m0 * m0).alias("var0"),
        (P.col("s11") - m1 * m1).alias("var1"),
        (P.col("s01") - m0 * m1).alias("covar"),
    )
    return moments.select(*rounded(6, "mean0", "mean1"), *rounded(4, "var0", "var1", "covar"))


# -- topics, graph, recommendation -----------------------------------------------------------

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(spark, folder):
    """Letter counts of each whole document."""
    low = P.lower("text")
    return table(spark, folder, "documents").select(
        "doc_id",
        P.array(
            *[
                (P.length(low) - P.length(P.replace(low, P.lit(c), P.lit("")))).cast("double")
                for c in LETTERS
            ]
        ).alias("features"),
    )


@query(
    "c6_topic_word_totals",
    " UNION ALL ".join(
        f"""SELECT {i} AS word, CAST(3 AS BIGINT) AS topics,
        round(CAST(sum(length(lower(text)) - length(replace(lower(text), '{c}', ''))) AS DOUBLE), 2) AS total
        FROM documents"""
        for i, c in enumerate(LETTERS)
    ),
)
def c6_topic_word_totals(spark, folder):
    """The topic weights of a word add up to its count in all documents."""
    docs = letter_counts(spark, folder)
    weights = cluster.topic_words(cluster.fit_topics(docs, 3, iterations=20), docs)
    return weights.groupBy("word").agg(
        P.count_if(P.col("weight") > 0).alias("topics"),
        P.round(P.sum("weight"), 2).alias("total"),
    )


@query(
    "c6_topic_tables",
    " UNION ALL ".join(
        f"""SELECT 'word' AS kind, {i} AS id,
        round(CAST(sum(length(lower(text)) - length(replace(lower(text), '{c}', ''))) AS DOUBLE), 2) AS total
        FROM documents"""
        for i, c in enumerate(LETTERS)
    )
    + """ UNION ALL SELECT 'step', CAST(i AS INT), 1.0::DOUBLE FROM range(1, 21) t(i)
    UNION ALL SELECT 'documents', 0, CAST(count(*) AS DOUBLE) FROM documents WHERE regexp_matches(lower(text), '[a-z]')""",
)
def c6_topic_tables(spark, folder):
    """Topic weights of each word after 20 steps, steps that do not lower the objective, documents whose weights add up."""
    counts = cluster.word_counts(letter_counts(spark, folder))
    found = cluster.fit_topic_tables(counts, 3, iterations=20)
    words = found.words.groupBy(P.col("word").alias("id")).agg(P.round(P.sum("weight"), 2).alias("total"))
    steps = [
        (i, float(b >= a - 1e-9 * abs(a)))
        for i, (a, b) in enumerate(zip(found.objective, found.objective[1:], strict=False), 1)
    ]
    sums = found.docs.groupBy("doc").agg(P.sum("weight").alias("weight"))
    sizes = counts.groupBy("doc").agg(P.sum("n").alias("n"))
    equal = P.count_if(P.abs(P.col("weight") - P.col("n")) <= 1e-6 * P.col("n")).cast("double")
    right = sums.join(sizes, "doc").agg(P.lit(0).alias("id"), equal.alias("total"))
    steps = spark.createDataFrame(steps, "id int, total double")
    kinds = (("word", words), ("step", steps), ("documents", right))
    parts = [df.select(P.lit(kind).alias("kind"), "id", "total") for kind, df in kinds]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def trade_edges(spark, folder):
    """Quantity sold between supplier and customer nations."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select(
        "c_custkey", P.col("c_nationkey").cast("long").alias("dst")
    )
    suppliers = table(spark, folder, "supplier").select(
        "s_suppkey", P.col("s_nationkey").cast("long").alias("src")
    )
    by_source = (
        lines.join(suppliers, P.col("l_suppkey") == P.col("s_suppkey"))
        .groupBy("l_orderkey", "src")
        .agg(P.sum("l_quantity").alias("q"))
    )
    by_customer = (
        by_source.join(orders, P.col("l_orderkey") == P.col("o_orderkey"))
        .groupBy("o_custkey", "src")
        .agg(P.sum("q").alias("q"))
    )
    return (
        by_customer.join(customers, P.col("o_custkey") == P.col("c_custkey"))
        .groupBy("src", "dst")
        .agg(P.sum("q").alias("weight"))
    )


SQL_NODES = """
WITH edges AS (
  SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey)
SELECT CAST(a AS BIGINT) AS id, CAST(1 AS BIGINT) AS clusters FROM edges
UNION SELECT CAST(b AS BIGINT), 1 FROM edges"""


@query("c7_every_node_once", SQL_NODES)
def c7_every_node_once(spark, folder):
    found = cluster.power_iteration_clusters(trade_edges(spark, folder), 2, 10)
    valid = P.col("cluster").between(0, 1).cast("long")
    return found.groupBy("id").agg(P.sum(valid).alias("clusters"))


def user_item_ratings(spark, folder):
    return ratings(spark, folder).select(P.col("user").cast("int").alias("user"), "item", "rating")


@query(
    "l3_recommend_for_all_users",
    """SELECT DISTINCT CAST(user_id AS INT) AS "user", CAST(10 AS BIGINT) AS items, CAST(10 AS BIGINT) AS ranks
    FROM events""",
)
def l3_recommend_for_all_users(spark, folder):
    """Ten different items for every user, in falling order of rating."""
    model = recommend.fit_als(user_item_ratings(spark, folder), rank=10, iterations=10, reg=0.1)
    recs = recommend.recommend_for_all_users(model, 10)
    ordered = P.forall(
        P.sequence(P.lit(1), P.lit(9)),
        lambda i: P.element_at("recommendations", i)["rating"]
        >= P.element_at("recommendations", i + 1)["rating"],
    )
    long = recs.select("user", ordered.alias("ok"), P.explode("recommendations").alias("r"))
    return long.groupBy("user").agg(
        P.count_distinct("r.item").alias("items"), P.count_if("ok").alias("ranks")
    )


@query(
    "l2_predict_ratings",
    """SELECT count(*) AS pairs, CAST(count(*) AS BIGINT) AS predicted FROM (
      SELECT DISTINCT user_id, props FROM events)""",
)
def l2_predict_ratings(spark, folder):
    rated = user_item_ratings(spark, folder)
    model = recommend.fit_als(rated, rank=10, iterations=10, reg=0.1)
    predicted = recommend.predict_ratings(model, rated)
    return predicted.agg(
        P.count(P.lit(1)).alias("pairs"), P.count("prediction").alias("predicted")
    )


@query(
    "l4_factors",
    """SELECT 'item' AS side, count(DISTINCT props) AS ids, CAST(10 AS BIGINT) AS rank FROM events
    UNION ALL SELECT 'user', count(DISTINCT user_id), 10 FROM events""",
)
def l4_factors(spark, folder):
    model = recommend.fit_als(user_item_ratings(spark, folder), rank=10, iterations=10, reg=0.1)
    sides = [
        factors.agg(
            P.count_distinct("id").alias("ids"), P.max(P.size("features")).cast("long").alias("rank")
        ).select(P.lit(side).alias("side"), "ids", "rank")
        for side, factors in (
            ("user", recommend.user_factors(model)),
            ("item", recommend.item_factors(model)),
        )
    ]
    return sides[0].unionAll(sides[1])
