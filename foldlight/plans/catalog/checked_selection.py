"""Pipelines, scores, grid search and data-set comparison on models with a closed form."""

from __future__ import annotations

from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as P

from foldlight.functions.vectors import as_vector
from foldlight.operators import classify, features
from foldlight.plans import cross_validation
from foldlight.plans.catalog.registry import (
    FOLD_SEED,
    LINE_KEY,
    SQL_FEATURES,
    SQL_LABEL,
    line_features,
    query,
    rounded,
    sql_hash,
)
from foldlight.plans.catalog.scores import MACRO, PER_CLASS
from foldlight.plans.catalog.transforms import SQL_PCA, two_features
from foldlight.sources.readers import table

FOLDS = 10


def bayes_sql(
    columns: tuple[str, ...], smoothing: float = 1.0, classes: int = 3, label: str = SQL_LABEL
) -> str:
    """CTEs up to ``ruled`` (fold, label, prediction) and ``margins`` (fold, label, m0, m1, ...).

    Model ``fold`` is fitted on the other folds; fold -1 is fitted on, and scores, all rows.
    """
    n = range(len(columns))
    k = range(classes)
    total = " + ".join(f"f{i}" for i in n)
    best = " ".join(
        f"WHEN {' AND '.join(f'm{c} >= m{o}' for o in k if o != c)} THEN {float(c)}::DOUBLE"
        for c in k
    )
    return f"""
x AS (
  SELECT CAST({sql_hash(FOLD_SEED, *LINE_KEY)} % {FOLDS} AS INT) AS fold, {label} AS label,
    l_linenumber, {', '.join(f'{c} AS f{i}' for i, c in enumerate(columns))}
  FROM lineitem),
per_fold AS (
  SELECT fold, label, count(*) AS n, {', '.join(f'sum(f{i}) AS f{i}' for i in n)} FROM x GROUP BY ALL),
training AS (
  SELECT k.fold, label, sum(n) AS n, {', '.join(f'sum(p.f{i}) AS f{i}' for i in n)}
  FROM (SELECT DISTINCT fold FROM x UNION ALL SELECT -1) k JOIN per_fold p ON p.fold <> k.fold GROUP BY ALL),
weights AS (
  SELECT fold, label, ln(n + {smoothing}) - ln(sum(n) OVER f + count(*) OVER f * {smoothing}) AS prior,
    {', '.join(f'ln(f{i} + {smoothing}) - ln({total} + {len(columns)} * {smoothing}) AS w{i}' for i in n)}
  FROM training WINDOW f AS (PARTITION BY fold)),
wide AS (
  SELECT fold, {', '.join(f'max({c}) FILTER (label = {j}) AS {c}_{j}' for j in k for c in ('prior', *[f'w{i}' for i in n]))}
  FROM weights GROUP BY fold),
margins AS (
  SELECT wide.fold, label, l_linenumber,
    {', '.join(f'prior_{j} + ' + ' + '.join(f'f{i} * w{i}_{j}' for i in n) + f' AS m{j}' for j in k)}
  FROM x JOIN wide ON wide.fold = x.fold OR wide.fold = -1),
ruled AS (SELECT fold, label, CASE {best} END AS prediction FROM margins)"""


@query(
    "t4_pipeline_bayes",
    f"""WITH {bayes_sql(SQL_FEATURES)}, names(c, name) AS (VALUES (0, 'A'), (1, 'N'), (2, 'R'))
    SELECT l.name AS label, p.name AS predicted_label, count(*) AS n
    FROM ruled JOIN names l ON l.c = label JOIN names p ON p.c = prediction
    WHERE fold = -1 GROUP BY ALL""",
)
def t4_pipeline_bayes(spark, folder):
    """Label indexer, feature indexer, classifier and label restorer in one pipeline."""
    flag = (
        P.when(P.col("label") == 0, "A").when(P.col("label") == 1, "N").otherwise("R")
    )
    rows = as_vector(line_features(spark, folder)).withColumn("label", flag)
    labels, _ = features.index_labels(rows)
    indexer, _ = features.index_features(rows, 4)
    bayes = NaiveBayes(labelCol="indexed_label", featuresCol="indexed_features")
    stages = [labels, indexer, bayes, features.label_restorer(labels.labels)]
    model = features.build_pipeline(stages).fit(rows)
    return model.transform(rows).groupBy("label", "predicted_label").agg(
        P.count(P.lit(1)).alias("n")
    )


@query(
    "t10_reduce_two_features",
    f"""WITH {SQL_PCA}
    SELECT l_linenumber, round(avg(s * (x * l_quantity + y * l_extendedprice / 2000.0)), 5) + 0.0 AS first
    FROM lineitem, signed WHERE component = 0 GROUP BY 1""",
)
def t10_reduce_two_features(spark, folder):
    reduced = features.reduce_features(two_features(spark, folder), 1)
    means = reduced.groupBy("l_linenumber").agg(P.avg(P.col("features")[0]).alias("first"))
    return means.select("l_linenumber", *rounded(5, "first"))


OPEN = "CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


@query(
    "m8_score_bayes",
    f"""WITH {bayes_sql(SQL_FEATURES, classes=2, label=OPEN)}
    SELECT l_linenumber, label, count(*) AS n, round(avg(1 / (1 + exp(m0 - m1))), 9) AS score
    FROM margins WHERE fold = -1 GROUP BY ALL""",
)
def m8_score_bayes(spark, folder):
    """Probability of class 1 for every row."""
    status = table(spark, folder, "lineitem").select(
        "l_linenumber",
        (P.col("l_linestatus") == "O").cast("double").alias("label"),
        P.array(
            P.col("l_quantity"),
            P.col("l_extendedprice") / 1000.0,
            P.col("l_discount"),
            P.col("l_tax"),
        ).alias("features"),
    )
    scored = classify.score(classify.fit_naive_bayes(status), status)
    means = scored.groupBy("l_linenumber", "label").agg(
        P.count(P.lit(1)).alias("n"), P.avg("score").alias("score")
    )
    return means.select("l_linenumber", "label", "n", *rounded(9, "score"))


SMOOTHINGS = (0.5, 1.0, 50000.0)


@query(
    "n2_grid_search_bayes",
    " UNION ALL ".join(
        f"""SELECT {s}::DOUBLE AS smoothing, round(avg(a), 9) AS mean_accuracy FROM (
          WITH {bayes_sql(SQL_FEATURES, s)}
          SELECT avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a
          FROM ruled WHERE fold >= 0 GROUP BY fold)"""
        for s in SMOOTHINGS
    ),
)
def n2_grid_search_bayes(spark, folder):
    _, settings = cross_validation.grid_search(
        NaiveBayes(),
        {"smoothing": list(SMOOTHINGS)},
        line_features(spark, folder),
        k=FOLDS,
        seed=FOLD_SEED,
        key=LINE_KEY,
    )
    return settings.select("smoothing", *rounded(9, "mean_accuracy"))


FORMS = {"all": SQL_FEATURES, "first_two": SQL_FEATURES[:2]}
MEANS = ("f_measure", "precision", "recall", "accuracy")


@query(
    "n6_compare_data_sets_bayes",
    " UNION ALL ".join(
        f"""SELECT * FROM (WITH {bayes_sql(columns).replace('ruled AS (', 'every AS (')},
          ruled AS (SELECT * FROM every WHERE fold >= 0), {PER_CLASS}, {MACRO}
          SELECT '{name}' AS data_set, count(*) AS folds, {', '.join(f'round(avg({m}), 9) AS {m}' for m in MEANS)}
          FROM macro)"""
        for name, columns in FORMS.items()
    ),
)
def n6_compare_data_sets_bayes(spark, folder):
    """The same model on all features and on the first two."""
    rows = line_features(spark, folder)
    forms = {"all": rows, "first_two": rows.withColumn("features", P.slice("features", 1, 2))}
    means = cross_validation.compare_data_sets(
        NaiveBayes(), forms, k=FOLDS, seed=FOLD_SEED, key=LINE_KEY, classes=[0.0, 1.0, 2.0]
    )
    return means.select("data_set", "folds", *rounded(9, *MEANS))


# A logistic fit with an intercept and group indicators has the group's share as its probability.
SQL_GROUPS = """
g AS (
  SELECT l_linenumber, count(*) AS n, count(*) FILTER (l_extendedprice / l_quantity > 2000 + 100 * l_linenumber) AS pos
  FROM lineitem GROUP BY 1)"""


def group_rows(spark, folder):
    """Label: price per unit above a bound; features: indicators of the line numbers 2-7."""
    dear = P.col("l_extendedprice") / P.col("l_quantity") > 2000 + 100 * P.col("l_linenumber")
    return as_vector(
        table(spark, folder, "lineitem").select(
            "l_linenumber",
            dear.cast("double").alias("label"),
            P.array(
                *[(P.col("l_linenumber") == i).cast("double") for i in range(2, 8)]
            ).alias("features"),
        )
    )


def group_fit(rows):
    return classify.fit_logistic_regression(rows, iterations=100, tol=1e-9)


@query(
    "e10_logistic_summary_groups",
    f"""WITH {SQL_GROUPS}, s AS (
      SELECT pos / n AS share, sum(n) OVER w AS n, sum(pos) OVER w AS tp, sum(pos) OVER () AS p
      FROM g WINDOW w AS (ORDER BY pos / n DESC))
    SELECT round(share, 4) AS threshold, round(tp / n, 8) AS precision, round(2 * tp / (n + p), 8) AS f_measure
    FROM s""",
)
def e10_logistic_summary_groups(spark, folder):
    rows = group_rows(spark, folder)
    _, _, f_measure, precision = classify.logistic_summary(group_fit(rows), rows)
    joined = f_measure.join(precision, "threshold")
    return joined.select(
        P.round("threshold", 4).alias("threshold"),
        P.round("precision", 8).alias("precision"),
        P.round(P.col("F-Measure"), 8).alias("f_measure"),
    )


@query(
    "m3_first_and_last_loss",
    f"""WITH {SQL_GROUPS}, t AS (SELECT sum(pos) / sum(n) AS share FROM g)
    SELECT (SELECT round(-(share * ln(share) + (1 - share) * ln(1 - share)), 6) FROM t) AS first_loss,
      round(-sum(pos * ln(pos / n) + (n - pos) * ln(1 - pos / n)) / sum(n), 6) AS last_loss FROM g""",
)
def m3_first_and_last_loss(spark, folder):
    """The loss starts at the entropy of the label and ends at its entropy within the groups."""
    rows = group_rows(spark, folder)
    history = classify.objective_history(group_fit(rows), rows)
    return history.agg(
        P.round(P.min_by("loss", "step"), 6).alias("first_loss"),
        P.round(P.max_by("loss", "step"), 6).alias("last_loss"),
    )


@query(
    "m2_logistic_group_shares",
    f"WITH {SQL_GROUPS} SELECT l_linenumber, n, round(pos / n, 4) AS probability FROM g",
)
def m2_logistic_group_shares(spark, folder):
    rows = group_rows(spark, folder)
    scored = classify.score(group_fit(rows), rows)
    return scored.groupBy("l_linenumber").agg(
        P.count(P.lit(1)).alias("n"), P.round(P.avg("score"), 4).alias("probability")
    )

