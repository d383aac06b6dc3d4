"""Class scores of a fixed rule on lineitem, fold by fold, and label-set scores."""

from __future__ import annotations

from pyspark.sql import functions as P

from foldlight.operators import evaluate, reshape
from foldlight.plans.catalog.registry import SQL_RULED, query, rounded, ruled_lines, sql_rounded
from foldlight.sources.readers import table

PER_CLASS = """
cells AS (SELECT fold, label, prediction, count(*) AS n FROM ruled GROUP BY ALL),
names AS (SELECT DISTINCT fold, label AS class FROM cells
          UNION SELECT DISTINCT fold, prediction FROM cells),
per_class AS (
  SELECT names.fold, class,
    CAST(coalesce(sum(n) FILTER (label = class AND prediction = class), 0) AS BIGINT) AS tp,
    CAST(coalesce(sum(n) FILTER (label = class), 0) AS BIGINT) AS true_n,
    CAST(coalesce(sum(n) FILTER (prediction = class), 0) AS BIGINT) AS pred_n,
    CAST(sum(n) AS BIGINT) AS rows
  FROM names JOIN cells ON cells.fold = names.fold GROUP BY ALL),
pr AS (
  SELECT *, CASE WHEN pred_n = 0 THEN 0.0 ELSE tp / pred_n END AS precision,
    CASE WHEN true_n = 0 THEN 0.0 ELSE tp / true_n END AS recall,
    CASE WHEN rows = true_n THEN 0.0 ELSE (pred_n - tp) / (rows - true_n) END AS fpr
  FROM per_class),
scores AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
                 ELSE 2 * precision * recall / (precision + recall) END AS f_measure
  FROM pr)"""
MACRO = """
macro AS (
  SELECT fold, sum(f_measure) / 3 AS f_measure, sum(precision) / 3 AS precision,
         sum(recall) / 3 AS recall, sum(tp) / sum(true_n) AS accuracy
  FROM scores WHERE class IN (0, 1, 2) GROUP BY fold)"""


@query(
    "e1_confusion_matrix",
    f"""WITH {SQL_RULED}, ks(c) AS (VALUES (0.0::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE))
    SELECT f.fold, l.c AS label, p.c AS prediction, count(ruled.label) AS n
    FROM (SELECT DISTINCT fold FROM ruled) f CROSS JOIN ks l CROSS JOIN ks p
    LEFT JOIN ruled ON ruled.fold = f.fold AND ruled.label = l.c AND ruled.prediction = p.c
    GROUP BY ALL""",
)
def e1_confusion_matrix(spark, folder):
    return evaluate.confusion_matrix(ruled_lines(spark, folder), ["fold"], [0.0, 1.0, 2.0, 3.0])


@query(
    "e2_per_class_metrics",
    f"""WITH {SQL_RULED}, {PER_CLASS}
    SELECT fold, class, tp, true_n, pred_n, rows,
      {sql_rounded(9, 'precision', 'recall', 'f_measure', 'fpr')} FROM scores""",
)
def e2_per_class_metrics(spark, folder):
    scores = evaluate.per_class_metrics(ruled_lines(spark, folder), ["fold"])
    return scores.select(
        "fold",
        "class",
        "tp",
        "true_n",
        "pred_n",
        "rows",
        *rounded(9, "precision", "recall", "f_measure", "fpr"),
    )


@query(
    "e3_accuracy",
    f"""WITH {SQL_RULED}
    SELECT round(avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy
    FROM ruled""",
)
def e3_accuracy(spark, folder):
    return reshape.error_rate(ruled_lines(spark, folder)).select(*rounded(9, "accuracy"))


@query(
    "a3_error_rate",
    f"""WITH {SQL_RULED}
    SELECT fold, count(*) AS rows,
      round(avg(CASE WHEN label = prediction THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 9) AS error_rate
    FROM ruled GROUP BY fold""",
)
def a3_error_rate(spark, folder):
    rates = reshape.error_rate(ruled_lines(spark, folder), ["fold"])
    return rates.select("fold", "rows", *rounded(9, "error_rate"))


@query(
    "e4_weighted_metrics",
    f"""WITH {SQL_RULED}, {PER_CLASS}
    SELECT fold, {', '.join(f"round(sum(true_n / rows * {s}), 9) AS weighted_{s}" for s in ("precision", "recall", "f_measure", "fpr"))}
    FROM scores GROUP BY fold""",
)
def e4_weighted_metrics(spark, folder):
    scores = evaluate.weighted_metrics(ruled_lines(spark, folder), ["fold"])
    return scores.select("fold", *rounded(9, *scores.columns[1:]))


@query(
    "e5_macro_metrics",
    f"""WITH {SQL_RULED}, {PER_CLASS}, {MACRO}
    SELECT fold, {sql_rounded(9, 'f_measure', 'precision', 'recall', 'accuracy')} FROM macro""",
)
def e5_macro_metrics(spark, folder):
    scores = evaluate.macro_metrics(ruled_lines(spark, folder), [0.0, 1.0, 2.0], ["fold"])
    return scores.select("fold", *rounded(9, *scores.columns[1:]))


@query(
    "a5_fold_summary",
    f"""WITH {SQL_RULED}, {PER_CLASS}, {MACRO}
    SELECT count(*) AS folds, {', '.join(f"round(avg({s}), 9) AS {s}" for s in ("f_measure", "precision", "recall", "accuracy"))}
    FROM macro""",
)
def a5_fold_summary(spark, folder):
    names = ("f_measure", "precision", "recall", "accuracy")
    macro = evaluate.macro_metrics(ruled_lines(spark, folder), by=["fold"])
    return reshape.fold_summary(macro, names).select("folds", *rounded(9, *names))


def code_sets(spark, folder):
    """Per order two sets of codes 0-4: predicted from the line number, actual from the part."""
    lines = table(spark, folder, "lineitem")
    return lines.groupBy("l_orderkey").agg(
        P.collect_set(P.pmod("l_linenumber", P.lit(5)).cast("double")).alias("predicted"),
        P.collect_set(P.pmod("l_partkey", P.lit(5)).cast("double")).alias("actual"),
    )


SETS = """
marks AS (
  SELECT l_orderkey, code, max(p) AS p, max(t) AS t FROM (
    SELECT l_orderkey, l_linenumber % 5 AS code, 1 AS p, 0 AS t FROM lineitem
    UNION ALL SELECT l_orderkey, l_partkey % 5, 0, 1 FROM lineitem) GROUP BY ALL),
docs AS (
  SELECT l_orderkey, sum(p) AS p, sum(t) AS t, sum(p * t) AS b FROM marks GROUP BY 1)"""


@query(
    "e11_multilabel_metrics",
    f"""WITH {SETS}
    SELECT round(avg(CASE WHEN p = 0 THEN 0.0 ELSE b / p END), 9) AS precision,
      round(avg(b / t), 9) AS recall, round(avg(2.0 * b / (p + t)), 9) AS f1,
      round(avg(b / (p + t - b)), 9) AS accuracy FROM docs""",
)
def e11_multilabel_metrics(spark, folder):
    scores = evaluate.multilabel_metrics(code_sets(spark, folder))
    return scores.select(*rounded(9, *scores.columns))


@query(
    "e12_multilabel_by_class",
    f"""WITH {SETS}, c AS (
      SELECT code, sum(p * t) AS tp, sum(p * (1 - t)) AS fp, sum((1 - p) * t) AS fn
      FROM marks GROUP BY 1)
    SELECT CAST(code AS DOUBLE) AS class, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
      CAST(fn AS BIGINT) AS fn, round(tp / (tp + fp), 9) AS precision,
      round(tp / (tp + fn), 9) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""",
)
def e12_multilabel_by_class(spark, folder):
    scores = evaluate.multilabel_by_class(code_sets(spark, folder))
    return scores.select("class", "tp", "fp", "fn", *rounded(9, "precision", "recall", "f1"))


@query(
    "e13_multilabel_micro",
    f"""WITH {SETS}, s AS (
      SELECT sum(b) AS tp, sum(p - b) AS fp, sum(t - b) AS fn, count(*) AS n,
        avg(CASE WHEN p = b AND t = b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS same FROM docs)
    SELECT round(tp / (tp + fp), 9) AS micro_precision, round(tp / (tp + fn), 9) AS micro_recall,
      round(2.0 * tp / (2 * tp + fp + fn), 9) AS micro_f1,
      round((fp + fn) / (n * (SELECT count(DISTINCT code) FROM marks WHERE t = 1)), 9) AS hamming_loss,
      round(same, 9) AS subset_accuracy FROM s""",
)
def e13_multilabel_micro(spark, folder):
    scores = evaluate.multilabel_micro(code_sets(spark, folder))
    return scores.select(*rounded(9, *scores.columns))
