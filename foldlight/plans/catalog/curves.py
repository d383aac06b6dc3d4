"""Threshold curves and threshold search on event scores."""

from __future__ import annotations

from pyspark.sql import functions as P

from foldlight.operators import classify, evaluate, reshape
from foldlight.plans import thresholds
from foldlight.plans.catalog.registry import SQL_CURVES, query, rounded, scored_events, sql_rounded

MIN_F1 = 0.3


def curves(spark, folder):
    return evaluate.threshold_curves(scored_events(spark, folder), ["fold"])


@query(
    "e6_threshold_curves",
    f"""WITH {SQL_CURVES}
    SELECT fold, threshold, tp, fp, {sql_rounded(9, 'precision', 'recall', 'f1', 'f2')} FROM curves""",
)
def e6_threshold_curves(spark, folder):
    return curves(spark, folder).select(
        "fold", "threshold", "tp", "fp", *rounded(9, "precision", "recall", "f1", "f2")
    )


@query(
    "e7_pr_curve",
    f"""WITH {SQL_CURVES}
    SELECT fold, threshold, {sql_rounded(9, 'recall', 'precision')} FROM curves
    UNION ALL
    SELECT fold, NULL, 0.0, {sql_rounded(9, 'precision')} FROM curves
    QUALIFY row_number() OVER (PARTITION BY fold ORDER BY threshold DESC) = 1""",
)
def e7_pr_curve(spark, folder):
    points = evaluate.pr_curve(curves(spark, folder), ["fold"])
    return points.select("fold", "threshold", *rounded(9, "recall", "precision"))


@query(
    "e8_roc_curve",
    f"""WITH {SQL_CURVES}
    SELECT fold, threshold, round(fpr, 9) + 0.0 AS fpr, round(recall, 9) + 0.0 AS tpr FROM curves
    UNION ALL SELECT DISTINCT fold, CAST(NULL AS DOUBLE), v.x, v.x
    FROM curves, (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) v(x)""",
)
def e8_roc_curve(spark, folder):
    points = evaluate.roc_curve(curves(spark, folder), ["fold"])
    return points.select("fold", "threshold", *rounded(9, "fpr", "tpr"))


@query(
    "e9_areas",
    f"""WITH {SQL_CURVES}, steps AS (
      SELECT fold, recall, precision, fpr,
        coalesce(lag(recall) OVER w, 0) AS r0, coalesce(lag(precision) OVER w, precision) AS p0,
        coalesce(lag(fpr) OVER w, 0) AS f0
      FROM curves WINDOW w AS (PARTITION BY fold ORDER BY threshold DESC))
    SELECT fold, round(sum((recall - r0) * (precision + p0) / 2), 9) AS area_under_pr,
      round(sum((fpr - f0) * (recall + r0) / 2), 9) AS area_under_roc
    FROM steps GROUP BY fold""",
)
def e9_areas(spark, folder):
    areas = evaluate.binary_areas(curves(spark, folder), ["fold"])
    return areas.select("fold", *rounded(9, "area_under_pr", "area_under_roc"))


@query("p11_thresholds", f"WITH {SQL_CURVES} SELECT fold, threshold FROM curves")
def p11_thresholds(spark, folder):
    return reshape.thresholds(curves(spark, folder), ["fold"])


BEST = """
best AS (
  SELECT fold, CASE WHEN f1 > 0 THEN threshold ELSE 0.0 END AS threshold, f1 FROM curves
  QUALIFY row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, threshold DESC) = 1)"""


@query(
    "n3_best_threshold",
    f"WITH {SQL_CURVES}, {BEST} SELECT fold, threshold, round(f1, 9) AS f1 FROM best",
)
def n3_best_threshold(spark, folder):
    best = thresholds.best_threshold(curves(spark, folder))
    return best.select("fold", "threshold", *rounded(9, "f1"))


@query(
    "n4_candidate_thresholds",
    f"WITH {SQL_CURVES} SELECT DISTINCT threshold FROM curves WHERE f1 > {MIN_F1}",
)
def n4_candidate_thresholds(spark, folder):
    return thresholds.candidate_thresholds(curves(spark, folder), MIN_F1)


def search_sql(candidates: str) -> str:
    return f"""
asked AS ({candidates}),
tested AS (
  SELECT fold, a.threshold, sum(pos) FILTER (c.threshold > a.threshold) AS tp,
    sum(neg) FILTER (c.threshold > a.threshold) AS fp, sum(pos) AS p, sum(neg) AS n
  FROM counts c CROSS JOIN asked a GROUP BY ALL),
filled AS (
  SELECT fold, threshold, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp,
    p - coalesce(tp, 0) AS fn, n - coalesce(fp, 0) AS tn FROM tested),
halves AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p1,
    CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r1,
    CASE WHEN tn + fn = 0 THEN 0.0 ELSE tn / (tn + fn) END AS p0,
    CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS r0 FROM filled),
found AS (
  SELECT threshold,
    avg((CASE WHEN p1 + r1 = 0 THEN 0.0 ELSE 2 * p1 * r1 / (p1 + r1) END
       + CASE WHEN p0 + r0 = 0 THEN 0.0 ELSE 2 * p0 * r0 / (p0 + r0) END) / 2) AS f_measure,
    avg((p0 + p1) / 2) AS precision, avg((r0 + r1) / 2) AS recall,
    avg((tp + tn) / (tp + fp + tn + fn)) AS accuracy
  FROM halves GROUP BY threshold)"""


SEARCH_COLUMNS = ("f_measure", "precision", "recall", "accuracy")
MANY = search_sql(f"SELECT DISTINCT threshold FROM curves WHERE f1 > {MIN_F1}")


@query(
    "n5_threshold_search",
    f"""WITH {SQL_CURVES}, {MANY}
    SELECT threshold, {sql_rounded(9, *SEARCH_COLUMNS)} FROM found""",
)
def n5_threshold_search(spark, folder):
    candidates = thresholds.candidate_thresholds(curves(spark, folder), MIN_F1)
    means = thresholds.threshold_search(scored_events(spark, folder), candidates, 5)
    return means.select("threshold", *rounded(9, *SEARCH_COLUMNS))


@query(
    "n5_best_of_folds",
    f"""WITH {SQL_CURVES}, {BEST}, {search_sql("SELECT DISTINCT threshold FROM best")}
    SELECT threshold, {sql_rounded(9, *SEARCH_COLUMNS)} FROM found
    ORDER BY round(found.f_measure, 9) DESC, threshold DESC LIMIT 1""",
)
def n5_best_of_folds(spark, folder):
    best = thresholds.search_from_scores(scored_events(spark, folder), 5)
    return best.select("threshold", *rounded(9, *SEARCH_COLUMNS))


@query(
    "m9_apply_threshold",
    f"""WITH {SQL_CURVES}
    SELECT fold, label, CASE WHEN score > 20.0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction,
      count(*) AS n FROM scored GROUP BY ALL""",
)
def m9_apply_threshold(spark, folder):
    decided = classify.apply_threshold(scored_events(spark, folder), 20.0)
    return decided.groupBy("fold", "label", "prediction").agg(P.count(P.lit(1)).alias("n"))
