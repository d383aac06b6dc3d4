"""Scores of classifiers, rankers and regressors as aggregate tables.

Every operator takes ``by`` columns (such as a fold), so one plan scores all
folds together. Rows are counted per (label, prediction) or per (score, label)
first, with partial aggregation, and all formulas run on these counts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as P

from foldlight.functions.vectors import doubles
from foldlight.operators.running import running_totals


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    return P.when(bottom == 0, P.lit(empty)).otherwise(top / bottom)


def f_measure(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b2 = beta * beta
    return ratio((1.0 + b2) * precision * recall, b2 * precision + recall)


def _cells(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(
        *by, P.col("label").cast("double"), P.col("prediction").cast("double")
    ).agg(P.count(P.lit(1)).alias("n"))


# -- classes -------------------------------------------------------------------


def confusion_matrix(
    df: DataFrame, by: Sequence[str] = (), classes: Sequence[float] | None = None
) -> DataFrame:
    """Rows per (label, prediction), zero cells included.

    Without ``classes`` the classes are those seen in the group. Only the class list
    of a group meets in one row; the counted cells join the grid by equality.
    """
    cells = _cells(df, by)
    seen = P.array_union(P.collect_set("label"), P.collect_set("prediction"))
    lists = cells.groupBy(*by).agg((doubles(classes) if classes is not None else seen).alias("_classes"))
    grid = (
        lists.withColumn("label", P.explode("_classes"))
        .withColumn("prediction", P.explode("_classes"))
        .drop("_classes")
    )
    keys = [*by, "label", "prediction"]
    same: Column = P.lit(True)
    for c in keys:
        same = same & P.col(f"g.{c}").eqNullSafe(P.col(f"c.{c}"))
    return grid.alias("g").join(cells.alias("c"), same, "left").select(
        *[P.col(f"g.{c}").alias(c) for c in keys],
        P.coalesce("c.n", P.lit(0).cast("long")).alias("n"),
    )


def per_class_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, precision, recall, F and false-positive rate of each class."""
    cells = _cells(df, by)
    no = P.lit(0).cast("long")
    hit = P.when(P.col("label") == P.col("prediction"), P.col("n")).otherwise(no)
    sides = cells.select(
        *by,
        P.inline(
            P.array(
                P.struct(
                    P.col("label").alias("class"),
                    P.col("n").alias("true_n"),
                    no.alias("pred_n"),
                    hit.alias("tp"),
                ),
                P.struct(
                    P.col("prediction").alias("class"),
                    no.alias("true_n"),
                    P.col("n").alias("pred_n"),
                    no.alias("tp"),
                ),
            )
        ),
    )
    counts = sides.groupBy(*by, "class").agg(
        P.sum("tp").alias("tp"), P.sum("true_n").alias("true_n"), P.sum("pred_n").alias("pred_n")
    )
    # one row per class of the group meets in this window
    group = Window.partitionBy(*by) if by else Window.partitionBy(P.lit(0))
    rows = P.sum("true_n").over(group)
    precision = ratio(P.col("tp"), P.col("pred_n"))
    recall = ratio(P.col("tp"), P.col("true_n"))
    return counts.withColumn("rows", rows).select(
        *by,
        "class",
        "tp",
        "true_n",
        "pred_n",
        "rows",
        precision.alias("precision"),
        recall.alias("recall"),
        f_measure(precision, recall).alias("f_measure"),
        ratio(P.col("pred_n") - P.col("tp"), P.col("rows") - P.col("true_n")).alias("fpr"),
    )


def weighted_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per-class scores weighted by the true share of the class."""
    share = P.col("true_n") / P.col("rows")
    return per_class_metrics(df, by).groupBy(*by).agg(
        *[
            P.sum(share * P.col(s)).alias(f"weighted_{s}")
            for s in ("precision", "recall", "f_measure", "fpr")
        ]
    )


def macro_from_classes(
    scores: DataFrame, by: Sequence[str] = (), classes: Sequence[float] | None = None
) -> DataFrame:
    """E5 from a table of per-class scores (see :func:`per_class_metrics`)."""
    if classes is not None:
        counted = P.col("class").isin([float(c) for c in classes])
        n: Column = P.lit(float(len(classes)))
    else:
        labels = scores.filter("true_n > 0").select(P.col("class").alias("_label")).distinct()
        n = labels.agg(P.count(P.lit(1)).cast("double")).scalar()
        scores = scores.join(labels, P.col("class") == P.col("_label"), "left")
        counted = P.col("_label").isNotNull()
    return scores.groupBy(*by).agg(
        *[
            (P.sum(P.when(counted, P.col(s)).otherwise(0.0)) / n).alias(s)
            for s in ("f_measure", "precision", "recall")
        ],
        (P.sum("tp") / P.sum("true_n")).alias("accuracy"),
    )


def macro_metrics(
    df: DataFrame, classes: Sequence[float] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """E5: plain mean of F, precision and recall over the classes, plus accuracy.

    ``classes`` defaults to the labels present in the whole table; a class that
    a group does not have adds 0 to the group's sums.
    """
    return macro_from_classes(per_class_metrics(df, by), by, classes)


# -- thresholds ------------------------------------------------------------------


def threshold_curves(
    df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label"
) -> DataFrame:
    """Scores at each distinct threshold; a row is positive from the threshold up.

    Rows are first counted per distinct score, then the counts are summed down
    the scores by :func:`running_totals`, so no group is walked by one task.
    """
    positive = P.col(label).cast("double") > 0.5
    counts = df.groupBy(*by, P.col(score).cast("double").alias("threshold")).agg(
        P.count_if(positive).alias("pos"), P.count_if(~positive).alias("neg")
    )
    run = running_totals(counts, ["threshold"], ["pos", "neg"], by, descending=True)
    tp = P.col("pos") + P.col("pos_before")
    fp = P.col("neg") + P.col("neg_before")
    curve = run.select(
        *by,
        "threshold",
        "pos",
        "neg",
        tp.alias("tp"),
        fp.alias("fp"),
        P.col("pos_all").alias("positives"),
        P.col("neg_all").alias("negatives"),
        (tp / (tp + fp)).alias("precision"),
        ratio(tp, P.col("pos_all")).alias("recall"),
        ratio(fp, P.col("neg_all")).alias("fpr"),
    )
    p, r = P.col("precision"), P.col("recall")
    return curve.withColumns({"f1": f_measure(p, r), "f2": f_measure(p, r, 2.0)})


def _is_first() -> Column:
    return (P.col("tp") == P.col("pos")) & (P.col("fp") == P.col("neg"))


def _is_last() -> Column:
    return (P.col("tp") == P.col("positives")) & (P.col("fp") == P.col("negatives"))


def _point(threshold: Column, x: Column, y: Column, names: tuple[str, str]) -> Column:
    return P.struct(
        threshold.cast("double").alias("threshold"),
        x.cast("double").alias(names[0]),
        y.cast("double").alias(names[1]),
    )


def pr_curve(
    curves: DataFrame, by: Sequence[str] = (), first_precision: float | None = None
) -> DataFrame:
    """(recall, precision) per threshold, led by (0, first precision).

    The added first point has no threshold. ``first_precision`` fixes its
    precision instead of taking that of the highest threshold.
    """
    names = ("recall", "precision")
    lead = P.col("precision") if first_precision is None else P.lit(first_precision)
    here = _point(P.col("threshold"), P.col("recall"), P.col("precision"), names)
    start = _point(P.lit(None), P.lit(0.0), lead, names)
    points = P.when(_is_first(), P.array(start, here)).otherwise(P.array(here))
    return curves.select(*by, P.inline(points))


def roc_curve(curves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(fpr, tpr) per threshold, between the added points (0, 0) and (1, 1)."""
    names = ("fpr", "tpr")
    here = _point(P.col("threshold"), P.col("fpr"), P.col("recall"), names)
    zero = _point(P.lit(None), P.lit(0.0), P.lit(0.0), names)
    one = _point(P.lit(None), P.lit(1.0), P.lit(1.0), names)
    before = P.when(_is_first(), P.array(zero, here)).otherwise(P.array(here))
    points = P.when(_is_last(), P.concat(before, P.array(one))).otherwise(before)
    return curves.select(*by, P.inline(points))


def _areas(first_precision: float | None = None) -> tuple[Column, Column]:
    """Trapezoid sums; each row knows the counts of the row above it."""
    tp0 = P.col("tp") - P.col("pos")
    fp0 = P.col("fp") - P.col("neg")
    recall0 = ratio(tp0, P.col("positives"))
    fpr0 = ratio(fp0, P.col("negatives"))
    start = P.col("precision") if first_precision is None else P.lit(first_precision)
    precision0 = P.when(tp0 + fp0 == 0, start).otherwise(ratio(tp0, tp0 + fp0))
    pr = P.sum((P.col("recall") - recall0) * (P.col("precision") + precision0) / 2.0)
    roc = P.sum((P.col("fpr") - fpr0) * (P.col("recall") + recall0) / 2.0)
    return pr, roc


def area_under_pr(curves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the precision-recall curve."""
    return curves.groupBy(*by).agg(_areas()[0].alias("area_under_pr"))


def area_under_roc(curves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve."""
    return curves.groupBy(*by).agg(_areas()[1].alias("area_under_roc"))


def binary_areas(curves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Both areas in one aggregate."""
    pr, roc = _areas()
    return curves.groupBy(*by).agg(pr.alias("area_under_pr"), roc.alias("area_under_roc"))


# -- several labels per row ---------------------------------------------------------


def _overlap(predicted: str, actual: str) -> tuple[Column, Column, Column]:
    both = P.size(P.array_intersect(predicted, actual))
    return P.size(predicted), P.size(actual), both


def multilabel_metrics(
    df: DataFrame, predicted: str = "predicted", actual: str = "actual"
) -> DataFrame:
    """Per-row precision, recall, F1 and accuracy, averaged over the rows."""
    p, t, b = _overlap(predicted, actual)
    return df.agg(
        P.avg(ratio(b, p)).alias("precision"),
        P.avg(ratio(b, t)).alias("recall"),
        P.avg(ratio(2.0 * b, p + t)).alias("f1"),
        P.avg(ratio(b, p + t - b)).alias("accuracy"),
    )


def multilabel_by_class(
    df: DataFrame, predicted: str = "predicted", actual: str = "actual"
) -> DataFrame:
    """Precision, recall and F1 of each label."""
    rows = df.select(P.explode(P.array_union(predicted, actual)).alias("class"), predicted, actual)
    in_p = P.array_contains(predicted, P.col("class"))
    in_t = P.array_contains(actual, P.col("class"))
    counts = rows.groupBy("class").agg(
        P.count_if(in_p & in_t).alias("tp"),
        P.count_if(in_p & ~in_t).alias("fp"),
        P.count_if(~in_p & in_t).alias("fn"),
    )
    tp, fp, fn = P.col("tp"), P.col("fp"), P.col("fn")
    return counts.select(
        "class",
        "tp",
        "fp",
        "fn",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2.0 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def multilabel_micro(
    df: DataFrame, predicted: str = "predicted", actual: str = "actual"
) -> DataFrame:
    """Micro precision, recall, F1; Hamming loss; subset accuracy."""
    p, t, b = _overlap(predicted, actual)
    totals = df.agg(
        P.count(P.lit(1)).alias("rows"),
        P.sum(b).alias("tp"),
        P.sum(p - b).alias("fp"),
        P.sum(t - b).alias("fn"),
        P.avg(((p == b) & (t == b)).cast("double")).alias("subset_accuracy"),
    )
    labels = df.select(P.explode(actual).alias("class")).agg(P.count_distinct("class")).scalar()
    tp, fp, fn = P.col("tp"), P.col("fp"), P.col("fn")
    return totals.select(
        ratio(tp, tp + fp).alias("micro_precision"),
        ratio(tp, tp + fn).alias("micro_recall"),
        ratio(2.0 * tp, 2 * tp + fp + fn).alias("micro_f1"),
        ((fp + fn) / (P.col("rows") * labels)).alias("hamming_loss"),
        "subset_accuracy",
    )


# -- ranked lists --------------------------------------------------------------------


def ranking_metrics(relevant: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """precision@k, NDCG@k and mean average precision.

    ``relevant`` comes from ``relevant_documents``: (user, rank, relevant,
    n_relevant). The ranked list of a user is a top-n list, which bounds the
    rows per user in the window below.
    """
    hit = P.when(P.col("relevant"), 1).otherwise(0)
    so_far = Window.partitionBy("user").orderBy("rank").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    rows = relevant.select(
        "user", "rank", "n_relevant", hit.alias("hit"), P.sum(hit).over(so_far).alias("hits")
    )
    gain = P.col("hit") / P.log2(P.col("rank") + 1.0)
    n = P.col("n_relevant")
    per_user = rows.groupBy("user", "n_relevant").agg(
        *[P.sum(P.when(P.col("rank") <= k, P.col("hit")).otherwise(0)).alias(f"_h{k}") for k in ks],
        *[P.sum(P.when(P.col("rank") <= k, gain).otherwise(0.0)).alias(f"_g{k}") for k in ks],
        P.sum(P.col("hit") * P.col("hits") / P.col("rank")).alias("_ap"),
    )
    scores: list[Column] = [P.count(P.lit(1)).alias("users")]
    for k in ks:
        best = [sum(1.0 / math.log2(i + 1) for i in range(1, m + 1)) for m in range(1, k + 1)]
        ideal = P.element_at(doubles(best), P.greatest(P.least(n, P.lit(k)), P.lit(1)).cast("int"))
        found = P.col(f"_h{k}") / P.lit(float(k))
        scores.append(P.avg(P.when(n == 0, 0.0).otherwise(found)).alias(f"precision_at_{k}"))
        scores.append(
            P.avg(P.when(n == 0, 0.0).otherwise(P.col(f"_g{k}") / ideal)).alias(f"ndcg_at_{k}")
        )
    scores.append(P.avg(ratio(P.col("_ap"), n)).alias("mean_average_precision"))
    return per_user.agg(*scores)


# -- regression ------------------------------------------------------------------------


def regression_metrics(
    df: DataFrame, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """MSE, RMSE, MAE, R squared and explained variance.

    ``weight`` says how often a row counts. R squared is null where all labels are
    equal. Weighted spreads are taken around the means of a first pass over one row
    per group, so large values lose no precision.
    """
    p, y = P.col("prediction").cast("double"), P.col("label").cast("double")
    gap = p - y
    if weight is None:
        mse, absolute = P.avg(gap * gap), P.avg(P.abs(gap))
        spread_y, spread_p, shift = P.var_pop(y), P.var_pop(p), P.avg(p) - P.avg(y)
    else:
        w = P.when(gap.isNotNull(), P.col(weight))
        y0 = P.col("_y0")

        def mean(x: Column) -> Column:
            return P.try_divide(P.sum(w * x), P.sum(w))

        same: Column = P.lit(True)
        for c in by:
            same = same & P.col(f"a.{c}").eqNullSafe(P.col(f"m.{c}"))
        first = df.groupBy(*by).agg(mean(y).alias("_y0"))
        if by:
            df = df.alias("a").join(first.alias("m"), same).select("a.*", "m._y0")
        else:
            df = df.withColumn("_y0", first.scalar())
        mse, absolute = mean(gap * gap), mean(P.abs(gap))
        off_y, off_p = mean(y - y0), mean(p - y0)
        spread_y = mean((y - y0) * (y - y0)) - off_y * off_y
        spread_p = mean((p - y0) * (p - y0)) - off_p * off_p
        shift = off_p - off_y
    return df.groupBy(*by).agg(
        mse.alias("mse"),
        P.sqrt(mse).alias("rmse"),
        absolute.alias("mae"),
        (1.0 - P.try_divide(mse, spread_y)).alias("r2"),
        (spread_p + shift * shift).alias("explained_variance"),
    )
