"""Cross-validated search for a decision threshold.

Each fold is fitted once; every step here works on the scored table (fold,
label, score).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as P

from foldlight.operators.evaluate import f_measure, ratio, threshold_curves
from foldlight.operators.running import running_totals


def best_threshold(curves: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """Threshold with the largest F1 per fold; ties to the highest, 0 if no F1 > 0."""
    best = P.max(P.struct("f1", "threshold"))
    return (
        curves.groupBy(*by)
        .agg(best.alias("_b"))
        .select(
            *by,
            P.when(P.col("_b.f1") > 0, P.col("_b.threshold")).otherwise(0.0).alias("threshold"),
            P.col("_b.f1").alias("f1"),
        )
    )


def candidate_thresholds(curves: DataFrame, min_f1: float = 0.8) -> DataFrame:
    """Distinct thresholds of all folds with F1 above ``min_f1``."""
    return curves.filter(P.col("f1") > min_f1).select("threshold").distinct()


def threshold_scores(
    scored: DataFrame, candidates: DataFrame, folds: int, classes: Sequence[float] = (0.0, 1.0)
) -> DataFrame:
    """Macro scores of each (fold, candidate); class 1 is a score above the candidate.

    Rows are counted per (fold, score); the candidates are merged into these
    counts and the totals above each candidate come from one running sum, so
    rows and candidates are never paired.
    """
    positive = P.col("label") > 0.5
    counts = scored.groupBy("fold", P.col("score").cast("double").alias("at")).agg(
        P.count_if(positive).alias("pos"), P.count_if(~positive).alias("neg")
    )
    zero = P.lit(0).cast("long")
    # a candidate asks for the counts strictly above it, so it sorts before its own score
    asked = (
        candidates.select(P.col("threshold").cast("double").alias("at"))
        .distinct()
        .select(
            P.explode(P.sequence(P.lit(0), P.lit(folds - 1))).alias("fold"),
            "at",
            zero.alias("pos"),
            zero.alias("neg"),
            P.lit(1).alias("ask"),
        )
    )
    merged = counts.select("fold", "at", "pos", "neg", P.lit(0).alias("ask")).unionAll(
        asked.select("fold", "at", "pos", "neg", "ask")
    )
    run = running_totals(merged, ["at", "ask"], ["pos", "neg"], ["fold"], descending=True)
    tp, fp = P.col("pos_before"), P.col("neg_before")
    fn, tn = P.col("pos_all") - tp, P.col("neg_all") - fp
    precision = {1.0: ratio(tp, tp + fp), 0.0: ratio(tn, tn + fn)}
    recall = {1.0: ratio(tp, tp + fn), 0.0: ratio(tn, tn + fp)}
    n = float(len(classes))
    known = [c for c in classes if c in precision]

    def mean(of) -> Column:
        return sum((of(c) for c in known), P.lit(0.0)) / n

    return run.filter(P.col("ask") == 1).select(
        "fold",
        P.col("at").alias("threshold"),
        mean(lambda c: f_measure(precision[c], recall[c])).alias("f_measure"),
        mean(precision.get).alias("precision"),
        mean(recall.get).alias("recall"),
        ((tp + tn) / (tp + fp + tn + fn)).alias("accuracy"),
    )


def threshold_search(
    scored: DataFrame, candidates: DataFrame, folds: int, classes: Sequence[float] = (0.0, 1.0)
) -> DataFrame:
    """Scores of each candidate, averaged over the folds."""
    per_fold = threshold_scores(scored, candidates, folds, classes)
    return per_fold.groupBy("threshold").agg(
        *[(P.sum(s) / folds).alias(s) for s in ("f_measure", "precision", "recall", "accuracy")]
    )


def best_candidate(means: DataFrame) -> DataFrame:
    """The row of the largest mean macro F; of equal ones the highest threshold."""
    return means.orderBy(P.desc("f_measure"), P.desc("threshold")).limit(1)


def search_from_scores(
    scored: DataFrame,
    folds: int,
    min_f1: float | None = None,
    proposing: DataFrame | None = None,
) -> DataFrame:
    """The whole search: candidates from the folds' curves, then the best of them.

    Without ``min_f1`` each fold proposes its best threshold, with it all
    thresholds above that F1. ``proposing`` is another scored table to take the
    candidates from, such as the folds' training rows.
    """
    curves = threshold_curves(scored if proposing is None else proposing, by=["fold"])
    if min_f1 is None:
        candidates = best_threshold(curves).select("threshold")
    else:
        candidates = candidate_thresholds(curves, min_f1)
    return best_candidate(threshold_search(scored, candidates, folds))
