"""Recommendation quality from ratings: factor model, top lists, ranking scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from foldlight.operators.evaluate import ranking_metrics, regression_metrics
from foldlight.operators.recommend import fit_als, predict_ratings, recommend_for_all_users
from foldlight.operators.reshape import (
    center_rating,
    clamp_recommendations,
    explode_recommendations,
    items_by_user,
    rates_and_predictions,
    relevant_documents,
)


def evaluate_recommendations(
    ratings: DataFrame, shift: float = 2.5, n: int = 10, ks: Sequence[int] = (1, 3, 5), **als
) -> tuple[DataFrame, DataFrame]:
    """(ranking scores, regression scores) of a factor model on its own ratings.

    Every rating is predicted and joined with all predictions of its pair, so a pair
    rated k times counts k times k, by weight and not by rows.
    """
    centred = center_rating(ratings, shift)
    model = fit_als(centred, **als)
    recs = explode_recommendations(clamp_recommendations(recommend_for_all_users(model, n)))
    ranking = ranking_metrics(relevant_documents(items_by_user(centred), recs), ks)
    predicted = predict_ratings(model, centred.select("user", "item"))
    pairs = rates_and_predictions(centred, predicted)
    return ranking, regression_metrics(pairs, weight="copies")
