"""Recommendation by alternating least squares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as P

from foldlight.functions import products
from foldlight.functions.vectors import dot
from foldlight.operators.running import with_row_id
from foldlight.session import enable_checkpoints, materialize


def fit_als(
    ratings: DataFrame,
    rank: int = 10,
    iterations: int = 10,
    reg: float = 0.01,
    blocks: int | None = None,
    seed: int = 1,
) -> ALSModel:
    """L1: explicit factor model of (user, item, rating)."""
    enable_checkpoints(ratings.sparkSession)
    als = ALS(
        rank=rank,
        maxIter=iterations,
        regParam=reg,
        seed=seed,
        userCol="user",
        itemCol="item",
        ratingCol="rating",
        coldStartStrategy="drop",
    )
    if blocks:
        als.setNumBlocks(blocks)
    return als.fit(ratings)


def predict_ratings(model: ALSModel, pairs: DataFrame) -> DataFrame:
    """L2: predicted rating for given (user, item); unknown ids give no row."""
    return model.transform(pairs.select("user", "item")).withColumn(
        "prediction", P.col("prediction").cast("double")
    )


SLICE_BYTES = 32 << 20  # of item factors that a task holds at once
BLOCK = 512  # items between two looks at the bounds


def top_products(users: DataFrame, items: DataFrame, n: int = 10, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(user, recommendations, scored): the n largest inner products of each row (id, features) with the items.

    Items lie in falling order of their norm. An inner product is at most the product of
    both norms, so a user is done where that bound falls below its n-th score; the rest of the items is not
    scored, and the result is exact. Items are sent to the tasks in slices of ``slice_bytes``, largest norms
    first, and users still open meet the next slice. ``scored`` counts the products formed. Equal scores go to the
    smaller id; with fewer than n items the lists are shorter. No users or no items give no rows.
    """
    spark = users.sparkSession
    vectors = items.select("id", P.col("features").cast("array<double>").alias("features"))
    vectors = vectors.withColumn("_minus", -P.sqrt(dot(P.col("features"), P.col("features"))))
    numbered = materialize(with_row_id(vectors, ["_minus", "id"], "_place"), "items")
    count, rank = numbered.agg(P.count(P.lit(1)), P.max(P.size("features"))).first()
    width = max(BLOCK, slice_bytes // (8 * (rank or 1) + 16))
    state = users.select(
        P.col("id").cast("int").alias("user"),
        P.col("features").cast("array<double>").alias("features"),
        P.array().cast("array<int>").alias("items"),
        P.array().cast("array<double>").alias("scores"),
        P.lit(0).cast("long").alias("scored"),
        P.lit(True).alias("open"),
    )
    for start in range(0, count, width):
        part = numbered.filter((P.col("_place") >= start) & (P.col("_place") < start + width + 1)).toArrow()
        part = part.sort_by("_place")
        norms = -part["_minus"].to_numpy()
        ids = part["id"].to_numpy()[:width]
        matrix = part["features"].combine_chunks().flatten().to_numpy().reshape(len(norms), -1)[:width]
        following = float(norms[width]) if len(norms) > width else -1.0  # norm of the next slice's first item
        sent = spark.sparkContext.broadcast((ids, matrix, norms[:width], following))

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, matrix, norms, following = sent.value
            for batch in batches:
                for i in range(0, batch.num_rows, products.ROWS):
                    part = batch.slice(i, products.ROWS)
                    columns = {c: part.column(c) for c in part.schema.names}
                    lists = [np.array(x, np.int32) for x in columns["items"].to_pylist()]
                    scores = [np.array(x, float) for x in columns["scores"].to_pylist()]
                    rows = columns["features"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    best = products.Best(rows, lists, scores, n)
                    for k in range(0, len(ids), BLOCK):
                        best.add(ids[k : k + BLOCK], matrix[k : k + BLOCK], norms[k])
                    still = np.zeros(part.num_rows, bool)
                    if following >= 0:
                        still[best.open(following)] = True
                    columns["items"] = pa.array([x.tolist() for x in best.items], pa.list_(pa.int32()))
                    columns["scores"] = pa.array([x.tolist() for x in best.scores], pa.list_(pa.float64()))
                    columns["scored"] = pa.array(columns["scored"].to_numpy() + best.scored)
                    columns["open"] = pa.array(still)
                    yield pa.RecordBatch.from_pydict(columns)

        state = materialize(state.mapInArrow(score, state.schema), "best")
        if state.filter("open").isEmpty():
            break
    pairs = P.arrays_zip(P.col("items").alias("item"), P.col("scores").cast("array<float>").alias("rating"))
    found = state.filter(P.size("items") > 0)
    return found.select("user", pairs.cast("array<struct<item:int,rating:float>>").alias("recommendations"), "scored")


def recommend_for_all_users(model: ALSModel, n: int = 10) -> DataFrame:
    """L3: (user, recommendations) with the n best items, seen ones included."""
    return top_products(model.userFactors, model.itemFactors, n).select("user", "recommendations")


def top_items(rated: DataFrame, n: int = 10) -> DataFrame:
    """Best n items of each user from a (user, item, rating) table, with ranks.

    Spark limits each map task to n rows per user before the shuffle, so a hot
    user does not gather its rows in one task.
    """
    order = Window.partitionBy("user").orderBy(P.desc("rating"), P.asc("item"))
    return (
        rated.withColumn("rank", P.row_number().over(order))
        .filter(P.col("rank") <= n)
        .select("user", "item", "rating", "rank")
    )


def user_factors(model: ALSModel) -> DataFrame:
    """L4: (id, features) of the users."""
    return model.userFactors


def item_factors(model: ALSModel) -> DataFrame:
    """L4: (id, features) of the items."""
    return model.itemFactors
