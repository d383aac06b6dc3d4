"""Projections, filters, joins and simple aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as P

from foldlight.functions.vectors import as_array, is_vector

# -- projections and filters --------------------------------------------------


def center_rating(df: DataFrame, shift: float = 2.5, rating: str = "rating") -> DataFrame:
    """Rating minus a constant."""
    return df.withColumn(rating, P.col(rating) - P.lit(float(shift)))


def binarize_rating(df: DataFrame, threshold: float = 0.0, rating: str = "rating") -> DataFrame:
    """1.0 where rating > threshold, else 0.0."""
    return df.withColumn(rating, P.when(P.col(rating) > threshold, 1.0).otherwise(0.0))


def clamp_recommendations(
    df: DataFrame, low: float = 0.0, high: float = 1.0, recs: str = "recommendations"
) -> DataFrame:
    """Limit every rating inside the recommendation array to [low, high]."""
    return df.withColumn(
        recs,
        P.transform(
            recs,
            lambda r: r.withField(
                "rating", P.greatest(P.least(r["rating"].cast("double"), P.lit(high)), P.lit(low))
            ),
        ),
    )


def discretize(df: DataFrame, width: float = 16.0, features: str = "features") -> DataFrame:
    """floor(x / width) for every feature."""
    return as_array(df, features).withColumn(
        features, P.transform(features, lambda x: P.floor(x / P.lit(float(width))).cast("double"))
    )


def append_bias(df: DataFrame, features: str = "features") -> DataFrame:
    """P5: 1.0 as an additional last feature."""
    return as_array(df, features).withColumn(
        features, P.concat(P.col(features), P.array(P.lit(1.0)))
    )


def extract_items(
    df: DataFrame,
    array: str = "recommendations",
    min_rating: float | None = None,
    name: str = "items",
) -> DataFrame:
    """Item ids of an array<struct<item, rating>>, of those above ``min_rating`` if given."""
    kept = P.col(array)
    if min_rating is not None:
        kept = P.filter(kept, lambda r: r["rating"] > min_rating)
    return df.withColumn(name, P.transform(kept, lambda r: r["item"]))


def prediction_pairs(
    df: DataFrame, prediction: str = "prediction", label: str = "label", keep: Sequence[str] = ()
) -> DataFrame:
    """(prediction, label) as doubles; label text such as '2.0' is parsed."""
    return df.select(
        *keep,
        P.col(prediction).cast("double").alias("prediction"),
        P.col(label).cast("double").alias("label"),
    )


def user_items(df: DataFrame) -> DataFrame:
    """The (user, item) keys of a rating table, one row per rating."""
    return df.select("user", "item")


def keyed_ratings(df: DataFrame) -> DataFrame:
    """Rating as ((user, item), rating)."""
    return df.select(P.struct("user", "item").alias("key"), "rating")


def errors(
    df: DataFrame, prediction: str = "prediction", label: str = "label", equal: bool = False
) -> DataFrame:
    """P10: rows predicted wrongly, or rightly with ``equal``."""
    same = P.col(prediction) == P.col(label)
    return df.filter(same if equal else ~same)


def thresholds(curves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The score column of a threshold curve; the curve has each score once."""
    return curves.select(*by, "threshold")


def significant(df: DataFrame, alpha: float = 0.05, p_value: str = "p_value") -> DataFrame:
    """Rows with p below alpha."""
    return df.filter(P.col(p_value) < alpha)


def num_features(df: DataFrame, features: str = "features") -> DataFrame:
    """Length of the first vector; reads one row."""
    first = as_array(df.select(features).limit(1), features) if is_vector(df, features) else (
        df.select(features).limit(1)
    )
    return first.select(P.size(features).cast("long").alias("num_features"))


# -- joins ---------------------------------------------------------------------


def rates_and_predictions(ratings: DataFrame, predictions: DataFrame) -> DataFrame:
    """Inner join of ratings and predictions on (user, item).

    Equal predictions of one pair are counted, not repeated: ``copies`` says how
    often the pair occurs in the plain join, and the error aggregates take it as
    their weight. A hot pair therefore never multiplies with itself.
    """
    counted = predictions.groupBy("user", "item", "prediction").agg(
        P.count(P.lit(1)).alias("copies")
    )
    return ratings.join(counted, ["user", "item"]).select(
        "user", "item", P.col("rating").alias("label"), "prediction", "copies"
    )


def holdout_rest(all_rows: DataFrame, sample: DataFrame) -> DataFrame:
    """Rows of ``all_rows`` with no equal row in ``sample`` (nulls are equal).

    Removes every copy of a sampled row and keeps the other duplicates.
    """
    same: Column = P.lit(True)
    for c in all_rows.columns:
        same = same & P.col(f"a.{c}").eqNullSafe(P.col(f"s.{c}"))
    return all_rows.alias("a").join(sample.distinct().alias("s"), same, "left_anti")


# -- aggregates ------------------------------------------------------------------


def items_by_user(ratings: DataFrame, min_rating: float = 0.0) -> DataFrame:
    """A1: the liked items of each user, long form.

    One row per (user, item) rated above ``min_rating`` with the number of such
    ratings; a user with none keeps one row with a null item and n = 0. The long
    form has no list that grows with a hot user.
    """
    liked = (
        ratings.filter(P.col("rating") > min_rating)
        .groupBy("user", "item")
        .agg(P.count(P.lit(1)).alias("n"))
    )
    none = (
        ratings.groupBy("user")
        .agg(P.max("rating").alias("_best"))
        .filter(P.coalesce(P.col("_best") <= min_rating, P.lit(True)))
    )
    item_type = ratings.schema["item"].dataType
    return liked.unionAll(
        none.select("user", P.lit(None).cast(item_type).alias("item"), P.lit(0).cast("long").alias("n"))
    )


def item_lists(
    ratings: DataFrame, min_rating: float = 0.0, chunks: int = 1
) -> DataFrame:
    """A1: the liked items of each user as sorted lists (user, chunk, items).

    Items are dealt over ``chunks`` lists by their hash, for every user alike and
    whatever its size; with one chunk a user is one row. Choose as many as keep the
    longest list small. Users without liked items keep one empty list.
    """
    long = items_by_user(ratings, min_rating)
    dealt = P.coalesce(P.pmod(P.xxhash64("item"), P.lit(chunks)), P.lit(0)).cast("int")
    return (
        long.withColumn("chunk", P.when(P.col("item").isNull(), 0).otherwise(dealt))
        .groupBy("user", "chunk")
        .agg(P.sort_array(P.collect_list("item")).alias("items"))
    )


def relevant_documents(truth: DataFrame, recs: DataFrame) -> DataFrame:
    """Ranked items joined with the truth of the same user.

    ``truth`` is the long table of :func:`items_by_user`, ``recs`` has (user,
    item, rank). Users missing on either side are lost. Gives (user, item, rank,
    relevant, n_relevant).
    """
    per_user = truth.groupBy("user").agg(P.count_distinct("item").alias("n_relevant"))
    liked = (
        truth.filter(P.col("item").isNotNull())
        .select("user", "item")
        .distinct()
        .withColumn("_hit", P.lit(True))
    )
    return (
        recs.select("user", "item", "rank")
        .join(per_user, "user")
        .join(liked, ["user", "item"], "left")
        .select(
            "user", "item", "rank", P.col("_hit").isNotNull().alias("relevant"), "n_relevant"
        )
    )


def explode_recommendations(df: DataFrame, recs: str = "recommendations") -> DataFrame:
    """Recommendation arrays to (user, item, rating, rank), rank from 1."""
    return df.select("user", P.posexplode(recs).alias("_pos", "_rec")).select(
        "user",
        P.col("_rec.item").alias("item"),
        P.col("_rec.rating").cast("double").alias("rating"),
        (P.col("_pos") + 1).alias("rank"),
    )


def mean_squared_error(
    df: DataFrame, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """A2: mean of (prediction - label) squared."""
    w = P.col(weight) if weight else P.lit(1)
    gap = P.col("prediction") - P.col("label")
    return df.groupBy(*by).agg((P.sum(w * gap * gap) / P.sum(w)).alias("mse"))


def error_rate(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of wrong and of right predictions."""
    wrong = (P.col("prediction") != P.col("label")).cast("double")
    return df.groupBy(*by).agg(
        P.count(P.lit(1)).alias("rows"),
        P.avg(wrong).alias("error_rate"),
        P.avg(1.0 - wrong).alias("accuracy"),
    )


def fold_counts(df: DataFrame, fold: str = "fold") -> DataFrame:
    """A4: validation and training rows of each fold."""
    counts = df.groupBy(fold).agg(P.count(P.lit(1)).alias("validation_rows"))
    # one row per fold meets in this window
    total = P.sum("validation_rows").over(Window.partitionBy(P.lit(0)))
    return counts.withColumn("training_rows", total - P.col("validation_rows"))


def fold_summary(
    per_fold: DataFrame, scores: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """A5: mean of the per-fold scores, and how many folds have a score."""
    return per_fold.groupBy(*by).agg(
        P.count(P.lit(1)).alias("folds"),
        *[P.count(s).alias(f"{s}_folds") for s in scores],
        *[P.avg(s).alias(s) for s in scores],
    )
