"""Factor models checked by the equations they solve."""

from __future__ import annotations

from pyspark.sql import functions as P

from foldlight.functions.vectors import dot
from foldlight.operators import recommend
from foldlight.plans.catalog.registry import query, rounded
from foldlight.plans.catalog.registry import ratings as user_item_ratings
from foldlight.session import scratch_path
from foldlight.sources import sinks

RANK, STEPS, REG = 10, 10, 0.1


def fitted(spark, folder):
    rated = user_item_ratings(spark, folder)
    return rated, recommend.fit_als(rated, rank=RANK, iterations=STEPS, reg=REG)


def with_factors(pairs, model):
    """Pairs with the factors x of their user and v of their item."""
    users = recommend.user_factors(model).select(P.col("id").alias("user"), P.col("features").alias("x"))
    items = recommend.item_factors(model).select(P.col("id").alias("item"), P.col("features").alias("v"))
    return pairs.join(users, "user").join(items, "item")


@query("l1_factor_equations", 'SELECT DISTINCT user_id AS "user", 0.0::DOUBLE AS residual FROM events')
def l1_factor_equations(spark, folder):
    """The last half step solves a ridge regression for each user: its gradient is zero.

    Largest component of sum v (v.x - r) + reg n x, relative to the sum of |v r|.
    """
    rated, model = fitted(spark, folder)
    rows = with_factors(rated, model)
    gap = dot(P.col("x"), P.col("v")) - P.col("rating")
    parts = rows.select(
        "user",
        gap.alias("gap"),
        "rating",
        P.posexplode(P.arrays_zip("x", "v")).alias("j", "f"),
    )
    equations = parts.groupBy("user", "j").agg(
        (P.sum(P.col("f.v") * P.col("gap")) + REG * P.sum("f.x")).alias("gradient"),
        P.sum(P.abs(P.col("f.v") * P.col("rating"))).alias("scale"),
    )
    largest = P.max(P.abs(P.col("gradient"))) / P.greatest(P.max("scale"), P.lit(1.0))
    return equations.groupBy("user").agg(largest.alias("residual")).select("user", *rounded(2, "residual"))


SQL_PAIRS = """SELECT user_id AS "user", count(DISTINCT props) AS {} FROM events GROUP BY 1"""


@query("l2_prediction_is_the_product", SQL_PAIRS.format("equal"))
def l2_prediction_is_the_product(spark, folder):
    """Per user, the pairs whose prediction is the product of the written factors."""
    rated, model = fitted(spark, folder)
    predicted = recommend.predict_ratings(model, rated).select("user", "item", "prediction")
    product = dot(P.col("x"), P.col("v"))
    close = P.abs(product - P.col("prediction")) <= 1e-4 * (1 + P.abs(product))
    return with_factors(predicted, model).groupBy("user").agg(P.count_if(close).alias("equal")).withColumn("user", P.col("user").cast("long"))


@query("l3_no_pair_beats_the_list", SQL_PAIRS.format("settled"))
def l3_no_pair_beats_the_list(spark, folder):
    """Per user, the rated pairs that are in the top list or not above its last rating."""
    rated, model = fitted(spark, folder)
    recs = recommend.recommend_for_all_users(model, 10).select("user", P.explode("recommendations").alias("r"))
    recs = recs.select("user", P.col("r.item").alias("item"), P.col("r.rating").alias("listed"))
    last = recs.groupBy("user").agg(P.min("listed").alias("last"))
    predicted = recommend.predict_ratings(model, rated).select("user", "item", "prediction")
    both = predicted.join(last, "user").join(recs, ["user", "item"], "left")
    settled = P.when(
        P.col("listed").isNotNull(), P.abs(P.col("listed") - P.col("prediction")) <= 1e-4 * (1 + P.abs("listed"))
    ).otherwise(P.col("prediction") <= P.col("last") + 1e-4 * (1 + P.abs("last")))
    return both.groupBy("user").agg(P.count_if(settled).alias("settled")).withColumn("user", P.col("user").cast("long"))


@query(
    "k1_lines_are_the_factors",
    """SELECT 'productFeatures' AS side, count(DISTINCT props) AS equal FROM events
    UNION ALL SELECT 'userFeatures', count(DISTINCT user_id) FROM events""",
)
def k1_lines_are_the_factors(spark, folder):
    """Written lines, parsed again, that hold exactly the factors of their id."""
    _, model = fitted(spark, folder)
    path = scratch_path(spark, "factors")
    sinks.write_factors(model, path)
    out = []
    for side, factors in (
        ("userFeatures", recommend.user_factors(model)),
        ("productFeatures", recommend.item_factors(model)),
    ):
        numbers = P.split(P.regexp_extract("value", r"^\d+,\[(.*)\]$", 1), ", ")
        lines = spark.read.text(f"{path}/{side}").select(
            P.regexp_extract("value", r"^(\d+),", 1).cast("int").alias("id"),
            P.transform(numbers, lambda t: t.cast("float")).alias("written"),
        )
        same = P.col("written") == P.col("features")
        out.append(lines.join(factors, "id").agg(P.lit(side).alias("side"), P.count_if(same).alias("equal")))
    return out[0].unionAll(out[1])
