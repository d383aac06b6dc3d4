"""Full-depth trees and the linear SVM checked by what their optimum implies."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as P

from foldlight.functions.vectors import as_vector, dot, doubles
from foldlight.operators import classify, forests, regress
from foldlight.plans.catalog.registry import LINE_KEY, priced_rows, quality_rows, query, sql_hash

SQL_LABELLED = "documents JOIN labels ON documents.doc_id = labels.doc_id"


@query(
    "r2_leaf_means",
    """SELECT count(*) AS rows, CAST(0 AS BIGINT) AS wrong, true AS deep
    FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def r2_leaf_means(spark, folder):
    """A tree of depth 5: each leaf predicts the mean of the rows that reach it."""
    rows = priced_rows(spark, folder)
    scored = regress.predict(regress.fit_decision_tree_regressor(rows), rows)
    leaves = scored.groupBy("prediction").agg(P.count(P.lit(1)).alias("n"), P.avg("label").alias("mean"))
    off = P.abs(P.col("mean") - P.col("prediction")) > 1e-6 * (1 + P.abs("mean"))
    return leaves.agg(
        P.sum("n").alias("rows"), P.count_if(off).alias("wrong"), (P.count(P.lit(1)) > 16).alias("deep")
    )


@query(
    "m6_leaf_shares",
    f"SELECT count(*) AS rows, CAST(0 AS BIGINT) AS wrong FROM {SQL_LABELLED}",
)
def m6_leaf_shares(spark, folder):
    """A tree of depth 5: each leaf gives the share of class 1 among the rows that reach it."""
    rows = quality_rows(spark, folder)
    scored = classify.score(classify.fit_decision_tree_classifier(rows), rows)
    leaves = scored.groupBy("score").agg(P.count(P.lit(1)).alias("n"), P.avg("label").alias("share"))
    off = P.abs(P.col("share") - P.col("score")) > 1e-9
    return leaves.agg(P.sum("n").alias("rows"), P.count_if(off).alias("wrong"))


@query(
    "m4_no_step_improves",
    f"SELECT CAST(12 AS BIGINT) AS steps, CAST(0 AS BIGINT) AS better, count(*) AS rows FROM {SQL_LABELLED}",
)
def m4_no_step_improves(spark, folder):
    """Linear SVM: the hinge loss with its penalty, which is convex, is not lower a step away
    in any weight or the intercept."""
    rows = quality_rows(spark, folder)
    model = classify.fit_linear_svm(rows, iterations=100)
    reg = model.getRegParam()
    weights, bias = [float(w) for w in model.coefficients], float(model.intercept)
    x = P.col("features")
    spread = rows.agg(*[P.stddev(x[j]).alias(f"s{j}") for j in range(len(weights))]).first()
    places = [(weights, bias)]
    for step in (0.05, -0.05):
        for j, s in enumerate(spread):
            places.append(([w + step / s if i == j else w for i, w in enumerate(weights)], bias))
        places.append((weights, bias + step))
    sign = 2 * P.col("label") - 1

    def objective(w, b):
        loss = P.avg(P.greatest(P.lit(0.0), 1 - sign * (dot(x, doubles(w)) + b)))
        return loss + reg / 2 * sum((v * s) ** 2 for v, s in zip(w, spread, strict=True))

    values = rows.agg(
        *[objective(w, b).alias(f"o{i}") for i, (w, b) in enumerate(places)], P.count(P.lit(1)).alias("rows")
    )
    better = sum(
        ((P.col(f"o{i}") < P.col("o0") * (1 - 1e-3)).cast("long") for i in range(1, len(places))), P.lit(0).cast("long")
    )
    return values.select(P.lit(len(places) - 1).cast("long").alias("steps"), better.alias("better"), "rows")


FOREST_SEED, FOREST_TREES = 12345, 3


def sql_drawn(rows: str, key: list[str], value: str) -> str:
    """Per tree: rows drawn, draws and the drawn total of ``value``, which its leaves must give back."""
    number = sql_hash(FOREST_SEED, "tree", *key)
    steps = " + ".join(f"CAST(h >= {s} AS BIGINT)" for s in forests.poisson_steps())
    return f"""WITH hashed AS (SELECT tree, {value} AS v, {number} AS h
      FROM {rows}, (SELECT unnest(range({FOREST_TREES})) AS tree)),
    drawn AS (SELECT tree, v, {steps} AS w FROM hashed)
    SELECT CAST(tree AS INT) AS tree, count(*) AS rows, CAST(sum(w) AS BIGINT) AS drawn,
      round(CAST(sum(w * v) AS DOUBLE), 2) AS total, CAST(0 AS BIGINT) AS wrong
    FROM drawn WHERE w > 0 GROUP BY tree"""


def drawn_leaves(forest: forests.HashedForest, df: DataFrame, value) -> DataFrame:
    """The same from the trees: totals of the leaf values, and leaves that are not the mean of their draws."""
    n = P.col("_draws")

    def per_tree(t: int) -> DataFrame:
        scored = forest.trees[t].transform(forest.drawn(df, t)).withColumn("value", value)
        leaves = scored.groupBy("value").agg(
            P.count(P.lit(1)).alias("rows"), P.sum(n).alias("drawn"), P.sum(n * P.col("label")).alias("own")
        )
        off = P.abs(P.col("own") / P.col("drawn") - P.col("value")) > 1e-6 * (1 + P.abs("value"))
        return leaves.agg(
            P.lit(t).alias("tree"),
            P.sum("rows").alias("rows"),
            P.sum("drawn").alias("drawn"),
            P.round(P.sum(P.col("value") * P.col("drawn")), 2).alias("total"),
            P.count_if(off).alias("wrong"),
        )

    return reduce(DataFrame.unionByName, [per_tree(t) for t in range(len(forest.trees))])


@query(
    "r3_leaves_of_hashed_forest",
    sql_drawn("lineitem JOIN part ON l_partkey = p_partkey", LINE_KEY, "l_extendedprice / 1000.0"),
)
def r3_leaves_of_hashed_forest(spark, folder):
    """Three trees of depth 4 over draws by row key: SQL draws the rows again."""
    rows = as_vector(priced_rows(spark, folder, tuple(LINE_KEY)))
    forest = forests.fit_hashed_forest_regressor(rows, LINE_KEY, FOREST_TREES, seed=FOREST_SEED)
    return drawn_leaves(forest, rows, P.col("prediction"))


@query("m1_leaves_of_hashed_forest", sql_drawn(SQL_LABELLED, ["documents.doc_id"], "labels.quality"))
def m1_leaves_of_hashed_forest(spark, folder):
    """Three trees of depth 5: the shares of class 1 add up to the class-1 draws that SQL counts."""
    rows = as_vector(quality_rows(spark, folder))
    forest = forests.fit_hashed_forest_classifier(rows, ["doc_id"], FOREST_TREES, seed=FOREST_SEED)
    return drawn_leaves(forest, rows, vector_to_array("probability")[1])
