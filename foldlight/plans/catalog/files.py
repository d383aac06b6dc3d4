"""Text sources and sinks: tables go out as text, come back through a reader, and are compared."""

from __future__ import annotations

from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    LinearSVCModel,
    LogisticRegressionModel,
    NaiveBayesModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegressionModel, LinearRegressionModel
from pyspark.sql import functions as P

from foldlight.functions.vectors import as_vector
from foldlight.operators import classify, recommend, regress, reshape
from foldlight.plans.catalog.checked_models import prices, user_item_ratings
from foldlight.plans.catalog.registry import (
    SQL_FEATURES,
    SQL_LABEL,
    SQL_RATED,
    SQL_RULED,
    line_features,
    query,
    quality_rows,
    rated_events,
    ruled_lines,
)
from foldlight.session import scratch_path
from foldlight.sources import readers, sinks
from foldlight.sources.readers import table

SQL_LINES = f"""SELECT {SQL_LABEL} AS label, count(*) AS n,
  {', '.join(f'round(sum({f}), 5) AS f{i}' for i, f in enumerate(SQL_FEATURES))}
FROM lineitem GROUP BY 1"""


def as_text(df, spark, name):
    path = scratch_path(spark, name)
    df.write.text(path)
    return path


def numbers(*columns, sep=" "):
    return P.concat_ws(sep, *[P.col(c).cast("string") for c in columns])


def flat_lines(spark, folder):
    f = P.col("features")
    return line_features(spark, folder).select("label", *[f[i].alias(f"f{i}") for i in range(4)])


def line_sums(df, by=("label",)):
    f = P.col("features")
    return df.groupBy(*by).agg(
        P.count(P.lit(1)).alias("n"),
        *[P.round(P.sum(f[i]), 5).alias(f"f{i}") for i in range(4)],
    )


@query("s1_read_class_features", SQL_LINES)
def s1_read_class_features(spark, folder):
    path = scratch_path(spark, "class-features")
    flat = flat_lines(spark, folder).withColumnRenamed("label", "ClassId")
    flat.write.option("header", True).csv(path)
    return line_sums(readers.read_class_features(spark, path))


@query(
    "s2_read_feature_vectors",
    f"""SELECT count(*) AS n, {', '.join(f'round(sum({f}), 5) AS f{i}' for i, f in enumerate(SQL_FEATURES))}
    FROM lineitem""",
)
def s2_read_feature_vectors(spark, folder):
    path = scratch_path(spark, "class-features")
    flat = flat_lines(spark, folder).withColumnRenamed("label", "ClassId")
    flat.write.option("header", True).csv(path)
    return line_sums(readers.read_feature_vectors(spark, path), ())


def _libsvm(spark, folder):
    path = scratch_path(spark, "libsvm")
    as_vector(line_features(spark, folder)).select("label", "features").write.format(
        "libsvm"
    ).save(path)
    return path


@query("s3_read_libsvm", SQL_LINES)
def s3_read_libsvm(spark, folder):
    rows = readers.read_libsvm(spark, _libsvm(spark, folder), num_features=4)
    return line_sums(rows.withColumn("features", vector_to_array("features")))


@query("s4_read_libsvm_dense", SQL_LINES)
def s4_read_libsvm_dense(spark, folder):
    return line_sums(readers.read_libsvm(spark, _libsvm(spark, folder), 4, dense=True))


@query(
    "s5_read_number_rows",
    f"""SELECT count(*) AS n, {', '.join(f'round(sum({f}), 5) AS f{i}' for i, f in enumerate(SQL_FEATURES))}
    FROM lineitem""",
)
def s5_read_number_rows(spark, folder):
    flat = flat_lines(spark, folder)
    path = as_text(flat.select(numbers("f0", "f1", "f2", "f3").alias("value")), spark, "numbers")
    return line_sums(readers.read_number_rows(spark, path), ())


@query("s6_read_label_comma_numbers", SQL_LINES)
def s6_read_label_comma_numbers(spark, folder):
    flat = flat_lines(spark, folder)
    line = P.concat_ws(",", P.col("label").cast("string"), numbers("f0", "f1", "f2", "f3"))
    path = as_text(flat.select(line.alias("value")), spark, "label-numbers")
    return line_sums(readers.read_label_comma_numbers(spark, path))


@query(
    "s7_read_ratings",
    f"""WITH {SQL_RATED} SELECT CAST("user" AS INT) AS "user", item, count(*) AS n,
      round(sum(rating), 4) AS total FROM rated GROUP BY ALL""",
)
def s7_read_ratings(spark, folder):
    rated = rated_events(spark, folder)
    line = numbers("user", "item", "rating", "event_id", sep="::")
    path = as_text(rated.select(line.alias("value")), spark, "ratings")
    return readers.read_ratings(spark, path, "::").groupBy("user", "item").agg(
        P.count(P.lit(1)).alias("n"), P.round(P.sum("rating"), 4).alias("total")
    )


@query(
    "s8_read_baskets",
    """SELECT len(codes) AS size, codes[1] AS first, count(*) AS n FROM (
      SELECT list_sort(list_distinct(list('p' || (l_partkey % 20)))) AS codes FROM lineitem GROUP BY l_orderkey)
    GROUP BY ALL""",
)
def s8_read_baskets(spark, folder):
    lines = table(spark, folder, "lineitem")
    codes = P.collect_set(P.concat(P.lit("p"), P.col("l_partkey") % 20))
    baskets = lines.groupBy("l_orderkey").agg(P.array_sort(codes).alias("items"))
    path = as_text(baskets.select(P.array_join("items", " ").alias("value")), spark, "baskets")
    items = P.col("items")
    return readers.read_baskets(spark, path).groupBy(
        P.size(items).cast("long").alias("size"), items[0].alias("first")
    ).agg(P.count(P.lit(1)).alias("n"))


@query(
    "k1_write_factors",
    """SELECT 'productFeatures' AS side, count(DISTINCT props) AS lines, CAST(10 AS BIGINT) AS numbers FROM events
    UNION ALL SELECT 'userFeatures', count(DISTINCT user_id), 10 FROM events""",
)
def k1_write_factors(spark, folder):
    model = recommend.fit_als(user_item_ratings(spark, folder), rank=10, iterations=10, reg=0.1)
    path = scratch_path(spark, "factors")
    sinks.write_factors(model, path)
    inside = P.regexp_extract("value", r"^\d+,\[(.*)\]$", 1)

    def side(name):
        return spark.read.text(f"{path}/{name}").agg(
            P.lit(name).alias("side"),
            P.count(P.lit(1)).alias("lines"),
            P.max(P.size(P.split(inside, ", "))).cast("long").alias("numbers"),
        )

    return side("userFeatures").unionAll(side("productFeatures"))


@query(
    "k2_save_and_load_model",
    """WITH q AS (SELECT count(*) AS n FROM documents JOIN labels ON documents.doc_id = labels.doc_id),
    l AS (SELECT count(*) AS n FROM lineitem)
    SELECT model, CASE WHEN lines THEN l.n ELSE q.n END AS rows, CAST(0 AS BIGINT) AS differences
    FROM q, l, (VALUES ('logistic', false), ('svm', false), ('bayes', false), ('tree', false),
      ('linear', true), ('isotonic', true)) v(model, lines)""",
)
def k2_save_and_load_model(spark, folder):
    docs = as_vector(quality_rows(spark, folder)).select("label", "features")
    lines = as_vector(prices(spark, folder)).select("label", "features")
    one = lines.withColumn("feature", P.col("label"))
    fitted = [
        ("logistic", docs, classify.fit_logistic_regression(docs), LogisticRegressionModel),
        ("svm", docs, classify.fit_linear_svm(docs, 20), LinearSVCModel),
        ("bayes", docs, classify.fit_naive_bayes(docs), NaiveBayesModel),
        ("tree", docs, classify.fit_decision_tree_classifier(docs), DecisionTreeClassificationModel),
        ("linear", lines, regress.fit_linear_regression(lines), LinearRegressionModel),
        ("isotonic", one, regress.fit_isotonic(one), IsotonicRegressionModel),
    ]
    result = None
    for name, rows, model, kind in fitted:
        path = scratch_path(spark, name)
        sinks.save_model(model, path)
        again = sinks.load_model(kind, path)
        again.setPredictionCol("again")
        both = model.transform(rows).select(*rows.columns, "prediction")
        checked = again.transform(both).agg(
            P.lit(name).alias("model"),
            P.count(P.lit(1)).alias("rows"),
            P.count_if(P.col("again") != P.col("prediction")).alias("differences"),
        )
        result = checked if result is None else result.unionAll(checked)
    return result


@query(
    "k3_write_report",
    f"""WITH {SQL_RULED} SELECT fold, label, prediction, count(*) AS n FROM ruled
    WHERE label <> prediction GROUP BY ALL""",
)
def k3_write_report(spark, folder):
    wrong = reshape.errors(ruled_lines(spark, folder))
    report = wrong.groupBy("fold", "label", "prediction").agg(P.count(P.lit(1)).alias("n"))
    path = scratch_path(spark, "report")
    sinks.write_report(report, path)
    return spark.read.parquet(path)
