"""Feature transforms."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as P

from foldlight.operators import features, stats
from foldlight.plans.catalog.registry import (
    LINE_KEY,
    embedding_rows,
    line_features,
    query,
    rounded,
)
from foldlight.sources.readers import table

SQL_INDEX = """
counts AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1),
indexed AS (SELECT label, n, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS DOUBLE) AS i
  FROM counts)"""


def priorities(spark, folder):
    return table(spark, folder, "orders").select(P.col("o_orderpriority").alias("label"))


@query("t1_index_labels", f"WITH {SQL_INDEX} SELECT label, i AS indexed_label, n FROM indexed")
def t1_index_labels(spark, folder):
    _, indexed = features.index_labels(priorities(spark, folder))
    return indexed.groupBy("label", "indexed_label").agg(P.count(P.lit(1)).alias("n"))


@query(
    "t3_restore_labels",
    f"WITH {SQL_INDEX} SELECT i AS prediction, label AS predicted_label, n FROM indexed",
)
def t3_restore_labels(spark, folder):
    model, indexed = features.index_labels(priorities(spark, folder))
    predicted = indexed.withColumnRenamed("indexed_label", "prediction")
    restored = features.restore_labels(predicted, model.labels)
    return restored.groupBy("prediction", "predicted_label").agg(P.count(P.lit(1)).alias("n"))


SIGNED = "(l_partkey % 4) * 2 - 2"
PLAIN = "l_linenumber % 3 + 5"


@query(
    "t2_index_features",
    f"""WITH v AS (SELECT CAST({SIGNED} AS DOUBLE) AS a, CAST({PLAIN} AS DOUBLE) AS b,
        l_quantity AS c FROM lineitem),
    ia AS (SELECT a, row_number() OVER (ORDER BY a <> 0, a) - 1 AS i FROM (SELECT DISTINCT a FROM v)),
    ib AS (SELECT b, row_number() OVER (ORDER BY b <> 0, b) - 1 AS i FROM (SELECT DISTINCT b FROM v))
    SELECT v.a, v.b, CAST(ia.i AS DOUBLE) AS ia, CAST(ib.i AS DOUBLE) AS ib, v.c AS ic, count(*) AS n
    FROM v JOIN ia ON ia.a = v.a JOIN ib ON ib.b = v.b GROUP BY ALL""",
)
def t2_index_features(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        P.array(
            P.expr(SIGNED).cast("double"), P.expr(PLAIN).cast("double"), P.col("l_quantity")
        ).alias("features")
    )
    _, indexed = features.index_features(lines, 4)
    old, new = vector_to_array("features"), vector_to_array("indexed_features")
    return indexed.groupBy(
        old[0].alias("a"),
        old[1].alias("b"),
        new[0].alias("ia"),
        new[1].alias("ib"),
        new[2].alias("ic"),
    ).agg(P.count(P.lit(1)).alias("n"))


@query(
    "t5_elementwise_product",
    """SELECT l_linenumber, sum(l_quantity * 2)::DOUBLE AS f0, round(sum(l_extendedprice / 1000.0::DOUBLE * -1), 6) AS f1,
      0.0::DOUBLE AS f2, round(sum(l_tax * 0.5::DOUBLE), 6) AS f3 FROM lineitem GROUP BY 1""",
)
def t5_elementwise_product(spark, folder):
    scaled = features.elementwise_product(line_features(spark, folder), [2, -1, 0, 0.5])
    f = vector_to_array("product")
    sums = scaled.groupBy("l_linenumber").agg(
        *[P.sum(f[i]).alias(f"f{i}") for i in range(4)]
    )
    return sums.select("l_linenumber", *rounded(6, "f0", "f1", "f2", "f3"))


BINNED = (
    "floor(l_quantity / 13)",
    "floor(l_extendedprice / 26000)",
    "floor(l_discount * 100 / 3)",
    "floor(l_tax * 100 / 2.5)",
    "l_linenumber % 4",
    "l_partkey % 4",
    "l_suppkey % 4",
    "l_orderkey % 4",
)


@query(
    "t6_select_by_chi_square",
    "WITH "
    + ", ".join(
        f"""t{i} AS (SELECT {i} AS feature, sum((o - e) ** 2 / e) AS x, count(DISTINCT b) AS bins FROM (
        SELECT b, o, sum(o) OVER (PARTITION BY l) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e
        FROM (SELECT l_returnflag AS l, {b} AS b, count(*) AS o FROM lineitem GROUP BY ALL)))"""
        for i, b in enumerate(BINNED)
    )
    + ", tests AS ("
    + " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(len(BINNED)))
    + """)
    SELECT feature FROM tests
    ORDER BY exp(-x / 2) * (1 + x / 2
      + CASE WHEN bins > 3 THEN (x / 2) ** 2 / 2 ELSE 0 END
      + CASE WHEN bins > 4 THEN (x / 2) ** 3 / 6 ELSE 0 END) LIMIT 5""",
)
def t6_select_by_chi_square(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        P.when(P.col("l_returnflag") == "A", 0.0)
        .when(P.col("l_returnflag") == "N", 1.0)
        .otherwise(2.0)
        .alias("label"),
        P.array(*[P.expr(b).cast("double") for b in BINNED]).alias("features"),
    )
    model, _ = features.select_by_chi_square(lines, 5)
    return spark.createDataFrame([(i,) for i in model.selectedFeatures], "feature int")


# closed form for two features: the angle of the first axis of [[a, b], [b, c]]
AXES = """
axes AS (
  SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b ** 2) AS l1,
    (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b ** 2) AS l2 FROM m),
ends AS (SELECT *, sqrt(b ** 2 + (l1 - a) ** 2) AS w1, sqrt(b ** 2 + (l2 - a) ** 2) AS w2 FROM axes),
raw AS (
  SELECT 0 AS component, l1 AS l, b / w1 AS x, (l1 - a) / w1 AS y FROM ends
  UNION ALL SELECT 1, l2, b / w2, (l2 - a) / w2 FROM ends),
signed AS (
  SELECT component, l, CASE WHEN (CASE WHEN abs(x) >= abs(y) THEN x ELSE y END) < 0 THEN -1 ELSE 1 END AS s,
    x, y FROM raw)"""
SQL_PCA = f"""
m AS (SELECT var_samp(l_quantity) AS a, covar_samp(l_quantity, l_extendedprice / 2000.0) AS b,
        var_samp(l_extendedprice / 2000.0) AS c FROM lineitem), {AXES}"""
SQL_GRAM = f"""
m AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_quantity * (l_extendedprice / 2000.0)) AS b,
        sum((l_extendedprice / 2000.0) ** 2) AS c FROM lineitem), {AXES}"""


def two_features(spark, folder):
    return table(spark, folder, "lineitem").select(
        *LINE_KEY,
        P.array(P.col("l_quantity"), P.col("l_extendedprice") / 2000.0).alias("features"),
    )


@query(
    "t7_principal_components",
    f"""WITH {SQL_PCA}
    SELECT 0 AS feature, component, round(s * x, 6) + 0.0 AS loading FROM signed
    UNION ALL SELECT 1, component, round(s * y, 6) + 0.0 FROM signed""",
)
def t7_principal_components(spark, folder):
    _, table_ = features.principal_components(two_features(spark, folder), 2)
    return table_.select("feature", "component", *rounded(6, "loading"))


@query(
    "t8_project",
    f"""WITH {SQL_PCA},
    p AS (SELECT l_linenumber, component, s * (x * l_quantity + y * l_extendedprice / 2000.0) AS v
          FROM lineitem, signed)
    SELECT l_linenumber, round(avg(v) FILTER (component = 0), 5) + 0.0 AS mean0,
      round(avg(v) FILTER (component = 1), 5) + 0.0 AS mean1 FROM p GROUP BY 1""",
)
def t8_project(spark, folder):
    rows = two_features(spark, folder)
    model, _ = features.principal_components(rows, 2)
    projected = features.project(rows, model)
    p = P.col("projected")
    means = projected.groupBy("l_linenumber").agg(
        P.avg(p[0]).alias("mean0"), P.avg(p[1]).alias("mean1")
    )
    return means.select("l_linenumber", *rounded(5, "mean0", "mean1"))


@query(
    "t9_singular_values",
    f"""WITH {SQL_GRAM} SELECT component, round(sqrt(l), 4) AS singular_value,
      round(s * x, 6) + 0.0 AS v0, round(s * y, 6) + 0.0 AS v1 FROM signed""",
)
def t9_singular_values(spark, folder):
    _, values, right = features.singular_values(two_features(spark, folder), 2)
    vectors = right.groupBy("component").agg(
        *[P.max(P.when(P.col("feature") == f, P.col("loading"))).alias(f"v{f}") for f in (0, 1)]
    )
    return values.join(vectors, "component").select(
        "component", *rounded(4, "singular_value"), *rounded(6, "v0", "v1")
    )


@query(
    "t9_left_vectors",
    f"""WITH {SQL_GRAM},
    u AS (SELECT l_linenumber, component, s * (x * l_quantity + y * l_extendedprice / 2000.0) / sqrt(l) AS u
          FROM lineitem, signed)
    SELECT l_linenumber, round(sum(u) FILTER (component = 0), 6) + 0.0 AS sum0,
      round(sum(u * u) FILTER (component = 1), 6) + 0.0 AS square1 FROM u GROUP BY 1""",
)
def t9_left_vectors(spark, folder):
    left, _, _ = features.singular_values(two_features(spark, folder), 2)
    u = P.col("u")
    sums = left.groupBy("l_linenumber").agg(
        P.sum(u[0]).alias("sum0"), P.sum(u[1] * u[1]).alias("square1")
    )
    return sums.select("l_linenumber", *rounded(6, "sum0", "square1"))


@query(
    "t7_embedding_components",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
    SELECT round(sum(s), 6) AS total_variance, CAST(64 AS BIGINT) AS components, 64.0::DOUBLE AS squares
    FROM (SELECT var_samp(v) AS s FROM e GROUP BY i)""",
)
def t7_embedding_components(spark, folder):
    """All 64 axes: unit length each; the variances along them add up to the total variance."""
    rows = embedding_rows(spark, folder)
    model, loadings = features.principal_components(rows, 64)
    squares = P.sum(P.col("loading") * P.col("loading")).alias("squares")
    lengths = loadings.agg(P.count_distinct("component").alias("components"), squares)
    spread = stats.column_stats(features.project(rows, model), "projected")
    total = spread.agg(P.sum("variance")).scalar()
    return lengths.select(
        P.round(total, 6).alias("total_variance"), "components", *rounded(6, "squares")
    )


@query("t10_reduce_features")
def t10_reduce_features(spark, folder):
    reduced = features.reduce_features(embedding_rows(spark, folder), 8)
    return reduced.select("vec_id", "label", P.posexplode("features").alias("component", "value"))
