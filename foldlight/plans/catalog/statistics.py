"""Summary statistics and tests."""

from __future__ import annotations

import math

from pyspark.sql import functions as P

from foldlight.operators import reshape, stats
from foldlight.plans.catalog.registry import (
    SQL_FEATURES,
    SQL_LABEL,
    class_label,
    line_features,
    query,
    rounded,
)
from foldlight.sources.readers import table


def even_tail(x: str, degrees: int) -> str:
    """Upper chi-square tail for an even number of degrees, as SQL."""
    terms = " + ".join(f"({x} / 2) ** {i} / {float(math.factorial(i))}" for i in range(degrees // 2))
    return f"exp(-({x}) / 2) * ({terms})"


@query(
    "q1_column_stats",
    " UNION ALL ".join(
        f"""SELECT {i} AS feature, round(avg({f}), 8) AS mean, round(var_samp({f}), 8) AS variance,
        count(*) FILTER ({f} <> 0) AS non_zeros FROM lineitem"""
        for i, f in enumerate(SQL_FEATURES)
    ),
)
def q1_column_stats(spark, folder):
    out = stats.column_stats(line_features(spark, folder))
    return out.select("feature", *rounded(8, "mean", "variance"), "non_zeros")


def lines(spark, folder):
    return table(spark, folder, "lineitem")


SQL_RANKS = """
ranked AS (
  SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a,
    rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b,
    rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 AS c,
    rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2 AS d
  FROM lineitem)"""


@query(
    "q2_correlation_pearson",
    "SELECT round(corr(l_quantity, l_extendedprice), 8) + 0.0 AS correlation FROM lineitem",
)
def q2_correlation_pearson(spark, folder):
    out = stats.correlation(lines(spark, folder), "l_quantity", "l_extendedprice")
    return out.select(*rounded(8, "correlation"))


@query(
    "q2_correlation_spearman",
    f"WITH {SQL_RANKS} SELECT round(corr(a, b), 8) + 0.0 AS correlation FROM ranked",
)
def q2_correlation_spearman(spark, folder):
    out = stats.correlation(lines(spark, folder), "l_quantity", "l_extendedprice", "spearman")
    return out.select(*rounded(8, "correlation"))


def _matrix_sql(names: tuple[str, ...], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, round(corr({x}, {y}), 8) + 0.0 AS correlation FROM {source}"
        for i, x in enumerate(names)
        for j, y in enumerate(names)
    )


@query("q3_correlation_matrix_pearson", _matrix_sql(SQL_FEATURES, "lineitem"))
def q3_correlation_matrix_pearson(spark, folder):
    out = stats.correlation_matrix(line_features(spark, folder))
    return out.select("i", "j", *rounded(8, "correlation"))


@query(
    "q3_correlation_matrix_spearman",
    f"WITH {SQL_RANKS} {_matrix_sql(('a', 'b', 'c', 'd'), 'ranked')}",
)
def q3_correlation_matrix_spearman(spark, folder):
    out = stats.correlation_matrix(line_features(spark, folder), "spearman")
    return out.select("i", "j", *rounded(8, "correlation"))


@query(
    "q4_chi_square_fit_uniform",
    f"""WITH c AS (SELECT count(*) AS o FROM orders GROUP BY o_orderpriority),
    s AS (SELECT sum((o - m) ** 2 / m) AS x, count(*) - 1 AS degrees
          FROM c, (SELECT avg(o) AS m FROM c))
    SELECT round(x, 6) AS statistic, degrees, round({even_tail('x', 4)}, 8) AS p_value FROM s""",
)
def q4_chi_square_fit_uniform(spark, folder):
    test = stats.chi_square_fit(table(spark, folder, "orders"), "o_orderpriority")
    return test.select(*rounded(6, "statistic"), "degrees", *rounded(8, "p_value"))


@query(
    "q4_chi_square_fit_given",
    f"""WITH c AS (SELECT o_orderstatus, count(*) AS o FROM orders GROUP BY 1),
    e AS (SELECT o, CASE o_orderstatus WHEN 'F' THEN 0.33 WHEN 'O' THEN 0.34 ELSE 0.33 END
            * (SELECT sum(o) FROM c) AS e FROM c),
    s AS (SELECT sum((o - e) ** 2 / e) AS x, CAST(2 AS BIGINT) AS degrees FROM e)
    SELECT round(x, 6) AS statistic, degrees, round({even_tail('x', 2)}, 8) AS p_value FROM s""",
)
def q4_chi_square_fit_given(spark, folder):
    test = stats.chi_square_fit(
        table(spark, folder, "orders"), "o_orderstatus", {"F": 33, "O": 34, "P": 33}
    )
    return test.select(*rounded(6, "statistic"), "degrees", *rounded(8, "p_value"))


@query(
    "q5_chi_square_independence",
    f"""WITH c AS (SELECT o_orderstatus AS r, o_orderpriority AS c, count(*) AS o FROM orders GROUP BY ALL),
    e AS (SELECT o, sum(o) OVER (PARTITION BY r) * sum(o) OVER (PARTITION BY c) / sum(o) OVER () AS e FROM c),
    s AS (SELECT sum((o - e) ** 2 / e) AS x, CAST(8 AS BIGINT) AS degrees FROM e)
    SELECT round(x, 6) AS statistic, degrees, round({even_tail('x', 8)}, 8) AS p_value FROM s""",
)
def q5_chi_square_independence(spark, folder):
    test = stats.chi_square_independence(
        table(spark, folder, "orders"), "o_orderstatus", "o_orderpriority"
    )
    return test.select(*rounded(6, "statistic"), "degrees", *rounded(8, "p_value"))


BINS = (
    "l_quantity > 25",
    "l_extendedprice > 50000",
    "l_discount > 0.05",
    "l_tax > 0.04",
    "l_linenumber > 3",
    "l_partkey % 2 = 0",
    "l_suppkey % 2 = 0",
    "l_orderkey % 2 = 0",
)
SQL_BINARY_TESTS = "tests AS (" + " UNION ALL ".join(
    f"""SELECT {i} AS feature, sum((o - e) ** 2 / e) AS x FROM (
      SELECT o, sum(o) OVER (PARTITION BY l) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e
      FROM (SELECT {SQL_LABEL} AS l, {b} AS b, count(*) AS o FROM lineitem GROUP BY ALL))"""
    for i, b in enumerate(BINS)
) + ")"


def binary_features(spark, folder):
    return lines(spark, folder).select(
        class_label().alias("label"),
        P.array(*[P.expr(b).cast("double") for b in BINS]).alias("features"),
    )


@query(
    "q6_chi_square_features",
    f"""WITH {SQL_BINARY_TESTS}
    SELECT feature, round(x, 6) AS statistic, CAST(2 AS BIGINT) AS degrees,
      round({even_tail('x', 2)}, 8) AS p_value FROM tests""",
)
def q6_chi_square_features(spark, folder):
    tests = stats.chi_square_features(binary_features(spark, folder))
    return tests.select("feature", *rounded(6, "statistic"), "degrees", *rounded(8, "p_value"))


@query(
    "p12_significant",
    f"""WITH {SQL_BINARY_TESTS} SELECT feature FROM tests WHERE {even_tail('x', 2)} < 0.4""",
)
def p12_significant(spark, folder):
    tests = stats.chi_square_features(binary_features(spark, folder))
    return reshape.significant(tests, 0.4).select("feature")


@query(
    "q7_kolmogorov_smirnov",
    """WITH z AS (SELECT (c_acctbal - 4500.0) / 3200.0 AS z FROM customer),
    d AS (SELECT z, rank() OVER (ORDER BY z) - 1 AS below,
            count(*) OVER (ORDER BY z RANGE UNBOUNDED PRECEDING) AS upto, count(*) OVER () AS n FROM z),
    series AS (SELECT *, CASE WHEN z = 0 THEN 0.0 ELSE sign(z) * list_sum(list_transform(range(0, 60), lambda i:
            exp((2 * i + 1) * ln(abs(z)) - lgamma(2.0 * i + 2) + i * ln(2) + lgamma(i + 1.0)))) END AS s FROM d),
    f AS (SELECT *, 0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * s AS cdf FROM series)
    SELECT round(max(greatest(cdf - below / n, upto / n - cdf)), 7) AS statistic, max(n) AS rows FROM f""",
)
def q7_kolmogorov_smirnov(spark, folder):
    test = stats.kolmogorov_smirnov(
        table(spark, folder, "customer"), "c_acctbal", "norm", 4500.0, 3200.0
    )
    return test.select(*rounded(7, "statistic"), "rows")


POINTS = (-500.0, 0.0, 1000.0, 2500.0, 5000.0, 7500.0, 9999.0)


@query(
    "q8_kernel_density",
    f"""SELECT p AS point, round(avg(exp(-((((c_acctbal - p) / 300.0) ** 2) / 2))) / (300.0 * sqrt(2 * pi())), 10)
      AS density
    FROM customer CROSS JOIN (VALUES {', '.join(f'({p}::DOUBLE)' for p in POINTS)}) v(p) GROUP BY p""",
)
def q8_kernel_density(spark, folder):
    out = stats.kernel_density(table(spark, folder, "customer"), "c_acctbal", POINTS, 300.0)
    return out.select("point", *rounded(10, "density"))


SQL_T = "(mean0 - mean1) / sqrt(var0 / n0 + var1 / n1)"
SQL_DEGREES = (
    "(var0 / n0 + var1 / n1) ** 2 / ((var0 / n0) ** 2 / (n0 - 1) + (var1 / n1) ** 2 / (n1 - 1))"
)


def sql_t_p(t: str, v: str, steps: int = 2000) -> str:
    """Two-sided p of Student's t by Simpson's rule over its density."""
    return f"""(1 - 2 * exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2)) / sqrt({v} * pi())
      * abs({t}) / {3 * steps} * list_sum(list_transform(range(0, {steps + 1}), lambda i:
        (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
        * pow(1 + pow({t} * i / {steps}.0, 2) / {v}, -({v} + 1) / 2))))"""


SQL_WELCH = f"""
g AS (SELECT count(*) FILTER (event_type <> 'purchase')::DOUBLE AS n0,
    avg(value) FILTER (event_type <> 'purchase') AS mean0,
    var_samp(value) FILTER (event_type <> 'purchase') AS var0,
    count(*) FILTER (event_type = 'purchase')::DOUBLE AS n1,
    avg(value) FILTER (event_type = 'purchase') AS mean1,
    var_samp(value) FILTER (event_type = 'purchase') AS var1 FROM events),
welch AS (SELECT *, {SQL_T} AS t, {SQL_DEGREES} AS degrees FROM g)
SELECT CAST(n0 AS BIGINT) AS n0, CAST(n1 AS BIGINT) AS n1, round(mean0, 6) AS mean0,
  round(mean1, 6) AS mean1, round(var0, 6) AS var0, round(var1, 6) AS var1,
  round(t, 6) AS t, round(degrees, 4) AS degrees,
  round({sql_t_p('t', 'degrees')}, 6) AS p_value FROM welch"""


def welch_columns(df):
    return df.select(
        P.col("n0").cast("long").alias("n0"),
        P.col("n1").cast("long").alias("n1"),
        *rounded(6, "mean0", "mean1", "var0", "var1", "t", "p_value"),
        *rounded(4, "degrees"),
    )


@query("q9_welch_test", f"WITH {SQL_WELCH}")
def q9_welch_test(spark, folder):
    samples = table(spark, folder, "events").select(
        (P.col("event_type") == "purchase").alias("label"), "value"
    )
    return welch_columns(stats.welch_test(samples))
