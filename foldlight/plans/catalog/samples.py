"""Folds, splits and samples of orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as P

from foldlight.operators import reshape, sampling
from foldlight.plans.catalog.registry import FOLD_SEED, LINE_KEY, query, sql_hash
from foldlight.sources.readers import table

ORDER_HASH = sql_hash(FOLD_SEED, "o_orderkey")
FRACTIONS = {"1-URGENT": 0.1, "2-HIGH": 0.6, "3-MEDIUM": 0.3}
SQL_FRACTION = """CASE o_orderpriority WHEN '1-URGENT' THEN 0.1::DOUBLE WHEN '2-HIGH' THEN 0.6::DOUBLE
  WHEN '3-MEDIUM' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END"""


@query("f1_k_fold", f"SELECT o_orderkey, CAST({ORDER_HASH} % 10 AS INT) AS fold FROM orders")
def f1_k_fold(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    return sampling.k_fold(orders, 10, FOLD_SEED, ["o_orderkey"])


@query(
    "f2_random_split",
    f"""SELECT o_orderkey,
      CASE WHEN {sql_hash(11, 'o_orderkey')} / 4294967296.0::DOUBLE >= 0.6 THEN 1 ELSE 0 END AS split
    FROM orders""",
)
def f2_random_split(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    return sampling.random_split(orders, [0.6, 0.4], 11, ["o_orderkey"])


@query(
    "f3_sample_fraction",
    f"""SELECT o_orderkey, o_orderstatus FROM orders
    WHERE {sql_hash(11, 'o_orderkey')} / 4294967296.0::DOUBLE < 0.6""",
)
def f3_sample_fraction(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.sample_fraction(orders, 0.6, 11, ["o_orderkey"])


@query(
    "f4_stratified_sample",
    f"""SELECT o_orderkey, o_orderpriority FROM orders
    WHERE {ORDER_HASH} / 4294967296.0::DOUBLE < {SQL_FRACTION}""",
)
def f4_stratified_sample(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.stratified_sample(
        orders, "o_orderpriority", FRACTIONS, FOLD_SEED, ["o_orderkey"]
    )


@query(
    "f5_stratified_sample_exact",
    f"""SELECT o_orderkey, o_orderpriority FROM (
      SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {ORDER_HASH}, o_orderkey) AS r,
             count(*) OVER (PARTITION BY o_orderpriority) AS n
      FROM orders)
    WHERE r <= ceil({SQL_FRACTION} * n)""",
)
def f5_stratified_sample_exact(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.stratified_sample_exact(
        orders, "o_orderpriority", FRACTIONS, FOLD_SEED, ["o_orderkey"]
    )


@query(
    "a4_fold_counts",
    f"""SELECT fold, n AS validation_rows, CAST(sum(n) OVER () - n AS BIGINT) AS training_rows
    FROM (SELECT CAST({sql_hash(FOLD_SEED, *LINE_KEY)} % 10 AS INT) AS fold, count(*) AS n
          FROM lineitem GROUP BY 1)""",
)
def a4_fold_counts(spark, folder):
    lines = table(spark, folder, "lineitem").select(*LINE_KEY)
    return reshape.fold_counts(sampling.k_fold(lines, 10, FOLD_SEED, LINE_KEY))


@query(
    "j3_holdout_rest",
    f"""WITH t AS (SELECT *, {sql_hash(11, *LINE_KEY)} / 4294967296.0::DOUBLE AS u FROM lineitem),
    s AS (SELECT DISTINCT l_partkey, l_linenumber, l_returnflag FROM t WHERE u < 0.3)
    SELECT l_returnflag, l_linenumber, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts
    FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.l_partkey = t.l_partkey
      AND s.l_linenumber = t.l_linenumber AND s.l_returnflag = t.l_returnflag)
    GROUP BY ALL""",
)
def j3_holdout_rest(spark, folder):
    lines = table(spark, folder, "lineitem")
    columns = ["l_partkey", "l_linenumber", "l_returnflag"]
    sample = sampling.sample_fraction(lines, 0.3, 11, LINE_KEY).select(*columns)
    rest = reshape.holdout_rest(lines.select(*columns), sample)
    return rest.groupBy("l_returnflag", "l_linenumber").agg(
        P.count(P.lit(1)).alias("n"), P.sum("l_partkey").alias("parts")
    )
