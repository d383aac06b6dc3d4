"""The table of queries and the SQL snippets they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as P

from foldlight.sources.readers import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

FOLD_SEED = 77678969
LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where there is one, its SQL."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


def sql_hash(seed: int, *key: str) -> str:
    """DuckDB form of ``foldlight.functions.hashing.hash32``."""
    texts = ", ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', {texts})), 1, 8) AS BIGINT)"


def rounded(digits: int, *names: str) -> list[Column]:
    """Columns rounded for comparison; the sum with 0.0 turns -0.0 into 0.0."""
    return [(P.round(P.col(n), digits) + P.lit(0.0)).alias(n) for n in names]


def sql_rounded(digits: int, *names: str) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


# -- inputs shared by several queries -------------------------------------------------


def class_label(flag: str = "l_returnflag") -> Column:
    return P.when(P.col(flag) == "A", 0.0).when(P.col(flag) == "N", 1.0).otherwise(2.0)


SQL_LABEL = "CASE l_returnflag WHEN 'A' THEN 0.0::DOUBLE WHEN 'N' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END"


def ruled_lines(spark: SparkSession, folder: str, k: int = 10) -> DataFrame:
    """lineitem rows as (fold, label, prediction) with a fixed rule as the classifier."""
    from foldlight.operators.sampling import k_fold

    lines = k_fold(table(spark, folder, "lineitem"), k, FOLD_SEED, LINE_KEY)
    rule = (
        P.when(P.col("l_quantity") < 17, 0.0).when(P.col("l_linestatus") == "O", 1.0).otherwise(2.0)
    )
    return lines.select("fold", class_label().alias("label"), rule.alias("prediction"))


SQL_RULED = f"""
ruled AS (
  SELECT CAST({sql_hash(FOLD_SEED, *LINE_KEY)} % 10 AS INT) AS fold, {SQL_LABEL} AS label,
         CASE WHEN l_quantity < 17 THEN 0.0::DOUBLE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE
              ELSE 2.0::DOUBLE END AS prediction
  FROM lineitem)"""


def rated_events(spark: SparkSession, folder: str) -> DataFrame:
    """events as ratings, one row per event: (event_id, user, item, rating)."""
    return table(spark, folder, "events").select(
        "event_id",
        P.col("user_id").alias("user"),
        P.get_json_object("props", "$.k").cast("int").alias("item"),
        P.col("value").alias("rating"),
    )


SQL_RATED = """
rated AS (
  SELECT event_id, user_id AS "user", CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS item,
         value AS rating
  FROM events)"""


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """One rating per (user, item): the largest value."""
    return (
        rated_events(spark, folder).groupBy("user", "item").agg(P.max("rating").alias("rating"))
    )


SQL_RATINGS = SQL_RATED + """,
ratings AS (SELECT "user", item, max(rating) AS rating FROM rated GROUP BY ALL)"""


def recency(spark: SparkSession, folder: str) -> DataFrame:
    """A second rating of the same pairs: the latest event."""
    return (
        rated_events(spark, folder)
        .groupBy("user", "item")
        .agg(P.max("event_id").cast("double").alias("rating"))
    )


SQL_TOP = """
top AS (
  SELECT "user", item, rating,
         row_number() OVER (PARTITION BY "user" ORDER BY rating DESC, item) AS rank
  FROM (SELECT "user", item, CAST(max(event_id) AS DOUBLE) AS rating FROM rated GROUP BY ALL)
  QUALIFY rank <= 10)"""


def scored_events(spark: SparkSession, folder: str, folds: int = 5) -> DataFrame:
    """events as binary scores: (fold, label, score)."""
    from foldlight.operators.sampling import k_fold

    events = k_fold(table(spark, folder, "events"), folds, FOLD_SEED, ["event_id"])
    return events.select(
        "fold",
        (P.col("event_type") == "purchase").cast("double").alias("label"),
        P.col("value").alias("score"),
    )


SQL_CURVES = f"""
scored AS (
  SELECT CAST({sql_hash(FOLD_SEED, 'event_id')} % 5 AS INT) AS fold,
         CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
         value AS score
  FROM events),
counts AS (
  SELECT fold, score AS threshold, count(*) FILTER (label = 1) AS pos,
         count(*) FILTER (label = 0) AS neg
  FROM scored GROUP BY ALL),
sums AS (
  SELECT *, CAST(sum(pos) OVER down AS BIGINT) AS tp, CAST(sum(neg) OVER down AS BIGINT) AS fp,
         CAST(sum(pos) OVER whole AS BIGINT) AS positives,
         CAST(sum(neg) OVER whole AS BIGINT) AS negatives
  FROM counts
  WINDOW down AS (PARTITION BY fold ORDER BY threshold DESC), whole AS (PARTITION BY fold)),
rates AS (
  SELECT *, tp / (tp + fp) AS precision,
         CASE WHEN positives = 0 THEN 0.0 ELSE tp / positives END AS recall,
         CASE WHEN negatives = 0 THEN 0.0 ELSE fp / negatives END AS fpr
  FROM sums),
curves AS (
  SELECT *,
    CASE WHEN precision + recall = 0 THEN 0.0
         ELSE 2 * precision * recall / (precision + recall) END AS f1,
    CASE WHEN 4 * precision + recall = 0 THEN 0.0
         ELSE 5 * precision * recall / (4 * precision + recall) END AS f2
  FROM rates)"""


def line_features(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as a non-negative class-feature table with its key."""
    return table(spark, folder, "lineitem").select(
        *LINE_KEY,
        class_label().alias("label"),
        P.array(
            P.col("l_quantity"),
            P.col("l_extendedprice") / 1000.0,
            P.col("l_discount"),
            P.col("l_tax"),
        ).alias("features"),
    )


SQL_FEATURES = ("l_quantity", "l_extendedprice / 1000.0::DOUBLE", "l_discount", "l_tax")


def embedding_rows(spark: SparkSession, folder: str) -> DataFrame:
    """embeddings as (vec_id, label, features array<double>)."""
    return table(spark, folder, "embeddings").select(
        "vec_id",
        P.col("label").cast("double").alias("label"),
        P.col("embedding").cast("array<double>").alias("features"),
    )


def quality_rows(spark: SparkSession, folder: str) -> DataFrame:
    """documents with a quality label as (doc_id, label, features) of simple text counts."""
    docs = table(spark, folder, "documents").join(
        table(spark, folder, "labels").select("doc_id", "quality"), "doc_id"
    )
    words = P.regexp_count("text", P.lit(r"\S+")).cast("double")
    lines = P.regexp_count("text", P.lit(r"\n")).cast("double")
    digits = P.regexp_count("text", P.lit(r"[0-9]")).cast("double")
    marks = P.regexp_count("text", P.lit(r"[^\p{L}\p{N}\s]")).cast("double")
    chars = P.greatest(P.length("text"), P.lit(1))
    return docs.select(
        "doc_id",
        P.col("quality").cast("double").alias("label"),
        P.array(
            P.log1p(words), P.log1p(lines), digits / chars, marks / chars, words / chars
        ).alias("features"),
    )


def priced_rows(spark: SparkSession, folder: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """lineitem with its part as (label = price, features) for regressors, after the columns of ``keep``."""
    lines = table(spark, folder, "lineitem").select(
        *dict.fromkeys([*keep, "l_partkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice"])
    )
    parts = table(spark, folder, "part").select("p_partkey", "p_retailprice", "p_size")
    return lines.join(parts, P.col("l_partkey") == P.col("p_partkey")).select(
        *keep,
        (P.col("l_extendedprice") / 1000.0).alias("label"),
        P.array(
            P.col("l_quantity"),
            P.col("p_retailprice"),
            P.col("p_size").cast("double"),
            P.col("l_discount"),
            P.col("l_tax"),
        ).alias("features"),
    )
