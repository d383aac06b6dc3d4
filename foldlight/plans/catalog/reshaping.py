"""Projections, filters, joins and rating lists."""

from __future__ import annotations

from pyspark.sql import functions as P

from foldlight.operators import evaluate, recommend, reshape, running, sampling
from foldlight.plans.catalog.registry import (
    FOLD_SEED,
    LINE_KEY,
    SQL_FEATURES,
    SQL_LABEL,
    SQL_RATED,
    SQL_RATINGS,
    SQL_RULED,
    SQL_TOP,
    class_label,
    embedding_rows,
    line_features,
    query,
    rated_events,
    ratings,
    recency,
    rounded,
    ruled_lines,
    sql_hash,
    sql_rounded,
)
from foldlight.session import scratch_path
from foldlight.sources.readers import read_class_features, table

LIKED = 12.0


def top_lists(spark, folder):
    """Top 10 items of each user as arrays."""
    top = recommend.top_items(recency(spark, folder), 10)
    packed = P.sort_array(P.collect_list(P.struct("rank", "item", "rating")))
    return top.groupBy("user").agg(
        P.transform(
            packed, lambda r: P.struct(r["item"].alias("item"), r["rating"].alias("rating"))
        ).alias("recommendations")
    )


@query(
    "p1_center_rating",
    f"""WITH {SQL_RATED} SELECT event_id, round(rating - 2.5, 6) + 0.0 AS rating FROM rated""",
)
def p1_center_rating(spark, folder):
    centred = reshape.center_rating(rated_events(spark, folder), 2.5)
    return centred.select("event_id", *rounded(6, "rating"))


@query(
    "p2_binarize_rating",
    f"""WITH {SQL_RATED}
    SELECT event_id, CASE WHEN rating - 2.5::DOUBLE > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rating
    FROM rated""",
)
def p2_binarize_rating(spark, folder):
    centred = reshape.center_rating(rated_events(spark, folder), 2.5)
    return reshape.binarize_rating(centred).select("event_id", "rating")


@query(
    "p3_clamp_recommendations",
    f"""WITH {SQL_RATED}, {SQL_TOP}
    SELECT "user", item, CAST(rank AS INT) AS rank, greatest(least(rating, 5000.0::DOUBLE), 100.0::DOUBLE) AS rating
    FROM top""",
)
def p3_clamp_recommendations(spark, folder):
    clamped = reshape.clamp_recommendations(top_lists(spark, folder), 100.0, 5000.0)
    return reshape.explode_recommendations(clamped).select("user", "item", "rank", "rating")


@query(
    "p4_discretize",
    f"""SELECT l_returnflag, CAST(floor(l_quantity / 16) AS BIGINT) AS f0,
      CAST(floor({SQL_FEATURES[1]} / 16) AS BIGINT) AS f1, count(*) AS n
    FROM lineitem GROUP BY ALL""",
)
def p4_discretize(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_returnflag",
        P.array(P.col("l_quantity"), P.col("l_extendedprice") / 1000.0).alias("features"),
    )
    binned = reshape.discretize(lines, 16.0)
    f = P.col("features")
    return binned.groupBy(
        "l_returnflag", f[0].cast("long").alias("f0"), f[1].cast("long").alias("f1")
    ).agg(P.count(P.lit(1)).alias("n"))


@query(
    "p5_append_bias",
    f"""SELECT {SQL_LABEL} AS label, count(*) AS n, CAST(5 * count(*) AS BIGINT) AS sizes,
      CAST(count(*) AS DOUBLE) AS last, round(sum(l_quantity), 2) AS first
    FROM lineitem GROUP BY 1""",
)
def p5_append_bias(spark, folder):
    biased = reshape.append_bias(line_features(spark, folder))
    return biased.groupBy("label").agg(
        P.count(P.lit(1)).alias("n"),
        P.sum(P.size("features")).alias("sizes"),
        P.sum(P.element_at("features", -1)).alias("last"),
        P.round(P.sum(P.col("features")[0]), 2).alias("first"),
    )


@query(
    "p6_file_row_id",
    f"""SELECT row_number() OVER (ORDER BY {', '.join(LINE_KEY)}) - 1 AS row_id,
      {SQL_LABEL} AS label, l_quantity AS quantity FROM lineitem""",
)
def p6_file_row_id(spark, folder):
    """lineitem in key order as a class-feature file without a key, numbered when read back."""
    path = scratch_path(spark, "class-features")
    lines = table(spark, folder, "lineitem").orderBy(*LINE_KEY)
    text = P.concat_ws(",", class_label().cast("string"), P.col("l_quantity").cast("string"))
    lines.select(text.alias("value")).write.text(path)
    rows = running.with_file_row_id(read_class_features(spark, path))
    return rows.select("row_id", "label", P.col("features")[0].alias("quantity"))


@query(
    "f1_fold_of_file_rows",
    f"""WITH numbered AS (
      SELECT row_number() OVER (ORDER BY {', '.join(LINE_KEY)}) - 1 AS row_id FROM lineitem)
    SELECT CAST({sql_hash(FOLD_SEED, 'row_id')} % 10 AS INT) AS fold, count(*) AS n
    FROM numbered GROUP BY 1""",
)
def f1_fold_of_file_rows(spark, folder):
    """Sizes of the ten folds that the class-feature jobs make of a file."""
    folded = sampling.k_fold(p6_file_row_id(spark, folder), 10, FOLD_SEED, ["row_id"])
    return folded.groupBy("fold").agg(P.count(P.lit(1)).alias("n"))


@query(
    "p6_with_row_id",
    """SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_id, o_orderkey
    FROM orders""",
)
def p6_with_row_id(spark, folder):
    orders = table(spark, folder, "orders").select("o_totalprice", "o_orderkey")
    numbered = running.with_row_id(orders, ["o_totalprice", "o_orderkey"])
    return numbered.select("row_id", "o_orderkey")


@query(
    "p7_extract_items",
    f"""WITH {SQL_RATED}, {SQL_TOP}
    SELECT "user", count(*) AS n, CAST(sum(item) AS BIGINT) AS items FROM top
    WHERE rating > 3000 GROUP BY 1""",
)
def p7_extract_items(spark, folder):
    items = reshape.extract_items(top_lists(spark, folder), min_rating=3000.0)
    rows = items.select("user", P.explode("items").alias("item"))
    return rows.groupBy("user").agg(P.count(P.lit(1)).alias("n"), P.sum("item").alias("items"))


@query(
    "p8_prediction_pairs",
    f"""WITH {SQL_RULED} SELECT prediction, label, count(*) AS n FROM ruled GROUP BY ALL""",
)
def p8_prediction_pairs(spark, folder):
    texts = ruled_lines(spark, folder).withColumn("predicted", P.col("prediction").cast("string"))
    pairs = reshape.prediction_pairs(texts, prediction="predicted")
    return pairs.groupBy("prediction", "label").agg(P.count(P.lit(1)).alias("n"))


@query(
    "p9_user_items",
    f"""WITH {SQL_RATED} SELECT "user", item, count(*) AS n FROM rated GROUP BY ALL""",
)
def p9_user_items(spark, folder):
    pairs = reshape.user_items(rated_events(spark, folder))
    return pairs.groupBy("user", "item").agg(P.count(P.lit(1)).alias("n"))


@query(
    "p9_keyed_ratings",
    f"""WITH {SQL_RATED}
    SELECT "user", item, round(sum(rating), 4) AS total FROM rated GROUP BY ALL""",
)
def p9_keyed_ratings(spark, folder):
    keyed = reshape.keyed_ratings(rated_events(spark, folder))
    return keyed.groupBy("key").agg(P.round(P.sum("rating"), 4).alias("total")).select(
        "key.user", "key.item", "total"
    )


@query(
    "p10_errors",
    f"""WITH {SQL_RULED}
    SELECT fold, label, prediction, count(*) AS n FROM ruled WHERE prediction <> label GROUP BY ALL""",
)
def p10_errors(spark, folder):
    wrong = reshape.errors(ruled_lines(spark, folder))
    return wrong.groupBy("fold", "label", "prediction").agg(P.count(P.lit(1)).alias("n"))


@query("p13_num_features", "SELECT CAST(max(len(embedding)) AS BIGINT) AS num_features FROM embeddings")
def p13_num_features(spark, folder):
    return reshape.num_features(embedding_rows(spark, folder))


TRUTH = f"""
truth AS (
  SELECT "user", item, CAST(count(*) AS BIGINT) AS n FROM ratings WHERE rating > {LIKED} GROUP BY ALL
  UNION ALL
  SELECT "user", NULL, 0 FROM ratings GROUP BY "user" HAVING max(rating) <= {LIKED})"""
RELEVANT = f"""
relevant AS (
  SELECT top."user", top.item, CAST(rank AS INT) AS rank, t.item IS NOT NULL AS relevant,
         u.n_relevant
  FROM top JOIN (SELECT "user", count(item) AS n_relevant FROM truth GROUP BY 1) u
    ON u."user" = top."user"
  LEFT JOIN truth t ON t."user" = top."user" AND t.item = top.item)"""


def relevant(spark, folder):
    truth = reshape.items_by_user(ratings(spark, folder), LIKED)
    return reshape.relevant_documents(truth, recommend.top_items(recency(spark, folder), 10))


@query(
    "j1_relevant_documents",
    f"WITH {SQL_RATINGS}, {SQL_TOP}, {TRUTH}, {RELEVANT} SELECT * FROM relevant",
)
def j1_relevant_documents(spark, folder):
    return relevant(spark, folder)


@query(
    "j2_rates_and_predictions",
    f"""WITH {SQL_RATED},
    predicted AS (
      SELECT r."user", r.item, m.best AS prediction FROM rated r
      JOIN (SELECT "user", item, max(rating) AS best FROM rated GROUP BY ALL) m
        ON m."user" = r."user" AND m.item = r.item)
    SELECT r."user", count(*) AS pairs, round(sqrt(avg((prediction - rating) ** 2)), 8) AS rmse
    FROM rated r JOIN predicted p ON p."user" = r."user" AND p.item = r.item GROUP BY ALL""",
)
def j2_rates_and_predictions(spark, folder):
    rated = rated_events(spark, folder).select("user", "item", "rating")
    best = ratings(spark, folder).withColumnRenamed("rating", "prediction")
    # one prediction per rating row, repeats included, as a model would return them
    predicted = reshape.user_items(rated).join(best, ["user", "item"])
    joined = reshape.rates_and_predictions(rated, predicted)
    scores = reshape.mean_squared_error(joined, ["user"], weight="copies")
    pairs = joined.groupBy("user").agg(P.sum("copies").alias("pairs"))
    return pairs.join(scores, "user").select(
        "user", "pairs", P.round(P.sqrt("mse"), 8).alias("rmse")
    )


@query(
    "a1_items_by_user",
    f"WITH {SQL_RATINGS}, {TRUTH} SELECT * FROM truth",
)
def a1_items_by_user(spark, folder):
    return reshape.items_by_user(ratings(spark, folder), LIKED)


@query(
    "a1_item_lists",
    f"""WITH {SQL_RATINGS}, {TRUTH}
    SELECT "user", 0 AS chunk, coalesce(string_agg(CAST(item AS VARCHAR), ' ' ORDER BY item), '') AS items
    FROM truth GROUP BY 1""",
)
def a1_item_lists(spark, folder):
    lists = reshape.item_lists(ratings(spark, folder), LIKED)
    return lists.select("user", "chunk", P.array_join("items", " ").alias("items"))


@query(
    "e14_ranking_metrics",
    f"""WITH {SQL_RATINGS}, {SQL_TOP}, {TRUTH}, {RELEVANT},
    marked AS (SELECT *, relevant::INT AS hit,
        sum(relevant::INT) OVER (PARTITION BY "user" ORDER BY rank) AS hits FROM relevant),
    ideal AS (SELECT k, m, sum(1 / log2(i + 1)) AS best
        FROM (VALUES (1), (3), (5)) ks(k), range(1, 6) ms(m), range(1, 6) r(i)
        WHERE m <= k AND i <= m GROUP BY k, m),
    per_user AS (SELECT "user", n_relevant,
        {', '.join(f"sum(hit) FILTER (rank <= {k}) / {k}.0 AS p{k}, coalesce(sum(hit / log2(rank + 1)) FILTER (rank <= {k}), 0) AS g{k}" for k in (1, 3, 5))},
        sum(hit * hits / rank) AS ap FROM marked GROUP BY ALL)
    SELECT count(*) AS users,
      {', '.join(f"round(avg(CASE WHEN n_relevant = 0 THEN 0.0 ELSE p{k} END), 10) AS precision_at_{k}, round(avg(CASE WHEN n_relevant = 0 THEN 0.0 ELSE g{k} / (SELECT best FROM ideal WHERE k = {k} AND m = least({k}, greatest(n_relevant, 1))) END), 10) AS ndcg_at_{k}" for k in (1, 3, 5))},
      round(avg(CASE WHEN n_relevant = 0 THEN 0.0 ELSE ap / n_relevant END), 10) AS mean_average_precision
    FROM per_user""",
)
def e14_ranking_metrics(spark, folder):
    scores = evaluate.ranking_metrics(relevant(spark, folder), (1, 3, 5))
    return scores.select("users", *rounded(10, *scores.columns[1:]))


PRICED = """
priced AS (
  SELECT l_extendedprice / 1000.0::DOUBLE AS label,
         p_retailprice * l_quantity / 1000.0::DOUBLE AS prediction, l_returnflag
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def priced(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag"
    )
    parts = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    return lines.join(parts, P.col("l_partkey") == P.col("p_partkey")).select(
        (P.col("l_extendedprice") / 1000.0).alias("label"),
        (P.col("p_retailprice") * P.col("l_quantity") / 1000.0).alias("prediction"),
        "l_returnflag",
    )


@query(
    "a2_mean_squared_error",
    f"""WITH {PRICED} SELECT l_returnflag, round(avg((prediction - label) ** 2), 5) AS mse
    FROM priced GROUP BY 1""",
)
def a2_mean_squared_error(spark, folder):
    scores = reshape.mean_squared_error(priced(spark, folder), ["l_returnflag"])
    return scores.select("l_returnflag", *rounded(5, "mse"))


@query(
    "e15_regression_metrics",
    f"""WITH {PRICED}, centre AS (SELECT avg(label) AS m FROM priced), s AS (
      SELECT avg((prediction - label) ** 2) AS mse, sqrt(avg((prediction - label) ** 2)) AS rmse,
        avg(abs(prediction - label)) AS mae,
        1 - sum((prediction - label) ** 2) / sum((label - m) ** 2) AS r2,
        avg((prediction - m) ** 2) AS explained_variance
      FROM priced, centre)
    SELECT {sql_rounded(5, 'mse', 'rmse', 'mae', 'r2', 'explained_variance')} FROM s""",
)
def e15_regression_metrics(spark, folder):
    scores = evaluate.regression_metrics(priced(spark, folder))
    return scores.select(*rounded(5, *scores.columns))
