"""Clusterings and topics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import (
    LDA,
    BisectingKMeans,
    BisectingKMeansModel,
    DistributedLDAModel,
    GaussianMixture,
    GaussianMixtureModel,
    KMeans,
    KMeansModel,
    LDAModel,
    PowerIterationClustering,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as P

from foldlight.functions.nearest import nearest
from foldlight.functions.vectors import as_array, as_vector
from foldlight.session import enable_checkpoints, materialize

ROWS_A_PART = 1_000_000  # (doc, word, n) rows that are kept together


def fit_kmeans(df: DataFrame, k: int = 2, iterations: int = 20, seed: int = 1) -> KMeansModel:
    """K-means."""
    return KMeans(k=k, maxIter=iterations, seed=seed).fit(as_vector(df))


def centers(model: KMeansModel | BisectingKMeansModel) -> list[list[float]]:
    """Cluster centres of a fitted model; k rows."""
    return [[float(x) for x in c] for c in model.clusterCenters()]


def assign_clusters(
    df: DataFrame,
    centres: Sequence[Sequence[float]],
    features: str = "features",
    name: str = "cluster",
) -> DataFrame:
    """Number of the nearest centre (the first of equals) for each row."""
    return as_array(df, features).withColumn(name, nearest(P.col(features), centres)["cluster"])


def within_cluster_cost(
    df: DataFrame, centres: Sequence[Sequence[float]], features: str = "features"
) -> DataFrame:
    """Sum over the rows of the squared distance to the nearest centre."""
    costs = as_array(df.select(features), features).select(nearest(P.col(features), centres)["cost"].alias("c"))
    return costs.agg(P.sum("c").alias("cost"))


def fit_bisecting_kmeans(
    df: DataFrame, k: int = 4, iterations: int = 20, seed: int = 1
) -> BisectingKMeansModel:
    """C4: bisecting k-means."""
    return BisectingKMeans(k=k, maxIter=iterations, seed=seed).fit(as_vector(df))


def fit_gaussian_mixture(
    df: DataFrame, k: int = 2, iterations: int = 100, seed: int = 1
) -> GaussianMixtureModel:
    """Gaussian mixture by expectation-maximization."""
    return GaussianMixture(k=k, maxIter=iterations, seed=seed).fit(as_vector(df))


def mixture_parts(model: GaussianMixtureModel) -> DataFrame:
    """(component, weight, mean, covariance) with the covariance row by row."""
    spark = model.gaussiansDF.sparkSession
    rows = [
        (
            i,
            float(w),
            [float(x) for x in g.mean],
            [[float(x) for x in line] for line in g.cov.toArray()],
        )
        for i, (w, g) in enumerate(
            zip(model.weights, model.gaussiansDF.select("mean", "cov").collect(), strict=True)
        )
    ]
    return spark.createDataFrame(
        rows, "component int, weight double, mean array<double>, covariance array<array<double>>"
    )


def fit_topics(
    df: DataFrame, k: int = 3, iterations: int = 20, seed: int = 1
) -> DistributedLDAModel | LDAModel:
    """Topics of a table (doc_id, features) of word counts."""
    enable_checkpoints(df.sparkSession)
    return LDA(k=k, maxIter=iterations, seed=seed, optimizer="em").fit(as_vector(df))


def topic_words(model: LDAModel, df: DataFrame) -> DataFrame:
    """Word by topic table (word, topic, weight), vocabulary x k rows, which pass through the driver.

    For a vocabulary of any size there is ``fit_topic_tables``.
    """
    matrix = model.topicsMatrix().toArray()
    rows = [(w, t, float(v)) for w, line in enumerate(matrix) for t, v in enumerate(line)]
    return df.sparkSession.createDataFrame(rows, "word int, topic int, weight double")


@dataclass
class TopicTables:
    """C6 as tables: (word, topic, weight), (doc, topic, weight), and the objective after each step."""

    words: DataFrame
    docs: DataFrame
    objective: list[float]


def word_counts(df: DataFrame, features: str = "features", doc: str = "doc_id") -> DataFrame:
    """(doc, word, n) with one row per word that a document holds, from vectors of counts."""
    counts = as_array(df.select(P.col(doc).alias("doc"), features), features)
    return counts.select("doc", P.posexplode(features).alias("word", "n")).filter("n > 0")


def _summed(rows: DataFrame, by: str, k: int, *more: Column) -> DataFrame:
    return rows.groupBy(by).agg(*[P.sum(f"share{i}").alias(f"weight{i}") for i in range(k)], *more)


def fit_topic_tables(
    counts: DataFrame, k: int = 3, iterations: int = 20, seed: int = 1, alpha: float | None = None, eta: float = 1.1
) -> TopicTables:
    """C6 by expectation-maximisation on tables; neither the vocabulary nor the documents meet the driver.

    ``counts`` has (doc, word, n), each pair once. Each row's count is divided over the topics in
    proportion to (word weight + eta - 1) (doc weight + alpha - 1) / (topic weight + words (eta - 1)); the shares are summed
    by word and by document, with partial sums per task. The rows are dealt by document once, sorted and kept for
    all steps, so a step moves one row per document and one per word and task; shares are made again where they are
    summed and never written. Only the k topic totals and the objective, the logarithm of
    the posterior up to a constant, are read back. It never falls from one step to the next. The first shares come
    from a hash of seed, document and word. ``alpha`` is 50 / k + 1 unless given. Rows without a positive count are
    left out; an empty table gives empty tables.
    """
    alpha = 50.0 / k + 1 if alpha is None else alpha
    rows = materialize(counts.select("doc", "word", P.col("n").cast("double").alias("n")).filter("n > 0"), "counts")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_A_PART))
    rows = rows.repartition(parts, "doc").sortWithinPartitions("doc").persist()
    draws = [(P.pmod(P.xxhash64(P.lit(seed), P.lit(i), "doc", "word"), P.lit(1000)) + 1).cast("double") for i in range(k)]
    drawn = rows.withColumns({f"share{i}": draw for i, draw in enumerate(draws)})
    scale = P.col("n") / sum((P.col(f"share{i}") for i in range(k)), P.lit(0.0))
    shares = drawn.withColumns({f"share{i}": P.col(f"share{i}") * scale for i in range(k)})
    log_share = P.lit(0.0)
    weights = [P.col(f"weight{i}") for i in range(k)]
    objective: list[float] = []
    prior = None
    for step in range(iterations + 1):
        words = materialize(_summed(shares, "word", k), "words")
        per_doc = _summed(shares, "doc", k, P.sum("n").alias("length"), P.sum(log_share).alias("logs"))
        docs = materialize(per_doc.filter("doc IS NOT NULL"), "docs")
        logs = [P.sum(P.log(w + (eta - 1))) if eta > 1 else P.lit(0.0) for w in weights]
        size, *sums = words.agg(P.count(P.lit(1)), *[P.sum(w) for w in weights], *logs).first()
        if not size:
            break
        totals = [t + size * (eta - 1) for t in sums[:k]]
        places = sum((P.log(w + (alpha - 1)) for w in weights), P.lit(0.0)) if alpha > 1 else P.lit(0.0)
        rest = P.log(P.col("length") + k * (alpha - 1)) * k if alpha > 1 else P.lit(0.0)
        of_docs, fit = docs.agg(P.sum(places - rest), P.sum("logs")).first()
        if prior is not None:
            objective.append(fit + prior)
        prior = (eta - 1) * sum(s - size * math.log(t) for s, t in zip(sums[k:], totals, strict=True))
        if alpha > 1:
            prior += (alpha - 1) * of_docs
        by_word = words.select("word", *[w.alias(f"of_word{i}") for i, w in enumerate(weights)])
        by_doc = docs.select("doc", "length", *[w.alias(f"of_doc{i}") for i, w in enumerate(weights)])
        met = rows.join(by_doc, "doc").join(by_word, "word")
        product = [
            (P.col(f"of_word{i}") + (eta - 1)) * (P.col(f"of_doc{i}") + (alpha - 1)) / totals[i] for i in range(k)
        ]
        met = met.withColumns({f"product{i}": x for i, x in enumerate(product)})
        met = met.withColumn("total", sum((P.col(f"product{i}") for i in range(k)), P.lit(0.0)))
        log_share = P.col("n") * (P.log("total") - P.log(P.col("length") + k * (alpha - 1)))
        met = met.withColumn("log_share", log_share)
        if step == iterations:
            objective.append(met.agg(P.sum("log_share")).first()[0] + prior)
            break
        divided = [(P.col(f"product{i}") / P.col("total") * P.col("n")).alias(f"share{i}") for i in range(k)]
        shares = met.select("doc", "word", "n", "log_share", *divided)
        log_share = P.col("log_share")
    rows.unpersist()
    weight = P.posexplode(P.array(*weights)).alias("topic", "weight")
    return TopicTables(words.select("word", weight), docs.select("doc", weight), objective)


def power_iteration_clusters(
    edges: DataFrame,
    k: int = 2,
    iterations: int = 10,
    src: str = "src",
    dst: str = "dst",
    weight: str = "weight",
) -> DataFrame:
    """(id, cluster) for the nodes of an undirected weighted graph.

    Each edge is given once, in either direction; parallel edges are added up.
    """
    once = (
        edges.filter(P.col(src) != P.col(dst))
        .groupBy(P.least(src, dst).alias("src"), P.greatest(src, dst).alias("dst"))
        .agg(P.sum(P.col(weight).cast("double")).alias("weight"))
    )
    return PowerIterationClustering(k=k, maxIter=iterations, weightCol="weight").assignClusters(
        once
    )
