"""Frequent itemsets, rules and sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth, FPGrowthModel, PrefixSpan
from pyspark.sql import DataFrame
from pyspark.sql import functions as P


def baskets_from_rows(df: DataFrame, basket: Sequence[str], item: str) -> DataFrame:
    """Long (basket, item) rows to one array of distinct items per basket.

    Each map task drops repeats before the one shuffle, so a basket holds at most
    the number of distinct items. Its items meet in one row, as the estimators need.
    """
    return df.groupBy(*basket).agg(P.sort_array(P.collect_set(item)).alias("items"))


def fit_fpgrowth(
    baskets: DataFrame,
    min_support: float = 0.2,
    min_confidence: float = 0.8,
    partitions: int | None = None,
    items: str = "items",
) -> FPGrowthModel:
    """Frequent-pattern model; repeated items in a basket count once."""
    growth = FPGrowth(itemsCol=items, minSupport=min_support, minConfidence=min_confidence)
    if partitions:
        growth.setNumPartitions(partitions)
    return growth.fit(baskets.withColumn(items, P.array_distinct(items)))


def frequent_itemsets(
    baskets: DataFrame,
    min_support: float = 0.2,
    partitions: int | None = None,
    items: str = "items",
) -> DataFrame:
    """G1: (items, freq), items sorted."""
    model = fit_fpgrowth(baskets, min_support, partitions=partitions, items=items)
    return model.freqItemsets.select(P.sort_array("items").alias("items"), "freq")


def basket_rules(
    baskets: DataFrame,
    min_support: float = 0.2,
    min_confidence: float = 0.8,
    partitions: int | None = None,
    items: str = "items",
) -> DataFrame:
    """Rules with one consequent straight from baskets."""
    model = fit_fpgrowth(baskets, min_support, min_confidence, partitions, items)
    return model.associationRules.withColumn("antecedent", P.sort_array("antecedent"))


def association_rules(itemsets: DataFrame, min_confidence: float = 0.8) -> DataFrame:
    """Rules with one consequent from a table (items, freq)."""
    wholes = itemsets.filter(P.size("items") > 1).select(
        "items", P.col("freq").alias("freq_all"), P.explode("items").alias("consequent")
    )
    wholes = wholes.select(
        P.sort_array(P.array_except("items", P.array("consequent"))).alias("antecedent"),
        P.array("consequent").alias("consequent"),
        "freq_all",
    )
    parts = itemsets.select(
        P.sort_array("items").alias("antecedent"), P.col("freq").alias("freq_antecedent")
    )
    confidence = P.col("freq_all") / P.col("freq_antecedent")
    return (
        wholes.join(parts, "antecedent")
        .withColumn("confidence", confidence)
        .filter(P.col("confidence") >= min_confidence)
        .select("antecedent", "consequent", "confidence", "freq_all", "freq_antecedent")
    )


def sequences_from_rows(
    df: DataFrame, sequence: Sequence[str], step: str, item: str
) -> DataFrame:
    """Long rows to one ordered array of itemsets per sequence.

    Each map task drops repeats within a step before the shuffle; what meets in a
    sequence is its distinct (step, item) pairs. Two shuffles: by step, by sequence.
    """
    steps = df.groupBy(*sequence, P.col(step).alias("step")).agg(
        P.sort_array(P.collect_set(item)).alias("items")
    )
    ordered = P.sort_array(P.collect_list(P.struct("step", "items")))
    return steps.groupBy(*sequence).agg(
        P.transform(ordered, lambda s: s["items"]).alias("sequence")
    )


def frequent_sequences(
    df: DataFrame,
    min_support: float = 0.5,
    max_length: int = 5,
    max_projected: int = 32_000_000,
    sequence: str = "sequence",
) -> DataFrame:
    """(sequence, freq) of ordered itemset patterns."""
    span = PrefixSpan(
        minSupport=min_support,
        maxPatternLength=max_length,
        maxLocalProjDBSize=max_projected,
        sequenceCol=sequence,
    )
    return span.findFrequentSequentialPatterns(df)
