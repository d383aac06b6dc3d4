"""Folds, splits and samples that depend on the row key only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as P

from foldlight.functions.hashing import RANGE, bucket, hash32, unit_interval
from foldlight.functions.lookup import with_lookup


def k_fold(
    df: DataFrame, k: int, seed: int, key: Sequence[str], name: str = "fold"
) -> DataFrame:
    """fold number 0 .. k-1. Validation set i is fold = i, training the rest."""
    return df.withColumn(name, bucket(seed, key, k))


def random_split(
    df: DataFrame, weights: Sequence[float], seed: int, key: Sequence[str], name: str = "split"
) -> DataFrame:
    """split number 0 .. len(weights)-1 in proportion to the weights."""
    total = float(sum(weights))
    cuts = [c / total for c in accumulate(weights)][:-1]
    u = unit_interval(seed, key)
    number = sum(((u >= P.lit(c)).cast("int") for c in cuts), P.lit(0))
    return df.withColumn(name, number)


def sample_fraction(
    df: DataFrame, fraction: float, seed: int, key: Sequence[str] | None = None
) -> DataFrame:
    """Bernoulli sample without replacement."""
    if key is None:
        return df.sample(False, fraction, seed)
    return df.filter(unit_interval(seed, key) < fraction)


def stratified_sample(
    df: DataFrame, stratum: str, fractions: Mapping[Any, float], seed: int, key: Sequence[str]
) -> DataFrame:
    """Bernoulli sample with one fraction per stratum; strata not named give no row."""
    rows = with_lookup(df, stratum, fractions, "_fraction")
    return rows.filter(unit_interval(seed, key) < P.col("_fraction")).drop("_fraction")


def stratified_sample_exact(
    df: DataFrame,
    stratum: str,
    fractions: Mapping[Any, float],
    seed: int,
    key: Sequence[str],
    slices: int = 65536,
) -> DataFrame:
    """exactly ceil(fraction x n) rows of each stratum, smallest key hash first.

    No stratum is sorted as a whole: rows are counted per hash slice, the slice
    where the quota runs out is found from these counts, lower slices are kept
    by a filter and only the rows of that one slice are ranked.
    """
    width = RANGE // slices
    tagged = df.filter(P.col(stratum).isin(*fractions)).withColumn("_h", hash32(seed, key))
    tagged = tagged.withColumn("_slice", P.floor(P.col("_h") / width).cast("int"))
    counts = tagged.groupBy(stratum, "_slice").agg(P.count(P.lit(1)).alias("_n"))
    counts = with_lookup(counts, stratum, fractions, "_fraction")
    group = Window.partitionBy(stratum)
    upto = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quota = P.ceil(P.max("_fraction").over(group) * P.sum("_n").over(group))
    cut = (
        counts.withColumn("_quota", quota)
        .withColumn("_upto", P.sum("_n").over(upto))
        .filter((P.col("_upto") >= P.col("_quota")) & (P.col("_upto") - P.col("_n") < P.col("_quota")))
        .select(
            P.col(stratum).alias("_stratum"),
            P.col("_slice").alias("_cut"),
            (P.col("_quota") - P.col("_upto") + P.col("_n")).alias("_left"),
        )
    )
    # one row per entry of ``fractions``: the dictionary bounds the broadcast side
    cut = P.broadcast(cut)
    same = P.col(stratum) == P.col("_stratum")
    below = tagged.join(cut, same & (P.col("_slice") < P.col("_cut")), "left_semi")
    ranked = Window.partitionBy(stratum).orderBy("_h", *key)
    at = (
        tagged.join(cut, same & (P.col("_slice") == P.col("_cut")))
        .withColumn("_rank", P.row_number().over(ranked))
        .filter(P.col("_rank") <= P.col("_left"))
    )
    return below.select(*df.columns).unionAll(at.select(*df.columns))
