"""Summary statistics and hypothesis tests.

Tests reduce the table to one row of sufficient statistics with partial
aggregates; the p-value is added to that row.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml.stat import ChiSquareTest, Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as P

from foldlight.functions.tails import chi2_p, ks_p, normal_cdf, t_p
from foldlight.functions.lookup import with_lookup
from foldlight.functions.vectors import as_array, as_vector
from foldlight.operators.running import average_ranks, running_totals
from foldlight.session import materialize


def column_stats(df: DataFrame, features: str = "features") -> DataFrame:
    """Q1: mean, sample variance and non-zero count of each feature."""
    vectors = as_vector(df, features)
    summary = vectors.select(
        Summarizer.metrics("mean", "variance", "numNonZeros").summary(P.col(features)).alias("s")
    ).select("s.mean", "s.variance", "s.numNonZeros")
    for c in summary.columns:
        summary = as_array(summary, c)
    zipped = P.arrays_zip("mean", "variance", "numNonZeros")
    return summary.select(P.posexplode(zipped).alias("feature", "s")).select(
        "feature",
        P.col("s.mean").alias("mean"),
        P.col("s.variance").alias("variance"),
        P.col("s.numNonZeros").cast("long").alias("non_zeros"),
    )


def _ratio_or_nan(above: Column, below: Column) -> Column:
    """NaN where a column is constant or empty, as in Spark's correlation matrix."""
    return P.coalesce(P.try_divide(above, below), P.lit(float("nan")))


def _weighted_pearson(x: Column, y: Column, n: Column) -> Column:
    """Correlation of ranks with counts; ranks are centred by the caller."""
    return _ratio_or_nan(P.sum(n * x * y), P.sqrt(P.sum(n * x * x) * P.sum(n * y * y)))


def correlation(df: DataFrame, x: str, y: str, method: str = "pearson") -> DataFrame:
    """Q2: Pearson or Spearman correlation of two columns; NaN where one is constant.

    Spearman counts equal (x, y) pairs first and joins the average ranks to
    these counts, so a value that fills a third of the rows travels once.
    """
    both = df.select(P.col(x).cast("double").alias("x"), P.col(y).cast("double").alias("y"))
    both = both.dropna()
    if method == "pearson":
        spread = P.sqrt(P.var_pop("x") * P.var_pop("y"))
        return both.agg(_ratio_or_nan(P.covar_pop("x", "y"), spread).alias("correlation"))
    if method != "spearman":
        raise ValueError(f"unknown method {method!r}")
    pairs = both.groupBy("x", "y").agg(P.count(P.lit(1)).alias("n"))
    rank_x = average_ranks(both, "x").withColumnRenamed("rank", "rx")
    rank_y = average_ranks(both, "y").withColumnRenamed("rank", "ry")
    # the mean rank is (rows + 1) / 2 for both columns
    middle = both.agg(((P.count(P.lit(1)) + 1) / 2.0).alias("m")).scalar()
    ranked = pairs.join(rank_x, "x").join(rank_y, "y").select(
        "n", (P.col("rx") - middle).alias("rx"), (P.col("ry") - middle).alias("ry")
    )
    return ranked.agg(
        _weighted_pearson(P.col("rx"), P.col("ry"), P.col("n")).alias("correlation")
    )


def correlation_matrix(
    df: DataFrame, method: str = "pearson", features: str = "features"
) -> DataFrame:
    """Q3: correlation of every pair of features as (i, j, correlation)."""
    if method == "spearman":
        df = rank_features(df, features)
    elif method != "pearson":
        raise ValueError(f"unknown method {method!r}")
    matrix = Correlation.corr(as_vector(df, features), features, "pearson")
    cells = matrix.head()[0].toArray()
    rows = [(i, j, float(v)) for i, line in enumerate(cells) for j, v in enumerate(line)]
    return df.sparkSession.createDataFrame(rows, "i int, j int, correlation double")


def rank_features(df: DataFrame, features: str = "features") -> DataFrame:
    """Each feature replaced by its average rank, as array<double>.

    The row numbers are written before they are used, so a recomputed task
    cannot number the rows differently.
    """
    rows = materialize(
        as_array(df.select(features), features).withColumn(
            "_row", P.monotonically_increasing_id()
        ),
        "rows",
    )
    long = rows.select("_row", P.posexplode(features).alias("_i", "_x"))
    ranks = average_ranks(long, "_x", ["_i"])
    return (
        long.join(ranks, ["_i", "_x"])
        .groupBy("_row")
        .agg(P.sort_array(P.collect_list(P.struct("_i", "rank"))).alias("_r"))
        .select(P.transform("_r", lambda r: r["rank"]).alias(features))
    )


def chi_square_fit(
    df: DataFrame,
    category: str,
    expected: Mapping[Any, float] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Q4: observed category counts against equal or given frequencies.

    Given frequencies are scaled to the observed total. A category without one,
    the null category included, has expected count 0: the statistic is infinite.
    """
    amount = P.sum(P.col(weight).cast("double")) if weight else P.count(P.lit(1)).cast("double")
    counts = df.groupBy(category).agg(amount.alias("o"))
    if expected is None:
        test = counts.agg(
            (P.count(P.lit(1)) * P.var_pop("o") / P.avg("o")).alias("statistic"),
            (P.count(P.lit(1)) - 1).alias("degrees"),
        )
    else:
        total = float(sum(expected.values()))
        shares = {value: e / total for value, e in expected.items()}
        # sum (o - pN)^2 / pN with N = sum o
        fit = P.sum(P.col("o") * P.col("o") / P.col("p")) / P.sum("o") - P.sum("o")
        unlisted = P.max((P.col("p").isNull() & (P.col("o") > 0)).cast("int")) == 1
        test = with_lookup(counts, category, shares, "p").agg(
            P.when(unlisted, float("inf")).otherwise(fit).alias("statistic"),
            P.lit(len(expected) - 1).cast("long").alias("degrees"),
        )
    return test.withColumn("p_value", chi2_p("statistic", "degrees"))


def chi_square_independence(
    df: DataFrame, row: str, col: str, weight: str | None = None
) -> DataFrame:
    """Q5: Pearson test on the contingency table of two columns.

    Rows with a null category are left out. Only observed cells are joined with
    their margins. The empty cells add the expected counts that the observed cells
    leave over, so they need no rows.
    """
    df = df.dropna(subset=[row, col])
    amount = P.sum(P.col(weight).cast("double")) if weight else P.count(P.lit(1)).cast("double")
    cells = df.groupBy(P.col(row).alias("r"), P.col(col).alias("c")).agg(amount.alias("o"))
    rows = cells.groupBy("r").agg(P.sum("o").alias("ro"))
    cols = cells.groupBy("c").agg(P.sum("o").alias("co"))
    total = cells.agg(P.sum("o")).scalar()
    table = (
        cells.join(rows, "r")
        .join(cols, "c")
        .withColumn("n", total)
        .withColumn("e", P.col("ro") * P.col("co") / P.col("n"))
    )
    seen = P.sum((P.col("o") - P.col("e")) * (P.col("o") - P.col("e")) / P.col("e"))
    test = table.agg(
        seen.alias("seen"),
        (P.first("n") - P.sum("e")).alias("unseen"),
        P.count(P.lit(1)).alias("cells"),
        P.count_distinct("r").alias("rows"),
        P.count_distinct("c").alias("cols"),
    )
    full = P.col("cells") == P.col("rows") * P.col("cols")
    return test.select(
        P.when(full, P.col("seen")).otherwise(P.col("seen") + P.col("unseen")).alias("statistic"),
        ((P.col("rows") - 1) * (P.col("cols") - 1)).alias("degrees"),
    ).withColumn("p_value", chi2_p("statistic", "degrees"))


def chi_square_features(
    df: DataFrame, features: str = "features", label: str = "label"
) -> DataFrame:
    """Q6: Q5 of every feature against the label."""
    tests = ChiSquareTest.test(as_vector(df, features), features, label, flatten=True)
    return tests.select(
        P.col("featureIndex").alias("feature"),
        "statistic",
        P.col("degreesOfFreedom").cast("long").alias("degrees"),
        P.col("pValue").alias("p_value"),
    )


def kolmogorov_smirnov(
    df: DataFrame, column: str, dist: str = "norm", mean: float = 0.0, sd: float = 1.0
) -> DataFrame:
    """Q7: one-sample, two-sided test against a normal distribution.

    Equal values are counted first; the distribution function of the sample
    comes from running totals over the distinct values.
    """
    if dist != "norm":
        raise ValueError(f"unknown distribution {dist!r}")
    counts = (
        df.select(P.col(column).cast("double").alias("x"))
        .dropna()
        .groupBy("x")
        .agg(P.count(P.lit(1)).alias("n"))
    )
    run = running_totals(counts, ["x"], ["n"])
    cdf = normal_cdf((P.col("x") - mean) / sd)
    below = P.col("n_before") / P.col("n_all")
    upto = (P.col("n_before") + P.col("n")) / P.col("n_all")
    test = run.agg(
        P.max(P.greatest(cdf - below, upto - cdf)).alias("statistic"),
        P.max("n_all").alias("rows"),
    )
    return test.withColumn("p_value", ks_p("statistic", "rows"))


def kernel_density(
    df: DataFrame, column: str, points: Sequence[float], bandwidth: float = 3.0
) -> DataFrame:
    """Q8: mean Gaussian kernel at each point; one pass, one average per point."""
    x = P.col(column).cast("double")
    scale = 1.0 / (bandwidth * math.sqrt(2.0 * math.pi))

    def density(p: float) -> Column:
        z = (x - P.lit(float(p))) / P.lit(float(bandwidth))
        return P.avg(P.exp(-z * z / 2.0)) * scale

    estimates = P.array(
        *[P.struct(P.lit(float(p)).alias("point"), density(p).alias("density")) for p in points]
    )
    return df.agg(estimates.alias("_e")).select(P.inline("_e"))


def welch_from_moments(moments: DataFrame) -> DataFrame:
    """Q9 formula on a row of n0, mean0, var0, n1, mean1, var1 (sample variances).

    t, degrees and p are null where both groups are constant or one is a single value.
    """
    a = P.col("var0") / P.col("n0")
    b = P.col("var1") / P.col("n1")
    t = P.try_divide(P.col("mean0") - P.col("mean1"), P.sqrt(a + b))
    within = P.try_divide(a * a, P.col("n0") - 1) + P.try_divide(b * b, P.col("n1") - 1)
    degrees = P.try_divide((a + b) * (a + b), within)
    return moments.select("*", t.alias("t"), degrees.alias("degrees")).withColumn(
        "p_value", t_p("t", "degrees")
    )


def welch_test(df: DataFrame, label: str = "label", value: str = "value") -> DataFrame:
    """Q9: two-group t test with unequal variances; group 0 is label = false."""
    flag = P.col(label).cast("boolean")
    aggregates = []
    for g, member in (("0", ~flag), ("1", flag)):
        v = P.when(member, P.col(value).cast("double"))
        aggregates += [
            P.count(v).alias(f"n{g}"),
            P.avg(v).alias(f"mean{g}"),
            P.var_samp(v).alias(f"var{g}"),
        ]
    return welch_from_moments(df.agg(*aggregates))
