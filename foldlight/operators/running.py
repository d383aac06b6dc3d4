"""Running totals and row numbers over a whole table.

A window without partition keys puts every row on one task, and a window per
group does the same to a hot group. Here the rows are range-partitioned on the
order column, the partition number is frozen in a written table, and each
partition gets the totals of the partitions before it. Only the per-partition
totals (groups x partitions rows) meet in one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as P

from foldlight.session import materialize

PART = "_part"


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add ``<s>_before`` and ``<s>_all`` for each column in ``sums``.

    ``_before`` is the total over the rows of the group that come earlier in
    the order, the row itself left out; ``_all`` is the group total. ``order``
    must be unique within a group, so callers pre-aggregate ties.
    """
    keys = [P.desc(c) if descending else P.asc(c) for c in order]
    parts = materialize(
        df.repartitionByRange(*keys).withColumn(PART, P.spark_partition_id()), "running"
    )
    per_part = parts.groupBy(*by, PART).agg(*[P.sum(s).alias(f"_t_{s}") for s in sums])
    over_group = Window.partitionBy(*by) if by else Window.partitionBy(P.lit(0))
    earlier = over_group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        *by,
        PART,
        *[P.coalesce(P.sum(f"_t_{s}").over(earlier), P.lit(0)).alias(f"_o_{s}") for s in sums],
        *[P.sum(f"_t_{s}").over(over_group).alias(f"{s}_all") for s in sums],
    )
    inside = Window.partitionBy(*by, PART).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    joined = parts.withColumns(
        {f"_b_{s}": P.coalesce(P.sum(s).over(inside), P.lit(0)) for s in sums}
    )
    if by:
        same = P.col(f"a.{PART}") == P.col(f"b.{PART}")
        for c in by:
            same = same & P.col(f"a.{c}").eqNullSafe(P.col(f"b.{c}"))
        joined = joined.alias("a").join(offsets.alias("b"), same).select(
            "a.*", *[P.col(f"b._o_{s}") for s in sums], *[P.col(f"b.{s}_all") for s in sums]
        )
    else:
        joined = joined.join(offsets, PART)
    return joined.select(
        *df.columns,
        *[(P.col(f"_b_{s}") + P.col(f"_o_{s}")).alias(f"{s}_before") for s in sums],
        *[f"{s}_all" for s in sums],
    )


def with_file_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """P6 for rows without a key: ids 0 .. n-1 in the order of the input files.

    The rows are written once with their file, block and place, so the ids are the
    same for every later job. Rows of a block follow each other, so only the counts
    per block meet in one window and no row is shuffled. Rows that come from no file
    count in the order of their partitions.
    """
    block = ["_file", "_block", "_split"]
    rows = materialize(
        df.select(
            "*",
            P.input_file_name().alias("_file"),
            P.input_file_block_start().alias("_block"),
            P.spark_partition_id().alias("_split"),
            P.monotonically_increasing_id().alias("_place"),
        ),
        "numbered",
    )
    blocks = rows.groupBy(*block).agg(
        P.count(P.lit(1)).alias("_n"), P.min("_place").alias("_low")
    )
    # one row per block of input meets in this window
    earlier = Window.partitionBy(P.lit(0)).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    first = P.coalesce(P.sum("_n").over(earlier), P.lit(0))
    starts = blocks.select(*block, (first - P.col("_low")).alias("_shift"))
    return rows.join(starts, block).select((P.col("_place") + P.col("_shift")).alias(name), *df.columns)


def with_row_id(df: DataFrame, key: Sequence[str], name: str = "row_id") -> DataFrame:
    """Ids 0 .. n-1 in the order of a unique key."""
    numbered = running_totals(df.withColumn("_one", P.lit(1).cast("long")), key, ["_one"])
    return numbered.select(P.col("_one_before").alias(name), *df.columns)


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value (and group): its average rank among all rows."""
    counts = df.groupBy(*by, value).agg(P.count(P.lit(1)).alias("_n"))
    ranked = running_totals(counts, [value], ["_n"], by)
    return ranked.select(*by, value, (P.col("_n_before") + (P.col("_n") + 1) / 2.0).alias("rank"))
