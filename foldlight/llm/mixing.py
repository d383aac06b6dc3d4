"""A mix of sources at target weights: hash thresholds found from histograms, no sort of rows.

Sources, in code-point order with null last, weigh ``weights`` in turn and share
``share`` times all words. A target stops at ``repeat`` times the words of its source; the
excess is shared again by weight until no target is above, which is filling vessels to a
common level: sources in order of capacity by weight, the level from running sums.

A row takes its whole source as often as the target holds it; the rest of the target is a
budget. Rows lie at the md5 of key and text. Words are summed by source and first digits of
that place, the digit where the running sum passes the budget is the boundary, and only the
rows of boundary digits are summed again by the next digits, until one row is left. It is in
if that brings the source closer to its budget, so a source misses its target by at most half
of that row. A filter by threshold then gives every row its count. Thresholds are nested: what a
smaller budget takes, a larger one takes too.

Rows equal in key and text share a place and are told apart by a number written with them;
they are interchangeable, so the result is the same as a table whichever of them is taken. Digits
that all rows of a boundary share are skipped at once, so a third of a table in copies of one row takes
no more rounds than other rows do. Sums are made before rows are shuffled, a hot source has one
row for each digit and task.

Null and wordless texts have size 0 and are never short of their target; a null source is a
source of its own, apart from the empty name; null keys count as empty in the place. An empty table gives an
empty result. Columns not named are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlight.operators.running import running_totals, with_row_id
from foldlight.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
DIGITS = 3  # hexadecimal digits summed at once: 4,096 sums for a source and round
PLACE = 64  # digits of a full place: md5 of the row, then of its number


def _place() -> Column:
    return F.concat("hash", F.md5(F.col("number").cast("string").cast("binary")))


def source_targets(
    sources: DataFrame, weights: Sequence[int], share: float, repeat: float
) -> DataFrame:
    """(source, source_size, target) of (source, source_size)."""
    ordered = with_row_id(sources.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "_id")
    turn = F.array(*map(F.lit, weights))[(F.col("_id") % len(weights)).cast("int")]
    vessels = ordered.withColumn("weight", turn.cast("double"))
    vessels = vessels.withColumn("capacity", repeat * F.col("source_size"))
    vessels = vessels.withColumn("_level", F.col("capacity") / F.col("weight"))
    vessels = running_totals(vessels, ["_level", "_id"], ["capacity", "weight", "source_size"])
    wanted = share * F.col("source_size_all")
    full = F.col("capacity") * (F.col("weight_all") - F.col("weight_before")) <= F.col("weight") * (
        wanted - F.col("capacity_before")
    )
    vessels = materialize(vessels.select("source", "source_size", "weight", "capacity", full.alias("full")), "vessels")
    total, gone, rest = vessels.agg(
        F.sum("source_size"), F.sum(F.when(F.col("full"), F.col("capacity"))), F.sum(F.when(~F.col("full"), F.col("weight")))
    ).first()
    left = share * (total or 0) - (gone or 0.0)
    level = F.col("weight") * left / (rest or 1.0)
    return vessels.select(
        "source", "source_size", F.when(F.col("full"), F.col("capacity")).otherwise(level).alias("target")
    )


def _shared(low: Column, high: Column) -> Column:
    """Number of first digits that two places share."""
    differs = F.transform(F.sequence(F.lit(1), F.lit(PLACE)), lambda i: F.substr(low, i, F.lit(1)) != F.substr(high, i, F.lit(1)))
    first = F.array_position(differs, True)
    return F.when(first == 0, PLACE).otherwise(first - 1).cast("int")


def _boundaries(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold, with_it): the place of the row at which each source's budget ends."""
    rows = rows.filter("size > 0").withColumn("place", _place())
    state = budgets.select(F.col("source").alias("_source"), "budget", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    done = None
    while True:
        inside = rows.join(state, F.col("source").eqNullSafe(F.col("_source")) & F.expr("startswith(place, prefix)"))
        digit = F.expr(f"substring(place, char_length(prefix) + 1, {DIGITS})")
        sums = inside.groupBy("_source", "budget", "before", digit.alias("digit")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min("place").alias("low"), F.max("place").alias("high")
        )
        by_digit = Window.partitionBy("_source").orderBy("digit")  # at most 4,096 rows a source
        sums = sums.withColumn("after", F.col("before") + F.sum("words").over(by_digit))
        # a budget that rounding leaves at the very end of its source stops at the last digit
        sums = sums.withColumn("last", F.lead("digit").over(by_digit).isNull())
        passed = sums.filter((F.col("after") >= F.col("budget")) | F.col("last"))
        first = passed.withColumn("turn", F.row_number().over(by_digit)).filter("turn = 1")
        first = first.withColumn("shared", _shared(F.col("low"), F.col("high")))
        state = materialize(
            first.select(
                "_source", "budget", F.expr("left(low, shared)").alias("prefix"),
                (F.col("after") - F.col("words")).alias("before"), "after", "n", "low",
            ),
            "boundaries",
        )
        found = state.filter("n = 1").select(
            "_source",
            F.col("low").alias("threshold"),
            (F.col("after") - F.col("budget") <= F.col("budget") - F.col("before")).alias("with_it"),
        )
        done = found if done is None else done.union(found)
        state = state.filter("n > 1").select("_source", "budget", "prefix", "before")
        if state.isEmpty():
            return done


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    repeat: int = 2,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken) of every row.

    ``copies`` is how often the mix takes the row, ``taken`` its words times that.
    """
    content = F.concat(
        F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text).cast("string"), F.lit(""))
    )
    rows = materialize(
        docs.select(
            F.col(key).alias("key"),
            F.col(source).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(content.cast("binary")).alias("hash"),
            F.monotonically_increasing_id().alias("number"),
        ),
        "mixed",
    )
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, share, repeat)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    targets = targets.withColumn("whole", whole)
    targets = materialize(targets.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    ends = _boundaries(rows, targets.filter("budget > 0"))
    plan = targets.join(ends, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        F.col("source").alias("_source"), "source_size", "target", "whole", "threshold", "with_it"
    )
    place = _place()
    extra = (place < F.col("threshold")) | ((place == F.col("threshold")) & F.col("with_it"))
    copies = F.col("whole") + F.coalesce(extra, F.lit(False)).cast("int")
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    return out.select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )
