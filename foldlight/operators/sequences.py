"""Frequent sequences by vertical id-lists.

No sequence becomes one row. An id-list names the steps at which a sequence holds an itemset,
one row a step. A pattern is a shorter pattern followed by one more itemset, and all it needs to
grow is the first step at which each sequence can end it: a prefix is one row per sequence.

What can follow depends on that step alone. So the next step of every itemset is looked up once
for each step of a sequence; prefixes only move to the step at which they end, where one
equality join both counts what follows them and says where it ends.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as P

from foldlight.operators.running import PART
from foldlight.session import materialize

ALONE = -1  # ``before`` of a pattern of one itemset
SLOTS = 32  # itemsets of one size whose next steps share a row


def itemset_spans(lists: DataFrame, need: int) -> DataFrame:
    """(owner, items, first, last) of the itemsets that ``need`` or more owners hold."""
    spans = lists.groupBy("owner", "items").agg(
        P.min("step").alias("first"), P.max("step").alias("last")
    )
    often = spans.groupBy("items").agg(P.count(P.lit(1)).alias("freq")).filter(P.col("freq") >= need)
    return spans.join(often, "items").select("owner", "items", "first", "last", "freq")


def itemset_lists(facts: DataFrame, need: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """Id-lists (owner, items, step) and spans of the frequent itemsets of all sizes.

    ``facts`` are distinct rows (owner, step, item). A list of one more item is an equality
    join by owner and step, so the steps of one long sequence are spread like any others.
    """
    lists = facts.select("owner", "step", P.array("item").alias("items"))
    singles = None
    all_lists, all_spans = [], []
    for size in range(1, longest + 1):
        spans = materialize(itemset_spans(lists, need), "spans")
        all_spans.append(spans)
        if spans.isEmpty():
            break
        lists = materialize(lists.join(spans.select("items").distinct(), "items", "leftsemi"), "lists")
        all_lists.append(lists)
        if size == 1:
            singles = lists.select("owner", "step", P.col("items")[0].alias("_item"))
        # both sides are whole tables, and what they give is read twice
        grown = (
            lists.join(singles.hint("merge"), ["owner", "step"])
            .filter(P.col("_item") > P.element_at("items", -1))
            .select("owner", "step", P.array_append("items", P.col("_item")).alias("items"))
        )
        lists = materialize(grown, "grown") if size < longest else grown
    return together(all_lists or [lists.limit(0)]), together(all_spans)


def together(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def next_steps(
    probes: DataFrame, lists: DataFrame, key: Sequence[str] = ("owner", "items"), slots: int | None = None
) -> DataFrame:
    """(key, after, next): the first step of the list that is later than ``after``.

    Probes and lists are cut into ranges of (key, step), so the list of one hot owner
    spans many tasks, and probes are never paired with steps. Inside a range a running minimum
    from the end answers; a list that goes on in later ranges adds their lowest step, one row
    for each border between ranges. ``next`` is null where the list has no later step.

    With ``slots`` a key has that many lists, told apart by their column ``slot`` (from 0), and
    ``next`` is an array with the answer of each.
    """
    key, places = [*key], range(slots or 1)
    slot = P.lit(0) if slots is None else P.col("slot")
    marks = lists.select(*key, P.col("step").alias("at"), slot.cast("int").alias("slot")).unionByName(
        probes.select(*key, P.col("after").alias("at")).distinct(), allowMissingColumns=True
    )
    # of equal steps the probe comes first when read from the end
    marks = marks.withColumn("probe", P.col("slot").isNull())
    parts = materialize(
        marks.repartitionByRange(*key, "at", "probe").withColumn(PART, P.spark_partition_id()), "marks"
    )
    lowest = [P.min(P.when(P.col("slot") == n, P.col("at"))) for n in places]
    from_end = Window.partitionBy(PART, *key).orderBy(P.desc("at"), P.desc("probe"))
    from_end = from_end.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = parts.select("*", *[lowest[n].over(from_end).alias(f"_inside_{n}") for n in places]).filter("probe")
    later_parts = Window.partitionBy(*key).orderBy(P.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)
    later = (
        parts.groupBy(PART, *key)
        .agg(*[lowest[n].alias(f"_low_{n}") for n in places])
        .select(PART, *key, *[P.min(f"_low_{n}").over(later_parts).alias(f"_later_{n}") for n in places])
        .filter(P.coalesce(*[P.col(f"_later_{n}") for n in places]).isNotNull())
    )
    answers = [P.coalesce(f"_inside_{n}", f"_later_{n}") for n in places]
    # a range has one border to the next, so few rows are sent to all
    return inside.join(P.broadcast(later), [PART, *key], "left").select(
        *key, P.col("at").alias("after"), (answers[0] if slots is None else P.array(*answers)).alias("next")
    )


def itemset_places(spans: DataFrame) -> DataFrame:
    """(items, size, place, freq): the itemsets of a size numbered from 0."""
    sizes = Window.partitionBy("size").orderBy("items")
    return (
        spans.select("items", P.size("items").alias("size"), "freq")
        .distinct()
        .withColumn("place", P.row_number().over(sizes) - 1)
    )


def next_itemsets(lists: DataFrame, spans: DataFrame, places: DataFrame, slots: int) -> DataFrame:
    """(owner, size, slice, after, next): when each itemset next occurs, for every step of an owner.

    One row holds the answers of ``slots`` itemsets of a size; rows in which none occurs again are left out.
    """
    coded = places.select(
        "items",
        "size",
        P.floor(P.col("place") / slots).cast("int").alias("slice"),
        (P.col("place") % slots).alias("slot"),
    )
    key = ["owner", "size", "slice"]
    steps = lists.join(coded, "items").select(*key, "slot", "step")
    ends = spans.join(coded, "items").groupBy(*key).agg(P.max("last").alias("last"))
    # the items of an itemset are itemsets, so these are all steps of the lists
    points = lists.filter(P.size("items") == 1).select("owner", P.col("step").alias("after")).distinct()
    probes = points.join(ends, "owner").filter(P.col("after") < P.col("last")).select(*key, "after")
    return next_steps(probes, steps, key, slots)


def meet_next(ends: DataFrame, nexts: DataFrame) -> DataFrame:
    """(owner, id, size, slice, next): each prefix with the itemsets that follow the step at which it ends.

    They meet by owner and step, so the prefixes and steps of one long sequence are spread like any
    others. Both sides grow with the table: neither is sent to all, whatever its size.
    """
    after = nexts.select("owner", P.col("after").alias("step"), "size", "slice", "next")
    return ends.join(after.hint("merge"), ["owner", "step"]).drop("step")


def followers(met: DataFrame, slots: int) -> DataFrame:
    """(owner, before, size, place, step): the patterns of one more itemset that an owner holds, and their ends."""
    place = (P.col("slice") * slots + P.col("slot")).alias("place")
    return (
        met.select("owner", P.col("id").alias("before"), "size", "slice", P.posexplode("next").alias("slot", "step"))
        .filter("step IS NOT NULL")
        .select("owner", "before", "size", place, "step")
    )


def frequent_sequences_by_lists(
    rows: DataFrame,
    sequence: Sequence[str],
    step: str,
    item: str,
    min_support: float = 0.5,
    max_length: int = 5,
) -> DataFrame:
    """(sequence, freq) of ordered itemset patterns, from long rows (sequence, step, item).

    A pattern of ``max_length`` items or fewer is frequent where ``ceil(min_support * sequences)``
    sequences hold its itemsets, each within one step, at steps that rise. Items of an itemset
    are sorted. Repeated rows count once. A null step or item holds nothing, but its sequence
    counts in the total; null sequence keys are one sequence. No rows give no patterns.

    Sequences and itemsets go by numbers. Supports are counted before the ends, which only frequent
    patterns get, and those of full length need none.
    """
    held = rows.select(
        P.struct(*sequence).alias("key"), P.col(step).alias("step"), P.col(item).alias("item")
    )
    held = materialize(held.distinct(), "held")
    # the ids are those of the written rows, here and below
    owners = held.select("key").distinct().withColumn("owner", P.monotonically_increasing_id())
    owners = materialize(owners, "owners")
    need = max(1, math.ceil(min_support * owners.count()))
    facts = held.dropna(subset=["step", "item"]).join(owners, "key").select("owner", "step", "item")
    lists, spans = itemset_lists(materialize(facts, "facts"), need, max_length)
    places = materialize(itemset_places(spans), "places")
    slots = min(SLOTS, 1 + (places.agg(P.max("place")).first()[0] or 0))
    nexts = None
    found: list[DataFrame] = []  # one table a length: id, before, size, place, sequence, freq
    supports: list[DataFrame] = []  # one table a length of the prefix: before, size, place, freq
    meetings: list[DataFrame] = []  # one table a length of the prefix: see meet_next

    for length in range(1, max_length + 1):
        patterns = places.filter(P.col("size") == length).select(
            P.lit(ALONE).cast("long").alias("before"), "size", "place", P.array("items").alias("sequence"), "freq"
        )
        for n, (level, often) in enumerate(zip(found, supports, strict=True), 1):
            grown = (
                often.filter(P.col("size") == length - n)
                .join(places.select("size", "place", "items"), ["size", "place"])
                .join(level.select(P.col("id").alias("before"), "sequence"), "before")
                .withColumn("sequence", P.array_append("sequence", P.col("items")))
            )
            patterns = patterns.unionByName(grown.select(*patterns.columns))
        level = materialize(patterns.withColumn("id", P.monotonically_increasing_id()), "patterns")
        found.append(level)
        if length == max_length or level.isEmpty():
            break
        if nexts is None:
            short = places.filter(P.col("size") < max_length)  # a longer itemset follows nothing
            nexts = materialize(next_itemsets(lists, spans, short, slots), "nexts")
        names = level.select("before", "size", "place", "id")
        own = spans.join(places.select("items", "size", "place"), "items").filter(P.col("size") == length)
        own = own.join(names.filter(P.col("before") == ALONE), ["size", "place"])
        ends = [own.select("owner", "id", P.col("first").alias("step"))]
        for n, met in enumerate(meetings, 1):
            grown = followers(met.filter(P.col("size") == length - n), slots)
            ends.append(grown.join(names, ["before", "size", "place"]).select("owner", "id", "step"))
        met = meet_next(together(ends), nexts.filter(P.col("size") <= max_length - length))
        if length < max_length - 1:
            met = materialize(met, "met")
            meetings.append(met)
        often = followers(met, slots).groupBy("before", "size", "place").agg(P.count(P.lit(1)).alias("freq"))
        supports.append(materialize(often.filter(P.col("freq") >= need), "supports"))
    return together(found).select("sequence", "freq")
