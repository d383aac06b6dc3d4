"""Fingerprints from closed syncmers, with SQL functions only.

A text is a row of units: words, words above 16 characters cut into parts. A k-mer
is ``K`` units; its inner substrings are the ``K - S + 1`` runs of ``S`` units. A
k-mer is an anchor if the smallest hash of its inner substrings lies at either
end. Whether it is one depends on its own units alone, so text around an edit
keeps its anchors. A fingerprint holds the ``SIZE`` anchors with the smallest
hashes (of a text with fewer units than ``K`` each unit is one) as 16 hexadecimal
digits each: 11 of the hash, 5 of the position in units.

The likeness of two fingerprints matches anchors by hash, takes the median shift
between their positions and counts the anchors within ``SLACK`` units of it, as
a share of the larger fingerprint.

Null text counts as empty. Texts without a word have an empty fingerprint; two
empty ones have likeness 1, an empty and another one 0. Equal texts have equal
fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 4, 2
SIZE = 64
SLACK = 8
PLACE = 20  # bits of a position

UNIT = r"[^\x20\x09-\x0D]{1,16}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _upto(n: Column) -> Column:
    """0 .. n-1, empty below 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _coded(value: Column, place: Column) -> Column:
    low = F.lit((1 << PLACE) - 1).cast("long")
    return F.bitwise_not(low).bitwiseAND(value).bitwiseOR(place.cast("long").bitwiseAND(low))


def _anchors(units: Column) -> Column:
    inner = F.transform(_upto(F.size(units) - (S - 1)), lambda i: F.xxhash64(*(F.get(units, i + j) for j in range(S))))

    def chosen(h: Column) -> Column:
        def at(i: Column) -> Column:
            ends = F.least(F.get(h, i), F.get(h, i + (K - S)))
            middle = F.least(*(F.get(h, i + j) for j in range(1, K - S)), F.get(h, i + 1))
            value = F.xxhash64(*(F.get(h, i + j) for j in (*range(0, K - S, S), K - S)))
            return F.when(ends <= middle, _coded(value, i))

        return F.filter(F.transform(_upto(F.size(h) - (K - S)), at), lambda x: x.isNotNull())

    short = F.transform(units, lambda u, i: _coded(F.xxhash64(u), i))
    return F.when(F.size(units) >= K, let(inner, chosen)).otherwise(short)


def fingerprint(text: Column, size: int = SIZE) -> Column:
    """The ``size`` anchors with the smallest hashes as array<long>, sorted."""
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))

    def first_places(a: Column) -> Column:
        fresh = F.filter(
            a,
            lambda x, i: (i == 0) | (F.shiftright(x, PLACE) != F.shiftright(F.get(a, i - 1), PLACE)),
        )
        return F.slice(fresh, 1, size)

    return let(F.sort_array(let(units, _anchors)), first_places)


def as_text(anchors: Column) -> Column:
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of anchors that match at the usual shift, 0 to 1."""
    low = F.lit((1 << PLACE) - 1).cast("long")

    def hashes(x: Column) -> Column:
        return F.transform(x, lambda v: F.shiftright(v, PLACE))

    def shifts(both: Column) -> Column:
        x, y = both["x"], both["y"]

        def shift(h: Column) -> Column:
            place_a = F.get(both["a"], F.array_position(x, h).cast("int") - 1).bitwiseAND(low)
            place_b = F.get(both["b"], F.array_position(y, h).cast("int") - 1).bitwiseAND(low)
            return place_a - place_b

        return F.sort_array(F.transform(F.array_intersect(x, y), shift))

    def aligned(d: Column) -> Column:
        usual = F.get(d, F.floor(F.size(d) / 2).cast("int"))
        return F.size(F.filter(d, lambda v: F.abs(v - usual) <= SLACK))

    both = F.struct(a.alias("a"), b.alias("b"), hashes(a).alias("x"), hashes(b).alias("y"))
    most = F.greatest(F.size(a), F.size(b))
    same = let(let(both, shifts), aligned)
    return F.when(most == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same / most)


def _partition(key: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` are below or equal to the key, by binary search; null: 0."""
    if not bounds:
        return F.lit(0)
    steps = [1 << s for s in reversed(range(len(bounds).bit_length()))]
    ends = F.array(*map(F.lit, bounds))

    def step(at: Column, size: Column) -> Column:
        probe = F.get(ends, at + size - 1)
        return F.when(probe.isNotNull() & (probe <= key), at + size).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def with_next(docs: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """``docs`` (key, text) plus part and ``is_copy``, dealt so that the next row is in the same part.

    Rows are dealt by ranges of the numeric key. The first row of each part is
    also placed, flagged, at the end of the part before it; the first row of all
    goes to the end. So the next text needs one shuffle and no global sort.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    bounds = []
    if shares:
        found = docs.agg(F.percentile_approx(key, shares, 10_000).alias("b")).first()["b"]
        bounds = sorted(set(found or []))
    rows = docs.withColumn("part", _partition(F.col(key), bounds)).withColumn("tie", F.xxhash64("text"))
    heads = rows.groupBy("part").agg(F.min(F.struct(key, "tie")).alias("head"))
    # one row per part: (part, part before it in a circle)
    circle = Window.orderBy("part")
    whole = circle.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(
        F.coalesce(F.lag("part").over(circle), F.max("part").over(whole)).alias("to"),
        F.col(f"head.{key}").alias("head_key"),
        F.col("head.tie").alias("head_tie"),
    )
    match = F.col(key).eqNullSafe(F.col("head_key")) & (F.col("tie") == F.col("head_tie"))
    copies = rows.join(F.broadcast(heads), match).dropDuplicates(["to"])
    copies = copies.select(key, "text", F.col("to").alias("part"), "tie", F.lit(True).alias("is_copy"))
    both = rows.select(key, "text", "part", "tie", F.lit(False).alias("is_copy")).union(copies)
    return both.repartitionById(len(bounds) + 1, "part")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited, anchors, edited_anchors, near_edited, near_next) for every row.

    ``edited`` is the text with its last quarter replaced by the beginning of the
    next document's text, in order of the numeric key (null first, equal keys by a
    hash of the text). Repeated rows are neighbours of each other; an empty table
    gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    dealt = with_next(rows, "key").withColumn("anchors", fingerprint(F.col("text")))
    order = Window.partitionBy("part").orderBy("is_copy", F.col("key").asc_nulls_first(), "tie")
    paired = dealt.select(
        "key",
        "text",
        "anchors",
        "is_copy",
        F.lead("text").over(order).alias("next_text"),
        F.lead("anchors").over(order).alias("next_anchors"),
    ).filter(~F.col("is_copy"))
    size = F.char_length("text")
    quarter = F.floor(size / 4).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), size - quarter), F.substring("next_text", F.lit(1), quarter)
    )
    out = paired.withColumn("n_chars", size.cast("long")).withColumn("edited", edited)
    out = out.withColumn("edited_anchors", fingerprint(F.col("edited")))
    return out.select(
        F.col("key").alias(key),
        "n_chars",
        "edited",
        "anchors",
        "edited_anchors",
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
