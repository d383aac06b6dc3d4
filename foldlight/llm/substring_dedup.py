"""Removal of word windows that occur more than once, found through difference-cover anchors.

Texts are dealt by hash into slots of bounded size; text is shuffled once, every
step reads that shuffle. In each text, runs of ``window - period + 1`` words are
hashed only where the position modulo ``period`` lies in a difference cover:
for any two positions of a repeated window some common offset below the period
puts both on the cover, so every repeated window shares an aligned anchor with
its copy. Three steps follow, each a pass over the slots:

1. each slot sends its distinct anchor hashes, once each, to hash buckets; the
   buckets answer which of them occur twice or more;
2. windows that hold such an anchor are extended to their full length and sent
   as 128-bit hashes in the same way;
3. words under a window that the buckets confirm are removed.

A hash goes out once per slot however often it occurs there, so a passage in a
third of all texts costs one entry per slot. No pair of texts is ever formed.

Null text has no words. Repeated rows are copies of each other: from ``window``
words up each loses all of them. Equal or null keys do not matter, every row is judged
by itself. An empty table gives an empty result. Only key and text are read, so
names of other columns cannot clash.
"""

from __future__ import annotations

import math
import sys
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from foldlight.llm.words import Words, chunks, release, windows, words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ENTRIES = "bucket int, slot int, low binary, high binary, many binary"
ANSWERS = "slot int, low binary, high binary"
NAMES = ["bucket", "slot", "low", "high", "many"]


def difference_cover(period: int) -> list[int]:
    """A smallest set of residues whose differences give every residue."""
    size = 1
    while size * (size - 1) < period - 1:
        size += 1
    while True:
        for rest in combinations(range(2, period), max(0, size - 2)):
            cover = [0, 1, *rest][: min(size, period)]
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
        size += 1


class Anchors:
    """The geometry shared by the steps."""

    def __init__(self, window: int, period: int) -> None:
        if not 2 < period < window:
            raise ValueError("the period must be above 2 and below the window")
        self.window, self.period = window, period
        self.size = window - period + 1
        self.on_cover = np.isin(np.arange(period), difference_cover(period))

    def positions(self, w: Words) -> np.ndarray:
        """Word numbers at which anchors start, over all texts of ``w``."""
        counts = w.counts
        n = np.repeat(counts, counts)
        place = np.arange(len(w.starts)) - np.repeat(w.first[:-1], counts)
        return np.flatnonzero(
            self.on_cover[place % self.period] & (place <= n - self.size) & (n >= self.window)
        )

    def candidates(self, w: Words, repeated: np.ndarray) -> np.ndarray:
        """Word numbers at which windows start that hold an anchor at ``repeated``."""
        total = len(w.starts)
        sums = np.zeros(total + self.period + 1, np.int64)
        sums[repeated + 1] = 1
        np.cumsum(sums, out=sums)
        holds = sums[self.period : self.period + total] > sums[:total]
        return np.flatnonzero(holds & self.whole(w))

    def whole(self, w: Words) -> np.ndarray:
        """Whether a window starting at each word stays inside its text."""
        counts = w.counts
        left = np.repeat(w.first[1:], counts) - np.arange(len(w.starts))
        return left >= self.window


def _order(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.lexsort((high, low)) if len(high) else np.argsort(low, kind="stable")


def _heads(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted values begin."""
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    if len(high):
        new[1:] |= high[1:] != high[:-1]
    return np.flatnonzero(new)


def entries(slot: int, buckets: int, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    """The distinct hashes of a slot, one row per bucket, flagged where they occur twice in the slot."""
    order = _order(low, high)
    low, high = low[order], high[order] if len(high) else high
    heads = _heads(low, high)
    many = (np.diff(np.append(heads, len(low))) > 1).astype(np.uint8)
    low, high = low[heads], high[heads] if len(high) else high
    to = ((low >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    edges = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
    spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if len(to) else []
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(to[a]) for a, _ in spans], pa.int32()),
            pa.array([slot] * len(spans), pa.int32()),
            *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (low, high, many)),
        ],
        names=NAMES,
    )


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def answers(table: pa.Table) -> pa.Table:
    """Of one bucket's entries, those that occur twice or more, by slot."""
    low, high = _joined(table.column("low"), np.uint64), _joined(table.column("high"), np.uint64)
    many = _joined(table.column("many"), np.uint8)
    sizes = [len(x) // 8 for x in table.column("low").to_pylist()]
    slot = np.repeat(table.column("slot").to_numpy(), sizes)
    order = _order(low, high)
    low, high, many, slot = low[order], high[order] if len(high) else high, many[order], slot[order]
    heads = _heads(low, high)
    size = np.diff(np.append(heads, len(low)))
    again = np.repeat((size > 1) | (np.maximum.reduceat(many, heads) > 0), size)
    back = np.flatnonzero(again)
    back = back[np.argsort(slot[back], kind="stable")]
    low, high, slot = low[back], high[back] if len(high) else high, slot[back]
    edges = np.flatnonzero(np.diff(slot, prepend=-1, append=-1))
    spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if len(slot) else []
    return pa.table(
        [
            pa.array([int(slot[a]) for a, _ in spans], pa.int32()),
            *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (low, high)),
        ],
        names=["slot", "low", "high"],
    )


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of ``values`` in sorted ``known``, or -1."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _anchor_entries(shape: Anchors, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        found = [np.empty(0, np.uint64)]
        for part in chunks(table):
            w = words(part.column("text"))
            found.append(windows(w.hashes(), shape.size)[shape.positions(w)])
        slot = table.column("slot")[0].as_py()
        out = pa.Table.from_batches([entries(slot, buckets, np.concatenate(found), found[0])])
        del found
        release()
        return out

    return run


def _window_entries(shape: Anchors, buckets: int):
    def run(table: pa.Table, repeated: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], pa.int32())] * 2 + [pa.array([], pa.binary())] * 3, NAMES)
        known = np.sort(_joined(repeated.column("low"), np.uint64))
        low, high = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for part in chunks(table) if len(known) else ():
            w = words(part.column("text"))
            hashes = w.hashes()
            at = shape.positions(w)
            starts = shape.candidates(w, at[_member(windows(hashes, shape.size)[at], known) >= 0])
            if len(starts):
                low.append(windows(hashes, shape.window)[starts])
                high.append(windows(w.hashes(1), shape.window, 1)[starts])
        slot = table.column("slot")[0].as_py()
        out = pa.Table.from_batches([entries(slot, buckets, np.concatenate(low), np.concatenate(high))])
        del low, high
        release()
        return out

    return run


def _text_of(w: Words, keep: np.ndarray) -> pa.Array:
    """Per text, its kept words joined by one space."""
    starts, sizes = w.starts[keep], w.ends[keep] - w.starts[keep] + 1
    places = np.concatenate([[0], np.cumsum(sizes)])
    first = np.searchsorted(np.flatnonzero(keep), w.first)
    source = np.arange(places[-1]) + np.repeat(starts - places[:-1], sizes)
    out = np.append(w.data, np.uint8(32))[source]
    out[places[1:] - 1] = 32
    lows, highs = places[first[:-1]], np.maximum(places[first[1:]] - 1, places[first[:-1]])
    body = out.tobytes()
    return pa.array([body[a:b].decode() for a, b in zip(lows.tolist(), highs.tolist(), strict=True)], pa.string())


def _cleaned(shape: Anchors, schema: pa.Schema, carry: list[str]):

    def run(table: pa.Table, repeated: pa.Table) -> pa.Table:
        low, high = (_joined(repeated.column(c), np.uint64) for c in ("low", "high"))
        order = _order(low, high)
        low, high = low[order], high[order]
        out = []
        for part in chunks(table):
            w = words(part.column("text"))
            total = len(w.starts)
            edge = np.zeros(total + shape.window + 1, np.int64)
            if len(low):
                starts = np.flatnonzero(shape.whole(w))
                runs = windows(w.hashes(), shape.window)[starts]
                hit = _member(runs, low) >= 0
                starts, runs = starts[hit], runs[hit]
                if len(starts):
                    other = windows(w.hashes(1), shape.window, 1)[starts]
                    begin, end = np.searchsorted(low, runs, "left"), np.searchsorted(low, runs, "right")
                    same = high[begin] == other
                    for i in np.flatnonzero(~same & (end - begin > 1)).tolist():  # equal lower halves
                        same[i] = other[i] in high[begin[i] : end[i]]
                    edge[starts[same]] += 1
                    edge[starts[same] + shape.window] -= 1
            keep = np.cumsum(edge)[:total] == 0
            sums = np.concatenate([[0], np.cumsum(~keep)])
            out.append(
                pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in carry),
                        pa.array(w.counts, pa.int64()),
                        pa.array(sums[w.first[1:]] - sums[w.first[:-1]], pa.int64()),
                        _text_of(w, keep),
                    ],
                    schema=schema,
                )
            )
        release()
        return pa.Table.from_batches(out, schema)

    return run


def slot_count(total_bytes: int, least: int, grain: int = 1 << 16, most: int = 128 << 20) -> int:
    """Slots for a table: their size grows with the root of the table up to ``most`` bytes.

    Slots times buckets is the number of shuffled rows, hence the root, and buckets of their own size.
    """
    return max(least, math.isqrt(total_bytes // grain + 1), -(-total_bytes // most), 1)


def bucket_count(total_bytes: int, least: int, most: int = 1 << 30) -> int:
    """Buckets of hashes for a table: each answers for about ``most`` bytes of text, some half of it in hashes."""
    return max(least, -(-total_bytes // most), 1)


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = 35,
    period: int = 21,
    slots: int | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(key, carried columns, n_words, n_removed, kept_text): ``text`` without the words of repeated windows."""
    spark = docs.sparkSession
    named = [f"_carry{i}" for i in range(len(carry))]
    rows = docs.select(
        F.col(key).alias("key"),
        F.col(text).cast("string").alias("text"),
        *(F.col(c).alias(n) for c, n in zip(carry, named, strict=True)),
    )
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = slots
    if slots is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        slots, buckets = slot_count(size, least), bucket_count(size, least)
    shape = Anchors(window, period)
    # copies of one row are dealt apart by the task that reads them
    dealt = rows.withColumn("slot", F.pmod(F.xxhash64("key", "text", F.spark_partition_id()), F.lit(slots)).cast("int"))
    by_slot = dealt.groupBy("slot")
    anchors = by_slot.applyInArrow(_anchor_entries(shape, buckets), ENTRIES)
    repeated = anchors.groupBy("bucket").applyInArrow(answers, ANSWERS)
    found = by_slot.cogroup(repeated.groupBy("slot")).applyInArrow(_window_entries(shape, buckets), ENTRIES)
    confirmed = found.groupBy("bucket").applyInArrow(answers, ANSWERS)
    out = T.StructType([dealt.schema[c] for c in ("key", *named)])
    out = out.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    cleaned = _cleaned(shape, to_arrow_schema(out), ["key", *named])
    result = by_slot.cogroup(confirmed.groupBy("slot")).applyInArrow(cleaned, out)
    return result.select(
        F.col("key").alias(key),
        *(F.col(n).alias(c) for c, n in zip(carry, named, strict=True)),
        "n_words",
        "n_removed",
        "kept_text",
    )
