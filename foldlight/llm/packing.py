"""Packing of token sequences: best-fit decreasing per partition, certified by lower bounds.

A document is its token ids and an end id. Only a document above ``capacity`` is
cut: whole pieces of ``capacity`` at its end, the rest in front. Pieces are dealt
by hash into partitions of about ``part_rows`` rows; each is packed by best-fit
decreasing and its number of bins is compared with a lower bound from
dual-feasible functions. Equal numbers certify that the partition cannot use
fewer bins. Partitions with a gap exchange their pieces by another hash and are
packed again. Then, while the whole table uses more bins than the bound of its
length histogram, the pieces of bins with room left are exchanged as well. A
new packing replaces an old one only if it needs fewer bins.

The shuffles carry keys and lengths, not tokens. The driver sees sums and a
histogram of at most ``capacity`` lengths.

Null text is an empty document: the end id alone. Ties are broken by key and
piece, repeated rows are packed each for itself, an empty table gives an empty
result. Columns named in ``carry`` are kept, others are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlight.llm.encoders import encoder
from foldlight.llm.words import tidy
from foldlight.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Least bins for ``counts[x]`` items of each length x, by two families of dual-feasible functions."""
    x = np.arange(capacity + 1)
    counts = np.asarray(counts, np.int64)
    volume = np.concatenate([[0], np.cumsum(counts * x)])
    number = np.concatenate([[0], np.cumsum(counts)])
    best = -(-int(volume[-1]) // capacity)
    # lengths above capacity - k fill a bin, lengths below k count nothing
    k = np.arange(1, capacity // 2 + 1)
    large = (number[-1] - number[capacity - k + 1]) * capacity
    middle = volume[capacity - k + 1] - volume[k]
    if len(k):
        best = max(best, -(-int((large + middle).max()) // capacity))
    # staircases with k steps; lengths on a step keep their share
    for k in range(1, min(64, capacity)):
        share = np.where((k + 1) * x % capacity == 0, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((share * counts).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, place in the bin) of lengths given in falling order, and the number of bins."""
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have left
    some = 0  # bit r is set where room[r] is not empty
    used = 0
    for i, length in enumerate(lengths.tolist()):
        fits = some >> length
        if fits:
            left = length + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                some ^= 1 << left
        else:
            left, b = capacity, used
            used += 1
        bins[i], places[i] = b, capacity - left
        left -= length
        if left:
            room[left].append(b)
            some |= 1 << left
    return bins, places, used


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(key, piece, start, length, ids): pieces of at most ``capacity`` ids, little-endian unsigned 32-bit."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "piece", "start", "length", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], "<u4")
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            for low in range(0, len(texts), 512):
                part = texts[low : low + 512]
                owner, number, start, length, ids = [], [], [], [], []
                for i, tokens in enumerate(encode(part)):
                    whole = np.concatenate([tokens.astype("<u4", copy=False), end])
                    first = len(whole) % capacity or min(len(whole), capacity)
                    cuts = [0, *range(first, len(whole) + 1, capacity)]
                    for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        owner.append(low + i)
                        number.append(j)
                        start.append(a)
                        length.append(b - a)
                        ids.append(whole[a:b].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(pa.array(owner, pa.int32())),
                        pa.array(number, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=names,
                )

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    pieces = rows.mapInArrow(tidy(run), f"key {kind}, piece int, start long, length long, ids binary")
    return pieces.withColumnRenamed("key", key)


def _packer(capacity: int, round_number: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("key", "ascending"), ("piece", "ascending")])
        lengths = table.column("length").to_numpy()
        bins, places, used = best_fit(lengths, capacity)
        fill = np.bincount(bins, lengths, minlength=used).astype(np.int64)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        part = table.column("part")[0].as_py()
        n = len(lengths)
        more = {
            "sequence_id": (round_number << 56) + (part << 24) + bins,
            "offset": places,
            "open": fill[bins] < capacity,
            "bins": np.full(n, used),
            "bound": np.full(n, bound),
        }
        for name, values in more.items():
            table = table.append_column(name, pa.array(values))
        return table

    return run


PLACED = "sequence_id long, offset long, open boolean, bins long, bound long"


def _packed(items: DataFrame, round_number: int, capacity: int, part_rows: int) -> DataFrame:
    parts = max(1, -(-items.count() // part_rows))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("_place", F.lit(round_number)), F.lit(parts)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    packed = dealt.groupBy("part").applyInArrow(_packer(capacity, round_number), f"{schema}, {PLACED}")
    return materialize(packed, "packed")


def _bins(packed: DataFrame) -> int:
    return packed.select("sequence_id").distinct().count()


def pack(
    pieces: DataFrame,
    capacity: int = 2048,
    key: str = "doc_id",
    carry: tuple[str, ...] = (),
    part_rows: int = 32_768,
    rounds: int | None = None,
) -> DataFrame:
    """(key, piece, length, carried columns, sequence_id, offset) for rows (key, piece, length, ...).

    Pieces are dealt by a number written with them, so the pieces of one key spread like any others. Gaps are
    exchanged while a round saves more than one sequence in 100,000, or at most ``rounds`` times.
    """
    names = ["key", "piece", "length", "_place", *carry]
    items = pieces.select(F.col(key).alias("key"), "piece", F.col("length").cast("long"), *carry)
    items = items.withColumn("_place", F.monotonically_increasing_id())
    items = materialize(items, "pieces")
    packed = _packed(items, 0, capacity, part_rows)
    histogram = items.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for row in histogram:
        counts[row["length"]] = row["count"]
    bound, used = lower_bound(counts, capacity), _bins(packed)
    gap, room = F.col("bins") > F.col("bound"), F.col("open")
    chosen, again = gap, 0
    while used > bound and (rounds is None or again < rounds):
        again += 1
        if chosen is gap and packed.filter(gap).isEmpty():
            chosen = room
        moved = packed.filter(chosen)
        renewed = _packed(moved.select(*names), again, capacity, part_rows)
        saved = _bins(moved) - _bins(renewed)
        if saved > 0:
            packed, used = packed.filter(~chosen).unionByName(renewed), used - saved
        if saved > used // 100_000:
            continue
        if chosen is gap:
            chosen = room
        else:
            break
    return packed.select("key", "piece", "length", *carry, "sequence_id", "offset").withColumnRenamed("key", key)
