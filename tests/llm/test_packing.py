"""Pieces against the tokenizer, packings against exhaustive search and bounds."""

import itertools
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests_llm_helpers import check_layout, check_pieces

from foldlight.llm.packing import best_fit, lower_bound, pack, token_pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("capacity, part_rows", [(2048, 32_768), (300, 70)])
def test_given_documents(documents, texts, capacity, part_rows):
    pieces = token_pieces(documents, PATH, capacity).withColumn("crc", F.crc32("ids"))
    rows = pack(pieces, capacity, carry=("start", "crc"), part_rows=part_rows).collect()
    check_pieces(rows, texts, capacity, PATH)
    used = check_layout(rows, capacity)
    bound = lower_bound(np.bincount([r.length for r in rows], minlength=capacity + 1), capacity)
    assert bound <= used <= bound + (1 if part_rows > 200 else 0.03 * bound)


def least_bins(lengths, capacity):
    best = len(lengths)

    def place(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(lengths):
            best = len(room)
            return
        for b in range(len(room)):
            if room[b] >= lengths[i]:
                room[b] -= lengths[i]
                place(i + 1, room)
                room[b] += lengths[i]
        room.append(capacity - lengths[i])
        place(i + 1, room)
        room.pop()

    place(0, [])
    return best


def test_bounds_and_best_fit():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([10, 17, 30])
        lengths = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 9))), reverse=True)
        exact = least_bins(lengths, capacity) if lengths else 0
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        bins, places, used = best_fit(np.array(lengths, np.int64), capacity)
        assert bound <= exact <= used
        fill = defaultdict(int)
        for b, p, x in zip(bins, places, lengths, strict=True):
            assert fill[b] == p
            fill[b] += x
        assert len(fill) == used and all(v <= capacity for v in fill.values())


def test_large_items_are_bounded():
    counts = np.zeros(101, np.int64)
    counts[51] = 40  # the volume alone allows 21 bins
    assert lower_bound(counts, 100) == 40


def test_gaps_are_exchanged(spark):
    """One piece per partition: only exchange brings pieces together."""
    rows = [(i, 0, x) for i, x in enumerate(itertools.islice(itertools.cycle([30, 70, 45, 55, 5]), 400))]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    alone = check_layout(pack(pieces, 100, part_rows=20, rounds=0).collect(), 100)
    joined = check_layout(pack(pieces, 100, part_rows=20, rounds=3).collect(), 100)
    assert joined < alone
    assert joined >= lower_bound(np.bincount([r[2] for r in rows], minlength=101), 100)


def test_odd_rows(odd):
    pieces = token_pieces(odd, PATH).withColumn("crc", F.crc32("ids"))
    rows = pack(pieces, carry=("start", "crc")).collect()
    check_layout(rows, 2048)
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id != 7}
    check_pieces([r for r in rows if r.doc_id != 7], texts, 2048, PATH)
    assert len([r for r in rows if r.doc_id == 7]) == 2


def test_empty(empty):
    assert pack(token_pieces(empty, PATH)).count() == 0
