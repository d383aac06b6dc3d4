"""Mixes against plain sharing of words and a plain greedy over sorted places."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from tests_llm_helpers import WORD

from foldlight.llm.mixing import mix
from foldlight.llm.queries import source_mix


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, repeat=2):
    """Excess over a source's stop is shared by weight among the others until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, target, left = set(names), {}, share * sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if unit * weight[s] > repeat * sizes[s]}
        if not above:
            return target | {s: unit * weight[s] for s in open_}
        for s in above:
            target[s] = repeat * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def plain_mix(rows, **options):
    """(key, size, source size, target, taken) sorted as text; rows are (key, text, source)."""
    sizes, members = Counter(), defaultdict(list)
    for key, text, source in rows:
        size = len(WORD.findall(text or ""))
        place = hashlib.md5(f"{'' if key is None else key}:{text or ''}".encode()).hexdigest()
        sizes[source] += size
        members[source].append((place, key, size))
    target, out = plain_targets(sizes, **options), []
    for source, found in members.items():
        whole = int(target[source] // sizes[source]) if sizes[source] else 0
        budget, at, ended = target[source] - whole * sizes[source], 0, False
        for _, key, size in sorted(found, key=lambda r: r[0]):
            more = size > 0 and not ended and budget > 0
            if more and at + size >= budget:
                ended, more = True, at + size - budget <= budget - at
            at += size
            out.append((key, size, sizes[source], target[source], size * (whole + more)))
    return out


def same(got, want):
    def key(r):
        return str((*r[:3], r[4]))

    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [(*r[:3], r[4]) for r in got] == [(*r[:3], r[4]) for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_query(spark, folder, documents):
    got = source_mix(spark, folder).collect()
    same(got, plain_mix([(r.doc_id, r.text, r.source) for r in documents.collect()]))
    assert all(r.taken <= 2 * r.size for r in got)


def test_near_targets_and_layout(spark):
    """A third of the rows in one source, few long rows; the same result from another layout and order."""
    rng = random.Random(1)
    rows = []
    for i in range(6000):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "é", "Z", "", None])
        rows.append((i, "w " * (5000 if i % 997 == 0 else rng.randrange(60)), source))
    schema = "doc_id long, text string, source string"
    first = mix(spark.createDataFrame(rows, schema).repartition(7)).collect()
    rng.shuffle(rows)
    again = mix(spark.createDataFrame(rows, schema).repartition(3)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    same([(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in first], plain_mix(rows))
    for source in {r.source for r in first}:
        part = [r for r in first if r.source == source]
        assert abs(sum(r.taken for r in part) - part[0].target) <= max(r.size for r in part) / 2


def test_copies_of_one_row(spark):
    """Rows equal in key and text share a place; still only some of them are taken."""
    rows = [(5, "a b c", "x")] * 3000 + [(i, "a b", "x") for i in range(10, 40)] + [(1, "q", "y")] * 5000
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(9)
    got = mix(df, weights=(1, 1), share=0.5).collect()
    for source in "xy":
        part = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 1.5
    same([(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got], plain_mix(rows, weights=(1, 1), share=0.5))


def test_other_shares(spark, documents):
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    for options in ({"share": 0.2}, {"share": 2, "repeat": 2}, {"share": 2.6, "repeat": 3, "weights": (1, 7)}):
        got = mix(documents, **options).select("doc_id", "size", "source_size", "target", "taken").collect()
        same(got, plain_mix(rows, **options))


def test_smaller_budgets_are_nested(spark, documents):
    small, large = ({r.doc_id: r.copies for r in mix(documents, share=s, weights=(1,)).collect()} for s in (0.4, 0.7))
    assert all(large[i] >= n for i, n in small.items()) and large != small


def test_odd_rows(odd):
    got = mix(odd.withColumnRenamed("key", "source").withColumn("size", odd.n)).collect()
    want = plain_mix([(r.doc_id, r.text, r.key) for r in odd.collect()])
    same([(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got], want)


def test_no_words(spark):
    rows = [(1, None, None), (2, " ", "a"), (3, "", None)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 3


def test_empty(empty):
    assert mix(empty.withColumn("source", empty.key)).count() == 0
