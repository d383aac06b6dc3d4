"""Words and hashes against plain Python; components against union-find."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from foldlight.llm import words as W
from foldlight.llm.graph import components

TEXTS = ["", None, " a  b\n\x0bc d ", "x", " ", "é ü ñ  ß", "one two three " * 40, "z" * 50, "\tq"]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words(kind):
    array = pa.array(["skipped", *TEXTS], kind).slice(1)
    w = W.words(array)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    got = [
        [bytes(w.data[w.starts[i] : w.ends[i]]).decode() for i in range(w.first[t], w.first[t + 1])]
        for t in range(len(TEXTS))
    ]
    assert got == want


def test_no_texts():
    w = W.words(pa.array([], pa.string()))
    assert len(w.hashes()) == 0 and len(W.windows(w.hashes(), 5)) == 0


def test_blocks_do_not_change_hashes(monkeypatch):
    w = W.words(pa.array([t for t in TEXTS if t] * 3))
    whole = [w.hashes(lane, low) for lane in (0, 1) for low in (False, True)]
    runs = W.windows(whole[0], 5)
    monkeypatch.setattr(W, "BLOCK", 7)
    assert all((a == b).all() for a, b in zip(whole, [w.hashes(lane, low) for lane in (0, 1) for low in (False, True)]))
    assert (W.windows(whole[0], 5) == runs).all()


def test_hashes_tell_words_apart():
    texts = [f"{'' if i % 2 else 'A'}w{i}" for i in range(20_000)]
    w = W.words(pa.array([" ".join(texts)]))
    for lane in (0, 1):
        assert len(np.unique(w.hashes(lane))) == len(texts)
    assert (W.words(pa.array(["AbC x"])).hashes(lower=True) == W.words(pa.array(["abc X"])).hashes(lower=True)).all()


def test_chunks_cover_the_batch(monkeypatch):
    monkeypatch.setattr(W, "CHUNK", 20)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], ["i", "text"])
    parts = list(W.chunks(batch))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(len(TEXTS)))
    assert len(parts) > 3


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    edges += [(200 + i, 201 + i) for i in range(40)]  # a path
    edges += [(300, 301 + i) for i in range(50)]  # a star
    edges = [(a, b) for a, b in edges if a != b]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    roots = components(spark.createDataFrame(edges, "a long, b long"))
    got = {r.node: r.root for r in roots.collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")) is None
