"""Base spans against the contract's patterns, added spans on planted cases, estimation on simulated votes."""

import hashlib
import random
import re

import numpy as np
import pytest
from tests_llm_helpers import base_spans

from foldlight.llm.pii import ABSTAIN, KINDS, LABELERS, candidates, emails, estimate, fit_spans
from foldlight.llm.queries import pii

def base(text):
    return [f"{KINDS[k]}:{s}:{e}" for s, k, e in base_spans(text)]


def test_query(spark, folder, texts):
    rows = pii(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in KINDS]
        assert set(want) <= set(r.spans.split(","))


def test_additions_on_given_documents(spark):
    """Numbers that fail a check stay out; a phone number that runs into an address is found."""
    folder = "/root/testdata/sf0.1"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    added = []
    for r in pii(spark, folder).collect():
        more = set(filter(None, r.spans.split(","))) - set(base(texts[r.doc_id]))
        added += [(m, texts[r.doc_id]) for m in more]
    assert 0 < len(added) < 10
    for span, text in added:
        kind, start, end = span.split(":")
        assert kind == "phone"
        assert re.fullmatch(r"\+[0-9] \([0-9]{3}\) [0-9]{3}-[0-9]{4}", text[int(start) : int(end)])


def noise(rng):
    pool = ["a", "1", "22", "333", "4111 1111 1111 1111", ".", "..", "@", "-", "+", "+1 ", "(0)", " ", "\n", "x@y.z"]
    pool += ["1.2.3.4", "300.1.1.1", "é", "com", "%", "@a.b-", "+49 30 123456", "5-5"]
    return "".join(rng.choice(pool) for _ in range(rng.randrange(1, 60)))


@pytest.mark.parametrize("seed", range(4))
def test_base_on_noise(seed):
    rng = random.Random(seed)
    for _ in range(1500):
        text = noise(rng)
        got = sorted((s, KINDS.index(k), e) for k, s, e, check in candidates(text) if check == 1)
        assert [f"{KINDS[k]}:{s}:{e}" for s, k, e in got] == base(text), text


def test_long_runs_are_linear():
    for text in ("x" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1 " * 100_000, "1 " * 200_000):
        candidates(text)
    assert list(emails("a" * 1000 + "@b.c")) == [(0, 1004)]


def test_octet_of_many_zeros():
    votes = {t[-7:]: [c[3] for c in candidates(t) if c[0] == "ip"] for t in ("0" * 5000 + x for x in ("1.1.2.3", "0.1.2.3"))}
    assert votes == {"1.1.2.3": [1], "0.1.2.3": [1]}
    assert [c[3] for c in candidates("0" * 5000 + "256.1.2.3") if c[0] == "ip"] == [0]


PLANTED = [
    ("Call us, phone (212) 555-0147 any day.", "phone:15:29"),
    ("Write to jane.doe (at) mail (dot) example (dot) com please.", "email:9:51"),
    ("Server version 10.2.3.4444 is out.", ""),
    ("Card 4111 1111 1111 1112 is not valid.", ""),
    ("Nothing here but 12 apples and 3.14.", ""),
]


def test_added_spans(spark, documents):
    rows = [(1000 + i, t) for i, (t, _) in enumerate(PLANTED)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit_spans(documents.select("doc_id", "text").union(more))
    got = {r.doc_id: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans) for r in model.spans(more).collect()}
    assert got == {1000 + i: want for i, (_, want) in enumerate(PLANTED)}
    clean = {r.doc_id: r.text for r in model.redact(more).collect()}
    assert clean[1000] == "Call us, phone [PHONE] any day." and clean[1004] == PLANTED[4][0]


def test_estimates_recover_reliabilities():
    rng = np.random.default_rng(2)
    n = 60_000
    truth = rng.random(n) < 0.6
    right = np.array([0.9999, 0.75, 0.9, 0.85, 0.65])
    votes = np.where(rng.random((n, 5)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((n, 5)) < 0.3] = ABSTAIN
    rows, counts = np.unique(np.column_stack([rng.integers(0, 4, n), votes]), axis=0, return_counts=True)
    p, _, table = estimate(rows, counts.astype(float))
    for j in range(1, len(LABELERS)):
        said = table[j][1, :2] / table[j][1, :2].sum()
        assert abs(said[1] - right[j]) < 0.05
    clear = np.abs((rows[:, 1:] == 1).sum(1) - (rows[:, 1:] == 0).sum(1)) >= 4
    assert ((p > 0.5) == ((rows[:, 1:] == 1).sum(1) > 2))[clear].all()


def test_odd_rows(odd):
    model = fit_spans(odd)
    rows = model.spans(odd).collect()
    assert len(rows) == odd.count() and all(r.spans == [] for r in rows)
    back = model.redact(odd)
    assert back.columns == odd.columns
    assert sorted(map(str, back.collect())) == sorted(map(str, odd.collect()))


def test_empty(empty):
    model = fit_spans(empty)
    assert model.spans(empty).count() == 0 and model.redact(empty).count() == 0


def test_spans_of_a_long_text_in_linear_time(documents):
    """A megabyte of addresses and numbers; accepted spans overlap no other."""
    import time

    model = fit_spans(documents)
    text = "mail ann at example dot org or +1 415 555 0100 or 10.0.0.1, 415-555-0133 and bob@example.org; " * 11_000
    begun = time.perf_counter()
    found = model.find(text)
    assert time.perf_counter() - begun < 20
    base = [(s, e) for s, _, e, b, _ in found if b]
    assert len(base) >= 33_000
    ends = 0
    for start, _, end, checked, _ in found:
        assert checked or start >= ends
        ends = max(ends, end)
