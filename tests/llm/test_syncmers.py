"""Edited texts against Python, properties of closed syncmers and their fingerprints."""

import hashlib

import pytest
from pyspark.sql import functions as F

from foldlight.llm.syncmers import SIZE, _anchors, as_text, fingerprint, fingerprints, likeness


def expected(rows):
    """doc_id -> (characters, digest of the edited text), next by ascending doc_id."""
    out = {}
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        out[key] = (len(text), hashlib.sha256(edited.encode()).hexdigest())
    return out


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_edited_texts(spark, documents, texts, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = fingerprints(documents.repartition(3)).withColumn("sha", F.sha2("edited", 256)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(rows) == len(texts)
    want = expected(sorted(texts.items()))
    assert {r.doc_id: (r.n_chars, r.sha) for r in rows} == want
    edited = sorted(r.near_edited for r in rows if r.n_chars > 100)
    assert sum(edited) / len(edited) > 0.6
    after = [r.near_next for r in rows]
    assert all(0 <= x <= 1 for x in edited + after) and sum(after) / len(after) < 0.1


def test_no_python_and_one_text_shuffle(documents):
    plan = fingerprints(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan
    assert "shufflepartitionidpassthrough" in plan


def test_anchors_are_closed_syncmers(spark):
    words = [f"w{i * 7919 % 1009}" for i in range(300)]
    df = spark.createDataFrame([(words,)], "u array<string>")
    got = df.select(_anchors(F.col("u")).alias("a")).first().a
    pairs = spark.createDataFrame([(i, words[i], words[i + 1]) for i in range(299)], "i int, x string, y string")
    h = {r.i: r.h for r in pairs.select("i", F.xxhash64("x", "y").alias("h")).collect()}
    mask = (1 << 20) - 1
    want = [i for i in range(297) if min(h[i], h[i + 1], h[i + 2]) in (h[i], h[i + 2])]
    assert [x & mask for x in got] == want


def test_anchors_away_from_an_edit_stay(spark):
    words = [f"w{i * 31 % 997}" for i in range(60)]
    other = [*words[:30], "new", "words", *words[30:]]
    df = spark.createDataFrame([(" ".join(words), " ".join(other))], "a string, b string")
    r = df.select(
        fingerprint(F.col("a"), 1000).alias("a"),
        fingerprint(F.col("b"), 1000).alias("b"),
        likeness(fingerprint(F.col("a"), 1000), fingerprint(F.col("b"), 1000)).alias("like"),
    ).first()
    mask = (1 << 20) - 1
    left = {x for x in r.a if x & mask <= 26}
    assert left == {x for x in r.b if x & mask <= 26}
    assert {x >> 20 for x in r.a if x & mask >= 30} <= {x >> 20 for x in r.b}
    assert r.like > 0.8


def test_size_and_order(spark, documents):
    rows = documents.select(fingerprint(F.col("text")).alias("f"), as_text(fingerprint(F.col("text"))).alias("t")).collect()
    for r in rows:
        assert len(r.f) <= SIZE and r.f == sorted(r.f) and len(r.t) == 16 * len(r.f)
        assert len({x >> 20 for x in r.f}) == len(r.f)


def test_odd_rows(odd):
    rows = fingerprints(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_chars == 0 and by[1][0].edited == "" and by[1][0].anchors == []
    assert by[1][0].near_edited == 1.0 and by[1][0].near_next == 1.0  # the next is empty as well
    assert by[3][0].near_next == 0.0  # nothing against "one"
    assert by[4][0].anchors == by[5][0].anchors and by[4][0].near_next == 1.0
    assert by[7][0].anchors == by[7][1].anchors == by[None][0].anchors
    assert by[10][0].edited[-1] == "x"
    last = by[10][0]
    assert last.edited == "x" * 225_000 + "one two three four five six"  # after the last: the first, a null key


def test_empty(empty):
    assert fingerprints(empty).count() == 0


def test_single_row(documents):
    one = documents.limit(1)
    r = fingerprints(one).first()
    text = one.first().text
    assert r.near_next == 1.0 and r.edited == text[: len(text) - len(text) // 4] + text[: len(text) // 4]
