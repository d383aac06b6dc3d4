"""Repeated windows against brute force over all windows."""

import random

import pytest
from tests_llm_helpers import brute_repeats

from foldlight.llm.substring_dedup import bucket_count, difference_cover, remove_repeats, slot_count

def expected(rows, window=35):
    numbered = brute_repeats(list(enumerate(t for _, t in rows)), window)
    return sorted(((key, *numbered[i]) for i, (key, _) in enumerate(rows)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("slots", [1, 7, None])
def test_given_documents(documents, texts, slots):
    assert found(remove_repeats(documents, slots=slots)) == expected(list(texts.items()))


def planted():
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(900)]
    passages = [[rng.choice(vocab) for _ in range(n)] for n in (34, 35, 36, 55, 56, 90)]
    rows = []
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(0, 4)):
            words += [rng.choice(vocab) for _ in range(rng.randrange(0, 50))]
            words += rng.choice(passages)
        rows.append(rng.choice([" ", "\n", " \t "]).join(words))
    rows.append(" ".join(["same"] * 36))  # overlaps itself
    rows.append(" ".join(["same"] * 34))
    return list(enumerate(rows + rows[:3]))


@pytest.mark.parametrize("window, period", [(35, 21), (35, 13), (20, 7), (8, 7)])
def test_planted_passages(spark, window, period):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(remove_repeats(docs, window=window, period=period, slots=5)) == expected(rows, window)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(remove_repeats(odd)) == expected(rows)


def test_empty(empty):
    assert remove_repeats(empty).count() == 0


def test_text_is_shuffled_once(documents):
    plan = remove_repeats(documents, slots=4)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 2


@pytest.mark.parametrize("period", [3, 7, 13, 21, 31])
def test_difference_cover(period):
    cover = difference_cover(period)
    for a in range(period):
        for b in range(period):
            assert any((a + d) % period in cover and (b + d) % period in cover for d in range(period))


def test_slots_follow_the_size():
    assert slot_count(0, 1) == 1
    assert slot_count(175 << 40, 200) * (128 << 20) >= 175 << 40
    assert bucket_count(175 << 40, 200) == 175 << 10 and bucket_count(0, 8) == 8
