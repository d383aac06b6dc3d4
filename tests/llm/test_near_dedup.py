"""Near-duplicate components against brute force over all pairs of full sets."""

import random

from tests_llm_helpers import brute_components, shingles

from foldlight.llm.near_dedup import NearDuplicates, near_duplicates


def expected(rows):
    """(key, set size, component, kept) per row; keys are unique."""
    sets = [shingles(t) for _, t in rows]
    component = brute_components(rows, sets)
    return sorted((k, len(s), component[k], component[k] == k) for (k, _), s in zip(rows, sets, strict=True))


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_given_documents(documents, texts):
    assert found(near_duplicates(documents)) == expected(sorted(texts.items()))


def planted(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []

    def text(n):
        return [rng.choice(vocab) for _ in range(n)]

    def edited(words, k):
        words = list(words)
        for _ in range(k):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        return words

    base = text(120)
    group = [edited(base, rng.choice([1, 1, 2])) for _ in range(60)]  # hot group of near copies
    chain = [text(200)]
    for _ in range(25):
        chain.append(edited(chain[-1], 2))  # only neighbours are alike
    family = text(150)
    loose = [edited(family, 9) for _ in range(40)]  # alike, but mostly below the threshold
    for words in (*group, *chain, *loose, *[text(rng.randrange(1, 90)) for _ in range(40)]):
        rows.append(" ".join(words))
    rows += rows[:8] * 2  # exact copies
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_planted_groups(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(near_duplicates(docs)) == expected(rows)


def test_odd_rows(odd):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i in (1, 2, 3):
        assert (by[i][0].n_shingles, by[i][0].component_id, by[i][0].kept) == (0, i, True)
    assert [(r.component_id, r.kept) for r in by[4] + by[5]] == [(4, True), (4, False)]
    assert [(r.component_id, r.kept) for r in by[None]] == [(7, False)]
    assert [(r.component_id, r.kept) for r in by[7]] == [(7, True), (7, True)]
    assert by[9][0].n_shingles == 1 and by[10][0].n_shingles == 1


def test_every_wordless_row_survives(spark):
    rows = [(None, None, "a"), (None, None, "b"), (None, " \n", "c"), (None, " \n", "d"), (5, "", "e"), (5, "", "e")]
    rows += [(6, "one", "f"), (6, "one", "g"), (7, "one", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [tuple(r) for r in NearDuplicates(docs).survivors().collect()]
    assert sorted(r[2] for r in got if r[1] != "one") == ["a", "b", "c", "d", "e", "e"]
    assert [r[0] for r in got if r[1] == "one"] == [6]


def test_empty(empty):
    out = near_duplicates(empty)
    assert out.count() == 0
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}


def test_estimate_is_close(spark):
    import numpy as np

    from foldlight.llm.near_dedup import sketches

    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 2000):
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: max(1, n * 9 // 10)], rng.integers(0, 1 << 60, n // 10).astype(np.uint64)]))
        s = sketches([a, b], 400)
        assert (s < np.iinfo(np.uint64).max).all()
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - j) < 0.08
