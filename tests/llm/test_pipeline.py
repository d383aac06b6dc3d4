"""Every stage of the pipeline against a plain reading on its own input."""

import numpy as np
import public_tokenizers
import pytest
from tests_llm_helpers import brute_components, brute_repeats, redacted

import corpus_pipeline
from foldlight.llm.packing import lower_bound
from foldlight.llm.quality import features, fit_quality, sizes
from foldlight.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder), name)
        out.append((name, docs))
    return dict(out)


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "pii", "packing"]
    for name in list(steps)[:-1]:
        assert steps[name].columns == COLUMNS


def test_quality(spark, steps, folder):
    docs = steps["documents"]
    model = fit_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = set()
    for i, r in rows(docs).items():
        data = r.text.encode()
        bad, good = sizes(data, model.dictionaries)
        x = features(np.array([bad]), np.array([good]), np.array([len(data)]))
        if 1 / (1 + np.exp(-(model.weights[0] + x @ model.weights[1:])))[0] >= 0.7:
            want.add(i)
    got = rows(steps["quality"])
    assert set(got) == want and all(got[i] == rows(docs)[i] for i in list(got)[:20])


def test_near_dedup(steps):
    before, after = rows(steps["quality"]), rows(steps["near_dedup"])
    want = brute_components([(i, r.text) for i, r in before.items()], percent=80)
    assert set(after) == {i for i, component in want.items() if i == component}
    assert all(after[i] == before[i] for i in after)


def test_near_dedup_at_80_percent(spark, folder, steps):
    """20 five-word shingles and 16 of them in a longer text: 0.80; 17 of 22: below it."""
    words = [[f"{c}{i}" for i in range(30)] for c in "abc"]
    texts = [
        words[0][:24], words[0][:20],  # 16 of 20
        words[1][:23], [*words[1][:21], "x", "y", "z"],  # 17 of 22
        words[2][:29], [*words[2][:27], "x", "y"],  # 23 of 27
    ]
    docs = [(i, " ".join(t), "en", "test", len(" ".join(t))) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, steps["documents"].select(*COLUMNS).schema)
    want = brute_components([d[:2] for d in docs], percent=80)
    kept = rows(corpus_pipeline.near_dedup(spark, df, folder))
    assert set(kept) == {i for i, c in want.items() if i == c} == {0, 2, 3, 4}


def test_substring_dedup(steps):
    before, after = rows(steps["near_dedup"]), rows(steps["substring_dedup"])
    want = brute_repeats([(i, r.text) for i, r in before.items()])
    for i, (n_words, n_removed, kept) in want.items():
        if n_removed and n_removed == n_words:
            assert i not in after
        else:
            assert after[i].text == (kept if n_removed else before[i].text)
            assert after[i].n_chars == len(after[i].text)


def test_pii(steps):
    before, after = rows(steps["substring_dedup"]), rows(steps["pii"])
    assert set(before) == set(after)
    for i, r in before.items():
        assert after[i].text == redacted(r.text)


def test_packing(steps):
    from tests_llm_helpers import check_layout, check_pieces

    texts = {i: r.text for i, r in rows(steps["pii"]).items()}
    out = steps["packing"].withColumnRenamed("ids_crc32", "crc").collect()
    check_pieces(out, texts, 2048, public_tokenizers.path("byte_bpe_50k.json"))
    used = check_layout(out, 2048)
    assert used <= lower_bound(np.bincount([r.length for r in out], minlength=2049), 2048) + 1


def test_run(spark, folder, steps):
    assert corpus_pipeline.run(spark, folder).count() == steps["packing"].count()


def test_odd_rows_and_empty(spark, odd, empty, folder):
    wide = odd.selectExpr("doc_id", "text", "key AS lang", "node AS source", "cast(n AS long) AS n_chars", "rid")
    for docs in (wide, wide.filter("false")):
        for name, stage in corpus_pipeline.STAGES[1:]:
            docs = materialize(stage(spark, docs, folder), name)
        docs.collect()
    assert corpus_pipeline.near_dedup(spark, wide, folder).count() == 8
