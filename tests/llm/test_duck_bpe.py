"""Ids against tiktoken, exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from foldlight.llm import duck_bpe
from foldlight.llm.duck_bpe import Database, decode, encode
from foldlight.llm.queries import duckdb_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def database():
    return Database(PATH, PATTERN)


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_query(spark, folder, texts, reference):
    rows = duckdb_bpe(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(packed(ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def noise(rng, n):
    pools = ["ab", "aab ", "=- ", "éàü ñ", "日本語中文 ", "0123 ", "\n\t ", "😀👍🏽", "'s't 're", "abcdefghijklmnop "]
    return "".join(rng.choice(rng.choice(pools)) for _ in range(n))


def test_noise(database, reference):
    rng = random.Random(0)
    texts = [noise(rng, rng.randrange(0, 200)) for _ in range(600)]
    texts += ["a" * 3001, "ab" * 1500, "=" * 997, " " * 500, "\n" * 64 + "x", "<|endoftext|>", "é" * 700]
    texts.append("".join(rng.choice("etaoinshr") for _ in range(3000)))  # one word of 3,000 letters
    ids = database.encode(texts)
    assert ids == [packed(reference.encode_ordinary(t)) for t in texts]
    assert database.decode(ids) == [t.encode() for t in texts]


def test_every_vocabulary_entry(database, reference):
    words = [w.decode() for w in reference.token_byte_values() if _is_text(w)]
    assert database._contract_all([w.encode() for w in words]) == [packed(reference._core_bpe.encode_single_piece(w.encode())) for w in words]


def _is_text(data):
    try:
        return bool(data.decode())
    except UnicodeDecodeError:
        return False


def test_bounds_do_not_change_results(monkeypatch, reference):
    small = Database(PATH, PATTERN)
    monkeypatch.setattr(duck_bpe, "KNOWN_BYTES", 3000)
    monkeypatch.setattr(duck_bpe, "KEPT_WORD", 10)
    monkeypatch.setattr(duck_bpe, "STRETCH", 12)
    monkeypatch.setattr(duck_bpe, "PART", 50)
    monkeypatch.setattr(duck_bpe, "BYTES_AT_ONCE", 60)
    monkeypatch.setattr(duck_bpe, "TOKENS_AT_ONCE", 9)
    rng = random.Random(1)
    for _ in range(5):
        texts = [noise(rng, 120) for _ in range(6)]
        ids = small.encode(texts)
        assert ids == [packed(reference.encode_ordinary(t)) for t in texts]
        assert small.decode(ids) == [t.encode() for t in texts]


def test_stretches_meet_as_the_whole_word(database, reference):
    rng = random.Random(2)
    words = ["x" * n for n in (97, 143, 1000, 4999)] + ["ab" * 300, "abc" * 333, "=" * 777, " " * 5000, "é" * 400, "日本" * 150]
    words += ["".join(rng.choice(pool) for _ in range(rng.randrange(2, 700))) for pool in ("ab", "aeiourst", "ACGT", "0123456789") for _ in range(40)]
    words += [rng.choice(words)[:80] + "x" * rng.randrange(100, 300) + rng.choice(words)[:80] for _ in range(40)]
    data = [w.encode() for w in words]
    want = [packed(reference._core_bpe.encode_single_piece(d)) for d in data]
    for stretch in (2, 14, 96):
        assert database._stretched(data, stretch) == want


def test_many_long_words(spark, reference):
    """Texts of 4 kB made of 200-letter words, all different."""
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(200)) for _ in range(20))) for i in range(1000)]
    got = {r.doc_id: bytes(r.ids) for r in encode(spark.createDataFrame(rows, "doc_id int, text string"), PATH, PATTERN).collect()}
    assert all(got[i] == packed(reference.encode_ordinary(t)) for i, t in rows)


def test_huge_words(database, reference):
    rng = random.Random(4)
    words = ["x" * (6 << 20), "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=400_000)) * 15, "é" * ((1 << 23) + 5)]
    for word in words:
        assert database.encode([word]) == [packed(reference.encode_ordinary(word))]
        assert word not in database.new


def test_odd_rows(odd, reference):
    rows = decode(encode(odd, PATH, PATTERN), PATH, PATTERN).collect()
    want = sorted(str((r.doc_id, (r.text or "").encode())) for r in odd.collect())
    assert sorted(str((r.doc_id, bytes(r.decoded))) for r in rows) == want


def test_empty(empty):
    assert decode(encode(empty, PATH, PATTERN), PATH, PATTERN).count() == 0
