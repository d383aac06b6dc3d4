"""Counts against the tokenizer libraries, and splits that change nothing."""

import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from foldlight.llm.encoders import encoder
from foldlight.llm.queries import token_counts
from foldlight.llm.token_counts import count_tokens, safe_parts

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]


def plain(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(pieces.encode(t))
    tokenizer = Tokenizer.from_file(path)
    return lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", FILES)
def test_given_documents(documents, texts, name):
    count = plain(name)
    rows = count_tokens(documents, public_tokenizers.path(name), split_chars=500, batch_bytes=3000).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == {
        i: (len(t.encode()), count(t)) for i, t in texts.items()
    }


def test_query(spark, folder, texts):
    count = plain(FILES[0])
    for r in token_counts(spark, folder).collect():
        assert r.n_tokens == count(texts[r.doc_id]) and r.over_limit == (r.n_tokens > 1024)


def test_every_character_has_the_same_ids():
    path = public_tokenizers.path(FILES[0])
    tokenizer, ours = Tokenizer.from_file(path), encoder(path)
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for low in range(0, len(codes), 100_000):
        chars = map(chr, codes[low : low + 100_000])
        lines = ["".join(f"a{c}b {c} 1{c}{c}2 {c}'s" for c in part) for part in zip(*[chars] * 50)]
        want = tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        assert all(a.tolist() == b.ids for a, b in zip(ours(lines), want, strict=True))


def test_special_strings_in_texts():
    path = public_tokenizers.path(FILES[0])
    text = "a<|endoftext|> b <|endoftext|><|endoftext|>c <|endoftext"
    assert encoder(path)([text])[0].tolist() == Tokenizer.from_file(path).encode(text).ids


def test_safe_parts_keep_the_count():
    count = plain(FILES[0])
    rng = random.Random(6)
    pools = ["word ", "it's ", "  ", "\n", "12", "a1b2", "'s't", "…—", "日本、中文。", "é", "<|endoftext|>", "!? ", "\t\r\n x"]
    for _ in range(400):
        text = "".join(rng.choice(pools) for _ in range(60))
        parts = safe_parts(text, rng.randrange(1, 30))
        assert "".join(parts) == text
        assert sum(map(count, parts)) == count(text)


def test_odd_rows(odd):
    count = plain(FILES[0])
    rows = count_tokens(odd, public_tokenizers.path(FILES[0]), split_chars=1000).collect()
    want = sorted(str((r.doc_id, len((r.text or "").encode()), count(r.text or ""))) for r in odd.collect())
    assert sorted(str(tuple(r)) for r in rows) == want


def test_empty(empty):
    assert count_tokens(empty, public_tokenizers.path(FILES[0])).count() == 0
