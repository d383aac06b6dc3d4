"""Alignment against whole texts read by the libraries themselves."""

import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from foldlight.llm.encoders import byte_letters
from foldlight.llm.queries import token_alignment
from foldlight.llm.token_alignment import Aligner, align_tokens, alignment_totals, link_totals, pair_counts, token_ends
from foldlight.session import materialize

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tools():
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    letters = byte_letters()
    words = {i: w for w, i in json.load(open(A))["model"]["vocab"].items()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)

    def b_bytes(i):
        p = pieces.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()

    def read(text):
        """(A ids, B ids, groups, links) by decoded bytes of whole texts."""
        if not text:
            return [], [], "", []
        a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        data = (" " + text).encode()
        ab, bb = [bytes(letters[c] for c in words[i]) for i in a], [b_bytes(i) for i in b]
        if b"".join(ab) != data or b"".join(bb) != data:
            return [], [], "", []
        ends = []
        for parts in (ab, bb):
            at, out = 0, {}
            for n, part in enumerate(parts):
                at += len(part)
                out[at] = n
            ends.append(out)
        groups, links, i, j = [], [], 0, 0
        for cut in sorted(ends[0].keys() & ends[1].keys()):
            k, m = ends[0][cut] + 1, ends[1][cut] + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            links.append((a[k - 1], b[m - 1]))
            i, j = k, m
        return a, b, ";".join(groups), links

    return read


def brute(read, rows):
    """One tuple of key and COLUMNS for each row."""
    seen = [(key, *read(text)) for key, text in rows]
    count = Counter(link for r in seen for link in r[4])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [
        (
            key, len(a), len(b), len(groups.split(";")) if groups else 0, len(links),
            sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links),
            hashlib.sha256(groups.encode()).hexdigest() if groups else "",
        )
        for key, a, b, groups, links in seen
    ]


def test_query(spark, tools, folder, texts):
    rows = token_alignment(spark, folder).select("doc_id", *COLUMNS).collect()
    assert sorted(map(tuple, rows)) == sorted(brute(tools, texts.items()))


def test_odd_rows(odd, tools):
    rows = alignment_totals(odd, A, B).select("doc_id", *COLUMNS).collect()
    want = brute(tools, [(r.doc_id, r.text) for r in odd.collect()])
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


def test_pairs_in_slices(spark, documents, tools, texts):
    aligned = materialize(align_tokens(documents, A, B), "aligned")
    pairs = materialize(pair_counts(aligned), "best")
    rows = link_totals(aligned, pairs, slice_pairs=-(-pairs.count() // 3)).select("doc_id", *COLUMNS)
    assert sorted(map(tuple, rows.collect())) == sorted(brute(tools, texts.items()))


def test_segments_are_independent(tools):
    both = Aligner(A, B)
    rng = random.Random(7)
    pool = ["word", "It's", " ", "  ", "\n", "\t", "12", "'s", "é", "ß.", "日本、", "\U0001f600", "é", " ", "­", " ",
            "word,", "don't", "a.\n", "x)", "<|endoftext|>", "<s>", "</s>", "<0x41>", "▁", "﻿", "\x00", "\x1c", "!?", "…", "ﬁ", "Ａ", "क्षि"]
    cut = valid = 0
    for _ in range(3000):
        text = "".join(rng.choice(pool) + rng.choice(["", "", " "]) for _ in range(rng.randrange(1, 14)))
        a, b, groups, links = tools(text)
        entries = both.texts([text])[0]
        assert ";".join(e[3] for e in entries) == groups
        assert (sum(e[0] for e in entries), sum(e[1] for e in entries)) == (len(a), len(b))
        assert sum(len(e[4]) // 8 for e in entries) == len(links)
        cut += len(both.segments(text)) > 1
        valid += bool(groups)
    assert cut > 1000 and valid > 500


def test_whole_texts_without_cuts(tools, texts):
    both = Aligner(A, B)
    both.cut = None
    for text in list(texts.values())[:40]:
        assert ";".join(e[3] for e in both.texts([text])[0]) == tools(text)[2]


def test_long_texts(spark, tools):
    """Text without a space, a long segment, and many different segments with a small memory of them."""
    import foldlight.llm.token_alignment as module

    rng = random.Random(8)
    letters = "abcdefghijéöß日本"
    texts = ["".join(rng.choice(letters) for _ in range(200_000)), "日本語" * 100_000, "ab " * 100_000, "\n\n" * 50_000]
    both = Aligner(A, B)
    assert [";".join(e[3] for e in r) for r in both.texts(texts)] == [tools(t)[2] for t in texts]
    known, module.KNOWN_BYTES = module.KNOWN_BYTES, 50_000
    try:
        both = Aligner(A, B)
        for _ in range(6):
            text = " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(400))
            assert ";".join(e[3] for e in both.texts([text])[0]) == tools(text)[2]
            assert both.size < 1_000_000
    finally:
        module.KNOWN_BYTES = known


def test_token_ends():
    data = " é".encode()
    cut = [b" ", b"\xc3", b"\xa9"]
    assert token_ends([(0, 1), (1, 3), (1, 3)], cut, data) == [1, 2, 3]
    assert token_ends([(0, 1), (1, 1), (1, 3)], cut, data) == [1, 2, 3]
    assert token_ends([(0, 3)], [b" e"], data) is None
    assert token_ends([], [], b"") == []


def test_groups_as_text(spark):
    df = spark.createDataFrame([(1, "a"), (2, "")], "doc_id int, text string")
    rows = {r.doc_id: r for r in align_tokens(df, A, B, with_groups=True).collect()}
    assert rows[1].groups == "257|264" and rows[2].groups == "" and rows[2].links == b""


def test_empty(empty):
    assert alignment_totals(empty, A, B).count() == 0
