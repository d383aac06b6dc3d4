"""Variants against plain deletion neighbourhoods, on given and on random vocabularies."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from foldlight.llm import spelling
from foldlight.llm.queries import spelling as query
from foldlight.llm.spelling import altered_runs, grams, near_pairs, padded, spelling_forms, two_lists, vocabulary

UPPER = re.compile("[A-Z]")


def plain_words(rows, one_in=97, min_length=5, min_count=3):
    count = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = UPPER.sub(lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= min_length and n >= min_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_near(words):
    """All pairs through words with one letter replaced by a mark or deleted, checked again."""
    by = defaultdict(set)
    if max(map(len, words), default=0) > 1000:
        return {(a, b) for a in words for b in words if a != b and one_edit(a, b)}
    for w in words:
        for i in range(len(w)):
            by[w[:i] + "\0" + w[i + 1 :]].add(w)
            by[w[:i] + w[i + 1 :]].add(w)
        by[w].add(w)
    return {(a, b) for found in by.values() for a in found for b in found if a != b and one_edit(a, b)}


def plain_forms(words, factor=2):
    near = defaultdict(list)
    for a, b in plain_near(words):
        near[a].append(b)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def collected(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def test_query(spark, folder, texts):
    assert collected(query(spark, folder)) == plain_forms(plain_words(texts.items()))


def test_one_edit_leaves_one_of_the_two_grams():
    """The bound itself: for random dictionaries and every edit, one of any two grams apart stays in its place."""
    rng = random.Random(3)
    letters = "abcé"
    for _ in range(300):
        words = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 12))) for _ in range(40)]
        count = Counter()
        for w in words:
            full = padded(w)
            count.update(full[p : p + s] for s in range(spelling.QMIN, spelling.QMAX) for p in range(len(full) - s + 1))
        threshold = rng.choice([0, 1, 3, 8, 40])
        grows = frozenset(g for g, n in count.items() if n > threshold)
        a = rng.choice(words)
        i = rng.randrange(len(a) + 1)
        edits = [a[:i] + rng.choice(letters) + a[i:]] + ([a[:i] + rng.choice(letters) + a[i + 1 :]] if i < len(a) else [])
        for b in edits:
            for g in {padded(b)[p:e] for p in range(len(padded(b))) for e in range(p + 2, p + spelling.QMAX)}:
                count[g] += 0  # both words are part of the vocabulary that the dictionary was made from
            held = {(padded(b)[p:e], p) for p, e in grams(padded(b), grows)}
            found = grams(padded(a), grows)
            firsts, ends = [p for p, _ in found], [e for _, e in found]
            left, right = two_lists(firsts, ends, [rng.randrange(9) for _ in found])
            full, shift = padded(a), len(b) - len(a)
            kept_left = (full[firsts[left] : ends[left]], firsts[left]) in held
            kept_right = (full[firsts[right] : ends[right]], firsts[right] + shift) in held
            assert kept_left or kept_right


@pytest.mark.parametrize("letters,longest,least", [("ab", 9, 2), ("abcde", 7, 2), ("aé÷z", 14, 5), ("a", 400, 2)])
def test_random_words(spark, letters, longest, least):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(least, longest + 1))): rng.randrange(1, 60) for _ in range(500)}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert collected(spelling_forms(df)) == plain_forms(words)


def test_small_dictionary(spark, texts, monkeypatch):
    """Short grams only, or none that grow: the same pairs from longer lists."""
    words = plain_words(texts.items())
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = {p for p in plain_near(words) if p[0] < p[1]}
    for least in (1, 500, 10**9):
        monkeypatch.setattr(spelling, "LEAST", least)
        got = [tuple(sorted((r.a, r.b))) for r in near_pairs(df).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_long_words_and_chains(spark):
    long = "abcdefghij" * 3000
    words = {long: 100, long[:-1]: 10, long + "x": 3, "aaaaa": 64, "aaaab": 32, "aaabb": 16, "aabbb": 8, "abbbb": 4, "bbbbb": 2}
    words |= {f"third{c}": n for c, n in zip("xyzw", (7, 7, 3, 1), strict=True)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: r for r in spelling_forms(df).collect()}
    assert (got[long[:-1]].root, got[long + "x"].form, got["bbbbb"].root) == (long, long, "aaaaa")
    assert (got["thirdz"].form, got["thirdx"].form, got["thirdz"].n_near) == ("thirdx", None, 3)


def test_words_around_the_long_length(spark):
    rng = random.Random(4)
    words = {}
    for _ in range(12):
        base = "".join(rng.choice("abc") for _ in range(rng.randrange(spelling.LONG - 3, spelling.LONG + 4)))
        for _ in range(15):
            words[base] = rng.randrange(1, 50)
            i = rng.randrange(len(base) + 1)
            base = rng.choice([base[:i] + base[i + 1 :], base[:i] + "b" + base[i:], base[:i] + "c" + base[i + 1 :]])
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = plain_forms(words)
    assert collected(spelling_forms(df)) == want and sum(r[4] for r in want) > 100


def test_odd_rows(spark, odd):
    words = vocabulary(altered_runs(odd), min_length=2, min_count=1)
    want = plain_words([(r.doc_id, r.text) for r in odd.collect()], min_length=2, min_count=1)
    assert {r.word: r.n for r in words.collect()} == want
    assert collected(spelling_forms(words)) == plain_forms({w: n for w, n in want.items()})


def test_letters_and_deletions(spark):
    """Upper case beyond A-Z stays; every run may lose a letter; a run of one letter vanishes."""
    texts = ["ÀÉ Straße ×÷ ÿÿ Zoë İstanbul naïve-Ärger x", None, "", "A B C"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0])] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for one_in in (1, 2, 97):
        got = {r.word: r.n for r in vocabulary(altered_runs(df, one_in=one_in), 1, 1).collect()}
        assert got == plain_words(rows, one_in, 1, 1)


def test_empty(empty):
    assert spelling_forms(vocabulary(altered_runs(empty))).count() == 0
