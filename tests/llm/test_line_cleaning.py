"""Line cleaning against a plain reading of the contract, and its verdicts against labels."""

import re
from collections import Counter

from foldlight.llm.line_cleaning import clean, clean_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(runs)
    covered = {i + k for i, r in enumerate(runs) if count[r] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def check(rows, texts):
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == base(texts[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)


def test_base_columns(documents, texts):
    rows = clean_lines(documents).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    for r in rows:
        assert r.clean_text == clean(texts[r.doc_id])[0]


def test_odd_rows(spark, odd):
    rows = clean_lines(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_words, by[1].base_failed, by[1].kept, by[1].clean_text) == (0, True, False, "")
    assert by[9].n_words == 30_000 and by[9].n_repeat_words == 30_000 and not by[9].kept
    check([r for r in rows if r.doc_id not in (None, 7)], {r.doc_id: r.text for r in odd.collect()})


def test_empty(empty):
    assert clean_lines(empty).count() == 0


def test_rules():
    good = "A plain line of text that ends well. And one more."
    text = "\n".join(
        [
            "Home | News | Sport | Weather | About.",
            good,
            "no sentence mark in this line at all",
            good,
            "All rights reserved.",
            "",
            "WOW!! BUY!! THIS!! NOW!! OK.",
        ]
    )
    cleaned, again, total, lost = clean(text)
    assert cleaned == good + "\n"
    assert again == 1 and 0 < lost < total
    assert clean(good) == (good, 0, 40, 0)
    notice = "All rights reserved."
    assert clean(f"{good}\n{notice}") == (good, 0, 40, 0)
    many = "\n".join([good, *(f"Page {i}. {notice}" for i in range(60))])
    text, _, total, lost = clean(many)
    assert text == good and total - lost == 40 and lost > 1000
    assert clean(notice) == ("", 0, 18, 18)


def test_repeated_word_at_any_place():
    good = "A plain line of text that ends well. And one more."
    stuffed = "buy these pills pills pills today pills pills online now."
    assert clean(f"{good}\n{stuffed}") == (good, 0, 40 + 48, 48)
    fewer = "buy these pills pills pills today pills my online now."
    assert clean(f"{good}\n{fewer}")[3] == 0


def test_verdicts_against_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = clean_lines(spark.read.parquet(f"{folder}/documents.parquet")).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert all(r.kept for r in good if not r.base_failed)
    assert sum(not r.kept for r in bad) > 0.9 * len(bad)
