"""Line-first cleaning: rules judge lines, documents are judged by what the lines lost.

A line (split at ``\\n``) is removed when a rule fails it:

* punctuation: no sentence mark before white space or the end of the line, or
  runs of marks on 30 % of its words;
* navigation: separators make up a quarter of its tokens, three at least;
* boilerplate: a line equal to an earlier one of the text, one word making up
  half of ten or more, or a notice: a licence, cookie, sign-in or rights phrase in
  a line of at most 25 words.

Lines without a word are never judged. A text may have a notice at its head and one at its foot: up to
``FREE_NOTICES`` of them count neither for nor against a text that has other lines, and where there are more, all
count as lost. A document whose removed lines hold more than ``max_lost`` of its word characters is rejected, and so is one that fails the
base limits (fewer than 10 words, or over 20 % of words in repeated
5-word windows). Only the document itself is looked at, so there is no shuffle.

Null text counts as empty (0 everywhere, base failed). Repeated rows are judged
row by row; an empty table gives an empty result; other columns are not read, so
their names cannot clash.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlight.llm.words import Words, chunks, kept, tidy, windows, words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACES = " \t\n\x0b\x0c\r"
SEPARATORS = {"|", "»", "›", ">", "•", "·", "→", "/", "::"}
PHRASES = (
    r"all rights reserved|licen[cs]ed under|released under the|terms of (use|service)|privacy policy"
    r"|cookies?\b.{0,40}\b(use|accept|policy|settings)|(use|accept|policy|settings)\b.{0,40}\bcookies?"
    r"|copyright|©|sign in\b|log in\b|subscribe|newsletter|skip to (main )?content|share (this|on)\b"
)
WINDOW = 5
FREE_NOTICES = 2


def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    return (
        re.compile(r"[.!?…:;。！？][\"'”’»)\]]*(?=\s|$)"),
        re.compile(r"[!?.,;:#*$%&|<>=~^_+-]{2,}(?=\s|$)"),
        re.compile(PHRASES, re.IGNORECASE),
    )


def failed_rule(line: str, seen: set[str]) -> str | None:
    """The first rule that fails the line, or None; ``seen`` holds the text's earlier lines."""
    sentence, run, phrase = kept("line patterns", _patterns)
    tokens = line.split()
    n = len(tokens)
    if sentence.search(line) is None:
        return "punctuation"
    if n >= 4 and 10 * len(run.findall(line)) >= 3 * n:
        return "punctuation"
    bars = sum(t in SEPARATORS for t in tokens)
    if bars >= 3 and 4 * bars >= n:
        return "navigation"
    if line in seen:
        return "boilerplate"
    if n <= 25 and phrase.search(line) is not None:
        return "notice"
    if n >= 10 and 2 * max(Counter(tokens).values()) >= n:
        return "boilerplate"
    return None


def clean(text: str) -> tuple[str, int, int, int]:
    """(text without failed lines, repeated lines, word characters judged, and of these removed)."""
    seen: set[str] = set()
    left = []
    again = total = lost = notices = noticed = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            size = sum(map(len, line.split()))
            rule = failed_rule(line, seen)
            if rule is None:
                left.append(line)
            if rule == "notice":
                notices += 1
                noticed += size
            else:
                total += size
                lost += size if rule else 0
            again += line in seen
            seen.add(line)
        else:
            left.append(line)
    if notices > FREE_NOTICES or not total:
        total += noticed
        lost += noticed
    return ("\n".join(left) if lost or notices else text), again, total, lost


def repeated_words(w: Words) -> np.ndarray:
    """Per text, the words covered by 5-word windows that occur twice or more in it."""
    runs = windows(w.hashes(), WINDOW)
    out = np.zeros(len(w.counts), np.int64)
    for t, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if b - a <= WINDOW:
            continue
        own = runs[a : b - WINDOW + 1]
        order = np.argsort(own)
        same = own[order][1:] == own[order][:-1]
        if not same.any():
            continue
        edge = np.zeros(b - a + 1, np.int64)
        starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
        edge[starts] += 1
        edge[starts + WINDOW] -= 1
        out[t] = (np.cumsum(edge) > 0).sum()
    return out


def _symbols() -> np.ndarray:
    return np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def clean_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    max_lost: float = 0.5,
    with_text: bool = True,
) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost, kept).

    ``with_text`` adds ``clean_text``, the text without the failed lines.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                texts = pc.fill_null(part.column("text"), "")
                w = words(texts)
                n = w.counts
                inside = np.zeros(len(w.data) + 1, np.int32)
                np.add.at(inside, w.starts, 1)
                np.add.at(inside, w.ends, -1)
                letters = (np.cumsum(inside)[:-1] > 0) & ((w.data & 0xC0) != 0x80)
                repeats = repeated_words(w)
                cleaned = [clean(t) for t in texts.to_pylist()]
                total = np.array([c[2] for c in cleaned], np.int64)
                lost = np.array([c[3] for c in cleaned], np.int64) / np.maximum(total, 1)
                failed = (n < 10) | (100 * repeats > 20 * n)
                columns = [
                    part.column("key"),
                    pa.array(n, pa.int64()),
                    pa.array(_per_text(letters, w.offsets)),
                    pa.array(_per_text(kept("symbols", _symbols)[w.data], w.offsets)),
                    pa.array([c[1] for c in cleaned], pa.int64()),
                    pa.array(repeats),
                    pa.array(failed),
                    pa.array(lost),
                    pa.array(~failed & (lost <= max_lost)),
                ]
                if with_text:
                    columns.append(pa.array([c[0] for c in cleaned], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=NAMES[: len(columns)])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = (
        f"key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
        " n_repeat_words long, base_failed boolean, lost double, kept boolean"
    )
    if with_text:
        schema += ", clean_text string"
    return rows.mapInArrow(tidy(run), schema).withColumnRenamed("key", key)


NAMES = [
    "key",
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "base_failed",
    "lost",
    "kept",
    "clean_text",
]
