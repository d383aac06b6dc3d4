r"""Spelling variants: words one edit apart, found by an index of variable-length grams.

Words are counted in one pass with a partial sum before the shuffle. A word is set between pads and
decomposed by a dictionary of frequent grams: at each place the gram grows from ``QMIN`` letters while the gram so far is
in the dictionary (more than ``threshold`` places in all words hold it), up to ``QMAX``; a gram inside
an earlier one is left out. The threshold grows with the number of gram places, so the dictionary has
at most ``DICTIONARY`` grams whatever the words are, and its size is checked before it is sent.

An edit at letter i can affect a gram of letters p to e only if it lies from e - QMAX + 1 to e: outside of this
range neither the gram nor what grows over it changes. That bound per gram says which lists must be merged:
a word one edit away holds every gram that the edit does not affect, at the same place where the edit
comes later and shifted by the change of length where it comes earlier. Two grams whose ranges do not meet are enough,
since every edit misses one of them; each word takes the two whose lists are shortest (a word of two or more letters
always has such two). A word of more than ``LONG`` letters has only two grams, its first and its last LONG / 2 letters, so
index rows stay in proportion to the words. The two lists, of words as long and of words one letter longer, are joined with the index of all
grams, and each candidate is verified by its edit distance. A list is an equality key of gram, place and length, so
adaptive execution splits the long ones.

Words whose ``form`` is null are their own root; forms have at least ``factor`` times the count, so they make
a forest, which pointer jumping climbs in few rounds.

Null text has no words; null keys count as empty in the deletion rule of ``altered_runs``. Rows equal in key
and text count each. Ties go to the smallest word in code-point order. An empty table gives an empty
result. Columns not named are not read.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlight.llm.graph import jump
from foldlight.llm.words import tidy
from foldlight.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RUN = r"([A-Za-zÀ-ÿ]+)"
QMIN, QMAX = 2, 5
PAD = QMAX - 1
HEAD, TAIL = "\x02", "\x03"
DICTIONARY = 500_000  # most grams of the dictionary
LEAST = 30  # places of a gram that need no longer grams
LONG = 64  # letters above which a word's two grams are its first and its last LONG / 2 letters
GRAMS_AT_ONCE = 200_000  # different grams counted at once in a task

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_latin(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    ascii_only = F.char_length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def altered_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", one_in: int = 97) -> DataFrame:
    """(word) for every run of Latin letters; where ``one_in`` divides crc32 of ``<key>:<run>``, one letter less."""
    runs = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"),
        F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(RUN), F.lit(1))).alias("run"),
    )
    runs = runs.select("key", lower_latin(F.col("run")).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return runs.select(F.when(F.col("h") % one_in == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(runs: DataFrame, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    counts = runs.filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= min_count)


def padded(word: str) -> str:
    return HEAD * PAD + word + TAIL * PAD


def gram_counts(words: DataFrame) -> DataFrame:
    """(gram, n): places of all words that hold each gram of QMIN to QMAX - 1 letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["gram", "n"]
            )

        for batch in batches:
            for word in batch.column("word").to_pylist():
                full = padded(word) if len(word) <= LONG else ""
                for size in range(QMIN, QMAX):
                    found.update([full[p : p + size] for p in range(len(full) - size + 1)])
                if len(found) > GRAMS_AT_ONCE:
                    yield rows()
                    found.clear()
        yield rows()

    counted = words.select("word").mapInArrow(tidy(run), "gram string, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def dictionary(words: DataFrame) -> frozenset[str]:
    """The grams that grow: those at more places than a threshold that bounds their number."""
    counts = materialize(gram_counts(words), "grams")
    places = counts.agg(F.sum("n")).first()[0] or 0
    threshold = max(LEAST, places // DICTIONARY)
    frequent = counts.filter(F.col("n") > threshold).select("gram")
    size = frequent.count()
    if size > DICTIONARY:  # more than places / threshold grams cannot be
        raise RuntimeError(f"{size} frequent grams")
    return frozenset(frequent.toArrow().column("gram").to_pylist())


def grams(full: str, grows: frozenset[str]) -> list[tuple[int, int]]:
    """(first letter, letter after the last) of each gram of a padded word, both increasing."""
    out, covered, n = [], 0, len(full)
    for p in range(n - QMIN + 1):
        e = p + QMIN
        while e < n and e - p < QMAX and full[p:e] in grows:
            e += 1
        if e > covered:
            out.append((p, e))
            covered = e
    return out


def list_key(gram: str, place: int, length: int) -> int:
    """The list of words of ``length`` letters that hold ``gram`` at ``place``, as a 64-bit number."""
    return xxhash.xxh3_64_intdigest(f"{gram}{place}:{length}") - (1 << 63)


def end_keys(word: str, length: int) -> tuple[int, int]:
    """The lists of words of ``length`` letters, more than LONG, with the first and the last letters of ``word``."""
    half = LONG // 2
    return list_key(word[:half], -1, length), list_key(word[-half:], -2, length)


def gram_index(words: DataFrame, grows: frozenset[str]) -> DataFrame:
    """(list, word, n, first, last) for each gram of each word."""
    sent = words.sparkSession.sparkContext.broadcast(grows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                places, keys, firsts, lasts = [], [], [], []
                for i, word in enumerate(part.column("word").to_pylist()):
                    if len(word) > LONG:
                        found, listed = [(0, 0), (1, 1)], end_keys(word, len(word))
                    else:
                        full = padded(word)
                        found = grams(full, known)
                        listed = [list_key(full[p:e], p, len(word)) for p, e in found]
                    places += [i] * len(found)
                    keys += listed
                    firsts += [p for p, _ in found]
                    lasts += [e for _, e in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), *(part.column(c).take(pa.array(places)) for c in ("word", "n")),
                     pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())],
                    ["list", "word", "n", "first", "last"],
                )

    schema = "list long, word string, n long, first int, last int"
    return words.select("word", "n").mapInArrow(tidy(run), schema)


def two_lists(firsts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[int, int]:
    """The two grams with the shortest lists together that no edit affects both; grams are in order."""
    best, left, right = None, 0, 0
    shortest, j = 0, 0
    for k in range(len(firsts)):
        # grams that end before the range of gram k begins; both borders increase
        while j < k and ends[j] - 1 < ends[k] - QMAX:
            if j == 0 or sizes[j] < sizes[shortest]:
                shortest = j
            j += 1
        if j and (best is None or sizes[shortest] + sizes[k] < best):
            best, left, right = sizes[shortest] + sizes[k], shortest, k
    if best is None:
        raise ValueError("a word of one letter has no two grams apart")
    return left, right


def probes(index: DataFrame) -> DataFrame:
    """(list, word, n, same) of the lists that each word merges; ``same``: words of its own length."""
    sizes = index.groupBy("list").agg(F.count(F.lit(1)).alias("size"))
    by_word = (
        index.join(sizes, "list")
        .groupBy("word", "n")
        .agg(F.sort_array(F.collect_list(F.struct("first", "last", "size"))).alias("grams"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = (batch.column(c).to_pylist() for c in ("word", "n"))
            lists = batch.column("grams")
            edges, fields = lists.offsets.to_numpy(), lists.values.flatten()
            first, last, size = (x.to_numpy() for x in fields)
            out: list[tuple[int, str, int, bool]] = []
            for i, word in enumerate(words):
                n = len(word)
                if n > LONG:
                    own, longer = end_keys(word, n), end_keys(word, n + 1)
                else:
                    low, high = edges[i], edges[i + 1]
                    firsts, ends = first[low:high].tolist(), last[low:high].tolist()
                    full = padded(word)
                    two = [(full[firsts[k] : ends[k]], firsts[k]) for k in two_lists(firsts, ends, size[low:high].tolist())]
                    own = [list_key(gram, p, n) for gram, p in two]
                    longer = [list_key(gram, p + shift, n + 1) for (gram, p), shift in zip(two, (0, 1), strict=True)]
                    if n + 1 > LONG:
                        longer = end_keys(word, n + 1)
                out += [(k, word, counts[i], True) for k in own] + [(k, word, counts[i], False) for k in longer]
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["list", "word", "n", "same"]
            )

    return by_word.mapInArrow(tidy(run), "list long, word string, n long, same boolean")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) once for each two words one edit apart; words are unique and have two letters or more."""
    index = materialize(gram_index(words, dictionary(words)), "gram_index")
    asked = materialize(probes(index).select("list", F.col("word").alias("a"), F.col("n").alias("n_a"), "same"), "probes")
    listed = index.select("list", F.col("word").alias("b"), F.col("n").alias("n_b"))
    met = asked.join(listed, "list").filter(~F.col("same") | (F.col("a") < F.col("b")))
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def spelling_forms(words: DataFrame, factor: int = 2) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of each row of (word, n)."""
    words = materialize(words, "words")
    pairs = materialize(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    )
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    )
    rows = words.join(best, "word", "left")
    fits = -F.col("best.minus") >= factor * F.col("n")
    rows = rows.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"),
        F.when(fits, -F.col("best.minus")).alias("form_n"),
    )
    rows = materialize(rows, "forms")
    roots = jump(rows.filter("form IS NOT NULL").select(F.col("word").alias("node"), F.col("form").alias("root")))
    rows = rows.join(roots.withColumnRenamed("node", "word"), "word", "left")
    return rows.select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))
