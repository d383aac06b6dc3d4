"""Byte-level BPE by recursive queries of an in-process DuckDB in each task.

Encoding: the split pattern cuts texts into words. Words not met before in this
worker become rows (word and position, token), one per byte. Each step of a
recursive query joins neighbouring tokens with the merge table, finds the lowest
rank in each word and contracts its leftmost pair, together with the pairs of the
same rank further right that do not overlap; that is what contracting one pair
at a time arrives at, because a contraction never opens a pair of lower rank.
Words without a pair are done. Texts are then looked up word by word.

Decoding: token rows join the vocabulary and an ordered aggregation puts the
bytes of each text together, in blocks of bounded size.

A word above ``STRETCH`` bytes is contracted in stretches that overlap by half, as words of their own, and
the stretches are joined where a token of one ends and a token of the next begins. Tokens are those of the whole word
exactly if each two neighbours, contracted by themselves, stay as they are: the first contraction across a token's end would
also happen in the two tokens alone. Two tokens that are neighbours in a stretch have stayed so; other pairs are contracted to
see. Stretches that nowhere meet so are doubled.

The merge table holds every way to cut a vocabulary entry into two entries. The
memory of the database is bounded, and so is what it is given at once (``BYTES_AT_ONCE``); nothing is written to local disk, and the
known words of a worker are kept in two generations of ``KNOWN_BYTES``. A text
above ``PART`` characters is cut where no word can span.

Null text is encoded as empty. Rows are encoded one by one, so repeated rows and
ties need no rule; an empty table gives an empty result; columns not named are
not read.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlight.llm.token_counts import safe_parts
from foldlight.llm.words import chunks, kept, tidy

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KNOWN_BYTES = 100 << 20  # of words, their ids and their places in a table
KEPT_WORD = 1 << 10  # longer words are encoded again when met again
PART = 1 << 20
BYTES_AT_ONCE = 1 << 18
STRETCH = 96
TOKENS_AT_ONCE = 1 << 18

PLACES = 1 << 32  # a row's id is its word's number times this, plus its place

ENCODE = f"""
WITH RECURSIVE step(id, token, after, done) AS (
  SELECT id, token, CASE WHEN lead(id) OVER o // {PLACES} = id // {PLACES} THEN lead(token) OVER o END, false
  FROM start WINDOW o AS (ORDER BY id)
  UNION ALL
  (WITH
   pairs AS MATERIALIZED (
     SELECT s.id, s.token, m.made
     FROM step s LEFT JOIN merges m ON s.token = m.first AND s.after = m.second
     WHERE NOT s.done),
   lowest AS MATERIALIZED (SELECT id // {PLACES} AS word, min(made) AS best FROM pairs GROUP BY 1),
   numbered AS (
     SELECT id, token, best, coalesce(made = best, false) AS hit, row_number() OVER (ORDER BY id) AS n
     FROM pairs JOIN lowest ON id // {PLACES} = word),
   runs AS (  -- consecutive hits right before each row; the last row of a word is never a hit
     SELECT *, n - 1 - coalesce(max(CASE WHEN NOT hit THEN n END) OVER (
              ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
     FROM numbered),
   contracted AS (  -- of overlapping hits every second one, from the left, takes the token after it
     SELECT id, CASE WHEN hit THEN best ELSE token END AS token, best IS NULL AS done
     FROM runs WHERE before % 2 = 0)
   SELECT id, token, CASE WHEN lead(id) OVER o // {PLACES} = id // {PLACES} THEN lead(token) OVER o END, done
   FROM contracted WINDOW o AS (ORDER BY id)))
SELECT id // {PLACES} AS word, list(token ORDER BY id) AS ids FROM step WHERE done GROUP BY 1 ORDER BY 1
"""

DECODE = """
SELECT block, string_agg(letters, '' ORDER BY place) AS letters
FROM tokens JOIN vocabulary USING (token) GROUP BY block ORDER BY block
"""


class Database:
    """The vocabulary in DuckDB and the words encoded so far; one per worker process."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pattern = regex.compile(pattern)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.con = duckdb.connect(
            ":memory:",
            config={"threads": 1, "memory_limit": "400MB", "temp_directory": "", "preserve_insertion_order": False},
        )
        cuts = [
            (ranks[w[:i]], ranks[w[i:]], made)
            for w, made in ranks.items()
            for i in range(1, len(w))
            if w[:i] in ranks and w[i:] in ranks
        ]
        first, second, made = (pa.array(c, pa.int32()) for c in zip(*cuts, strict=True))
        self._table("merges", {"first": first, "second": second, "made": made})
        token = pa.array(ranks.values(), pa.int32())
        letters = pa.array([w.decode("latin-1") for w in ranks])  # one letter per byte
        self._table("vocabulary", {"token": token, "letters": letters})
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0
        self.letters = {i: w for w, i in ranks.items()}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        lengths[list(ranks.values())] = [len(w) for w in ranks]
        self.lengths = lengths

    def _table(self, name: str, columns: dict) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _contract(self, data: list[bytes]) -> list[bytes]:
        """The ids of each word, none of them empty."""
        sizes = np.array([len(d) for d in data])
        token = self.byte[np.frombuffer(b"".join(data), np.uint8)]
        place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids = np.repeat(np.arange(len(data)), sizes) * PLACES + place
        self.con.register("start", pa.table({"id": ids, "token": token}))
        ids = self.con.sql(ENCODE).to_arrow_table().column("ids").combine_chunks()
        self.con.unregister("start")
        ends = ids.offsets.to_numpy()
        flat = ids.values.to_numpy().astype("<u4").tobytes()
        return [flat[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _contract_all(self, data: list[bytes]) -> list[bytes]:
        """The ids of each word in calls of BYTES_AT_ONCE bytes, or one longer word."""
        out: list[bytes] = []
        begin = size = 0
        for i, word in enumerate(data):
            if size and size + len(word) > BYTES_AT_ONCE:
                out += self._contract(data[begin:i])
                begin, size = i, 0
            size += len(word)
        return out + self._contract(data[begin:]) if begin < len(data) else out

    def _stretched(self, words: list[bytes], stretch: int = STRETCH) -> list[bytes]:
        """The ids of words longer than a stretch."""
        step = stretch // 2
        parts = [[w[i : i + stretch] for i in range(0, max(len(w) - step, 1), step)] for w in words]
        different = sorted({p for cut in parts for p in cut})
        found = dict(zip(different, self._contract_all(different), strict=True))
        out, again = [], []
        for n, cut in enumerate(parts):
            joined = self._joined([found[p] for p in cut], step)
            out.append(joined or b"")
            if joined is None:
                again.append(n)
        if again:  # a stretch as long as the word always ends it
            for n, ids in zip(again, self._stretched([words[n] for n in again], 2 * stretch), strict=True):
                out[n] = ids
        return out

    def _joined(self, parts: list[bytes], step: int) -> bytes | None:
        """Ids of a word from those of its stretches, which begin ``step`` bytes apart; None where two do not meet."""
        tokens = np.frombuffer(parts[0], "<u4")
        ends = np.cumsum(self.lengths[tokens])
        out, begin = [], 0  # kept tokens, and the first token of the present stretch that is not among them
        for i, part in enumerate(parts[1:], 1):
            after = np.frombuffer(part, "<u4")
            starts = i * step + np.cumsum(self.lengths[after]) - self.lengths[after]
            places, left, right = np.intersect1d(ends, starts, assume_unique=True, return_indices=True)
            keep = left >= begin
            left, right = left[keep], right[keep]
            meets = None
            for k, m in zip(left.tolist(), right.tolist(), strict=True):
                # the token after the meeting place is the same in both, so its neighbours are too
                if k + 1 < len(tokens) and tokens[k + 1] == after[m]:
                    meets = k, m
                    break
            if meets is None and len(left):
                k, m = int(left[0]), int(right[0])
                pair = self.letters[tokens[k]] + self.letters[after[m]]
                if self._contract([pair])[0] == tokens[[k]].tobytes() + after[[m]].tobytes():
                    meets = k, m
            if meets is None:
                return None
            out.append(tokens[begin : meets[0] + 1])
            begin, tokens = meets[1], after
            ends = starts + self.lengths[after]
        return np.concatenate([*out, tokens[begin:]]).astype("<u4").tobytes()

    def learn(self, words: set[str]) -> list[str]:
        """Make every one of ``words`` known; those to be forgotten after use."""
        if self.size > KNOWN_BYTES:
            self.old, self.new, self.size = self.new, {}, 0
        for w in words & self.old.keys():
            if w not in self.new:
                self.new[w] = self.old[w]
                self.size += 3 * len(w) + 150
        missing = sorted(words - self.new.keys())
        data = [w.encode() for w in missing]
        short = [i for i, d in enumerate(data) if len(d) <= STRETCH]
        long = [i for i, d in enumerate(data) if len(d) > STRETCH]
        for some, encoded in (
            (short, self._contract_all([data[i] for i in short])),
            (long, self._stretched([data[i] for i in long]) if long else []),
        ):
            for i, ids in zip(some, encoded, strict=True):
                self.new[missing[i]] = ids
                self.size += len(data[i]) + len(ids) + 150
        return [missing[i] for i in long if len(data[i]) > KEPT_WORD]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [[self.pattern.findall(p) for p in safe_parts(t, PART)] for t in texts]
        passing = self.learn({w for parts in cut for part in parts for w in part})
        get = self.new.__getitem__
        out = [b"".join(b"".join(map(get, part)) for part in parts) for parts in cut]
        for w in passing:
            self.size -= len(w.encode()) + len(self.new.pop(w)) + 150
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each row of little-endian unsigned 32-bit ids."""
        out = [b""] * len(ids)
        step = 4 * TOKENS_AT_ONCE
        blocks = [(i, d[a : a + step]) for i, d in enumerate(ids) for a in range(0, len(d), step)]
        begin = 0
        while begin < len(blocks):
            end, size = begin, 0
            while end < len(blocks) and (end == begin or size + len(blocks[end][1]) <= step):
                size += len(blocks[end][1])
                end += 1
            token = np.frombuffer(b"".join(b for _, b in blocks[begin:end]), "<u4").astype(np.int32)
            block = np.repeat(np.arange(begin, end, dtype=np.int64), [len(b) // 4 for _, b in blocks[begin:end]])
            place = np.arange(len(token), dtype=np.int32)
            self.con.register("tokens", pa.table({"block": block, "place": place, "token": token}))
            for n, letters in self.con.sql(DECODE).fetchall():
                out[blocks[n][0]] += letters.encode("latin-1")
            self.con.unregister("tokens")
            begin = end
        return out


def database(path: str, pattern: str) -> Database:
    return kept(f"duckdb {path}", lambda: Database(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): each text's token ids as little-endian unsigned 32-bit integers.

    ``path`` is a rank file that every executor has, ``pattern`` cuts texts into words.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = database(path, pattern).encode(texts)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(ids, pa.binary())], ["key", "ids"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"key {kind}, ids binary").withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded`` of bytes in place of ``ids``; null ids are empty."""
    carry = [c for c in encoded.columns if c != ids]
    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [d or b"" for d in batch.column(ids).to_pylist()]
            decoded = database(path, pattern).decode(data)
            columns = [*(batch.column(c) for c in carry), pa.array(decoded, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*carry, "decoded"])

    return encoded.select(*carry, ids).mapInArrow(tidy(run), f"{schema}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded): encoded and decoded again by one database per worker."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                base = database(path, pattern)
                ids = base.encode([t or "" for t in part.column("text").to_pylist()])
                columns = [part.column("key"), pa.array(ids, pa.binary()), pa.array(base.decode(ids), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "ids", "decoded"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"key {kind}, ids binary, decoded binary").withColumnRenamed("key", key)
