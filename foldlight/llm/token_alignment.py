"""Tokens of two tokenizers over the same bytes, cut into groups where both end together.

Tokenizer A reads a space and the text, tokenizer B the text, before which it puts the space itself, so both
cover the same bytes. The character offsets that tokenizers gives and the spans that sentencepiece
gives (``return_type="proto"``, the immutable proto's present name) are coarse cuts: a token whose span holds as many bytes
as the token decodes to ends there. Tokens that share a character (parts of a multibyte
character, byte-fallback pieces) are refined: their decoded bytes are counted on from the last cut. A text
whose joined token bytes are not the space and the text has no tokens at all, and neither has null or empty text.

Where both vocabularies allow it, a text is cut where no token of either can span: before a space that stands
between two visible characters (A splits at spaces, no piece of B has a space mark after another
character) and between a letter and punctuation (A splits there, no piece of B holds the two side by side). The groups of a
text are those of its segments in order. Segments that this worker does not know are joined to texts of some
thousand characters, which both tokenizers cut at the same places, and aligned with few calls of the libraries; the known ones are kept in two generations bounded by bytes. A segment of any length is aligned alone. Other vocabularies read whole texts.

A link is a token of A and a token of B that end at the same byte. Counts of id pairs over all links are
summed per task before a shuffle. The pair table depends on the vocabularies, not on the number of
texts; it is sent to the tasks in slices of at most ``slice_pairs`` rows, one pass over the written links for each.

Rows are read one by one: repeated rows and ties need no rule, and links of repeated rows count again. An empty table
gives an empty result. Columns not named are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import sys
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlight.llm.encoders import byte_letters, splits_at_spaces
from foldlight.llm.words import chunks, kept, tidy
from foldlight.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VISIBLE = "!-~¡-¬®-ɏ"
PLAIN = re.compile(f"[ \n{VISIBLE}]*")
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
TAILS = ',;:!?.)]}"/%*&-_\n'  # may begin a segment behind a letter, if the pieces of B allow it
KNOWN_BYTES = 72 << 20  # of one generation of known segments
ROWS_AT_ONCE = 400
JOINED_CHARS = 1 << 13  # of segments that are read as one text
SEPARATORS = (",", "|", ";", "\n")
KEPT_SEGMENT = 1 << 8  # longer segments are aligned again when met again
COUNT_AT_ONCE = 1 << 21  # links whose pairs are counted at once
SLICE_PAIRS = 1 << 21

Span = tuple[int, int]  # first byte, byte after the last
Entry = tuple[int, int, int, str, bytes]  # tokens of A, of B, groups, their text, linked id pairs


def token_ends(spans: Iterable[Span], pieces: list[bytes], data: bytes) -> list[int] | None:
    """The byte after each token, given its span and its decoded bytes; None where these are not ``data``."""
    if b"".join(pieces) != data:
        return None
    ends, at = [], 0
    for (start, end), piece in zip(spans, pieces, strict=True):
        size = len(piece)
        if start == at and end - start == size:
            at = end  # the span is the token's own
        else:  # it shares characters with its neighbours
            at += size
        ends.append(at)
    return ends


def joined_ends(spans: list[Span], sizes: np.ndarray, byte: np.ndarray | None = None) -> np.ndarray:
    """``token_ends`` of a text that the tokens decode to; ``byte`` is the place of each character that spans count."""
    bounds = np.fromiter(chain.from_iterable(spans), np.int64, 2 * len(spans)).reshape(-1, 2)
    if byte is not None:
        bounds = byte[bounds]
    counted = np.cumsum(sizes)
    own = (bounds[:, 0] == counted - sizes) & (bounds[:, 1] - bounds[:, 0] == sizes)
    cut = np.maximum.accumulate(np.where(own, np.arange(len(own)), -1))  # the last token that ends with its span
    return counted + np.where(cut >= 0, bounds[cut, 1] - counted[cut], 0)


def entry(a_ids: list[int], a_ends: list[int], b_ids: list[int], b_ends: list[int]) -> Entry:
    """Groups between the common ends, and the links at them; every token has a byte, so ends increase."""
    if len(b_ids) == 1:
        group = ",".join(map(str, a_ids)) + "|" + str(b_ids[0])
        return len(a_ids), 1, 1, group, struct.pack("<2I", a_ids[-1], b_ids[0])
    groups, links, i, j = [], [], 0, 0
    place = {e: m for m, e in enumerate(b_ends, 1)}
    for k, e in enumerate(a_ends, 1):
        m = place.get(e)
        if m is not None:
            groups.append(",".join(map(str, a_ids[i:k])) + "|" + ",".join(map(str, b_ids[j:m])))
            links += (a_ids[k - 1], b_ids[m - 1])
            i, j = k, m
    return len(a_ids), len(b_ids), len(groups), ";".join(groups), struct.pack(f"<{len(links)}I", *links)


class Aligner:
    """Both tokenizers and the segments met so far; one per worker process."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letters = byte_letters()
        with open(a_path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        self.a_bytes = {i: bytes(letters[c] for c in word) for word, i in vocabulary.items() if all(c in letters for c in word)}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        plain = [not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)) for i in range(len(pieces))]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_sizes = np.zeros(max(self.a_bytes, default=0) + 1, np.int64)
        for i, piece in self.a_bytes.items():
            self.a_sizes[i] = len(piece)
        self.b_sizes = np.array([len(piece) for piece in self.b_bytes], np.int64)
        self.names = [str(i) for i in range(max(len(self.a_sizes), len(self.b_sizes)))]
        self.anchor = len(self.b.encode("a"))  # pieces before a tail that is read behind this letter
        self.cut, self.joins, self.tails = None, None, ""
        if splits_at_spaces(a_path):
            self._find_cuts([p for p, known in zip(pieces, plain, strict=True) if known])
        self.new: dict[str, Entry | None] = {}
        self.old: dict[str, Entry | None] = {}
        self.size = 0

    def _find_cuts(self, pieces: list[str]) -> None:
        """Set the places that no token spans, where the pieces allow any."""
        if any("▁" in p.lstrip("▁") for p in pieces):
            return
        beside = {y for p in pieces for x, y in zip(p, p[1:], strict=False) if x.isalpha()}
        self.tails = "".join(c for c in TAILS if c not in beside)
        behind_letter = f"|(?<=[{LETTER}])(?=[{re.escape(self.tails)}])" if self.tails else ""
        self.cut = re.compile(f"(?<=[{VISIBLE}])(?= [^ ]){behind_letter}")
        self.joins = re.compile(f" (?! )[ \n{VISIBLE}]*[{VISIBLE}]")

    def segments(self, text: str) -> list[str]:
        """A space and the text, cut; not all places that allow a cut need to be taken."""
        whole = " " + text
        if self.cut is None:
            return [whole]
        if "  " in whole or whole[-1] == " " or not PLAIN.fullmatch(text):
            return self.cut.split(whole)
        out, tails, split = [], self.tails, self.cut.split
        for word in text.split(" "):  # every space stands before a visible character or a line's end
            if "\n" in word:
                out += split(" " + word)
            elif word[-1] in tails:
                base = word.rstrip(tails)
                if base and base[-1].isalpha():
                    out += (" " + base, word[len(base) :])
                else:
                    out.append(" " + word)
            else:
                out.append(" " + word)
        return out

    def _b_spans(self, proto, tail: bool) -> tuple[list[int], list[Span]]:
        shift = -1 if tail else 1
        found = proto.pieces[self.anchor :] if tail else proto.pieces
        ids, spans = [], []
        for p in found:
            ids.append(p.id)
            spans.append((p.begin + shift, p.end + shift))
        if spans and not tail:  # the first piece begins with the space that is no part of the text read
            spans[0] = (0, spans[0][1])
        return ids, spans

    def align(self, segments: list[str]) -> list[Entry | None]:
        """Groups and links of each segment, a space and text or a tail; None: no tokens."""
        encodings = self.a.encode_batch(segments, add_special_tokens=False)
        read = [s[1:] if s[0] == " " else "a" + s for s in segments]
        protos = self.b.encode(read, return_type="proto", num_threads=1)
        out: list[Entry | None] = []
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        for segment, encoding, proto in zip(segments, encodings, protos, strict=True):
            data = segment.encode()
            a_ids, a_spans = encoding.ids, encoding.offsets
            if len(data) != len(segment):
                byte = [0, *accumulate(len(c.encode()) for c in segment)]
                a_spans = [(byte[s], byte[e]) for s, e in a_spans]
            b_ids, b_spans = self._b_spans(proto, segment[0] != " ")
            a_ends = token_ends(a_spans, [a_bytes[i] for i in a_ids], data)
            b_ends = token_ends(b_spans, [b_bytes[i] for i in b_ids], data)
            fits = a_ends is not None and b_ends is not None
            out.append(entry(a_ids, a_ends, b_ids, b_ends) if fits else None)
        return out

    def align_joined(self, segments: list[str]) -> list[Entry | None]:
        """The same for segments that match ``joins``: read as one text, which both tokenizers cut between them.

        Where the tokens' bytes are not the text, its halves are read.
        """
        if len(segments) == 1:
            return self.align(segments)
        text = "".join(segments)
        data = text.encode()
        encoding = self.a.encode(text, add_special_tokens=False)
        proto = self.b.encode(text[1:], return_type="proto", num_threads=1)
        a_list, a_spans = encoding.ids, encoding.offsets
        b_list, b_spans = self._b_spans(proto, False)
        a_ends = b_ends = None
        if b"".join([self.a_bytes[i] for i in a_list]) == data == b"".join([self.b_bytes[i] for i in b_list]):
            a_ids, b_ids = np.array(a_list, np.int64), np.array(b_list, np.int64)
            byte = None
            if len(data) != len(text):
                widths = np.fromiter((len(c.encode()) for c in text), np.int64, len(text))
                byte = np.concatenate([[0], np.cumsum(widths)])
            a_ends = joined_ends(a_spans, self.a_sizes[a_ids], byte)
            b_ends = joined_ends(b_spans, self.b_sizes[b_ids])
            sizes = [len(s) if s.isascii() else len(s.encode()) for s in segments]
            edges = np.cumsum(np.array(sizes, np.int64))
            common = np.intersect1d(a_ends, b_ends, assume_unique=True)
            at = np.searchsorted(common, edges)
            if len(common) and np.array_equal(common[np.minimum(at, len(common) - 1)], edges):
                return self._entries(a_ids, a_ends, b_ids, b_ends, common, at + 1)
        half = len(segments) // 2
        return self.align_joined(segments[:half]) + self.align_joined(segments[half:])

    def _entries(
        self, a_ids: np.ndarray, a_ends: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray, common: np.ndarray, upto: np.ndarray
    ) -> list[Entry]:
        """Entries of segments, given the common ends and how many of them each segment and those before it have."""
        a_last, b_last = np.searchsorted(a_ends, common), np.searchsorted(b_ends, common)
        links = np.empty((len(common), 2), "<u4")
        links[:, 0], links[:, 1] = a_ids[a_last], b_ids[b_last]
        # tokens in the order of the text of groups: those of A and of B of a group, then the next group's
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        before_b = np.concatenate([[0], b_last + 1])[a_group]
        a_place, b_place = np.arange(len(a_ids)) + before_b, np.arange(len(b_ids)) + (a_last + 1)[b_group]
        ids, signs = np.empty(len(a_ids) + len(b_ids), np.int64), np.zeros(len(a_ids) + len(b_ids), np.int64)
        ids[a_place], ids[b_place] = a_ids, b_ids
        signs[a_place[a_last]] = 1
        signs[b_place[b_last]] = 2
        signs[b_place[b_last[upto - 1]]] = 3
        parts = [""] * (2 * len(ids))
        parts[::2] = map(self.names.__getitem__, ids.tolist())
        parts[1::2] = map(SEPARATORS.__getitem__, signs.tolist())
        groups = "".join(parts).split("\n")
        raw = links.tobytes()
        n_a = np.diff(a_last[upto - 1] + 1, prepend=0).tolist()
        n_b = np.diff(b_last[upto - 1] + 1, prepend=0).tolist()
        n_groups = np.diff(upto, prepend=0).tolist()
        stops = [0, *(8 * upto).tolist()]
        out = []
        for i in range(len(upto)):
            out.append((n_a[i], n_b[i], n_groups[i], groups[i], raw[stops[i] : stops[i + 1]]))
        return out

    def aligned(self, segments: list[str]) -> Iterator[tuple[str, Entry | None]]:
        """Each segment with its entry: those that may stand side by side are read together, others one by one."""
        fits = self.joins.fullmatch if self.joins else lambda s: None
        together: list[str] = []
        alone: list[str] = []
        size = 0
        for s in segments:
            if len(s) > KEPT_SEGMENT or not fits(s):
                alone.append(s)
                continue
            together.append(s)
            size += len(s)
            if size > JOINED_CHARS:
                yield from zip(together, self.align_joined(together), strict=True)
                together, size = [], 0
        if together:
            yield from zip(together, self.align_joined(together), strict=True)
        for i in range(0, len(alone), 1000):
            part = alone[i : i + 1000]
            yield from zip(part, self.align(part), strict=True)

    def look_up(self, segments: set[str]) -> dict[str, Entry | None]:
        """The entry of each segment; those of at most KEPT_SEGMENT characters become known."""
        if self.size > KNOWN_BYTES:
            self.old, self.new, self.size = self.new, {}, 0
        new, old = self.new, self.old
        found: dict[str, Entry | None] = {}
        missing = []
        for s in segments:
            if s in new:
                found[s] = new[s]
            elif s in old:
                found[s] = old[s]
                self._keep(s, old[s])
            else:
                missing.append(s)
        for s, e in self.aligned(missing):
            found[s] = e
            if len(s) <= KEPT_SEGMENT:
                self._keep(s, e)
        return found

    def _keep(self, segment: str, found: Entry | None) -> None:
        self.new[segment] = found
        self.size += 350 + len(segment) + (len(found[3]) + len(found[4]) if found else 0)

    def texts(self, texts: list[str | None]) -> list[list[Entry]]:
        """Entries of each text in order; none for a text without tokens."""
        cut = [self.segments(t) if t else [] for t in texts]
        known = self.look_up({s for parts in cut for s in parts})
        out = []
        for parts in cut:
            entries = [known[s] for s in parts]
            out.append([] if None in entries else entries)
        return out


def aligner(a_path: str, b_path: str) -> Aligner:
    return kept(f"aligner {a_path} {b_path}", lambda: Aligner(a_path, b_path))


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def align_tokens(
    docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", with_groups: bool = False
) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, groups_sha256, links) of each row.

    ``links`` holds the linked ids (a, b) in order, as little-endian unsigned 32-bit integers. ``with_groups``
    adds ``groups``, written as ``a1,a2|b1;a3|b2,b3``. Every executor has the files.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        for batch in batches:
            for part in (c.slice(i, ROWS_AT_ONCE) for c in chunks(batch) for i in range(0, c.num_rows, ROWS_AT_ONCE)):
                rows = both.texts(part.column("text").to_pylist())
                fields = [tuple(zip(*r, strict=True)) or ((),) * 5 for r in rows]  # n_a, n_b, n_groups, groups, links
                groups = [";".join(f[3]) for f in fields]
                links = [b"".join(f[4]) for f in fields]
                hashes = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                columns = [
                    part.column("key"),
                    *(pa.array([sum(f[k]) for f in fields], pa.int64()) for k in range(3)),
                    pa.array([len(x) // 8 for x in links], pa.int64()),
                    pa.array(hashes, pa.string()),
                    pa.array(links, pa.binary()),
                ]
                names = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
                if with_groups:
                    columns, names = [*columns, pa.array(groups, pa.string())], [*names, "groups"]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    more = ", groups string" if with_groups else ""
    return rows.mapInArrow(tidy(run), f"key {kind}, {ALIGNED}, links binary{more}").withColumnRenamed("key", key)


def linked(links: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The links of some rows, a in the low half and b in the high, and where each row's begin and the last ends."""
    kind = np.int64 if pa.types.is_large_binary(links.type) else np.int32
    if not len(links):
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    offsets = np.frombuffer(links.buffers()[1], kind)[links.offset : links.offset + len(links) + 1].astype(np.int64)
    data = links.buffers()[2]
    if data is None or offsets[0] == offsets[-1]:
        return np.empty(0, np.uint64), np.zeros(len(links) + 1, np.int64)
    codes = np.frombuffer(data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])), "<u8")
    return codes, (offsets - offsets[0]) // 8


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): how many links hold each id pair, and whether no other pair of its b has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
            found = pa.array(np.concatenate(parts)).value_counts()
            code, n = (x.to_numpy() for x in found.flatten())
            a, b = (code & np.uint64(0xFFFFFFFF)).astype(np.int64), (code >> np.uint64(32)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

        parts, size = [], 0
        for batch in batches:
            codes, _ = linked(batch.column("links"))
            for i in range(0, len(codes), COUNT_AT_ONCE):
                parts.append(codes[i : i + COUNT_AT_ONCE].copy())
                size += len(parts[-1])
                if size >= COUNT_AT_ONCE:
                    yield counted(parts)
                    parts, size = [], 0
        if parts:
            yield counted(parts)

    found = aligned.select("links").mapInArrow(tidy(run), "a long, b long, n long")
    counts = materialize(found.groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def link_totals(aligned: DataFrame, pairs: DataFrame, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """``aligned`` with n_best and count_sum in place of links; ``aligned`` and ``pairs`` are written tables."""
    spark = aligned.sparkSession
    carry = [c for c in aligned.columns if c != "links"]
    rows = aligned.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    slices = max(1, -(-pairs.count() // slice_pairs))
    for i in range(slices):
        # hashed evenly, so a slice holds about slice_pairs rows however many there are
        part = pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(slices)) == i).toArrow()
        code = part["b"].to_numpy().astype(np.uint64) << np.uint64(32) | part["a"].to_numpy().astype(np.uint64)
        best = part["best"].to_numpy().astype(np.int64)
        sent = spark.sparkContext.broadcast((pa.array(code), part["n"].to_numpy(), best))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            code, n, best = sent.value
            for part in (c for batch in batches for c in chunks(batch, "links")):
                codes, edges = linked(part.column("links"))
                at = pc.index_in(pa.array(codes), value_set=code).to_numpy(zero_copy_only=False)
                hit = np.flatnonzero(~np.isnan(at)) if at.dtype.kind == "f" else np.arange(len(at))
                at = at[hit].astype(np.int64)
                # totals up to each link that is in this slice, then differences per row
                among = np.searchsorted(hit, edges)
                n_best = np.diff(np.concatenate([[0], np.cumsum(best[at])])[among])
                total = np.diff(np.concatenate([[0], np.cumsum(n[at])])[among])
                columns = dict(zip(part.schema.names, part.columns, strict=True))
                columns["n_best"] = pa.array(columns["n_best"].to_numpy() + n_best)
                columns["count_sum"] = pa.array(columns["count_sum"].to_numpy() + total)
                yield pa.RecordBatch.from_pydict(columns)

        rows = rows.mapInArrow(tidy(run), rows.schema)
        if i + 1 < slices:
            rows = materialize(rows, "totals")
    return rows.select(*carry, "n_best", "count_sum")


def alignment_totals(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of each row."""
    aligned = materialize(align_tokens(docs, a_path, b_path, key, text), "aligned")
    pairs = materialize(pair_counts(aligned), "best")
    return link_totals(aligned, pairs)
