"""Plain versions that several tests compare with."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ("email", "ip", "card", "phone")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_components(rows, sets=None, percent=85):
    """key -> smallest key of its component, over all pairs of full sets; keys are unique."""
    sets = sets or [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if not a or not b or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                continue
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, key), key)
    return {key: least[find(i)] for i, (key, _) in enumerate(rows)}


def brute_repeats(rows, window=35):
    """key -> (words, words removed, kept words joined by a space)."""
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = {}
    for (key, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out[key] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def base_spans(text):
    """(start, kind number, end) of the base patterns, sorted."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [
        (m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15
    ]
    return sorted(out)


def redacted(text):
    parts, end = [], 0
    for start, kind, stop in base_spans(text):
        if start >= end:
            parts += [text[end:start], f"[{KINDS[kind].upper()}]"]
        end = max(end, stop)
    return "".join([*parts, text[end:]])


def check_layout(rows, capacity):
    """Sequences are gapless and within capacity; their number."""
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def check_pieces(rows, texts, capacity, path):
    """Pieces are the document's ids and the end id, cut from the end."""
    tokenizer = Tokenizer.from_file(path)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == set(texts)
    for i, parts in by.items():
        ids = [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        parts.sort(key=lambda r: r.piece)
        at = 0
        for j, r in enumerate(parts):
            assert (r.piece, r.start) == (j, at)
            assert r.crc == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert j == 0 or r.length == capacity
            at += r.length
        assert at == len(ids)
