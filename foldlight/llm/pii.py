"""Personal data by weak supervision: labelers vote on candidate spans, a classifier decides.

Candidates are e-mail addresses (plain or with "at" and "dot" spelled out), IP
addresses, card numbers and phone numbers in wide patterns. Five labelers vote
yes, no or abstain on each:

* checker: the strict pattern and its check (octets, Luhn sum, digit count); it
  abstains where the strict pattern does not apply;
* shape: length, leading zeros, letters;
* gazetteer: known top-level domains, calling codes, card issuers;
* context: telling words before the span;
* edges: what stands right before and after.

Expectation-maximisation over the counts of vote patterns estimates how each
labeler votes on true and on false spans, starting from stated reliabilities.
The resulting probabilities train a logistic classifier on the votes and the
form of a span, which decides about the spans that are not certain. Spans of the
strict patterns that pass their check are always reported (``base``); the
classifier adds others that do not overlap them.

Fitting counts the patterns of all documents; there are at most a few thousand
patterns whatever the size of the table, and only their counts reach the driver.
Null text counts as empty. Repeated rows get equal spans, an empty table gives an
empty result. Offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlight.llm.quality import fit_logistic
from foldlight.llm.words import kept, tidy

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("checker", "shape", "gazetteer", "context", "edges")
# how often a labeler that votes is right, before any data is seen
RELIABILITY = (0.99999, 0.8, 0.85, 0.9, 0.7)
ABSTAIN = 2

DOMAINS = frozenset(
    "com org net edu gov int mil info biz io dev app de fr es it uk eu nl be ch at pl se no dk fi pt ie"
    " us ca mx br ar au nz jp cn in kr ru za".split()
)
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45",
           "46", "47", "48", "49", "52", "54", "55", "61", "64", "81", "82", "86", "90", "91")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "35", "36", "6011", "65", "62")
FOR = re.compile(
    r"\b(e-?mail|mail|contact|write|reach|call|tel|phone|mobile|fax|whatsapp|card|visa|mastercard|amex"
    r"|credit|debit|ip|host|server|address|login|correo|courriel|telefon|anruf|karte|tarjeta|carte)\b",
    re.IGNORECASE,
)
AGAINST = re.compile(
    r"\b(version|ver|release|section|chapter|figure|table|page|isbn|issn|doi|order|item|sku|invoice|id"
    r"|serial|rfc|oid|build|part|no|nr|ref)\b\.?\W*$",
    re.IGNORECASE,
)
DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


def _patterns() -> dict[str, re.Pattern]:
    return {
        "any": re.compile(r"[0-9@]|[(\[]at[)\]]| dot ", re.IGNORECASE),
        "local": re.compile(r"[A-Za-z0-9._%+-]"),
        "domain": re.compile(DOMAIN),
        "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
        "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
        "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
        "spelled": re.compile(
            r"(?<![\w.+-])[A-Za-z0-9._+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}"
            r"(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{2,63}){1,4}",
            re.IGNORECASE,
        ),
        "local_phone": re.compile(
            r"(?<![\w+(.-])(?:\+[0-9]{1,3}[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w.-]?[0-9])"
        ),
    }


def patterns() -> dict[str, re.Pattern]:
    return kept("pii patterns", _patterns)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of ``[A-Za-z0-9._%+-]+@`` and a domain, in linear time."""
    p = patterns()
    local, domain = p["local"], p["domain"]
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and local.match(text, start - 1):
            start -= 1
        found = domain.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def joined_spans(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover together."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted(spans):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def candidates(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, checker's vote) of all candidate spans."""
    p = patterns()
    if not p["any"].search(text):
        return []
    out = [("email", a, b, 1) for a, b in emails(text)]
    for m in p["ip"].finditer(text):
        octets = m[0].split(".")
        out.append(("ip", m.start(), m.end(), int(all(len(y := x.lstrip("0")) <= 3 and int(y or "0") <= 255 for x in octets))))
    for m in p["card"].finditer(text):
        digits = _digits(m[0]) if m.end() - m.start() <= 37 else ""
        if 12 <= len(digits) <= 19:
            out.append(("card", m.start(), m.end(), int(luhn(digits))))
    for m in p["phone"].finditer(text):
        out.append(("phone", m.start(), m.end(), int(9 <= len(_digits(m[0])) <= 15)))
    out += [("email", *m.span(), ABSTAIN) for m in p["spelled"].finditer(text)]
    out += [("phone", *m.span(), ABSTAIN) for m in p["local_phone"].finditer(text)]
    return out


def _shape(kind: str, span: str, digits: str) -> int:
    if kind == "email":
        return int(span[:1].isalnum() and re.search(r"[A-Za-z]{2,10}$", span) is not None)
    if kind == "ip":
        parts = span.split(".")
        return int(all(x == "0" or not x.startswith("0") for x in parts) and parts[0] != "0")
    if kind == "card":
        return int(len(digits) in (13, 14, 15, 16) and len(set(digits)) > 2)
    return int(10 <= len(digits) <= 13)


def _gazetteer(kind: str, span: str, digits: str) -> int:
    if kind == "email":
        return 1 if re.split(r"[.\s)\]]", span)[-1].lower() in DOMAINS else ABSTAIN
    if kind == "ip":
        return 1 if span.startswith(("10.", "192.168.", "172.16.", "127.0.0.")) else ABSTAIN
    if kind == "card":
        return 1 if digits.startswith(ISSUERS) else ABSTAIN
    if span.startswith("+"):
        return 1 if digits.startswith(CALLING) else 0
    return 1 if digits[0] > "1" else 0


def _context(text: str, start: int) -> int:
    before = text[max(0, start - 40) : start]
    if AGAINST.search(before):
        return 0
    return 1 if FOR.search(before) else ABSTAIN


def _edges(text: str, start: int, end: int) -> int:
    left, right = text[start - 1 : start], text[end : end + 1]
    after = text[end + 1 : end + 2]
    clean = not (left.isalnum() or right.isalnum() or left in ("$", "€", "£", ".", "#") and left)
    return int(clean and not (right in (".", ",", "-", ":") and right and after.isdigit()) and right != "%")


def described(text: str, span: tuple[str, int, int, int]) -> tuple[int, ...]:
    """Kind number, the votes of the labelers, and the form: digit count and separators in classes."""
    kind, start, end, check = span
    body = text[start:end]
    digits = _digits(body)
    votes = (check, _shape(kind, body, digits), _gazetteer(kind, body, digits), _context(text, start))
    form = (min(len(digits) // 4, 5), min(sum(not c.isalnum() for c in body), 4) // 2)
    return (KINDS.index(kind), *votes, _edges(text, start, end), *form)


def posterior(rows: np.ndarray, share: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Probability that spans with (kind, votes...) are true; abstaining says nothing."""
    odds = np.log(share / (1 - share))[rows[:, 0]]
    for j in range(len(LABELERS)):
        said = np.log(table[j][1] / table[j][0])
        odds = odds + np.append(said, 0.0)[rows[:, 1 + j]]
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def estimate(
    rows: np.ndarray, counts: np.ndarray, steps: int = 200
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability that the spans of each row are true, the share of true spans per kind, and
    P(vote | truth) as [labeler, truth, vote].

    ``rows`` are distinct (kind, votes...) with ``counts``. Truth has a share per
    kind; a labeler is as reliable on all kinds. Every estimate leans on ``RELIABILITY``
    with the weight of 50 spans and a tenth of those given; the checker's is known and stays.
    """
    kinds, votes = rows[:, 0], rows[:, 1 : 1 + len(LABELERS)]
    right = np.array(RELIABILITY)
    first = np.stack([np.stack([right, 1 - right], 1), np.stack([1 - right, right], 1)], 1)
    weight = 50 + 0.1 * counts.sum()
    table, share = first, np.full(len(KINDS), 0.5)
    p = np.full(len(rows), 0.5)
    for _ in range(steps):
        new = posterior(rows, share, table)
        moved = np.abs(new - p).max(initial=0)
        p = new
        share = np.array(
            [(1 + (counts * p)[kinds == k].sum()) / (2 + counts[kinds == k].sum()) for k in range(len(KINDS))]
        )
        table = weight * first
        for j in range(1, len(LABELERS)):
            for truth, mass in ((0, counts * (1 - p)), (1, counts * p)):
                table[j, truth] += np.bincount(votes[:, j], mass, minlength=3)[:2]
        table = table / table.sum(axis=2, keepdims=True)
        if moved < 1e-9:
            break
    return p, share, table


def _columns(rows: np.ndarray) -> np.ndarray:
    """Indicator columns of every value of every field; -1 sets none."""
    sizes = (len(KINDS), *[3] * len(LABELERS), 6, 3)
    return np.concatenate([np.eye(n + 1)[rows[:, i]][:, :n] for i, n in enumerate(sizes)], axis=1)


@dataclass
class SpanModel:
    """The fitted classifier and the estimates behind it."""

    weights: np.ndarray
    reliability: dict[str, list[list[float]]] = field(default_factory=dict)

    def probability(self, row: tuple[int, ...]) -> float:
        line = self.weights[0] + _columns(np.array([row]))[0] @ self.weights[1:]
        return float(1 / (1 + np.exp(-np.clip(line, -30, 30))))

    def find(self, text: str, memo: dict | None = None) -> list[tuple[int, str, int, bool, float]]:
        """(start, kind, end, base, probability) by start, then kind as listed."""
        memo = {} if memo is None else memo
        base, other = [], []
        for span in candidates(text):
            row = described(text, span)
            if row not in memo:
                memo[row] = self.probability(row)
            kind, start, end, check = span
            (base if check == 1 else other).append((start, kind, end, check == 1, memo[row]))
        starts, ends = joined_spans([(s, e) for s, _, e, _, _ in base])
        for found in sorted(other, key=lambda f: (-f[4], f[0])):
            start, end = found[0], found[2]
            at = bisect_right(starts, start)
            free = (at == 0 or ends[at - 1] <= start) and (at == len(starts) or starts[at] >= end)
            if found[4] >= 0.5 and free:
                base.append(found)
                starts.insert(at, start)
                ends.insert(at, end)
        return sorted(base, key=lambda f: (f[0], KINDS.index(f[1]), f[2]))

    def spans(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, spans) with spans as array<struct<kind, start, end, base, probability>>."""
        kind = docs.schema[key].dataType.simpleString()
        shape = pa.list_(
            pa.struct(
                [
                    ("kind", pa.string()),
                    ("start", pa.int64()),
                    ("end", pa.int64()),
                    ("base", pa.bool_()),
                    ("probability", pa.float64()),
                ]
            )
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo: dict = {}
            for batch in batches:
                found = [
                    [dict(kind=k, start=s, end=e, base=b, probability=p) for s, k, e, b, p in self.find(t, memo)]
                    for t in pc.fill_null(batch.column("text"), "").to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, shape)], ["key", "spans"])

        rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        one = "struct<kind:string,start:bigint,end:bigint,base:boolean,probability:double>"
        return rows.mapInArrow(tidy(run), f"key {kind}, spans array<{one}>").withColumnRenamed("key", key)

    def redact(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with every span in ``text`` replaced by its kind in brackets; null stays null."""
        schema, at = docs.schema, docs.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo: dict = {}
            for batch in batches:
                out = []
                for t in batch.column(at).to_pylist():
                    parts, end = [], 0
                    for start, kind, stop, _, _ in self.find(t or "", memo):
                        if start >= end:
                            parts += [t[end:start], f"[{kind.upper()}]"]
                        end = max(end, stop)
                    out.append("".join([*parts, t[end:]]) if parts else t)
                columns = batch.columns
                columns[at] = pa.array(out, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return docs.mapInArrow(tidy(run), schema)


def fit_spans(docs: DataFrame, text: str = "text") -> SpanModel:
    """Estimate the labelers and train the classifier on all candidates of ``docs``."""
    width = 1 + len(LABELERS) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column("text").drop_null().to_pylist():
                counts.update(described(t, span) for span in candidates(t))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([list(row) for row in counts], pa.list_(pa.int32())),
                pa.array(list(counts.values()), pa.int64()),
            ],
            ["row", "n"],
        )

    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), "row array<int>, n long")
    total = found.groupBy("row").agg(F.sum("n").alias("n")).orderBy("row").collect()
    if not total:
        return SpanModel(np.zeros(1 + _columns(np.zeros((1, width), int)).shape[1]))
    rows = np.array([r["row"] for r in total])
    counts = np.array([r["n"] for r in total], float)
    votes, back = np.unique(rows[:, : 1 + len(LABELERS)], axis=0, return_inverse=True)
    back = back.ravel()
    p, share, table = estimate(votes, np.bincount(back, counts))
    # every conceivable vote, as the estimates judge it, steadies the classifier where data are few
    grid = np.array(list(product(range(len(KINDS)), *[range(3)] * len(LABELERS))))
    rows = np.concatenate([rows, np.column_stack([grid, np.full((len(grid), 2), -1)])])
    counts = np.concatenate([counts, np.ones(len(grid))])
    p = np.concatenate([p[back], posterior(grid, share, table)])
    x = _columns(rows)
    truth = np.repeat([1.0, 0.0], len(x))
    each = np.concatenate([counts * p, counts * (1 - p)])
    weights = fit_logistic(np.concatenate([x, x]), truth, each, ridge=1e-3)
    return SpanModel(weights, {name: table[j].tolist() for j, name in enumerate(LABELERS)})
