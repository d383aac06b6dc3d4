"""URL verdicts from Bloom filter cascades: exact membership without a join.

A cascade answers whether a key of a known universe is listed. Level 0 is a
Bloom filter of the listed keys, level 1 of the other keys that level 0 lets
through by mistake, level 2 of the listed keys that level 1 lets through, and so
on until a level makes no mistake on the universe. A key is then decided by the
first level that rejects it. Levels shrink by half, so a cascade takes a few bits
per listed key; ``most_bytes`` is a checked bound of what is sent to the tasks.

Every page has candidate keys: its host and each parent domain, joined with the
beginnings of its path that are as long as some rule's path. The universe is the
set of candidate keys of all pages, so answers about pages are exact. The longest
rule that fits decides (of equally long ones the first in alphabetical order);
where none fits, a second cascade of listed hosts does.

Null urls and urls without ``://`` have an empty host and path, no rule, and the
verdict allow. Repeated rows are judged row by row, ties cannot differ, an empty
table gives an empty result, and only key and url are read.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlight.llm.words import tidy
from foldlight.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 16  # bytes of a filter that travel together while it is built


@dataclass
class Level:
    bits: int
    hashes: int
    data: bytes = b""

    def places(self, key: str, level: int) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key, seed=level)
        a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
        return [(a + i * b) % 0x1FFFFFFFFFFFFFFF % self.bits for i in range(self.hashes)]

    def has(self, key: str, level: int) -> bool:
        return all(self.data[p >> 3] >> (p & 7) & 1 for p in self.places(key, level))


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    @property
    def n_bytes(self) -> int:
        return sum(len(x.data) for x in self.levels)

    def passes(self, key: str, count: int) -> bool:
        return all(self.levels[i].has(key, i) for i in range(count))

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if not level.has(key, i):
                return i % 2 == 1
        return len(self.levels) % 2 == 1


def _sized(n: int, rate: float) -> Level:
    hashes = max(1, round(math.log2(1 / rate)))
    return Level(max(64, math.ceil(n * hashes / math.log(2))), hashes)


def _filled(keys: DataFrame, level: Level, number: int) -> bytes:
    """The level's bits with all ``keys`` set; chunks are merged in tasks before the driver sees them."""

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, bytearray] = {}
        for batch in batches:
            for key in batch.column(0).to_pylist():
                for p in level.places(key, number):
                    part = parts.setdefault(p // (8 * CHUNK), bytearray(CHUNK))
                    part[p >> 3 & CHUNK - 1] |= 1 << (p & 7)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(parts), pa.int32()), pa.array([bytes(x) for x in parts.values()], pa.binary())],
            ["part", "bits"],
        )

    def merged(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()]
        both = np.bitwise_or.reduce(rows).tobytes()
        return pa.table([table.column("part").slice(0, 1), pa.array([both], pa.binary())], ["part", "bits"])

    shape = "part int, bits binary"
    parts = keys.mapInArrow(tidy(set_bits), shape).groupBy("part").applyInArrow(merged, shape).collect()
    out = bytearray(-(-level.bits // 8))
    for row in parts:
        low = row["part"] * CHUNK
        out[low : low + CHUNK] = row["bits"][: len(out) - low]
    return bytes(out)


def build_cascade(universe: DataFrame, most_bytes: int = 64 << 20) -> Cascade:
    """From distinct (key, listed) rows; every key is a non-null string."""
    universe = materialize(universe.select("key", "listed"), "universe")
    size = {r["listed"]: r["count"] for r in universe.groupBy("listed").count().collect()}
    cascade = Cascade()
    if not size.get(True):
        return cascade
    others = size.get(False, 0)
    rate = min(0.5, size[True] / max(1, others) / math.sqrt(2))
    keys, count = universe.filter("listed").select("key"), size[True]
    while count:
        number = len(cascade.levels)
        level = _sized(count, 0.5 if number else rate)
        level.data = _filled(keys, level, number)
        cascade.levels.append(level)
        if cascade.n_bytes > most_bytes:
            raise ValueError(f"the cascade needs more than {most_bytes} bytes; split the keys by their hash")

        def mistaken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                passed = [cascade.passes(k, len(cascade.levels)) for k in batch.column(0).to_pylist()]
                yield batch.filter(pa.array(passed, pa.bool_()))

        other = universe.filter(F.col("listed") == F.lit(number % 2 == 1)).select("key")
        keys = materialize(other.mapInArrow(tidy(mistaken), "key string"), "mistaken")
        count = keys.count()
    return cascade


_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def host_and_path(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = re.search(r"[/?#]", rest)
    host = rest if end is None else rest[: end.start()]
    path = rest[len(host) :]
    end = re.search(r"[?#]", path)
    return host.translate(_LOWER), path if end is None else path[: end.start()]


def rule_keys(host: str, path: str, lengths: list[int], most: int) -> list[str]:
    """Candidate rules of a page: domains of at most ``most`` labels, from long to short, with path beginnings of ``lengths``."""
    if not host:
        return []
    labels = host.rsplit(".", most)[-most:] if host.count(".") >= most else host.split(".")
    domains = [".".join(labels[i:]) for i in range(len(labels))]
    starts = [path[:n] for n in lengths if len(path) >= n]
    return [d + p for d in domains if d for p in starts]


@dataclass
class UrlFilter:
    """Rules and cascades; ``judge`` needs no other table."""

    rules: dict[str, str]
    lengths: list[int]
    most: int
    fitting: Cascade
    hosts: Cascade

    def verdict(self, host: str, path: str) -> tuple[str | None, str]:
        fits = [k for k in rule_keys(host, path, self.lengths, self.most) if k in self.fitting]
        if fits:
            rule = min(fits, key=lambda r: (-len(r), r))
            return rule, self.rules[rule]
        return None, "block" if host and host in self.hosts else "allow"

    def judge(self, pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
        """(key, host, path, rule, verdict) for every row."""
        kind = pages.schema[key].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places = [host_and_path(u) for u in batch.column("url").to_pylist()]
                found = [self.verdict(*p) for p in places]
                columns = [*zip(*places, strict=True), *zip(*found, strict=True)] or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), *(pa.array(c, pa.string()) for c in columns)],
                    ["key", "host", "path", "rule", "verdict"],
                )

        rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
        out = rows.mapInArrow(tidy(run), f"key {kind}, host string, path string, rule string, verdict string")
        return out.withColumnRenamed("key", key)


def fit_url_filter(
    pages: DataFrame, allow: list[str], block: list[str], listed_hosts: DataFrame, url: str = "url"
) -> UrlFilter:
    """``allow`` and ``block`` hold rules like ``example.org/path``; ``listed_hosts`` has a column host."""
    rules = {**dict.fromkeys(allow, "allow"), **dict.fromkeys(block, "block")}
    if any("/" not in r for r in rules):
        raise ValueError("a rule is a host and a path that begins with /")
    lengths = sorted({len(r) - r.index("/") for r in rules})
    most = max((r[: r.index("/")].count(".") + 1 for r in rules), default=1)  # labels of the longest rule host

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[str, bool]] = set()
            for u in batch.column("url").to_pylist():
                host, path = host_and_path(u)
                found.update((k, False) for k in rule_keys(host, path, lengths, most))
                if host:
                    found.add((host, True))
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.string()), pa.array([h for _, h in rows], pa.bool_())],
                ["key", "is_host"],
            )

    urls = pages.select(F.col(url).cast("string").alias("url"))
    universe = materialize(urls.mapInArrow(tidy(keys), "key string, is_host boolean").distinct(), "keys")
    known = universe.filter("not is_host").select("key", F.col("key").isin(list(rules)).alias("listed"))
    listed = listed_hosts.select(F.col("host").alias("key"), F.lit(True).alias("listed")).distinct()
    hosts = universe.filter("is_host").select("key").join(listed, "key", "left")
    hosts = hosts.select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
    return UrlFilter(rules, lengths, most, build_cascade(known), build_cascade(hosts))


def hosts_with_words(pages: DataFrame, words: list[str], url: str = "url") -> DataFrame:
    """Distinct hosts of ``pages`` that have one of ``words`` between dots and hyphens."""
    host = F.regexp_extract(url, r"^.*?://([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pattern = rf"(^|[.-])({'|'.join(map(re.escape, words))})([.-]|$)"
    return pages.select(host.alias("host")).filter(F.col("host").rlike(pattern)).distinct()
