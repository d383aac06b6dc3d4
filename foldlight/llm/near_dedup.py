"""Near-duplicate components by fast similarity sketching, banding and exact checks.

A text's set holds the hashes of its distinct five-word shingles (A-Z folded; a
shorter text is one shingle). The sketch has ``bands * rows`` coordinates. In
round i every element is placed into one coordinate by the i-th hash function;
after as many rounds as coordinates, round i fills coordinate i with an element
of the whole set, so no coordinate stays empty. Earlier rounds win, so each
coordinate is a fair draw from the set and the share of equal coordinates is a
concentrated estimate of the Jaccard similarity.

Texts with equal sets form a class and only classes are compared. Classes
meeting in a band bucket are candidates. A bucket never lists its pairs: all
members are first compared with the one that meets most others over all its
buckets, which in a group of copies is the text they were made from. Buckets
that still hold different components go on. There, the differences of each class
from the leader bound from below how much two classes differ, and classes that
the bound keeps apart from all others leave the bucket. Of the rest a few lead,
in each round thirty-two times as many, until every member has led; members of one
component are not compared again. Candidates whose sketches
are too unlike are dropped (the margin is seven standard deviations), the rest is
checked on full sets.

With the defaults a link at the threshold is missed with probability 3e-8.

Null or wordless text: an empty set, linked with nothing. Null keys take part
and never become a component's id unless all its keys are null. Repeated rows
and equal texts share a component. An empty table gives an empty result. Other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlight.llm.graph import components, relabel
from foldlight.llm.words import Words, chunks, mix, tidy, windows, words
from foldlight.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
GROWTH = 32  # leaders of a bucket grow by this factor per round


def shingle_sets(w: Words) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes = w.hashes(lower=True)
    runs = windows(hashes, SHINGLE)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix(windows(hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of ``size`` coordinates per set; an empty set keeps the largest value."""
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    out = np.full(len(sets) * size, np.iinfo(np.uint64).max, np.uint64)
    counts = np.array([len(s) for s in sets], np.int64)
    live = counts > 0
    values = np.concatenate([np.empty(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets)), counts)
    for i in range(2 * size):
        if not live.any():
            break
        if i:
            keep = live[owner]
            values, owner = values[keep], owner[keep]
        h = mix(values ^ mix(np.array([i + 1], np.uint64)))
        place = ((h >> half) * np.uint64(size) >> half).astype(np.int64) if i < size else i - size
        np.minimum.at(out, owner * size + place, (np.uint64(i) << half) | (h & low))
        live &= (out.reshape(-1, size) == np.iinfo(np.uint64).max).any(axis=1)
    return out.reshape(-1, size)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sketch.reshape(-1, bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2])
    for j in range(rows):
        key = mix(key ^ parts[:, :, j])
    return key.view(np.int64)


def signature(sketch: np.ndarray) -> np.ndarray:
    """One byte per coordinate."""
    return (mix(sketch) & np.uint64(0xFF)).astype(np.uint8)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(r) for r in rows)])
    flat = np.concatenate([np.empty(0, np.uint64), *rows]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _digests(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                for c in ("sig_a", "sig_b")
            )
            equal = ((left == right).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            keep = pa.array(equal >= least)
            out = pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(equal)], ["a", "b", "likeness"]
            )
            yield out.filter(keep)

    return run


class NearDuplicates:
    """One run over ``docs``; ``result()`` has (key, n_shingles, component_id, kept)."""

    def __init__(
        self,
        docs: DataFrame,
        key: str = "doc_id",
        text: str = "text",
        percent: int = 85,
        bands: int = 30,
        rows: int = 5,
    ) -> None:
        self.percent, self.bands, self.rows = percent, bands, rows
        self.source, self.key, self.text = docs, key, text
        self.docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).select(
            "key", "text", self._rid(key="key", text="text").alias("rid")
        )
        self.kind = docs.schema[key].dataType.simpleString()
        j = percent / 100
        self.least = j - 7 * (j * (1 - j) / (bands * rows)) ** 0.5

    @staticmethod
    def _rid(key: str, text: str) -> Column:
        return F.xxhash64(F.col(key), F.xxhash64(F.col(text).cast("string")))

    def sketched(self) -> DataFrame:
        """One row per document: set size, digest of the set, band keys, signature."""
        bands, rows = self.bands, self.rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch):
                    sets = shingle_sets(words(part.column("text")))
                    sketch = sketches(sets, bands * rows)
                    keys = band_keys(sketch, bands, rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("key"),
                            part.column("rid"),
                            pa.array([len(s) for s in sets], pa.int64()),
                            _digests(sets),
                            pa.ListArray.from_arrays(
                                pa.array(np.arange(len(sets) + 1) * bands, pa.int32()),
                                pa.array(keys.ravel()),
                            ),
                            pa.array([s.tobytes() for s in signature(sketch)], pa.binary()),
                        ],
                        ["key", "rid", "n", "node", "bands", "sig"],
                    )

        return self.docs.mapInArrow(
            tidy(run), f"key {self.kind}, rid long, n long, node binary, bands array<long>, sig binary"
        )

    def _sets(self, rids: DataFrame) -> DataFrame:
        """(node, set) of one document of each class named by ``rids``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch):
                    sets = shingle_sets(words(part.column("text")))
                    yield pa.RecordBatch.from_arrays([_digests(sets), _lists(sets)], ["node", "set"])

        found = self.docs.select("rid", "text").join(rids, "rid", "left_semi")
        found = found.select("rid", F.xxhash64("text").alias("hash"), "text").dropDuplicates(["rid", "hash"])
        return found.select("text").mapInArrow(tidy(run), "node binary, set array<long>")

    def _likely(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Pairs (a, b) of classes whose sizes and sketches allow a link, with the estimate."""
        for end in ("a", "b"):
            side = classes.select(
                F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("sig").alias(f"sig_{end}")
            )
            pairs = pairs.join(side, end)
        small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
        pairs = pairs.filter(100 * small >= self.percent * large).select("a", "b", "sig_a", "sig_b")
        return pairs.mapInArrow(tidy(_likely(self.least)), "a binary, b binary, likeness double")

    def _linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs (a, b) that the full sets confirm."""
        left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
        right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
        both = F.size(F.array_intersect("set_a", "set_b"))
        union = F.size("set_a") + F.size("set_b") - both
        return (
            pairs.select("a", "b")
            .join(left, "a")
            .join(right, "b")
            .filter(100 * both >= self.percent * union)
            .select("a", "b")
        )

    def _resolve(self, pairs: DataFrame, sets: DataFrame, roots: DataFrame | None) -> DataFrame | None:
        """Components after checking the likely ``pairs`` that still join different roots.

        First each class is checked with its likeliest partner only; what the
        components found so far do not settle is then checked as well.
        """
        if pairs.isEmpty():
            return roots
        first = pairs.groupBy("b").agg(F.max_by("a", F.struct("likeness", "a")).alias("a"))
        sure = materialize(self._linked(first, sets), "links")
        roots = components(self._by_root(sure, roots), roots)
        rest = pairs.select("a", "b")
        if roots is not None:
            named = rest.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y"))
            rest = relabel(named, roots, "x", "y").select("a", "b")
        rest = materialize(rest.join(first.select("a", "b"), ["a", "b"], "left_anti"), "rest")
        if not rest.isEmpty():
            more = materialize(self._linked(rest, sets), "links")
            roots = components(self._by_root(more, roots), roots)
        return roots

    @staticmethod
    def _by_root(edges: DataFrame, roots: DataFrame | None) -> DataFrame:
        return edges if roots is None else materialize(relabel(edges, roots, "a", "b"), "edges")

    def result(self) -> DataFrame:
        """(key, n_shingles, component_id, kept) for every row."""
        return self._named(*self._solved())

    def survivors(self) -> DataFrame:
        """All columns of ``docs``: of each component the row with the smallest key, and every wordless row."""
        rows, classes, roots = self._solved()
        if roots is not None:
            classes = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        else:
            classes = classes.withColumn("root", F.col("node"))
        named = rows.join(classes.select("node", "root"), "node")
        order = F.struct(F.col("key").isNull(), "key", "rid")
        best = named.groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.rid").alias("_rid"))
        has_word = F.coalesce(F.col(self.text).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        found = self.source.filter(has_word).withColumn("_rid", self._rid(self.key, self.text))
        found = found.join(best, "_rid", "left_semi").dropDuplicates(["_rid"]).drop("_rid")
        return found.select(*self.source.columns).union(self.source.filter(~has_word))

    def _solved(self) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """Rows of all documents, the classes, and the roots of classes that are not their own root."""
        rows = materialize(self.sketched(), "sketches")
        classes = materialize(
            rows.filter("n > 0")
            .groupBy("node")
            .agg(
                F.min("key").alias("least"),
                F.min("rid").alias("rid"),
                F.first("n").alias("n"),
                F.first("bands").alias("bands"),
                F.first("sig").alias("sig"),
            ),
            "classes",
        )
        buckets = materialize(self._buckets(classes), "buckets")
        star = buckets.filter("node <> lead").select(
            F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")
        )
        tried = materialize(self._likely(star.distinct(), classes), "pairs")
        several = buckets.filter("m > 2")
        wanted = tried.select(F.explode(F.array("a", "b")).alias("node")).union(several.select("node"))
        sets = materialize(self._sets(classes.join(wanted, "node", "left_semi").select("rid")), "sets")
        roots = self._resolve(tried, sets, None)
        open_rows = self._unresolved(several, roots)
        if not open_rows.isEmpty():
            open_rows = self._able(open_rows, sets)
        leaders, before = GROWTH, 0
        while not open_rows.isEmpty():
            pairs = self._led(open_rows, leaders, before).join(tried, ["a", "b"], "left_anti")
            pairs = materialize(self._likely(pairs, classes), "pairs")
            roots = self._resolve(pairs, sets, roots)
            tried = tried.unionByName(pairs)
            open_rows = self._unresolved(open_rows.filter(F.col("m") > leaders).drop("root"), roots)
            leaders, before = leaders * GROWTH, leaders
        return rows, classes, roots

    @staticmethod
    def _buckets(classes: DataFrame) -> DataFrame:
        """Rows (bucket, node, m, lead) of buckets with m > 1 classes."""
        member = classes.select("node", F.explode("bands").alias("bucket"))
        shared = member.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1")
        rows = materialize(member.join(shared, "bucket"), "shared")
        meets = rows.groupBy("node").agg(F.sum("m").alias("meets"))
        lead = rows.join(meets, "node").groupBy("bucket").agg(F.max(F.struct("meets", "node")).alias("top"))
        return rows.join(lead.select("bucket", F.col("top.node").alias("lead")), "bucket")

    @staticmethod
    def _unresolved(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
        """``rows`` (bucket, node, ...) with their roots, of the buckets that hold several."""
        if roots is not None:
            rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        else:
            rows = rows.withColumn("root", F.col("node"))
        mixed = (
            rows.groupBy("bucket")
            .agg(F.min("root").alias("low"), F.max("root").alias("high"))
            .filter("low < high")
            .select("bucket")
        )
        return materialize(rows.join(mixed, "bucket", "left_semi"), "open")

    def _able(self, rows: DataFrame, sets: DataFrame) -> DataFrame:
        """``rows`` that may still have a partner, with n, d and s.

        d is the number of shingles in which a class differs from the bucket's leader, s
        those of them in which another class differs as well. Two classes differ in
        d + d' less twice the shared ones, so in d + d' - 2 min(s, s') at least. Classes
        of a bucket that agree in n, d and s are judged together, so copies of the
        leader with changes of their own leave without being paired.
        """
        ends = rows.select("node", "lead").distinct()
        left = sets.select("node", F.col("set").alias("own"))
        right = sets.select(F.col("node").alias("lead"), F.col("set").alias("other"))
        both = ends.join(left, "node").join(right, "lead")
        change = F.array_union(F.array_except("own", "other"), F.array_except("other", "own"))
        sizes = both.select("node", "lead", F.size("own").cast("long").alias("n"), change.alias("change"))
        sizes = materialize(sizes, "changes")
        alone = (
            sizes.select("node", "lead", F.explode("change").alias("shingle"))
            .groupBy("lead", "shingle")
            .agg(F.min("node").alias("node"), F.count("*").alias("holders"))
            .filter("holders = 1")
            .groupBy("lead", "node")
            .agg(F.count("*").alias("alone"))
        )
        sizes = sizes.select("node", "lead", "n", F.size("change").cast("long").alias("d"))
        sizes = sizes.join(alone, ["node", "lead"], "left").withColumn(
            "s", F.col("d") - F.coalesce("alone", F.lit(0))
        )
        rows = rows.join(sizes.drop("alone"), ["node", "lead"])
        rows = materialize(rows, "differences")
        most = rows.groupBy("bucket", "root").agg(F.count("*").alias("members"))
        most = most.groupBy("bucket").agg(F.max_by("root", F.struct("members", "root")).alias("most"))
        rows = rows.join(most, "bucket").withColumn("home", F.col("root") == F.col("most")).drop("most")
        kind = ("n", "d", "s", "home")
        kinds = rows.select("bucket", *kind).distinct()
        able = kinds.alias("x").join(
            kinds.alias("y"),
            (F.col("x.bucket") == F.col("y.bucket"))
            & ~(F.col("x.home") & F.col("y.home"))
            & self._possible(*(F.col(f"{e}.{c}") for e in "xy" for c in ("n", "d", "s"))),
            "left_semi",
        )
        rows = rows.join(able, ["bucket", *kind], "left_semi").drop("m")
        left = rows.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1")
        return materialize(rows.join(left, "bucket").drop("home"), "able")

    def _possible(self, *of: Column) -> Column:
        """Whether classes with (n, d, s) and (n', d', s') can reach the threshold."""
        n, d, s, n2, d2, s2 = of
        differ = d + d2 - 2 * F.least(s, s2)
        return (100 + self.percent) * differ <= (100 - self.percent) * (n + n2)

    def _led(self, rows: DataFrame, leaders: int, before: int) -> DataFrame:
        """Pairs of this round's leaders with members of other components, each once.

        A member leads when its hash in the bucket falls below leaders / m, so about
        ``leaders`` members lead, and all of them once ``leaders`` reaches m. A pair is
        formed in the first open bucket that both share; that one stays open until
        all its members have led or are one component.
        """
        own = rows.groupBy("node").agg(F.collect_set("bucket").alias("buckets"))
        draw = F.pmod(F.xxhash64("node", "bucket"), F.lit(1 << 40)) / float(1 << 40) * F.col("m")
        rows = rows.join(own, "node").withColumn("draw", draw)
        leads = ((F.col("draw") < leaders) | (F.col("m") <= leaders)) & (F.col("draw") >= before)
        rows = rows.withColumn("leads", leads)
        names = ("node", "root", "n", "d", "s", "buckets", "leads")
        left = rows.filter("leads").select("bucket", *(F.col(c).alias(f"{c}_x") for c in names))
        right = rows.select("bucket", *(F.col(c).alias(f"{c}_y") for c in names))
        possible = self._possible(*(F.col(f"{c}_{e}") for e in "xy" for c in ("n", "d", "s")))
        once = ~F.col("leads_y") | (F.col("node_x") < F.col("node_y"))
        first = F.col("bucket") == F.array_min(F.array_intersect("buckets_x", "buckets_y"))
        found = left.join(right, on=["bucket"]).filter((F.col("root_x") != F.col("root_y")) & possible & once)
        found = found.filter(first)
        return found.select(
            F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")
        ).distinct()

    def _named(self, rows: DataFrame, classes: DataFrame, roots: DataFrame | None) -> DataFrame:
        named = classes.select("node", "least")
        if roots is not None:
            named = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            least = named.groupBy("root").agg(F.min("least").alias("component_id"))
            named = named.select("node", "root").join(least, "root")
        else:
            named = named.withColumnRenamed("least", "component_id")
        out = rows.select("key", "n", "node").join(named.select("node", "component_id"), "node", "left")
        component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
        return out.select(
            F.col("key").alias(self.key),
            F.col("n").alias("n_shingles"),
            component.alias("component_id"),
            F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"),
        )


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``docs``."""
    return NearDuplicates(docs, **options).result()
