"""Quality scores from two zstandard dictionaries.

One dictionary is built from pieces of good, one from pieces of bad labelled
texts, without the lines that both kinds share. A text is cut into pieces, each is compressed with both dictionaries, and
the sizes are added up. The difference over the sum says which dictionary fits
better; a logistic curve over it and the compression rate (text that only
repeats itself fits both) turns it into a score from 0 to 1.

Fitting reads a bounded sample: per label the ``sample_rows`` rows with the
smallest hash of their key, and of these the ``sample_pieces`` pieces with the
smallest hash. The curve weighs the sampled rows as the labels are spread.
Scoring reads whole texts and needs no shuffle; the model is two dictionaries of
``dictionary_bytes`` and five numbers.

Null text is scored as empty. Labels other than 0 and 1 and labels without a
document are not used; where a label has no rows at all every score is the share
of label 1 (0.5 without labels). Repeated rows get equal scores. An empty table
gives an empty result. Only key and text are read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlight.llm.words import kept, tidy
from foldlight.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = 1000  # bytes compressed at once


def pieces(data: bytes) -> list[bytes]:
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)] or [b""]


def build_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 4)), samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    ready = zstandard.ZstdCompressionDict(dictionary)
    ready.precompute_compress(level=3)
    return zstandard.ZstdCompressor(
        level=3, dict_data=ready, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def sizes(data: bytes, dictionaries: tuple[bytes, bytes]) -> tuple[int, int]:
    """Compressed size by the (bad, good) dictionary."""
    parts = pieces(data)
    bad, good = (kept(f"zstd {hash(d)}", lambda d=d: _compressor(d)) for d in dictionaries)
    return sum(len(bad.compress(p)) for p in parts), sum(len(good.compress(p)) for p in parts)


def features(bad: np.ndarray, good: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Normalised difference, and three terms of the compression rate."""
    total = bad + good
    rate = np.clip(total / 2 / np.maximum(n_bytes, 1), 1e-3, 2)
    return np.column_stack([(bad - good) / total, rate, rate * rate, np.log(rate)])


def fit_logistic(
    x: np.ndarray, y: np.ndarray, each: np.ndarray | float = 1.0, ridge: float = 0.1
) -> np.ndarray:
    """Newton steps on standardised columns; weights for the plain columns, intercept first.

    ``each`` weighs the rows.
    """
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    penalty = ridge * np.eye(a.shape[1])
    penalty[0, 0] = 1e-6
    w = np.zeros(a.shape[1])

    def loss(w: np.ndarray) -> float:
        line = a @ w
        return float((each * (np.logaddexp(0, line) - y * line)).sum() + w @ penalty @ w / 2)

    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        curve = (a.T * (p * (1 - p) * each)) @ a + penalty
        step = np.linalg.solve(curve, a.T @ ((y - p) * each) - penalty @ w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        after = loss(w + size * step)
        if now - after <= 1e-10 * (1 + abs(now)):
            break
        w, now = w + size * step, after
    plain = w[1:] / scale
    return np.concatenate([[w[0] - plain @ mean], plain])


@dataclass
class QualityModel:
    dictionaries: tuple[bytes, bytes] | None
    weights: np.ndarray

    def _sizes(self, docs: DataFrame, *carry: str) -> DataFrame:
        """``docs`` (text, carried columns) as carried columns, n_bytes, bad, good, score."""
        dictionaries, weights = self.dictionaries, self.weights
        names = [*carry, "n_bytes", "bad", "good", "score"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score, found = _scores(_bytes(batch.column("text")), dictionaries, weights)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in carry),
                        *map(pa.array, (*found.T.copy(), score)),
                    ],
                    names=names,
                )

        schema = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in carry)
        return docs.select(*carry, "text").mapInArrow(
            tidy(run), schema + "n_bytes long, bad long, good long, score double"
        )

    def score(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, n_bytes, bad, good, score) for every row."""
        rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        if self.dictionaries is None:
            size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
            none = F.lit(None).cast("long")
            out = rows.select(
                "key",
                size.alias("n_bytes"),
                none.alias("bad"),
                none.alias("good"),
                F.lit(float(self.weights[0])).alias("score"),
            )
        else:
            out = self._sizes(rows, "key")
        return out.withColumnRenamed("key", key)


    def accepted(self, docs: DataFrame, least: float = 0.7, text: str = "text") -> DataFrame:
        """The rows of ``docs``, all columns, whose score is at least ``least``."""
        if self.dictionaries is None:
            return docs if self.weights[0] >= least else docs.filter(F.lit(False))
        dictionaries, weights, at = self.dictionaries, self.weights, docs.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data = _bytes(batch.column(at))
                score, _ = _scores(data, dictionaries, weights)
                yield batch.filter(pa.array(score >= least))

        return docs.mapInArrow(tidy(run), docs.schema)


def _bytes(texts: pa.Array) -> list[bytes]:
    return pc.fill_null(texts.cast(pa.string()), "").cast(pa.binary()).to_pylist()


def _scores(
    data: list[bytes], dictionaries: tuple[bytes, bytes], weights: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Scores, and rows of bytes, size by the bad and size by the good dictionary."""
    both = np.array([sizes(d, dictionaries) for d in data], np.int64).reshape(-1, 2)
    n = np.array([len(d) for d in data], np.int64)
    line = weights[0] + features(both[:, 0], both[:, 1], n) @ weights[1:]
    return 1 / (1 + np.exp(-np.clip(line, -30, 30))), np.column_stack([n, both])


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the key as text leaves 2 when divided by 4."""
    rest = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4))
    return F.coalesce(rest == 2, F.lit(False))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_rows: int = 8000,
    sample_pieces: int = 4000,
    dictionary_bytes: int = 110_000,
) -> QualityModel:
    """Fit on labelled rows that are not held out; ``labels`` has the key and ``label`` 0 or 1."""
    usable = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key))
    usable = usable.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).distinct()
    drawn = [
        usable.filter(F.col("label") == v).orderBy(F.xxhash64("key"), "key").limit(sample_rows)
        for v in (0, 1)
    ]
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # at most 2 * sample_rows keys are broadcast
    copies = rows.join(F.broadcast(drawn[0].union(drawn[1])), "key")
    # a key may stand in many rows: one text of each, so that the sample stays as small as it is said to be
    sample = materialize(copies.groupBy("key", "label").agg(F.min("text").alias("text")), "labelled")
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = next(iter(counts), 0.5)
        return QualityModel(None, np.array([float(share)]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, v, t in zip(*(batch.column(c).to_pylist() for c in ("key", "label", "text")), strict=True):
                parts = pieces(t.encode())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k] * len(parts), batch.schema.field("key").type),
                        pa.array([v] * len(parts), pa.int32()),
                        pa.array(range(len(parts)), pa.int32()),
                        pa.array(parts, pa.binary()),
                    ],
                    names=["key", "label", "number", "piece"],
                )

    kind = sample.schema["key"].dataType.simpleString()
    lines = sample.select("key", "label", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    shared = lines.groupBy("line").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    own = lines.join(shared.filter("low < high"), "line", "left_anti").groupBy("key", "label")
    own = own.agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("lines"))
    own = own.select("key", "label", F.concat_ws("\n", F.col("lines.line")).alias("text"))
    parts = own.mapInArrow(tidy(cut), f"key {kind}, label int, number int, piece binary")
    dictionaries = []
    for v in (0, 1):
        order = (F.xxhash64("key", "number"), "key", "number", "piece")
        chosen = parts.filter(F.col("label") == v).orderBy(*order).limit(sample_pieces)
        dictionaries.append(
            build_dictionary([bytes(r.piece) for r in chosen.select("piece").collect()], dictionary_bytes)
        )
    model = QualityModel((dictionaries[0], dictionaries[1]), np.zeros(5))
    found = model._sizes(sample, "label").select("label", "bad", "good", "n_bytes").toPandas()
    found = found.sort_values(list(found.columns)).to_numpy(float)
    x = features(found[:, 1], found[:, 2], found[:, 3])
    spread = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    each = np.where(found[:, 0] == 1, spread[1] / counts[1], spread[0] / counts[0])
    model.weights = fit_logistic(x, found[:, 0], each)
    return model
