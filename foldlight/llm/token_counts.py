"""Token counts of whole texts: Arrow batches in, lengths out.

Texts are gathered into batches of about ``batch_bytes`` each, so one call of the
tokenizer has the same work whatever the text lengths are. A text above
``split_chars`` is cut at safe boundaries: places where no match of the
tokenizer's split pattern can span, so the counts of the parts add up to the
count of the whole. Only lengths leave the function; there is no shuffle.

Null text counts as empty (0 bytes, 0 tokens). Ties and repeated rows are
counted row by row; an empty table gives an empty result; other columns are
not read, so their names cannot clash.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlight.llm.encoders import encoder, splits_at_spaces
from foldlight.llm.words import tidy

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# White space after a visible character starts a new match; so does a change between
# letters and digits, and a letter after ideographic punctuation.
SAFE = (
    r"(?<=[!-~])(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
    r"|(?<=[、。，])(?=[一-鿿])"
)


def safe_parts(text: str, limit: int) -> list[str]:
    """``text`` cut at the first safe boundary at or after each ``limit`` characters."""
    if len(text) <= limit:
        return [text]
    safe, parts, at = re.compile(SAFE), [], 0
    while len(text) - at > limit:
        cut = safe.search(text, at + limit)
        if cut is None:
            break
        parts.append(text[at : cut.start()])
        at = cut.start()
    return [*parts, text[at:]]


def _lengths(texts: list[str], path: str, batch_bytes: int, split_chars: int) -> np.ndarray:
    encode = encoder(path)
    split = split_chars if splits_at_spaces(path) else sys.maxsize
    counts = np.zeros(len(texts), np.int64)
    batch: list[str] = []
    owners: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        for part in safe_parts(text, split):
            batch.append(part)
            owners.append(i)
            size += len(part) if part.isascii() else len(part.encode())
            if size >= batch_bytes:
                np.add.at(counts, owners, [len(x) for x in encode(batch)])
                batch, owners, size = [], [], 0
    if batch:
        np.add.at(counts, owners, [len(x) for x in encode(batch)])
    return counts


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    batch_bytes: int = 1 << 20,
    split_chars: int = 1 << 16,
) -> DataFrame:
    """(key, n_bytes, n_tokens) for every row; ``tokenizer`` is a file that every executor has.

    Files with other split rules than plain byte-level BPE are given whole texts.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            counts = _lengths(texts.to_pylist(), tokenizer, batch_bytes, split_chars)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast("int64"), pa.array(counts)],
                ["key", "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"key {kind}, n_bytes long, n_tokens long").withColumnRenamed(
        "key", key
    )
