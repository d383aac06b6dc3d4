"""From raw documents to packed training sequences.

Each stage takes the documents that the one before kept and returns the columns
of documents, the last one the places of token pieces in sequences. The result of
every stage is written to the shared scratch folder and read again, so a lost
executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlight.llm.near_dedup import NearDuplicates
from foldlight.llm.packing import pack, token_pieces
from foldlight.llm.pii import fit_spans
from foldlight.llm.quality import fit_quality
from foldlight.llm.substring_dedup import remove_repeats
from foldlight.session import materialize

ORACLE_SQL = None


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the present text; null text keeps what it had."""
    length = F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return docs.withColumn("n_chars", length)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.7 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit_quality(docs, labels).accepted(docs, 0.7)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 80 % of their five-word shingles; wordless ones are no group."""
    return NearDuplicates(docs, percent=80).survivors()


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated windows of 35 words; a text left without a word goes, others are untouched."""
    cleaned = remove_repeats(docs, carry=tuple(c for c in docs.columns if c != "doc_id"))
    left = cleaned.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return _with_length(left.withColumn("text", text).select(*docs.columns))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return _with_length(fit_spans(docs).redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of at most 2048 tokens."""
    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")), 2048, carry=("start", "ids_crc32"))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("pii", pii),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
