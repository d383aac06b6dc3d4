"""Text sources with explicit schemas.

Every reader is a text scan plus column expressions, so files keep their
splits. ``mode="fail"`` (the default) stops on a field that is not a number,
``mode="drop"`` leaves such lines out.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as P

FAIL, DROP = "fail", "drop"


def _numbers(texts: Column, mode: str) -> Column:
    if mode not in (FAIL, DROP):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == FAIL:
        return P.transform(texts, lambda t: t.cast("double"))
    return P.transform(texts, lambda t: t.try_cast("double"))


def _keep_parsed(df: DataFrame, mode: str, *arrays: str) -> DataFrame:
    if mode == DROP:
        for a in arrays:
            df = df.filter(~P.exists(a, lambda x: x.isNull()))
    return df


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(P.trim("value") != "")


def read_class_features(
    spark: SparkSession, path: str, mode: str = FAIL, fields: int | None = None
) -> DataFrame:
    """CSV of label and features; every line that starts with ``ClassId`` is dropped.

    Every line must have ``fields`` numbers, as many as the first one if not given;
    other lines are errors, or dropped by ``mode``.
    """
    rows = _lines(spark, path).filter(~P.col("value").startswith("ClassId"))
    if fields is None:
        first = rows.first()
        fields = first["value"].count(",") + 1 if first else 1
    numbers = rows.select(_numbers(P.split("value", ","), mode).alias("_all"))
    whole = P.size("_all") == fields
    if mode == DROP:
        numbers = numbers.filter(whole)
    else:
        text = P.concat(P.lit(f"a line has not {fields} fields but "), P.size("_all").cast("string"))
        numbers = numbers.select(P.when(whole, P.col("_all")).otherwise(P.raise_error(text)).alias("_all"))
    return _keep_parsed(numbers, mode, "_all").select(
        P.col("_all")[0].alias("label"),
        P.slice("_all", P.lit(2), P.size("_all") - 1).alias("features"),
    )


def read_feature_vectors(spark: SparkSession, path: str, mode: str = FAIL) -> DataFrame:
    """The features of S1 without the label."""
    return read_class_features(spark, path, mode).select("features")


def read_libsvm(
    spark: SparkSession, path: str, num_features: int | None = None, dense: bool = False
) -> DataFrame:
    """S3: ``label index:value ...`` with indices from 1. S4: ``dense`` gives arrays."""
    reader = spark.read.format("libsvm")
    if num_features is not None:
        reader = reader.option("numFeatures", str(num_features))
    rows = reader.load(path)
    return rows.withColumn("features", vector_to_array("features")) if dense else rows


def read_number_rows(spark: SparkSession, path: str, mode: str = FAIL) -> DataFrame:
    """Numbers split by one space."""
    rows = _lines(spark, path).select(
        _numbers(P.split(P.trim("value"), " "), mode).alias("features")
    )
    return _keep_parsed(rows, mode, "features")


def read_label_comma_numbers(spark: SparkSession, path: str, mode: str = FAIL) -> DataFrame:
    """``label,f1 f2 ...`` with all features."""
    sides = P.split("value", ",", 2)
    rest = P.get(sides, 1) if mode == DROP else sides[1]  # a line without a comma is an error or dropped
    rows = _lines(spark, path).select(
        _numbers(P.array(sides[0]), mode).alias("_label"),
        _numbers(P.split(P.trim(rest), " "), mode).alias("features"),
    )
    if mode == DROP:
        rows = rows.filter(P.col("features").isNotNull())
    return _keep_parsed(rows, mode, "_label", "features").select(
        P.col("_label")[0].alias("label"), "features"
    )


def read_ratings(
    spark: SparkSession, path: str, sep: str = ",", mode: str = FAIL
) -> DataFrame:
    """``user SEP item SEP rating``; further fields are ignored."""
    fields = P.split("value", rf"\Q{sep}\E")
    numbers = _lines(spark, path).select(_numbers(P.slice(fields, 1, 3), mode).alias("_all"))
    if mode == DROP:
        whole = P.col("_all")
        ids = [P.get(whole, P.lit(i)).try_cast("int") for i in (0, 1)]
        numbers = numbers.filter((P.size(whole) == 3) & ids[0].isNotNull() & ids[1].isNotNull())
    return _keep_parsed(numbers, mode, "_all").select(
        P.col("_all")[0].cast("int").alias("user"),
        P.col("_all")[1].cast("int").alias("item"),
        P.col("_all")[2].alias("rating"),
    )


def read_baskets(spark: SparkSession, path: str) -> DataFrame:
    """Items split by one space, order kept."""
    return _lines(spark, path).select(P.split("value", " ").alias("items"))



def stream_samples(
    spark: SparkSession, folder: str, files_per_batch: int | None = None
) -> DataFrame:
    """Stream of new ``label,value`` text files as (label boolean, value double)."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    fields = P.split("value", ",")
    return reader.text(folder).select(
        (P.lower(fields[0]) == "true").alias("label"), P.trim(fields[1]).cast("double").alias("value")
    )


def rows(spark: SparkSession, values, schema: str, partitions: int | None = None) -> DataFrame:
    """In-memory rows for tests and literals."""
    df = spark.createDataFrame(values, schema)
    return df.repartition(partitions) if partitions else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
