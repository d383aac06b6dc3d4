"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_private: dict[str, str] = {}  # application id -> folder, for local masters only
_scopes: list[list[str]] = []  # open scopes of scratch_scope


def local_session(cores: str | int = "*", app: str = "foldlight", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "12g"),
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset a private folder is made, but only for a local master:
    on a cluster a driver-local path cannot be read by the executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _private:
        _private[sc.applicationId] = tempfile.mkdtemp(prefix="foldlight-", dir="/tmp")
    return _private[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the scratch folder."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Remove at the end what was written to the scratch folder inside.

    Results are read lazily from these folders: write or collect them before the scope ends.
    """
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield paths
    finally:
        _scopes[:] = [s for s in _scopes if s is not paths]
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def enable_checkpoints(spark: SparkSession) -> None:
    """Let iterative estimators (factors, topics, boosting) cut their lineage."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch_dir(spark))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    Cuts the lineage, freezes partition-dependent columns and survives the
    loss of executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int = 250_000) -> DataFrame:
    """``df`` dealt evenly into parts of about ``rows`` rows where it has more, so that what a pass over a
    part reads does not grow with the table."""
    size = df.count()
    return df if size <= rows else df.repartition(-(-size // rows))
