"""Online two-group significance test on Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as P
from pyspark.sql.streaming import StreamingQuery

from foldlight.operators.reshape import significant
from foldlight.operators.stats import welch_from_moments
from foldlight.session import scratch_path

MOMENTS = "label boolean, n long, mean double, m2 double"
RESULTS = (
    "batch_id long, n0 double, mean0 double, var0 double, n1 double, mean1 double, var1 double, "
    "t double, degrees double, p_value double"
)


def batch_moments(samples: DataFrame) -> DataFrame:
    """Count, mean and sum of squared deviations of each group in one batch.

    One aggregate without keys: each task sends one row, whatever the partition setting.
    """
    groups = {False: ~P.col("label"), True: P.col("label")}
    aggregates = []
    for flag, member in groups.items():
        v = P.when(member, P.col("value"))
        aggregates.append(
            P.struct(
                P.lit(flag).alias("label"),
                P.count(v).alias("n"),
                P.avg(v).alias("mean"),
                (P.var_pop(v) * P.count(v)).alias("m2"),
            )
        )
    both = samples.dropna().agg(P.array(*aggregates).alias("groups"))
    return both.select(P.inline("groups")).filter("n > 0")


def merge_moments(moments: DataFrame) -> DataFrame:
    """One row per group from the moments of a few batches.

    The between-batch part is taken around the common mean of the group, which
    keeps precision for large values.
    """
    # two rows per batch of the window
    groups = moments.coalesce(1).groupBy("label").agg(
        P.sum("n").alias("n"),
        (P.sum(P.col("n") * P.col("mean")) / P.sum("n")).alias("mean"),
        P.sum("m2").alias("within"),
        P.collect_list(P.struct("n", "mean")).alias("parts"),
    )
    between = P.aggregate(
        "parts",
        P.lit(0.0),
        lambda s, p: s + p["n"] * (p["mean"] - P.col("mean")) * (p["mean"] - P.col("mean")),
    )
    return groups.select("label", "n", "mean", (P.col("within") + between).alias("m2"))


def moments_row(groups: DataFrame) -> DataFrame:
    """The two groups side by side: n0, mean0, var0, n1, mean1, var1."""
    spread = groups.select(
        "label",
        P.col("n").cast("double").alias("n"),
        "mean",
        P.when(P.col("n") > 1, P.col("m2") / (P.col("n") - 1)).alias("var"),
    )
    sides = {"0": ~P.col("label"), "1": P.col("label")}
    return spread.agg(
        *[
            P.max(P.when(member, P.col(c))).alias(f"{c}{g}")
            for g, member in sides.items()
            for c in ("n", "mean", "var")
        ]
    )


@dataclass
class WelchStream:
    """A running test: the query, where its results are, and the batch counter."""

    query: StreamingQuery
    folder: str
    progress: dict = field(default_factory=dict)

    def results(self, spark: SparkSession) -> DataFrame:
        """One row per batch that had two or more values in each group of its window."""
        return spark.read.schema(RESULTS).parquet(f"{self.folder}/results/*")


def streaming_welch(
    stream: DataFrame,
    peace_period: int = 0,
    window_size: int = 0,
    folder: str | None = None,
    trigger: dict | None = None,
    on_result: Callable[[int, DataFrame | None], bool | None] | None = None,
) -> WelchStream:
    """A Welch test after each batch of a (label, value) stream.

    The first ``peace_period`` batches are ignored. Each test covers the last
    ``window_size`` batches, or all so far for 0. Every batch writes two moment
    rows and its result under its own batch id, replacing what an earlier attempt at
    the same batch left, so a restart from the checkpoint repeats nothing.
    ``trigger`` goes to ``writeStream.trigger``; the default takes what is there
    and stops. ``on_result`` is called after every batch, with None for an ignored
    one; once it returns true, later batches are neither tested nor written.
    """
    spark = stream.sparkSession
    folder = folder or scratch_path(spark, "welch")
    progress: dict = {"batches": 0, "stopped": False}
    # so that the results can be read before the first batch has one
    spark.createDataFrame([], RESULTS).write.mode("ignore").parquet(f"{folder}/results/none")

    def keep(df: DataFrame, kind: str, batch_id: int) -> None:
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{kind}/b{batch_id}")

    def handle(samples: DataFrame, batch_id: int) -> None:
        if progress["stopped"]:
            return
        session = samples.sparkSession
        progress["batches"] = batch_id + 1
        if batch_id < peace_period:
            if on_result is not None:
                progress["stopped"] = bool(on_result(batch_id, None))
            return

        def stored(kind: str, first: int, last: int) -> DataFrame:
            paths = [f"{folder}/{kind}/b{b}" for b in range(max(first, peace_period), last + 1)]
            return session.read.schema(MOMENTS).parquet(*paths)

        if window_size:
            keep(batch_moments(samples), "moments", batch_id)
            groups = merge_moments(stored("moments", batch_id - window_size + 1, batch_id))
        else:
            # all so far = all before (one small table) + this batch
            groups = batch_moments(samples)
            if batch_id > peace_period:
                groups = merge_moments(groups.unionAll(stored("so_far", batch_id - 1, batch_id - 1)))
            keep(groups, "so_far", batch_id)
            groups = stored("so_far", batch_id, batch_id)
        tested = welch_from_moments(moments_row(groups).filter("n0 > 1 and n1 > 1"))
        keep(
            tested.select(P.lit(batch_id).cast("long").alias("batch_id"), "*"), "results", batch_id
        )
        target = f"{folder}/results/b{batch_id}"
        if on_result is not None:
            result = session.read.schema(RESULTS).parquet(target)
            progress["stopped"] = bool(on_result(batch_id, result))

    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    return WelchStream(query, folder, progress)


def stop_when_significant(
    start: Callable[[Callable[[int, DataFrame | None], bool]], WelchStream],
    alpha: float = 0.05,
    max_batches: int | None = None,
    poll_seconds: float = 0.1,
) -> tuple[WelchStream, str]:
    """Run a test until p < alpha, the batch limit is used up or the input ends.

    ``start`` gets the callback to pass on as ``on_result`` and returns the
    running stream. Every batch counts, ignored ones too. Batches after the deciding
    one leave no result.
    """
    found = {"reason": ""}
    seen = {"batches": 0}

    def watch(batch_id: int, result: DataFrame | None) -> bool:
        seen["batches"] += 1
        if result is not None and not significant(result, alpha).isEmpty():
            found["reason"] = "significant"
        elif max_batches is not None and seen["batches"] >= max_batches:
            found["reason"] = "batches"
        return bool(found["reason"])

    running = start(watch)
    while running.query.isActive and not found["reason"]:
        time.sleep(poll_seconds)
    if running.query.isActive:
        running.query.stop()
    running.query.awaitTermination()
    if running.query.exception() is not None:
        raise running.query.exception()
    return running, found["reason"] or "input ended"
