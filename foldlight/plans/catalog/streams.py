"""Streaming test over the events, fed as text files."""

from __future__ import annotations

from pyspark.sql import functions as P

from foldlight.plans.catalog.registry import query, rounded
from foldlight.plans.catalog.statistics import (
    SQL_DEGREES,
    SQL_T,
    SQL_WELCH,
    sql_t_p,
    welch_columns,
)
from foldlight.session import scratch_path
from foldlight.sources.readers import stream_samples, table
from foldlight.streaming import welch

BATCHES = 6


def file_count(spark):
    """One file per shuffle partition, so that the writing scales with the cluster."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sample_stream(spark, folder):
    """The events as a stream of ``BATCHES`` batches: batch i has the ids that leave i.

    The files of a batch are written before those of the next one, all batches have
    the same number of files, and the source takes files by age.
    """
    path = scratch_path(spark, "batches")
    per_batch = -(-file_count(spark) // BATCHES)
    for i in range(BATCHES):
        lines = sample_lines(spark, folder, P.col("event_id") % BATCHES == i)
        lines.repartition(per_batch).write.mode("append").text(path)
    return stream_samples(spark, path, files_per_batch=per_batch)


def sample_lines(spark, folder, keep=None):
    """events as ``label, value`` lines."""
    events = table(spark, folder, "events")
    if keep is not None:
        events = events.filter(keep)
    line = P.concat_ws(
        ", ", (P.col("event_type") == "purchase").cast("string"), P.col("value").cast("string")
    )
    return events.select(line.alias("value"))


def sample_files(spark, folder, name="samples", keep=None):
    """events as text files in a new folder."""
    path = scratch_path(spark, name)
    sample_lines(spark, folder, keep).repartition(file_count(spark)).write.text(path)
    return path


@query(
    "s9_stream_samples",
    """SELECT event_type = 'purchase' AS label, count(*) AS n, round(sum(value), 4) AS total
    FROM events GROUP BY 1""",
)
def s9_stream_samples(spark, folder):
    samples = stream_samples(spark, sample_files(spark, folder))
    path = scratch_path(spark, "sums")

    def keep(batch, batch_id):
        batch.groupBy("label").agg(
            P.count(P.lit(1)).alias("n"), P.sum("value").alias("total")
        ).write.mode("overwrite").parquet(f"{path}/sums/b{batch_id}")

    query_ = (
        samples.writeStream.foreachBatch(keep)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query_.awaitTermination()
    sums = spark.read.schema("label boolean, n long, total double").parquet(f"{path}/sums/*")
    return sums.groupBy("label").agg(
        P.sum("n").alias("n"), P.round(P.sum("total"), 4).alias("total")
    )


def last_row(results):
    return results.orderBy(P.desc("batch_id")).limit(1)


@query("w1_streaming_welch", f"WITH {SQL_WELCH}")
def w1_streaming_welch(spark, folder):
    """The test after the last batch covers all rows."""
    stream = sample_stream(spark, folder)
    running = welch.streaming_welch(stream)
    running.query.awaitTermination()
    return welch_columns(last_row(running.results(spark)))


def sql_batch_tests(first: str, last: int) -> str:
    """Tests after each of the batches 0 .. ``last`` over the batches ``first`` .. b."""
    return f"""
    spans AS (SELECT b AS batch_id, {first} AS low FROM range(0, {last + 1}) t(b)),
    m AS (SELECT batch_id, count(*) FILTER (event_type <> 'purchase')::DOUBLE AS n0,
        avg(value) FILTER (event_type <> 'purchase') AS mean0,
        var_samp(value) FILTER (event_type <> 'purchase') AS var0,
        count(*) FILTER (event_type = 'purchase')::DOUBLE AS n1,
        avg(value) FILTER (event_type = 'purchase') AS mean1,
        var_samp(value) FILTER (event_type = 'purchase') AS var1
      FROM spans JOIN events ON event_id % {BATCHES} BETWEEN low AND batch_id GROUP BY batch_id),
    w AS (SELECT *, {SQL_T} AS t, {SQL_DEGREES} AS degrees FROM m),
    tests AS (SELECT *, {sql_t_p('t', 'degrees')} AS p_value FROM w)"""


@query(
    "w1_streaming_welch_window",
    f"""WITH {sql_batch_tests('greatest(1, b - 1)', BATCHES - 1)}
    SELECT CAST(batch_id AS BIGINT) AS batch_id, n0, n1, round(t, 6) + 0.0 AS t,
      round(degrees, 4) AS degrees, round(p_value, 6) AS p_value FROM tests WHERE batch_id >= 1""",
)
def w1_streaming_welch_window(spark, folder):
    """One batch ignored, then tests over the last two batches."""
    stream = sample_stream(spark, folder)
    running = welch.streaming_welch(stream, peace_period=1, window_size=2)
    running.query.awaitTermination()
    return running.results(spark).select(
        "batch_id", "n0", "n1", *rounded(6, "t"), *rounded(4, "degrees"), *rounded(6, "p_value")
    )


@query(
    "w2_stop_when_significant",
    f"""WITH {sql_batch_tests('0', BATCHES - 1)},
    hit AS (SELECT coalesce(min(batch_id) FILTER (p_value < 0.05), 99) AS hit_at FROM tests)
    SELECT CASE WHEN hit_at <= 2 THEN 'significant' ELSE 'batches' END AS reason,
      CAST(batch_id AS BIGINT) AS batch_id, round(p_value, 6) AS p_value
    FROM tests, hit WHERE batch_id <= least(hit_at, 2)""",
)
def w2_stop_when_significant(spark, folder):
    """Stops at the first significant batch or after three batches."""
    stream = sample_stream(spark, folder)
    running, reason = welch.stop_when_significant(
        lambda watch: welch.streaming_welch(stream, on_result=watch), alpha=0.05, max_batches=3
    )
    return running.results(spark).select(P.lit(reason).alias("reason"), "batch_id", *rounded(6, "p_value"))


@query("w3_restart_from_checkpoint", f"WITH {SQL_WELCH}")
def w3_restart_from_checkpoint(spark, folder):
    """Stopped after the first half of the files, restarted for the second."""
    early = sample_files(spark, folder, "early", P.col("event_id") % 2 == 0)
    late = sample_files(spark, folder, "late", P.col("event_id") % 2 == 1)
    inbox = scratch_path(spark, "inbox")
    state = scratch_path(spark, "welch")
    for part in (early, late):
        spark.read.text(part).write.mode("append").text(inbox)
        stream = stream_samples(spark, inbox, files_per_batch=-(-file_count(spark) // 2))
        running = welch.streaming_welch(stream, folder=state)
        running.query.awaitTermination()
    return welch_columns(last_row(running.results(spark)))
