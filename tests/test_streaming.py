"""The streaming test against the batch test on the same rows."""

import os
import random

import pytest

from foldlight.operators.stats import welch_test
from foldlight.sources.readers import stream_samples
from foldlight.streaming import welch

COLUMNS = ("n0", "mean0", "var0", "n1", "mean1", "var1", "t", "degrees", "p_value")


def batches(n=5, size=40, shift=0.2, seed=3):
    rng = random.Random(seed)
    return [
        [(rng.random() < 0.5, 1e6 + rng.gauss(0, 1)) for _ in range(size)]
        if i < n // 2
        else [(flag, 1e6 + rng.gauss(shift if flag else 0, 1)) for flag in rng.choices([True, False], k=size)]
        for i in range(n)
    ]


def write(folder, parts, start=0):
    folder.mkdir(exist_ok=True)
    for i, part in enumerate(parts):
        lines = [f"{'TRUE' if flag else 'false'}, {value!r}" for flag, value in part]
        path = folder / f"part-{start + i:03d}.txt"
        path.write_text("\n".join(lines) + "\n")
        # the file source goes by modification time
        stamp = 1_700_000_000 + start + i
        os.utime(path, (stamp, stamp))


def batch_result(spark, parts):
    rows = [row for part in parts for row in part]
    return welch_test(spark.createDataFrame(rows, "label boolean, value double")).head()


def assert_same(row, want):
    for c in COLUMNS:
        assert row[c] == pytest.approx(want[c], rel=1e-6), c


def run(spark, inbox, **options):
    running = welch.streaming_welch(stream_samples(spark, str(inbox), 1), **options)
    running.query.awaitTermination()
    return {r["batch_id"]: r for r in running.results(spark).collect()}


def test_all_so_far(spark, tmp_path):
    parts = batches()
    write(tmp_path / "in", parts)
    results = run(spark, tmp_path / "in")
    assert sorted(results) == [0, 1, 2, 3, 4]
    for i, row in results.items():
        assert_same(row, batch_result(spark, parts[: i + 1]))


def test_window_and_peace_period(spark, tmp_path):
    parts = batches(6)
    write(tmp_path / "in", parts)
    results = run(spark, tmp_path / "in", peace_period=2, window_size=2)
    assert sorted(results) == [2, 3, 4, 5]
    for i, row in results.items():
        assert_same(row, batch_result(spark, parts[max(2, i - 1) : i + 1]))


def test_batches_without_a_group_give_no_row(spark, tmp_path):
    parts = [[(True, 1.0), (True, 2.0)], [(False, 1.5), (False, 2.5)]]
    write(tmp_path / "in", parts)
    assert sorted(run(spark, tmp_path / "in")) == [1]


def test_no_result_yet(spark, tmp_path):
    write(tmp_path / "in", batches(2))
    assert run(spark, tmp_path / "in", peace_period=5) == {}


def test_restart_continues(spark, tmp_path):
    parts = batches(4)
    state = str(tmp_path / "state")
    write(tmp_path / "in", parts[:2])
    run(spark, tmp_path / "in", folder=state)
    write(tmp_path / "in", parts[2:], start=2)
    results = run(spark, tmp_path / "in", folder=state)
    assert sorted(results) == [0, 1, 2, 3]
    assert_same(results[3], batch_result(spark, parts))


def test_a_repeated_batch_replaces_its_rows(spark, tmp_path):
    parts = batches(2)
    moments = [
        welch.batch_moments(spark.createDataFrame(p, "label boolean, value double")) for p in parts
    ]
    merged = welch.merge_moments(moments[0].unionAll(moments[1]))
    row = welch.welch_from_moments(welch.moments_row(merged)).head()
    assert_same(row, batch_result(spark, parts))


def test_stop_when_significant(spark, tmp_path):
    parts = batches(8, shift=8.0)
    write(tmp_path / "in", parts)
    stream = stream_samples(spark, str(tmp_path / "in"), 1)
    running, reason = welch.stop_when_significant(
        lambda watch: welch.streaming_welch(stream, on_result=watch), alpha=1e-9
    )
    assert reason == "significant"
    rows = {r["batch_id"]: r["p_value"] for r in running.results(spark).collect()}
    assert min(rows.values()) < 1e-9
    assert not running.query.isActive


def test_stop_after_batches(spark, tmp_path):
    write(tmp_path / "in", batches(8, shift=0.0))
    stream = stream_samples(spark, str(tmp_path / "in"), 1)
    running, reason = welch.stop_when_significant(
        lambda watch: welch.streaming_welch(stream, on_result=watch), alpha=0.0, max_batches=2
    )
    assert reason == "batches"
    assert running.progress["batches"] == 2
    assert sorted(r.batch_id for r in running.results(spark).collect()) == [0, 1]


def test_input_ends(spark, tmp_path):
    write(tmp_path / "in", batches(2, shift=0.0))
    stream = stream_samples(spark, str(tmp_path / "in"), 1)
    _, reason = welch.stop_when_significant(
        lambda watch: welch.streaming_welch(stream, on_result=watch), alpha=0.0
    )
    assert reason == "input ended"
