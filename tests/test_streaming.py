import time

import pytest
from pyspark.sql import functions as F

from plumbline.operators.checks import build_check
from plumbline.streaming import stream


def write(spark, path, rows):
    df = spark.createDataFrame(rows, "id int, t string, v double").withColumn("at", F.col("t").cast("timestamp_ntz")).drop("t")
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def test_windows_close_with_the_watermark(spark, tmp_path):
    path, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = write(spark, path, [(1, "2024-01-01 00:10:00", 2.0), (1, "2024-01-01 00:50:00", None), (1, "2024-01-01 01:30:00", 1.0)])

    def step():
        rows = stream.windowed_metrics(stream.read_stream(spark, path, schema), "at", "id", "v")
        stream.write_to_table(rows, out, mark).awaitTermination()
        return sorted((r["window_start"].hour, r["row_count"], r["null_pct"], r["mean"]) for r in spark.read.parquet(out).collect())

    assert step() == [(0, 2, 50.0, 2.0)]
    # a late row of the closed hour is dropped, the next hour closes
    write(spark, path, [(1, "2024-01-01 00:59:00", 9.0), (1, "2024-01-01 03:00:00", 5.0)])
    assert step() == [(0, 2, 50.0, 2.0), (1, 1, 0.0, 1.0)]


def test_silent_keys(spark, tmp_path):
    path, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = write(spark, path, [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 01:00:00", 1.0), (2, "2024-01-02 00:00:00", 1.0), (2, "2024-01-03 06:00:00", 1.0)])
    rows = stream.silent_keys(stream.read_stream(spark, path, schema), "at", "id", "24 hours")
    stream.write_to_table(rows, out, mark).awaitTermination()
    assert sorted((r["asset_id"], str(r["stale_at"]), r["rows"]) for r in spark.read.parquet(out).collect()) == [
        (1, "2024-01-02 01:00:00", 2), (2, "2024-01-03 00:00:00", 1),
    ]


def test_checks_per_batch_add_up_and_restart_is_safe(spark, tmp_path):
    path, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = write(spark, path, [(1, "2024-01-01", 1.0), (None, "2024-01-01", 1.0)])
    rule = build_check("not_null", "s", {"column": "id"})

    def step():
        stream.run_checks(stream.read_stream(spark, path, schema), "s", [rule], out, mark).awaitTermination()
        row = stream.running_totals(spark.read.parquet(out)).first()
        return row["fail_count"], row["total_count"]

    assert step() == (1, 2)
    assert step() == (1, 2)
    write(spark, path, [(None, "2024-01-02", 1.0)])
    assert step() == (2, 3)


def test_errors_stay_errors_and_unfit_checks_are_refused(spark, tmp_path):
    import pytest

    from plumbline.operators.checks import build_check
    from plumbline.streaming import stream

    log = spark.createDataFrame(
        [("r", "t", "c", "low", 0, 5, "passed", None), ("r", "t", "c", "low", None, None, "error", "bad value"), ("s", "t", "c", "low", 1, 5, "failed", None)],
        "rule string, table string, column string, severity string, fail_count long, total_count long, status string, error string",
    )
    assert {r["rule"]: (r["status"], r["error"]) for r in stream.running_totals(log).collect()} == {"r": ("error", "bad value"), "s": ("failed", None)}
    for shape, threshold in (("uniqueness", None), ("freshness", {"max_age_hours": 1})):
        with pytest.raises(ValueError):
            stream.run_checks(log, "t", [build_check(shape, "t", {"column": "c"}, threshold)], str(tmp_path / "a"), str(tmp_path / "b"))


def _silent(spark, tmp_path, steps, **options):
    """Rows of silent_keys after each step of (id, time) rows, as (id, first hour, last hour, rows)."""
    path, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    seen = []
    for step in steps:
        schema = write(spark, path, [(i, t, 1.0) for i, t in step])
        rows = stream.silent_keys(stream.read_stream(spark, path, schema), "at", "id", **options)
        stream.write_to_table(rows, out, mark).awaitTermination()
        found = spark.read.parquet(out).collect()
        seen.append(sorted(((r["asset_id"], str(r["active_since"])[8:16], str(r["last_seen_at"])[8:16], r["rows"]) for r in found), key=repr))
    return seen


def test_late_rows_join_sessions_across_batches(spark, tmp_path):
    first = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 06:00:00"), (None, "2024-01-01 02:00:00"), (3, None)]
    # 03:00 closes the gap between two sessions that were apart; a row exactly at the gap begins a new one
    second = [(1, "2024-01-01 03:00:00"), (1, "2024-01-01 10:00:00"), (2, "2024-01-01 03:00:00"), (2, "2024-01-01 03:00:00")]
    third = [(9, "2024-01-03 00:00:00")]
    steps = _silent(spark, tmp_path, [first, second, third], max_age="4 hours", lateness="6 hours")
    assert steps[0] == [] and steps[1] == []
    assert steps[2] == [
        (1, "01 00:00", "01 06:00", 3), (1, "01 10:00", "01 10:00", 1), (2, "01 03:00", "01 03:00", 2), (None, "01 02:00", "01 02:00", 1),
    ]


def test_wall_clock_reports_a_key_that_stays_silent(spark, tmp_path):
    """Nothing follows that could move a watermark. Such a stream has no last batch, so it is stopped."""
    path, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = write(spark, path, [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 01:00:00", 1.0), (2, "2024-01-02 00:00:00", 1.0)])
    rows = stream.silent_keys(stream.read_stream(spark, path, schema), "at", "id", clock="wall")
    query = stream.write_to_table(rows, out, mark, continuous="1 second")
    try:
        for _ in range(60):
            if any(p["numInputRows"] for p in query.recentProgress):
                break
            time.sleep(1)
    finally:
        query.stop()
    found = spark.read.schema(rows.schema).parquet(out).collect()
    assert sorted((r["asset_id"], str(r["last_seen_at"]), str(r["stale_at"]), r["rows"]) for r in found) == [
        (1, "2024-01-01 01:00:00", "2024-01-02 01:00:00", 2), (2, "2024-01-02 00:00:00", "2024-01-03 00:00:00", 1),
    ]


def test_clocks_are_named(spark, tmp_path):
    schema = write(spark, str(tmp_path / "in"), [(1, "2024-01-01 00:00:00", 1.0)])
    rows = stream.read_stream(spark, str(tmp_path / "in"), schema)
    with pytest.raises(ValueError):
        stream.silent_keys(rows, "at", "id", clock="moon")


def test_merged_spans():
    assert stream.merged_spans([(5, 6, 1), (0, 1, 2), (10, 12, 1), (2, 9, 4)], 2) == [(0, 12, 8)]
    assert stream.merged_spans([(0, 1, 1), (3, 3, 1)], 2) == [(0, 1, 1), (3, 3, 1)]
    assert stream.merged_spans([], 2) == []
