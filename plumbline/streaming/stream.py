"""Streaming forms of the metrics, the checks and the freshness rule.

They replace timed rescans. State is Spark's, so it is partitioned, checkpointed and
survives lost executors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators import checks
from plumbline.operators.checks import Check


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """A growing folder of Parquet files as a stream. ``path`` may be a glob."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _timed(stream: DataFrame, time_column: str, lateness: str) -> DataFrame:
    """Event time has to be a TIMESTAMP; the session time zone should be UTC."""
    return stream.withColumn(time_column, F.col(time_column).cast("timestamp")).withWatermark(time_column, lateness)


def windowed_metrics(
    stream: DataFrame,
    time_column: str,
    key: str,
    value: str,
    window: str = "1 hour",
    lateness: str = "10 minutes",
) -> DataFrame:
    """Row count, NULL percentage and mean of a column per key and time window.

    A window is emitted once the watermark has passed it; later rows of it are
    dropped. Counters are merged per task before the shuffle.
    """
    grouped = (
        _timed(stream, time_column, lateness)
        .groupBy(F.window(time_column, window).alias("w"), F.col(key).alias("asset_id"))
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.round((F.count(F.lit(1)) - F.count(value)) / F.count(F.lit(1)) * 100, 4).alias("null_pct"),
            F.avg(F.col(value).cast("double")).alias("mean"),
        )
    )
    return grouped.select(
        "asset_id",
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        "row_count",
        "null_pct",
        "mean",
    )


def windows_to_snapshots(windows: DataFrame, column: str) -> DataFrame:
    """Closed windows as metric snapshots, ready for baselines and anomaly checks."""
    rows = F.array(
        F.struct(
            F.lit(None).cast("string").alias("column_name"),
            F.lit("row_count").alias("metric_name"),
            F.col("row_count").cast("double").alias("metric_value"),
        ),
        F.struct(F.lit(column).alias("column_name"), F.lit("null_pct").alias("metric_name"), F.col("null_pct").alias("metric_value")),
        F.struct(F.lit(column).alias("column_name"), F.lit("mean").alias("metric_name"), F.col("mean").alias("metric_value")),
    )
    return windows.select(
        "asset_id", F.col("window_end").alias("captured_at"), F.inline(rows)
    ).where(F.col("metric_value").isNotNull()).select(
        "asset_id", "column_name", "metric_name", "metric_value",
        F.lit(None).cast("array<string>").alias("observed_values"), "captured_at",
    )


def _spans(time_column: str, slice_us: int):
    """Rows to one row per task batch, key and slice of time: first and last time, and rows."""

    def reduce_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = batch.column(time_column).cast(pa.timestamp("us", tz=batch.schema.field(time_column).type.tz)).cast(pa.int64())
            table = pa.table({"asset_id": batch.column("asset_id"), "at": times, "slice": pc.divide(times, slice_us)})
            spans = table.filter(pc.is_valid(table["at"])).group_by(["asset_id", "slice"]).aggregate(
                [("at", "min"), ("at", "max"), ("at", "count")]
            )
            columns = [spans["asset_id"], spans["at_min"], spans["at_max"].cast(pa.timestamp("us", tz="UTC")), spans["at_count"]]
            yield from pa.Table.from_arrays(columns, ["asset_id", "first", "last_at", "n"]).to_batches()

    return reduce_batches


def merged_spans(spans: Iterable[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(first, last, rows) of sessions: spans less than ``gap`` apart belong together."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(spans):
        if out and first - out[-1][1] < gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


def _watch(gap: int, wall: bool):
    """The state of a key is the list of its sessions that are not over."""

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spans = list(zip(*state.get)) if state.exists else []
        if not state.hasTimedOut:
            for frame in frames:
                last = frame["last_at"].astype("int64") // (1000 if frame["last_at"].dtype.name.startswith("datetime64[ns") else 1)
                spans = merged_spans([*spans, *zip(frame["first"], last, frame["n"])], gap)
        # In milliseconds: event time that can no longer be undercut, or the time of day.
        now = state.getCurrentProcessingTimeMs() if wall else state.getCurrentWatermarkMs()
        over = [s for s in spans if s[1] + gap <= now * 1000]
        open_ = [s for s in spans if s[1] + gap > now * 1000]
        if open_:
            state.update(tuple([int(s[i]) for s in open_] for i in range(3)))
            due = -(-(min(s[1] for s in open_) + gap) // 1000)
            if wall:
                state.setTimeoutDuration(max(1, due - now))
            else:
                # A timer runs once the watermark is past it.
                state.setTimeoutTimestamp(due - 1)
        elif state.exists:
            state.remove()
        if over:
            firsts, lasts, counts = zip(*over)
            times = {
                "active_since": pd.to_datetime(firsts, unit="us"),
                "last_seen_at": pd.to_datetime(lasts, unit="us"),
                "stale_at": pd.to_datetime([x + gap for x in lasts], unit="us"),
            }
            yield pd.DataFrame({"asset_id": [key[0]] * len(over), **times, "rows": counts})

    return watch


def silent_keys(
    stream: DataFrame,
    time_column: str,
    key: str,
    max_age: str = "24 hours",
    lateness: str = "10 minutes",
    clock: str = "event",
) -> DataFrame:
    """One row each time a key has sent nothing for ``max_age``: since when, and when it became stale.

    Every key has state and a timer of its own. With the ``event`` clock the timer runs when the
    watermark passes it, so results repeat; with the ``wall`` clock it runs by the time of day, also
    if no key sends anything any more, and what was silent before the stream began is reported at once.
    Such a stream never runs out of batches: write it with a ``continuous`` trigger.

    Rows are first merged to one per key and hour in each task, so a busy key is a few rows in
    the shuffle. Works with any session settings. Rows without time are no signs of life; rows
    without key are a key of their own. Rows later than ``lateness`` are dropped.
    """
    if clock not in ("event", "wall"):
        raise ValueError("clock is 'event' or 'wall'")
    gap = pd.Timedelta(max_age) // pd.Timedelta("1us")
    kind = stream.schema[key].dataType.simpleString()
    timed = stream.select(F.col(key).alias("asset_id"), F.col(time_column).cast("timestamp_ntz").alias("at"))
    # A slice that is no longer than the gap never spans two sessions.
    spans = timed.mapInArrow(
        _spans("at", min(gap, 3_600_000_000)), f"asset_id {kind}, first long, last_at timestamp, n long"
    ).withWatermark("last_at", lateness)
    return spans.groupBy("asset_id").applyInPandasWithState(
        _watch(gap, clock == "wall"),
        f"asset_id {kind}, active_since timestamp_ntz, last_seen_at timestamp_ntz, stale_at timestamp_ntz, rows long",
        "firsts array<long>, lasts array<long>, counts array<long>",
        "append",
        GroupStateTimeout.ProcessingTimeTimeout if clock == "wall" else GroupStateTimeout.EventTimeTimeout,
    )


def write_to_table(stream: DataFrame, path: str, checkpoint: str, continuous: str | None = None) -> StreamingQuery:
    """Append finished rows to a Parquet table, exactly once.

    Without ``continuous`` (a trigger interval) the stream stops when the data
    present has been processed.
    """
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)
    return writer.start(path)


def run_checks(
    stream: DataFrame,
    table: str,
    rules: Sequence[Check],
    path: str,
    checkpoint: str,
    continuous: str | None = None,
) -> StreamingQuery:
    """Run row checks on every micro-batch and keep the results as a log.

    Each batch owns one partition of the log, which a repeated batch overwrites:
    a restart never counts rows twice. All rules of a batch are one aggregation.
    Checks that need more than one batch (keys, references, freshness) are refused.
    """
    unfit = [c.rule for c in rules if c.shape not in checks.ROW_SHAPES or c.shape == "freshness"]
    if unfit:
        raise ValueError(f"not decided row by row: {', '.join(unfit)}")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        results = checks.scan({table: batch}, rules).withColumn("batch_id", F.lit(batch_id))
        (
            results.coalesce(1)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(path)
        )

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)
    return writer.start()


def running_totals(log: DataFrame) -> DataFrame:
    """Counts of the check log over all batches; an error in any batch stays one."""
    sums = log.groupBy("rule", "table", "column", "severity").agg(
        F.sum("fail_count").alias("fail_count"),
        F.sum("total_count").alias("total_count"),
        F.min("error").alias("error"),
        F.count_if(F.col("status") == "error").alias("__errors"),
    )
    status = F.when(F.col("__errors") > 0, "error").when(F.col("fail_count") > 0, "failed").otherwise("passed")
    return sums.withColumn("status", status).drop("__errors")
