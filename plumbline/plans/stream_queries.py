"""The event stream: windows, checks per micro-batch and silent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.checks import build_check
from plumbline.plans.registry import query
from plumbline.session import fresh_path
from plumbline.streaming import stream


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # The table may be a file or a folder; as a glob both can be streamed.
    return stream.read_stream(spark, f"{sf_dir}/events.parque[t]", schema)


def _finished(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Process what is there and read the result table."""
    path = fresh_path(spark, name)
    stream.write_to_table(rows, path, fresh_path(spark, f"{name}-checkpoint")).awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


_MARK = "(SELECT date_trunc('milliseconds', max(ts)) FROM events)"


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished(spark, stream.windowed_metrics(_events(spark, sf_dir), "ts", "event_type", "value", "6 hours"), "windows")


_WINDOWS_SQL = f"""SELECT event_type AS asset_id, time_bucket(INTERVAL 6 HOUR, ts) AS window_start,
        time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end, count(*) AS row_count,
        round((count(*) - count(value)) * 100.0 / count(*), 4) AS null_pct, round(avg(value), 6) AS mean
      FROM events WHERE time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= {_MARK} - INTERVAL 10 MINUTE GROUP BY 1, 2"""


@query("stream_windowed_metrics", _WINDOWS_SQL)
def stream_windowed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).withColumn("mean", F.round("mean", 6))


@query(
    "stream_snapshots",
    f"""WITH w AS ({_WINDOWS_SQL}) SELECT asset_id, CAST(NULL AS VARCHAR) AS column_name, 'row_count' AS metric_name,
             CAST(row_count AS DOUBLE) AS metric_value, window_end AS captured_at FROM w
        UNION ALL SELECT asset_id, 'value', 'null_pct', null_pct, window_end FROM w
        UNION ALL SELECT asset_id, 'value', 'mean', mean, window_end FROM w""",
)
def stream_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = stream.windows_to_snapshots(_windows(spark, sf_dir), "value")
    return snaps.drop("observed_values").withColumn("metric_value", F.round("metric_value", 6))


@query(
    "stream_silent_keys",
    f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 18 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new
                   FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
             s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
        SELECT user_id AS asset_id, min(ts) AS active_since, max(ts) AS last_seen_at, max(ts) + INTERVAL 18 HOUR AS stale_at,
               count(*) AS "rows" FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 18 HOUR <= {_MARK} - INTERVAL 10 MINUTE""",
)
def stream_silent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished(spark, stream.silent_keys(_events(spark, sf_dir), "ts", "user_id", "18 hours"), "silent-keys")


def _rules():
    return [
        build_check("not_null", "events", {"column": "user_id"}, rule="user_set", severity="high"),
        build_check("range", "events", {"column": "value"}, {"max": 150}, rule="value_cap"),
        build_check("accepted_values", "events", {"column": "event_type"}, {"values": ["view", "click", "purchase"]}, rule="known_type"),
        build_check("regex_match", "events", {"column": "props"}, {"pattern": r'\{"k": [0-9]+\}'}, rule="props_format", severity="low"),
    ]


@query(
    "stream_checks",
    """WITH c(rule, "column", severity, fail_count, total_count) AS (
         SELECT 'user_set', 'user_id', 'high', count(*) - count(user_id), count(*) FROM events
         UNION ALL SELECT 'value_cap', 'value', 'medium', count(*) FILTER (WHERE value > 150), count(value) FROM events
         UNION ALL SELECT 'known_type', 'event_type', 'medium', count(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'purchase')),
                   count(event_type) FROM events
         UNION ALL SELECT 'props_format', 'props', 'low', count(*) FILTER (WHERE NOT regexp_full_match(props, '\\{"k": [0-9]+\\}')),
                   count(props) FROM events)
       SELECT rule, 'events' AS "table", "column", severity, fail_count, total_count,
              CASE WHEN fail_count > 0 THEN 'failed' ELSE 'passed' END AS status, CAST(NULL AS VARCHAR) AS error FROM c""",
)
def stream_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "stream-checks")
    stream.run_checks(
        _events(spark, sf_dir), "events", _rules(), path, fresh_path(spark, "stream-checks-checkpoint")
    ).awaitTermination()
    return stream.running_totals(spark.read.parquet(path))
