"""Metrics of the event stream: each day is a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import checks, metrics, profiling
from plumbline.operators.checks import build_check
from plumbline.plans.registry import query
from plumbline.session import stored
from plumbline.sources.tables import read_tables

AS_OF = "2024-01-30 00:00:00"
_NOW = f"TIMESTAMP '{AS_OF}'"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tables(spark, sf_dir, ["events"])["events"].select(
        F.col("event_type").alias("asset_id"),
        F.col("ts").cast("date").cast("timestamp_ntz").alias("captured_at"),
        "ts", "user_id", "value",
        F.date_format("ts", "HH").alias("hour"),
    )


def type_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type and day: all metrics of ts, user_id, value and hour."""
    rows = _events(spark, sf_dir)
    keys = ["asset_id", "captured_at"]
    end_of_day = F.col("captured_at") + F.expr("INTERVAL '1' DAY")
    profile = profiling.profile_columns(rows, "events", end_of_day, keys=keys)
    counted = profiling.value_frequencies(rows, ["hour"], keys)
    # An hour has 24 values, so its lists are bounded.
    sets = counted.groupBy(*keys, "column").agg(
        F.count(F.lit(1)).alias("distinct_count"), F.sort_array(F.collect_list("value")).alias("values")
    )
    return metrics.extract_metrics(profile, sets)


def user_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day: row count and mean value."""
    daily = (
        read_tables(spark, sf_dir, ["events"])["events"]
        .groupBy(
            F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("asset_id"),
            F.col("ts").cast("date").cast("timestamp_ntz").alias("captured_at"),
        )
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("value").alias("m"))
    )
    rows = F.array(
        F.struct(F.lit(None).cast("string").alias("column_name"), F.lit("row_count").alias("metric_name"), F.col("n").alias("metric_value")),
        F.struct(F.lit("value").alias("column_name"), F.lit("mean").alias("metric_name"), F.col("m").alias("metric_value")),
    )
    return daily.select("asset_id", "captured_at", F.inline(rows)).withColumn(
        "observed_values", F.lit(None).cast("array<string>")
    )


_COLUMNS = {"ts": "time", "user_id": "number", "value": "number", "hour": "text"}


def _column_metrics_sql(c: str, kind: str) -> str:
    values = {
        "null_pct": f"round((count(*) - count({c})) * 100.0 / count(*), 4)",
        "distinct_count": f"count(DISTINCT {c})",
        "duplicate_pct": f"CASE WHEN count({c}) > 0 THEN (1.0 - count(DISTINCT {c}) / CAST(count({c}) AS DOUBLE)) * 100 END",
    }
    if kind == "number":
        values |= {"mean": f"avg({c})", "stddev": f"stddev_samp({c})", "min_value": f"min({c})", "max_value": f"max({c})"}
    if kind == "text":
        values |= {"avg_length": f"avg(length({c}))", "max_length": f"max(length({c}))"}
    return " UNION ALL ".join(
        f"""SELECT asset_id, '{c}' AS column_name, '{m}' AS metric_name, CAST({v} AS DOUBLE) AS metric_value,
                   CAST(NULL AS VARCHAR[]) AS observed_values, captured_at FROM e GROUP BY asset_id, captured_at"""
        for m, v in values.items()
    )


_E = """e AS (SELECT event_type AS asset_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS captured_at, ts, user_id, value,
                    strftime(ts, '%H') AS "hour" FROM events)"""
TYPE_SNAPSHOTS = (
    _E
    + ", snaps AS (SELECT * FROM ("
    + " UNION ALL ".join(_column_metrics_sql(c, k) for c, k in _COLUMNS.items())
    + """ UNION ALL SELECT asset_id, NULL, 'row_count', CAST(count(*) AS DOUBLE), NULL, captured_at FROM e GROUP BY asset_id, captured_at
      UNION ALL SELECT asset_id, NULL, 'freshness_lag_hours',
           round(epoch(captured_at + INTERVAL 1 DAY - max(ts)) / 86400.0, 1) * 24.0, NULL, captured_at FROM e GROUP BY asset_id, captured_at
      UNION ALL SELECT asset_id, 'hour', 'observed_categories', CAST(count(DISTINCT "hour") AS DOUBLE), list_sort(list(DISTINCT "hour")),
           captured_at FROM e GROUP BY asset_id, captured_at) WHERE metric_value IS NOT NULL)"""
)
USER_SNAPSHOTS = """snaps AS (
    SELECT 'user-' || user_id AS asset_id, CAST(NULL AS VARCHAR) AS column_name, 'row_count' AS metric_name,
           CAST(count(*) AS DOUBLE) AS metric_value, CAST(NULL AS VARCHAR[]) AS observed_values,
           CAST(CAST(ts AS DATE) AS TIMESTAMP) AS captured_at FROM events GROUP BY user_id, CAST(ts AS DATE)
    UNION ALL
    SELECT 'user-' || user_id, 'value', 'mean', avg(value), NULL, CAST(CAST(ts AS DATE) AS TIMESTAMP)
    FROM events GROUP BY user_id, CAST(ts AS DATE))"""
BASELINES = f"""
    win AS (SELECT * FROM snaps WHERE captured_at BETWEEN {_NOW} - INTERVAL 30 DAY AND {_NOW}),
    med AS (SELECT asset_id, column_name, metric_name, count(*) AS sample_count,
                   CASE WHEN metric_name <> 'observed_categories' THEN median(metric_value) END AS median,
                   min(captured_at) AS window_start, max(captured_at) AS window_end FROM win GROUP BY 1, 2, 3),
    dev AS (SELECT m.asset_id, m.column_name, m.metric_name, median(abs(w.metric_value - m.median)) AS mad
            FROM med m JOIN win w ON w.asset_id = m.asset_id AND w.metric_name = m.metric_name
              AND w.column_name IS NOT DISTINCT FROM m.column_name
            WHERE m.metric_name <> 'observed_categories' GROUP BY 1, 2, 3),
    obs AS (SELECT asset_id, column_name, list_sort(list(DISTINCT v)) AS observed_set
            FROM (SELECT asset_id, column_name, unnest(observed_values) AS v FROM win
                  WHERE metric_name = 'observed_categories') GROUP BY 1, 2),
    base AS (SELECT m.asset_id, m.column_name, m.metric_name, m.median, d.mad, m.sample_count,
                    CASE WHEN m.metric_name = 'observed_categories' THEN o.observed_set END AS observed_set,
                    m.window_start, m.window_end
             FROM med m LEFT JOIN dev d ON d.asset_id = m.asset_id AND d.metric_name = m.metric_name
               AND d.column_name IS NOT DISTINCT FROM m.column_name
             LEFT JOIN obs o ON o.asset_id = m.asset_id AND o.column_name = m.column_name),
    latest AS (SELECT asset_id, column_name, metric_name, arg_max(metric_value, captured_at) AS latest_value,
                      arg_max(observed_values, captured_at) AS latest_values, max(captured_at) AS latest_at
               FROM snaps GROUP BY 1, 2, 3),
    bl AS (SELECT b.*, l.latest_value, l.latest_values, l.latest_at,
                  abs(l.latest_value - b.median) / nullif(b.mad, 0) AS deviations
           FROM base b LEFT JOIN latest l ON l.asset_id = b.asset_id AND l.metric_name = b.metric_name
             AND l.column_name IS NOT DISTINCT FROM b.column_name)"""
_R = "round({0}, 6) AS {0}"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


@query(
    "metric_snapshots",
    f"""WITH {TYPE_SNAPSHOTS} SELECT asset_id, column_name, metric_name, {_R.format("metric_value")},
          array_to_string(observed_values, ',') AS observed_values, captured_at FROM snaps""",
)
def metric_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(type_snapshots(spark, sf_dir), "metric_value").withColumn(
        "observed_values", F.array_join("observed_values", ",")
    )


def _base(spark: SparkSession, sf_dir: str, kind: str):
    """Snapshots and baselines are recorded; checks and reports read the recorded tables."""
    taken = type_snapshots(spark, sf_dir) if kind == "type" else user_snapshots(spark, sf_dir)
    snaps = stored(taken, f"{kind}-snapshots")
    return snaps, stored(metrics.baselines(snaps, AS_OF), f"{kind}-baselines")


@query(
    "baselines_mad",
    f"""WITH {TYPE_SNAPSHOTS}, {BASELINES} SELECT asset_id, column_name, metric_name, {_R.format("median")},
          {_R.format("mad")}, sample_count, array_to_string(observed_set, ',') AS observed_set, window_start, window_end
        FROM base""",
)
def baselines_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_base(spark, sf_dir, "type")[1], "median", "mad").withColumn(
        "observed_set", F.array_join("observed_set", ",")
    )


@query(
    "user_baselines",
    f"""WITH {USER_SNAPSHOTS}, {BASELINES} SELECT asset_id, column_name, metric_name, {_R.format("median")},
          {_R.format("mad")}, sample_count FROM base""",
)
def user_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_base(spark, sf_dir, "user")[1], "median", "mad").select(
        "asset_id", "column_name", "metric_name", "median", "mad", "sample_count"
    )


@query(
    "ready_baselines",
    f"""WITH {USER_SNAPSHOTS}, {BASELINES} SELECT asset_id, column_name, metric_name, sample_count FROM base
        WHERE sample_count >= 14""",
)
def ready_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ready(_base(spark, sf_dir, "user")[1]).select(
        "asset_id", "column_name", "metric_name", "sample_count"
    )


@query(
    "latest_baseline",
    f"""WITH {USER_SNAPSHOTS} SELECT asset_id, column_name, metric_name, {_R.format("median")}, updated_at FROM (
          SELECT asset_id, column_name, metric_name, median(metric_value) AS median, max(captured_at) AS updated_at,
                 row_number() OVER (PARTITION BY asset_id, column_name, metric_name ORDER BY max(captured_at) DESC) AS rn
          FROM snaps GROUP BY asset_id, column_name, metric_name, date_trunc('week', captured_at)) WHERE rn = 1""",
)
def latest_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One baseline per calendar week; the newest of each key is looked up."""
    snaps = user_snapshots(spark, sf_dir).withColumn("week", F.trunc(F.col("captured_at").cast("date"), "week"))
    keys = [*metrics.KEYS, "week"]
    weekly = metrics.exact_medians(snaps, keys, "metric_value")
    stamped = metrics.null_safe_join(
        weekly, snaps.groupBy(*keys).agg(F.max("captured_at").alias("updated_at")), keys
    )
    return _rounded(metrics.latest_baselines(stamped), "median").select(*metrics.KEYS, "median", "updated_at")


@query(
    "metric_anomaly",
    f"""WITH {TYPE_SNAPSHOTS}, {BASELINES} SELECT asset_id, column_name, metric_name, {_R.format("latest_value")},
          {_R.format("median")}, {_R.format("mad")},
          CAST(CASE WHEN mad IS NULL OR latest_value IS NULL THEN 0 WHEN mad = 0 THEN CAST(latest_value <> median AS INT)
                    WHEN deviations > 3 THEN 1 ELSE 0 END AS BIGINT) AS fail_count, CAST(1 AS BIGINT) AS total_count
        FROM bl WHERE metric_name <> 'observed_categories'""",
)
def metric_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps, base = _base(spark, sf_dir, "type")
    return _rounded(metrics.metric_anomaly(snaps, base), "latest_value", "median", "mad")


@query(
    "metric_relative_change",
    f"""WITH {USER_SNAPSHOTS}, r AS (SELECT *, row_number() OVER (PARTITION BY asset_id, column_name, metric_name
                                                                 ORDER BY captured_at DESC) AS rn FROM snaps),
        p AS (SELECT asset_id, column_name, metric_name, max(metric_value) FILTER (WHERE rn = 1) AS latest_value,
                     max(metric_value) FILTER (WHERE rn = 2) AS previous_value FROM r GROUP BY 1, 2, 3)
        SELECT asset_id, column_name, metric_name, {_R.format("latest_value")}, {_R.format("previous_value")},
               CAST(CASE WHEN previous_value IS NULL OR latest_value IS NULL THEN 0
                         WHEN previous_value = 0 AND latest_value = 0 THEN 0 WHEN previous_value = 0 THEN 1
                         WHEN abs(latest_value - previous_value) * 100.0 / abs(previous_value) > 25 THEN 1 ELSE 0 END
                    AS BIGINT) AS fail_count, CAST(1 AS BIGINT) AS total_count FROM p""",
)
def metric_relative_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        metrics.metric_relative_change(user_snapshots(spark, sf_dir)), "latest_value", "previous_value"
    )


@query(
    "category_disappeared",
    f"""WITH {TYPE_SNAPSHOTS}, {BASELINES}, m AS (
          SELECT asset_id, column_name, metric_name, list_filter(observed_set, lambda v: NOT list_contains(latest_values, v)) AS gone
          FROM bl WHERE metric_name = 'observed_categories')
        SELECT asset_id, column_name, metric_name, array_to_string(gone, ',') AS missing_values,
               CAST(len(gone) > 0 AS BIGINT) AS fail_count, CAST(1 AS BIGINT) AS total_count FROM m""",
)
def category_disappeared(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps, base = _base(spark, sf_dir, "type")
    return metrics.category_disappeared(snaps, base).withColumn(
        "missing_values", F.array_join("missing_values", ",")
    )


@query(
    "fleet_breaches",
    f"""WITH {USER_SNAPSHOTS}, {BASELINES} SELECT asset_id, column_name, metric_name, {_R.format("latest_value")}, latest_at,
          {_R.format("median")}, {_R.format("mad")}, sample_count, {_R.format("deviations")},
          CASE WHEN bl.deviations >= 3 THEN 'breached' ELSE 'watch' END AS severity
        FROM bl WHERE sample_count >= 14 AND mad > 0 AND bl.deviations >= 2
        ORDER BY bl.deviations DESC, asset_id, column_name NULLS FIRST, metric_name LIMIT 50""",
)
def fleet_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps, base = _base(spark, sf_dir, "user")
    return _rounded(metrics.fleet_breaches(snaps, base), "latest_value", "median", "mad", "deviations")


@query(
    "asset_metrics",
    f"""WITH {USER_SNAPSHOTS}, {BASELINES}, r AS (SELECT *, row_number() OVER (PARTITION BY asset_id, column_name, metric_name
                                                            ORDER BY captured_at DESC) AS rn FROM snaps),
        h AS (SELECT asset_id, column_name, metric_name, count(*) AS points,
                     string_agg(strftime(captured_at, '%d'), ',' ORDER BY captured_at) AS days FROM r WHERE rn <= 20 GROUP BY 1, 2, 3)
        SELECT bl.asset_id, bl.column_name, bl.metric_name, {_R.format("latest_value")}, {_R.format("deviations")},
               CASE WHEN sample_count < 14 THEN 'warming_up' WHEN bl.deviations >= 3 THEN 'breached'
                    WHEN bl.deviations >= 2 THEN 'watch' ELSE 'healthy' END AS status,
               CAST(points AS INTEGER) AS points, days
        FROM bl JOIN h ON h.asset_id = bl.asset_id AND h.metric_name = bl.metric_name
             AND h.column_name IS NOT DISTINCT FROM bl.column_name""",
)
def asset_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps, base = _base(spark, sf_dir, "user")
    found = metrics.asset_metrics(snaps, base)
    days = F.transform(F.col("history.captured_at"), lambda t: F.date_format(t, "dd"))
    return _rounded(
        found.select(
            *metrics.KEYS, "latest_value", "deviations", "status", F.size("history").alias("points"),
            F.array_join(days, ",").alias("days"),
        ),
        "latest_value", "deviations",
    )


@query(
    "metric_status_counts",
    f"""WITH {USER_SNAPSHOTS}, {BASELINES} SELECT CASE WHEN sample_count < 14 THEN 'warming_up' WHEN bl.deviations >= 3 THEN 'breached'
               WHEN bl.deviations >= 2 THEN 'watch' ELSE 'healthy' END AS status, count(*) AS n FROM bl GROUP BY 1""",
)
def metric_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps, base = _base(spark, sf_dir, "user")
    return metrics.asset_metrics(snaps, base, 2).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "metric_history",
    f"""WITH {TYPE_SNAPSHOTS}, {BASELINES} SELECT s.asset_id, s.column_name, s.metric_name, s.captured_at, {_R.format("s.metric_value").replace("AS s.", "AS ")},
          {_R.format("median")}, round(median - 3 * mad, 6) AS "lower", round(median + 3 * mad, 6) AS "upper",
          s.captured_at IN (SELECT captured_at FROM e WHERE value > 200 AND asset_id = 'click') AS is_breach
        FROM snaps s JOIN base b ON b.asset_id = s.asset_id AND b.metric_name = s.metric_name AND b.column_name = s.column_name
        WHERE s.asset_id = 'click' AND s.column_name = 'value' AND s.metric_name = 'mean'""",
)
def metric_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps, base = _base(spark, sf_dir, "type")
    breaches = _events(spark, sf_dir).where((F.col("value") > 200) & (F.col("asset_id") == "click"))
    return _rounded(
        metrics.metric_history(snaps, base, breaches, "click", "mean", "value"), "metric_value", "median", "lower", "upper"
    )


_TRACKED = """(metric_name = 'null_pct' AND metric_value BETWEEN 0.5 AND 99.5) OR (metric_name = 'distinct_count' AND metric_value >= 2)
    OR (metric_name = 'duplicate_pct' AND metric_value BETWEEN 1 AND 99) OR metric_name IN ('mean', 'stddev', 'min_value',
    'max_value', 'avg_length', 'max_length', 'pattern_match_pct', 'observed_categories')"""


def _monitored(snaps: DataFrame) -> DataFrame:
    return snaps.where(F.col("metric_name").isin("mean", "row_count")).select(*metrics.KEYS).distinct()


@query(
    "column_enrollment",
    f"""WITH {TYPE_SNAPSHOTS} SELECT DISTINCT asset_id, column_name, metric_name, 'auto_column' AS enrollment_source
        FROM snaps WHERE column_name IS NOT NULL AND metric_name <> 'mean' AND ({_TRACKED})""",
)
def column_enrollment(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = type_snapshots(spark, sf_dir)
    return metrics.enroll_column_metrics(snaps, _monitored(snaps))


@query(
    "table_enrollment",
    """SELECT DISTINCT 'user-' || user_id AS asset_id, CAST(NULL AS VARCHAR) AS column_name, 'freshness_lag_hours' AS metric_name,
              'auto_table' AS enrollment_source FROM events""",
)
def table_enrollment(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = user_snapshots(spark, sf_dir)
    return metrics.enroll_table_metrics(snaps.select("asset_id").distinct(), _monitored(snaps))


@query(
    "enrollment_backfill",
    f"""WITH {USER_SNAPSHOTS}, {BASELINES} SELECT asset_id, column_name, metric_name, 'anomaly_proposal' AS enrollment_source
        FROM base WHERE metric_name = 'mean'""",
)
def enrollment_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps, base = _base(spark, sf_dir, "user")
    return metrics.backfill_enrollment(base, _monitored(snaps.where(F.col("metric_name") == "row_count")))


@query(
    "enrolled_snapshots",
    f"""WITH {TYPE_SNAPSHOTS} SELECT asset_id, column_name, metric_name, captured_at, {_R.format("metric_value")}
        FROM snaps WHERE metric_name IN ('mean', 'row_count')""",
)
def enrolled_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = type_snapshots(spark, sf_dir)
    return _rounded(metrics.enrolled_only(snaps, _monitored(snaps)), "metric_value").drop("observed_values")


@query(
    "anomaly_proposals",
    f"""WITH {TYPE_SNAPSHOTS}, {BASELINES}, c AS (SELECT asset_id, column_name, metric_name,
             CASE metric_name WHEN 'observed_categories' THEN 'category_disappeared' ELSE 'metric_anomaly' END AS shape,
             CASE metric_name WHEN 'row_count' THEN 'high' WHEN 'freshness_lag_hours' THEN 'high' WHEN 'null_pct' THEN 'medium'
                              WHEN 'distinct_count' THEN 'low' ELSE 'medium' END AS severity,
             CASE metric_name WHEN 'row_count' THEN -3 WHEN 'freshness_lag_hours' THEN -2 WHEN 'observed_categories' THEN -1 ELSE 0 END
               AS priority
           FROM base WHERE sample_count >= 14 AND metric_name IN ('row_count', 'freshness_lag_hours', 'null_pct', 'distinct_count',
                'observed_categories') AND NOT (metric_name = 'row_count' AND asset_id IN ('click', 'view'))
             AND NOT (metric_name = 'null_pct' AND column_name = 'value'))
        SELECT *, CASE WHEN shape = 'metric_anomaly' THEN CAST(3 AS DOUBLE) END AS deviations FROM (SELECT *, CAST(row_number() OVER (
           PARTITION BY asset_id ORDER BY priority, column_name NULLS FIRST, metric_name) AS INTEGER) AS rank FROM c)""",
)
def anomaly_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, base = _base(spark, sf_dir, "type")
    keys = base.select(*metrics.KEYS, F.lit("metric_anomaly").alias("shape"))
    existing = keys.where((F.col("metric_name") == "row_count") & F.col("asset_id").isin("click", "view"))
    rejected = keys.where((F.col("metric_name") == "null_pct") & (F.col("column_name") == "value")).withColumn(
        "status", F.lit("rejected")
    )
    return metrics.anomaly_proposals(base, existing, rejected)


@query(
    "threshold_update",
    f"""SELECT DISTINCT 'user-' || user_id AS instance_id,
               CAST(CASE WHEN user_id IN (1, 2) THEN 4.5 ELSE 3 END AS DOUBLE) AS deviations,
               CAST(25 AS DOUBLE) AS max_pct_change FROM events""",
)
def threshold_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances = user_snapshots(spark, sf_dir).select(
        F.col("asset_id").alias("instance_id"), F.lit(3.0).alias("deviations"), F.lit(25.0).alias("max_pct_change")
    ).distinct()
    return metrics.update_thresholds(instances, deviations=4.5, instance_ids=["user-1", "user-2"])


_RULES = (
    # rule, shape, asset, column, metric, thresholds
    ("count_3", "metric_anomaly", "view", None, "row_count", {}),
    ("count_tight", "metric_anomaly", "view", None, "row_count", {"deviations": 0.1}),
    ("nulls", "metric_anomaly", "click", "value", "null_pct", {}),
    ("change_25", "metric_relative_change", "click", None, "row_count", {}),
    ("change_tiny", "metric_relative_change", "click", None, "row_count", {"max_pct_change": 0.001}),
    ("unknown", "metric_anomaly", "nowhere", None, "row_count", {}),
)


@query(
    "metric_rules_scan",
    f"""WITH {TYPE_SNAPSHOTS}, {BASELINES},
        r AS (SELECT *, row_number() OVER (PARTITION BY asset_id, column_name, metric_name ORDER BY captured_at DESC, metric_value DESC) AS rn FROM snaps),
        p AS (SELECT asset_id, column_name, metric_name, max(metric_value) FILTER (WHERE rn = 1) AS now_,
                     max(metric_value) FILTER (WHERE rn = 2) AS then_ FROM r GROUP BY 1, 2, 3),
        w(rule, shape, asset_id, column_name, metric_name, t) AS (VALUES
          ('count_3', 'a', 'view', NULL, 'row_count', 3.0), ('count_tight', 'a', 'view', NULL, 'row_count', 0.1),
          ('nulls', 'a', 'click', 'value', 'null_pct', 3.0), ('change_25', 'c', 'click', NULL, 'row_count', 25.0),
          ('change_tiny', 'c', 'click', NULL, 'row_count', 0.001), ('unknown', 'a', 'nowhere', NULL, 'row_count', 3.0)),
        j AS (SELECT rule, w.asset_id, CASE shape WHEN 'a' THEN CASE WHEN mad IS NULL OR latest_value IS NULL THEN 0
                       WHEN mad = 0 THEN CAST(latest_value <> median AS INT) WHEN deviations > t THEN 1 ELSE 0 END
                     ELSE CASE WHEN now_ IS NULL OR then_ IS NULL OR (now_ = 0 AND then_ = 0) THEN 0 WHEN then_ = 0 THEN 1
                       WHEN abs(now_ - then_) * 100.0 / abs(then_) > t THEN 1 ELSE 0 END END AS failed
              FROM w LEFT JOIN bl ON bl.asset_id = w.asset_id AND bl.column_name IS NOT DISTINCT FROM w.column_name AND bl.metric_name = w.metric_name
              LEFT JOIN p ON p.asset_id = w.asset_id AND p.column_name IS NOT DISTINCT FROM w.column_name AND p.metric_name = w.metric_name)
        SELECT rule, asset_id AS "table", CAST(failed AS BIGINT) AS fail_count, CAST(1 AS BIGINT) AS total_count,
               CASE WHEN failed > 0 THEN 'failed' ELSE 'passed' END AS status FROM j
        UNION ALL SELECT 'user_set', 'events', count(*) - count(user_id), count(*),
               CASE WHEN count(*) > count(user_id) THEN 'failed' ELSE 'passed' END FROM events""",
)
def metric_rules_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rules with thresholds of their own next to a row check, in one scan."""
    snaps, base = _base(spark, sf_dir, "type")
    rules = [
        build_check(shape, asset, {"column": column, "metric_name": metric}, thresholds, rule=rule)
        for rule, shape, asset, column, metric, thresholds in _RULES
    ]
    rules.append(build_check("not_null", "events", {"column": "user_id"}, rule="user_set"))
    events = read_tables(spark, sf_dir, ["events"])["events"]
    results = checks.scan({"events": events}, rules, snapshots=snaps, baselines=base)
    return results.select("rule", "table", "fail_count", "total_count", "status")
