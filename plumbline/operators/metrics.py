"""Metrics over time: snapshots, baselines, anomalies, enrolment.

A snapshot row is (asset_id, column_name or NULL, metric_name, metric_value,
observed_values, captured_at). A NULL column means the whole table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import policy
from plumbline.functions.naming import starts_with_any
from plumbline.functions.time import AsOf, days_before, moment
from plumbline.operators.joins import null_safe_join

KEYS = ("asset_id", "column_name", "metric_name")
SNAPSHOTS = T.StructType(
    [
        T.StructField("asset_id", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("metric_name", T.StringType()),
        T.StructField("metric_value", T.DoubleType()),
        T.StructField("observed_values", T.ArrayType(T.StringType())),
        T.StructField("captured_at", T.TimestampNTZType()),
    ]
)


def is_finite(value: Column) -> Column:
    number = value.cast("double")
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))


def finite(value: Column) -> Column:
    return F.when(is_finite(value), value.cast("double"))


def _clamped(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))


def extract_metrics(profile: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Snapshot rows of a profile keyed by asset_id and captured_at.

    ``sets`` is the matching ``closed_sets`` result; it adds observed_categories.
    """
    kind = F.upper("data_type")
    numeric = starts_with_any(
        kind, ("NUMBER", "INT", "BIGINT", "SMALLINT", "TINYINT", "FLOAT", "DOUBLE", "DECIMAL", "NUMERIC", "REAL")
    )
    text = starts_with_any(kind, ("VARCHAR", "STRING", "TEXT", "CHAR"))
    duplicate = (F.lit(1.0) - F.col("distinct_count") / F.nullif(F.col("non_null"), F.lit(0))) * 100
    per_column = {
        "null_pct": _clamped(F.col("null_pct")),
        "distinct_count": F.col("distinct_count"),
        "duplicate_pct": _clamped(F.when(F.col("non_null") > 0, duplicate)),
        "mean": F.when(numeric, F.col("avg_value")),
        "stddev": F.when(numeric, F.col("stddev")),
        "min_value": F.when(numeric, F.col("min_number")),
        "max_value": F.when(numeric, F.col("max_number")),
        "avg_length": F.when(text, F.col("avg_length")),
        "max_length": F.when(text, F.col("max_length")),
        "pattern_match_pct": _clamped(F.col("pattern_match_pct")),
    }
    # greatest/least skip NULLs, so a metric without a value has to be ruled out itself.
    guards = {"duplicate_pct": F.col("non_null") > 0, "pattern_match_pct": F.col("pattern_match_pct").isNotNull()}
    rows = [
        F.struct(
            F.lit(name).alias("metric_name"),
            F.when(guards.get(name, F.lit(True)), finite(value)).alias("metric_value"),
        )
        for name, value in per_column.items()
    ]
    columns = profile.select(
        "asset_id",
        F.col("column").alias("column_name"),
        "captured_at",
        F.inline(F.array(*rows)),
    )
    table_values = profile.groupBy("asset_id", "captured_at").agg(
        F.max("total").cast("double").alias("row_count"),
        (F.min("freshness_days") * 24.0).alias("freshness_lag_hours"),
    )
    tables = table_values.select(
        "asset_id",
        F.lit(None).cast("string").alias("column_name"),
        "captured_at",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric_name"), finite(F.col(m)).alias("metric_value"))
                    for m in policy.TABLE_DEFAULT_METRICS
                ]
            )
        ),
    )
    no_values = F.lit(None).cast("array<string>").alias("observed_values")
    order = [f.name for f in SNAPSHOTS]
    out = columns.unionByName(tables).where(F.col("metric_value").isNotNull())
    out = out.select("*", no_values).select(*order)
    if sets is not None:
        out = out.unionByName(
            sets.select(
                "asset_id",
                F.col("column").alias("column_name"),
                F.lit("observed_categories").alias("metric_name"),
                F.col("distinct_count").cast("double").alias("metric_value"),
                F.col("values").alias("observed_values"),
                "captured_at",
            )
        )
    return out


def worth_tracking(metric: Column, value: Column) -> Column:
    """Does a column metric carry a signal at all."""
    always = ("mean", "stddev", "min_value", "max_value", "avg_length", "max_length", "pattern_match_pct", "observed_categories")
    return (
        F.when(metric == "null_pct", value.between(0.5, 99.5))
        .when(metric == "distinct_count", value >= 2)
        .when(metric == "duplicate_pct", value.between(1.0, 99.0))
        .otherwise(metric.isin(*always))
    )


def _not_enrolled(candidates: DataFrame, monitored: DataFrame) -> DataFrame:
    return null_safe_join(candidates, monitored.select(*KEYS), KEYS, "left_anti")


def enroll_column_metrics(snapshots: DataFrame, monitored: DataFrame) -> DataFrame:
    """New enrolments for column metrics worth tracking. Enrolling twice adds nothing."""
    seen = (
        snapshots.where(
            F.col("column_name").isNotNull()
            & is_finite(F.col("metric_value"))
            & worth_tracking(F.col("metric_name"), F.col("metric_value"))
        )
        .select(*KEYS)
        .distinct()
    )
    return _not_enrolled(seen, monitored).withColumn("enrollment_source", F.lit("auto_column"))


def enroll_table_metrics(assets: DataFrame, monitored: DataFrame) -> DataFrame:
    """Row count and freshness for every asset that lacks them."""
    wanted = assets.select(
        "asset_id",
        F.lit(None).cast("string").alias("column_name"),
        F.explode(F.array(*[F.lit(m) for m in policy.TABLE_DEFAULT_METRICS])).alias("metric_name"),
    )
    return _not_enrolled(wanted, monitored).withColumn("enrollment_source", F.lit("auto_table"))


def backfill_enrollment(baselines: DataFrame, monitored: DataFrame) -> DataFrame:
    """Enrol everything that already has a baseline."""
    known = baselines.select(*KEYS).distinct()
    return _not_enrolled(known, monitored).withColumn("enrollment_source", F.lit("anomaly_proposal"))


def enrolled_only(snapshots: DataFrame, monitored: DataFrame) -> DataFrame:
    """Snapshots of metrics that are tracked; the others are not persisted."""
    return null_safe_join(snapshots, monitored.select(*KEYS).distinct(), KEYS, "left_semi")


def exact_medians(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, median): the exact median per group, also where one group is huge.

    A mergeable sketch brackets the median within a twentieth of a percent of the
    ranks on either side, five times its error bound (and it is exact below 10,000
    values).
    Everything below the bracket is folded into one count on the map side and
    everything above is dropped, so only the values inside the bracket are ranked.
    The ranks are exact counts; the sketch merely says where to look.
    """
    rows = df.where(is_finite(F.col(value))).select(*keys, F.col(value).cast("double").alias("v"))
    bracket = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.percentile_approx("v", [0.4995, 0.5005], 10000).alias("q"),
    )
    low, high = F.col("q")[0], F.col("q")[1]
    counted = rows.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    near = (
        null_safe_join(counted, bracket, keys)
        .where(F.col("v") <= high)
        .groupBy(*keys, "total", F.when(F.col("v") >= low, F.col("v")).alias("v"))
        .agg(F.sum("n").alias("n"))
    )
    order = W.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first())
    upto = near.withColumn("upto", F.sum("n").over(order))
    lower, upper = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    return upto.groupBy(*keys).agg(
        (
            (
                F.min(F.when(F.col("upto") >= lower, F.col("v")))
                + F.min(F.when(F.col("upto") >= upper, F.col("v")))
            )
            / 2
        ).alias("median")
    )


def baselines(
    snapshots: DataFrame,
    as_of: AsOf,
    window_days: int = policy.BASELINE_WINDOW_DAYS,
    leave_out_latest: bool = False,
) -> DataFrame:
    """Median, MAD, sample count, observed set and window per key over the last days.

    The newest snapshot is part of its own baseline unless ``leave_out_latest``.
    ``sample_count`` counts all rows, those without a value too.
    """
    keys = list(KEYS)
    window = snapshots.where(F.col("captured_at").between(days_before(as_of, window_days), moment(as_of)))
    if leave_out_latest:
        newest = window.groupBy(*keys).agg(F.max("captured_at").alias("newest"))
        window = null_safe_join(window, newest, keys).where(F.col("captured_at") < F.col("newest")).drop("newest")
    numeric = window.where(F.col("metric_name") != "observed_categories")
    medians = exact_medians(numeric, keys, "metric_value")
    spread = null_safe_join(numeric, medians, keys).select(
        *keys, F.abs(F.col("metric_value") - F.col("median")).alias("distance")
    )
    mads = exact_medians(spread, keys, "distance").withColumnRenamed("median", "mad")
    stats = window.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.min("captured_at").alias("window_start"),
        F.max("captured_at").alias("window_end"),
    )
    observed = (
        window.where(F.col("metric_name") == "observed_categories")
        .select(*keys, F.explode("observed_values").alias("value"))
        .distinct()
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("value")).alias("observed_set"))
    )
    joined = null_safe_join(stats, medians, keys, "left")
    joined = null_safe_join(joined, mads, keys, "left")
    joined = null_safe_join(joined, observed, keys, "left")
    categories = F.col("metric_name") == "observed_categories"
    return joined.where(categories | F.col("median").isNotNull()).select(
        *keys,
        "median",
        "mad",
        "sample_count",
        F.when(categories, F.coalesce("observed_set", F.array().cast("array<string>"))).alias("observed_set"),
        "window_start",
        "window_end",
    )


def latest_baselines(history: DataFrame) -> DataFrame:
    """The newest baseline of each key. ``history`` has updated_at; ties go to the larger values."""
    rest = [c for c in history.columns if c not in KEYS]
    newest = F.max(F.struct("updated_at", *[c for c in rest if c != "updated_at"])).alias("b")
    return history.groupBy(*KEYS).agg(newest).select(
        *KEYS, *[F.col(f"b.{c}").alias(c) for c in rest]
    )


def ready(baseline_rows: DataFrame) -> DataFrame:
    return baseline_rows.where(F.col("sample_count") >= policy.BASELINE_MIN_SAMPLES)


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each key, by aggregation: no series is sorted.

    Of several at one moment the one with the larger value counts.
    """
    newest = F.max(F.struct("captured_at", "metric_value", "observed_values"))
    return snapshots.groupBy(*KEYS).agg(newest.alias("s")).select(
        *KEYS,
        F.col("s.metric_value").alias("latest_value"),
        F.col("s.observed_values").alias("latest_values"),
        F.col("s.captured_at").alias("latest_at"),
    )


def _deviations() -> Column:
    return F.abs(F.col("latest_value") - F.col("median")) / F.nullif(F.col("mad"), F.lit(0.0))


def metric_anomaly(snapshots: DataFrame, baseline_rows: DataFrame, deviations: float = 3.0) -> DataFrame:
    """fail_count 1 where the latest value is more than ``deviations`` MADs off the median.

    With a MAD of 0 any difference fails; without a MAD or a value nothing does.
    """
    joined = null_safe_join(baseline_rows, latest_snapshots(snapshots), KEYS, "left")
    value, median, mad = F.col("latest_value"), F.col("median"), F.col("mad")
    failed = (
        F.when(mad.isNull() | value.isNull(), 0)
        .when(mad == 0, (value != median).cast("int"))
        .otherwise((_deviations() > deviations).cast("int"))
    )
    return joined.where(F.col("metric_name") != "observed_categories").select(
        *KEYS,
        value,
        median,
        mad,
        failed.cast("bigint").alias("fail_count"),
        F.lit(1).cast("bigint").alias("total_count"),
    )


def metric_relative_change(snapshots: DataFrame, max_pct_change: float = 25.0) -> DataFrame:
    """fail_count 1 where the last two snapshots differ by more than a percentage."""
    recent = snapshots.select(*KEYS, "captured_at", "metric_value").withColumn(
        "rank",
        F.row_number().over(W.partitionBy(*KEYS).orderBy(F.col("captured_at").desc(), F.col("metric_value").desc())),
    )
    pairs = (
        recent.where(F.col("rank") <= 2)
        .groupBy(*KEYS)
        .agg(
            F.max(F.when(F.col("rank") == 1, F.col("metric_value"))).alias("latest_value"),
            F.max(F.when(F.col("rank") == 2, F.col("metric_value"))).alias("previous_value"),
        )
    )
    now, then = F.col("latest_value"), F.col("previous_value")
    change = F.abs(now - then) * 100.0 / F.nullif(F.abs(then), F.lit(0.0))
    failed = (
        F.when(then.isNull() | now.isNull(), 0)
        .when((then == 0) & (now == 0), 0)
        .when(then == 0, 1)
        .otherwise((change > max_pct_change).cast("int"))
    )
    return pairs.select(
        *KEYS, now, then, failed.cast("bigint").alias("fail_count"), F.lit(1).cast("bigint").alias("total_count")
    )


def category_disappeared(snapshots: DataFrame, baseline_rows: DataFrame) -> DataFrame:
    """fail_count 1 where a value of the baseline set is missing from the latest one."""
    sets = baseline_rows.where(F.col("metric_name") == "observed_categories")
    latest = latest_snapshots(snapshots.where(F.col("metric_name") == "observed_categories"))
    joined = null_safe_join(sets, latest, KEYS, "left")
    missing = F.array_except(
        "observed_set", F.coalesce("latest_values", F.array().cast("array<string>"))
    )
    return joined.select(
        *KEYS,
        missing.alias("missing_values"),
        (F.size(missing) > 0).cast("bigint").alias("fail_count"),
        F.lit(1).cast("bigint").alias("total_count"),
    )


def fleet_breaches(
    snapshots: DataFrame, baseline_rows: DataFrame, min_deviations: float = 2.0, limit: int = 50
) -> DataFrame:
    """Metrics whose latest value is furthest off its mature baseline, worst first (a top-n report)."""
    if min_deviations <= 0 or limit <= 0:
        raise ValueError("min_deviations and limit must be positive")
    mature = ready(baseline_rows).where((F.col("mad") > 0) & F.col("median").isNotNull())
    found = (
        null_safe_join(mature, latest_snapshots(snapshots), KEYS)
        .withColumn("deviations", _deviations())
        .where(F.col("deviations") >= min_deviations)
        .withColumn("severity", F.when(F.col("deviations") >= 3, "breached").otherwise("watch"))
    )
    return (
        found.orderBy(F.col("deviations").desc(), *KEYS)
        .limit(limit)
        .select(*KEYS, "latest_value", "latest_at", "median", "mad", "sample_count", "deviations", "severity")
    )


def metric_status(sample_count: Column, deviations: Column) -> Column:
    return (
        F.when(sample_count < policy.BASELINE_MIN_SAMPLES, "warming_up")
        .when(deviations >= 3, "breached")
        .when(deviations >= 2, "watch")
        .otherwise("healthy")
    )


def asset_metrics(snapshots: DataFrame, baseline_rows: DataFrame, points: int = 20) -> DataFrame:
    """Each baseline with its latest value, status and the last points, oldest first."""
    if points <= 0:
        raise ValueError("points must be positive")
    ranked = snapshots.withColumn(
        "rank", F.row_number().over(W.partitionBy(*KEYS).orderBy(F.col("captured_at").desc()))
    )
    series = (
        ranked.where(F.col("rank") <= points)
        .groupBy(*KEYS)
        .agg(F.sort_array(F.collect_list(F.struct("captured_at", "metric_value"))).alias("history"))
    )
    joined = null_safe_join(baseline_rows, series, KEYS, "left").withColumn(
        "latest_value", F.element_at(F.col("history.metric_value"), -1)
    )
    return joined.withColumn("deviations", _deviations()).select(
        *KEYS,
        "median",
        "mad",
        "sample_count",
        "latest_value",
        "deviations",
        metric_status(F.col("sample_count"), F.col("deviations")).alias("status"),
        "history",
    )


def metric_history(
    snapshots: DataFrame,
    baseline_rows: DataFrame,
    breaches: DataFrame,
    asset_id: str,
    metric_name: str,
    column_name: str | None = None,
    deviations: float = 3.0,
    limit: int = 500,
) -> DataFrame:
    """The last points of one metric, oldest first, with its band and breach marks.

    ``breaches``: captured_at of the scans that raised a finding on this metric.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")

    def one(df: DataFrame) -> DataFrame:
        return df.where(
            (F.col("asset_id") == asset_id)
            & (F.col("metric_name") == metric_name)
            & F.col("column_name").eqNullSafe(F.lit(column_name))
        )

    last = one(snapshots).orderBy(F.col("captured_at").desc()).limit(limit)
    marked = last.join(
        breaches.select("captured_at").distinct().withColumn("__hit", F.lit(True)), "captured_at", "left"
    )
    band = F.lit(deviations) * F.col("mad")
    joined = null_safe_join(marked, one(baseline_rows).select(*KEYS, "median", "mad"), KEYS, "left")
    return joined.orderBy("captured_at").select(
        *KEYS,
        "captured_at",
        "metric_value",
        "median",
        (F.col("median") - band).alias("lower"),
        (F.col("median") + band).alias("upper"),
        F.coalesce("__hit", F.lit(False)).alias("is_breach"),
    )


def anomaly_proposals(
    baseline_rows: DataFrame,
    existing: DataFrame,
    proposals: DataFrame,
) -> DataFrame:
    """Rules to propose for mature baselines nothing covers yet.

    ``existing``: rule instances (asset_id, column_name, metric_name, shape) of any
    status. ``proposals``: earlier proposals with status; pending and rejected ones
    block. All are returned, with their ``rank`` by priority within the asset; who
    wants a few per scan filters by it.
    """
    names = F.array(*[F.lit(m) for m in policy.METRIC_PROPOSALS])
    chain_shape, chain_severity, chain_rank = F, F, F
    for metric, (shape, severity, rank) in policy.METRIC_PROPOSALS.items():
        chain_shape = chain_shape.when(F.col("metric_name") == metric, shape)
        chain_severity = chain_severity.when(F.col("metric_name") == metric, severity)
        chain_rank = chain_rank.when(F.col("metric_name") == metric, rank)
    candidates = ready(baseline_rows).where(F.array_contains(names, F.col("metric_name"))).select(
        *KEYS, chain_shape.alias("shape"), chain_severity.alias("severity"), chain_rank.alias("priority")
    )
    taken = existing.select(*KEYS, "shape").unionByName(
        proposals.where(F.col("status").isin("pending", "rejected")).select(*KEYS, "shape")
    )
    free = null_safe_join(candidates, taken.distinct(), [*KEYS, "shape"], "left_anti")
    order = W.partitionBy("asset_id").orderBy(
        "priority", F.col("column_name").asc_nulls_first(), "metric_name"
    )
    return (
        free.withColumn("rank", F.row_number().over(order))
        .withColumn("deviations", F.when(F.col("shape") == "metric_anomaly", F.lit(3.0)))
    )


def update_thresholds(
    instances: DataFrame, deviations: float | None = None, max_pct_change: float | None = None, instance_ids: Sequence[str] = ()
) -> DataFrame:
    """Set the two anomaly thresholds of some instances; other settings stay."""
    if deviations is None and max_pct_change is None:
        raise ValueError("no threshold given")
    if deviations is not None and not 0 < deviations <= 10:
        raise ValueError("deviations must be above 0 and at most 10")
    if max_pct_change is not None and not 0 < max_pct_change <= 1000:
        raise ValueError("max_pct_change must be above 0 and at most 1000")
    chosen = F.col("instance_id").isin(*instance_ids)
    changes: Mapping[str, float | None] = {"deviations": deviations, "max_pct_change": max_pct_change}
    out = instances
    for name, value in changes.items():
        if value is not None:
            out = out.withColumn(name, F.when(chosen, F.lit(float(value))).otherwise(F.col(name)))
    return out
