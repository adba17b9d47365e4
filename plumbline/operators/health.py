"""Health of tables and of the fleet from the execution log and the findings.

``executions``: instance_id, status, executed_at. ``instances``: instance_id,
definition_id, asset_id, database, schema, table, severity, is_active, ...
``findings``: instance_id, asset_id, status, first_detected_at, reopened_count, ...
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline import policy
from plumbline.functions.naming import severity_rank, severity_weight
from plumbline.functions.time import AsOf, days_before, moment
from plumbline.operators.lifecycle import is_open

TABLE = ("database", "schema", "table")
COUNTED = ("passed", "failed", "error")


def recent_executions(executions: DataFrame, limit: int = policy.HISTORY_LIMIT) -> DataFrame:
    """The last runs of each instance.

    The rank filter limits every task to ``limit`` rows per instance before the
    shuffle, so an instance with most of the log does not travel.
    """
    newest = W.partitionBy("instance_id").orderBy(F.col("executed_at").desc())
    return executions.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= limit)


def pass_rates(executions: DataFrame, limit: int = policy.HISTORY_LIMIT) -> DataFrame:
    """Per instance over its last runs: counts by status, pass rate, latest status and time."""
    counted = recent_executions(executions, limit).groupBy("instance_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in COUNTED],
        F.max(F.struct("executed_at", "status"))["status"].alias("latest_status"),
        F.max("executed_at").alias("last_executed_at"),
    )
    runs = F.col("passed") + F.col("failed") + F.col("error")
    return counted.withColumn("runs", runs).withColumn("pass_rate", F.col("passed") / F.nullif(runs, F.lit(0)))


def health_scores(executions: DataFrame, instances: DataFrame) -> DataFrame:
    """Severity-weighted mean pass rate per table over its active instances."""
    active = instances.where("is_active").select("instance_id", *TABLE, "severity")
    rated = active.join(pass_rates(executions), "instance_id").where(F.col("pass_rate").isNotNull())
    weight = severity_weight(F.col("severity"))
    return rated.groupBy(*TABLE).agg(
        (F.sum(weight * F.col("pass_rate")) / F.sum(weight)).alias("health_score"),
        F.count(F.lit(1)).alias("rules_rated"),
    )


def status_dot(status: Column) -> Column:
    return (
        F.when(status == "passed", "green")
        .when(status.isin("failed", "error"), "red")
        .when(status.isNull(), "gray")
        .otherwise("amber")
    )


def column_status(rules: DataFrame) -> DataFrame:
    """Worst dot per column. ``rules``: database, schema, table, columns (array), latest_status."""
    dot = status_dot(F.col("latest_status"))
    rank = F.when(dot == "red", 3).when(dot == "amber", 2).when(dot == "gray", 1).otherwise(0)
    worst = (
        rules.select(*TABLE, F.explode("columns").alias("column"), rank.alias("rank"))
        .groupBy(*TABLE, "column")
        .agg(F.max("rank").alias("rank"))
    )
    names = F.array(*[F.lit(n) for n in ("green", "gray", "amber", "red")])
    return worst.select(*TABLE, "column", F.element_at(names, F.col("rank") + 1).alias("status"))


def rule_ranking_order() -> list[Column]:
    """Sort order of a rule list: failing, erroring, not run, passed; then severity and name."""
    status = F.col("latest_status")
    rank = F.when(status == "failed", 0).when(status == "error", 1).when(status == "passed", 3).otherwise(2)
    return [rank, severity_rank(F.col("severity")), F.col("name"), F.col("instance_id")]


def daily_trend(executions: DataFrame, as_of: AsOf | None = None, days: int = 30) -> DataFrame:
    """Runs by day and status with the share passed."""
    if days <= 0:
        raise ValueError("days must be positive")
    rows = executions
    if as_of is not None:
        rows = rows.where(F.col("executed_at").between(days_before(as_of, days), moment(as_of)))
    counted = rows.groupBy(F.col("executed_at").cast("date").alias("day")).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in COUNTED]
    )
    total = F.col("passed") + F.col("failed") + F.col("error")
    return counted.select(
        "day", *COUNTED, total.alias("total"), (F.col("passed") / F.nullif(total, F.lit(0))).alias("pass_rate")
    )


def overall_health(executions: DataFrame, instances: DataFrame, as_of: AsOf, days: int = 30) -> DataFrame:
    """One row: the plain share of passed runs and the share weighted by severity."""
    rows = executions.where(
        F.col("executed_at").between(days_before(as_of, days), moment(as_of)) & F.col("status").isin(*COUNTED)
    ).select("instance_id", "status")
    weighted = rows.join(instances.select("instance_id", "severity"), "instance_id", "left")
    weight = severity_weight(F.coalesce("severity", F.lit("medium")))
    passed = (F.col("status") == "passed").cast("int")
    return weighted.agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg(passed).alias("pass_rate"),
        (F.sum(weight * passed) / F.nullif(F.sum(weight), F.lit(0))).alias("weighted_pass_rate"),
    )


def incident_counts(findings: DataFrame, instances: DataFrame) -> DataFrame:
    """Per table: open, flapping (open and reopened before), oldest open."""
    open_now = is_open(F.col("status"))
    places = instances.select("instance_id", *TABLE)
    return (
        findings.select("instance_id", "status", "reopened_count", "first_detected_at")
        .join(places, "instance_id")
        .groupBy(*TABLE)
        .agg(
            F.count_if(open_now).alias("open_findings"),
            F.count_if(open_now & (F.coalesce("reopened_count", F.lit(0)) > 0)).alias("flapping"),
            F.min(F.when(open_now, F.col("first_detected_at"))).alias("oldest_open_at"),
        )
    )


def fleet_tables(
    executions: DataFrame, findings: DataFrame, instances: DataFrame, as_of: AsOf, days: int = 30
) -> DataFrame:
    """All tables with runs in the window or findings: counts, pass rate, incidents."""
    window = executions.where(F.col("executed_at").between(days_before(as_of, days), moment(as_of)))
    # One row per instance before the join: the log itself is not shuffled to it.
    by_instance = window.groupBy("instance_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in COUNTED]
    )
    runs = (
        by_instance.join(instances.select("instance_id", *TABLE), "instance_id")
        .groupBy(*TABLE)
        .agg(*[F.sum(s).alias(s) for s in COUNTED])
    )
    joined = runs.join(incident_counts(findings, instances), list(TABLE), "full")
    zero = F.lit(0)
    total = F.coalesce("passed", zero) + F.coalesce("failed", zero) + F.coalesce("error", zero)
    return joined.select(
        *TABLE,
        total.alias("runs"),
        *[F.coalesce(s, zero).alias(s) for s in COUNTED],
        (F.coalesce("passed", zero) / F.nullif(total, zero)).alias("pass_rate"),
        F.coalesce("open_findings", zero).alias("open_findings"),
        F.coalesce("flapping", zero).alias("flapping"),
        "oldest_open_at",
    )


def worst_tables(fleet: DataFrame, top_n: int = 8) -> DataFrame:
    """Most open incidents first, then lowest pass rate (unknown counts as 1), then most failures."""
    if top_n <= 0:
        raise ValueError("top_n must be positive")
    return fleet.orderBy(
        F.col("open_findings").desc(),
        F.coalesce("pass_rate", F.lit(1.0)),
        F.col("failed").desc(),
        *TABLE,
    ).limit(top_n)


def fleet_incidents(findings: DataFrame) -> DataFrame:
    """One row for the whole fleet: open, flapping, oldest open."""
    open_now = is_open(F.col("status"))
    return findings.agg(
        F.count_if(open_now).alias("open_findings"),
        F.count_if(open_now & (F.coalesce("reopened_count", F.lit(0)) > 0)).alias("flapping"),
        F.min(F.when(open_now, F.col("first_detected_at"))).alias("oldest_open_at"),
    )


def table_rules(
    executions: DataFrame, findings: DataFrame, instances: DataFrame, mutes: DataFrame, as_of: AsOf
) -> DataFrame:
    """Every active rule with its recent runs, open finding and mute state.

    Drift monitors (``kind`` = schema_drift) appear only while they have an open
    finding. ``instances`` also has name, kind and columns.
    """
    newest = F.struct(
        F.coalesce("last_seen_at", F.lit("0001-01-01").cast("timestamp_ntz")), F.col("first_detected_at")
    )
    opened = (
        findings.where(is_open(F.col("status")))
        .groupBy("instance_id", "asset_id")
        .agg(
            F.max_by(
                F.struct("finding_id", "first_detected_at", "reopened_count", "current_fail_count", "current_total_count"),
                newest,
            ).alias("f")
        )
        .select(
            "instance_id",
            "asset_id",
            F.col("f.finding_id").alias("open_finding_id"),
            "f.first_detected_at",
            "f.reopened_count",
            "f.current_fail_count",
            "f.current_total_count",
        )
    )
    muted = (
        mutes.where(F.col("muted_until") > moment(as_of))
        .select("instance_id", "asset_id")
        .distinct()
        .withColumn("muted", F.lit(True))
    )
    rules = (
        instances.where("is_active")
        .join(pass_rates(executions), "instance_id", "left")
        .join(opened, ["instance_id", "asset_id"], "left")
        .join(muted, ["instance_id", "asset_id"], "left")
        .withColumn("muted", F.coalesce("muted", F.lit(False)))
    )
    hidden = F.col("kind").eqNullSafe(F.lit("schema_drift")) & F.col("open_finding_id").isNull()
    return rules.where(~hidden).withColumn("dot", status_dot(F.col("latest_status")))


def table_reports(rules: DataFrame) -> DataFrame:
    """One row per table on top of ``table_rules``."""
    weight = F.when(F.col("pass_rate").isNotNull(), severity_weight(F.col("severity")))
    return rules.groupBy(*TABLE).agg(
        (F.sum(weight * F.col("pass_rate")) / F.sum(weight)).alias("health_score"),
        F.count(F.lit(1)).alias("rules_total"),
        F.count_if(F.col("latest_status").isin("failed", "error")).alias("rules_failing"),
        F.count_if(F.col("latest_status") == "passed").alias("rules_passing"),
        F.count_if(F.col("latest_status").isNull()).alias("rules_unrun"),
        F.count("open_finding_id").alias("open_findings"),
        F.count_if("muted").alias("rules_muted"),
        F.max("last_executed_at").alias("last_run_at"),
    )
