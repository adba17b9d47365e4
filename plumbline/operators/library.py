"""Counts over findings and the rule library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.lifecycle import is_open

SEVERITIES = ("critical", "high", "medium", "low", "info")


def _grouped_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(dimension, value, n): the total and the counts by each column, in one pass.

    The value columns are folded into one before the shuffle, so every row costs
    at most one counter per dimension and map task.
    """
    cells = [F.struct(F.lit("total").alias("dimension"), F.lit(None).cast("string").alias("value"))]
    cells += [
        F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns
    ]
    return df.select(F.inline(F.array(*cells))).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def findings_summary(findings: DataFrame) -> DataFrame:
    """Total, by status and by severity; superseded rows do not count."""
    return _grouped_counts(findings.where(F.col("status") != "superseded"), ["status", "severity"])


def findings_by_table(findings: DataFrame, assets: DataFrame) -> DataFrame:
    """Unresolved findings per table with a column per severity, and per database (table NULL)."""
    named = (
        findings.where(F.col("status") != "resolved")
        .select("asset_id", "severity")
        .join(assets.select("asset_id", "database", "table", "fqn"), "asset_id")
        .select(
            F.coalesce("database", F.lit("Unknown")).alias("database"),
            F.coalesce("table", "fqn", F.lit("Unknown")).alias("table"),
            "severity",
        )
    )
    return named.rollup("database", "table").agg(
        F.grouping("table").alias("is_database"),
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES],
    ).where(F.col("database").isNotNull())


def rule_stats(rules: DataFrame) -> DataFrame:
    """Counts by category, severity and status (no status counts as active) and the number active."""
    named = rules.withColumn("status", F.coalesce("status", F.lit("active")))
    active = named.select(F.when(F.col("is_active"), "yes").otherwise("no").alias("active"), "category", "severity", "status")
    return _grouped_counts(active, ["category", "severity", "status", "active"])


def rule_coverage(instances: DataFrame, findings: DataFrame) -> DataFrame:
    """Active instances, how many have an open finding and how many do not."""
    failing = (
        findings.where(is_open(F.col("status"))).groupBy("instance_id").agg(F.lit(True).alias("open"))
    )
    return (
        instances.where(F.col("status") == "active")
        .select("instance_id")
        .join(failing, "instance_id", "left")
        .agg(
            F.count(F.lit(1)).alias("active"),
            F.count("open").alias("failing"),
            F.count_if(F.col("open").isNull()).alias("passing"),
        )
    )


def _per_instance(findings: DataFrame) -> DataFrame:
    """Findings per (instance, asset), superseded left out: small before it is joined."""
    return (
        findings.where(F.col("status") != "superseded")
        .groupBy("instance_id", "asset_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def findings_per_definition(findings: DataFrame, instances: DataFrame) -> DataFrame:
    return (
        _per_instance(findings)
        .join(instances.select("instance_id", "definition_id"), "instance_id")
        .groupBy("definition_id")
        .agg(F.sum("n").alias("n"))
    )


def top_assets_per_definition(
    findings: DataFrame, instances: DataFrame, assets: DataFrame, top_n: int = 3
) -> DataFrame:
    counted = (
        _per_instance(findings)
        .join(instances.select("instance_id", "definition_id"), "instance_id")
        .join(assets.select("asset_id", "fqn"), "asset_id")
        .groupBy("definition_id", "fqn")
        .agg(F.sum("n").alias("n"))
    )
    order = W.partitionBy("definition_id").orderBy(F.col("n").desc(), "fqn")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def instance_counts(instances: DataFrame) -> DataFrame:
    return instances.groupBy("definition_id").agg(F.count(F.lit(1)).alias("n"))


def preferred_definition(definitions: DataFrame, instances: DataFrame) -> DataFrame:
    """Per shape the enabled definition with most active instances; the oldest wins a tie."""
    active = (
        instances.where(F.col("status") == "active")
        .groupBy("definition_id")
        .agg(F.count(F.lit(1)).alias("active_count"))
    )
    ranked = (
        definitions.where(F.col("status") != "disabled")
        .join(active, "definition_id", "left")
        .withColumn("active_count", F.coalesce("active_count", F.lit(0)))
    )
    best = F.min_by(
        F.struct("definition_id", "active_count"), F.struct(-F.col("active_count"), F.col("created_at"), F.col("definition_id"))
    )
    return ranked.groupBy("shape").agg(best.alias("b")).select("shape", "b.definition_id", "b.active_count")


def table_activity(findings: DataFrame, executions: DataFrame, instances: DataFrame, assets: DataFrame) -> DataFrame:
    """Open findings and runs of active rules per asset."""
    opened = (
        findings.where(is_open(F.col("status"))).groupBy("asset_id").agg(F.count(F.lit(1)).alias("open_findings"))
    )
    per_instance = executions.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n"))
    runs = (
        instances.where("is_active")
        .select("instance_id", "asset_id")
        .join(per_instance, "instance_id")
        .groupBy("asset_id")
        .agg(F.sum("n").alias("rules_run"))
    )
    return (
        assets.select("asset_id", "fqn")
        .join(opened, "asset_id", "left")
        .join(runs, "asset_id", "left")
        .na.fill(0, ["open_findings", "rules_run"])
    )


def run_targets(runs: DataFrame) -> DataFrame:
    return runs.select("database", "schema", "table").distinct()


def severity_counts(results: DataFrame, by: Sequence[str | Column] = ()) -> DataFrame:
    """Failing results by severity (per scan, if ``by`` names it)."""
    return results.where(F.col("fail_count") > 0).groupBy(*by, "severity").agg(F.count(F.lit(1)).alias("n"))


def run_status_counts(runs: DataFrame) -> DataFrame:
    """One row: completed, failed and still active runs."""
    status = F.col("status")
    return runs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(status == "completed").alias("completed"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(~status.isin("completed", "failed")).alias("active"),
    )


def fleet_tiles(fleet: DataFrame, coverage: DataFrame, metric_rows: DataFrame) -> DataFrame:
    """One row of dashboard numbers.

    ``fleet`` from ``fleet_tables``, ``coverage`` from ``rule_coverage``,
    ``metric_rows`` with the status of each tracked metric. Each input is reduced
    to one row first.
    """
    none = F.lit(0).cast("bigint")

    def row(df: DataFrame, **values: Column) -> DataFrame:
        names = ("tables_with_failures", "unhealthy_tables", "active", "passing", "breached", "watch")
        return df.agg(*[F.coalesce(values.get(n, none), none).alias(n) for n in names])

    parts = row(
        fleet,
        tables_with_failures=F.count_if(F.col("failed") > 0),
        unhealthy_tables=F.count_if(F.col("open_findings") > 0),
    )
    parts = parts.unionByName(row(coverage, active=F.sum("active"), passing=F.sum("passing")))
    parts = parts.unionByName(
        row(
            metric_rows,
            breached=F.count_if(F.col("status") == "breached"),
            watch=F.count_if(F.col("status") == "watch"),
        )
    )
    sums = parts.agg(*[F.sum(c).alias(c) for c in parts.columns])
    return sums.select(
        "tables_with_failures",
        "unhealthy_tables",
        "breached",
        "watch",
        F.round(F.col("passing") * 100.0 / F.nullif(F.col("active"), F.lit(0)), 1).alias("passing_pct"),
    )
