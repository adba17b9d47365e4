"""Upkeep of the rule library: what to retire, what to reuse, what was learned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline import policy
from plumbline.functions.time import AsOf, days_before
from plumbline.operators.joins import null_safe_join
from plumbline.operators.metrics import KEYS as METRIC_KEYS


def reopen_history(findings: DataFrame) -> DataFrame:
    """Most reopenings of any finding per instance; superseded findings do not count."""
    return (
        findings.where((F.col("status") != "superseded") & F.col("instance_id").isNotNull())
        .groupBy("instance_id")
        .agg(F.max(F.coalesce("reopened_count", F.lit(0))).alias("max_reopened"))
    )


def flapping(findings: DataFrame) -> DataFrame:
    return reopen_history(findings).where(F.col("max_reopened") >= policy.FLAPPING_REOPENS)


def retire_candidates(executions: DataFrame, findings: DataFrame, as_of: AsOf) -> DataFrame:
    """Instances that ran lately, never failed lately and were never reopened.

    Every run counts: those of the quiet period for the numbers, the whole log for the
    last failure. One aggregation, so a rule that runs often is counted map-side.
    """
    reopened = reopen_history(findings).where(F.col("max_reopened") > 0).select("instance_id")
    return (
        _run_history(executions, as_of)
        .where(_is_quiet())
        .join(reopened, "instance_id", "left_anti")
        .select("instance_id", "recent_runs", "last_failure_at")
    )


def _run_history(executions: DataFrame, as_of: AsOf) -> DataFrame:
    """(instance_id, recent_runs, recent_failures, last_failure_at)."""
    inside = F.col("executed_at") >= days_before(as_of, policy.RETIRE_QUIET_DAYS)
    failed = F.col("status") == "failed"
    return executions.groupBy("instance_id").agg(
        F.count_if(inside).alias("recent_runs"),
        F.count_if(inside & failed).alias("recent_failures"),
        F.max(F.when(failed, F.col("executed_at"))).alias("last_failure_at"),
    )


def _is_quiet() -> Column:
    return (F.col("recent_failures") == 0) & (F.col("recent_runs") >= policy.RETIRE_MIN_RUNS)


def superseded(instances: DataFrame) -> DataFrame:
    """Active instances that a newer one with the same definition, table and target replaces.

    ``instances``: instance_id, definition_id, fqn, target_json, status, created_at.
    The winner of each target comes from an aggregation, so many instances of one
    target are not gathered in one task.
    """
    key = ["definition_id", "fqn_key", "target_json"]
    active = instances.where(F.col("status") == "active").withColumn("fqn_key", F.upper("fqn"))
    order = F.struct(F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp_ntz")), F.col("instance_id"))
    winners = active.groupBy(*key).agg(
        F.max_by("instance_id", order).alias("newer_instance_id"), F.count(F.lit(1)).alias("n")
    )
    return (
        active.join(winners.where(F.col("n") > 1), key)
        .where(F.col("instance_id") != F.col("newer_instance_id"))
        .select("instance_id", "newer_instance_id", "definition_id", F.col("fqn_key").alias("fqn"))
    )


def obsolete_targets(instances: DataFrame, assets: DataFrame) -> DataFrame:
    """Instances on tables that no longer exist."""
    known = assets.select(F.upper("fqn").alias("__fqn")).distinct()
    return instances.join(known, F.upper("fqn") == F.col("__fqn"), "left_anti").select("instance_id", "fqn")


def maintenance_sweep(
    instances: DataFrame,
    executions: DataFrame,
    findings: DataFrame,
    assets: DataFrame,
    proposals: DataFrame,
    as_of: AsOf,
) -> DataFrame:
    """New (instance_id, action) proposals.

    An obsolete target rules out flapping and retirement, flapping rules out
    retirement. A pair that is pending or was dismissed is not proposed again.
    """
    active = instances.where(F.col("status") == "active").select("instance_id", "fqn").distinct()
    known = assets.select(F.upper("fqn").alias("__fqn")).distinct().withColumn("__known", F.lit(True))
    # One row per instance and target holds all that the rules ask for; each log is aggregated once.
    judged = (
        active.join(known, F.upper("fqn") == F.col("__fqn"), "left")
        .join(reopen_history(findings), "instance_id", "left")
        .join(_run_history(executions, as_of), "instance_id", "left")
        .groupBy("instance_id")
        .agg(
            F.bool_or(F.col("__known").isNull()).alias("gone"),
            F.max(F.coalesce("max_reopened", F.lit(0))).alias("max_reopened"),
            F.bool_or(F.coalesce(_is_quiet(), F.lit(False))).alias("quiet"),
        )
    )
    action = (
        F.when(F.col("gone"), "obsolete_target")
        .when(F.col("max_reopened") >= policy.FLAPPING_REOPENS, "flapping")
        .when(F.col("quiet") & (F.col("max_reopened") == 0), "retire_candidate")
    )
    found = (
        judged.select("instance_id", action.alias("action"))
        .where(F.col("action").isNotNull())
        .unionByName(superseded(instances).select("instance_id", F.lit("superseded").alias("action")))
    )
    blocked = proposals.where(F.col("status").isin("pending", "dismissed")).select("instance_id", "action").distinct()
    return found.join(blocked, ["instance_id", "action"], "left_anti")


def action_counts(proposals: DataFrame) -> DataFrame:
    return proposals.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def apply_decisions(instances: DataFrame, approved: DataFrame) -> DataFrame:
    """Pause or retire the instances of approved proposals (instance_id, action)."""
    chain = F
    for action, status in policy.MAINTENANCE_STATUS.items():
        chain = chain.when(F.col("action") == action, status)
    # Retiring outweighs pausing if both were approved.
    new = approved.select("instance_id", chain.alias("__status")).groupBy("instance_id").agg(
        F.max("__status").alias("__status")
    )
    decided = F.col("__status").isNotNull()
    return (
        instances.join(new, "instance_id", "left")
        .withColumn("status", F.coalesce("__status", "status"))
        .withColumn("is_active", F.when(decided, F.lit(False)).otherwise(F.col("is_active")))
        .select(*instances.columns)
    )


def unenroll(monitored: DataFrame, dropped: DataFrame) -> DataFrame:
    """The enrolments left after dropping some metrics.

    ``dropped``: asset_id, column_name, metric_name of retired instances or rejected
    proposals. What a user or the table defaults enrolled stays.
    """
    sticky = monitored.where(F.col("enrollment_source").isin(*policy.STICKY_ENROLLMENTS))
    others = monitored.where(~F.col("enrollment_source").isin(*policy.STICKY_ENROLLMENTS))
    gone = dropped.where(F.col("asset_id").isNotNull() & F.col("metric_name").isNotNull()).select(*METRIC_KEYS).distinct()
    return sticky.unionByName(null_safe_join(others, gone, METRIC_KEYS, "left_anti"))


def reject_proposals(proposals: DataFrame, rejected: DataFrame) -> DataFrame:
    """Mark pending proposals as rejected. ``rejected``: proposal_id, decided_by, reason."""
    new = rejected.select(
        "proposal_id",
        F.coalesce("decided_by", F.lit("user")).alias("__by"),
        F.coalesce("reason", F.lit("")).alias("__reason"),
    )
    hit = F.col("__by").isNotNull() & (F.col("status") == "pending")
    return (
        proposals.join(new, "proposal_id", "left")
        .withColumn("decided_by", F.when(hit, F.col("__by")).otherwise(F.col("decided_by")))
        .withColumn("decision_reason", F.when(hit, F.col("__reason")).otherwise(F.col("decision_reason")))
        .withColumn("status", F.when(hit, "rejected").otherwise(F.col("status")))
        .select(*proposals.columns)
    )


def required_columns(scope: Column, column: Column, columns: Column) -> Column:
    """Columns of the target a pattern cannot do without."""
    single = F.when(F.coalesce(column, F.lit("")) != "", F.array(column))
    none = F.array().cast("array<string>")
    return (
        F.when(scope == "multi_column", F.coalesce(columns, none))
        .when(scope.isin("column", "cross_table"), F.coalesce(single, none))
        .otherwise(none)
    )


def instantiate_pack(
    patterns: DataFrame, targets: DataFrame, columns_meta: DataFrame, definitions: DataFrame
) -> DataFrame:
    """Apply the patterns of saved packs to tables.

    ``patterns``: pack_id, pattern_id, definition_id, scope, column, columns,
    asset_id. ``targets``: pack_id, table, asset_id, one row per requested
    application. ``columns_meta``: table, column. Rows come back with skip_reason
    (NULL if the pattern applies) and the asset_id of the target for anomaly scopes.
    """
    wanted = patterns.withColumnRenamed("asset_id", "__origin").join(
        targets.select("pack_id", F.col("table"), F.col("asset_id").alias("__asset")), "pack_id"
    )
    needs = wanted.select(
        "pattern_id",
        "table",
        F.posexplode(required_columns(F.col("scope"), F.col("column"), F.col("columns"))).alias("pos", "need"),
    )
    present = columns_meta.select("table", F.upper("column").alias("__have")).distinct()
    missing = (
        needs.join(
            present, (needs["table"] == present["table"]) & (F.upper(needs["need"]) == present["__have"]), "left_anti"
        )
        .groupBy("pattern_id", "table")
        .agg(F.min_by("need", "pos").alias("__missing"))
    )
    known = definitions.select("definition_id").distinct().withColumn("__known", F.lit(True))
    joined = wanted.join(missing, ["pattern_id", "table"], "left").join(known, "definition_id", "left")
    anomaly = F.col("scope").isin("anomaly", "anomaly_column")
    return joined.select(
        *[c for c in patterns.columns if c != "asset_id"],
        "table",
        F.when(anomaly, F.col("__asset")).otherwise(F.col("__origin")).alias("asset_id"),
        F.when(
            F.col("__missing").isNotNull(),
            F.concat(F.lit("column "), F.col("__missing"), F.lit(" not found")),
        )
        .when(F.col("__known").isNull(), "definition not found")
        .alias("skip_reason"),
    )


def _active(instances: DataFrame) -> DataFrame:
    return instances.where((F.col("status") == "active") & F.col("is_active"))


def capture_pack(
    instances: DataFrame,
    database: str,
    schema: str,
    table: str,
    pick_definitions: Sequence[str] = (),
    pick_instances: Sequence[str] = (),
) -> DataFrame:
    """The active instances of a table and the global ones (database ``*``), each once.

    Lists of picked definitions or instances narrow the choice.
    """
    here = (F.col("database") == database) & (F.col("schema") == schema) & (F.col("table") == table)
    chosen = _active(instances).where(here | (F.col("database") == "*"))
    if pick_instances:
        chosen = chosen.where(F.col("instance_id").isin(*pick_instances))
    if pick_definitions:
        chosen = chosen.where(F.col("definition_id").isin(*pick_definitions))
    return chosen.dropDuplicates(["instance_id"])


def effective_rules(pack: DataFrame, instances: DataFrame, table: str) -> DataFrame:
    """Instances a pack run executes, by id.

    ``pack``: instance_id, fingerprint of the instantiated patterns. An active
    instance with the same fingerprint is reused instead. All other active
    instances of the table and the global ones run too.
    """
    active = _active(instances)
    same = active.groupBy("fingerprint").agg(F.min("instance_id").alias("__existing"))
    own = pack.join(same, "fingerprint", "left").select(
        F.coalesce("__existing", "instance_id").alias("instance_id")
    )
    others = active.where((F.col("table") == table) | (F.col("database") == "*")).select("instance_id")
    return own.unionByName(others).distinct()


def bare_name(fqn: Column) -> Column:
    return F.upper(F.element_at(F.split(fqn, r"\."), -1))


def similar_tables(logs: DataFrame, focus: str, limit: int = 5) -> DataFrame:
    """Logs of tables like ``focus``: same name (3), shared keyword (2), same type with approvals (1).

    ``logs``: table_fqn, table_type, approved_count, created_at, thinking. Higher
    tiers first, then approvals, then the newest: a top-n report.
    """
    name = focus.upper().split(".")[-1]
    words = [w for w in name.split("_") if len(w) > 3]
    keyword = words[0] if words else name
    newest = logs.where(F.col("table_fqn") == focus).agg(F.max_by("table_type", "created_at")).first()
    focus_type = newest[0] if newest else None
    bare = bare_name(F.col("table_fqn"))
    tier = (
        F.when(bare == name, 3)
        .when(F.contains(bare, F.lit(keyword)), 2)
        .when((F.col("table_type") == F.lit(focus_type)) & (F.col("approved_count") > 0), 1)
        .otherwise(0)
    )
    return (
        logs.where((F.col("table_fqn") != focus) & (F.length(F.coalesce("thinking", F.lit(""))) > 0))
        .withColumn("tier", tier)
        .where(F.col("tier") > 0)
        .orderBy(F.col("tier").desc(), F.col("approved_count").desc(), F.col("created_at").desc(), "table_fqn")
        .limit(limit)
    )


def lesson_feed(lessons: DataFrame, limit: int | None = None) -> DataFrame:
    """Review lessons per bare table name, with ``recency`` 1 for the latest.

    ``lessons``: lesson_id, table_fqn, created_at, ... ``limit`` keeps the latest few per table.
    """
    newest = W.partitionBy("bare_table").orderBy(F.col("created_at").desc(), F.col("lesson_id").desc())
    ranked = lessons.withColumn("bare_table", bare_name(F.col("table_fqn"))).withColumn(
        "recency", F.row_number().over(newest)
    )
    return ranked if limit is None else ranked.where(F.col("recency") <= limit)


def verdict_counts(lessons: DataFrame) -> DataFrame:
    """Approvals and rejections per bare table name and concept."""
    return lessons.groupBy(bare_name(F.col("table_fqn")).alias("bare_table"), "check_concept").agg(
        F.count_if(F.col("verdict") == "approved").alias("approved"),
        F.count_if(F.col("verdict") == "rejected").alias("rejected"),
    )


def relevant_definitions(
    definitions: DataFrame, column_names: Sequence[str], cap: int | None = None
) -> DataFrame:
    """How well definitions suit a table's columns: two points per shared word plus the approval rate.

    Best first; ``cap`` keeps the best few.

    ``definitions``: definition_id, name, description, approvals, rejections.
    """
    words = sorted({w.lower() for c in column_names for w in c.replace("_", " ").split()})
    text = F.concat_ws(" ", "name", F.coalesce("description", F.lit("")))
    tokens = F.array_distinct(
        F.transform(F.regexp_extract_all(text, F.lit(f"({policy.RELEVANCE_TOKEN})"), 1), lambda t: F.lower(t))
    )
    shared = F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in words]).cast("array<string>")))
    decided = F.coalesce("approvals", F.lit(0)) + F.coalesce("rejections", F.lit(0))
    rate = F.coalesce("approvals", F.lit(0)) / F.nullif(decided, F.lit(0))
    score = shared * 2.0 + F.coalesce(rate, F.lit(0.0))
    ordered = definitions.select("definition_id", score.alias("score")).orderBy(F.col("score").desc(), "definition_id")
    return ordered if cap is None else ordered.limit(cap)


def signals_missed(expected: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Expected signal ids nothing evaluated."""
    return expected.select("signal_id").distinct().join(evaluated.select("signal_id"), "signal_id", "left_anti")


def expected_signals(key_candidates: DataFrame, freshness: DataFrame) -> DataFrame:
    """Signal ids of key columns and temporal columns."""
    keys = key_candidates.select(F.concat(F.lit("uniqueness:"), F.col("column")).alias("signal_id"))
    return keys.unionByName(freshness.select("signal_id"))
