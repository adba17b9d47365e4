"""Incidents: created, updated, resolved, reopened, muted.

``finalize_scan`` applies one scan to the findings table. ``replay`` derives the
same events for a whole execution log at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import policy
from plumbline.functions.time import AsOf, days_before, moment

KEY = ("instance_id", "asset_id")
OPEN = ("open", "reopened")

HISTORY_ENTRY = T.StructType(
    [
        T.StructField("scan_id", T.StringType()),
        T.StructField("at", T.TimestampNTZType()),
        T.StructField("fail_count", T.LongType()),
        T.StructField("total_count", T.LongType()),
        T.StructField("event", T.StringType()),
    ]
)
FINDINGS = T.StructType(
    [
        T.StructField("finding_id", T.StringType()),
        T.StructField("instance_id", T.StringType()),
        T.StructField("asset_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("assignee", T.StringType()),
        T.StructField("first_detected_at", T.TimestampNTZType()),
        T.StructField("last_seen_at", T.TimestampNTZType()),
        T.StructField("resolved_at", T.TimestampNTZType()),
        T.StructField("closed_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
        T.StructField("resolution_notes", T.StringType()),
        T.StructField("scan_id", T.StringType()),
        T.StructField("last_scan_id", T.StringType()),
        T.StructField("current_fail_count", T.LongType()),
        T.StructField("current_total_count", T.LongType()),
        T.StructField("fail_history", T.ArrayType(HISTORY_ENTRY)),
        T.StructField("reopened_count", T.LongType()),
    ]
)


def is_open(status: Column) -> Column:
    return status.isin(*OPEN)


def append_history(history: Column, entry: Column, keep: int = policy.FAIL_HISTORY_MAX) -> Column:
    """Append an entry and keep the last ``keep``."""
    longer = F.concat(F.coalesce(history, F.array().cast(T.ArrayType(HISTORY_ENTRY))), F.array(entry))
    return F.when(F.size(longer) > keep, F.slice(longer, -keep, keep)).otherwise(longer)


def refreshed_description(description: Column, fail: Column, total: Column) -> Column:
    """Bring the leading ``N of M rows fail this check.`` up to date; other text stays."""
    prefix = F.concat(
        fail.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" rows fail this check.")
    )
    rewritten = F.regexp_replace(description, F.lit(r"^\d+ of \d+ rows fail this check\."), prefix)
    return F.when(total > 0, rewritten).otherwise(description)


def active_mutes(mutes: DataFrame, as_of: AsOf) -> DataFrame:
    return mutes.where(F.col("muted_until") > moment(as_of)).select(*KEY).distinct()


def latest_open(findings: DataFrame) -> DataFrame:
    """The open finding of each (instance, asset): last seen, then first detected last."""
    newest = F.struct(
        F.coalesce("last_seen_at", F.lit("0001-01-01").cast("timestamp_ntz")), F.col("first_detected_at"), F.col("finding_id")
    )
    return (
        findings.where(is_open(F.col("status")))
        .groupBy(*KEY)
        .agg(F.max_by("finding_id", newest).alias("open_id"))
    )


def recently_resolved(findings: DataFrame, as_of: AsOf, days: int = policy.REOPEN_WINDOW_DAYS) -> DataFrame:
    """The finding of each (instance, asset) resolved last, if within ``days``."""
    ended = F.coalesce("resolved_at", "closed_at", "updated_at")
    return (
        findings.where((F.col("status") == "resolved") & (ended >= days_before(as_of, days)))
        .groupBy(*KEY)
        .agg(F.max_by("finding_id", F.struct(ended, F.col("finding_id"))).alias("resolved_id"))
    )


def _entry(scan_id: str, as_of: AsOf, fail: Column, total: Column, event: Column) -> Column:
    return F.struct(
        F.lit(scan_id).alias("scan_id"),
        moment(as_of).alias("at"),
        fail.cast("bigint").alias("fail_count"),
        total.cast("bigint").alias("total_count"),
        event.cast("string").alias("event"),
    )


def finalize_scan(
    findings: DataFrame,
    results: DataFrame,
    executed: DataFrame,
    mutes: DataFrame,
    scan_id: str,
    as_of: AsOf,
    reopen_days: int = policy.REOPEN_WINDOW_DAYS,
) -> tuple[DataFrame, DataFrame]:
    """(findings after the scan, events of the scan).

    ``results``: instance_id, asset_id, severity, title, description, fail_count,
    total_count of every failing check. ``executed``: instance_id of every check
    that ran. Running the same scan twice changes nothing the second time.

    * failing with an open finding: updated; recently resolved: reopened; else created;
    * an instance that ran and failed nowhere resolves its open findings on any asset;
    * a muted failure is skipped (event ``muted``), a muted pass still resolves.
    """
    now = moment(as_of)
    # One result per key, the same one whenever a task is repeated.
    worst = F.max(F.struct("fail_count", "total_count", "severity", "title", "description"))
    failing = results.groupBy(*KEY).agg(worst.alias("r")).select(*KEY, "r.*")
    muted = active_mutes(mutes, as_of).withColumn("muted", F.lit(True))
    judged = (
        failing.join(muted, list(KEY), "left")
        .join(latest_open(findings), list(KEY), "left")
        .join(recently_resolved(findings, as_of, reopen_days), list(KEY), "left")
        .withColumn(
            "event",
            F.when(F.col("muted"), "muted")
            .when(F.col("open_id").isNotNull(), "updated")
            .when(F.col("resolved_id").isNotNull(), "reopened")
            .otherwise("created"),
        )
        .withColumn(
            "finding_id",
            F.when(F.col("event") == "created", F.sha2(F.concat_ws("|", F.lit(scan_id), *KEY), 256))
            .when(F.col("event") == "reopened", F.col("resolved_id"))
            .otherwise(F.col("open_id")),
        )
    )
    passed = (
        executed.select("instance_id")
        .distinct()
        .join(results.select("instance_id").distinct(), "instance_id", "left_anti")
    )
    resolved = findings.where(is_open(F.col("status"))).join(passed, "instance_id", "left_semi")

    changes = judged.where(F.col("event").isin("updated", "reopened")).select(
        "finding_id",
        F.col("event").alias("__event"),
        F.col("fail_count").alias("__fail"),
        F.col("total_count").alias("__total"),
        F.col("severity").alias("__severity"),
    )
    changes = changes.unionByName(
        resolved.select(
            "finding_id",
            F.lit("resolved").alias("__event"),
            F.lit(0).cast("bigint").alias("__fail"),
            F.col("current_total_count").alias("__total"),
            F.lit(None).cast("string").alias("__severity"),
        )
    )
    merged = findings.join(changes, "finding_id", "left").withColumn(
        # A second run of the same scan finds its own mark and stops here.
        "__event",
        F.when(~F.col("last_scan_id").eqNullSafe(F.lit(scan_id)), F.col("__event")),
    )
    event = F.col("__event")
    failed, reopened, solved = event.isin("updated", "reopened"), event == "reopened", event == "resolved"
    fail, total = F.col("__fail"), F.col("__total")

    def changed(test: Column, value: Column, name: str) -> Column:
        return F.when(test, value).otherwise(F.col(name)).alias(name)

    def cleared(name: str) -> Column:
        return F.when(F.coalesce(reopened, F.lit(False)), F.lit(None)).otherwise(F.col(name))

    values = {
        "status": F.when(reopened, "reopened").when(solved, "resolved").otherwise(F.col("status")),
        "severity": F.when(failed, F.coalesce("__severity", "severity")).otherwise(F.col("severity")),
        "description": F.when(failed, refreshed_description(F.col("description"), fail, total)).otherwise(
            F.col("description")
        ),
        "last_seen_at": F.when(failed, now).otherwise(F.col("last_seen_at")),
        "resolved_at": F.when(solved, now).otherwise(cleared("resolved_at")),
        "closed_at": cleared("closed_at"),
        "updated_at": F.when(event.isNotNull(), now).otherwise(F.col("updated_at")),
        "resolution_notes": F.when(
            solved, F.coalesce("resolution_notes", F.lit(policy.RESCAN_NOTE))
        ).otherwise(cleared("resolution_notes")),
        "last_scan_id": F.when(event.isNotNull(), F.lit(scan_id)).otherwise(F.col("last_scan_id")),
        "current_fail_count": F.when(failed, fail).otherwise(F.col("current_fail_count")),
        "current_total_count": F.when(failed, total).otherwise(F.col("current_total_count")),
        "fail_history": F.when(
            failed,
            append_history(
                F.col("fail_history"), _entry(scan_id, as_of, fail, total, F.when(reopened, F.lit("reopened")))
            ),
        ).otherwise(F.col("fail_history")),
        "reopened_count": F.when(reopened, F.coalesce("reopened_count", F.lit(0)) + 1).otherwise(
            F.col("reopened_count")
        ),
    }
    kept = merged.select(
        *[values[f.name].cast(f.dataType).alias(f.name) if f.name in values else F.col(f.name) for f in FINDINGS]
    )
    created = judged.where(F.col("event") == "created").select(
        "finding_id",
        *KEY,
        F.lit("open").alias("status"),
        "severity",
        "title",
        "description",
        F.lit(None).cast("string").alias("assignee"),
        now.alias("first_detected_at"),
        now.alias("last_seen_at"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
        F.lit(None).cast("timestamp_ntz").alias("closed_at"),
        now.alias("updated_at"),
        F.lit(None).cast("string").alias("resolution_notes"),
        F.lit(scan_id).alias("scan_id"),
        F.lit(scan_id).alias("last_scan_id"),
        F.col("fail_count").cast("bigint").alias("current_fail_count"),
        F.col("total_count").cast("bigint").alias("current_total_count"),
        F.array(_entry(scan_id, as_of, F.col("fail_count"), F.col("total_count"), F.lit(None))).alias("fail_history"),
        F.lit(0).cast("bigint").alias("reopened_count"),
    )
    after = kept.unionByName(created)

    before = findings.select(
        "finding_id",
        "last_scan_id",
        F.col("current_fail_count").alias("prev_fail_count"),
        F.col("current_total_count").alias("prev_total_count"),
    )
    failures = judged.join(before, "finding_id", "left").where(
        ~F.coalesce(F.col("last_scan_id") == F.lit(scan_id), F.lit(False))
    )
    events = failures.select(
        "finding_id",
        "event",
        *KEY,
        F.when(F.col("event") != "muted", F.col("prev_fail_count")).alias("prev_fail_count"),
        F.when(F.col("event") != "muted", F.col("prev_total_count")).alias("prev_total_count"),
        F.col("fail_count").cast("bigint").alias("curr_fail_count"),
        F.col("total_count").cast("bigint").alias("curr_total_count"),
    ).unionByName(
        resolved.where(~F.col("last_scan_id").eqNullSafe(F.lit(scan_id))).select(
            "finding_id",
            F.lit("resolved").alias("event"),
            *KEY,
            F.col("current_fail_count").alias("prev_fail_count"),
            F.col("current_total_count").alias("prev_total_count"),
            F.lit(0).cast("bigint").alias("curr_fail_count"),
            F.col("current_total_count").alias("curr_total_count"),
        )
    )
    return after, events


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def replay(
    executions: DataFrame,
    reopen_days: int = policy.REOPEN_WINDOW_DAYS,
    chunk: str = "month",
) -> DataFrame:
    """Lifecycle events of an execution log.

    ``executions``: instance_id, asset_id, executed_at (distinct per key), status,
    severity, fail_count, total_count. Adds event (NULL for a pass with nothing
    open), incident_no (NULL before the first failure) and the previous counts.

    The log is cut into chunks of time. Rows are sorted within (key, chunk) only;
    what a chunk needs to know of earlier ones (did the last run fail, when was
    the last resolution, how many incidents so far) is carried over through one
    summary row per chunk. So an instance with a third of all runs is spread over
    as many tasks as it has chunks.
    """
    part = [*KEY, "chunk"]
    within = W.partitionBy(*part).orderBy("executed_at")
    earlier = within.rowsBetween(W.unboundedPreceding, -1)
    chunks = W.partitionBy(*KEY).orderBy("chunk")
    earlier_chunks = chunks.rowsBetween(W.unboundedPreceding, -1)
    failing, at = F.col("failing"), F.col("executed_at")
    counts = F.when(failing, F.struct("fail_count", "total_count"))

    def reopenable(resolved: Column, start: Column) -> Column:
        return F.coalesce(resolved >= start - F.expr(f"INTERVAL '{int(reopen_days)}' DAY"), F.lit(False))

    # What a row can know from its own chunk. "start" is the first failure of a run of failures.
    rows = (
        executions.where(F.col("status").isin("passed", "failed"))
        .select(
            *KEY,
            "executed_at",
            "severity",
            "fail_count",
            "total_count",
            (F.col("status") == "failed").alias("failing"),
            F.trunc(at.cast("date"), chunk).alias("chunk"),
        )
        .withColumn("prev", F.lag("failing").over(within))
        .withColumn("solved", F.when(~failing & F.col("prev"), at))
        .withColumn("solved_in", F.max("solved").over(earlier))
        .withColumn("counts_in", F.last(counts, ignorenulls=True).over(earlier))
        .withColumn("start", failing & ~F.coalesce("prev", F.lit(False)))
    )
    # A start after a resolution in the chunk is settled there; at most the first one is not.
    settled = F.col("solved_in").isNotNull()
    carried = (
        rows.groupBy(*part)
        .agg(
            F.min("executed_at").alias("first_at"),
            F.min_by("failing", "executed_at").alias("first_failing"),
            F.max_by("failing", "executed_at").alias("ends_failing"),
            F.max_by(counts, F.when(failing, at)).alias("end_counts"),
            F.max("solved").alias("solved"),
            F.min(F.when(F.col("start") & ~settled, at)).alias("first_start"),
            F.count_if(F.col("start") & settled & ~reopenable(F.col("solved_in"), at)).alias("created"),
        )
        .withColumn("was_failing", F.coalesce(F.lag("ends_failing").over(chunks), F.lit(False)))
        .withColumn("was_counts", F.last("end_counts", ignorenulls=True).over(earlier_chunks))
        .withColumn("solved_at_entry", F.when(~F.col("first_failing") & F.col("was_failing"), F.col("first_at")))
        .withColumn(
            "solved_before", F.max(F.greatest("solved", "solved_at_entry")).over(earlier_chunks)
        )
        .withColumn(
            "first_is_new",
            F.col("first_start").isNotNull()
            & ~(F.col("was_failing") & F.col("first_failing"))
            & ~reopenable(F.coalesce("solved_at_entry", "solved_before"), F.col("first_start")),
        )
        .withColumn(
            "incidents_before",
            F.coalesce(
                F.sum(F.col("created") + F.col("first_is_new").cast("bigint")).over(earlier_chunks), F.lit(0)
            ),
        )
        .select(*part, "first_at", "was_failing", "was_counts", "solved_at_entry", "solved_before", "incidents_before")
    )
    before = F.coalesce("prev", "was_failing")
    last_solved = F.coalesce(
        F.col("solved_in"), F.when(at > F.col("first_at"), F.col("solved_at_entry")), F.col("solved_before")
    )
    known = (
        rows.join(carried, part)
        .withColumn(
            "event",
            F.when(failing & before, "updated")
            .when(failing & reopenable(last_solved, at), "reopened")
            .when(failing, "created")
            .when(before, "resolved"),
        )
        .withColumn("last_counts", F.coalesce("counts_in", "was_counts"))
    )
    started = F.coalesce((F.col("event") == "created").cast("bigint"), F.lit(0))
    number = F.col("incidents_before") + F.sum(started).over(within)
    return known.select(
        *KEY,
        "executed_at",
        "severity",
        "event",
        F.nullif(number, F.lit(0)).alias("incident_no"),
        F.when(F.col("event") != "created", F.col("last_counts.fail_count")).alias("prev_fail_count"),
        F.when(F.col("event") != "created", F.col("last_counts.total_count")).alias("prev_total_count"),
        F.when(failing, F.col("fail_count")).otherwise(F.lit(0)).alias("curr_fail_count"),
        F.col("total_count").alias("curr_total_count"),
    )


def incidents(events: DataFrame) -> DataFrame:
    """The findings a replayed log leaves behind, one row per (instance, asset, incident)."""
    failing = F.col("event").isin("created", "updated", "reopened")
    counted = (
        events.where(F.col("event").isNotNull())
        .groupBy(*KEY, "incident_no")
        .agg(
            F.max_by("event", "executed_at").alias("last_event"),
            F.max("executed_at").alias("updated_at"),
            F.min("executed_at").alias("first_detected_at"),
            F.max(F.when(failing, F.col("executed_at"))).alias("last_seen_at"),
            F.max_by(F.when(failing, F.col("curr_fail_count")), F.when(failing, F.col("executed_at"))).alias(
                "current_fail_count"
            ),
            F.max_by(F.when(failing, F.col("curr_total_count")), F.when(failing, F.col("executed_at"))).alias(
                "current_total_count"
            ),
            F.max_by(F.when(failing, F.col("severity")), F.when(failing, F.col("executed_at"))).alias("severity"),
            F.count_if(F.col("event") == "reopened").alias("reopened_count"),
            F.count_if(failing).alias("failures"),
        )
    )
    resolved = F.col("last_event") == "resolved"
    return counted.select(
        F.concat_ws("#", "instance_id", "asset_id", F.col("incident_no").cast("string")).alias("finding_id"),
        *KEY,
        "incident_no",
        F.when(resolved, "resolved")
        .when(F.col("reopened_count") > 0, "reopened")
        .otherwise("open")
        .alias("status"),
        "severity",
        "first_detected_at",
        "last_seen_at",
        F.when(resolved, F.col("updated_at")).alias("resolved_at"),
        "updated_at",
        "current_fail_count",
        "current_total_count",
        "reopened_count",
        "failures",
    )


def to_findings(incident_rows: DataFrame) -> DataFrame:
    """Replayed incidents in the layout of the findings table (history left empty)."""
    present = set(incident_rows.columns)
    return incident_rows.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in FINDINGS
        ]
    )


def verification_rescan(
    findings: DataFrame, firing: DataFrame, checked: DataFrame, as_of: AsOf
) -> DataFrame:
    """Resolve open findings whose instance was re-run and no longer fires.

    ``firing`` / ``checked``: instance_id. Findings without an instance, or whose
    definition was disabled and hence not re-run, stay open.
    """
    fires = firing.select("instance_id").distinct().withColumn("__fires", F.lit(True))
    ran = checked.select("instance_id").distinct().withColumn("__ran", F.lit(True))
    solved = is_open(F.col("status")) & F.col("__ran").isNotNull() & F.col("__fires").isNull()
    return (
        findings.join(fires, "instance_id", "left")
        .join(ran, "instance_id", "left")
        .withColumn("resolved_at", F.when(solved, moment(as_of)).otherwise(F.col("resolved_at")))
        .withColumn("updated_at", F.when(solved, moment(as_of)).otherwise(F.col("updated_at")))
        .withColumn("resolution_notes", F.when(solved, F.lit(policy.VERIFICATION_NOTE)).otherwise(F.col("resolution_notes")))
        .withColumn("last_scan_id", F.when(solved, F.lit("verification")).otherwise(F.col("last_scan_id")))
        .withColumn("status", F.when(solved, "resolved").otherwise(F.col("status")))
        .select(*findings.columns)
    )


def update_findings(findings: DataFrame, updates: DataFrame, as_of: AsOf) -> DataFrame:
    """Manual changes. ``updates``: finding_id, status, assignee, resolution_notes; NULL keeps a value."""
    new = updates.select(
        "finding_id",
        F.col("status").alias("__status"),
        F.col("assignee").alias("__assignee"),
        F.col("resolution_notes").alias("__notes"),
        F.lit(True).alias("__touched"),
    )
    newly = (F.col("__status") == "resolved") & (F.col("status") != "resolved")
    return (
        findings.join(new, "finding_id", "left")
        .withColumn("resolved_at", F.when(newly, moment(as_of)).otherwise(F.col("resolved_at")))
        .withColumn("updated_at", F.when(F.col("__touched"), moment(as_of)).otherwise(F.col("updated_at")))
        .withColumn("status", F.coalesce("__status", "status"))
        .withColumn("assignee", F.coalesce("__assignee", "assignee"))
        .withColumn("resolution_notes", F.coalesce("__notes", "resolution_notes"))
        .select(*findings.columns)
    )


def sweep_stale_proposals(instances: DataFrame, tables: Sequence[str], run_id: str) -> DataFrame:
    """Reject instances of these tables still pending from another run."""
    stale = (
        F.col("table").isin(*tables)
        & (F.col("status") == "pending")
        & ~F.col("run_id").eqNullSafe(F.lit(run_id))
    )
    return instances.withColumn(
        "rejection_reason", F.when(stale, policy.STALE_PROPOSAL_REASON).otherwise(F.col("rejection_reason"))
    ).withColumn("status", F.when(stale, "rejected").otherwise(F.col("status")))
