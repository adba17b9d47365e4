"""Incident lifecycle over runs derived from the shipments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import policy
from plumbline.operators import checks, lifecycle
from plumbline.plans import derived
from plumbline.plans.derived import EVENTS_CTE, EXECUTIONS_CTE, FINDINGS_CTE, INSTANCES_CTE, PLACES_CTE, RUNS_SQL, STATE_CTES
from plumbline.plans.registry import query
from plumbline.session import stored
from plumbline.sources import state


@query("grouped_rule_runs", f"WITH {EXECUTIONS_CTE} SELECT * FROM executions")
def grouped_rule_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.executions(spark, sf_dir)


@query(
    "execution_log",
    f"""WITH {INSTANCES_CTE}, {EXECUTIONS_CTE}
        SELECT i.instance_id, CASE WHEN e.instance_id IS NULL THEN 'passed' ELSE 'failed' END AS status,
               e.fail_count, e.total_count, TIMESTAMP '2001-03-01 00:00:00' AS executed_at
        FROM instances i LEFT JOIN executions e ON e.instance_id = i.instance_id AND e.status = 'failed'
          AND e.executed_at = TIMESTAMP '2001-03-01 00:00:00' WHERE i.is_active""",
)
def execution_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.lit("2001-03-01").cast("timestamp_ntz")
    active = derived.instances(spark, sf_dir).where("is_active").select("instance_id")
    failed = derived.executions(spark, sf_dir).where((F.col("executed_at") == month) & (F.col("status") == "failed"))
    return checks.execution_log(active, failed, month)


@query("lifecycle_events", f"WITH {EVENTS_CTE} SELECT * FROM events_log")
def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.events(spark, sf_dir)


@query("incident_findings", f"WITH {FINDINGS_CTE} SELECT * FROM findings")
def incident_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.findings(spark, sf_dir)


@query(
    "lifecycle_event_counts",
    f"WITH {EVENTS_CTE} SELECT event, count(*) AS n FROM events_log WHERE event IS NOT NULL GROUP BY 1",
)
def lifecycle_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.event_counts(derived.events(spark, sf_dir).where(F.col("event").isNotNull()))


#: The scan of this month is applied to the findings all earlier months left.
SCAN = "2001-06-01"
_SCAN_TS = f"TIMESTAMP '{SCAN} 00:00:00'"


def _scan_inputs(spark: SparkSession, sf_dir: str):
    moment = F.lit(SCAN).cast("timestamp_ntz")
    # The log and the findings are tables the scan starts from.
    runs = stored(derived.executions(spark, sf_dir), "executions")
    earlier = runs.where(F.col("executed_at") < moment)
    replayed = lifecycle.replay(earlier, derived.REOPEN_DAYS, chunk="year")
    before = stored(lifecycle.to_findings(lifecycle.incidents(replayed)), "findings")
    scan = runs.where(F.col("executed_at") == moment)
    prefix = F.concat(
        F.col("fail_count").cast("string"), F.lit(" of "), F.col("total_count").cast("string"), F.lit(" rows fail this check.")
    )
    results = scan.where(F.col("status") == "failed").select(
        "instance_id", "asset_id", "severity", F.col("definition_id").alias("title"), prefix.alias("description"),
        "fail_count", "total_count",
    )
    return before, results, scan.select("instance_id"), _mutes(spark, sf_dir)


def _mutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax rules of suppliers with little money are muted, for the poorest the mute is over."""
    return derived.places(spark, sf_dir).where(F.col("balance") < 2000).select(
        F.concat(F.lit("tax_cap:"), F.col("suppkey").cast("string")).alias("instance_id"), "asset_id",
        F.when(F.col("balance") < 500, F.lit("2001-05-15")).otherwise("2001-07-01").cast("timestamp_ntz").alias("muted_until"),
    )



_BEFORE = FINDINGS_CTE.replace("FROM counts", f"FROM counts WHERE executed_at < {_SCAN_TS}")
_SCAN_CTES = f"""{PLACES_CTE}, {_BEFORE},
    scan AS (SELECT * FROM ({RUNS_SQL}) WHERE executed_at = {_SCAN_TS}),
    mutes AS (SELECT 'tax_cap:' || suppkey AS instance_id, asset_id FROM places WHERE balance < 2000
              AND (CASE WHEN balance < 500 THEN TIMESTAMP '2001-05-15 00:00:00' ELSE TIMESTAMP '2001-07-01 00:00:00' END)
                  > {_SCAN_TS}),
    open_f AS (SELECT * FROM findings WHERE status IN ('open', 'reopened')),
    res_f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, asset_id
                                                          ORDER BY resolved_at DESC, finding_id DESC) AS rn
                FROM findings WHERE status = 'resolved' AND resolved_at >= {_SCAN_TS} - INTERVAL {derived.REOPEN_DAYS} DAY)
              WHERE rn = 1),
    judged AS (SELECT s.*, CASE WHEN m.asset_id IS NOT NULL THEN 'muted' WHEN o.finding_id IS NOT NULL THEN 'updated'
                           WHEN r.finding_id IS NOT NULL THEN 'reopened' ELSE 'created' END AS event,
                      coalesce(o.finding_id, r.finding_id) AS old_id,
                      coalesce(o.current_fail_count, r.current_fail_count) AS pf,
                      coalesce(o.current_total_count, r.current_total_count) AS pt
               FROM scan s LEFT JOIN mutes m USING (instance_id, asset_id) LEFT JOIN open_f o USING (instance_id, asset_id)
               LEFT JOIN res_f r USING (instance_id, asset_id) WHERE s.status = 'failed'),
    scan_events AS (
      SELECT CASE event WHEN 'created' THEN sha256('scan-{SCAN}|' || instance_id || '|' || asset_id)
                  WHEN 'muted' THEN (SELECT any_value(o.finding_id) FROM open_f o WHERE o.instance_id = judged.instance_id
                                     AND o.asset_id = judged.asset_id)
                  ELSE old_id END AS finding_id,
             event, instance_id, asset_id,
             CASE WHEN event IN ('updated', 'reopened') THEN pf END AS prev_fail_count,
             CASE WHEN event IN ('updated', 'reopened') THEN pt END AS prev_total_count,
             fail_count AS curr_fail_count, total_count AS curr_total_count
      FROM judged
      UNION ALL
      SELECT finding_id, 'resolved', instance_id, asset_id, current_fail_count, current_total_count, 0, current_total_count
      FROM open_f WHERE instance_id IN (SELECT instance_id FROM scan)
        AND instance_id NOT IN (SELECT instance_id FROM scan WHERE status = 'failed'))"""


@query("finalize_scan_events", f"WITH {_SCAN_CTES} SELECT * FROM scan_events")
def finalize_scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, results, executed, mutes = _scan_inputs(spark, sf_dir)
    return lifecycle.finalize_scan(
        before, results, executed, mutes, f"scan-{SCAN}", SCAN, reopen_days=derived.REOPEN_DAYS
    )[1]


@query(
    "finalize_scan_findings",
    f"""WITH {_SCAN_CTES}, ev AS (SELECT * FROM scan_events WHERE event <> 'muted')
        SELECT f.finding_id, CASE ev.event WHEN 'reopened' THEN 'reopened' WHEN 'resolved' THEN 'resolved' ELSE f.status END
                 AS status, f.severity, f.first_detected_at,
               CASE WHEN ev.event IN ('updated', 'reopened') THEN {_SCAN_TS} ELSE f.last_seen_at END AS last_seen_at,
               CASE ev.event WHEN 'resolved' THEN {_SCAN_TS} WHEN 'reopened' THEN NULL ELSE f.resolved_at END AS resolved_at,
               CASE WHEN ev.event = 'resolved' THEN '{policy.RESCAN_NOTE}' END AS resolution_notes,
               CASE WHEN ev.event IN ('updated', 'reopened') THEN ev.curr_fail_count ELSE f.current_fail_count END
                 AS current_fail_count,
               CASE WHEN ev.event = 'reopened' THEN f.reopened_count + 1 ELSE f.reopened_count END AS reopened_count,
               CASE WHEN ev.event IN ('updated', 'reopened') THEN 1 ELSE 0 END AS history_entries
        FROM findings f LEFT JOIN ev USING (finding_id)
        UNION ALL
        SELECT finding_id, 'open', (SELECT severity FROM scan s WHERE s.instance_id = ev.instance_id), {_SCAN_TS},
               {_SCAN_TS}, NULL, NULL, curr_fail_count, 0, 1 FROM ev WHERE event = 'created'""",
)
def finalize_scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, results, executed, mutes = _scan_inputs(spark, sf_dir)
    after = lifecycle.finalize_scan(
        before, results, executed, mutes, f"scan-{SCAN}", SCAN, reopen_days=derived.REOPEN_DAYS
    )[0]
    return after.select(
        "finding_id", "status", "severity", "first_detected_at", "last_seen_at", "resolved_at", "resolution_notes",
        "current_fail_count", "reopened_count",
        F.size(F.coalesce("fail_history", F.array())).alias("history_entries"),
    )


@query(
    "open_finding_lookup",
    f"""WITH {FINDINGS_CTE} SELECT instance_id, asset_id, arg_max(finding_id, (last_seen_at, first_detected_at, finding_id))
          AS open_id FROM findings WHERE status IN ('open', 'reopened') GROUP BY 1, 2""",
)
def open_finding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.latest_open(lifecycle.to_findings(derived.findings(spark, sf_dir)))


@query(
    "recently_resolved_lookup",
    f"""WITH {FINDINGS_CTE} SELECT instance_id, asset_id, arg_max(finding_id, (resolved_at, finding_id)) AS resolved_id
        FROM findings WHERE status = 'resolved' AND resolved_at >= TIMESTAMP '2001-11-01 00:00:00' - INTERVAL 7 DAY
        GROUP BY 1, 2""",
)
def recently_resolved_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.recently_resolved(lifecycle.to_findings(derived.findings(spark, sf_dir)), "2001-11-01")


@query(
    "active_mutes",
    f"""WITH {PLACES_CTE} SELECT 'tax_cap:' || suppkey AS instance_id, asset_id FROM places WHERE balance BETWEEN 500 AND 1999.99""",
)
def active_mutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.active_mutes(_mutes(spark, sf_dir), SCAN)


@query(
    "verification_rescan",
    f"""WITH {INSTANCES_CTE}, {FINDINGS_CTE},
        firing AS (SELECT DISTINCT instance_id FROM executions WHERE executed_at = TIMESTAMP '2001-11-01' AND status = 'failed'),
        hit AS (SELECT f.*, f.status IN ('open', 'reopened') AND f.instance_id IN (SELECT instance_id FROM instances WHERE is_active)
                  AND f.instance_id NOT IN (SELECT instance_id FROM firing) AS solved FROM findings f)
        SELECT finding_id, CASE WHEN solved THEN 'resolved' ELSE status END AS status,
               CASE WHEN solved THEN TIMESTAMP '2001-12-01 00:00:00' ELSE resolved_at END AS resolved_at,
               CASE WHEN solved THEN '{policy.VERIFICATION_NOTE}' END AS resolution_notes FROM hit""",
)
def verification_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lifecycle.to_findings(derived.findings(spark, sf_dir))
    last = F.lit("2001-11-01").cast("timestamp_ntz")
    firing = derived.executions(spark, sf_dir).where((F.col("executed_at") == last) & (F.col("status") == "failed"))
    checked = derived.instances(spark, sf_dir).where("is_active")
    return lifecycle.verification_rescan(found, firing, checked, "2001-12-01").select(
        "finding_id", "status", "resolved_at", "resolution_notes"
    )


@query(
    "manual_status_update",
    f"""WITH {FINDINGS_CTE}
        SELECT finding_id, CASE WHEN failures >= 5 THEN 'resolved' ELSE status END AS status,
               CASE WHEN failures >= 5 THEN 'owner-1' END AS assignee,
               CASE WHEN failures >= 5 AND status <> 'resolved' THEN TIMESTAMP '2001-12-01 00:00:00' ELSE resolved_at END
                 AS resolved_at FROM findings""",
)
def manual_status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    replayed = derived.findings(spark, sf_dir)
    updates = replayed.where(F.col("failures") >= 5).select(
        "finding_id", F.lit("resolved").alias("status"), F.lit("owner-1").alias("assignee"),
        F.lit(None).cast("string").alias("resolution_notes"),
    )
    return lifecycle.update_findings(lifecycle.to_findings(replayed), updates, "2001-12-01").select(
        "finding_id", "status", "assignee", "resolved_at"
    )


@query(
    "stale_proposal_sweep",
    f"""WITH {STATE_CTES}, p AS (SELECT instance_id, "table", CASE WHEN status = 'paused' THEN 'pending' ELSE status END AS status,
               "schema" AS run_id FROM instances)
        SELECT instance_id, CASE WHEN status = 'pending' AND run_id <> 'NATION_3' THEN 'rejected' ELSE status END AS status,
               CASE WHEN status = 'pending' AND run_id <> 'NATION_3' THEN '{policy.STALE_PROPOSAL_REASON}' END
                 AS rejection_reason
        FROM p""",
)
def stale_proposal_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposed = derived.instances(spark, sf_dir).select(
        "instance_id", F.lit("lineitem").alias("table"),
        F.when(F.col("status") == "paused", "pending").otherwise(F.col("status")).alias("status"),
        F.col("schema").alias("run_id"), F.lit(None).cast("string").alias("rejection_reason"),
    )
    return lifecycle.sweep_stale_proposals(proposed, ["lineitem"], "NATION_3").select(
        "instance_id", "status", "rejection_reason"
    )


@query(
    "finding_listing",
    f"""WITH {FINDINGS_CTE} SELECT finding_id, status, severity, last_seen_at FROM findings
        WHERE severity = 'high' AND status = 'resolved' ORDER BY last_seen_at DESC, finding_id LIMIT 20 OFFSET 40""",
)
def finding_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of resolved findings of high severity, newest first."""
    page, _ = _listed(spark, sf_dir)
    return page.select("finding_id", "status", "severity", "last_seen_at")


@query(
    "finding_listing_total",
    f"WITH {FINDINGS_CTE} SELECT count(*) AS total FROM findings WHERE severity = 'high' AND status = 'resolved'",
)
def finding_listing_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir)[1]


def _listed(spark: SparkSession, sf_dir: str):
    return state.listing(
        derived.findings(spark, sf_dir), {"severity": "high", "status": "resolved"},
        [F.col("last_seen_at").desc(), F.col("finding_id")], limit=20, offset=40,
    )


@query(
    "refreshed_descriptions",
    f"""WITH {EVENTS_CTE} SELECT instance_id, executed_at, CASE WHEN curr_total_count > 0
             THEN curr_fail_count || ' of ' || curr_total_count || ' rows fail this check. Column of ' || asset_id || '.'
             ELSE prev_fail_count || ' of ' || prev_total_count || ' rows fail this check. Column of ' || asset_id || '.' END AS description
        FROM events_log WHERE event = 'updated'""",
)
def refreshed_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The description an updated finding had, brought up to date."""
    updated = derived.events(spark, sf_dir).where(F.col("event") == "updated")
    old = F.concat(
        F.col("prev_fail_count").cast("string"), F.lit(" of "), F.col("prev_total_count").cast("string"),
        F.lit(" rows fail this check. Column of "), F.col("asset_id"), F.lit("."),
    )
    return updated.select(
        "instance_id", "executed_at",
        lifecycle.refreshed_description(old, F.col("curr_fail_count"), F.col("curr_total_count")).alias("description"),
    )
