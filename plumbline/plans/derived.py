"""State tables derived from the star schema.

The lifecycle, health and library operators work on logs of rule runs. Here the
log comes from the data: each supplier is a monitored table (region.nation.name),
each month of shipping is a scan, and four rules are checked on the rows shipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import checks, lifecycle
from plumbline.operators.checks import build_check
from plumbline.sources.tables import read_tables

RULES = (
    ("price_cap", "critical", "l_extendedprice", {"max": 95000}),
    ("discount_cap", "high", "l_discount", {"max": 0.095}),
    ("quantity_range", "medium", "l_quantity", {"min": 2, "max": 48}),
    ("tax_cap", "low", "l_tax", {"max": 0.075}),
)
CATEGORIES = {"price_cap": "finance", "discount_cap": "finance", "quantity_range": "volume", "tax_cap": "finance"}


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppkey, asset_id, database, schema, table, fqn of every supplier."""
    t = read_tables(spark, sf_dir, ["supplier", "nation", "region"])
    return (
        t["supplier"]
        .join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("suppkey"),
            F.concat(F.lit("A"), F.col("s_suppkey").cast("string")).alias("asset_id"),
            F.col("r_name").alias("database"),
            F.col("n_name").alias("schema"),
            F.col("s_name").alias("table"),
            F.concat_ws(".", "r_name", "n_name", "s_name").alias("fqn"),
            F.col("s_acctbal").alias("balance"),
        )
    )


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier, rule and month shipped in."""
    lineitem = read_tables(spark, sf_dir, ["lineitem"])["lineitem"]
    rules = [
        build_check("range", "lineitem", {"column": column}, bounds, rule=rule, severity=severity)
        for rule, severity, column, bounds in RULES
    ]
    month = F.trunc(F.col("l_shipdate").cast("date"), "month").cast("timestamp_ntz").alias("executed_at")
    results = checks.scan_groups(lineitem, [F.col("l_suppkey"), month], rules)
    supplier = F.col("l_suppkey").cast("string")
    return results.select(
        F.concat_ws(":", "rule", supplier).alias("instance_id"),
        F.col("rule").alias("definition_id"),
        F.concat(F.lit("A"), supplier).alias("asset_id"),
        "severity",
        "status",
        "fail_count",
        "total_count",
        "executed_at",
    )


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier and rule; suppliers in debt have their tax rule paused."""
    rules = F.array(
        *[F.struct(F.lit(r).alias("definition_id"), F.lit(s).alias("severity")) for r, s, _, _ in RULES]
    )
    paused = (F.col("definition_id") == "tax_cap") & (F.col("balance") < 1000)
    return places(spark, sf_dir).select("*", F.inline(rules)).select(
        F.concat_ws(":", "definition_id", F.col("suppkey").cast("string")).alias("instance_id"),
        "definition_id",
        "asset_id",
        "database",
        "schema",
        "table",
        "fqn",
        "severity",
        F.when(paused, "paused").otherwise("active").alias("status"),
        (~paused).alias("is_active"),
        F.when(F.col("definition_id") == "quantity_range", "volume").otherwise("finance").alias("category"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.replay(executions(spark, sf_dir), REOPEN_DAYS, chunk="year")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.incidents(events(spark, sf_dir))


#: Monthly scans: a resolution stays reopenable for 45 days.
REOPEN_DAYS = 45



def _fails(column: str, bounds: dict) -> str:
    tests = [f"{column} < {bounds['min']}"] if "min" in bounds else []
    tests += [f"{column} > {bounds['max']}"] if "max" in bounds else []
    return " OR ".join(tests)


_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE {_fails(column, bounds)}) AS f_{rule}, count({column}) AS t_{rule}"
    for rule, _, column, bounds in RULES
)
PLACES_CTE = """
    places AS (SELECT s_suppkey AS suppkey, 'A' || s_suppkey AS asset_id, r_name AS "database", n_name AS "schema",
                      s_name AS "table", r_name || '.' || n_name || '.' || s_name AS fqn, s_acctbal AS balance
               FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
INSTANCES_CTE = (
    PLACES_CTE
    + ", instances AS ("
    + " UNION ALL ".join(
        f"""SELECT '{rule}:' || suppkey AS instance_id, '{rule}' AS definition_id, asset_id, "database", "schema",
                   "table", fqn, '{severity}' AS severity,
                   CASE WHEN {"balance < 1000" if rule == "tax_cap" else "false"} THEN 'paused' ELSE 'active' END AS status,
                   NOT ({"balance < 1000" if rule == "tax_cap" else "false"}) AS is_active,
                   '{CATEGORIES[rule]}' AS category FROM places"""
        for rule, severity, _, _ in RULES
    )
    + ")"
)
RUNS_SQL = " UNION ALL ".join(
    f"""SELECT '{rule}:' || l_suppkey AS instance_id, '{rule}' AS definition_id, 'A' || l_suppkey AS asset_id,
               '{severity}' AS severity, CASE WHEN f_{rule} > 0 THEN 'failed' ELSE 'passed' END AS status,
               f_{rule} AS fail_count, t_{rule} AS total_count, CAST(executed_at AS TIMESTAMP) AS executed_at
        FROM counts"""
    for rule, severity, _, _ in RULES
)
EXECUTIONS_CTE = f"""counts AS (SELECT l_suppkey, date_trunc('month', l_shipdate) AS executed_at, {_COUNTS}
    FROM lineitem GROUP BY 1, 2), executions AS ({RUNS_SQL})"""
EVENTS_CTE = (
    EXECUTIONS_CTE
    + f""",
    e1 AS (SELECT *, status = 'failed' AS failing, coalesce(lag(status = 'failed') OVER w, false) AS before
           FROM executions WINDOW w AS (PARTITION BY instance_id, asset_id ORDER BY executed_at)),
    e2 AS (SELECT *, max(CASE WHEN NOT failing AND before THEN executed_at END) OVER w AS last_resolved,
                  last_value(CASE WHEN failing THEN fail_count END IGNORE NULLS) OVER w AS last_fail,
                  last_value(CASE WHEN failing THEN total_count END IGNORE NULLS) OVER w AS last_total
           FROM e1 WINDOW w AS (PARTITION BY instance_id, asset_id ORDER BY executed_at
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    e3 AS (SELECT *, CASE WHEN failing AND before THEN 'updated'
                          WHEN failing AND last_resolved >= executed_at - INTERVAL {REOPEN_DAYS} DAY THEN 'reopened'
                          WHEN failing THEN 'created' WHEN before THEN 'resolved' END AS event FROM e2),
    events_log AS (SELECT instance_id, asset_id, executed_at, severity, event,
                  nullif(CAST(count(*) FILTER (WHERE event = 'created') OVER w AS BIGINT), 0) AS incident_no,
                  CASE WHEN event <> 'created' THEN last_fail END AS prev_fail_count,
                  CASE WHEN event <> 'created' THEN last_total END AS prev_total_count,
                  CASE WHEN failing THEN fail_count ELSE 0 END AS curr_fail_count, total_count AS curr_total_count
           FROM e3 WINDOW w AS (PARTITION BY instance_id, asset_id ORDER BY executed_at
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
)
FINDINGS_CTE = (
    EVENTS_CTE
    + """,
    i1 AS (SELECT instance_id, asset_id, incident_no, arg_max(event, executed_at) AS last_event,
                  max(executed_at) AS updated_at, min(executed_at) AS first_detected_at,
                  max(executed_at) FILTER (WHERE event <> 'resolved') AS last_seen_at,
                  arg_max(curr_fail_count, executed_at) FILTER (WHERE event <> 'resolved') AS current_fail_count,
                  arg_max(curr_total_count, executed_at) FILTER (WHERE event <> 'resolved') AS current_total_count,
                  arg_max(severity, executed_at) FILTER (WHERE event <> 'resolved') AS severity,
                  count(*) FILTER (WHERE event = 'reopened') AS reopened_count,
                  count(*) FILTER (WHERE event <> 'resolved') AS failures
           FROM events_log WHERE event IS NOT NULL GROUP BY 1, 2, 3),
    findings AS (SELECT instance_id || '#' || asset_id || '#' || incident_no AS finding_id, instance_id, asset_id,
                  incident_no, CASE WHEN last_event = 'resolved' THEN 'resolved' WHEN reopened_count > 0 THEN 'reopened'
                               ELSE 'open' END AS status, severity, first_detected_at, last_seen_at,
                  CASE WHEN last_event = 'resolved' THEN updated_at END AS resolved_at, updated_at,
                  current_fail_count, current_total_count, reopened_count, failures FROM i1)"""
)
STATE_CTES = f"{INSTANCES_CTE}, {FINDINGS_CTE}"
