"""Health, fleet and library reports over the derived runs and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import health, library, metrics
from plumbline.plans import derived, metric_queries
from plumbline.plans.derived import EXECUTIONS_CTE, INSTANCES_CTE, STATE_CTES
from plumbline.plans.registry import query
from plumbline.session import stored

AS_OF = "2001-11-30 00:00:00"
_NOW = f"TIMESTAMP '{AS_OF}'"
_WEIGHT = "CASE lower(severity) WHEN 'critical' THEN 5 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 WHEN 'info' THEN 1 ELSE 2 END"
_RATES = """
    recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY executed_at DESC) AS rn
                              FROM executions) WHERE rn <= 20),
    rates AS (SELECT instance_id, count(*) FILTER (WHERE status = 'passed') AS passed,
                     count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'error') AS error,
                     arg_max(status, executed_at) AS latest_status, max(executed_at) AS last_executed_at,
                     count(*) AS runs, count(*) FILTER (WHERE status = 'passed') / CAST(count(*) AS DOUBLE) AS pass_rate
              FROM recent GROUP BY 1)"""


def _round(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


@query(
    "rule_pass_rates",
    f"WITH {EXECUTIONS_CTE}, {_RATES} SELECT * REPLACE (round(pass_rate, 6) AS pass_rate) FROM rates",
)
def rule_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(health.pass_rates(derived.executions(spark, sf_dir)), "pass_rate")


_SCORES = f"""scores AS (SELECT "database", "schema", "table", sum({_WEIGHT} * pass_rate) / sum({_WEIGHT}) AS health_score,
                                count(*) AS rules_rated
                         FROM instances JOIN rates USING (instance_id) WHERE is_active GROUP BY 1, 2, 3)"""


@query(
    "health_scores",
    f"""WITH {INSTANCES_CTE}, {EXECUTIONS_CTE}, {_RATES}, {_SCORES}
        SELECT * REPLACE (round(health_score, 6) AS health_score) FROM scores""",
)
def health_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = health.health_scores(derived.executions(spark, sf_dir), derived.instances(spark, sf_dir))
    return _round(scores, "health_score")


@query(
    "column_status",
    f"""WITH {INSTANCES_CTE}, {EXECUTIONS_CTE}, {_RATES},
        c AS (SELECT "database", "schema", "table", latest_status, unnest(CASE definition_id WHEN 'price_cap' THEN ['l_extendedprice', 'l_quantity']
                     WHEN 'quantity_range' THEN ['l_quantity'] WHEN 'discount_cap' THEN ['l_discount'] ELSE ['l_tax'] END) AS "column"
              FROM instances LEFT JOIN rates USING (instance_id))
        SELECT "database", "schema", "table", "column",
               CASE max(CASE WHEN latest_status = 'passed' THEN 0 WHEN latest_status IN ('failed', 'error') THEN 3
                             WHEN latest_status IS NULL THEN 1 ELSE 2 END)
                    WHEN 3 THEN 'red' WHEN 2 THEN 'amber' WHEN 1 THEN 'gray' ELSE 'green' END AS status
        FROM c GROUP BY 1, 2, 3, 4""",
)
def column_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = derived.instances(spark, sf_dir).join(
        health.pass_rates(derived.executions(spark, sf_dir)), "instance_id", "left"
    )
    definition = F.col("definition_id")
    columns = (
        F.when(definition == "price_cap", F.array(F.lit("l_extendedprice"), F.lit("l_quantity")))
        .when(definition == "quantity_range", F.array(F.lit("l_quantity")))
        .when(definition == "discount_cap", F.array(F.lit("l_discount")))
        .otherwise(F.array(F.lit("l_tax")))
    )
    return health.column_status(rules.withColumn("columns", columns))


@query(
    "rule_ranking",
    f"""WITH {INSTANCES_CTE}, {EXECUTIONS_CTE}, {_RATES}
        SELECT instance_id, latest_status, severity, definition_id AS name FROM instances JOIN rates USING (instance_id)
        ORDER BY CASE latest_status WHEN 'failed' THEN 0 WHEN 'error' THEN 1 WHEN 'passed' THEN 3 ELSE 2 END,
                 CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END,
                 name, instance_id""",
)
def rule_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules, those that need attention first."""
    rules = derived.instances(spark, sf_dir).join(health.pass_rates(derived.executions(spark, sf_dir)), "instance_id")
    named = rules.select("instance_id", "latest_status", "severity", F.col("definition_id").alias("name"))
    return named.orderBy(*health.rule_ranking_order())


@query(
    "daily_trend",
    f"""WITH {EXECUTIONS_CTE} SELECT CAST(executed_at AS DATE) AS "day", count(*) FILTER (WHERE status = 'passed') AS passed,
          count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'error') AS error,
          count(*) AS total, round(count(*) FILTER (WHERE status = 'passed') / CAST(count(*) AS DOUBLE), 6) AS pass_rate
        FROM executions GROUP BY 1""",
)
def daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(health.daily_trend(derived.executions(spark, sf_dir)), "pass_rate")


@query(
    "overall_health",
    f"""WITH {INSTANCES_CTE}, {EXECUTIONS_CTE}
        SELECT count(*) AS runs, round(avg(CASE WHEN e.status = 'passed' THEN 1.0 ELSE 0.0 END), 6) AS pass_rate,
               round(sum(w * CASE WHEN e.status = 'passed' THEN 1.0 ELSE 0.0 END) / sum(w), 6) AS weighted_pass_rate
        FROM executions e JOIN (SELECT instance_id, {_WEIGHT} AS w FROM instances) i USING (instance_id)
        WHERE executed_at BETWEEN {_NOW} - INTERVAL 180 DAY AND {_NOW}""",
)
def overall_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = health.overall_health(derived.executions(spark, sf_dir), derived.instances(spark, sf_dir), AS_OF, 180)
    return _round(found, "pass_rate", "weighted_pass_rate")


_OPEN = "f.status IN ('open', 'reopened')"
_FLEET = f"""
    runs AS (SELECT "database", "schema", "table", count(*) FILTER (WHERE e.status = 'passed') AS passed,
                    count(*) FILTER (WHERE e.status = 'failed') AS failed, count(*) FILTER (WHERE e.status = 'error') AS error
             FROM executions e JOIN instances USING (instance_id)
             WHERE executed_at BETWEEN {_NOW} - INTERVAL 60 DAY AND {_NOW} GROUP BY 1, 2, 3),
    inc AS (SELECT "database", "schema", "table", count(*) FILTER (WHERE {_OPEN}) AS open_findings,
                   count(*) FILTER (WHERE {_OPEN} AND reopened_count > 0) AS flapping,
                   min(first_detected_at) FILTER (WHERE {_OPEN}) AS oldest_open_at
            FROM findings f JOIN instances i USING (instance_id) GROUP BY 1, 2, 3),
    fleet AS (SELECT "database", "schema", "table",
                     CAST(coalesce(passed, 0) + coalesce(failed, 0) + coalesce(error, 0) AS BIGINT) AS runs,
                     coalesce(passed, 0) AS passed, coalesce(failed, 0) AS failed, coalesce(error, 0) AS error,
                     coalesce(passed, 0) / CAST(nullif(coalesce(passed, 0) + coalesce(failed, 0) + coalesce(error, 0), 0) AS DOUBLE)
                       AS pass_rate,
                     coalesce(open_findings, 0) AS open_findings, coalesce(flapping, 0) AS flapping, oldest_open_at
              FROM runs FULL JOIN inc USING ("database", "schema", "table"))"""


def _fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.fleet_tables(
        derived.executions(spark, sf_dir), derived.findings(spark, sf_dir), derived.instances(spark, sf_dir), AS_OF, 60
    )


@query(
    "fleet_tables",
    f"WITH {STATE_CTES}, {_FLEET} SELECT * REPLACE (round(pass_rate, 6) AS pass_rate) FROM fleet",
)
def fleet_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_fleet(spark, sf_dir), "pass_rate")


@query(
    "fleet_overview",
    f"""WITH {STATE_CTES}, {_FLEET} SELECT * REPLACE (round(pass_rate, 6) AS pass_rate) FROM fleet
        ORDER BY open_findings DESC, coalesce(fleet.pass_rate, 1), failed DESC, "database", "schema", "table" LIMIT 8""",
)
def fleet_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(health.worst_tables(_fleet(spark, sf_dir)), "pass_rate")


@query(
    "incident_counts",
    f"""WITH {STATE_CTES}, {_FLEET} SELECT * FROM inc""",
)
def incident_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.incident_counts(derived.findings(spark, sf_dir), derived.instances(spark, sf_dir))


@query(
    "fleet_incidents",
    f"""WITH {STATE_CTES} SELECT count(*) FILTER (WHERE {_OPEN}) AS open_findings,
               count(*) FILTER (WHERE {_OPEN} AND reopened_count > 0) AS flapping,
               min(first_detected_at) FILTER (WHERE {_OPEN}) AS oldest_open_at FROM findings f""",
)
def fleet_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.fleet_incidents(derived.findings(spark, sf_dir))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax rules play the drift monitors; rules of suppliers with high balance are muted."""
    instances = derived.instances(spark, sf_dir).withColumn(
        "kind", F.when(F.col("definition_id") == "tax_cap", "schema_drift")
    )
    mutes = derived.places(spark, sf_dir).where(F.col("balance") > 9000).select(
        F.concat(F.lit("price_cap:"), F.col("suppkey").cast("string")).alias("instance_id"), "asset_id",
        F.lit("2002-01-01").cast("timestamp_ntz").alias("muted_until"),
    )
    return health.table_rules(
        derived.executions(spark, sf_dir), derived.findings(spark, sf_dir), instances, mutes, AS_OF
    )


_RULES = f"""
    opened AS (SELECT instance_id, asset_id, arg_max(finding_id, (last_seen_at, first_detected_at)) AS open_finding_id
               FROM findings f WHERE {_OPEN} GROUP BY 1, 2),
    muted AS (SELECT 'price_cap:' || suppkey AS instance_id, asset_id FROM places WHERE balance > 9000),
    rules AS (SELECT i.*, r.passed, r.failed, r.latest_status, r.last_executed_at, r.runs, r.pass_rate, o.open_finding_id,
                     m.instance_id IS NOT NULL AS muted,
                     CASE WHEN latest_status = 'passed' THEN 'green' WHEN latest_status IN ('failed', 'error') THEN 'red'
                          WHEN latest_status IS NULL THEN 'gray' ELSE 'amber' END AS dot
              FROM instances i LEFT JOIN rates r USING (instance_id) LEFT JOIN opened o USING (instance_id, asset_id)
              LEFT JOIN muted m USING (instance_id, asset_id)
              WHERE is_active AND NOT (definition_id = 'tax_cap' AND o.open_finding_id IS NULL))"""


@query(
    "table_rules",
    f"""WITH {STATE_CTES}, {_RATES}, {_RULES}
        SELECT instance_id, "table", severity, latest_status, dot, runs, round(pass_rate, 6) AS pass_rate, open_finding_id, muted
        FROM rules""",
)
def table_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(
        _rules(spark, sf_dir).select(
            "instance_id", "table", "severity", "latest_status", "dot", "runs", "pass_rate", "open_finding_id", "muted"
        ),
        "pass_rate",
    )


@query(
    "table_health_report",
    f"""WITH {STATE_CTES}, {_RATES}, {_RULES}
        SELECT "database", "schema", "table",
               round(sum({_WEIGHT} * pass_rate) / sum(CASE WHEN pass_rate IS NOT NULL THEN {_WEIGHT} END), 6) AS health_score,
               count(*) AS rules_total, count(*) FILTER (WHERE latest_status IN ('failed', 'error')) AS rules_failing,
               count(*) FILTER (WHERE latest_status = 'passed') AS rules_passing,
               count(*) FILTER (WHERE latest_status IS NULL) AS rules_unrun, count(open_finding_id) AS open_findings,
               count(*) FILTER (WHERE muted) AS rules_muted, max(last_executed_at) AS last_run_at
        FROM rules GROUP BY 1, 2, 3""",
)
def table_health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(health.table_reports(_rules(spark, sf_dir)), "health_score")


@query(
    "findings_summary",
    f"""WITH {STATE_CTES} SELECT 'total' AS dimension, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM findings
        UNION ALL SELECT 'status', status, count(*) FROM findings GROUP BY status
        UNION ALL SELECT 'severity', severity, count(*) FROM findings GROUP BY severity""",
)
def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.findings_summary(derived.findings(spark, sf_dir))


@query(
    "findings_by_table",
    f"""WITH {STATE_CTES} SELECT "database", "table", CAST(grouping("table") AS INTEGER) AS is_database, count(*) AS total,
          {", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in library.SEVERITIES)}
        FROM findings JOIN places USING (asset_id) WHERE status <> 'resolved'
        GROUP BY GROUPING SETS (("database"), ("database", "table"))""",
)
def findings_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = library.findings_by_table(derived.findings(spark, sf_dir), derived.places(spark, sf_dir))
    return found.withColumn("is_database", F.col("is_database").cast("int"))


@query(
    "rule_stats",
    f"""WITH {INSTANCES_CTE} SELECT 'total' AS dimension, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM instances
        UNION ALL SELECT 'category', category, count(*) FROM instances GROUP BY category
        UNION ALL SELECT 'severity', severity, count(*) FROM instances GROUP BY severity
        UNION ALL SELECT 'status', status, count(*) FROM instances GROUP BY status
        UNION ALL SELECT 'active', CASE WHEN is_active THEN 'yes' ELSE 'no' END, count(*) FROM instances GROUP BY is_active""",
)
def rule_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.rule_stats(derived.instances(spark, sf_dir))


@query(
    "rule_coverage",
    f"""WITH {STATE_CTES}, o AS (SELECT DISTINCT instance_id FROM findings f WHERE {_OPEN})
        SELECT count(*) AS active, count(o.instance_id) AS failing, count(*) - count(o.instance_id) AS passing
        FROM instances i LEFT JOIN o USING (instance_id) WHERE i.status = 'active'""",
)
def rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.rule_coverage(derived.instances(spark, sf_dir), derived.findings(spark, sf_dir))


@query(
    "findings_per_definition",
    f"""WITH {STATE_CTES} SELECT definition_id, count(*) AS n FROM findings JOIN instances USING (instance_id) GROUP BY 1""",
)
def findings_per_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.findings_per_definition(derived.findings(spark, sf_dir), derived.instances(spark, sf_dir))


@query(
    "top_assets_per_definition",
    f"""WITH {STATE_CTES}, c AS (SELECT definition_id, fqn, count(*) AS n FROM findings JOIN instances USING (instance_id) GROUP BY 1, 2)
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY definition_id ORDER BY n DESC, fqn) AS INTEGER) AS rank FROM c)
        WHERE rank <= 3""",
)
def top_assets_per_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.top_assets_per_definition(
        derived.findings(spark, sf_dir), derived.instances(spark, sf_dir), derived.places(spark, sf_dir)
    )


@query("instance_counts", f"WITH {INSTANCES_CTE} SELECT definition_id, count(*) AS n FROM instances GROUP BY 1")
def instance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.instance_counts(derived.instances(spark, sf_dir))


@query(
    "preferred_definition",
    f"""WITH {INSTANCES_CTE}, d AS (SELECT definition_id, CASE WHEN definition_id = 'quantity_range' THEN 'range' ELSE 'cap' END AS shape,
             count(*) FILTER (WHERE status = 'active') AS active_count FROM instances WHERE definition_id <> 'price_cap' GROUP BY 1)
        SELECT shape, definition_id, active_count FROM (SELECT *, row_number() OVER (PARTITION BY shape
               ORDER BY active_count DESC, definition_id) AS rn FROM d) WHERE rn = 1""",
)
def preferred_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances = derived.instances(spark, sf_dir)
    definitions = instances.select("definition_id").distinct().select(
        "definition_id",
        F.when(F.col("definition_id") == "quantity_range", "range").otherwise("cap").alias("shape"),
        F.when(F.col("definition_id") == "price_cap", "disabled").otherwise("approved").alias("status"),
        F.lit("1995-01-01").cast("timestamp_ntz").alias("created_at"),
    )
    return library.preferred_definition(definitions, instances)


@query(
    "table_activity",
    f"""WITH {STATE_CTES}, o AS (SELECT asset_id, count(*) AS open_findings FROM findings f WHERE {_OPEN} GROUP BY 1),
        r AS (SELECT i.asset_id, count(*) AS rules_run FROM executions e JOIN instances i USING (instance_id) WHERE is_active GROUP BY 1)
        SELECT asset_id, fqn, coalesce(open_findings, 0) AS open_findings, coalesce(rules_run, 0) AS rules_run
        FROM places LEFT JOIN o USING (asset_id) LEFT JOIN r USING (asset_id)""",
)
def table_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.table_activity(
        derived.findings(spark, sf_dir), derived.executions(spark, sf_dir), derived.instances(spark, sf_dir),
        derived.places(spark, sf_dir),
    )


@query(
    "run_targets",
    f"""WITH {INSTANCES_CTE}, {EXECUTIONS_CTE} SELECT DISTINCT "database", "schema", "table"
        FROM executions JOIN instances USING (instance_id)""",
)
def run_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = derived.executions(spark, sf_dir).select("instance_id").distinct()
    return library.run_targets(runs.join(derived.instances(spark, sf_dir), "instance_id"))


@query(
    "scan_severity_counts",
    f"""WITH {EXECUTIONS_CTE} SELECT executed_at, severity, count(*) AS n FROM executions WHERE fail_count > 0 GROUP BY 1, 2""",
)
def scan_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.severity_counts(derived.executions(spark, sf_dir), ["executed_at"])


@query(
    "run_status_counts",
    """SELECT count(*) AS runs, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed,
              count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, count(*) FILTER (WHERE o_orderstatus = 'O') AS active
       FROM orders""",
)
def run_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders play the runs: finished, failed (pending) and open ones."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed")
    return library.run_status_counts(orders.select(status.otherwise("running").alias("status")))


@query(
    "fleet_tiles",
    f"""WITH {STATE_CTES}, {_FLEET}, {metric_queries.USER_SNAPSHOTS}, {metric_queries.BASELINES},
        o AS (SELECT DISTINCT instance_id FROM findings f WHERE {_OPEN})
        SELECT (SELECT count(*) FROM fleet WHERE failed > 0) AS tables_with_failures,
               (SELECT count(*) FROM fleet WHERE open_findings > 0) AS unhealthy_tables,
               (SELECT count(*) FROM bl WHERE sample_count >= 14 AND deviations >= 3) AS breached,
               (SELECT count(*) FROM bl WHERE sample_count >= 14 AND deviations >= 2 AND deviations < 3) AS watch,
               (SELECT round((count(*) - count(o.instance_id)) * 100.0 / count(*), 1) FROM instances i LEFT JOIN o USING (instance_id)
                WHERE i.status = 'active') AS passing_pct""",
)
def fleet_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = stored(derived.findings(spark, sf_dir), "findings")
    instances = derived.instances(spark, sf_dir)
    fleet = health.fleet_tables(derived.executions(spark, sf_dir), findings, instances, AS_OF, 60)
    snaps, base = metric_queries._base(spark, sf_dir, "user")
    return library.fleet_tiles(
        fleet, library.rule_coverage(instances, findings), metrics.asset_metrics(snaps, base, 2)
    )
