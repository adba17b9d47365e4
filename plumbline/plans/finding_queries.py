"""Rules run on the order table, their findings, and the findings of a first scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import checks, findings, lifecycle
from plumbline.operators.checks import build_check
from plumbline.plans.registry import query
from plumbline.sources.tables import read_tables

AS_OF = "2003-01-01 00:00:00"
#: instance, definition, shape, column, severity, reason
_INSTANCES = (
    ("i-price", "d-range", "range", "o_totalprice", "high", "Large orders are keyed wrongly."),
    ("i-status", "d-values", "accepted_values", "o_orderstatus", "low", " "),
    ("i-fresh", "d-fresh", "freshness", "o_orderdate", "medium", None),
    ("i-whole", "d-predicate", "predicate", None, "critical", None),
    ("i-key", "d-null", "not_null", "o_orderkey", "low", None),
)
_DEFINITIONS = (
    ("d-range", "price_limit", "Prices lie in a range.", "range"),
    ("d-values", "known_status", "Only known values.", "accepted_values"),
    ("d-fresh", "recent_orders", None, "freshness"),
    ("d-predicate", "old_and_open", "", "predicate"),
    ("d-null", "key_present", "Keys are there.", "not_null"),
)


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(results, finding rows)"""
    orders = read_tables(spark, sf_dir, ["orders"])["orders"]
    rules = [
        build_check("range", "orders", {"column": "o_totalprice"}, {"max": 200000}, rule="i-price"),
        build_check("accepted_values", "orders", {"column": "o_orderstatus"}, {"accepted_values": ["F", "O"]}, rule="i-status"),
        build_check("freshness", "orders", {"column": "o_orderdate"}, {"max_age_hours": 24}, rule="i-fresh"),
        build_check("predicate", "orders", {}, {"fails_if": "o_orderstatus = 'O' AND o_orderdate < TIMESTAMP_NTZ '1996-01-01'"}, rule="i-whole"),
        build_check("not_null", "orders", {"column": "o_orderkey"}, rule="i-key"),
    ]
    results = checks.scan({"orders": orders}, rules, AS_OF)
    instances = spark.createDataFrame(
        [(i, d, "SHOP.MAIN.ORDERS", c, s, r) for i, d, _, c, s, r in _INSTANCES],
        "instance_id string, definition_id string, table_fqn string, column string, severity string, rationale string",
    )
    definitions = spark.createDataFrame(
        list(_DEFINITIONS), "definition_id string, name string, description string, shape string"
    )
    columns = [c for c in orders.columns if c != "o_orderstatus"]
    assets = spark.createDataFrame(
        [("a-table", "SHOP.MAIN.ORDERS")] + [(f"a-{c}", f"SHOP.MAIN.ORDERS.{c}") for c in columns], "asset_id string, fqn string"
    )
    return results, findings.finding_rows(results, instances, definitions, assets)


_SQL = """
    c(instance_id, asset_id, severity, name, target, detail, whole, column_name, fail_count, total_count) AS (
        SELECT 'i-price', 'a-o_totalprice', 'high', 'price_limit', 'o_totalprice', ' Large orders are keyed wrongly.', false, 'o_totalprice',
               count(*) FILTER (WHERE o_totalprice > 200000), count(o_totalprice) FROM orders
        UNION ALL SELECT 'i-status', 'a-table', 'low', 'known_status', 'ORDERS', ' Only known values.', false, 'o_orderstatus',
               count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')), count(o_orderstatus) FROM orders
        UNION ALL SELECT 'i-fresh', 'a-o_orderdate', 'medium', 'recent_orders', 'o_orderdate', '', true, 'o_orderdate',
               CAST(max(o_orderdate) < TIMESTAMP '2002-12-31 00:00:00' AS BIGINT), 1 FROM orders
        UNION ALL SELECT 'i-whole', 'a-table', 'critical', 'old_and_open', 'ORDERS', '', false, '',
               count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00'), count(*) FROM orders
        UNION ALL SELECT 'i-key', 'a-o_orderkey', 'low', 'key_present', 'o_orderkey', ' Keys are there.', false, 'o_orderkey',
               count(*) - count(o_orderkey), count(*) FROM orders),
    f AS (SELECT instance_id, asset_id, severity, name || ' violated on ' || target AS title,
                 CASE WHEN whole THEN 'This table-level check failed.' ELSE fail_count || ' of ' || total_count || ' rows fail this check.' END
                   || detail AS description, fail_count, total_count, column_name FROM c WHERE fail_count > 0)"""


@query("finding_rows", f"WITH {_SQL} SELECT * FROM f")
def finding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of five rules with their places and texts."""
    return _found(spark, sf_dir)[1].drop("fqn", "sample_rows")


@query(
    "scan_to_findings",
    f"""WITH {_SQL} SELECT instance_id, asset_id, severity, title, description, 'open' AS status, fail_count, total_count FROM f""",
)
def scan_to_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules are run, their findings built and a first scan finalized."""
    results, found = _found(spark, sf_dir)
    executed = results.select(F.col("rule").alias("instance_id"))
    none = spark.createDataFrame([], lifecycle.FINDINGS)
    mutes = spark.createDataFrame([], "instance_id string, asset_id string, muted_until timestamp_ntz")
    after, _ = lifecycle.finalize_scan(none, found, executed, mutes, "scan-1", AS_OF)
    counts = [F.col(f"current_{c}").alias(c) for c in ("fail_count", "total_count")]
    return after.select("instance_id", "asset_id", "severity", "title", "description", "status", *counts)
