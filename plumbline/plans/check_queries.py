"""Row-level checks on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import checks
from plumbline.operators.checks import build_check
from plumbline.plans.registry import query
from plumbline.sources.tables import read_tables


def _result_sql(rule: str, table: str, column: str, severity: str, fail: str, total: str, tail: str) -> str:
    """SQL of one check result row, with the counts taken from ``tail``."""
    return f"""
    SELECT '{rule}' AS rule, '{table}' AS "table", '{column}' AS "column",
           '{severity}' AS severity, fail_count, total_count,
           CASE WHEN fail_count > 0 THEN 'failed' ELSE 'passed' END AS status,
           CAST(NULL AS VARCHAR) AS error
    FROM (SELECT CAST({fail} AS BIGINT) AS fail_count, CAST({total} AS BIGINT) AS total_count {tail})
    """


def _dup_sql(table: str, cols: str, not_null: str) -> str:
    return (
        f"FROM (SELECT {cols}, count(*) AS n, {not_null} AS whole FROM {table} GROUP BY {cols})"
    )


_SQL = {
    "not_null": _result_sql(
        "lang_not_null", "documents", "lang", "high", "count(*) - count(lang)", "count(*)", "FROM documents"
    ),
    "uniqueness": _result_sql(
        "orderkey_unique", "lineitem", "l_orderkey", "high",
        "coalesce(sum(CASE WHEN whole AND n > 1 THEN n END), 0)", "coalesce(sum(n), 0)",
        _dup_sql("lineitem", "l_orderkey", "l_orderkey IS NOT NULL"),
    ),
    "accepted_values": _result_sql(
        "status_known", "orders", "o_orderstatus", "medium",
        "count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F'))", "count(o_orderstatus)", "FROM orders",
    ),
    "range": _result_sql(
        "quantity_range", "lineitem", "l_quantity", "medium",
        "count(*) FILTER (WHERE l_quantity < 2 OR l_quantity > 48)", "count(l_quantity)", "FROM lineitem",
    ),
    "regex": _result_sql(
        "name_format", "customer", "c_name", "low",
        "count(*) FILTER (WHERE NOT regexp_full_match(c_name, 'Customer#0[0-9]*[0-4]'))", "count(c_name)",
        "FROM customer",
    ),
    "freshness": _result_sql(
        "orders_fresh", "orders", "o_orderdate", "high",
        "CASE WHEN max(o_orderdate) < TIMESTAMP '2001-12-31 00:00:00' - INTERVAL 720 HOUR THEN 1 ELSE 0 END",
        "1", "FROM orders",
    ),
    "duplicate_key": _result_sql(
        "line_unique", "lineitem", "l_orderkey,l_linenumber", "critical",
        "coalesce(sum(CASE WHEN whole AND n > 1 THEN n END), 0)", "coalesce(sum(n), 0)",
        _dup_sql("lineitem", "l_orderkey, l_linenumber", "l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL"),
    ),
    "ref_integrity": _result_sql(
        "label_has_event_user", "labels", "doc_id", "high",
        "count(*) FILTER (WHERE doc_id IS NOT NULL AND NOT EXISTS "
        "(SELECT 1 FROM events e WHERE e.user_id = labels.doc_id))",
        "count(*)", "FROM labels",
    ),
    "predicate": _result_sql(
        "price_covers_quantity", "lineitem", "", "low",
        "count(*) FILTER (WHERE l_extendedprice < l_quantity * 1000 AND l_discount > 0.05)", "count(*)",
        "FROM lineitem",
    ),
}

_CHECKS = {
    "not_null": build_check("not_null", "documents", {"column": "lang"}, rule="lang_not_null", severity="high"),
    "uniqueness": build_check(
        "uniqueness", "lineitem", {"column": "l_orderkey"}, rule="orderkey_unique", severity="high"
    ),
    "accepted_values": build_check(
        "accepted_values", "orders", {"column": "o_orderstatus"}, {"values": ["O", "F"]}, rule="status_known"
    ),
    "range": build_check(
        "range", "lineitem", {"column": "l_quantity"}, {"min": 2, "max": 48}, rule="quantity_range"
    ),
    "regex": build_check(
        "regex_match", "customer", {"column": "c_name"}, {"regex": "Customer#0[0-9]*[0-4]"},
        rule="name_format", severity="low",
    ),
    "freshness": build_check(
        "freshness", "orders", {"column": "o_orderdate"}, {"max_age_hours": 720}, rule="orders_fresh", severity="high"
    ),
    "duplicate_key": build_check(
        "duplicate_key", "lineitem", {"columns": ["l_orderkey", "l_linenumber"]}, rule="line_unique", severity="critical"
    ),
    "ref_integrity": build_check(
        "referential_integrity", "labels", {"column": "doc_id", "ref_table": "events", "ref_column": "user_id"},
        rule="label_has_event_user", severity="high",
    ),
    "predicate": build_check(
        "predicate", "lineitem", {}, {"fails_if": "l_extendedprice < l_quantity * 1000 AND l_discount > 0.05"},
        rule="price_covers_quantity", severity="low",
    ),
}

_AS_OF = "2001-12-31 00:00:00"
_TABLES = ("documents", "lineitem", "orders", "customer", "labels", "events")


def _register_single(kind: str) -> None:
    check = _CHECKS[kind]

    @query(f"check_{kind}", _SQL[kind])
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        needed = {check.table, check.params.get("ref_table", check.table)}
        return checks.scan(read_tables(spark, sf_dir, sorted(needed)), [check], _AS_OF)


for _kind in _CHECKS:
    _register_single(_kind)


@query("multi_rule_scan", " UNION ALL ".join(_SQL.values()))
def multi_rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.scan(read_tables(spark, sf_dir, _TABLES), _CHECKS.values(), _AS_OF)


def star_checks() -> list[checks.Check]:
    """The flagship rule set: five shapes over three tables."""
    return [
        build_check("not_null", "orders", {"column": "o_custkey"}, rule="order_customer_set", severity="high"),
        build_check("range", "lineitem", {"column": "l_quantity"}, {"min": 1, "max": 49}, rule="quantity_range"),
        build_check("range", "lineitem", {"column": "l_discount"}, {"max": 0.09}, rule="discount_cap"),
        build_check(
            "accepted_values", "orders", {"column": "o_orderstatus"}, {"values": ["O", "F"]}, rule="status_known"
        ),
        build_check("uniqueness", "customer", {"column": "c_custkey"}, rule="customer_unique", severity="critical"),
        build_check("uniqueness", "lineitem", {"column": "l_orderkey"}, rule="orderkey_unique"),
        build_check(
            "referential_integrity", "orders",
            {"column": "o_custkey", "ref_table": "customer", "ref_column": "c_custkey"},
            rule="order_customer_exists", severity="critical",
        ),
        build_check(
            "referential_integrity", "lineitem",
            {"column": "l_orderkey", "ref_table": "orders", "ref_column": "o_orderkey"},
            rule="line_order_exists", severity="critical",
        ),
    ]


_STAR_SQL = " UNION ALL ".join(
    [
        _result_sql("order_customer_set", "orders", "o_custkey", "high", "count(*) - count(o_custkey)", "count(*)", "FROM orders"),
        _result_sql("quantity_range", "lineitem", "l_quantity", "medium",
                    "count(*) FILTER (WHERE l_quantity < 1 OR l_quantity > 49)", "count(l_quantity)", "FROM lineitem"),
        _result_sql("discount_cap", "lineitem", "l_discount", "medium",
                    "count(*) FILTER (WHERE l_discount > 0.09)", "count(l_discount)", "FROM lineitem"),
        _result_sql("status_known", "orders", "o_orderstatus", "medium",
                    "count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F'))", "count(o_orderstatus)", "FROM orders"),
        _result_sql("customer_unique", "customer", "c_custkey", "critical",
                    "coalesce(sum(CASE WHEN whole AND n > 1 THEN n END), 0)", "coalesce(sum(n), 0)",
                    _dup_sql("customer", "c_custkey", "c_custkey IS NOT NULL")),
        _result_sql("orderkey_unique", "lineitem", "l_orderkey", "medium",
                    "coalesce(sum(CASE WHEN whole AND n > 1 THEN n END), 0)", "coalesce(sum(n), 0)",
                    _dup_sql("lineitem", "l_orderkey", "l_orderkey IS NOT NULL")),
        _result_sql("order_customer_exists", "orders", "o_custkey", "critical",
                    "count(*) FILTER (WHERE o_custkey IS NOT NULL AND NOT EXISTS "
                    "(SELECT 1 FROM customer c WHERE c.c_custkey = orders.o_custkey))", "count(*)", "FROM orders"),
        _result_sql("line_order_exists", "lineitem", "l_orderkey", "critical",
                    "count(*) FILTER (WHERE l_orderkey IS NOT NULL AND NOT EXISTS "
                    "(SELECT 1 FROM orders o WHERE o.o_orderkey = lineitem.l_orderkey))", "count(*)", "FROM lineitem"),
    ]
)


@query("star_schema_scan", _STAR_SQL)
def star_schema_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.scan(read_tables(spark, sf_dir, ("orders", "lineitem", "customer")), star_checks())


_SAMPLE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
_SAMPLE_BY = ", ".join(_SAMPLE_ORDER)


@query(
    "failing_sample_range",
    f"SELECT * FROM lineitem WHERE l_quantity < 2 OR l_quantity > 48 ORDER BY {_SAMPLE_BY} LIMIT 10",
)
def failing_sample_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.failing_rows(read_tables(spark, sf_dir, ["lineitem"]), _CHECKS["range"], 10, _SAMPLE_ORDER)


@query(
    "failing_sample_duplicate_key",
    f"""SELECT * FROM lineitem WHERE (l_orderkey, l_linenumber) IN (
          SELECT (l_orderkey, l_linenumber) FROM lineitem
          WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
          GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
        ORDER BY {_SAMPLE_BY} LIMIT 10""",
)
def failing_sample_duplicate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.failing_rows(
        read_tables(spark, sf_dir, ["lineitem"]), _CHECKS["duplicate_key"], 10, _SAMPLE_ORDER
    )


@query(
    "failing_sample_ref_integrity",
    """SELECT * FROM labels WHERE doc_id IS NOT NULL
       AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = labels.doc_id) ORDER BY doc_id LIMIT 10""",
)
def failing_sample_ref_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.failing_rows(
        read_tables(spark, sf_dir, ["labels", "events"]), _CHECKS["ref_integrity"], 10, ["doc_id"]
    )


@query(
    "violating_row_evidence",
    f"""SELECT * FROM lineitem WHERE l_extendedprice < l_quantity * 1000 AND l_discount > 0.05
        ORDER BY {_SAMPLE_BY} LIMIT 10""",
)
def violating_row_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.failing_rows(read_tables(spark, sf_dir, ["lineitem"]), _CHECKS["predicate"], 10, _SAMPLE_ORDER)


@query(
    "severity_override",
    f"""SELECT r.* REPLACE (CASE rule WHEN 'quantity_range' THEN 'critical' WHEN 'status_known' THEN 'info'
                                      ELSE severity END AS severity)
        FROM ({" UNION ALL ".join(_SQL.values())}) r""",
)
def severity_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    overrides = spark.createDataFrame(
        [("quantity_range", "critical"), ("status_known", "info")], "rule string, severity string"
    )
    return checks.override_severity(multi_rule_scan(spark, sf_dir), overrides)


@query(
    "reconciled_counts",
    f"""SELECT r.* FROM ({_SQL["range"]} UNION ALL {_SQL["duplicate_key"]}) r""",
)
def reconciled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = read_tables(spark, sf_dir, ["lineitem"])
    wanted = [_CHECKS["range"], _CHECKS["duplicate_key"]]
    samples = None
    for check in wanted:
        counted = checks.failing_rows(tables, check, 10, _SAMPLE_ORDER).agg(
            F.lit(check.rule).alias("rule"), F.count(F.lit(1)).alias("sample_count")
        )
        samples = counted if samples is None else samples.unionByName(counted)
    return checks.reconcile(checks.scan(tables, wanted), samples)


@query(
    "scan_with_broken_rules",
    """SELECT 'priority_range' AS rule, CAST(NULL AS BIGINT) AS fail_count, CAST(NULL AS BIGINT) AS total_count, 'error' AS status
       UNION ALL SELECT 'one_by_zero', NULL, NULL, 'error'
       UNION ALL SELECT 'price_range', count(*) FILTER (WHERE o_totalprice > 100000), count(o_totalprice),
                        CASE WHEN count(*) FILTER (WHERE o_totalprice > 100000) > 0 THEN 'failed' ELSE 'passed' END FROM orders
       UNION ALL SELECT 'open_orders', count(*) FILTER (WHERE o_orderstatus = 'O'), count(*),
                        CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'O') > 0 THEN 'failed' ELSE 'passed' END FROM orders""",
)
def scan_with_broken_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules fail on values of the table; they alone become errors."""
    orders = read_tables(spark, sf_dir, ["orders"])["orders"]
    rules = [
        build_check("range", "orders", {"column": "o_orderpriority"}, {"min": 1}, rule="priority_range"),
        build_check("range", "orders", {"column": "o_totalprice"}, {"max": 100000}, rule="price_range"),
        build_check("predicate", "orders", {}, {"fails_if": "1 / (o_custkey - o_custkey) > 2"}, rule="one_by_zero"),
        build_check("predicate", "orders", {}, {"fails_if": "o_orderstatus = 'O'"}, rule="open_orders"),
        build_check("not_null", "orders", {"column": "o_custkey"}, rule="switched_off", enabled=False),
    ]
    return checks.scan({"orders": orders}, rules).select("rule", "fail_count", "total_count", "status")
