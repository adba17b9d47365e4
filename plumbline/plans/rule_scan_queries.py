"""SELECT checks, inclusions of columns, and one scan of all kinds of rules."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import checks, inclusion, rulescan
from plumbline.operators.checks import build_check
from plumbline.operators.drift import column_snapshot
from plumbline.plans.mart import META_CTES, mart
from plumbline.plans.metadata_queries import _findings_sql
from plumbline.plans.registry import query
from plumbline.sources.tables import columns_meta, read_tables

_SELECTS = [
    build_check(
        "sql", "orders", {}, rule="rich_orders_of_debtors", severity="high",
        threshold={"sql": "SELECT count_if(c_acctbal < 0) AS FAILED_COUNT, count(*) AS TOTAL_COUNT FROM {orders} JOIN {customer} "
                          "ON o_custkey = c_custkey WHERE o_totalprice > 200000"},
    ),
    build_check(
        "sql", "lineitem", {"column": "l_shipdate"}, rule="shipped_before_ordered",
        threshold={"sql": "SELECT count(*) AS total_count, count_if(l_shipdate < o_orderdate) AS failed_count FROM {lineitem} "
                          "JOIN {orders} ON l_orderkey = o_orderkey"},
    ),
    build_check(
        "sql", "orders", {}, rule="divides_by_zero", severity="low",
        threshold={"sql": "SELECT sum(o_custkey) DIV (count(*) - count(*)) AS failed_count, 1 AS total_count FROM {orders}"},
    ),
    build_check("sql", "orders", {}, rule="no_total", threshold={"sql": "SELECT count(*) AS failed_count FROM {orders}"}),
    build_check("sql", "orders", {}, rule="many_rows", threshold={"sql": "SELECT 1 AS failed_count, 1 AS total_count FROM {orders}"}),
    build_check("sql", "orders", {}, rule="no_table", threshold={"sql": "SELECT 1 AS failed_count, 1 AS total_count FROM {nothing}"}),
]
_ERROR = "CAST(NULL AS BIGINT) AS fail_count, CAST(NULL AS BIGINT) AS total_count, 'error' AS status"


@query(
    "sql_check",
    f"""WITH debtors AS (SELECT count(*) FILTER (WHERE c_acctbal < 0) AS f, count(*) AS t FROM orders JOIN customer ON o_custkey = c_custkey
                       WHERE o_totalprice > 200000),
           early AS (SELECT count(*) FILTER (WHERE l_shipdate < o_orderdate) AS f, count(*) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT 'rich_orders_of_debtors' AS rule, 'orders' AS "table", '' AS "column", 'high' AS severity, f AS fail_count, t AS total_count,
               CASE WHEN f > 0 THEN 'failed' ELSE 'passed' END AS status FROM debtors
        UNION ALL SELECT 'shipped_before_ordered', 'lineitem', 'l_shipdate', 'medium', f, t, CASE WHEN f > 0 THEN 'failed' ELSE 'passed' END FROM early
        UNION ALL SELECT 'divides_by_zero', 'orders', '', 'low', {_ERROR}
        UNION ALL SELECT r, 'orders', '', 'medium', {_ERROR} FROM (VALUES ('no_total'), ('many_rows'), ('no_table')) x(r)""",
)
def sql_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SELECTs over two tables, and four that cannot give two counts."""
    tables = read_tables(spark, sf_dir, ["orders", "customer", "lineitem"])
    return checks.scan(tables, _SELECTS).drop("error")


_KEYS = [
    ("region", "r_regionkey"), ("nation", "n_nationkey"), ("nation", "n_regionkey"), ("customer", "c_custkey"), ("customer", "c_nationkey"),
    ("supplier", "s_suppkey"), ("supplier", "s_nationkey"), ("part", "p_partkey"), ("orders", "o_orderkey"), ("orders", "o_custkey"),
    ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("lineitem", "l_suppkey"),
]


@query(
    "column_inclusions",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{t}' AS from_table, '{c}' AS from_column, '{p}' AS to_table, '{r}' AS to_column, count(*) AS total,
            count(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {r} FROM {p} WHERE {r} IS NOT NULL)) AS orphans FROM {t}"""
        for (t, c), (p, r) in permutations(_KEYS, 2)
    )
    + ") WHERE orphans <= 0.05 * total AND orphans < total",
)
def column_inclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of key columns of which the second holds all but a twentieth of the first, found from the values alone."""
    tables = read_tables(spark, sf_dir, sorted({t for t, _ in _KEYS}))
    return inclusion.inclusions(inclusion.index_values(tables, _KEYS), 0.05)


_RULES = ["NO_PRIMARY_KEY_HINT", "PII_COLUMN_NO_MASKING", "NULLABLE_ID_COLUMN", "DATE_STORED_AS_VARCHAR", "MISSING_UPDATED_AT"]


def _row(kind: str, rule: str, table: str, column: str, severity: str, fail: str, total: str, tail: str) -> str:
    return f"""SELECT '{kind}' AS kind, '{rule}' AS rule, '{table}' AS "table", '{column}' AS "column", '{severity}' AS severity,
        f AS fail_count, t AS total_count, CASE WHEN f > 0 THEN 'failed' ELSE 'passed' END AS status
        FROM (SELECT CAST({fail} AS BIGINT) AS f, CAST({total} AS BIGINT) AS t {tail})"""


_SCAN_SQL = " UNION ALL ".join(
    [
        _row("row", "customer_set", "ORDERS", "CUSTOMER_ID", "high", "count(*) - count(CUSTOMER_ID)", "count(*)", "FROM m_ORDERS"),
        _row("row", "amount_cap", "ORDERS", "TOTAL_AMOUNT", "medium", "count(*) FILTER (WHERE TOTAL_AMOUNT > 300000)", "count(TOTAL_AMOUNT)", "FROM m_ORDERS"),
        _row("row", "salary_floor", "CUSTOMERS", "SALARY", "low", "count(*) FILTER (WHERE SALARY < 0)", "count(SALARY)", "FROM m_CUSTOMERS"),
        _row("key", "order_unique", "LINE_ITEMS", "ORDER_ID", "medium",
             "coalesce(sum(n) FILTER (WHERE n > 1 AND ORDER_ID IS NOT NULL), 0)", "sum(n)", "FROM (SELECT ORDER_ID, count(*) AS n FROM m_LINE_ITEMS GROUP BY 1)"),
        _row("key", "event_customer", "EVENT_LOG", "CUSTOMER_ID", "high",
             "count(*) FILTER (WHERE CUSTOMER_ID IS NOT NULL AND CUSTOMER_ID NOT IN (SELECT CUSTOMER_ID FROM m_CUSTOMERS))", "count(*)", "FROM m_EVENT_LOG"),
        _row("select", "orders_per_customer", "ORDERS", "", "low", "count(*) FILTER (WHERE n > 20)", "count(*)",
             "FROM (SELECT count(*) AS n FROM m_ORDERS JOIN m_CUSTOMERS USING (CUSTOMER_ID) GROUP BY CUSTOMER_ID)"),
        f"""SELECT 'row', 'half_by_zero', 'SUPPLIER', '', 'medium', {_ERROR}""",
        f"""SELECT 'row', 'no_such_column', 'SUPPLIER', 'NOTHING', 'medium', {_ERROR}""",
        f"""SELECT 'metadata', rule_code, "table", "column", severity, 1, 1, 'failed' FROM ({_findings_sql(_RULES)})""",
        """SELECT 'drift', 'column_removed', 'CUSTOMERS', 'LEGACY_CODE', 'high', 1, 1, 'failed'""",
        """SELECT 'drift', 'column_added', 'ORDERS', 'TOTAL_AMOUNT', 'low', 1, 1, 'failed'""",
        """SELECT 'drift', 'table_removed', 'RETURNS', NULL, 'critical', 1, 1, 'failed'""",
    ]
)


@query("full_rule_scan", f"WITH {META_CTES} {_SCAN_SQL}")
def full_rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row, key, SELECT, metadata and drift rules of all mart tables; two rules cannot run."""
    tables = mart(spark, sf_dir)
    rules = [
        build_check("not_null", "ORDERS", {"column": "CUSTOMER_ID"}, rule="customer_set", severity="high"),
        build_check("range", "ORDERS", {"column": "TOTAL_AMOUNT"}, {"max": 300000}, rule="amount_cap"),
        build_check("range", "CUSTOMERS", {"column": "SALARY"}, {"min": 0}, rule="salary_floor", severity="low"),
        build_check("predicate", "SUPPLIER", {}, {"fails_if": "1 / (ID - ID) > 2"}, rule="half_by_zero"),
        build_check("not_null", "SUPPLIER", {"column": "NOTHING"}, rule="no_such_column"),
        build_check("uniqueness", "LINE_ITEMS", {"column": "ORDER_ID"}, rule="order_unique"),
        build_check("referential_integrity", "EVENT_LOG", {"column": "CUSTOMER_ID", "ref_table": "CUSTOMERS", "ref_column": "CUSTOMER_ID"},
                    rule="event_customer", severity="high"),
        build_check("sql", "ORDERS", {}, rule="orders_per_customer", severity="low", threshold={
            "sql": "SELECT count_if(n > 20) AS failed_count, count(*) AS total_count FROM (SELECT count(*) AS n FROM {ORDERS} o "
                   "JOIN {CUSTOMERS} c ON o.CUSTOMER_ID = c.CUSTOMER_ID GROUP BY c.CUSTOMER_ID)"}),
    ]
    # The scan before knew one more column and one more table, and not the amount of an order.
    declared = columns_meta(spark, tables).where("NOT (table = 'ORDERS' AND column = 'TOTAL_AMOUNT')").withColumn("is_nullable", F.lit(None).cast("string"))
    gone = spark.createDataFrame(
        [("CUSTOMERS", "LEGACY_CODE", "string"), ("RETURNS", "ID", "bigint")], "table string, column string, data_type string"
    ).withColumn("is_nullable", F.lit(None).cast("string"))
    prior = column_snapshot(declared.select(*gone.columns).unionByName(gone))
    return rulescan.full_rule_scan(tables, rules, _RULES, prior).drop("error")


_PRIMARY = {"customer": ["c_custkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "conversations": ["conv_id"]}
_UNIQUE = {"nation": ["n_name"], "part": ["p_name"]}


def _set(table: str, column: str) -> str:
    return f"""SELECT 'primary_key_set:{table}.{column}' AS rule, '{table}' AS "table", '{column}' AS "column", 'critical' AS severity,
        count(*) - count({column}) AS fail_count, count(*) AS total_count FROM {table}"""


def _unique(rule: str, table: str, columns: list[str], severity: str) -> str:
    whole = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    keys = ", ".join(columns)
    return f"""SELECT '{rule}', '{table}', '{",".join(columns)}', '{severity}', CAST(coalesce(sum(n) FILTER (WHERE n > 1 AND whole), 0) AS BIGINT),
        CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n, {whole} AS whole FROM {table} GROUP BY {keys})"""


@query(
    "declared_key_checks",
    "SELECT *, CASE WHEN fail_count > 0 THEN 'failed' ELSE 'passed' END AS status FROM ("
    + " UNION ALL ".join(
        [
            *[_set(t, c) for t, columns in _PRIMARY.items() for c in columns],
            *[_unique(f"primary_key:{t}", t, columns, "critical") for t, columns in _PRIMARY.items()],
            *[_unique(f"unique_key:{t}.{c}", t, [c], "high") for t, columns in _UNIQUE.items() for c in columns],
        ]
    )
    + ")",
)
def declared_key_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the declared keys of six tables promise; the turns of a conversation break one."""
    tables = read_tables(spark, sf_dir, [*_PRIMARY, *_UNIQUE])
    rules = checks.declared_key_checks(columns_meta(spark, tables, _PRIMARY, _UNIQUE))
    return checks.scan(tables, rules).drop("error")
