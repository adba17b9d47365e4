"""Conventions, documentation, schema drift and catalog queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import policy
from plumbline.operators import conventions, drift
from plumbline.plans.mart import META_CTES, mart, page_structure, page_structure_sql
from plumbline.plans.registry import query
from plumbline.session import fresh_path
from plumbline.sources import catalog, state
from plumbline.sources.tables import observed_columns_meta, read_tables

ALL_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_U = 'upper("column")'
_BASE = "upper(trim(split_part(data_type, '(', 1)))"
_TEXT = f"{_BASE} IN ({_quoted(policy.TEXT_TYPES)})"
_PII = " OR ".join(f"regexp_matches({_U}, '{p}')" for p in policy.PII_PATTERNS)
_WRONG = (
    "CASE "
    + " ".join(
        f"WHEN regexp_matches({_U}, '{p}') THEN CASE WHEN {_BASE} NOT IN ({_quoted(a)}) THEN '{c}' END"
        for p, a, c in policy.NAME_TYPE_RULES
    )
    + " END"
)
_OWN = (
    f"({_U} = rtrim(upper(\"table\"), 'S') || '_ID' OR {_U} IN ('SURROGATE_KEY', 'ROW_ID', 'RECORD_ID'))"
)

_COLUMN_SQL = {
    "PII_COLUMN_NO_MASKING": ("high", f"{_U} IN ({_quoted(policy.PII_NAMES)}) OR {_PII}"),
    "NULLABLE_ID_COLUMN": ("high", f"regexp_matches({_U}, '{policy.NULLABLE_KEY_SHAPE}') AND is_nullable = 'YES'"),
    "DATE_STORED_AS_VARCHAR": ("high", f"regexp_matches({_U}, '{policy.DATE_SHAPE}') AND {_TEXT}"),
    "BOOLEAN_STORED_AS_VARCHAR": ("medium", f"regexp_matches({_U}, '{policy.FLAG_SHAPE}') AND {_TEXT}"),
    "FK_COLUMN_NO_CONSTRAINT": ("low", f"regexp_matches({_U}, '_ID$') AND NOT {_OWN}"),
    "GENERIC_COLUMN_NAME": ("low", f"{_U} IN ({_quoted(policy.GENERIC_NAMES)})"),
}
_TABLE_SQL = {
    "NO_PRIMARY_KEY_HINT": ("medium", f"NOT bool_or(regexp_matches({_U}, '{policy.KEY_SHAPE}'))"),
    "MISSING_CREATED_AT": ("medium", f"NOT bool_or({_U} IN ({_quoted(policy.CREATED_AT_NAMES)}))"),
    "MISSING_UPDATED_AT": ("low", f"NOT bool_or({_U} IN ({_quoted(policy.UPDATED_AT_NAMES)}))"),
    "TOO_MANY_COLUMNS": ("low", f"count(*) > {policy.MAX_COLUMNS}"),
    "INCONSISTENT_COLUMN_NAMING": (
        "low",
        """count(*) >= 3 AND
           CAST(count(*) FILTER (WHERE contains("column", '_') AND "column" = upper("column")) > 1 AS INT)
         + CAST(count(*) FILTER (WHERE contains("column", '_') AND "column" = lower("column")) > 1 AS INT)
         + CAST(count(*) FILTER (WHERE NOT contains("column", '_') AND regexp_matches("column", '[a-z][A-Z]')) > 1 AS INT)
           >= 2""",
    ),
}


def _findings_sql(rules) -> str:
    parts = []
    for code, (severity, test) in _COLUMN_SQL.items():
        if code in rules:
            parts.append(
                f"""SELECT "table", "column", '{code}' AS rule_code, '{severity}' AS severity FROM meta WHERE {test}"""
            )
    if "COLUMN_WRONG_TYPE" in rules:
        parts.append(
            f"""SELECT "table", "column", {_WRONG} AS rule_code, 'medium' AS severity FROM meta
                WHERE {_WRONG} IS NOT NULL"""
        )
    for code, (severity, test) in _TABLE_SQL.items():
        if code in rules:
            parts.append(
                f"""SELECT "table", CAST(NULL AS VARCHAR) AS "column", '{code}' AS rule_code, '{severity}' AS severity
                    FROM meta GROUP BY "table" HAVING {test}"""
            )
    return " UNION ALL ".join(parts)


_EVERY_RULE = [*_COLUMN_SQL, "COLUMN_WRONG_TYPE", *_TABLE_SQL]


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed_columns_meta(spark, mart(spark, sf_dir))


@query("convention_checks", f"WITH {META_CTES} {_findings_sql(_EVERY_RULE)}")
def convention_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conventions.check_conventions(_meta(spark, sf_dir), conventions.all_rule_names())


@query("observed_columns_meta", f'WITH {META_CTES} SELECT "table", "column", data_type, is_nullable FROM meta')
def observed_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _meta(spark, sf_dir).select("table", "column", "data_type", "is_nullable")


@query(
    "schema_gate_findings",
    f"""WITH {META_CTES} SELECT *, severity IN ('critical', 'high') AS blocks
        FROM ({_findings_sql(conventions.ACTIVE_RULES)})""",
)
def schema_gate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conventions.schema_gate(_meta(spark, sf_dir))[0]


@query(
    "schema_gate_summary",
    f"""WITH {META_CTES}, f AS ({_findings_sql(conventions.ACTIVE_RULES)})
        SELECT (SELECT count(DISTINCT "table") + 4 * count(*) FROM meta) AS rules_checked,
               count(*) AS finding_count, count(*) FILTER (WHERE severity IN ('critical', 'high')) AS blocked_by,
               count(*) FILTER (WHERE severity IN ('critical', 'high')) = 0 AS passed FROM f""",
)
def schema_gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conventions.schema_gate(_meta(spark, sf_dir))[1]


@query(
    "missing_documentation",
    f"""WITH {META_CTES}
        SELECT "table", CAST(NULL AS VARCHAR) AS "column", 'MISSING_TABLE_COMMENT' AS rule_code, 'medium' AS severity
        FROM meta GROUP BY 1
        UNION ALL SELECT "table", NULL, 'MISSING_TABLE_OWNER', 'medium' FROM meta WHERE is_nullable = 'YES' GROUP BY 1
        UNION ALL SELECT "table", "column", 'MISSING_COLUMN_COMMENT', 'low' FROM meta WHERE data_type <> 'bigint'""",
)
def missing_documentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer columns count as documented, tables without NULLs as owned."""
    meta = _meta(spark, sf_dir)
    columns = meta.withColumn("comment", F.when(F.col("data_type") == "bigint", "a key").otherwise("  "))
    tables = meta.groupBy("table").agg(
        F.when(F.bool_or(F.col("is_nullable") == "YES"), F.lit(" ")).otherwise("data team").alias("owner"),
        F.lit(None).cast("string").alias("comment"),
    )
    return conventions.missing_documentation(columns, tables)


@query(
    "findings_with_instance",
    f"""WITH {META_CTES}, f AS ({_findings_sql(conventions.ACTIVE_RULES)}),
        i AS (SELECT "table", 'i-' || lower("table") AS instance_id FROM meta WHERE is_nullable = 'YES' GROUP BY 1)
        SELECT f."table", f."column", f.rule_code, f.severity, i.instance_id
        FROM f JOIN i ON f."table" = i."table" AND f.rule_code IN ('NULLABLE_ID_COLUMN', 'DATE_STORED_AS_VARCHAR')""",
)
def findings_with_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = _meta(spark, sf_dir)
    holes = meta.where(F.col("is_nullable") == "YES").select("table").distinct()
    instances = holes.select(
        "table",
        F.explode(F.array(F.lit("nullable_id_column"), F.lit("date_stored_as_varchar"))).alias("handler_key"),
        F.concat(F.lit("i-"), F.lower("table")).alias("instance_id"),
    )
    return conventions.with_approved_instance(conventions.check_conventions(meta), instances)


_DRIFT_SQL = f"""
    WITH prior AS {page_structure_sql("http")}, live AS {page_structure_sql("https")},
    gone AS (SELECT DISTINCT "table" FROM prior WHERE "table" NOT IN (SELECT "table" FROM live)),
    both_sides AS (SELECT DISTINCT "table" FROM prior WHERE "table" IN (SELECT "table" FROM live)),
    j AS (SELECT coalesce(p."table", l."table") AS "table", coalesce(p."column", l."column") AS "column",
                 p.data_type AS ot, l.data_type AS nt, p.nullable AS o, l.nullable AS n,
                 p."table" IS NOT NULL AS in_old, l."table" IS NOT NULL AS in_new
          FROM prior p FULL JOIN live l ON p."table" = l."table" AND p."column" = l."column"
          WHERE coalesce(p."table", l."table") IN (SELECT "table" FROM both_sides))
    SELECT "table", CAST(NULL AS VARCHAR) AS "column", 'table_removed' AS change, 'critical' AS severity,
           CAST(NULL AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS after FROM gone
    UNION ALL SELECT "table", "column", 'column_added', 'low', NULL, nt FROM j WHERE NOT in_old
    UNION ALL SELECT "table", "column", 'column_removed', 'high', ot, NULL FROM j WHERE NOT in_new
    UNION ALL SELECT "table", "column", 'column_type_changed', 'high', ot, nt FROM j
      WHERE in_old AND in_new AND split_part(ot, '(', 1) <> split_part(nt, '(', 1)
    UNION ALL SELECT "table", "column", 'column_nullability_changed', 'medium',
           CASE WHEN o THEN 'NULLABLE' ELSE 'NOT NULL' END, CASE WHEN n THEN 'NULLABLE' ELSE 'NOT NULL' END
      FROM j WHERE in_old AND in_new AND o <> n"""


@query("schema_drift", _DRIFT_SQL)
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = drift.column_snapshot(page_structure(spark, sf_dir, "http"))
    live = drift.column_snapshot(page_structure(spark, sf_dir, "https"))
    return drift.schema_drift(prior, live)


@query("column_snapshot", f"SELECT * FROM {page_structure_sql()}")
def column_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.column_snapshot(page_structure(spark, sf_dir))


@query(
    "table_info",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", count(*) AS row_count,
            (SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE {t})) AS column_count FROM {t}"""
        for t in ALL_TABLES
    ),
)
def table_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table_info(read_tables(spark, sf_dir, ALL_TABLES))


#: Suppliers as catalog objects: region.nation.supplier, with the rows each one ships.
OBJECTS_SQL = """
    SELECT r_name AS "database", n_name AS "schema", s_name AS "table",
           CASE WHEN s_acctbal < 0 THEN 'EXTERNAL TABLE' WHEN s_acctbal > 9000 THEN 'MATERIALIZED VIEW'
                WHEN s_acctbal > 8000 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type,
           count(l_orderkey) AS row_count, CAST(count(l_orderkey) * 100 AS BIGINT) AS size_bytes
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN lineitem ON l_suppkey = s_suppkey
    GROUP BY s_suppkey, r_name, n_name, s_name, s_acctbal"""


def supplier_objects(spark: SparkSession, sf_dir: str, until: str | None = None, since: str | None = None) -> DataFrame:
    t = read_tables(spark, sf_dir, ["supplier", "nation", "region", "lineitem"])
    lines = t["lineitem"]
    if until:
        lines = lines.where(F.col("l_shipdate") < F.lit(until).cast("timestamp_ntz"))
    if since:
        lines = lines.where(F.col("l_shipdate") >= F.lit(since).cast("timestamp_ntz"))
    shipped = lines.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("row_count"))
    places = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    balance = F.col("s_acctbal")
    return (
        t["supplier"]
        .join(places, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(shipped, "s_suppkey", "left")
        .select(
            F.col("r_name").alias("database"),
            F.col("n_name").alias("schema"),
            F.col("s_name").alias("table"),
            F.when(balance < 0, "EXTERNAL TABLE")
            .when(balance > 9000, "MATERIALIZED VIEW")
            .when(balance > 8000, "VIEW")
            .otherwise("BASE TABLE")
            .alias("table_type"),
            F.coalesce("row_count", F.lit(0)).alias("row_count"),
            (F.coalesce("row_count", F.lit(0)) * 100).alias("size_bytes"),
        )
    )


@query(
    "full_catalog",
    f"""WITH o AS ({OBJECTS_SQL})
        SELECT DISTINCT 'schema' AS object_kind, "database", "schema", CAST(NULL AS VARCHAR) AS "table",
               "database" || '.' || "schema" AS fqn, CAST(NULL AS BIGINT) AS row_count, CAST(NULL AS BIGINT) AS size_bytes
        FROM o
        UNION ALL
        SELECT CASE table_type WHEN 'EXTERNAL TABLE' THEN 'external_table' WHEN 'MATERIALIZED VIEW' THEN 'materialized_view'
                               WHEN 'VIEW' THEN 'view' ELSE 'table' END,
               "database", "schema", "table", "database" || '.' || "schema" || '.' || "table", row_count, size_bytes
        FROM o""",
)
def full_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.full_catalog(supplier_objects(spark, sf_dir))


@query(
    "scope_targets",
    f"""WITH o AS ({OBJECTS_SQL}) SELECT DISTINCT "database", "schema", "table" FROM o WHERE "database" = 'ASIA'""",
)
def scope_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.expand_scope(catalog.full_catalog(supplier_objects(spark, sf_dir)), "database", "ASIA")


def _assets(spark: SparkSession, sf_dir: str, **period: str) -> DataFrame:
    objects = supplier_objects(spark, sf_dir, **period)
    return objects.where(F.col("row_count") > 0).select(
        F.concat_ws(".", "database", "schema", "table").alias("fqn"), "table_type", "row_count"
    )


_ASSET_SQL = """
    SELECT r_name || '.' || n_name || '.' || s_name AS fqn, count(*) AS row_count
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    JOIN lineitem ON l_suppkey = s_suppkey WHERE l_shipdate {test} TIMESTAMP '{moment} 00:00:00' GROUP BY s_suppkey, 1"""


@query(
    "asset_upsert",
    f"""WITH a AS ({_ASSET_SQL.format(test="<", moment="2001-09-15")}),
             b AS ({_ASSET_SQL.format(test=">=", moment="2001-09-15")})
        SELECT coalesce(b.fqn, a.fqn) AS fqn, coalesce(b.row_count, a.row_count) AS row_count,
               CASE WHEN b.fqn IS NULL THEN 'old' ELSE 'new' END AS origin
        FROM a FULL JOIN b ON a.fqn = b.fqn""",
)
def asset_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _assets(spark, sf_dir, until="2001-09-15").select("fqn", "row_count", F.lit("old").alias("origin"))
    new = _assets(spark, sf_dir, since="2001-09-15").select("fqn", "row_count", F.lit("new").alias("origin"))
    return state.upsert(old, new, "fqn")


@query(
    "append_log_sink",
    """SELECT CAST(ts AS DATE) AS "day", count(*) AS n, round(sum(value), 2) AS total
       FROM events GROUP BY 1""",
)
def append_log_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to a day-partitioned log, read back."""
    events = read_tables(spark, sf_dir, ["events"])["events"]
    path = fresh_path(spark, "event-log")
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    state.append_log(events.where(F.col("ts") < middle), path, "ts")
    state.append_log(events.where(F.col("ts") >= middle), path, "ts")
    log = state.read_log(spark, path)
    return log.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "replace_scope_sink",
    """SELECT o_orderstatus, count(*) AS n, CASE WHEN o_orderstatus = 'F' THEN 'second' ELSE 'first' END AS written
       FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice > 250000 GROUP BY 1""",
)
def replace_scope_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all scopes, then replace one of them; the others stay."""
    orders = read_tables(spark, sf_dir, ["orders"])["orders"].select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = fresh_path(spark, "order-scopes")
    state.replace_scope(orders.withColumn("written", F.lit("first")), path, ["o_orderstatus"])
    again = orders.where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 250000))
    state.replace_scope(again.withColumn("written", F.lit("second")), path, ["o_orderstatus"])
    return spark.read.parquet(path).groupBy("o_orderstatus", "written").agg(F.count(F.lit(1)).alias("n"))


@query(
    "replace_scope_empty",
    """SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""",
)
def replace_scope_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scope replaced by nothing is gone; the others stay."""
    orders = read_tables(spark, sf_dir, ["orders"])["orders"].select("o_orderkey", "o_orderstatus")
    path = fresh_path(spark, "order-versions")
    state.replace_where(orders, path, F.lit(False))
    state.replace_where(orders.where("false"), path, F.col("o_orderstatus") == "F")
    return state.read_version(spark, path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "replace_edges_either_side",
    """SELECT l_suppkey % 50 AS source, l_partkey % 50 AS target, count(*) AS n FROM lineitem
       WHERE l_suppkey % 50 <> 7 AND l_partkey % 50 <> 7 GROUP BY 1, 2
       UNION ALL SELECT 7, l_partkey % 50, count(*) FROM lineitem WHERE l_suppkey % 50 = 7 AND l_quantity > 25 GROUP BY 2""",
)
def replace_edges_either_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges at either side of a node replaced by what a new look at its source side found."""
    lines = read_tables(spark, sf_dir, ["lineitem"])["lineitem"].select(
        (F.col("l_suppkey") % 50).alias("source"), (F.col("l_partkey") % 50).alias("target"), "l_quantity"
    )
    path = fresh_path(spark, "edge-versions")
    touching = (F.col("source") == 7) | (F.col("target") == 7)
    state.replace_where(lines, path, F.lit(False))
    state.replace_where(lines.where((F.col("source") == 7) & (F.col("l_quantity") > 25)), path, touching)
    return state.read_version(spark, path).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
