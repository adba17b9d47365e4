"""A warehouse-style view of the star schema, and page structure as a schema.

The naming rules and the key discovery look for names such as ``CUSTOMER_ID``.
These views give the test tables such names; every row comes from the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.tables import read_tables

MART_TABLES = ("CUSTOMERS", "ORDERS", "LINE_ITEMS", "SUPPLIER", "EVENT_LOG")


def mart(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = read_tables(spark, sf_dir, ["customer", "orders", "lineitem", "supplier", "events"])
    return {
        "CUSTOMERS": t["customer"].selectExpr(
            "c_custkey AS CUSTOMER_ID", "c_name AS CUSTOMER_EMAIL", "c_nationkey AS NATION_ID",
            "c_acctbal AS SALARY", "c_mktsegment AS TYPE",
        ),
        "ORDERS": t["orders"].selectExpr(
            "o_orderkey AS ORDER_ID",
            "CASE WHEN o_orderstatus = 'P' AND o_totalprice < 50000 THEN NULL ELSE o_custkey END AS CUSTOMER_ID",
            "o_orderstatus AS IS_OPEN", "CAST(CAST(o_orderdate AS DATE) AS STRING) AS ORDER_DATE",
            "o_totalprice AS TOTAL_AMOUNT", "o_orderpriority AS UNIT_PRICE", "o_orderdate AS CREATED_AT",
        ),
        "LINE_ITEMS": t["lineitem"].selectExpr(
            "l_orderkey AS ORDER_ID", "l_partkey AS PART_REF", "l_suppkey AS SUPPLIER_ID",
            "l_quantity AS lineQuantity", "l_extendedprice AS extendedPrice", "l_tax AS VALUE",
            "l_shipdate AS ship_date", "l_returnflag AS return_flag",
        ),
        "SUPPLIER": t["supplier"].selectExpr(
            "s_suppkey AS ID", "s_name AS SUPPLIER_NAME", "s_nationkey AS NATION_ID", "s_acctbal AS BALANCE"
        ),
        "EVENT_LOG": t["events"].selectExpr(
            "event_id AS EVENT_KEY", "user_id AS CUSTOMER_ID", "ts AS EVENT_TS", "event_type AS EVENT_FLAG",
            "value AS AMOUNT",
        ),
    }


#: The same views in SQL, with the Spark type of each column.
MART_SQL = {
    "CUSTOMERS": (
        "SELECT c_custkey AS CUSTOMER_ID, c_name AS CUSTOMER_EMAIL, c_nationkey AS NATION_ID, c_acctbal AS SALARY, "
        "c_mktsegment AS TYPE FROM customer",
        {"CUSTOMER_ID": "bigint", "CUSTOMER_EMAIL": "string", "NATION_ID": "int", "SALARY": "double", "TYPE": "string"},
    ),
    "ORDERS": (
        "SELECT o_orderkey AS ORDER_ID, CASE WHEN o_orderstatus = 'P' AND o_totalprice < 50000 THEN NULL "
        "ELSE o_custkey END AS CUSTOMER_ID, o_orderstatus AS IS_OPEN, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) "
        "AS ORDER_DATE, o_totalprice AS TOTAL_AMOUNT, o_orderpriority AS UNIT_PRICE, o_orderdate AS CREATED_AT FROM orders",
        {"ORDER_ID": "bigint", "CUSTOMER_ID": "bigint", "IS_OPEN": "string", "ORDER_DATE": "string",
         "TOTAL_AMOUNT": "double", "UNIT_PRICE": "string", "CREATED_AT": "timestamp_ntz"},
    ),
    "LINE_ITEMS": (
        'SELECT l_orderkey AS ORDER_ID, l_partkey AS PART_REF, l_suppkey AS SUPPLIER_ID, l_quantity AS "lineQuantity", '
        'l_extendedprice AS "extendedPrice", l_tax AS "VALUE", l_shipdate AS ship_date, l_returnflag AS return_flag '
        "FROM lineitem",
        {"ORDER_ID": "bigint", "PART_REF": "bigint", "SUPPLIER_ID": "bigint", "lineQuantity": "double",
         "extendedPrice": "double", "VALUE": "double", "ship_date": "timestamp_ntz", "return_flag": "string"},
    ),
    "SUPPLIER": (
        "SELECT s_suppkey AS ID, s_name AS SUPPLIER_NAME, s_nationkey AS NATION_ID, s_acctbal AS BALANCE FROM supplier",
        {"ID": "bigint", "SUPPLIER_NAME": "string", "NATION_ID": "int", "BALANCE": "double"},
    ),
    "EVENT_LOG": (
        "SELECT event_id AS EVENT_KEY, user_id AS CUSTOMER_ID, ts AS EVENT_TS, event_type AS EVENT_FLAG, "
        "value AS AMOUNT FROM events",
        {"EVENT_KEY": "bigint", "CUSTOMER_ID": "bigint", "EVENT_TS": "timestamp_ntz", "EVENT_FLAG": "string",
         "AMOUNT": "double"},
    ),
}

#: CTEs: mart tables (``m_<name>``) and their observed column metadata (``meta``).
MART_CTES = ", ".join(f"m_{t} AS ({sql})" for t, (sql, _) in MART_SQL.items())
META_CTES = (
    MART_CTES
    + ", meta AS ("
    + " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", '{kind}' AS data_type,
            CASE WHEN count(*) > count("{c}") THEN 'YES' ELSE 'NO' END AS is_nullable FROM m_{t}"""
        for t, (_, columns) in MART_SQL.items()
        for c, kind in columns.items()
    )
    + ")"
)


def page_structure(spark: SparkSession, sf_dir: str, scheme: str | None = None) -> DataFrame:
    """The element inventory of each site as column metadata.

    Table = host, column = element; an element is nullable if some page of the
    site lacks it, and an ARRAY if some page repeats it. ``scheme`` picks the
    http or the https capture, which play the prior and the live scan; by default all pages count.
    """
    pages = read_tables(spark, sf_dir, ["pages"])["pages"]
    parts = pages.select(
        "page_id",
        "html",
        F.regexp_extract("url", r"^(https?)://", 1).alias("scheme"),
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("table"),
    )
    if scheme is not None:
        parts = parts.where(F.col("scheme") == scheme)
    totals = parts.groupBy("table").agg(F.count(F.lit(1)).alias("pages"))
    elements = parts.select(
        "table", "page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), 1)).alias("element")
    )
    per_page = elements.groupBy("table", F.lower("element").alias("column"), "page_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    per_site = per_page.groupBy("table", "column").agg(
        F.max("n").alias("most"), F.count(F.lit(1)).alias("with_it")
    )
    return per_site.join(totals, "table").select(
        "table",
        "column",
        F.when(F.col("most") > 1, F.concat(F.lit("ARRAY("), F.col("most").cast("string"), F.lit(")")))
        .otherwise("SCALAR")
        .alias("data_type"),
        F.when(F.col("with_it") < F.col("pages"), "YES").otherwise("NO").alias("is_nullable"),
    )


def page_structure_sql(scheme: str | None = None) -> str:
    chosen = f"WHERE regexp_extract(url, '^(https?)://', 1) = '{scheme}'" if scheme else ""
    return f"""
    (WITH p AS (SELECT page_id, html, regexp_extract(url, '^https?://([^/]+)', 1) AS "table" FROM pages {chosen}),
          t AS (SELECT "table", count(*) AS pages FROM p GROUP BY 1),
          e AS (SELECT "table", page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS "column"
                FROM p),
          g AS (SELECT "table", "column", page_id, count(*) AS n FROM e GROUP BY 1, 2, 3),
          s AS (SELECT "table", "column", max(n) AS most, count(*) AS with_it FROM g GROUP BY 1, 2)
     SELECT "table", upper("column") AS "column",
            CASE WHEN most > 1 THEN 'ARRAY(' || most || ')' ELSE 'SCALAR' END AS data_type,
            with_it < pages AS nullable
     FROM s JOIN t USING ("table"))"""
