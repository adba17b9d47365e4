"""Key discovery on the warehouse-style views and on the star schema itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import profiling, relationships
from plumbline.plans.mart import MART_CTES, mart
from plumbline.plans.registry import query
from plumbline.policy import STAR_NAMING
from plumbline.sources.tables import columns_meta, read_tables

STAR_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

_OWNER_PARTS = {
    "CUSTOMER_ID": [("CUSTOMERS", "CUSTOMER_ID"), ("ORDERS", "CUSTOMER_ID"), ("EVENT_LOG", "CUSTOMER_ID")],
    "ORDER_ID": [("ORDERS", "ORDER_ID"), ("LINE_ITEMS", "ORDER_ID")],
    "NATION_ID": [("CUSTOMERS", "NATION_ID"), ("SUPPLIER", "NATION_ID")],
    "SUPPLIER_ID": [("LINE_ITEMS", "SUPPLIER_ID")],
    "ID": [("SUPPLIER", "ID")],
    "EVENT_KEY": [("EVENT_LOG", "EVENT_KEY")],
}
_RATIOS = " UNION ALL ".join(
    f"""SELECT '{name}' AS key_name, '{t}' AS "table", '{c}' AS "column",
               count(DISTINCT {c}) / CAST(count(*) AS DOUBLE) AS ratio FROM m_{t}"""
    for name, members in _OWNER_PARTS.items()
    for t, c in members
)
_OWNERS = f"""ratios AS ({_RATIOS}),
    owners AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key_name ORDER BY ratio DESC, "table") AS rn FROM ratios)
               WHERE rn = 1 AND ratio >= 0.5)"""


def _keys(spark: SparkSession, sf_dir: str):
    tables = mart(spark, sf_dir)
    return tables, relationships.classify_keys(columns_meta(spark, tables))


@query("key_uniqueness", f'WITH {MART_CTES} SELECT "table", "column", round(ratio, 6) AS ratio FROM ({_RATIOS})')
def key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relationships.uniqueness_ratios(*_keys(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


@query(
    "pk_ownership",
    f'WITH {MART_CTES}, {_OWNERS} SELECT key_name, "table", "column", round(ratio, 6) AS ratio FROM owners',
)
def pk_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, keys = _keys(spark, sf_dir)
    owners = relationships.key_owners(keys, relationships.uniqueness_ratios(tables, keys))
    return owners.select("key_name", "table", "column", F.round("ratio", 6).alias("ratio"))


#: Foreign-key shaped columns that are not their table's own key.
_FOREIGN = """foreign_keys(from_table, from_column) AS (VALUES ('CUSTOMERS', 'NATION_ID'), ('ORDERS', 'CUSTOMER_ID'),
    ('LINE_ITEMS', 'ORDER_ID'), ('LINE_ITEMS', 'PART_REF'), ('LINE_ITEMS', 'SUPPLIER_ID'), ('SUPPLIER', 'NATION_ID'),
    ('EVENT_LOG', 'EVENT_KEY'), ('EVENT_LOG', 'CUSTOMER_ID'))"""
_CANDIDATES = f"""{_OWNERS}, {_FOREIGN},
    exact AS (SELECT from_table, from_column, o."table" AS to_table, o."column" AS to_column, 'exact' AS match
              FROM foreign_keys JOIN owners o ON o.key_name = from_column WHERE o."table" <> from_table),
    pre AS (SELECT from_table, from_column, o."table" AS to_table, o."column" AS to_column, 'prefix' AS match
            FROM foreign_keys JOIN owners o ON o.key_name = 'ID' AND o."table" IN (
              regexp_replace(from_column, '(_ID|_KEY|_REF)$', ''), regexp_replace(from_column, '(_ID|_KEY|_REF)$', '') || 'S')
            WHERE o."table" <> from_table),
    cand AS (SELECT * FROM exact UNION ALL SELECT * FROM pre
             WHERE (from_table, from_column, to_table, to_column) NOT IN
                   (SELECT (from_table, from_column, to_table, to_column) FROM exact))"""


@query("fk_candidates", f"WITH {MART_CTES}, {_CANDIDATES} SELECT *, true AS type_ok FROM cand")
def fk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, keys = _keys(spark, sf_dir)
    owners = relationships.key_owners(keys, relationships.uniqueness_ratios(tables, keys))
    return relationships.candidates(keys, owners).drop("from_type", "to_type")


def _orphans(child: str, column: str, parent: str, ref: str) -> str:
    return f"""SELECT '{child}' AS from_table, '{column}' AS from_column, '{parent}' AS to_table, '{ref}' AS to_column,
        count(*) FILTER (WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {ref} FROM m_{parent} WHERE {ref} IS NOT NULL))
          AS orphans, count(*) AS total FROM m_{child}"""


_PAIRS = [
    ("ORDERS", "CUSTOMER_ID", "CUSTOMERS", "CUSTOMER_ID"), ("EVENT_LOG", "CUSTOMER_ID", "CUSTOMERS", "CUSTOMER_ID"),
    ("LINE_ITEMS", "ORDER_ID", "ORDERS", "ORDER_ID"), ("LINE_ITEMS", "SUPPLIER_ID", "SUPPLIER", "ID"),
    # Only one of these is a candidate, if any: NATION_ID is owned where it is most unique.
    ("CUSTOMERS", "NATION_ID", "SUPPLIER", "NATION_ID"), ("SUPPLIER", "NATION_ID", "CUSTOMERS", "NATION_ID"),
]
_CATALOG = f"""{_CANDIDATES}, counted AS ({" UNION ALL ".join(_orphans(*p) for p in _PAIRS)}),
    rel AS (SELECT from_table, from_column, to_table, to_column,
                   CASE WHEN orphans / CAST(total AS DOUBLE) >= 0.9 THEN 'rejected' ELSE 'confirmed' END AS status,
                   'verified' AS confidence, orphans / CAST(total AS DOUBLE) AS orphan_rate, total AS sample_total,
                   orphans AS sample_orphans
            FROM counted JOIN cand USING (from_table, from_column, to_table, to_column))"""


@query("orphan_rates", f"WITH {MART_CTES}, {_CATALOG} SELECT * REPLACE (round(orphan_rate, 6) AS orphan_rate) FROM rel")
def orphan_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = mart(spark, sf_dir)
    return relationships.discover(tables, columns_meta(spark, tables)).withColumn(
        "orphan_rate", F.round("orphan_rate", 6)
    )


_STAR_PAIRS = [
    ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]


@query(
    "star_relationships",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS from_table, '{k}' AS from_column, '{p}' AS to_table, '{r}' AS to_column, 'confirmed' AS status,
            'verified' AS confidence, round(count(*) FILTER (WHERE {k} NOT IN (SELECT {r} FROM {p})) / CAST(count(*) AS DOUBLE), 6)
              AS orphan_rate, count(*) AS sample_total, count(*) FILTER (WHERE {k} NOT IN (SELECT {r} FROM {p})) AS sample_orphans
            FROM {c}"""
        for c, k, p, r in _STAR_PAIRS
    ),
)
def star_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the star-schema naming policy ``o_custkey`` is read as ``CUSTKEY``."""
    tables = read_tables(spark, sf_dir, STAR_TABLES)
    return relationships.discover(tables, columns_meta(spark, tables), STAR_NAMING).withColumn(
        "orphan_rate", F.round("orphan_rate", 6)
    )


@query(
    "deterministic_rule_candidates",
    f"""WITH {MART_CTES}, {_CATALOG}, k AS (
          SELECT 'EVENT_LOG' AS "table", 'EVENT_KEY' AS "column", count(EVENT_KEY) - count(DISTINCT EVENT_KEY) AS dup FROM m_EVENT_LOG
          UNION ALL SELECT 'SUPPLIER', 'ID', count(ID) - count(DISTINCT ID) FROM m_SUPPLIER
          UNION ALL SELECT 'TURNS', 'CONVERSATION_KEY', count(conv_id) - count(DISTINCT conv_id) FROM conversations)
        SELECT "table", "column", 'uniqueness' AS shape, CAST(NULL AS VARCHAR) AS ref_table, CAST(NULL AS VARCHAR) AS ref_column,
               'high' AS severity, dup AS violations FROM k WHERE dup > 0
        UNION ALL SELECT from_table, from_column, 'referential_integrity', to_table, to_column, 'high', sample_orphans
        FROM rel WHERE status = 'confirmed' AND orphan_rate > 0""",
)
def deterministic_rule_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the profiles of all columns of all tables; the turns of a conversation share its key."""
    tables = mart(spark, sf_dir)
    found = relationships.discover(tables, columns_meta(spark, tables))
    turns = read_tables(spark, sf_dir, ["conversations"])["conversations"].selectExpr(
        "conv_id AS CONVERSATION_KEY", "turn AS TURN_NO", "role AS SPEAKER", "text AS MESSAGE"
    )
    profiles = [profiling.profile_columns(df, name) for name, df in {**tables, "TURNS": turns}.items()]
    key_columns = profiling.key_candidates(reduce(DataFrame.unionByName, profiles))
    none = spark.createDataFrame([], "table string, column string")
    return relationships.rule_candidates(key_columns, found, none)


@query(
    "relationship_freshness",
    f"""WITH {MART_CTES}, {_CATALOG}, v AS (SELECT from_table, to_table, max_at AS last_verified_at
          FROM rel, (SELECT max(o_orderdate) AS max_at FROM orders))
        SELECT t AS "table", coalesce((SELECT min(last_verified_at) FROM v WHERE from_table = t OR to_table = t)
                                       > TIMESTAMP '2001-08-02 00:00:00' - INTERVAL 24 HOUR, false) AS fresh
        FROM (VALUES ('CUSTOMERS'), ('ORDERS'), ('LINE_ITEMS'), ('SUPPLIER'), ('EVENT_LOG'), ('PARTS')) x(t)""",
)
def relationship_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = mart(spark, sf_dir)
    found = relationships.discover(tables, columns_meta(spark, tables))
    newest = tables["ORDERS"].agg(F.max("CREATED_AT")).first()[0]
    stamped = found.withColumn("last_verified_at", F.lit(str(newest)).cast("timestamp_ntz"))
    names = spark.createDataFrame([(t,) for t in (*tables, "PARTS")], "table string")
    return relationships.catalog_is_fresh(stamped, names, "2001-08-02 00:00:00")
