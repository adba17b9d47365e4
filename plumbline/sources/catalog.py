"""Catalogs: which databases, schemas and tables exist."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SCHEMA = (
    "object_kind string, database string, schema string, table string, fqn string, comment string"
)


def object_kind(table_type: Column) -> Column:
    """Kind of a catalog object from the type name its catalog gives."""
    kind = F.upper(F.coalesce(table_type, F.lit("")))
    return (
        F.when(F.contains(kind, F.lit("MATERIALIZED")) & F.contains(kind, F.lit("VIEW")), "materialized_view")
        .when(F.contains(kind, F.lit("DYNAMIC")), "dynamic_table")
        .when(F.contains(kind, F.lit("EXTERNAL")), "external_table")
        .when(F.contains(kind, F.lit("ICEBERG")), "iceberg_table")
        .when(F.contains(kind, F.lit("VIEW")), "view")
        .otherwise("table")
    )


def session_catalog(spark: SparkSession, catalog: str | None = None) -> DataFrame:
    """Schemas and tables the session's catalog knows (metadata, one row per object)."""
    name = catalog or spark.catalog.currentCatalog()
    rows = []
    for database in spark.catalog.listDatabases():
        rows.append(("schema", name, database.name, None, f"{name}.{database.name}", database.description))
        for t in spark.catalog.listTables(database.name):
            rows.append((t.tableType, name, database.name, t.name, f"{name}.{database.name}.{t.name}", t.description))
    found = spark.createDataFrame(rows, CATALOG_SCHEMA)
    return found.withColumn(
        "object_kind", F.when(F.col("table").isNull(), "schema").otherwise(object_kind(F.col("object_kind")))
    )


def full_catalog(objects: DataFrame) -> DataFrame:
    """One row per schema plus one per object.

    ``objects``: database, schema, table, table_type, row_count, size_bytes.
    """
    known = objects.where(F.upper("schema") != "INFORMATION_SCHEMA")
    schemas = (
        known.select("database", "schema")
        .distinct()
        .select(
            F.lit("schema").alias("object_kind"),
            "database",
            "schema",
            F.lit(None).cast("string").alias("table"),
            F.concat_ws(".", "database", "schema").alias("fqn"),
            F.lit(None).cast("bigint").alias("row_count"),
            F.lit(None).cast("bigint").alias("size_bytes"),
        )
    )
    tables = known.where(F.col("table").isNotNull()).select(
        object_kind(F.col("table_type")).alias("object_kind"),
        "database",
        "schema",
        "table",
        F.concat_ws(".", "database", "schema", "table").alias("fqn"),
        "row_count",
        "size_bytes",
    )
    return schemas.unionByName(tables)


def table_info(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Exact row count and column count of each table."""
    parts = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table"), "row_count", F.lit(len(df.columns)).alias("column_count")
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


def expand_scope(
    catalog: DataFrame,
    scope: str,
    database: str,
    schema: str | None = None,
    table: str | None = None,
) -> DataFrame:
    """The ordered (database, schema, table) targets of a table, schema or database scope."""
    scope = (scope or "table").lower()
    if scope not in ("table", "schema", "database"):
        raise ValueError(f"unknown scope {scope!r}")
    if scope == "table" and not (schema and table):
        raise ValueError("scope table needs a schema and a table")
    if scope == "schema" and not schema:
        raise ValueError("scope schema needs a schema")
    targets = catalog.where(F.col("table").isNotNull() & (F.col("database") == database))
    if scope != "database":
        targets = targets.where(F.col("schema") == schema)
    if scope == "table":
        targets = targets.where(F.col("table") == table)
    return targets.select("database", "schema", "table").distinct().orderBy("database", "schema", "table")
