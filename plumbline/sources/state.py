"""State tables: logs that grow, scopes that are replaced, rows that are upserted."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_log(df: DataFrame, path: str, moment_column: str) -> None:
    """Append rows to a log partitioned by day; older days are never touched.

    Rows of a day are brought together first, so that a day gets a few files and
    not one per task. AQE splits a day too large for one task.
    """
    dated = df.withColumn("day", F.to_date(F.col(moment_column)))
    dated.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log; columns added later read as NULL in older files."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def replace_scope(df: DataFrame, path: str, scope: Sequence[str]) -> None:
    """Replace the partitions ``df`` has rows for and keep all others.

    A scope that becomes empty has no rows here; ``replace_where`` names it.
    """
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*scope)
        .parquet(path)
    )


def replace_where(df: DataFrame, path: str, condition: Column) -> None:
    """Replace the rows that satisfy ``condition`` by ``df``, which may be empty.

    The table is kept in versions: the rows that stay and the new ones are written as the
    next version, which counts once it is complete. A NULL condition keeps a row.
    """
    spark = df.sparkSession
    newest = _newest_version(spark, path)
    rows = df
    if newest:
        kept = spark.read.parquet(f"{path}/version={newest}").where(~F.coalesce(condition, F.lit(False)))
        rows = kept.unionByName(df, allowMissingColumns=True)
    rows.write.parquet(f"{path}/version={newest + 1}")


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table written by ``replace_where``."""
    return spark.read.parquet(f"{path}/version={_newest_version(spark, path)}")


def _newest_version(spark: SparkSession, path: str) -> int:
    """0 if there is none. A version is complete when its job has committed its files."""
    try:
        files = spark.read.parquet(path).inputFiles()
    except AnalysisException:
        return 0
    return max((int(v) for f in files for v in re.findall(r"/version=(\d+)/", f)), default=0)


def upsert(current: DataFrame, incoming: DataFrame, key: str, keep_when_null: bool = True) -> DataFrame:
    """Rows of both by ``key``; incoming values win, and NULLs in them keep the old value.

    Columns only one side has are kept. Both sides have to be unique by ``key``.
    """
    names = [c for c in current.columns if c != key]
    names += [c for c in incoming.columns if c != key and c not in names]
    old = current.select(key, *[F.col(c).alias(f"__old_{c}") for c in current.columns if c != key])
    new = incoming.select(
        key, *[F.col(c).alias(f"__new_{c}") for c in incoming.columns if c != key], F.lit(True).alias("__in")
    )
    joined = old.join(new, key, "full")

    def merged(c: str) -> Column:
        if c not in incoming.columns:
            return F.col(f"__old_{c}")
        if c not in current.columns:
            return F.col(f"__new_{c}")
        if keep_when_null:
            return F.coalesce(f"__new_{c}", f"__old_{c}")
        return F.when(F.col("__in"), F.col(f"__new_{c}")).otherwise(F.col(f"__old_{c}"))

    return joined.select(key, *[merged(c).alias(c) for c in names])


def listing(
    df: DataFrame,
    equals: Mapping[str, Any] | None = None,
    order_by: Sequence[Column] = (),
    limit: int = 100,
    offset: int = 0,
    include_superseded: bool = False,
    scan_id: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(page, total): equality filters, newest first, a page of rows and the full count.

    ``scan_id`` matches the scan that found a row or the last one that saw it.
    """
    rows = df
    for column, value in (equals or {}).items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    if "status" in df.columns and not include_superseded and (equals or {}).get("status") is None:
        rows = rows.where(F.col("status") != "superseded")
    if scan_id is not None:
        rows = rows.where((F.col("scan_id") == scan_id) | (F.col("last_scan_id") == scan_id))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    ordered = rows.orderBy(*order_by) if order_by else rows
    return ordered.offset(offset).limit(limit), total
