"""Schema differences between two scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import policy
from plumbline.functions.naming import base_type, nullable_flag


def column_snapshot(columns_meta: DataFrame) -> DataFrame:
    """What has to be kept of a scan: upper-cased column names, type and nullability."""
    return columns_meta.select(
        "table",
        F.upper("column").alias("column"),
        "data_type",
        nullable_flag(F.col("is_nullable")).alias("nullable"),
    ).dropDuplicates(["table", "column"])


def _event(kind: str, test: Column, before: Column, after: Column) -> Column:
    return F.when(
        test,
        F.struct(
            F.lit(kind).alias("change"),
            F.lit(policy.DRIFT_SEVERITY[kind]).alias("severity"),
            before.cast("string").alias("before"),
            after.cast("string").alias("after"),
        ),
    )


def schema_drift(prior: DataFrame, live: DataFrame) -> DataFrame:
    """(table, column, change, severity, before, after) between two ``column_snapshot`` results.

    A table the prior scan did not see yields nothing; a table the live scan no
    longer sees yields one ``table_removed`` and no column events.
    """
    tables = (
        prior.groupBy("table")
        .agg(F.lit(True).alias("was"))
        .join(live.groupBy("table").agg(F.lit(True).alias("now")), "table", "left")
    )
    removed = tables.where(F.col("now").isNull()).select(
        "table",
        F.lit(None).cast("string").alias("column"),
        F.lit("table_removed").alias("change"),
        F.lit(policy.DRIFT_SEVERITY["table_removed"]).alias("severity"),
        F.lit(None).cast("string").alias("before"),
        F.lit(None).cast("string").alias("after"),
    )
    both = tables.where(F.col("now")).select("table")
    old = prior.select(
        "table", "column", F.col("data_type").alias("old_type"), F.col("nullable").alias("old_null"), F.lit(True).alias("in_old")
    )
    new = live.select(
        "table", "column", F.col("data_type").alias("new_type"), F.col("nullable").alias("new_null"), F.lit(True).alias("in_new")
    )
    pairs = old.join(new, ["table", "column"], "full").join(both, "table", "left_semi")
    present = F.col("in_old").isNotNull() & F.col("in_new").isNotNull()
    old_base, new_base = base_type(F.col("old_type")), base_type(F.col("new_type"))
    events = F.array(
        _event("column_added", F.col("in_old").isNull(), F.lit(None), F.col("new_type")),
        _event("column_removed", F.col("in_new").isNull(), F.col("old_type"), F.lit(None)),
        _event(
            "column_type_changed",
            present & (old_base != "") & (new_base != "") & (old_base != new_base),
            F.col("old_type"),
            F.col("new_type"),
        ),
        _event(
            "column_nullability_changed",
            present & (F.col("old_null") != F.col("new_null")),
            F.when(F.col("old_null"), "NULLABLE").otherwise("NOT NULL"),
            F.when(F.col("new_null"), "NULLABLE").otherwise("NOT NULL"),
        ),
    )
    columns = pairs.select("table", "column", F.inline(F.filter(events, lambda e: e.isNotNull())))
    return removed.unionByName(columns)
