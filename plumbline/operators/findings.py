"""From check results to finding rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shapes that judge a table as a whole: their one row is no row count.
TABLE_LEVEL_SHAPES = ("freshness", "metric_anomaly", "metric_relative_change", "category_disappeared")


def finding_rows(
    results: DataFrame,
    instances: DataFrame,
    definitions: DataFrame,
    assets: DataFrame,
    samples: DataFrame | None = None,
) -> DataFrame:
    """One finding per failing result, ready for ``lifecycle.finalize_scan``.

    ``results``: rule (the instance id), fail_count, total_count, status. ``instances``:
    instance_id, definition_id, table_fqn, column, severity, rationale. ``definitions``:
    definition_id, name, description, shape. ``assets``: asset_id, fqn. ``samples``: rule,
    sample_rows (an array).

    The finding lies on the column's asset if there is one, else on the table's; without
    either there is none. More sampled rows than counted failures raise the count. The
    text names the rows or the table, and adds the instance's reason or else the
    definition's description.
    """
    failed = results.where(F.col("status") == "failed").select(
        F.col("rule").alias("instance_id"), "fail_count", "total_count"
    )
    known = failed.join(instances, "instance_id").join(
        definitions.select("definition_id", "name", F.col("description").alias("__about"), "shape"), "definition_id"
    )
    places = assets.select(F.col("fqn").alias("__fqn"), F.col("asset_id").alias("__id"))
    tables = places.toDF("table_fqn", "__table_id")
    has_column = F.coalesce("column", F.lit("")) != ""
    wanted = F.when(has_column, F.concat("table_fqn", F.lit("."), "column"))
    placed = (
        known.join(tables, "table_fqn")
        .withColumn("__wanted", wanted)
        .join(places, F.col("__wanted") == F.col("__fqn"), "left")
    )
    if samples is None:
        placed = placed.withColumn("sample_rows", F.array().cast("array<string>"))
    else:
        chosen = samples.select(F.col("rule").alias("instance_id"), "sample_rows")
        placed = placed.join(chosen, "instance_id", "left")
    whole = (F.col("total_count") == 1) & F.col("shape").isin(*TABLE_LEVEL_SHAPES)
    seen = F.coalesce(F.size("sample_rows"), F.lit(0)).cast("bigint")
    count = F.when(whole, F.col("fail_count")).otherwise(F.greatest("fail_count", seen))
    counted = placed.withColumn("fail_count", count).withColumn("fqn", F.coalesce("__fqn", "table_fqn"))
    detail = F.coalesce(
        F.nullif(F.trim(F.coalesce("rationale", F.lit(""))), F.lit("")), F.trim(F.coalesce("__about", F.lit("")))
    )
    rows = F.format_string("%d of %d rows fail this check.", F.col("fail_count"), F.col("total_count"))
    text = F.when(whole, F.lit("This table-level check failed.")).otherwise(rows)
    return counted.select(
        "instance_id",
        F.coalesce("__id", "__table_id").alias("asset_id"),
        "severity",
        F.concat("name", F.lit(" violated on "), F.element_at(F.split("fqn", r"\."), -1)).alias("title"),
        F.when(detail != "", F.concat(text, F.lit(" "), detail)).otherwise(text).alias("description"),
        "fail_count",
        "total_count",
        "fqn",
        F.coalesce("column", F.lit("")).alias("column_name"),
        "sample_rows",
    )
