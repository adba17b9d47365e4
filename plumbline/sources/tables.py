"""Table scans and column metadata."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS_META = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("is_nullable", T.StringType()),
        T.StructField("is_primary_key", T.BooleanType()),
        T.StructField("is_unique", T.BooleanType()),
        T.StructField("comment", T.StringType()),
    ]
)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A file table. Filters and columns are pushed into the scan by Catalyst."""
    return spark.read.format(fmt).options(**options).load(path)


def read_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {n: read_table(spark, f"{folder.rstrip('/')}/{n}.parquet") for n in names}


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int = 32,
    **options: str,
) -> DataFrame:
    """A table of a relational database, read in parallel ranges of ``partition_column``.

    The JDBC driver has to be on the class path. Without a partition column the
    database hands the table to one task, so give one for anything large.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition_column:
        if lower is None or upper is None:
            raise ValueError("a partition column needs lower and upper")
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=lower,
            upperBound=upper,
            numPartitions=partitions,
        )
    return reader.options(**options).load()


def columns_meta(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    primary_keys: Mapping[str, Iterable[str]] | None = None,
    unique_keys: Mapping[str, Iterable[str]] | None = None,
) -> DataFrame:
    """One row per column, from the schemas only (no data is read).

    Key flags are declared input, as files carry none.
    """
    primary = {t: set(c) for t, c in (primary_keys or {}).items()}
    unique = {t: set(c) for t, c in (unique_keys or {}).items()}
    rows = [
        (
            table,
            f.name,
            i,
            f.dataType.simpleString(),
            "YES" if f.nullable else "NO",
            f.name in primary.get(table, ()),
            f.name in unique.get(table, ()),
            (f.metadata or {}).get("comment"),
        )
        for table, df in tables.items()
        for i, f in enumerate(df.schema.fields, 1)
    ]
    return spark.createDataFrame(rows, COLUMNS_META)


def observed_columns_meta(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """``columns_meta`` whose nullability is what the data shows.

    Parquet files are written with every column optional; a column counts as
    nullable here if some row of the table holds a NULL in it. One aggregation
    per table, whose result is one row.
    """
    parts = None
    for table, df in tables.items():
        counts = df.agg(
            *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n_{i}") for i, c in enumerate(df.columns)]
        )
        rows = [
            F.struct(
                F.lit(table).alias("table"),
                F.lit(f.name).alias("column"),
                F.lit(i + 1).alias("ordinal"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.when(F.col(f"n_{i}") > 0, "YES").otherwise("NO").alias("is_nullable"),
                F.lit((f.metadata or {}).get("comment")).cast("string").alias("comment"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
        part = counts.select(F.inline(F.array(*rows)))
        parts = part if parts is None else parts.unionByName(part)
    return parts
