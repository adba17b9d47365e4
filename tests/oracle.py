"""Compare a registered query with its SQL run by DuckDB on the same files."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

#: Spark type -> DuckDB type the result columns have to have.
SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> list[str]:
    """Empty if both give the same columns, types and rows."""
    result = con.execute(sql)
    sql_types = {d[0]: str(d[1]) for d in result.description}
    sql_rows = rows_of([d[0] for d in result.description], result.fetchall())
    problems = []
    if sorted(df.columns) != sorted(sql_types):
        return [f"columns differ: {sorted(df.columns)} / {sorted(sql_types)}"]
    for name, spark_type in df.dtypes:
        if SAME_TYPE.get(spark_type, spark_type) != sql_types[name]:
            problems.append(f"type of {name}: {spark_type} / {sql_types[name]}")
    spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if spark_rows != sql_rows:
        only_spark = [r for r in spark_rows if r not in set(sql_rows)][:3]
        only_sql = [r for r in sql_rows if r not in set(spark_rows)][:3]
        problems.append(
            f"rows differ ({len(spark_rows)} / {len(sql_rows)}) in {sorted(df.columns)}; "
            f"only Spark: {only_spark}; only SQL: {only_sql}"
        )
    return problems
