"""All kinds of rules over a set of tables, from shared passes, in one result.

Row rules and the metadata that rules on names and types need (which columns hold a NULL) come from one
aggregation per table, so a table is scanned once for both. All keys and references are
one more scan per table (``checks.scan``); SELECTs, metrics and schema drift read what they name.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.time import AsOf
from plumbline.operators import checks, conventions, drift
from plumbline.operators.checks import CHECK_RESULT, ROW_SHAPES, Check
from plumbline.session import stored

#: The columns of a result, with the kind of rule in front.
RULE_RESULT = T.StructType([T.StructField("kind", T.StringType()), *CHECK_RESULT.fields])

_META = T.StructType(
    [T.StructField(n, T.IntegerType() if n == "ordinal" else T.StringType()) for n in ("table", "column", "ordinal", "data_type", "is_nullable", "comment")]
)


def table_pass(tables: Mapping[str, DataFrame], rules: Mapping[str, Sequence[Check]], as_of: AsOf | None = None) -> DataFrame:
    """One row per table: (results, meta), from one aggregation of the table.

    ``results`` are those of its row rules, ``meta`` describes its columns, nullable where the
    data has a NULL.
    """
    parts = []
    for table, df in tables.items():
        source, aggregates, rows = checks._check_columns(df, rules.get(table, ()), as_of)
        nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{i}") for i, c in enumerate(df.columns)]
        meta = [
            F.struct(
                F.lit(table).alias("table"),
                F.lit(f.name).alias("column"),
                F.lit(i + 1).alias("ordinal"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.when(F.col(f"null_{i}") > 0, "YES").otherwise("NO").alias("is_nullable"),
                F.lit((f.metadata or {}).get("comment")).cast("string").alias("comment"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
        parts.append(
            source.agg(F.count(F.lit(1)).alias("rows"), *aggregates, *nulls).select(
                F.array(*rows).cast(T.ArrayType(CHECK_RESULT)).alias("results"),
                F.array(*meta).cast(T.ArrayType(_META)).alias("meta"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _stored_pass(tables, rules: dict[str, list[Check]], as_of) -> tuple[DataFrame, list[tuple]]:
    """The stored pass, and error rows of users' expressions that fail on a value."""
    try:
        return stored(table_pass(tables, rules, as_of), "table-pass"), []
    except PySparkException as problem:
        if not checks.is_data_error(problem):
            raise
    # Expressions are tried apart; the other rules of the table share one pass as before.
    errors = []
    for table, members in rules.items():
        own = [c for c in members if c.shape == "predicate"]
        broken = {row[0]: row for row in checks._isolated(tables[table], own, as_of) if row[6] == "error"} if own else {}
        errors += broken.values()
        rules[table] = [c for c in members if c.rule not in broken]
    return stored(table_pass(tables, rules, as_of), "table-pass"), errors


def full_rule_scan(
    tables: Mapping[str, DataFrame],
    rules: Iterable[Check] = (),
    conventions_wanted: Sequence[str] = conventions.ACTIVE_RULES,
    prior: DataFrame | None = None,
    snapshots: DataFrame | None = None,
    baselines: DataFrame | None = None,
    as_of: AsOf | None = None,
) -> DataFrame:
    """Results of every rule: (kind, rule, table, column, severity, fail_count, total_count, status, error).

    ``rules`` are checks of any shape, one row each. Conventions and drift against ``prior``, a
    ``drift.column_snapshot``, give a row per finding. A rule that cannot run is an ``error``
    row and stops no other; what goes wrong in the cluster is raised.
    """
    given = [c for c in rules if c.enabled]
    spark = next(iter(tables.values())).sparkSession
    planned: dict[str, list[Check]] = {}
    unfit: list[tuple[Check, str]] = []
    for check in (c for c in given if c.shape in ROW_SHAPES):
        df = tables.get(check.table)
        problem = f"table {check.table} not found" if df is None else checks._problem(df, check, as_of, tables)
        if problem:
            unfit.append((check, problem))
        else:
            planned.setdefault(check.table, []).append(check)
    shared, errors = _stored_pass(tables, planned, as_of)
    errors += [(c.rule, c.table, c.column_label, c.severity, None, None, "error", message) for c, message in unfit]

    def kind(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("kind"), *CHECK_RESULT.names)

    def finding(df: DataFrame, code: str) -> DataFrame:
        one = F.lit(1).cast("long")
        return df.select(
            F.col(code).alias("rule"), "table", "column", "severity", one.alias("fail_count"), one.alias("total_count"),
            F.lit("failed").alias("status"), F.lit(None).cast("string").alias("error"),
        )

    parts = [kind("row", shared.select(F.inline("results")))]
    if errors:
        parts.append(kind("row", spark.createDataFrame(errors, CHECK_RESULT)))
    others = {
        "key": checks.GROUP_SHAPES + checks.JOIN_SHAPES, "select": checks.SQL_SHAPES, "metric": checks.METRIC_SHAPES,
    }
    for name, shapes in others.items():
        members = [c for c in given if c.shape in shapes]
        if members:
            parts.append(kind(name, checks.scan(tables, members, as_of, snapshots, baselines)))
    meta = shared.select(F.inline("meta"))
    if conventions_wanted:
        parts.append(kind("metadata", finding(conventions.check_conventions(meta, conventions_wanted), "rule_code")))
    if prior is not None:
        parts.append(kind("drift", finding(drift.schema_drift(prior, drift.column_snapshot(meta)), "change")))
    return reduce(DataFrame.unionByName, parts)
