"""Row-level data checks.

A check is a small frozen description. ``scan`` runs many of them on one table:
everything that is a predicate on single rows shares ONE aggregation, so the
table is read once however many rules there are. All checks of keys and references,
of all tables, share one table of counted values: each table is read once for all its
keys, and a key that holds a third of the table costs one row per map task in the shuffle.

The result has one row per check: rule, table, column, severity, fail_count,
total_count, status (passed / failed / error) and error.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from string import Formatter
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import policy
from plumbline.functions.time import AsOf, hours_before
from plumbline.operators import metrics
from plumbline.operators.inclusion import value_counts
from plumbline.operators.joins import null_safe_join

ROW_SHAPES = ("not_null", "accepted_values", "range", "regex_match", "freshness", "predicate")
GROUP_SHAPES = ("uniqueness", "duplicate_key")
JOIN_SHAPES = ("referential_integrity",)
SQL_SHAPES = ("sql",)
METRIC_SHAPES = ("metric_anomaly", "metric_relative_change", "category_disappeared")

CHECK_RESULT = T.StructType(
    [
        T.StructField("rule", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("fail_count", T.LongType()),
        T.StructField("total_count", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Check:
    """One rule bound to one table."""

    rule: str
    table: str
    shape: str
    columns: tuple[str, ...] = ()
    severity: str = "medium"
    params: Mapping[str, Any] = field(default_factory=dict)
    enabled: bool = True

    @property
    def column_label(self) -> str:
        return ",".join(self.columns)


def normalize_thresholds(config: Mapping[str, Any] | None) -> dict[str, Any]:
    """Replace short threshold names by the full ones; a full name given as well wins."""
    given = dict(config or {})
    full = {k: v for k, v in given.items() if k not in policy.THRESHOLD_ALIASES}
    for alias, name in policy.THRESHOLD_ALIASES.items():
        if alias in given:
            full.setdefault(name, given[alias])
    return full


def build_check(
    shape: str,
    table: str,
    target: Mapping[str, Any],
    threshold: Mapping[str, Any] | None = None,
    rule: str | None = None,
    severity: str = "medium",
    enabled: bool = True,
) -> Check:
    """Make a check from a shape name, a target and thresholds; bad input raises ValueError."""
    params = normalize_thresholds(threshold)
    if shape not in ROW_SHAPES + GROUP_SHAPES + JOIN_SHAPES + METRIC_SHAPES + SQL_SHAPES:
        raise ValueError(f"unknown check shape {shape!r}")
    if target.get("columns"):
        columns = tuple(target["columns"])
    else:
        columns = (target["column"],) if target.get("column") else ()
    if shape in METRIC_SHAPES:
        # The table is the asset whose series is judged; a table's own metrics have no column.
        if shape != "category_disappeared" and not target.get("metric_name"):
            raise ValueError(f"{shape} needs metric_name")
        params["metric_name"] = target.get("metric_name", "observed_categories")
    elif shape not in ("predicate", "sql") and not columns:
        raise ValueError(f"{shape} needs a target column")
    if shape == "accepted_values" and not params.get("accepted_values"):
        raise ValueError("accepted_values needs a list that is not empty")
    if shape == "range" and params.get("min_value") is None and params.get("max_value") is None:
        raise ValueError("range needs min_value or max_value")
    if shape == "regex_match" and not params.get("pattern"):
        raise ValueError("regex_match needs a pattern")
    if shape == "freshness" and params.get("max_age_hours") is None:
        raise ValueError("freshness needs max_age_hours")
    if shape == "predicate" and not params.get("fails_if"):
        raise ValueError("predicate needs fails_if")
    if shape == "sql" and not params.get("sql"):
        raise ValueError("sql needs a SELECT of failed_count and total_count")
    if shape == "referential_integrity":
        for key in ("ref_table", "ref_column"):
            if not target.get(key):
                raise ValueError(f"referential_integrity needs {key}")
            params[key] = target[key]
    name = rule or f"{shape}:{table}.{','.join(columns)}"
    return Check(name, table, shape, columns, severity, params, enabled)


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def failing_predicate(check: Check) -> Column:
    """The condition under which a row fails. Used for counts and for samples alike.

    It is NULL-safe: a NULL comparison never counts as a failure.
    """
    shape, params = check.shape, check.params
    if shape == "predicate":
        return F.coalesce(F.expr(params["fails_if"]), F.lit(False))
    column = _col(check.columns[0])
    if shape == "not_null":
        return column.isNull()
    if shape == "accepted_values":
        allowed = [F.lit(v) for v in params["accepted_values"]]
        return F.coalesce(~column.isin(*allowed), F.lit(False))
    if shape == "range":
        bounds = []
        if params.get("min_value") is not None:
            bounds.append(column < F.lit(params["min_value"]))
        if params.get("max_value") is not None:
            bounds.append(column > F.lit(params["max_value"]))
        return F.coalesce(reduce(lambda a, b: a | b, bounds), F.lit(False))
    if shape == "regex_match":
        # The whole value has to match, while rlike is content with a part of it.
        whole = r"\A(?:" + params["pattern"] + r")\z"
        return F.coalesce(~column.cast("string").rlike(whole), F.lit(False))
    raise ValueError(f"{shape} is not decided row by row")


def _row_aggregates(check: Check, as_of: AsOf | None) -> tuple[Column, Column]:
    """(fail_count, total_count) of a check that needs nothing but the rows."""
    if check.shape == "freshness":
        if as_of is None:
            raise ValueError("freshness needs as_of")
        limit = hours_before(as_of, check.params["max_age_hours"])
        stale = F.max(_col(check.columns[0])) < limit
        return F.coalesce(stale.cast("long"), F.lit(0).cast("long")), F.lit(1).cast("long")
    failed = F.count_if(failing_predicate(check))
    if check.shape in ("not_null", "predicate"):
        return failed, F.count(F.lit(1))
    return failed, F.count(_col(check.columns[0]))


def _result(check: Check, fail: Column, total: Column, error: Column | None = None) -> Column:
    status = F.lit("error") if error is not None else F.when(fail > 0, "failed").otherwise("passed")
    return F.struct(
        F.lit(check.rule).alias("rule"),
        F.lit(check.table).alias("table"),
        F.lit(check.column_label).alias("column"),
        F.lit(check.severity).alias("severity"),
        fail.cast("long").alias("fail_count"),
        total.cast("long").alias("total_count"),
        status.alias("status"),
        (error if error is not None else F.lit(None)).cast("string").alias("error"),
    )


def _row_checks(df: DataFrame, checks: Sequence[Check], as_of) -> DataFrame:
    """All row checks of one table in one aggregation, then one row per check.

    Expressions of users could fail on some value. If there are any, the aggregation runs at once;
    if it fails, the checks are halved until only the culprits are left, which become ``error``.
    """
    if any(c.shape == "predicate" for c in checks):
        return df.sparkSession.createDataFrame(_isolated(df, checks, as_of), CHECK_RESULT)
    return _fused(df, checks, as_of)


def _bounds(check: Check) -> list:
    """The values that a check compares its column with."""
    given = [check.params.get(k) for k in ("min_value", "max_value")] + list(check.params.get("accepted_values") or ())
    return [b for b in given if b is not None]


def _unreadable(df: DataFrame, check: Check) -> Column | None:
    """The number of texts that a check compares with numbers but that are none; None if it compares like with like."""
    if check.shape not in ("range", "accepted_values") or all(isinstance(b, str) for b in _bounds(check)):
        return None
    if not isinstance(df.schema[check.columns[0]].dataType, T.StringType):
        return None
    column = _col(check.columns[0])
    return F.count_if(column.isNotNull() & column.try_cast("double").isNull())


def _message(problem: Exception) -> str:
    return str(problem).strip().partition("\n")[0] or type(problem).__name__


def is_data_error(problem: Exception) -> bool:
    """Whether a value or the text of a rule is at fault, and not the cluster.

    Spark names the first two by an SQL state: 21, 22 and 42 stand for cardinality, data, and
    syntax or names. A lost executor, a full disk or a killed job has another one or none.
    """
    return isinstance(problem, PySparkException) and (problem.getSqlState() or "")[:2] in ("21", "22", "42")


def _isolated(df: DataFrame, checks: Sequence[Check], as_of) -> list[tuple]:
    """Result rows, one per check. What is not the fault of a check is raised."""
    try:
        return [tuple(r) for r in _fused(df, checks, as_of).collect()]
    except PySparkException as problem:
        if not is_data_error(problem):
            raise
        if len(checks) == 1:
            c = checks[0]
            return [(c.rule, c.table, c.column_label, c.severity, None, None, "error", _message(problem))]
    half = len(checks) // 2
    return _isolated(df, checks[:half], as_of) + _isolated(df, checks[half:], as_of)


def _check_columns(df: DataFrame, checks: Sequence[Check], as_of) -> tuple[DataFrame, list[Column], list[Column]]:
    """The table to aggregate, the aggregates of all checks, and their result rows."""
    aggregates, rows = [], []
    for i, check in enumerate(checks):
        bad = _unreadable(df, check)
        if bad is not None:
            # Judged on a copy of the column, so other checks keep the text.
            copy = f"__number_{i}"
            df = df.withColumn(copy, _col(check.columns[0]).try_cast("double"))
            fail, total = _row_aggregates(replace(check, columns=(copy,)), as_of)
            aggregates.append(bad.alias(f"bad_{i}"))
            message = F.concat(F.col(f"bad_{i}").cast("string"), F.lit(f" values of {check.columns[0]} are no numbers"))
            broken = F.col(f"bad_{i}") > 0
        else:
            fail, total = _row_aggregates(check, as_of)
            broken = None
        aggregates += [fail.alias(f"fail_{i}"), total.alias(f"total_{i}")]
        fine = _result(check, F.col(f"fail_{i}"), F.col(f"total_{i}"))
        if broken is None:
            rows.append(fine)
        else:
            none = F.lit(None).cast("long")
            rows.append(F.when(broken, _result(check, none, none, message)).otherwise(fine))
    return df, aggregates, rows


def _fused(df: DataFrame, checks: Sequence[Check], as_of) -> DataFrame:
    df, aggregates, rows = _check_columns(df, checks, as_of)
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def _key_checks(tables: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """All checks of keys and references, of all tables, from one table of counted values.

    A value's holders are the key columns that have it, so a repeated value and one without a
    parent are both seen in one row. The number of checks adds no scan and no shuffle.
    """
    spark = next(iter(tables.values())).sparkSession
    places: dict[tuple[str, tuple[str, ...]], int] = {}

    def place(table: str, columns: Sequence[str]) -> int:
        return places.setdefault((table, tuple(columns)), len(places))

    rows = []
    for i, c in enumerate(checks):
        reference = c.shape in JOIN_SHAPES
        own = place(c.table, c.columns[:1] if reference else c.columns)
        parent = place(c.params["ref_table"], [c.params["ref_column"]]) if reference else None
        rows.append((i, c.rule, c.table, c.column_label, c.severity, own, parent))
    wanted = spark.createDataFrame(
        rows, "id int, rule string, table string, column string, severity string, place int, parent int"
    )
    held = (
        value_counts(tables, list(places))
        .groupBy("value")
        .agg(F.collect_list(F.struct("place", "n")).alias("holders"))
        .select(F.col("value").isNotNull().alias("filled"), F.array_sort("holders.place").alias("known"), F.inline("holders"))
        # Values that no check can tell apart are added up before the join: a column's values would all meet in one task.
        .groupBy("place", "known", "filled", (F.col("n") > 1).alias("repeated"))
        .agg(F.sum("n").alias("n"))
    )
    bad = F.when(F.col("parent").isNull(), F.col("repeated")).otherwise(~F.array_contains("known", F.col("parent")))
    counted = (
        held.join(wanted.select("id", "place", "parent"), "place")
        .groupBy("id")
        .agg(F.sum(F.when(F.col("filled") & bad, F.col("n")).otherwise(0)).alias("fail"), F.sum("n").alias("total"))
    )
    fail, total = (F.coalesce(c, F.lit(0)) for c in ("fail", "total"))
    return wanted.join(counted, "id", "left").select(
        "rule", "table", "column", "severity", fail.alias("fail_count"), total.alias("total_count"),
        F.when(fail > 0, "failed").otherwise("passed").alias("status"), F.lit(None).cast("string").alias("error"),
    )


def sql_counts(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The result of a user's SELECT, which names tables in braces: ``FROM {orders} JOIN {customer} …``.

    It has to have the columns failed_count and total_count, in any letter case and order.
    """
    # Only tables that are named are known to the statement.
    named = {name for _, name, _, _ in Formatter().parse(sql) if name}
    unknown = sorted(named - set(tables))
    if unknown:
        raise ValueError(f"table {unknown[0]} not found")
    found = spark.sql(sql, **{name: tables[name] for name in named})
    columns = {c.lower(): c for c in found.columns}
    missing = [c for c in ("failed_count", "total_count") if c not in columns]
    if missing:
        raise ValueError(f"the SELECT has no {missing[0]}")
    return found.select(*[_col(columns[c]).cast("long").alias(c) for c in ("failed_count", "total_count")])


def _sql_row(spark: SparkSession, check: Check, tables: Mapping[str, DataFrame]) -> tuple:
    """The result row of one SELECT; its errors are its own, those of the cluster are raised."""
    label = (check.rule, check.table, check.column_label, check.severity)
    try:
        # A second row is enough to know that it is not a count.
        found = sql_counts(spark, check.params["sql"], tables).limit(2).collect()
        if len(found) != 1 or None in tuple(found[0]):
            raise ValueError("the SELECT has to give one row with two numbers")
        failed, total = found[0]
        return (*label, failed, total, "failed" if failed > 0 else "passed", None)
    except ValueError as problem:
        return (*label, None, None, "error", _message(problem))
    except PySparkException as problem:
        if not is_data_error(problem):
            raise
        return (*label, None, None, "error", _message(problem))


def _error_rows(df: DataFrame, errors: Sequence[tuple[Check, str]]) -> DataFrame:
    rows = [
        (c.rule, c.table, c.column_label, c.severity, None, None, "error", message)
        for c, message in errors
    ]
    return df.sparkSession.createDataFrame(rows, CHECK_RESULT)


def _problem(df: DataFrame, check: Check, as_of, tables: Mapping[str, DataFrame]) -> str | None:
    """Why a check cannot be planned on this table, or None. Only the schema is looked at."""
    missing = [c for c in check.columns if c not in df.columns]
    if missing:
        return f"column {missing[0]} not found"
    if check.shape in ("range", "accepted_values"):
        kind = df.schema[check.columns[0]].dataType
        for bound in _bounds(check):
            if isinstance(bound, str) and not isinstance(kind, T.StringType):
                read = df.sparkSession.sql(f"SELECT try_cast(:bound AS {kind.simpleString()})", args={"bound": bound})
                if read.first()[0] is None:
                    return f"{bound!r} is no {kind.simpleString()}"
    try:
        if check.shape in ROW_SHAPES:
            given, aggregates, _ = _check_columns(df, [check], as_of)
            given.agg(*aggregates).schema
        elif check.shape in JOIN_SHAPES:
            parent = tables.get(check.params["ref_table"])
            if parent is None:
                return f"table {check.params['ref_table']} not found"
            if check.params["ref_column"] not in parent.columns:
                return f"column {check.params['ref_column']} not found"
        elif check.shape not in GROUP_SHAPES:
            return f"unknown check shape {check.shape!r}"
    except (PySparkException, ValueError) as problem:  # an expression Spark cannot resolve
        return _message(problem)
    return None


def _metric_checks(rules: Sequence[Check], snapshots: DataFrame, baselines: DataFrame) -> list[DataFrame]:
    """Results of metric checks: one pass over the series per shape and threshold, however many rules."""
    by_threshold: dict[tuple, list[Check]] = {}
    for check in rules:
        name = {"metric_anomaly": "deviations", "metric_relative_change": "max_pct_change"}.get(check.shape)
        default = {"deviations": 3.0, "max_pct_change": 25.0}.get(name)
        by_threshold.setdefault((check.shape, float(check.params.get(name, default)) if name else None), []).append(check)
    parts = []
    for (shape, threshold), members in by_threshold.items():
        if shape == "metric_anomaly":
            judged = metrics.metric_anomaly(snapshots, baselines, threshold)
        elif shape == "metric_relative_change":
            judged = metrics.metric_relative_change(snapshots, threshold)
        else:
            judged = metrics.category_disappeared(snapshots, baselines)
        rows = [
            (c.rule, c.table, c.column_label, c.severity, c.table, c.columns[0] if c.columns else None, c.params["metric_name"])
            for c in members
        ]
        wanted = snapshots.sparkSession.createDataFrame(
            rows, "rule string, table string, column string, severity string, asset_id string, column_name string, metric_name string"
        )
        found = null_safe_join(wanted, judged.select(*metrics.KEYS, "fail_count"), metrics.KEYS, "left")
        fail = F.coalesce("fail_count", F.lit(0)).cast("long")
        parts.append(
            found.select(
                "rule", "table", "column", "severity", fail.alias("fail_count"), F.lit(1).cast("long").alias("total_count"),
                F.when(fail > 0, "failed").otherwise("passed").alias("status"), F.lit(None).cast("string").alias("error"),
            )
        )
    return parts


def scan(
    tables: Mapping[str, DataFrame],
    checks: Iterable[Check],
    as_of: AsOf | None = None,
    snapshots: DataFrame | None = None,
    baselines: DataFrame | None = None,
) -> DataFrame:
    """Run all enabled checks on their tables; one result row each.

    A check that cannot be planned, or that fails on a value of the table, becomes an
    ``error`` row and does not stop the others. Row checks of a table are one scan, and all
    checks of its keys and references are one more. SELECTs run one by one and may read any
    of ``tables``. Metric checks read ``snapshots`` and ``baselines``; their table is the asset.
    """
    by_table: dict[str, list[Check]] = {}
    for check in checks:
        if check.enabled:
            by_table.setdefault(check.table, []).append(check)
    if not by_table:
        raise ValueError("no enabled check to run")
    any_table = next(iter([*tables.values(), snapshots]))
    parts: list[DataFrame] = []
    errors: list[tuple[Check, str]] = []
    series = [c for members in by_table.values() for c in members if c.shape in METRIC_SHAPES]
    if series and (snapshots is None or baselines is None):
        errors += [(c, "no snapshots or baselines given") for c in series]
    elif series:
        parts += _metric_checks(series, snapshots, baselines)
    spark = any_table.sparkSession
    selects = [c for members in by_table.values() for c in members if c.shape in SQL_SHAPES]
    if selects:
        parts.append(spark.createDataFrame([_sql_row(spark, c, tables) for c in selects], CHECK_RESULT))
    keyed: list[Check] = []
    for table, everything in by_table.items():
        members = [c for c in everything if c.shape not in METRIC_SHAPES + SQL_SHAPES]
        if not members:
            continue
        df = tables.get(table)
        if df is None:
            errors += [(c, f"table {table} not found") for c in members]
            continue
        planned = []
        for check in members:
            problem = _problem(df, check, as_of, tables)
            if problem:
                errors.append((check, problem))
            else:
                planned.append(check)
        row_checks = [c for c in planned if c.shape in ROW_SHAPES]
        if row_checks:
            parts.append(_row_checks(df, row_checks, as_of))
        keyed += [c for c in planned if c.shape in GROUP_SHAPES + JOIN_SHAPES]
    if keyed:
        parts.append(_key_checks(tables, keyed))
    if errors:
        parts.append(_error_rows(any_table, errors))
    return reduce(DataFrame.unionByName, parts)


def scan_groups(
    df: DataFrame,
    keys: Sequence[Column],
    checks: Sequence[Check],
    as_of: AsOf | None = None,
) -> DataFrame:
    """Enabled row checks per group (a partition, a tenant, a day): the keys plus the result columns.

    One aggregation for all groups and checks; only counters cross the network.
    """
    checks = [c for c in checks if c.enabled]
    if not checks:
        raise ValueError("no enabled check to run")
    # A user's expression that fails on some value of the table fails in its own rows only.
    own = [c for c in checks if c.shape == "predicate"]
    broken = {row[0]: row for row in _isolated(df, own, as_of) if row[6] == "error"} if own else {}
    fine = [c for c in checks if c.rule not in broken]
    source, aggregates, rows = _check_columns(df, fine, as_of)
    counted = source.groupBy(*keys).agg(*aggregates, F.count(F.lit(1)).alias("__rows"))
    kept = counted.columns[: len(keys)]
    rows += [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, CHECK_RESULT.fields)])
        for row in broken.values()
    ]
    return counted.select(*[_col(k) for k in kept], F.inline(F.array(*rows)))


def _failing(tables: Mapping[str, DataFrame], check: Check) -> DataFrame:
    """All failing rows of a check that can name them."""
    df = tables[check.table]
    if check.shape in GROUP_SHAPES:
        keys = list(check.columns)
        repeated = (
            df.where(reduce(lambda a, b: a & b, [_col(k).isNotNull() for k in keys]))
            .groupBy(*[_col(k) for k in keys])
            .agg(F.count(F.lit(1)).alias("__n"))
            .where(F.col("__n") > 1)
            .drop("__n")
        )
        return df.join(repeated, keys, "left_semi")
    if check.shape in JOIN_SHAPES:
        parent = tables[check.params["ref_table"]]
        keys = parent.select(_col(check.params["ref_column"]).alias("__parent")).distinct()
        child = _col(check.columns[0])
        return df.where(child.isNotNull()).join(keys, child == F.col("__parent"), "left_anti")
    return df.where(failing_predicate(check))


def failing_rows(
    tables: Mapping[str, DataFrame],
    check: Check,
    limit: int = 10,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Up to ``limit`` failing rows, chosen by the predicate that also counts them.

    Freshness, metrics and SELECTs have no failing rows. Give ``order_by`` for a repeatable
    choice; it becomes a top-n per task, not a global sort. Rows that keys decide about are
    then chosen on the key and order columns alone, and only the chosen ones are read in full.
    """
    df = tables[check.table]
    if check.shape == "freshness" or check.shape in METRIC_SHAPES + SQL_SHAPES:
        return df.limit(0)
    if not order_by:
        return _failing(tables, check).limit(limit)

    def first(rows: DataFrame) -> DataFrame:
        return rows.orderBy(*[_col(c) for c in order_by]).limit(limit)

    if check.shape in ROW_SHAPES:
        return first(_failing(tables, check))
    columns = list(dict.fromkeys([*check.columns, *order_by]))
    narrow = df.select(*[_col(c) for c in columns])
    shown = first(_failing({**tables, check.table: narrow}, check))
    named = shown.select(*[_col(c).alias(f"__{i}") for i, c in enumerate(columns)])
    same = reduce(lambda a, b: a & b, [_col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(columns)])
    return first(df.join(named, same, "left_semi"))


def reconcile(results: DataFrame, samples: DataFrame) -> DataFrame:
    """Raise fail_count to the number of sampled failing rows where it is smaller.

    ``samples``: rule, sample_count. Results with total_count 1 from freshness-like
    shapes simply have no sample row.
    """
    return (
        results.join(samples.select("rule", "sample_count"), "rule", "left")
        .withColumn(
            "fail_count",
            F.greatest(F.col("fail_count"), F.coalesce(F.col("sample_count"), F.lit(0))),
        )
        .withColumn(
            "status",
            F.when(F.col("status") == "error", "error")
            .when(F.col("fail_count") > 0, "failed")
            .otherwise("passed"),
        )
        .drop("sample_count")
    )


def declared_key_checks(columns_meta: DataFrame) -> list[Check]:
    """The checks that declared keys ask for; metadata decides which.

    ``columns_meta`` with its key flags: the primary key columns of a table, in
    their order, are one key without NULLs; each unique column is a key that may be NULL.
    """
    rows = columns_meta.where("is_primary_key OR is_unique").orderBy("table", "ordinal").collect()
    primary: dict[str, list[str]] = {}
    for row in rows:
        if row["is_primary_key"]:
            primary.setdefault(row["table"], []).append(row["column"])
    found = []
    for table, columns in primary.items():
        found += [build_check("not_null", table, {"column": c}, rule=f"primary_key_set:{table}.{c}", severity="critical") for c in columns]
        shape = "uniqueness" if len(columns) == 1 else "duplicate_key"
        found.append(build_check(shape, table, {"columns": columns}, rule=f"primary_key:{table}", severity="critical"))
    return found + [
        build_check("uniqueness", r["table"], {"column": r["column"]}, rule=f"unique_key:{r['table']}.{r['column']}", severity="high")
        for r in rows
        if r["is_unique"]
    ]


def execution_log(instances: DataFrame, results: DataFrame, executed_at: Column) -> DataFrame:
    """One row per instance that ran: failed or error with its counts, else passed.

    ``instances``: instance_id. ``results``: instance_id, fail_count, total_count and,
    if there are errors among them, status of the failing instances (one row each).
    """
    outcome = F.when(F.col("status") == "error", "error").when(F.col("status") == "passed", "passed") if "status" in results.columns else F.lit(None)
    failed = results.select(
        "instance_id",
        F.col("fail_count").alias("__fail"),
        F.col("total_count").alias("__total"),
        F.coalesce(outcome, F.lit("failed")).alias("__outcome"),
    )
    return instances.join(failed, "instance_id", "left").select(
        *[F.col(c) for c in instances.columns],
        F.coalesce("__outcome", F.lit("passed")).alias("status"),
        F.col("__fail").alias("fail_count"),
        F.col("__total").alias("total_count"),
        executed_at.alias("executed_at"),
    )


def override_severity(results: DataFrame, overrides: DataFrame, key: str = "rule") -> DataFrame:
    """Apply (key, severity) overrides to results; the rule table itself stays as it is."""
    wanted = overrides.select(key, F.col("severity").alias("__override"))
    return (
        results.join(wanted, key, "left")
        .withColumn("severity", F.coalesce("__override", "severity"))
        .drop("__override")
    )
