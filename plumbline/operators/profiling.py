"""Table and column profiles over whole tables.

Two passes, both without moving rows:

* scalar statistics (counts, bounds, mean, deviation, lengths, pattern share) are
  one aggregation, so only one record per task crosses the network;
* distinct and duplicate counts are exact up to a collision of 128-bit hashes.
  Values are reduced to their hash and counted by (column, hash) with partial aggregation on the map side. That
  moves 16 bytes per distinct value instead of the value itself, and avoids the
  row expansion of several ``count(distinct)`` in one aggregation.

Both work per group as well: pass ``keys`` to profile a day, a tenant or a
partition at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import policy
from plumbline.functions.naming import base_type, contains_any, starts_with_any
from plumbline.functions.time import AsOf, moment, seconds_between
from plumbline.policy import ProfilePolicy

#: Columns handled by one aggregation: keeps the generated code of a stage small.
COLUMN_BATCH = 40


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _is_numeric(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.NumericType)


def _is_temporal(f: T.StructField) -> bool:
    return isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _is_text(f: T.StructField) -> bool:
    return isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType))


def _is_orderable(f: T.StructField) -> bool:
    return _is_numeric(f) or _is_temporal(f) or _is_text(f) or isinstance(f.dataType, T.BooleanType)


def _format_pattern(name: str) -> str | None:
    """The pattern values of an e-mail or phone column should follow; the name decides."""
    upper = name.upper()
    if "EMAIL" in upper or upper.endswith("_MAIL"):
        return policy.EMAIL_PATTERN
    if "PHONE" in upper or "MOBILE" in upper or upper.endswith("_TEL"):
        return policy.PHONE_PATTERN
    return None


def _percent(part: Column, whole: Column, digits: int) -> Column:
    return F.round(part / F.nullif(whole, F.lit(0)) * 100, digits)


def _scalar_aggregates(f: T.StructField, i: int) -> list[Column]:
    c = _col(f.name)
    out = [F.count(c).alias(f"non_null_{i}")]
    if _is_orderable(f):
        out += [F.min(c).alias(f"min_{i}"), F.max(c).alias(f"max_{i}")]
    if _is_numeric(f):
        number = c.cast("double")
        out += [F.avg(number).alias(f"avg_{i}"), F.stddev_samp(number).alias(f"stddev_{i}")]
    if _is_text(f):
        out += [F.avg(F.length(c)).alias(f"avg_len_{i}"), F.max(F.length(c)).alias(f"max_len_{i}")]
        pattern = _format_pattern(f.name)
        if pattern:
            hit = F.trim(c).rlike(pattern)
            out.append(F.avg(hit.cast("double")).alias(f"pattern_{i}"))
    return out


def _scalar_row(f: T.StructField, i: int, ordinal: int) -> Column:
    def number(name: str, present: bool, kind: str = "double") -> Column:
        return (F.col(f"{name}_{i}") if present else F.lit(None)).cast(kind)

    orderable, numeric, text = _is_orderable(f), _is_numeric(f), _is_text(f)
    pattern = number("pattern", text and _format_pattern(f.name) is not None)
    return F.struct(
        F.lit(f.name).alias("column"),
        F.lit(ordinal).alias("ordinal"),
        F.lit(f.dataType.simpleString()).alias("data_type"),
        F.col("total").alias("total"),
        F.col(f"non_null_{i}").alias("non_null"),
        number("min", orderable, "string").alias("min_value"),
        number("max", orderable, "string").alias("max_value"),
        number("min", numeric).alias("min_number"),
        number("max", numeric).alias("max_number"),
        (F.col(f"max_{i}") if _is_temporal(f) else F.lit(None)).cast("timestamp_ntz").alias("newest"),
        number("avg", numeric).alias("avg_value"),
        number("stddev", numeric).alias("stddev"),
        number("avg_len", text).alias("avg_length"),
        number("max_len", text, "bigint").alias("max_length"),
        F.round(pattern * 100, 1).alias("pattern_match_pct"),
    )


def scalar_statistics(
    df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """One row per (keys, column) with the single-pass statistics."""
    fields = [f for f in df.schema.fields if f.name not in keys and (columns is None or f.name in columns)]
    # Bounds of texts cannot be kept in a hash table and would turn the whole
    # aggregation into a sort-based one, so texts are aggregated apart. Each
    # column is still read once.
    texts = [f for f in fields if _is_text(f)]
    others = [f for f in fields if not _is_text(f)]
    batches = [
        group[start : start + COLUMN_BATCH]
        for group in (others, texts)
        for start in range(0, len(group), COLUMN_BATCH)
    ]
    parts = []
    for batch in batches:
        aggregates = [F.count(F.lit(1)).alias("total")]
        rows = []
        for i, f in enumerate(batch):
            aggregates += _scalar_aggregates(f, i)
            rows.append(_scalar_row(f, i, df.columns.index(f.name) + 1))
        grouped = df.groupBy(*[_col(k) for k in keys]).agg(*aggregates)
        parts.append(grouped.select(*[_col(k) for k in keys], F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def _cells(df: DataFrame, keys: Sequence[str], columns: Sequence[str], parts: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row per non-NULL cell: keys, the position of the column, and ``parts`` of the value."""
    cells = [
        F.struct(
            F.lit(i).alias("position"),
            _col(c).isNull().alias("absent"),
            *[part(_col(c)).alias(name) for name, part in parts.items()],
        )
        for i, c in enumerate(columns)
    ]
    return df.select(*[_col(k) for k in keys], F.inline(F.array(*cells))).where("NOT absent").drop("absent")


def _column_name(columns: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("position") + 1).alias("column")


def distinct_statistics(
    df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = (), approximate: bool = False
) -> DataFrame:
    """(keys, column, distinct_count, duplicate_values, repeated_rows), exact by default.

    ``duplicate_values`` counts the values that occur more than once and
    ``repeated_rows`` the rows they fill. ``approximate`` uses a mergeable sketch
    in one pass; the two duplicate counts are then NULL.
    """
    names = [c for c in df.columns if c not in keys and (columns is None or c in columns)]
    if approximate:
        grouped = df.groupBy(*[_col(k) for k in keys]).agg(
            *[F.approx_count_distinct(_col(c)).alias(f"d_{i}") for i, c in enumerate(names)]
        )
        rows = [
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"d_{i}").alias("distinct_count"),
                F.lit(None).cast("bigint").alias("duplicate_values"),
                F.lit(None).cast("bigint").alias("repeated_rows"),
            )
            for i, c in enumerate(names)
        ]
        return grouped.select(*[_col(k) for k in keys], F.inline(F.array(*rows)))
    # 128 bits of a value from two independently seeded hashes.
    cells = _cells(df, keys, names, {"a": F.xxhash64, "b": lambda c: F.xxhash64(F.lit(1), c)})
    group = [_col(k) for k in keys]
    sizes = cells.groupBy(*group, "position", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    counted = sizes.groupBy(*group, "position").agg(
        F.count(F.lit(1)).alias("distinct_count"),
        F.count_if(F.col("n") > 1).alias("duplicate_values"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated_rows"),
    )
    return counted.select(*group, _column_name(names), "distinct_count", "duplicate_values", "repeated_rows")


def category_of(
    name: Column, data_type: Column, distinct_pct: Column, distinct_count: Column, rules: ProfilePolicy
) -> Column:
    """Semantic category of a column: name hints first, then type and cardinality."""
    upper = F.upper(name)
    kind = base_type(data_type)
    numeric = starts_with_any(kind, policy.NUMERIC_PREFIXES)
    few = rules.categorical_max_distinct
    return (
        F.when(F.contains(upper, F.lit("EMAIL")) | upper.endswith("_MAIL"), "email")
        .when(contains_any(upper, ("PHONE", "MOBILE")) | upper.endswith("_TEL"), "phone")
        .when(starts_with_any(kind, policy.DATE_PREFIXES), "date")
        .when((upper == "ID") | contains_any(upper, policy.ID_HINTS), "id")
        .when((distinct_pct >= 98) & ~numeric, "id")
        .when(contains_any(upper, policy.STATUS_HINTS), "status")
        .when(numeric & contains_any(upper, policy.AMOUNT_HINTS), "amount")
        .when(numeric & (distinct_count <= few), "categorical")
        .when(numeric, "measure")
        .when(
            starts_with_any(kind, policy.TEXT_PREFIXES) & (distinct_count <= max(2 * few, 30)),
            "categorical",
        )
        .otherwise("text")
    )


def profile_columns(
    df: DataFrame,
    table: str,
    as_of: AsOf | None = None,
    columns: Sequence[str] | None = None,
    keys: Sequence[str] = (),
    rules: ProfilePolicy = ProfilePolicy(),
    approximate: bool = False,
) -> DataFrame:
    """The full profile, one row per (keys, column)."""
    scalars = scalar_statistics(df, columns, keys)
    distincts = distinct_statistics(df, columns, keys, approximate)
    joined = scalars.join(distincts, [*keys, "column"], "left")
    now = moment(as_of) if as_of is not None else F.lit(None).cast("timestamp_ntz")
    distinct = F.coalesce(F.col("distinct_count"), F.lit(0))
    distinct_pct = _percent(distinct, F.col("non_null"), 2)
    mean, deviation = F.col("avg_value"), F.col("stddev")
    return joined.select(
        *[_col(k) for k in keys],
        F.lit(table).alias("table"),
        "column",
        "ordinal",
        "data_type",
        category_of(F.col("column"), F.col("data_type"), distinct_pct, distinct, rules).alias("category"),
        "total",
        "non_null",
        (F.col("total") - F.col("non_null")).alias("null_count"),
        F.coalesce(_percent(F.col("total") - F.col("non_null"), F.col("total"), 4), F.lit(0.0)).alias("null_pct"),
        distinct.alias("distinct_count"),
        distinct_pct.alias("distinct_pct"),
        F.coalesce("duplicate_values", F.lit(0)).alias("duplicate_values"),
        F.coalesce("repeated_rows", F.lit(0)).alias("repeated_rows"),
        "min_value",
        "max_value",
        "min_number",
        "max_number",
        "avg_value",
        "stddev",
        "avg_length",
        "max_length",
        "pattern_match_pct",
        "newest",
        F.round(seconds_between(F.col("newest"), now) / 86400, 1).alias("freshness_days"),
        F.coalesce(
            (deviation > 0) & (F.abs(F.col("max_number") - mean) > rules.outlier_stddevs * deviation),
            F.lit(False),
        ).alias("outlier_hint"),
    )


def value_frequencies(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, value, n) of the non-NULL values, as text. For low-cardinality columns."""
    cells = _cells(df, keys, columns, {"value": lambda c: c.cast("string")})
    group = [_col(k) for k in keys]
    counted = cells.groupBy(*group, "position", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*group, _column_name(columns), "value", "n")


def extreme_values(frequencies: DataFrame, k: int, rarest: bool = False) -> DataFrame:
    """The k most (or least) frequent values per column; equal counts go by value.

    Catalyst turns the rank filter into a per-task limit, so a column with many
    values sends k rows per task to the final ranking.
    """
    keys = [c for c in frequencies.columns if c not in ("value", "n")]
    order = F.col("n") if rarest else F.col("n").desc()
    ranked = frequencies.withColumn(
        "rank", F.row_number().over(W.partitionBy(*keys).orderBy(order, F.col("value")))
    )
    return ranked.where(F.col("rank") <= k)


def _names(profile: DataFrame, condition: Column) -> list[str]:
    """Column names a profile selects: metadata, one row per column of the table."""
    return [r["column"] for r in profile.where(condition).select("column").distinct().collect()]


def shows_top_values(rules: ProfilePolicy) -> Column:
    return F.col("category").isin("status", "categorical") | (
        (F.col("category") == "text") & (F.col("distinct_count") <= rules.top_values_max_distinct)
    )


def _empty_frequencies(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "column string, value string, n bigint")


def top_values(df: DataFrame, profile: DataFrame, rules: ProfilePolicy = ProfilePolicy()) -> DataFrame:
    """Most frequent values of the columns whose category shows them.

    The profile is consulted first, so that no column of identifiers or free text
    is grouped by value.
    """
    names = _names(profile, shows_top_values(rules))
    counted = value_frequencies(df, names) if names else _empty_frequencies(df)
    return extreme_values(counted, rules.top_k)


def tail_values(df: DataFrame, profile: DataFrame, rules: ProfilePolicy = ProfilePolicy()) -> DataFrame:
    """Least frequent values of the columns with few enough distinct values."""
    names = _names(profile, F.col("distinct_count").between(1, rules.tail_values_max_distinct))
    counted = value_frequencies(df, names) if names else _empty_frequencies(df)
    return extreme_values(counted, rules.top_k, rarest=True)


def left_out(profile: DataFrame, keys: Sequence[str] = (), rules: ProfilePolicy = ProfilePolicy()) -> DataFrame:
    """(keys, column, list, distinct_count, reason): which value lists a column has not, and why.

    ``list`` is top_values, tail_values or closed_set.
    """
    n = F.col("distinct_count")

    def entry(name: str, most: int, category_allows: Column = F.lit(True), category_decides: Column = F.lit(False)) -> Column:
        reason = (
            F.when(~category_allows, F.concat(F.lit("columns of category "), F.coalesce("category", F.lit("?")), F.lit(" have none")))
            .when(F.coalesce(n, F.lit(0)) == 0, "no value")
            .when(~category_decides & (n > most), f"more than {most} distinct values")
        )
        return F.struct(F.lit(name).alias("list"), n.alias("distinct_count"), reason.alias("reason"))

    listed = F.col("category").isin("status", "categorical")
    entries = F.array(
        entry("top_values", rules.top_values_max_distinct, listed | (F.col("category") == "text"), listed),
        entry("tail_values", rules.tail_values_max_distinct),
        entry("closed_set", rules.closed_set_max_distinct),
    )
    missing = F.filter(entries, lambda e: e["reason"].isNotNull())
    return profile.select(*[_col(k) for k in keys], "column", F.inline(missing))


def closed_sets(
    df: DataFrame, profile: DataFrame, keys: Sequence[str] = (), rules: ProfilePolicy = ProfilePolicy()
) -> DataFrame:
    """(keys, column, distinct_count, values): the complete, sorted value list of enum-like columns.

    Only groups the profile found to hold at most ``closed_set_max_distinct``
    values are collected, so the lists are bounded.
    """
    small = F.col("distinct_count").between(1, rules.closed_set_max_distinct)
    names = _names(profile, small)
    if not names:
        counted = _empty_frequencies(df)
        keys = ()
    else:
        counted = value_frequencies(df, names, keys)
    allowed = profile.where(small).select(*keys, "column", "distinct_count")
    return (
        counted.join(allowed, [*keys, "column"])
        .groupBy(*[_col(k) for k in keys], "column")
        .agg(
            F.first("distinct_count").alias("distinct_count"),
            F.sort_array(F.collect_list("value")).alias("values"),
        )
    )


def value_sample(df: DataFrame, column: str, limit: int = 200, order_by: Sequence[str] = ()) -> DataFrame:
    """Up to ``limit`` non-NULL values of a column."""
    rows = df.where(_col(column).isNotNull())
    if order_by:
        rows = rows.orderBy(*[_col(c) for c in order_by])
    return rows.select(_col(column).alias("value")).limit(limit)


def null_summary(df: DataFrame, column: str) -> DataFrame:
    """Total, non-NULL rows and the NULL percentage (one decimal) of a column."""
    counted = df.agg(F.count(F.lit(1)).alias("total"), F.count(_col(column)).alias("non_null"))
    return counted.select(
        F.lit(column).alias("column"),
        "total",
        "non_null",
        _percent(F.col("total") - F.col("non_null"), F.col("total"), 1).alias("null_pct"),
    )


def row_sample(
    df: DataFrame,
    columns: Sequence[str],
    predicate: str | None = None,
    limit: int = 20,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """``limit`` rows of the given columns that satisfy an optional predicate."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    rows = df.where(F.expr(predicate)) if predicate else df
    if order_by:
        rows = rows.orderBy(*[_col(c) for c in order_by])
    return rows.select(*[_col(c) for c in columns]).limit(limit)


def anomaly_signals(profile: DataFrame, rules: ProfilePolicy = ProfilePolicy()) -> DataFrame:
    """Statistical red flags of a profile, one row each."""
    tests = [
        (F.col("null_pct") >= rules.high_null_pct, "high_null_rate"),
        (F.col("outlier_hint"), "numeric_outlier"),
        ((F.col("category") == "id") & (F.col("duplicate_values") > 0), "duplicate_key"),
        (F.col("freshness_days") > rules.stale_days, "stale_data"),
        (
            F.col("category").isin("email", "phone") & (F.col("pattern_match_pct") < rules.pattern_min_pct),
            "format_mismatch",
        ),
    ]
    flags = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in tests]))
    keep = [c for c in profile.columns if c in ("asset_id", "captured_at", "table", "column", "category")]
    return profile.select(*keep, F.explode(flags).alias("signal"))


def key_candidates(profile: DataFrame, shape: str = policy.STRONG_KEY_SHAPE) -> DataFrame:
    """Columns whose name says they identify a row: are they unique, how many rows repeat."""
    return profile.where(F.upper("column").rlike(shape)).select(
        "table",
        "column",
        "total",
        "non_null",
        "distinct_count",
        (F.col("distinct_count") >= F.col("non_null")).alias("is_unique"),
        F.greatest(F.col("non_null") - F.col("distinct_count"), F.lit(0)).alias("duplicate_rows"),
    )


def freshness_signals(profile: DataFrame) -> DataFrame:
    """Temporal columns that hold a value, with their age."""
    return profile.where(F.col("newest").isNotNull()).select(
        F.concat(F.lit("freshness:"), F.col("column")).alias("signal_id"),
        "table",
        "column",
        "data_type",
        "newest",
        "freshness_days",
    )


def table_summary(profile: DataFrame) -> DataFrame:
    """Row and column counts per table and the categories present, in their fixed order."""
    order = F.array(*[F.lit(c) for c in policy.CATEGORY_ORDER])
    found = profile.groupBy("table").agg(
        F.max("total").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.collect_set("category").alias("found"),
    )
    return found.select(
        "table",
        "row_count",
        "column_count",
        F.filter(order, lambda c: F.array_contains(F.col("found"), c)).alias("categories"),
    )


def grounded_values(proposed: DataFrame, sets: DataFrame) -> DataFrame:
    """Keep of each proposed value list what the column's closed set contains.

    ``proposed``: column, values. A column without a closed set keeps its list.
    """
    observed = sets.select("column", F.col("values").alias("observed"))
    text_values = F.col("values").cast("array<string>")
    return proposed.join(observed, "column", "left").select(
        "column",
        F.when(F.col("observed").isNull(), text_values)
        .otherwise(F.filter(text_values, lambda v: F.array_contains(F.col("observed"), v)))
        .alias("values"),
        F.when(F.col("observed").isNull(), F.array().cast("array<string>"))
        .otherwise(F.filter(text_values, lambda v: ~F.array_contains(F.col("observed"), v)))
        .alias("dropped"),
    )
