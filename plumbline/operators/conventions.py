"""Naming and typing conventions over column metadata.

Input is a ``columns_meta`` DataFrame (table, column, data_type, is_nullable,
comment). All column rules are evaluated in one pass for all tables; all table
rules share one aggregation by table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import policy
from plumbline.functions.naming import base_type, matches_any, nullable_flag, severity_rank
from plumbline.session import stored

#: Rules that run by default; the others are available by name.
ACTIVE_RULES = (
    "NO_PRIMARY_KEY_HINT",
    "PII_COLUMN_NO_MASKING",
    "NULLABLE_ID_COLUMN",
    "DATE_STORED_AS_VARCHAR",
    "BOOLEAN_STORED_AS_VARCHAR",
)


def _finding(code: str | Column, severity: str, test: Column) -> Column:
    code_column = F.lit(code) if isinstance(code, str) else code
    return F.when(
        test, F.struct(code_column.alias("rule_code"), F.lit(severity).alias("severity"))
    )


def _wrong_type_code() -> Column:
    """Rule code of the first name pattern that hits, if the type is not one it allows."""
    name, kind = F.upper("column"), base_type(F.col("data_type"))
    chain = F
    for pattern, allowed, code in policy.NAME_TYPE_RULES:
        chain = chain.when(name.rlike(pattern), F.when(~kind.isin(*allowed), F.lit(code)))
    return chain


def _column_rules() -> dict[str, Column]:
    name, kind = F.upper("column"), base_type(F.col("data_type"))
    text = kind.isin(*policy.TEXT_TYPES)
    stem = F.regexp_replace(F.upper("table"), "S+$", "")
    own = (name == F.concat(stem, F.lit("_ID"))) | name.isin("SURROGATE_KEY", "ROW_ID", "RECORD_ID")
    wrong = _wrong_type_code()
    return {
        "PII_COLUMN_NO_MASKING": _finding(
            "PII_COLUMN_NO_MASKING",
            "high",
            name.isin(*policy.PII_NAMES) | matches_any(name, policy.PII_PATTERNS),
        ),
        "NULLABLE_ID_COLUMN": _finding(
            "NULLABLE_ID_COLUMN",
            "high",
            name.rlike(policy.NULLABLE_KEY_SHAPE) & F.coalesce(nullable_flag(F.col("is_nullable")), F.lit(False)),
        ),
        "DATE_STORED_AS_VARCHAR": _finding(
            "DATE_STORED_AS_VARCHAR", "high", name.rlike(policy.DATE_SHAPE) & text
        ),
        "BOOLEAN_STORED_AS_VARCHAR": _finding(
            "BOOLEAN_STORED_AS_VARCHAR", "medium", name.rlike(policy.FLAG_SHAPE) & text
        ),
        "COLUMN_WRONG_TYPE": _finding(wrong, "medium", wrong.isNotNull()),
        "FK_COLUMN_NO_CONSTRAINT": _finding("FK_COLUMN_NO_CONSTRAINT", "low", name.rlike("_ID$") & ~own),
        "GENERIC_COLUMN_NAME": _finding("GENERIC_COLUMN_NAME", "low", name.isin(*policy.GENERIC_NAMES)),
    }


def _table_rules() -> tuple[list[Column], dict[str, Column]]:
    """Aggregates over a table's columns and the rules on top of them."""
    raw, name = F.col("column"), F.upper("column")
    snake = F.contains(raw, F.lit("_"))
    aggregates = [
        F.count(F.lit(1)).alias("n"),
        F.bool_or(name.rlike(policy.KEY_SHAPE)).alias("has_key"),
        F.bool_or(name.isin(*policy.CREATED_AT_NAMES)).alias("has_created"),
        F.bool_or(name.isin(*policy.UPDATED_AT_NAMES)).alias("has_updated"),
        F.count_if(snake & (raw == F.upper(raw))).alias("upper_snake"),
        F.count_if(snake & (raw == F.lower(raw))).alias("lower_snake"),
        F.count_if(~snake & raw.rlike("[a-z][A-Z]")).alias("camel"),
    ]
    styles = sum(
        ((F.col(c) > 1).cast("int") for c in ("upper_snake", "lower_snake", "camel")), F.lit(0)
    )
    rules = {
        "NO_PRIMARY_KEY_HINT": _finding("NO_PRIMARY_KEY_HINT", "medium", ~F.col("has_key")),
        "MISSING_CREATED_AT": _finding("MISSING_CREATED_AT", "medium", ~F.col("has_created")),
        "MISSING_UPDATED_AT": _finding("MISSING_UPDATED_AT", "low", ~F.col("has_updated")),
        "TOO_MANY_COLUMNS": _finding("TOO_MANY_COLUMNS", "low", F.col("n") > policy.MAX_COLUMNS),
        "INCONSISTENT_COLUMN_NAMING": _finding(
            "INCONSISTENT_COLUMN_NAMING", "low", (F.col("n") >= 3) & (styles >= 2)
        ),
    }
    return aggregates, rules


def _explode(df: DataFrame, keep: Sequence[Column], rules: Sequence[Column]) -> DataFrame:
    found = F.filter(F.array(*rules), lambda f: f.isNotNull())
    return df.select(*keep, F.inline(found))


def check_conventions(columns_meta: DataFrame, rules: Sequence[str] = ACTIVE_RULES) -> DataFrame:
    """Findings (table, column or NULL, rule_code, severity) of the chosen rules."""
    column_rules = [r for n, r in _column_rules().items() if n in rules]
    aggregates, all_table_rules = _table_rules()
    table_rules = [r for n, r in all_table_rules.items() if n in rules]
    if not column_rules and not table_rules:
        raise ValueError("no known rule chosen")

    def found(candidates: Sequence[Column], column: Column) -> Column:
        """What fires, as an array of (column, rule_code, severity)."""
        if not candidates:
            return F.array().cast("array<struct<column:string,rule_code:string,severity:string>>")
        fired = F.filter(F.array(*candidates), lambda f: f.isNotNull())
        return F.transform(
            fired, lambda f: F.struct(column.alias("column"), f["rule_code"].alias("rule_code"), f["severity"].alias("severity"))
        )

    # One pass: a table's columns are metadata, so their findings fit into a row.
    grouped = columns_meta.groupBy("table").agg(
        F.flatten(F.collect_list(found(column_rules, F.col("column")))).alias("__columns"), *aggregates
    )
    own = found(table_rules, F.lit(None).cast("string"))
    return grouped.select("table", F.inline(F.concat("__columns", own)))


def all_rule_names() -> list[str]:
    return [*_column_rules(), *_table_rules()[1]]


def missing_documentation(columns_meta: DataFrame, tables_meta: DataFrame) -> DataFrame:
    """Blank comments and owners. ``tables_meta``: table, owner, comment."""

    def blank(c: str) -> Column:
        return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""

    tables = _explode(
        tables_meta,
        [F.col("table"), F.lit(None).cast("string").alias("column")],
        [
            _finding("MISSING_TABLE_COMMENT", "medium", blank("comment")),
            _finding("MISSING_TABLE_OWNER", "medium", blank("owner")),
        ],
    )
    columns = _explode(
        columns_meta,
        [F.col("table"), F.col("column")],
        [_finding("MISSING_COLUMN_COMMENT", "low", blank("comment"))],
    )
    return tables.unionByName(columns)


def schema_gate(
    columns_meta: DataFrame, fail_on: Sequence[str] = ("critical", "high")
) -> tuple[DataFrame, DataFrame]:
    """(findings worst first, summary) of the active rules on declared schemas.

    The summary is one row: rules_checked, finding_count, blocked_by, passed.
    """
    # Findings and summary start from the same stored rows.
    columns_meta = stored(columns_meta, "declared-columns")
    findings = check_conventions(columns_meta).withColumn("blocks", F.col("severity").isin(*fail_on))
    ordered = findings.orderBy(severity_rank(F.col("severity")), "table", F.col("column").asc_nulls_first(), "rule_code")
    none = F.lit(0).cast("bigint")
    checked = columns_meta.groupBy("table").agg((F.count(F.lit(1)) * 4 + 1).alias("checked")).select(
        "checked", none.alias("found"), none.alias("blocking")
    )
    found = findings.select(
        none.alias("checked"), F.lit(1).alias("found"), F.col("blocks").cast("bigint").alias("blocking")
    )
    summary = checked.unionByName(found).agg(
        F.sum("checked").alias("rules_checked"),
        F.sum("found").alias("finding_count"),
        F.sum("blocking").alias("blocked_by"),
        (F.sum("blocking") == 0).alias("passed"),
    )
    return ordered, summary


def with_approved_instance(findings: DataFrame, instances: DataFrame) -> DataFrame:
    """Drop findings whose (table, rule) has no approved instance; attach its id.

    ``instances``: table, handler_key, instance_id, one approved instance per pair.
    """
    approved = instances.select(
        "table", F.upper("handler_key").alias("rule_code"), "instance_id"
    )
    return findings.join(approved, ["table", "rule_code"])
