"""Planted defects with exact expected counts."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import checks
from plumbline.operators.checks import build_check


@pytest.fixture(scope="module")
def tables(spark):
    i = F.col("id")
    return {
        # every tenth customer is missing
        "nulls": spark.range(100).select(i, F.when(i % 10 != 0, i).alias("customer_id")),
        # one group of six equal values among 55 rows, and two NULLs
        "dups": spark.range(55).select(
            i, F.when(i < 6, 42).when(i >= 53, None).otherwise(i + 1000).alias("user_id"), (i % 11).alias("slot")
        ),
        "people": spark.createDataFrame(
            [(20, "a@b.co", "active"), (121, "no mail", "pending"), (0, None, "gone"), (None, "x@y.z", None), (-1, "a@b", "closed")],
            "age int, email string, status string",
        ),
        "parents": spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "parent_id int"),
        "children": spark.createDataFrame([(1,), (1,), (2,), (9,), (9,), (8,), (None,)], "parent_id int"),
        "spans": spark.sql(
            "SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-01-01', TIMESTAMP_NTZ'2024-01-02'), "
            "(TIMESTAMP_NTZ'2024-01-03', TIMESTAMP_NTZ'2024-01-02'), (TIMESTAMP_NTZ'2024-01-03', NULL) AS t(start_at, end_at)"
        ),
        "empty": spark.createDataFrame([], "x int, at timestamp_ntz"),
    }


def run(tables, check, as_of=None):
    row = checks.scan(tables, [check], as_of).first()
    return row["fail_count"], row["total_count"], row["status"]


@pytest.mark.parametrize(
    ("shape", "table", "target", "threshold", "expected"),
    [
        ("not_null", "nulls", {"column": "customer_id"}, {}, (10, 100, "failed")),
        ("uniqueness", "dups", {"column": "user_id"}, {}, (6, 55, "failed")),
        ("uniqueness", "dups", {"column": "id"}, {}, (0, 55, "passed")),
        ("duplicate_key", "dups", {"columns": ["user_id", "id"]}, {}, (0, 55, "passed")),
        ("duplicate_key", "dups", {"columns": ["slot"]}, {}, (55, 55, "failed")),
        ("range", "people", {"column": "age"}, {"min": 0, "max": 120}, (2, 4, "failed")),
        ("range", "people", {"column": "age"}, {"minimum": 0}, (1, 4, "failed")),
        ("accepted_values", "people", {"column": "status"}, {"values": ["active", "pending", "closed"]}, (1, 4, "failed")),
        ("regex_match", "people", {"column": "email"}, {"regex": r"[^@\s]+@[^@\s]+\.[^@\s]+"}, (2, 4, "failed")),
        # a part of the value matching is not enough
        ("regex_match", "people", {"column": "status"}, {"regex": "activ|clos|pending"}, (3, 4, "failed")),
        ("referential_integrity", "children", {"column": "parent_id", "ref_table": "parents", "ref_column": "parent_id"}, {}, (3, 7, "failed")),
        ("predicate", "spans", {}, {"fails_if": "end_at < start_at"}, (1, 3, "failed")),
        ("not_null", "empty", {"column": "x"}, {}, (0, 0, "passed")),
        ("uniqueness", "empty", {"column": "x"}, {}, (0, 0, "passed")),
    ],
)
def test_counts(tables, shape, table, target, threshold, expected):
    assert run(tables, build_check(shape, table, target, threshold)) == expected


def test_freshness(tables):
    check = build_check("freshness", "spans", {"column": "start_at"}, {"max_age_hours": 24})
    assert run(tables, check, "2024-01-04 00:00:00") == (0, 1, "passed")
    assert run(tables, check, "2024-01-04 00:00:01") == (1, 1, "failed")
    nothing = build_check("freshness", "empty", {"column": "at"}, {"max_age_hours": 1})
    assert run(tables, nothing, "2024-01-04") == (0, 1, "passed")


def test_failing_check_does_not_lose_the_rest(tables):
    found = checks.scan(
        tables,
        [
            build_check("not_null", "nulls", {"column": "customer_id"}, rule="good"),
            build_check("not_null", "nulls", {"column": "missing"}, rule="no column"),
            build_check("predicate", "nulls", {}, {"fails_if": "nonsense ("}, rule="bad text"),
            build_check("not_null", "nowhere", {"column": "x"}, rule="no table"),
            build_check("not_null", "nulls", {"column": "id"}, rule="off", enabled=False),
        ],
    )
    status = {r["rule"]: r["status"] for r in found.collect()}
    assert status == {"good": "failed", "no column": "error", "bad text": "error", "no table": "error"}


def test_row_checks_share_one_aggregation(tables):
    rules = [build_check("range", "people", {"column": "age"}, {"min": n}) for n in range(20)]
    plan = checks.scan(tables, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.count("Scan") <= 1


@pytest.mark.parametrize(
    ("shape", "target", "threshold"),
    [
        ("accepted_values", {"column": "a"}, {"accepted_values": []}),
        ("range", {"column": "a"}, {}),
        ("regex_match", {"column": "a"}, {}),
        ("freshness", {"column": "a"}, {}),
        ("not_null", {}, {}),
        ("referential_integrity", {"column": "a"}, {}),
        ("unheard_of", {"column": "a"}, {}),
    ],
)
def test_bad_configuration(shape, target, threshold):
    with pytest.raises(ValueError):
        build_check(shape, "t", target, threshold)


def test_threshold_aliases():
    given = {"min": 1, "maximum": 9, "max_value": 5, "regex": "x", "allowed_values": [1], "other": 2}
    assert checks.normalize_thresholds(given) == {
        "min_value": 1, "max_value": 5, "pattern": "x", "accepted_values": [1], "other": 2,
    }
    assert checks.normalize_thresholds(None) == {}


def test_samples_follow_the_counts(tables, rows):
    dup = build_check("uniqueness", "dups", {"column": "user_id"})
    assert rows(checks.failing_rows(tables, dup, 10), "user_id") == [(42,)] * 6
    assert checks.failing_rows(tables, dup, 4).count() == 4
    ref = build_check("referential_integrity", "children", {"column": "parent_id", "ref_table": "parents", "ref_column": "parent_id"})
    assert rows(checks.failing_rows(tables, ref, 10)) == [(8,), (9,), (9,)]
    fresh = build_check("freshness", "spans", {"column": "start_at"}, {"max_age_hours": 1})
    assert checks.failing_rows(tables, fresh, 10).count() == 0


def test_reconcile_and_override(spark, rows):
    results = spark.createDataFrame(
        [("a", "low", 1, 9, "failed"), ("b", "low", 0, 9, "passed"), ("c", "low", None, None, "error")],
        "rule string, severity string, fail_count bigint, total_count bigint, status string",
    )
    samples = spark.createDataFrame([("a", 3), ("b", 2)], "rule string, sample_count bigint")
    assert rows(checks.reconcile(results, samples), "rule", "fail_count", "status") == [
        ("a", 3, "failed"), ("b", 2, "failed"), ("c", 0, "error"),
    ]
    changed = checks.override_severity(results, spark.createDataFrame([("b", "high")], "rule string, severity string"))
    assert rows(changed, "rule", "severity") == [("a", "low"), ("b", "high"), ("c", "low")]


def test_execution_log(spark, rows):
    ran = spark.createDataFrame([("i1",), ("i2",)], "instance_id string")
    failed = spark.createDataFrame([("i1", 4, 10)], "instance_id string, fail_count bigint, total_count bigint")
    log = checks.execution_log(ran, failed, F.lit("2024-01-01").cast("timestamp_ntz"))
    assert rows(log, "instance_id", "status", "fail_count") == [("i1", "failed", 4), ("i2", "passed", None)]


def test_values_that_end_a_job_are_isolated(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a", 1), ("5", 0)], "s string, n int")
    rules = [
        build_check("range", "t", {"column": "s"}, {"min": 1}, rule="text"),
        build_check("predicate", "t", {}, {"fails_if": "1 / n > 5"}, rule="zero"),
        build_check("range", "t", {"column": "n"}, {"min": 1}, rule="low"),
        build_check("not_null", "t", {"column": "s"}, rule="null"),
        build_check("uniqueness", "t", {"column": "n"}, rule="unique"),
    ]
    got = {r["rule"]: (r["status"], r["fail_count"], r["total_count"]) for r in checks.scan({"t": rows}, rules).collect()}
    assert got == {
        "text": ("error", None, None), "zero": ("error", None, None), "low": ("failed", 1, 2), "null": ("passed", 0, 2), "unique": ("passed", 0, 2),
    }
    ran = spark.createDataFrame([("text",), ("low",), ("null",)], "instance_id string")
    results = checks.scan({"t": rows}, rules).where("status <> 'passed'").withColumnRenamed("rule", "instance_id")
    log = checks.execution_log(ran, results, F.lit("2024-01-01").cast("timestamp_ntz"))
    assert {r["instance_id"]: r["status"] for r in log.collect()} == {"text": "error", "low": "failed", "null": "passed"}
    grouped = checks.scan_groups(rows, [F.col("n")], [rules[2], build_check("not_null", "t", {"column": "s"}, rule="off", enabled=False)])
    assert {r["rule"] for r in grouped.collect()} == {"low"}
