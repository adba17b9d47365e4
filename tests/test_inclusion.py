"""Counted values, checks of keys, SELECT checks, rare-word pairs and the scan of all kinds of rules."""

import datetime as dt
import itertools
import math
import random
import time
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.operators import checks, drift, inclusion, relationships, rulescan, similarity
from plumbline.operators.checks import build_check
from plumbline.sources.tables import columns_meta


def scans(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


@pytest.fixture
def saved(spark, tmp_path):
    def save(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / name))
        return {name: spark.read.parquet(str(tmp_path / name)) for name in tables}

    return save


def test_values_of_a_family_are_spelled_alike(spark):
    row = spark.createDataFrame(
        [(7, 7, 7.0, Decimal("7.00"), 7.5, Decimal("7.50"), "7", dt.date(2024, 1, 2), dt.datetime(2024, 1, 2), True, bytearray(b"7"), "x" * 65, None)],
        "a int, b bigint, c double, d decimal(10,2), e double, f decimal(20,4), g string, h date, i timestamp_ntz, j boolean, k binary, l string, m int",
    )
    spelled = row.select([inclusion.spelling(F.col(n), row.schema[n].dataType).alias(n) for n in row.columns]).first()
    assert spelled["a"] == spelled["b"] == spelled["c"] == spelled["d"] and spelled["e"] == spelled["f"] and spelled["h"] == spelled["i"]
    assert len({spelled[n] for n in "aeghjkl"}) == 7 and spelled["m"] is None
    assert len(spelled["l"]) < 70


def test_inclusions_against_sets(spark):
    rng = random.Random(3)
    data = {c: [rng.choice([None, *range(size)]) for _ in range(80)] for c, size in (("a", 5), ("b", 9), ("c", 30), ("d", 31))}
    data["e"] = [None] * 80
    tables = {c: spark.createDataFrame([(v,) for v in values], f"{c} int") for c, values in data.items()}
    names = [(c, c) for c in data]
    index = inclusion.index_values(tables, names)
    for share in (0.0, 0.3):
        found = {(r["from_table"], r["to_table"]): (r["total"], r["orphans"]) for r in inclusion.inclusions(index, share).collect()}
        want = {}
        for x, y in itertools.permutations(data, 2):
            filled = [v for v in data[x] if v is not None]
            orphans = sum(v not in set(data[y]) for v in filled)
            if filled and orphans <= share * len(filled) and orphans < len(filled):
                want[x, y] = (80, orphans)
        assert found == want
    ratios = {r["table"]: r["ratio"] for r in index.uniqueness().collect()}
    assert ratios["e"] == 0.0 and ratios["a"] == len({v for v in data["a"] if v is not None}) / 80


def test_many_pairs_are_planned_in_seconds(spark, saved):
    parents = {f"P{i}S": spark.range(6).select(F.col("id").alias(f"P{i}_ID")) for i in range(5)}
    child = spark.range(40).select(*[(F.col("id") % (3 + i)).alias(f"P{i}_ID") for i in range(5)])
    tables = saved(**parents, **{f"C{j:03d}": child for j in range(12)})
    names = [(t, c) for t, df in tables.items() for c in df.columns]
    counts = inclusion.value_counts(tables, names)
    # a scan per table, however many key columns it has
    assert scans(counts) == len(tables)
    begin = time.time()
    found = relationships.discover(tables, columns_meta(spark, tables))
    listed = found.collect()
    assert time.time() - begin < 60
    # every child column refers to its parent; ids 6 to 8 have none
    assert len(listed) == 60 and {r["sample_total"] for r in listed} == {40}
    by_column = {r["from_column"]: r["sample_orphans"] for r in listed}
    assert [by_column[f"P{i}_ID"] for i in range(5)] == [sum(k % (3 + i) > 5 for k in range(40)) for i in range(5)]


def test_key_checks_share_a_scan(spark, saved):
    tables = saved(
        orders=spark.range(30).select(F.col("id").alias("o"), F.when(F.col("id") > 2, F.col("id") % 9).alias("c"), (F.col("id") % 4).alias("d")),
        customers=spark.range(7).select(F.col("id").cast("int").alias("k")),
    )
    rules = [
        build_check("uniqueness", "orders", {"column": "o"}), build_check("uniqueness", "orders", {"column": "c"}),
        build_check("duplicate_key", "orders", {"columns": ["c", "d"]}), build_check("uniqueness", "customers", {"column": "k"}),
        build_check("referential_integrity", "orders", {"column": "c", "ref_table": "customers", "ref_column": "k"}),
    ]
    found = checks.scan(tables, rules)
    assert scans(found) == 2
    rows = [(i, i % 9 if i > 2 else None, i % 4) for i in range(30)]
    keyed = [r[1:] for r in rows if r[1] is not None]
    want = {
        "uniqueness:orders.o": (0, 30), "uniqueness:orders.c": (27, 30), "uniqueness:customers.k": (0, 7),
        "duplicate_key:orders.c,d": (sum(keyed.count(k) > 1 for k in keyed), 30),
        "referential_integrity:orders.c": (sum(r[1] is not None and r[1] > 6 for r in rows), 30),
    }
    assert {r["rule"]: (r["fail_count"], r["total_count"]) for r in found.collect()} == want


def test_empty_tables_have_no_failures(spark):
    tables = {"a": spark.createDataFrame([], "x int"), "b": spark.createDataFrame([(1,)], "y int")}
    rules = [
        build_check("uniqueness", "a", {"column": "x"}), build_check("referential_integrity", "a", {"column": "x", "ref_table": "b", "ref_column": "y"}),
        build_check("referential_integrity", "b", {"column": "y", "ref_table": "a", "ref_column": "x"}),
    ]
    assert [(r["fail_count"], r["total_count"], r["status"]) for r in checks.scan(tables, rules).orderBy("table", "rule").collect()] == [
        (0, 0, "passed"), (0, 0, "passed"), (1, 1, "failed"),
    ]


def test_only_faults_of_rules_become_errors(spark):
    with pytest.raises(PySparkException) as divided:
        spark.sql("SELECT 1 DIV id FROM range(1)").collect()
    assert checks.is_data_error(divided.value)
    assert not checks.is_data_error(PySparkException("a lost executor")) and not checks.is_data_error(OSError("full"))
    table = spark.createDataFrame([("1", 2), ("x", 3), (None, 4)], "t string, n int")
    rules = [
        build_check("range", "r", {"column": "t"}, {"min": 0}, rule="text"), build_check("range", "r", {"column": "n"}, {"max": 3}, rule="number"),
        build_check("accepted_values", "r", {"column": "n"}, {"values": ["2", "3"]}, rule="as_text"),
        build_check("accepted_values", "r", {"column": "n"}, {"values": ["two"]}, rule="no_number"),
    ]
    found = {r["rule"]: (r["status"], r["fail_count"], r["error"]) for r in checks.scan({"r": table}, rules).collect()}
    assert found["text"] == ("error", None, "1 values of t are no numbers") and found["number"] == ("failed", 1, None)
    assert found["as_text"] == ("failed", 1, None) and found["no_number"][0] == "error"
    fine = {r["rule"]: r["fail_count"] for r in checks.scan({"r": table.where("t IS NULL OR t <> 'x'")}, rules[:2]).collect()}
    assert fine == {"text": 0, "number": 1}


def test_groups_keep_going_beside_a_broken_rule(spark):
    table = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2)], "g string, n int")
    rules = [build_check("predicate", "t", {}, {"fails_if": "1 DIV n > 0"}, rule="bad"), build_check("range", "t", {"column": "n"}, {"min": 1}, rule="good")]
    found = checks.scan_groups(table, [F.col("g")], rules).collect()
    assert sorted((r["g"], r["rule"], r["status"], r["fail_count"]) for r in found) == [
        ("a", "bad", "error", None), ("a", "good", "failed", 1), ("b", "bad", "error", None), ("b", "good", "passed", 0),
    ]


def test_selects_name_their_tables(spark):
    tables = {"a": spark.range(4), "b": spark.range(2)}
    good = "SELECT count(*) AS TOTAL_COUNT, count_if(b.id IS NULL) AS Failed_Count FROM {a} a LEFT JOIN {b} b ON a.id = b.id"
    assert tuple(checks.sql_counts(spark, good, tables).first()) == (2, 4)
    texts = {"good": good, "syntax": "SELEC 1", "null": "SELECT NULL AS failed_count, 1 AS total_count", "brace": "SELECT } AS failed_count"}
    rules = [build_check("sql", "a", {}, {"sql": t}, rule=n) for n, t in texts.items()]
    found = {r["rule"]: r["status"] for r in checks.scan(tables, rules).collect()}
    assert found == {"good": "failed", "syntax": "error", "null": "error", "brace": "error"}
    with pytest.raises(ValueError):
        build_check("sql", "a", {})


def test_pairs_by_rare_words_lose_no_match(spark):
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]

    def rows(n, start):
        out = []
        for i in range(n):
            words = set(rng.choices(vocabulary, weights, k=rng.randint(1, 14)))
            out.append((start + i, None, " ".join(sorted(words))))
        return out

    left, right = rows(120, 0), rows(60, 1000)
    right += [(2000 + i, None, left[i][2]) for i in range(5)]
    form = "id int, name string, description string"
    found = similarity.best_matches(spark.createDataFrame(left, form), spark.createDataFrame(right, form), 0.55)
    want = {}
    for i, _, text in left:
        a = set(text.split())
        scored = [(-len(a & set(t.split())) / min(len(a), len(set(t.split()))), j) for j, _, t in right]
        score, j = min(scored)
        if -score >= 0.55:
            want[i] = (j, -score)
    got = {r["id"]: (r["match_id"], r["score"]) for r in found.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(math.isclose(got[k][1], want[k][1]) for k in want)


def test_full_scan_reads_each_table_once_for_rows_and_metadata(spark, saved):
    tables = saved(T=spark.createDataFrame([(1, "x", None), (2, None, None)], "ID int, NOTE string, AGENT_ID int"), U=spark.range(3).withColumnRenamed("id", "KEY"))
    rules = {"T": [build_check("not_null", "T", {"column": "NOTE"}, rule="note")]}
    assert scans(rulescan.table_pass(tables, rules)) == 2
    given = [
        *rules["T"], build_check("predicate", "U", {}, {"fails_if": "1 DIV (KEY - 1) > 5"}, rule="broken"),
        build_check("predicate", "U", {}, {"fails_if": "KEY > 1"}, rule="fine"), build_check("uniqueness", "U", {"column": "KEY"}, rule="unique"),
        build_check("not_null", "V", {"column": "X"}, rule="nowhere"),
    ]
    prior = drift.column_snapshot(spark.createDataFrame([("T", "ID", "bigint", "YES"), ("T", "NOTE", "string", None)], "table string, column string, data_type string, is_nullable string"))
    found = rulescan.full_rule_scan(tables, given, ["NULLABLE_ID_COLUMN"], prior).collect()
    assert sorted((r["kind"], r["rule"], r["table"], str(r["column"]), r["status"], r["fail_count"]) for r in found) == [
        ("drift", "column_added", "T", "AGENT_ID", "failed", 1), ("drift", "column_nullability_changed", "T", "ID", "failed", 1),
        ("drift", "column_type_changed", "T", "ID", "failed", 1), ("key", "unique", "U", "KEY", "passed", 0),
        ("metadata", "NULLABLE_ID_COLUMN", "T", "AGENT_ID", "failed", 1), ("row", "broken", "U", "", "error", None),
        ("row", "fine", "U", "", "failed", 1), ("row", "note", "T", "NOTE", "failed", 1), ("row", "nowhere", "V", "X", "error", None),
    ]
