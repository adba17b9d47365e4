"""Conventions, drift, catalog and state tables."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions.naming import own_key_names, types_joinable
from plumbline.operators import conventions, drift
from plumbline.sources import catalog, state
from plumbline.sources.tables import columns_meta, read_jdbc


def meta(spark, table, *columns):
    return spark.createDataFrame([(table, c, t, n) for c, t, n in columns], "table string, column string, data_type string, is_nullable string")


def codes(df):
    return sorted((r["column"] or "", r["rule_code"]) for r in df.collect())


def test_active_conventions(spark):
    df = meta(
        spark, "T",
        ("ID", "bigint", "YES"), ("EMAIL_ADDR", "string", "NO"), ("CREATED_ON", "string", "NO"), ("IS_OK", "string", "NO"),
        ("OK_FLAG", "boolean", "NO"), ("CUST_DOB", "date", "NO"), ("DOB", "date", "NO"), ("notes", "string", "YES"),
    )
    assert codes(conventions.check_conventions(df)) == [
        ("CREATED_ON", "DATE_STORED_AS_VARCHAR"), ("DOB", "PII_COLUMN_NO_MASKING"), ("EMAIL_ADDR", "PII_COLUMN_NO_MASKING"),
        ("ID", "NULLABLE_ID_COLUMN"), ("IS_OK", "BOOLEAN_STORED_AS_VARCHAR"),
    ]


def test_first_name_pattern_decides(spark):
    df = meta(spark, "T", ("A_ID", "string", "NO"), ("A_DATE", "string", "NO"), ("A_AT", "int", "NO"), ("A_FLAG", "int", "NO"),
              ("A_FLAG_NO", "int", "NO"), ("A_AMT", "decimal(12,2)", "NO"), ("A_PRICE", "string", "NO"))
    assert codes(conventions.check_conventions(df, ["COLUMN_WRONG_TYPE"])) == [
        ("A_AT", "COLUMN_TIMESTAMP_WRONG_TYPE"), ("A_DATE", "COLUMN_DATE_WRONG_TYPE"), ("A_ID", "COLUMN_ID_WRONG_TYPE"),
        ("A_PRICE", "COLUMN_AMOUNT_WRONG_TYPE"),
    ]


def test_table_conventions(spark):
    wide = meta(spark, "WIDE", *[(f"C{i}", "int", "NO") for i in range(51)])
    mixed = meta(spark, "MIXED", *[(c, "int", "NO") for c in ("A_B", "C_D", "e_f", "g_h", "CREATED_AT", "UPD_DATE")])
    table_rules = ["NO_PRIMARY_KEY_HINT", "MISSING_CREATED_AT", "MISSING_UPDATED_AT", "TOO_MANY_COLUMNS", "INCONSISTENT_COLUMN_NAMING"]
    found = conventions.check_conventions(wide.unionByName(mixed), table_rules)
    assert sorted((r["table"], r["rule_code"]) for r in found.collect()) == [
        ("MIXED", "INCONSISTENT_COLUMN_NAMING"), ("MIXED", "NO_PRIMARY_KEY_HINT"), ("WIDE", "MISSING_CREATED_AT"),
        ("WIDE", "MISSING_UPDATED_AT"), ("WIDE", "NO_PRIMARY_KEY_HINT"), ("WIDE", "TOO_MANY_COLUMNS"),
    ]


def test_own_key_is_no_foreign_key(spark):
    df = meta(spark, "ORDERSS", ("ORDER_ID", "int", "NO"), ("CUSTOMER_ID", "int", "NO"), ("ROW_ID", "int", "NO"), ("VALUE", "int", "NO"))
    assert codes(conventions.check_conventions(df, ["FK_COLUMN_NO_CONSTRAINT", "GENERIC_COLUMN_NAME"])) == [
        ("CUSTOMER_ID", "FK_COLUMN_NO_CONSTRAINT"), ("VALUE", "GENERIC_COLUMN_NAME"),
    ]


def test_gate(spark):
    df = meta(spark, "T", ("ID", "int", "NO"), ("EMAIL", "string", "NO"), ("IS_X", "string", "NO"))
    findings, summary = conventions.schema_gate(df)
    assert [r["rule_code"] for r in findings.collect()] == ["PII_COLUMN_NO_MASKING", "BOOLEAN_STORED_AS_VARCHAR"]
    assert tuple(summary.first()) == (13, 2, 1, False)


@pytest.mark.parametrize(
    ("table", "inside", "outside"),
    [
        ("ORDERS", {"ORDERS_ID", "ORDER_ID", "ORDER_KEY", "ROW_ID"}, {"O_ID"}),
        ("CATEGORIES", {"CATEGORIES_ID"}, {"CATEGORIE_ID"}),
        ("STATUS", {"STATUS_KEY"}, {"STATU_ID"}),
        ("PRODUCT_CATEGORIES", {"PC_ID", "PRODUCT_CATEGORIES_ID"}, {"PRODUCT_CATEGORIE_ID"}),
        ("AS", {"AS_ID"}, {"A_ID"}),
    ],
)
def test_own_key_names(spark, table, inside, outside):
    names = set(spark.range(1).select(own_key_names(F.lit(table))).first()[0])
    assert inside <= names and not outside & names


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [("bigint", "decimal(38,0)", True), ("string", "bigint", False), ("date", "timestamp_ntz", True), ("variant", "int", True), (None, "int", True)],
)
def test_types_joinable(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(types_joinable(F.col("a"), F.col("b"))).first()[0] is expected


def changes(spark, old, new):
    prior, live = (drift.column_snapshot(meta(spark, "T", *rows)) for rows in (old, new))
    return sorted((r["column"], r["change"]) for r in drift.schema_drift(prior, live).collect())


def test_drift_kinds(spark):
    old = [("A", "NUMBER(38,0)", "NO"), ("B", "NUMBER", "YES"), ("C", "string", "1"), ("d", "int", None)]
    new = [("a", "NUMBER", "false"), ("B", "VARCHAR", "Y"), ("E", "int", "NO"), ("D", "int", "YES")]
    assert changes(spark, old, new) == [("B", "column_type_changed"), ("C", "column_removed"), ("E", "column_added")]
    assert changes(spark, [("A", "int", "NO")], [("A", "int", "YES")]) == [("A", "column_nullability_changed")]


def test_first_scan_is_silent_and_lost_table_is_reported(spark):
    t1, t2 = (drift.column_snapshot(meta(spark, t, ("A", "int", "NO"))) for t in ("T1", "T2"))
    found = drift.schema_drift(t1, t2).collect()
    assert [(r["table"], r["change"], r["severity"]) for r in found] == [("T1", "table_removed", "critical")]


def test_columns_meta_and_session_catalog(spark):
    df = spark.createDataFrame([(1, "x")], "id int NOT NULL, name string")
    found = {r["column"]: r for r in columns_meta(spark, {"t": df}, {"t": ["id"]}).collect()}
    assert (found["id"]["is_nullable"], found["id"]["is_primary_key"], found["name"]["ordinal"]) == ("NO", True, 2)
    df.createOrReplaceTempView("seen_table")
    names = {(r["object_kind"], r["table"]) for r in catalog.session_catalog(spark).collect()}
    assert ("schema", None) in names and ("table", "seen_table") in names
    with pytest.raises(ValueError):
        read_jdbc(spark, "jdbc:none", "t", partition_column="id")


def test_scope(spark):
    known = spark.createDataFrame([("d", "s", "t1"), ("d", "s", "t2"), ("d", "r", "t3"), ("e", "s", "t4"), ("d", "s", None)], "database string, schema string, table string")
    count = lambda *a: catalog.expand_scope(known, *a).count()
    assert (count("database", "d"), count("schema", "d", "s"), count("table", "d", "s", "t1")) == (3, 2, 1)
    for bad in (("table", "d"), ("schema", "d"), ("galaxy", "d")):
        with pytest.raises(ValueError):
            catalog.expand_scope(known, *bad)


def test_upsert(spark, rows):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, o string")
    new = spark.createDataFrame([("b", None, True), ("c", 3, False)], "k string, n int, p boolean")
    assert rows(state.upsert(old, new, "k")) == [("a", 1, "x", None), ("b", 2, "y", True), ("c", 3, None, False)]
    assert ("b", None, "y", True) in rows(state.upsert(old, new, "k", keep_when_null=False))


def test_listing(spark):
    df = spark.createDataFrame(
        [(i, "open" if i % 2 else "superseded", f"s{i}", f"s{i + 1}") for i in range(10)], "id int, status string, scan_id string, last_scan_id string"
    )
    page, total = state.listing(df, order_by=[F.col("id").desc()], limit=2, offset=1)
    assert [r["id"] for r in page.collect()] == [7, 5] and total.first()[0] == 5
    assert state.listing(df, {"status": "superseded"})[1].first()[0] == 5
    assert state.listing(df, include_superseded=True, scan_id="s4")[1].first()[0] == 2


def test_log_appends_and_scope_replaces(spark, tmp_path):
    day = lambda d, n: spark.sql(f"SELECT TIMESTAMP_NTZ'{d}' AS at, {n} AS n")
    log = str(tmp_path / "log")
    state.append_log(day("2024-01-01", 1), log, "at")
    state.append_log(day("2024-01-01", 2).withColumn("extra", F.lit("x")), log, "at")
    assert sorted((r["n"], r["extra"]) for r in state.read_log(spark, log).collect()) == [(1, None), (2, "x")]
    scopes = str(tmp_path / "scopes")
    state.replace_scope(spark.sql("SELECT * FROM VALUES ('a', 1), ('b', 1) AS t(s, n)"), scopes, ["s"])
    state.replace_scope(spark.sql("SELECT 'a' AS s, 2 AS n"), scopes, ["s"])
    assert sorted((r["s"], r["n"]) for r in spark.read.parquet(scopes).collect()) == [("a", 2), ("b", 1)]


def test_a_scope_can_become_empty(spark, tmp_path):
    path = str(tmp_path / "versions")
    edges = spark.sql("SELECT * FROM VALUES ('a', 'b'), ('b', 'c'), ('c', 'd') AS t(s, t)")
    state.replace_where(edges, path, F.lit(False))
    state.replace_where(edges.where("false"), path, (F.col("s") == "b") | (F.col("t") == "b"))
    assert [tuple(r) for r in state.read_version(spark, path).collect()] == [("c", "d")]
    state.replace_where(edges.where("false"), path, F.lit(True))
    assert state.read_version(spark, path).count() == 0
    state.replace_where(edges, path, F.lit(True))
    assert state.read_version(spark, path).count() == 3
