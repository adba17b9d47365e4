import pytest
from pyspark.sql import functions as F

from plumbline.operators import profiling
from plumbline.policy import ProfilePolicy


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        [
            (1, "on", None, 1.0, "a@b.co", "2024-01-01"),
            (2, "off", None, 1.0, "broken", "2024-01-03"),
            (3, "on", None, 2.0, " c@d.ef ", None),
            (3, "", None, None, None, None),
        ],
        "record_key int, switch string, nothing string, amount double, email string, seen string",
    ).withColumn("seen", F.col("seen").cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def profile(table):
    return {r["column"]: r for r in profiling.profile_columns(table, "t", "2024-01-10").collect()}


def test_counts_and_percentages(profile):
    assert (profile["switch"]["non_null"], profile["switch"]["distinct_count"], profile["switch"]["duplicate_values"]) == (4, 3, 1)
    assert profile["switch"]["repeated_rows"] == 2
    assert (profile["amount"]["null_count"], profile["amount"]["null_pct"], profile["amount"]["distinct_pct"]) == (1, 25.0, 66.67)


def test_all_null_column(profile):
    row = profile["nothing"]
    assert (row["null_pct"], row["distinct_count"], row["distinct_pct"], row["min_value"]) == (100.0, 0, None, None)


def test_empty_string_is_a_value(profile):
    assert profile["switch"]["null_count"] == 0 and profile["switch"]["min_value"] == ""


def test_pattern_share_trims_and_skips_nulls(profile):
    assert profile["email"]["category"] == "email"
    assert profile["email"]["pattern_match_pct"] == 66.7


def test_freshness_days(profile):
    assert profile["seen"]["freshness_days"] == 7.0


def test_single_row_has_no_deviation(spark):
    row = profiling.profile_columns(spark.createDataFrame([(5,)], "max_retries int"), "t").first()
    assert row["stddev"] is None and row["outlier_hint"] is False and row["duplicate_values"] == 0


def test_empty_table(spark):
    row = profiling.profile_columns(spark.createDataFrame([], "x int"), "t").first()
    assert (row["total"], row["null_pct"], row["distinct_count"], row["distinct_pct"]) == (0, 0.0, 0, None)


@pytest.mark.parametrize(
    ("name", "kind", "pct", "count", "expected"),
    [
        ("USER_EMAIL", "string", 1.0, 5, "email"),
        ("HOME_PHONE", "string", 1.0, 5, "phone"),
        ("CUSTOMER_ID", "bigint", 1.0, 5, "id"),
        ("ORDER_STATUS", "int", 1.0, 5, "status"),
        ("UPDATED", "timestamp_ntz", 1.0, 5, "date"),
        ("CODE", "string", 98.0, 5000, "id"),
        ("CODE", "string", 97.9, 5000, "text"),
        ("CODE", "string", 1.0, 30, "categorical"),
        ("CODE", "string", 1.0, 31, "text"),
        ("TOTAL_USD", "decimal(10,2)", 1.0, 3, "amount"),
        ("SCORE", "double", 1.0, 15, "categorical"),
        ("SCORE", "double", 99.0, 16, "measure"),
        ("TAGS", "array<string>", None, None, "text"),
    ],
)
def test_categories(spark, name, kind, pct, count, expected):
    df = spark.createDataFrame([(name, kind, pct, count)], "n string, t string, p double, c bigint")
    category = profiling.category_of(F.col("n"), F.col("t"), F.col("p"), F.col("c"), ProfilePolicy())
    assert df.select(category).first()[0] == expected


def test_grouped_profile_equals_single_profiles(spark):
    df = spark.range(60).select((F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("v"), F.lit("x").alias("s"))
    grouped = profiling.profile_columns(df, "t", keys=["g"])
    for g in range(3):
        single = profiling.profile_columns(df.where(F.col("g") == g).drop("g"), "t")
        pick = ["column", "total", "distinct_count", "avg_value", "max_length"]
        assert sorted(map(tuple, grouped.where(F.col("g") == g).select(*pick).collect())) == sorted(
            map(tuple, single.select(*pick).collect())
        )


def test_distinct_counts_tell_apart_what_text_would_not(spark):
    df = spark.sql("SELECT * FROM VALUES (0.0D, 'a'), (-0.0D, 'A'), (DOUBLE('NaN'), 'a '), (DOUBLE('NaN'), NULL) AS t(d, s)")
    found = {r["column"]: r["distinct_count"] for r in profiling.distinct_statistics(df).collect()}
    assert found == {"d": 2, "s": 3}


def test_extreme_values_break_ties_by_value(spark, rows):
    df = spark.createDataFrame([(v,) for v in "bbaaccd"], "c string")
    counted = profiling.value_frequencies(df, ["c"])
    assert rows(profiling.extreme_values(counted, 2), "value", "rank") == [("a", 1), ("b", 2)]
    assert rows(profiling.extreme_values(counted, 2, rarest=True), "value", "rank") == [("a", 2), ("d", 1)]


def test_closed_sets_and_grounding(spark, table, rows):
    sets = profiling.closed_sets(table, profiling.profile_columns(table, "t"))
    assert {r["column"]: r["values"] for r in sets.collect()}["switch"] == ["", "off", "on"]
    proposed = spark.createDataFrame([("switch", ["on", "dim"])], "column string, values array<string>")
    kept = profiling.grounded_values(proposed, sets).first()
    assert (kept["values"], kept["dropped"]) == (["on"], ["dim"])


def test_signals_and_keys(table, rows):
    profile = profiling.profile_columns(table, "t", "2024-02-10")
    assert rows(profiling.anomaly_signals(profile), "column", "signal") == [
        ("email", "format_mismatch"), ("nothing", "high_null_rate"), ("record_key", "duplicate_key"),
        ("seen", "high_null_rate"), ("seen", "stale_data"),
    ]
    key = profiling.key_candidates(profile).first()
    assert (key["column"], key["is_unique"], key["duplicate_rows"]) == ("record_key", False, 1)


def test_approximate_counts_are_close(spark):
    df = spark.range(20000).select((F.col("id") % 5000).alias("v"))
    estimate = profiling.distinct_statistics(df, approximate=True).first()["distinct_count"]
    assert abs(estimate - 5000) < 500


def test_outlier_looks_at_the_maximum_only(spark):
    high = spark.createDataFrame([(float(x),) for x in [1] * 50 + [1000]], "v double")
    low = spark.createDataFrame([(float(x),) for x in [1] * 50 + [-1000]], "v double")
    assert profiling.profile_columns(high, "t").first()["outlier_hint"] is True
    assert profiling.profile_columns(low, "t").first()["outlier_hint"] is False


def test_elapsed_time_ignores_clock_changes(spark):
    from pyspark.sql import functions as F

    from plumbline.functions.time import seconds_between

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        row = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-30 12:00:00' AS a, TIMESTAMP_NTZ '2024-03-31 12:00:00.5' AS b")
        assert row.select(seconds_between(F.col("a"), F.col("b"))).first()[0] == 86400.5
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_left_out_lists_have_a_reason(spark):
    from plumbline.operators import profiling

    rows = [("state", "status", 300), ("kind", "categorical", 4), ("note", "text", 60), ("word", "text", 12), ("price", "amount", 900), ("gone", "text", 0)]
    profile = spark.createDataFrame(rows, "column string, category string, distinct_count long")
    found = {(r["column"], r["list"]): r["reason"] for r in profiling.left_out(profile).collect()}
    assert found == {
        ("state", "tail_values"): "more than 200 distinct values", ("state", "closed_set"): "more than 50 distinct values",
        ("note", "top_values"): "more than 50 distinct values", ("note", "closed_set"): "more than 50 distinct values",
        ("price", "top_values"): "columns of category amount have none", ("price", "tail_values"): "more than 200 distinct values",
        ("price", "closed_set"): "more than 50 distinct values",
        ("gone", "top_values"): "no value", ("gone", "tail_values"): "no value", ("gone", "closed_set"): "no value",
    }
