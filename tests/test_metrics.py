import random
import statistics

import pytest
from pyspark.sql import functions as F

from plumbline.operators import metrics


def series(spark, values, asset="a", column=None, metric="row_count"):
    rows = [(asset, column, metric, v, None, f"2024-01-{i + 1:02d} 00:00:00") for i, v in enumerate(values)]
    df = spark.createDataFrame(
        rows, "asset_id string, column_name string, metric_name string, metric_value double, observed_values array<string>, captured_at string"
    )
    return df.withColumn("captured_at", F.col("captured_at").cast("timestamp_ntz"))


def verdict(spark, values, as_of="2024-01-31"):
    snaps = series(spark, values)
    return metrics.metric_anomaly(snaps, metrics.baselines(snaps, as_of)).first()


def test_stable_then_spike_then_back(spark):
    stable = [1000.0] * 14
    first = verdict(spark, stable)
    assert (first["median"], first["mad"], first["fail_count"]) == (1000.0, 0.0, 0)
    spike = verdict(spark, stable + [5000.0])
    assert (spike["mad"], spike["fail_count"]) == (0.0, 1)
    assert verdict(spark, stable + [5000.0, 1000.0])["fail_count"] == 0


def test_ready_needs_fourteen(spark):
    assert metrics.ready(metrics.baselines(series(spark, [1.0] * 13), "2024-01-31")).count() == 0
    assert metrics.ready(metrics.baselines(series(spark, [1.0] * 14), "2024-01-31")).count() == 1


def test_exactly_three_deviations_do_not_fire(spark):
    snaps = series(spark, [10.0, 13.0])
    base = metrics.baselines(series(spark, [9.0, 10.0, 11.0]), "2024-01-31")
    assert (base.first()["median"], base.first()["mad"]) == (10.0, 1.0)
    assert metrics.metric_anomaly(snaps, base).first()["fail_count"] == 0
    assert metrics.metric_anomaly(series(spark, [10.0, 13.001]), base).first()["fail_count"] == 1


def test_missing_latest_or_mad_does_not_fire(spark):
    base = metrics.baselines(series(spark, [1.0, 2.0]), "2024-01-31")
    assert metrics.metric_anomaly(series(spark, [9.0], asset="other"), base).first()["fail_count"] == 0
    no_mad = base.withColumn("mad", F.lit(None).cast("double"))
    assert metrics.metric_anomaly(series(spark, [99.0]), no_mad).first()["fail_count"] == 0


@pytest.mark.parametrize(
    ("values", "expected"),
    [([5.0], 0), ([0.0, 0.0], 0), ([0.0, 1.0], 1), ([100.0, 125.0], 0), ([100.0, 126.0], 1), ([-100.0, -50.0], 1), ([None, 5.0], 0)],
)
def test_relative_change(spark, values, expected):
    assert metrics.metric_relative_change(series(spark, values)).first()["fail_count"] == expected


def test_category_disappeared(spark):
    rows = [
        ("a", "c", "observed_categories", 2.0, ["x", "y"], "2024-01-01"),
        ("a", "c", "observed_categories", 2.0, ["x", "z"], "2024-01-02"),
        ("b", "c", "observed_categories", 1.0, ["q"], "2024-01-02"),
    ]
    snaps = spark.createDataFrame(
        rows, "asset_id string, column_name string, metric_name string, metric_value double, observed_values array<string>, captured_at string"
    ).withColumn("captured_at", F.col("captured_at").cast("timestamp_ntz"))
    base = metrics.baselines(snaps, "2024-01-31")
    assert {r["asset_id"]: r["observed_set"] for r in base.collect()} == {"a": ["x", "y", "z"], "b": ["q"]}
    found = {r["asset_id"]: (r["missing_values"], r["fail_count"]) for r in metrics.category_disappeared(snaps, base).collect()}
    assert found == {"a": (["y"], 1), "b": ([], 0)}


def test_sample_count_includes_rows_without_value_and_old_rows_fall_out(spark):
    base = metrics.baselines(series(spark, [1.0, None, 3.0, float("nan")]), "2024-02-01").first()
    # the window opens at 2024-01-02, so the first value is gone
    assert (base["sample_count"], base["median"]) == (3, 3.0)


def test_leave_out_latest(spark):
    base = metrics.baselines(series(spark, [1.0, 1.0, 9.0]), "2024-01-31", leave_out_latest=True).first()
    assert (base["median"], base["sample_count"]) == (1.0, 2)


def test_exact_medians_of_skewed_groups(spark):
    """One group holds most rows; values repeat, are heavy-tailed or all equal."""
    rng = random.Random(7)
    groups = {
        None: [rng.choice([0.0, 1.0, 5.0]) for _ in range(4000)],
        "heavy": [rng.paretovariate(0.3) for _ in range(1501)],
        "even": [float(i) for i in range(1000)],
        "equal": [2.5] * 300,
        "one": [7.0],
        "two": [1.0, 4.0],
    }
    data = [(g, v) for g, values in groups.items() for v in values]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    found = {r["g"]: r["median"] for r in metrics.exact_medians(df, ["g"], "v").collect()}
    assert found == {g: statistics.median(v) for g, v in groups.items()}


def test_null_column_is_its_own_key(spark):
    both = series(spark, [1.0, 2.0, 3.0]).unionByName(series(spark, [10.0, 20.0, 30.0], column="row_count"))
    base = metrics.baselines(both, "2024-01-31")
    assert sorted((r["column_name"] or "", r["median"]) for r in base.collect()) == [("", 2.0), ("row_count", 20.0)]


def test_enrolment_is_idempotent(spark):
    snaps = series(spark, [5.0], column="c", metric="distinct_count").unionByName(
        series(spark, [1.0], column="d", metric="distinct_count")
    )
    none = spark.createDataFrame([], "asset_id string, column_name string, metric_name string, enrollment_source string")
    first = metrics.enroll_column_metrics(snaps, none)
    assert [r["column_name"] for r in first.collect()] == ["c"]
    assert metrics.enroll_column_metrics(snaps, first).count() == 0
    tables = metrics.enroll_table_metrics(snaps.select("asset_id").distinct(), none)
    assert tables.count() == 2 and metrics.enroll_table_metrics(snaps.select("asset_id").distinct(), tables).count() == 0


@pytest.mark.parametrize(
    ("metric", "value", "expected"),
    [("null_pct", 0.4, False), ("null_pct", 0.5, True), ("null_pct", 99.6, False), ("distinct_count", 1.0, False),
     ("duplicate_pct", 99.0, True), ("duplicate_pct", 99.1, False), ("mean", 0.0, True), ("unknown", 5.0, False)],
)
def test_worth_tracking(spark, metric, value, expected):
    df = spark.createDataFrame([(metric, value)], "m string, v double")
    assert df.select(metrics.worth_tracking(F.col("m"), F.col("v"))).first()[0] is expected


def test_finite(spark):
    df = spark.sql("SELECT explode(array(1.0D, DOUBLE('NaN'), DOUBLE('Infinity'), DOUBLE('-Infinity'), NULL)) AS v")
    assert [r[0] for r in df.select(metrics.is_finite(F.col("v"))).collect()] == [True, False, False, False, False]


def test_breaches_need_maturity_and_spread(spark):
    grown = series(spark, [10.0, 12.0] * 7 + [40.0])
    constant = series(spark, [5.0] * 15, asset="flat")
    young = series(spark, [1.0, 2.0, 90.0], asset="young")
    snaps = grown.unionByName(constant).unionByName(young)
    found = metrics.fleet_breaches(snaps, metrics.baselines(snaps, "2024-01-31")).collect()
    assert [(r["asset_id"], r["severity"]) for r in found] == [("a", "breached")]
    with pytest.raises(ValueError):
        metrics.fleet_breaches(snaps, metrics.baselines(snaps, "2024-01-31"), min_deviations=0)


def test_proposals_are_ranked_by_priority(spark):
    base = spark.createDataFrame(
        [("a", f"c{i:02d}", "null_pct", 20) for i in range(25)] + [("a", None, "row_count", 20), ("a", "c99", "observed_categories", 20), ("a", "c98", "null_pct", 3)],
        "asset_id string, column_name string, metric_name string, sample_count int",
    )
    keys = "asset_id string, column_name string, metric_name string, shape string"
    none = spark.createDataFrame([], keys)
    rejected = spark.createDataFrame([("a", "c00", "null_pct", "metric_anomaly", "rejected")], keys + ", status string")
    found = metrics.anomaly_proposals(base, none, rejected).orderBy("rank").collect()
    # all but the one that is not ready and the one rejected before
    assert [r["rank"] for r in found] == list(range(1, 27))
    assert [r["metric_name"] for r in found[:3]] == ["row_count", "observed_categories", "null_pct"]
    assert "c00" not in {r["column_name"] for r in found}


def test_threshold_limits(spark):
    instances = spark.createDataFrame([("i", 3.0, 25.0), ("j", 3.0, 25.0)], "instance_id string, deviations double, max_pct_change double")
    changed = {r["instance_id"]: r["deviations"] for r in metrics.update_thresholds(instances, deviations=10, instance_ids=["i"]).collect()}
    assert changed == {"i": 10.0, "j": 3.0}
    for bad in ({"deviations": 0}, {"deviations": 11}, {"max_pct_change": 1001}, {}):
        with pytest.raises(ValueError):
            metrics.update_thresholds(instances, instance_ids=["i"], **bad)


def test_metric_rules_need_series(spark):
    import pytest

    from plumbline.operators import checks
    from plumbline.operators.checks import build_check

    with pytest.raises(ValueError):
        build_check("metric_anomaly", "t", {})
    rows = spark.range(3)
    results = checks.scan({"t": rows}, [build_check("metric_anomaly", "t", {"metric_name": "row_count"}, rule="m"), build_check("not_null", "t", {"column": "id"}, rule="n")])
    assert {r["rule"]: r["status"] for r in results.collect()} == {"m": "error", "n": "passed"}
