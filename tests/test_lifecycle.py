import random

import pytest
from pyspark.sql import functions as F

from plumbline import policy
from plumbline.operators import lifecycle


@pytest.fixture
def world(spark):
    """A scan against an empty or a prepared findings table."""

    class World:
        def __init__(self):
            self.findings = spark.createDataFrame([], lifecycle.FINDINGS)
            self.mutes = spark.createDataFrame([], "instance_id string, asset_id string, muted_until timestamp_ntz")

        def mute(self, instance, asset, until):
            row = spark.createDataFrame([(instance, asset, until)], "instance_id string, asset_id string, u string")
            self.mutes = self.mutes.unionByName(row.select("instance_id", "asset_id", F.col("u").cast("timestamp_ntz").alias("muted_until")))

        def scan(self, number, at, failing, executed):
            results = spark.createDataFrame(
                [(i, a, "high", "t", f"{f} of {t} rows fail this check. Column X.", f, t) for i, a, f, t in failing],
                "instance_id string, asset_id string, severity string, title string, description string, fail_count bigint, total_count bigint",
            )
            ran = spark.createDataFrame([(i,) for i in executed], "instance_id string")
            after, events = lifecycle.finalize_scan(self.findings, results, ran, self.mutes, f"s{number}", at)
            happened = sorted((r["instance_id"], r["asset_id"], r["event"]) for r in events.collect())
            self.findings = spark.createDataFrame(after.collect(), lifecycle.FINDINGS)
            return happened

        def one(self):
            return self.findings.first()

    return World()


def test_create_update_resolve_reopen(world):
    assert world.scan(1, "2024-01-01", [("i", "a", 3, 10)], ["i"]) == [("i", "a", "created")]
    assert world.one()["status"] == "open" and len(world.one()["fail_history"]) == 1
    assert world.scan(2, "2024-01-02", [("i", "a", 5, 12)], ["i"]) == [("i", "a", "updated")]
    row = world.one()
    assert (row["current_fail_count"], row["first_detected_at"].day, row["last_seen_at"].day) == (5, 1, 2)
    assert row["description"] == "5 of 12 rows fail this check. Column X."
    assert world.scan(3, "2024-01-03", [], ["i"]) == [("i", "a", "resolved")]
    assert (world.one()["status"], world.one()["resolution_notes"]) == ("resolved", policy.RESCAN_NOTE)
    assert world.scan(4, "2024-01-10", [("i", "a", 1, 9)], ["i"]) == [("i", "a", "reopened")]
    row = world.one()
    assert (row["status"], row["reopened_count"], row["resolved_at"], row["resolution_notes"]) == ("reopened", 1, None, None)
    assert row["fail_history"][-1]["event"] == "reopened" and row["first_detected_at"].day == 1


def test_late_failure_creates_a_second_finding(world):
    world.scan(1, "2024-01-01", [("i", "a", 3, 10)], ["i"])
    world.scan(2, "2024-01-02", [], ["i"])
    assert world.scan(3, "2024-01-10", [("i", "a", 1, 9)], ["i"]) == [("i", "a", "created")]
    assert world.findings.count() == 2


def test_same_scan_twice_changes_nothing(world):
    world.scan(1, "2024-01-01", [("i", "a", 3, 10), ("j", "a", 1, 1)], ["i", "j"])
    world.scan(2, "2024-01-02", [("i", "a", 4, 10)], ["i", "j"])
    before = sorted(map(str, world.findings.collect()))
    assert world.scan(2, "2024-01-02", [("i", "a", 4, 10)], ["i", "j"]) == []
    assert sorted(map(str, world.findings.collect())) == before


def test_mutes(world):
    world.mute("i", "a", "2024-01-05")
    assert world.scan(1, "2024-01-01", [("i", "a", 3, 10)], ["i"]) == [("i", "a", "muted")]
    assert world.findings.count() == 0
    assert world.scan(2, "2024-01-06", [("i", "a", 3, 10)], ["i"]) == [("i", "a", "created")]
    world.mute("i", "a", "2024-02-01")
    assert world.scan(3, "2024-01-07", [], ["i"]) == [("i", "a", "resolved")]


def test_an_instance_keeps_a_finding_per_asset(world):
    assert len(world.scan(1, "2024-01-01", [("i", "a", 1, 1), ("i", "b", 2, 2)], ["i"])) == 2
    # it still fails on a, so the finding on b stays open
    assert world.scan(2, "2024-01-02", [("i", "a", 1, 1)], ["i"]) == [("i", "a", "updated")]
    assert world.scan(3, "2024-01-03", [], ["i"]) == [("i", "a", "resolved"), ("i", "b", "resolved")]


def test_what_did_not_run_stays_open(world):
    world.scan(1, "2024-01-01", [("i", "a", 1, 1)], ["i"])
    assert world.scan(2, "2024-01-02", [], ["other"]) == []


def test_all_branches_at_once(world):
    world.scan(1, "2024-01-01", [("upd", "a", 1, 1), ("res", "a", 1, 1), ("reo", "a", 1, 1)], ["upd", "res", "reo"])
    world.scan(2, "2024-01-02", [("upd", "a", 1, 1), ("res", "a", 1, 1)], ["upd", "res", "reo"])
    assert world.scan(3, "2024-01-03", [("upd", "a", 1, 1), ("reo", "a", 1, 1), ("new", "a", 1, 1)], ["upd", "res", "reo", "new"]) == [
        ("new", "a", "created"), ("reo", "a", "reopened"), ("res", "a", "resolved"), ("upd", "a", "updated"),
    ]


def test_history_ring(spark):
    entry = F.struct(
        F.lit("new").alias("scan_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("at"), F.lit(1).cast("bigint").alias("fail_count"),
        F.lit(1).cast("bigint").alias("total_count"), F.lit(None).cast("string").alias("event"),
    )
    for have, expected in ((0, 1), (2, 3), (49, 50), (50, 50)):
        old = F.expr(
            f"transform(sequence(1, {have}), i -> named_struct('scan_id', string(i), 'at', timestamp_ntz'2024-01-01', "
            "'fail_count', 1L, 'total_count', 1L, 'event', string(null)))"
        ) if have else F.lit(None).cast(lifecycle.FINDINGS["fail_history"].dataType)
        history = spark.range(1).select(lifecycle.append_history(old, entry)).first()[0]
        assert len(history) == expected and history[-1]["scan_id"] == "new"


def state_machine(runs, days):
    """The lifecycle of one key, run by run."""
    out, is_open, resolved, number = [], False, None, 0
    for day, failed in runs:
        event = None
        if failed and is_open:
            event = "updated"
        elif failed:
            event = "reopened" if resolved is not None and resolved >= day - days else "created"
            number += event == "created"
            is_open = True
        elif is_open:
            event, is_open, resolved = "resolved", False, day
        out.append((day, event, number or None))
    return out


@pytest.mark.parametrize("chunk", ["week", "month", "year"])
def test_replay_follows_the_state_machine(spark, chunk):
    rng = random.Random(3)
    runs = {}
    for key in range(12):
        days = sorted(rng.sample(range(400), rng.choice([1, 5, 60, 200])))
        runs[f"k{key}"] = [(d, rng.random() < rng.choice([0.2, 0.5, 0.8])) for d in days]
    rows = [(k, d, "failed" if f else "passed") for k, series in runs.items() for d, f in series] + [("k0", 399, "error")]
    log = spark.createDataFrame(rows, "instance_id string, d int, status string").select(
        "instance_id", F.lit("a").alias("asset_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).cast("timestamp_ntz").alias("executed_at"),
        "status", F.lit("low").alias("severity"), F.col("d").cast("bigint").alias("fail_count"), F.lit(9).cast("bigint").alias("total_count"),
    )
    found = lifecycle.replay(log, 7, chunk).select(
        "instance_id", F.date_diff(F.col("executed_at").cast("date"), F.lit("2024-01-01").cast("date")).alias("d"), "event", "incident_no"
    )
    got = sorted(((r[0], r[1], r[2], r[3]) for r in found.collect()), key=repr)
    expected = sorted(((k, *e) for k, series in runs.items() for e in state_machine(series, 7)), key=repr)
    assert got == expected


def test_verification_leaves_unchecked_findings(spark, world):
    world.scan(1, "2024-01-01", [("i", "a", 1, 1), ("j", "a", 1, 1), ("k", "a", 1, 1)], ["i", "j", "k"])
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "instance_id string")
    after = lifecycle.verification_rescan(world.findings, ids("j"), ids("i", "j"), "2024-01-02")
    assert {r["instance_id"]: r["status"] for r in after.collect()} == {"i": "resolved", "j": "open", "k": "open"}
