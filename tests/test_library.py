"""Similarity, fingerprints, maintenance and health."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from plumbline import policy
from plumbline.functions.text import canonical_json, canonical_map_json, fingerprint, significant_words, word_overlap
from plumbline.operators import health, library, maintenance, similarity


def test_significant_words(spark):
    df = spark.createDataFrame([("The e-Mail of a USER_1 is naïve, naïve! 42 123",), ("",), (None,)], "t string")
    found = [sorted(r[0]) for r in df.select(significant_words(F.col("t"))).collect()]
    assert found == [["123", "mail", "naïve", "user_1"], [], []]


def test_word_overlap(spark):
    df = spark.createDataFrame([("amounts are positive", "positive amounts in orders"), ("is the", "any"), ("alpha beta", "beta gamma delta")], "a string, b string")
    assert [r[0] for r in df.select(word_overlap(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.5]


def best(candidate, entries, threshold):
    """Compare with every entry, as a check on small data."""
    def words(name, text):
        return {w for w in f"{name or ''} {text or ''}".lower().split() if len(w) > 2 and w not in policy.STOP_WORDS}

    name = (candidate[1] or "").strip().lower()
    same = [e[0] for e in entries if name and (e[1] or "").strip().lower() == name]
    if same:
        return min(same), None
    mine = words(*candidate[1:])
    scored = [(-len(mine & other) / min(len(mine), len(other)), e[0]) for e in entries if mine and (other := words(*e[1:]))]
    score, match = min(scored, default=(0.0, None))
    return (match, -score) if -score >= threshold else None


def test_best_matches_equal_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i:03d}" for i in range(60)]
    # the first words are in most texts, so a third of all rows share them
    text = lambda n: " ".join(rng.choices(vocabulary, weights=[60 / (i + 1) for i in range(60)], k=n))
    entries = [(i, rng.choice([None, f"name {i % 9}"]), text(rng.randint(1, 14))) for i in range(80)]
    new = [(1000 + i, rng.choice([None, "", f" NAME {i % 30} "]), text(rng.randint(0, 20))) for i in range(150)]
    new += [(2000 + i, None, entries[5][2]) for i in range(50)]
    schema = "id bigint, name string, description string"
    for threshold in (policy.SIMILARITY_THRESHOLD, policy.SYNTHESIS_SIMILARITY_THRESHOLD):
        found = similarity.best_matches(spark.createDataFrame(new, schema), spark.createDataFrame(entries, schema), threshold)
        got = {r["id"]: (r["match_id"], r["score"]) for r in found.collect()}
        expected = {c[0]: b for c in new if (b := best(c, entries, threshold))}
        assert got == expected


def test_fingerprint_matches_plain_python(spark):
    parts = ["def", "column", "db", "", "t"]
    target = spark.range(1).select(canonical_json(F.struct(F.lit("x").alias("column"), F.lit(None).cast("string").alias("ref"))).alias("j"))
    assert target.first()[0] == '{"column":"x"}'
    text = "|".join([*parts, json.dumps({"column": "x"}, separators=(",", ":")), "{}"])
    got = spark.range(1).select(
        fingerprint(F.lit("def"), F.lit("column"), F.lit("db"), F.lit(None), F.lit("t"), F.lit('{"column":"x"}'), F.lit("{}"))
    ).first()[0]
    assert got == hashlib.sha256(text.encode()).hexdigest()
    df = spark.sql("SELECT map('b', 1, 'a', 2) AS m UNION ALL SELECT NULL")
    assert [r[0] for r in df.select(canonical_map_json(F.col("m"))).collect()] == ['{"a":2,"b":1}', "{}"]


def test_suppression(spark):
    existing = spark.createDataFrame(
        [("f1", "i1", "active", None), ("f2", "i2", "pending", None), ("f3", "i3", "rejected", "nulls expected during backfill")],
        "fingerprint string, instance_id string, status string, rejection_reason string",
    )
    new = spark.createDataFrame(
        [("f1", "x"), ("f2", "x"), ("f3", "nulls during backfill"), ("f3", "sudden duplicates"), ("f3", None), ("f9", "x")],
        "fingerprint string, evidence string",
    )
    found = similarity.suppress_known(new, existing)
    assert sorted((r["fingerprint"], r["evidence"] or "", r["reason"] or "") for r in found.collect()) == [
        ("f1", "x", "already_active"), ("f2", "x", "already_pending"), ("f3", "", "previously_rejected"),
        ("f3", "nulls during backfill", "previously_rejected"), ("f3", "sudden duplicates", ""), ("f9", "x", ""),
    ]


def runs(spark, rows):
    return spark.createDataFrame(rows, "instance_id string, status string, at string").select(
        "instance_id", "status", F.col("at").cast("timestamp_ntz").alias("executed_at")
    )


def test_retire_flapping_obsolete_superseded(spark):
    log = runs(spark, [("quiet", "passed", f"2024-03-{d:02d}") for d in range(1, 5)] + [("quiet", "failed", "2023-01-01")]
               + [("bad", "passed", "2024-03-01"), ("bad", "failed", "2024-03-02"), ("bad", "passed", "2024-03-03")]
               + [("rare", "passed", "2024-03-01")] + [("was", "passed", f"2024-03-{d:02d}") for d in range(1, 5)]
               + [("flap", "passed", f"2024-03-{d:02d}") for d in range(1, 5)])
    findings = spark.createDataFrame([("was", "resolved", 1), ("flap", "open", 4), ("flap", "resolved", 1), ("bad", "superseded", 9)],
                                     "instance_id string, status string, reopened_count int")
    assert [r[0] for r in maintenance.retire_candidates(log, findings, "2024-03-10").collect()] == ["quiet"]
    assert [tuple(r) for r in maintenance.flapping(findings).collect()] == [("flap", 4)]
    rows = [(i, "d", "db.s.gone" if i == "rare" else "db.s.t", "{}" if i in ("bad", "was") else i, "active", f"2024-01-0{n + 1}")
            for n, i in enumerate(["quiet", "bad", "rare", "was", "flap"])]
    instances = spark.createDataFrame(rows, "instance_id string, definition_id string, fqn string, target_json string, status string, c string")
    instances = instances.withColumn("created_at", F.col("c").cast("timestamp_ntz"))
    assets = spark.createDataFrame([("DB.S.T",)], "fqn string")
    none = spark.createDataFrame([("quiet", "retire_candidate", "approved")], "instance_id string, action string, status string")
    sweep = lambda p: sorted((r[0], r[1]) for r in maintenance.maintenance_sweep(instances, log, findings, assets, p, "2024-03-10").collect())
    assert sweep(none) == [("bad", "superseded"), ("flap", "flapping"), ("quiet", "retire_candidate"), ("rare", "obsolete_target")]
    dismissed = spark.createDataFrame([("flap", "flapping", "dismissed"), ("rare", "obsolete_target", "pending")], "instance_id string, action string, status string")
    assert sweep(dismissed) == [("bad", "superseded"), ("quiet", "retire_candidate")]


def test_decisions_and_unenrolment(spark):
    instances = spark.createDataFrame([(i, "active", True) for i in "abc"], "instance_id string, status string, is_active boolean")
    approved = spark.createDataFrame([("a", "flapping"), ("b", "superseded"), ("b", "retire_candidate")], "instance_id string, action string")
    assert sorted(map(tuple, maintenance.apply_decisions(instances, approved).collect())) == [("a", "paused", False), ("b", "retired", False), ("c", "active", True)]
    keys = "asset_id string, column_name string, metric_name string"
    monitored = spark.createDataFrame(
        [("t", None, "row_count", "auto_table"), ("t", "c", "mean", "user"), ("t", "c", "null_pct", "auto_column"), ("t", None, "x", "auto_column")],
        keys + ", enrollment_source string",
    )
    dropped = monitored.select("asset_id", "column_name", "metric_name")
    assert sorted(r["metric_name"] for r in maintenance.unenroll(monitored, dropped).collect()) == ["mean", "row_count"]


def test_pack_rules(spark):
    patterns = spark.createDataFrame(
        [("p", "1", "d", "column", "age", None, "o"), ("p", "2", "d", "multi_column", None, ["AGE", "zip", "city"], "o"),
         ("p", "3", "gone", "table", None, None, "o"), ("p", "4", "d", "anomaly", "nope", None, "o"), ("p", "5", "d", "cross_table", "nope", None, "o")],
        "pack_id string, pattern_id string, definition_id string, scope string, column string, columns array<string>, asset_id string",
    )
    targets = spark.createDataFrame([("p", "T", "new")], "pack_id string, table string, asset_id string")
    meta = spark.createDataFrame([("T", "AGE")], "table string, column string")
    known = spark.createDataFrame([("d",)], "definition_id string")
    found = maintenance.instantiate_pack(patterns, targets, meta, known)
    assert sorted((r["pattern_id"], r["asset_id"], r["skip_reason"]) for r in found.collect()) == [
        ("1", "o", None), ("2", "o", "column zip not found"), ("3", "o", "definition not found"), ("4", "new", None), ("5", "o", "column nope not found"),
    ]


def test_health_score_and_dots(spark):
    log = runs(spark, [("crit", "passed", "2024-01-01"), ("crit", "failed", "2024-01-02"), ("low", "passed", "2024-01-01")]
               + [("long", "failed" if d < 5 else "passed", f"2024-02-{d:02d}") for d in range(1, 26)])
    instances = spark.createDataFrame(
        [("crit", "critical", True), ("low", "low", True), ("long", "weird", True), ("never", "high", True), ("off", "high", False)],
        "instance_id string, severity string, is_active boolean",
    ).select("*", *[F.lit(c).alias(c) for c in health.TABLE])
    # the last 20 of 25 runs all passed; an unknown severity weighs 2
    assert health.health_scores(log, instances).first()["health_score"] == (5 * 0.5 + 1 + 2) / 8
    rules = spark.createDataFrame([(["a", "b"], "passed"), (["b"], "failed"), (["c"], None), (["d"], "running")], "columns array<string>, latest_status string")
    rules = rules.select("*", *[F.lit(c).alias(c) for c in health.TABLE])
    assert {r["column"]: r["status"] for r in health.column_status(rules).collect()} == {"a": "green", "b": "red", "c": "gray", "d": "amber"}


def test_preferred_definition(spark):
    definitions = spark.createDataFrame(
        [("d1", "s", "approved", "2024-01-02"), ("d2", "s", "approved", "2024-01-01"), ("d3", "s", "disabled", "2023-01-01")],
        "definition_id string, shape string, status string, created_at string",
    )
    pick = lambda ids: library.preferred_definition(definitions, spark.createDataFrame([(i, "active") for i in ids], "definition_id string, status string")).first()["definition_id"]
    assert pick(["d3", "d3"]) == "d2"
    assert pick(["d1"]) == "d1"


def test_relevance_counts_all_shared_words(spark):
    names = [f"word{i}" for i in range(8)]
    rows = [("many", " ".join(names), None, 0, 0), ("five", " ".join(names[:5]), None, 1, 1), ("none", "other", None, 3, 0)]
    definitions = spark.createDataFrame(rows, "definition_id string, name string, description string, approvals int, rejections int")
    found = maintenance.relevant_definitions(definitions, ["_".join(names)])
    assert [tuple(r) for r in found.collect()] == [("many", 16.0), ("five", 10.5), ("none", 1.0)]


def test_similar_tables(spark):
    rows = [
        ("A.B.ORDERS", "fact", 0, "t"), ("A.B.ORDER_ITEMS", "fact", 9, "t"), ("A.C.PURCHASE_ORDERS", "x", 1, "t"), ("A.B.PAYMENTS", "fact", 1, "t"),
         ("A.B.REFUNDS", "fact", 0, "t"), ("A.Z.ORDERS", "fact", 0, None), ("X.Y.ORDERS", "fact", 0, "t"),
    ]
    logs = spark.createDataFrame(rows, "table_fqn string, table_type string, approved_count int, thinking string").withColumn("created_at", F.lit("2024-01-01"))
    found = maintenance.similar_tables(logs, "X.Y.ORDERS")
    assert [(r["table_fqn"], r["tier"]) for r in found.collect()] == [
        ("A.B.ORDERS", 3), ("A.C.PURCHASE_ORDERS", 2), ("A.B.ORDER_ITEMS", 1), ("A.B.PAYMENTS", 1),
    ]


def test_a_failure_behind_many_runs_still_counts(spark):
    """Run 201, counted from the latest, failed within the quiet period."""
    log = spark.sql(
        "SELECT 'busy' AS instance_id, IF(id = 201, 'failed', 'passed') AS status, "
        "TIMESTAMP_NTZ '2024-03-09 00:00:00' - make_dt_interval(0, 0, 10 * id) AS executed_at FROM range(1, 400) "
        "UNION ALL SELECT 'calm', 'passed', TIMESTAMP_NTZ '2024-03-01 00:00:00' FROM range(5) "
        "UNION ALL SELECT 'calm', 'failed', TIMESTAMP_NTZ '2023-01-01 00:00:00'"
    )
    findings = spark.createDataFrame([], "instance_id string, status string, reopened_count int")
    kept = maintenance.retire_candidates(log, findings, "2024-03-10").collect()
    assert [(r["instance_id"], str(r["last_failure_at"])) for r in kept] == [("calm", "2023-01-01 00:00:00")]
