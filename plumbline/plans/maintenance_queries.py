"""Text similarity, fingerprints and upkeep of the rule library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import policy
from plumbline.functions.text import canonical_json, fingerprint, significant_words, word_overlap
from plumbline.operators import lifecycle, maintenance, profiling, similarity
from plumbline.plans import derived
from plumbline.plans.derived import INSTANCES_CTE, PLACES_CTE, STATE_CTES
from plumbline.plans.metric_queries import USER_SNAPSHOTS, user_snapshots
from plumbline.plans.registry import query
from plumbline.session import stored
from plumbline.sources.tables import read_tables

_STOP = ", ".join(f"'{w}'" for w in policy.STOP_WORDS)


def _words(text: str) -> str:
    """SQL list of the significant words of a text."""
    return (
        f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_]+')), "
        f"lambda w: length(w) > 2 AND w NOT IN ({_STOP}))"
    )


def _overlap(a: str, b: str) -> str:
    return (
        f"CASE WHEN least(len({a}), len({b})) = 0 THEN 0.0 ELSE "
        f"len(list_intersect({a}, {b})) / CAST(least(len({a}), len({b})) AS DOUBLE) END"
    )


@query(
    "significant_words",
    f"""SELECT doc_id, len({_words("text")}) AS n_words, array_to_string(list_sort({_words("text")}), ' ') AS words FROM documents""",
)
def significant_words_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_tables(spark, sf_dir, ["documents"])["documents"]
    words = documents.select("doc_id", F.array_sort(significant_words(F.col("text"))).alias("w"))
    return words.select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.array_join("w", " ").alias("words"))


@query(
    "word_overlap_scores",
    f"""WITH p AS (SELECT a.conv_id, a.turn, {_words("a.text")} AS x, {_words("b.text")} AS y
                   FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)
        SELECT conv_id, turn, round({_overlap("x", "y")}, 6) AS score FROM p""",
)
def word_overlap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of each turn with the next one."""
    turns = read_tables(spark, sf_dir, ["conversations"])["conversations"]
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return turns.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(word_overlap(F.col("text"), F.col("next_text")), 6).alias("score")
    )


@query(
    "library_matches",
    f"""WITH c AS (SELECT doc_id AS id, source || ' ' || lang AS name, {_words("source || ' ' || lang || ' ' || text")} AS w FROM documents),
        l AS (SELECT item_id AS id, ' SRC' || item_id || ' fr' AS name, {_words("' SRC' || item_id || ' fr ' || text")} AS w FROM benchmark),
        n AS (SELECT c.id, min(l.id) AS name_id FROM c JOIN l ON lower(trim(c.name)) = lower(trim(l.name)) GROUP BY 1),
        ct AS (SELECT id, len(w) AS size, unnest(w) AS t FROM c WHERE id NOT IN (SELECT id FROM n)),
        lt AS (SELECT id, len(w) AS size, unnest(w) AS t FROM l),
        s AS (SELECT ct.id, lt.id AS match_id, count(*) / CAST(least(any_value(ct.size), any_value(lt.size)) AS DOUBLE) AS score
              FROM ct JOIN lt USING (t) GROUP BY 1, 2),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, match_id) AS rn FROM s
                             WHERE score >= 0.55) WHERE rn = 1)
        SELECT id, name_id AS match_id, CAST(NULL AS DOUBLE) AS score, 'name' AS matched_by FROM n
        UNION ALL SELECT id, match_id, round(score, 6), 'text' FROM b""",
)
def library_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as proposed texts, benchmark items as the library."""
    t = read_tables(spark, sf_dir, ["documents", "benchmark"])
    proposed = t["documents"].select(
        F.col("doc_id").alias("id"), F.concat_ws(" ", "source", "lang").alias("name"), F.col("text").alias("description")
    )
    known = t["benchmark"].select(
        F.col("item_id").alias("id"),
        F.concat(F.lit(" SRC"), F.col("item_id").cast("string"), F.lit(" fr")).alias("name"),
        F.col("text").alias("description"),
    )
    return similarity.best_matches(proposed, known).withColumn("score", F.round("score", 6))


def _fingerprinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instance per order: a range rule on the customer's orders of one priority."""
    orders = read_tables(spark, sf_dir, ["orders"])["orders"]
    target = F.struct(F.lit("total").alias("column"))
    limit = F.when(F.col("o_orderstatus") == "F", F.lit(100))
    threshold = F.struct(limit.alias("max_value"), F.lit(1).alias("min_value"))
    table = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    return orders.select(
        F.col("o_orderkey").alias("instance_id"),
        F.col("o_orderpriority").alias("definition_id"),
        F.concat_ws(".", F.lit("sales"), F.lit("orders"), table).alias("fqn"),
        canonical_json(target).alias("target_json"),
        canonical_json(threshold).alias("threshold_json"),
        fingerprint(
            F.col("o_orderpriority"), F.lit("column"), F.lit("sales"), F.lit("orders"), table,
            canonical_json(target), canonical_json(threshold),
        ).alias("fingerprint"),
        F.col("o_orderstatus"),
        F.col("o_totalprice"),
        F.col("o_orderdate").alias("created_at"),
    )


_FP = """f AS (SELECT o_orderkey AS instance_id, o_orderpriority AS definition_id, 'sales.orders.C' || o_custkey AS fqn,
       '{"column":"total"}' AS target_json,
       CASE WHEN o_orderstatus = 'F' THEN '{"max_value":100,"min_value":1}' ELSE '{"min_value":1}' END AS threshold_json,
       o_orderstatus, o_totalprice, o_orderdate AS created_at, o_custkey,
       sha256(o_orderpriority || '|column|sales|orders|C' || o_custkey || '|{"column":"total"}|' ||
              CASE WHEN o_orderstatus = 'F' THEN '{"max_value":100,"min_value":1}' ELSE '{"min_value":1}' END) AS fingerprint
     FROM orders)"""


@query("fingerprints", f"WITH {_FP} SELECT instance_id, target_json, threshold_json, fingerprint FROM f")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fingerprinted(spark, sf_dir).select("instance_id", "target_json", "threshold_json", "fingerprint")


_LONG_REASON = "totals of large customers vary every month"
_SHORT_EVIDENCE = "large totals vary by customers and month"


@query(
    "fingerprint_suppression",
    f"""WITH {_FP}, e AS (SELECT fingerprint, arg_max(instance_id, instance_id) AS existing_id, arg_max(CASE o_orderstatus WHEN 'F' THEN 'active'
              WHEN 'P' THEN 'pending' ELSE 'rejected' END, instance_id) AS status FROM f WHERE created_at < TIMESTAMP '1998-01-01' GROUP BY 1),
        c AS (SELECT instance_id, fingerprint, CASE WHEN o_totalprice > 250000 THEN '{_SHORT_EVIDENCE}' ELSE 'nulls appeared in region codes' END
                AS evidence FROM f WHERE created_at >= TIMESTAMP '1998-01-01'),
        j AS (SELECT c.*, e.existing_id, CASE WHEN status = 'active' THEN 'already_active' WHEN status = 'pending' THEN 'already_pending'
                WHEN status = 'rejected' AND NOT ({_overlap(_words("evidence"), _words(f"'{_LONG_REASON}'"))} < 0.3) THEN 'previously_rejected' END AS reason
              FROM c LEFT JOIN e USING (fingerprint))
        SELECT instance_id, existing_id, reason IS NOT NULL AS suppressed, reason FROM j""",
)
def fingerprint_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fingerprinted(spark, sf_dir)
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    status = F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "P", "pending").otherwise("rejected")
    existing = rows.where(F.col("created_at") < cut).select(
        "fingerprint", "instance_id", status.alias("status"), F.lit(_LONG_REASON).alias("rejection_reason")
    )
    evidence = F.when(F.col("o_totalprice") > 250000, _SHORT_EVIDENCE).otherwise("nulls appeared in region codes")
    new = rows.where(F.col("created_at") >= cut).select("instance_id", "fingerprint", evidence.alias("evidence"))
    return similarity.suppress_known(new, existing).select("instance_id", "existing_id", "suppressed", "reason")


@query(
    "collapsed_names",
    """SELECT min(p_partkey) AS id, arg_min(p_name, p_partkey) AS name, count(*) AS collapsed FROM part GROUP BY lower(trim(p_name))""",
)
def collapsed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read_tables(spark, sf_dir, ["part"])["part"]
    return similarity.collapse_same_names(parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query(
    "flapping_rules",
    f"""WITH {STATE_CTES} SELECT instance_id, max(reopened_count) AS max_reopened FROM findings GROUP BY 1 HAVING max(reopened_count) >= 4""",
)
def flapping_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.flapping(derived.findings(spark, sf_dir))


AS_OF = "2001-10-15 00:00:00"
_RETIRE = f"""
    quiet AS (SELECT instance_id, count(*) FILTER (WHERE executed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY) AS recent_runs,
                     count(*) FILTER (WHERE status = 'failed' AND executed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY) AS bad,
                     max(executed_at) FILTER (WHERE status = 'failed') AS last_failure_at FROM executions GROUP BY 1),
    retire AS (SELECT instance_id, recent_runs, last_failure_at FROM quiet WHERE bad = 0 AND recent_runs >= 3
               AND instance_id NOT IN (SELECT instance_id FROM findings WHERE reopened_count > 0))"""


@query("retire_candidates", f"WITH {STATE_CTES}, {_RETIRE} SELECT * FROM retire")
def retire_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.retire_candidates(derived.executions(spark, sf_dir), derived.findings(spark, sf_dir), AS_OF)


@query(
    "superseded_rules",
    f"""WITH {_FP}, a AS (SELECT *, upper(fqn) AS key FROM f WHERE o_orderstatus <> 'P'),
        r AS (SELECT *, row_number() OVER w AS rn, first_value(instance_id) OVER w AS newer FROM a
              WINDOW w AS (PARTITION BY definition_id, key, target_json ORDER BY created_at DESC, instance_id DESC))
        SELECT instance_id, newer AS newer_instance_id, definition_id, key AS fqn FROM r WHERE rn > 1""",
)
def superseded_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fingerprinted(spark, sf_dir).withColumn(
        "status", F.when(F.col("o_orderstatus") == "P", "paused").otherwise("active")
    )
    return maintenance.superseded(rows)


@query(
    "obsolete_targets",
    f"""WITH {INSTANCES_CTE} SELECT instance_id, fqn FROM instances
        WHERE fqn NOT IN (SELECT fqn FROM places WHERE balance > 0)""",
)
def obsolete_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = derived.places(spark, sf_dir).where(F.col("balance") > 0).select(F.lower("fqn").alias("fqn"))
    return maintenance.obsolete_targets(derived.instances(spark, sf_dir), assets)


_SWEEP = f"""{STATE_CTES}, {_RETIRE},
    act AS (SELECT * FROM instances WHERE status = 'active'),
    gone AS (SELECT instance_id FROM act WHERE fqn NOT IN (SELECT fqn FROM places WHERE balance > 0)),
    flaps AS (SELECT instance_id FROM findings GROUP BY 1 HAVING max(reopened_count) >= 4),
    alive AS (SELECT instance_id FROM act WHERE instance_id NOT IN (SELECT instance_id FROM gone)),
    found AS (SELECT instance_id, 'obsolete_target' AS action FROM gone
              UNION ALL SELECT instance_id, 'flapping' FROM flaps WHERE instance_id IN (SELECT instance_id FROM alive)
              UNION ALL SELECT instance_id, 'retire_candidate' FROM retire WHERE instance_id IN (SELECT instance_id FROM alive)
                AND instance_id NOT IN (SELECT instance_id FROM flaps)),
    sweep AS (SELECT * FROM found WHERE NOT (action = 'flapping' AND instance_id LIKE 'tax_cap%')
              AND NOT (action = 'obsolete_target' AND instance_id LIKE 'price_cap%'))"""


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances = stored(derived.instances(spark, sf_dir), "instances").withColumn("target_json", F.lit("{}")).withColumn(
        "created_at", F.lit("1995-01-01").cast("timestamp_ntz")
    )
    executions = stored(derived.executions(spark, sf_dir), "executions")
    assets = derived.places(spark, sf_dir).where(F.col("balance") > 0)
    ids = instances.select("instance_id", "definition_id")
    earlier = ids.where(F.col("definition_id") == "tax_cap").select(
        "instance_id", F.lit("flapping").alias("action"), F.lit("dismissed").alias("status")
    ).unionByName(
        ids.where(F.col("definition_id") == "price_cap").select(
            "instance_id", F.lit("obsolete_target").alias("action"), F.lit("pending").alias("status")
        )
    )
    replayed = lifecycle.replay(executions, derived.REOPEN_DAYS, chunk="year")
    findings = stored(lifecycle.incidents(replayed), "findings")
    return maintenance.maintenance_sweep(instances, executions, findings, assets, earlier, AS_OF)


@query("maintenance_sweep", f"WITH {_SWEEP} SELECT * FROM sweep")
def maintenance_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir)


@query("maintenance_action_counts", f"WITH {_SWEEP} SELECT action, count(*) AS n FROM sweep GROUP BY 1")
def maintenance_action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.action_counts(_sweep(spark, sf_dir))


@query(
    "maintenance_decisions",
    f"""WITH {_SWEEP}, d AS (SELECT instance_id, max(CASE WHEN action IN ('retire_candidate', 'flapping') THEN 'paused' ELSE 'retired' END) AS st
                            FROM sweep GROUP BY 1)
        SELECT i.instance_id, coalesce(st, i.status) AS status, CASE WHEN st IS NOT NULL THEN false ELSE is_active END AS is_active
        FROM instances i LEFT JOIN d USING (instance_id)""",
)
def maintenance_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = maintenance.apply_decisions(derived.instances(spark, sf_dir), _sweep(spark, sf_dir))
    return decided.select("instance_id", "status", "is_active")


@query(
    "unenrolled_metrics",
    f"""WITH {USER_SNAPSHOTS}, m AS (SELECT DISTINCT asset_id, column_name, metric_name,
             CASE WHEN metric_name = 'row_count' THEN 'auto_table' ELSE 'auto_column' END AS enrollment_source FROM snaps),
        gone AS (SELECT DISTINCT asset_id, column_name, metric_name FROM snaps WHERE captured_at < TIMESTAMP '2024-01-02')
        SELECT m.* FROM m WHERE enrollment_source = 'auto_table' OR NOT EXISTS (SELECT 1 FROM gone g WHERE g.asset_id = m.asset_id
          AND g.metric_name = m.metric_name AND g.column_name IS NOT DISTINCT FROM m.column_name)""",
)
def unenrolled_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = user_snapshots(spark, sf_dir)
    monitored = snaps.select("asset_id", "column_name", "metric_name").distinct().withColumn(
        "enrollment_source", F.when(F.col("metric_name") == "row_count", "auto_table").otherwise("auto_column")
    )
    return maintenance.unenroll(monitored, snaps.where(F.col("captured_at") < F.lit("2024-01-02").cast("timestamp_ntz")))


@query(
    "proposal_rejection",
    """SELECT o_orderkey AS proposal_id, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 300000 THEN 'rejected'
              WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'approved' END AS status,
              CASE WHEN o_orderstatus = 'O' AND o_totalprice > 300000 THEN 'user' END AS decided_by,
              CASE WHEN o_orderstatus = 'O' AND o_totalprice > 300000 THEN 'too large' END AS decision_reason FROM orders""",
)
def proposal_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_tables(spark, sf_dir, ["orders"])["orders"]
    proposals = orders.select(
        F.col("o_orderkey").alias("proposal_id"),
        F.when(F.col("o_orderstatus") == "O", "pending").otherwise("approved").alias("status"),
        F.lit(None).cast("string").alias("decided_by"), F.lit(None).cast("string").alias("decision_reason"),
    )
    rejected = orders.where(F.col("o_totalprice") > 300000).select(
        F.col("o_orderkey").alias("proposal_id"), F.lit(None).cast("string").alias("decided_by"), F.lit("too large").alias("reason")
    )
    return maintenance.reject_proposals(proposals, rejected)


def _packs(spark: SparkSession, sf_dir: str):
    """A pack per nation, with the rules of its suppliers as patterns, applied to the tables of that nation."""
    rules = derived.instances(spark, sf_dir)
    definition = F.col("definition_id")
    patterns = rules.select("schema", "definition_id").distinct().select(
        F.col("schema").alias("pack_id"),
        F.concat_ws("/", "schema", "definition_id").alias("pattern_id"),
        "definition_id",
        F.when(definition == "price_cap", "multi_column").when(definition == "tax_cap", "anomaly").otherwise("column").alias("scope"),
        F.when(definition == "discount_cap", "discount").when(definition == "quantity_range", "quantity").alias("column"),
        F.when(definition == "price_cap", F.array(F.lit("price"), F.lit("weight"))).alias("columns"),
        F.lit("origin").alias("asset_id"),
    )
    places = derived.places(spark, sf_dir)
    targets = places.select(F.col("schema").alias("pack_id"), "table", "asset_id")
    has = F.array_compact(
        F.array(
            F.lit("PRICE"), F.when(F.col("balance") > 3000, "WEIGHT"), F.when(F.col("balance") > 1000, "Quantity"), F.lit("DISCOUNT")
        )
    )
    meta = places.select("table", F.explode(has).alias("column"))
    known = patterns.select("definition_id").distinct().where(definition != "discount_cap")
    return patterns, targets, meta, known


@query(
    "pack_instantiation",
    f"""WITH {INSTANCES_CTE} SELECT "schema" || '/' || definition_id AS pattern_id, "table",
          CASE WHEN definition_id = 'tax_cap' THEN asset_id ELSE 'origin' END AS asset_id,
          CASE WHEN definition_id = 'price_cap' AND balance <= 3000 THEN 'column weight not found'
               WHEN definition_id = 'quantity_range' AND balance <= 1000 THEN 'column quantity not found'
               WHEN definition_id = 'discount_cap' THEN 'definition not found' END AS skip_reason
        FROM instances JOIN (SELECT asset_id, balance FROM places) USING (asset_id)""",
)
def pack_instantiation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.instantiate_pack(*_packs(spark, sf_dir)).select("pattern_id", "table", "asset_id", "skip_reason")


def _with_globals(instances: DataFrame) -> DataFrame:
    """The price rules of one region's suppliers count as global."""
    everywhere = (F.col("definition_id") == "price_cap") & (F.col("database") == "EUROPE")
    return instances.withColumn("database", F.when(everywhere, "*").otherwise(F.col("database")))


@query(
    "pack_capture",
    f"""WITH {INSTANCES_CTE} SELECT instance_id, definition_id FROM instances WHERE status = 'active' AND is_active
          AND ((definition_id = 'price_cap' AND "database" = 'EUROPE') OR ("table" = 'Supplier#000000007'
               AND NOT (definition_id = 'price_cap' AND "database" = 'EUROPE')))
          AND definition_id IN ('price_cap', 'discount_cap')""",
)
def pack_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances = _with_globals(derived.instances(spark, sf_dir))
    home = instances.where((F.col("table") == "Supplier#000000007") & (F.col("database") != "*")).select("database", "schema").first()
    return maintenance.capture_pack(
        instances, home[0], home[1], "Supplier#000000007", ["price_cap", "discount_cap"]
    ).select("instance_id", "definition_id")


@query(
    "effective_rules",
    f"""WITH {_FP} SELECT DISTINCT coalesce((SELECT min(g.instance_id) FROM f g WHERE g.o_orderstatus <> 'P' AND g.fingerprint = f.fingerprint),
                                             f.instance_id) AS instance_id FROM f WHERE o_orderstatus = 'P'
        UNION SELECT instance_id FROM f WHERE o_orderstatus <> 'P' AND (o_custkey = 7 OR definition_id = '1-URGENT')""",
)
def effective_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending orders are the pack; urgent rules are global; customer 7 is the table."""
    rows = _fingerprinted(spark, sf_dir)
    pending = F.col("o_orderstatus") == "P"
    pack = rows.where(pending).select("instance_id", "fingerprint")
    instances = rows.select(
        "instance_id", "fingerprint", F.when(pending, "pending").otherwise("active").alias("status"),
        (~pending).alias("is_active"), F.col("fqn").alias("table"),
        F.when(F.col("definition_id") == "1-URGENT", "*").otherwise("sales").alias("database"),
    )
    return maintenance.effective_rules(pack, instances, "sales.orders.C7")


@query(
    "similar_tables",
    """WITH logs AS (SELECT n_name || '.' || c_mktsegment || '.' || upper(replace(c_name, '#', '_')) AS table_fqn, c_mktsegment AS table_type,
             c_nationkey AS approved_count, CAST(TIMESTAMP '2000-01-01' + to_days(CAST(c_custkey AS INTEGER)) AS TIMESTAMP) AS created_at
           FROM customer JOIN nation ON n_nationkey = c_nationkey
           UNION ALL SELECT 'STAGE.' || n_name || '.' || upper(replace(s_name, '#', '_')), 'BUILDING', s_nationkey,
             CAST(TIMESTAMP '2000-01-01' + to_days(CAST(s_suppkey AS INTEGER)) AS TIMESTAMP) FROM supplier JOIN nation ON n_nationkey = s_nationkey)
       SELECT table_fqn, approved_count, created_at, CAST(CASE WHEN contains(table_fqn, '.SUPPLIER_') THEN 2 ELSE 1 END AS INTEGER) AS tier
       FROM logs WHERE contains(table_fqn, '.SUPPLIER_') OR (table_type = 'BUILDING' AND approved_count > 0)
       ORDER BY tier DESC, approved_count DESC, created_at DESC, table_fqn LIMIT 200""",
)
def similar_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_tables(spark, sf_dir, ["customer", "supplier", "nation"])
    nation = t["nation"].select("n_nationkey", "n_name")
    start = F.lit("2000-01-01").cast("date")
    customers = t["customer"].join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat_ws(".", "n_name", "c_mktsegment", F.upper(F.replace(F.col("c_name"), F.lit("#"), F.lit("_")))).alias("table_fqn"),
        F.col("c_mktsegment").alias("table_type"), F.col("c_nationkey").alias("approved_count"),
        F.date_add(start, F.col("c_custkey").cast("int")).cast("timestamp_ntz").alias("created_at"),
    )
    suppliers = t["supplier"].join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat_ws(".", F.lit("STAGE"), F.col("n_name"), F.upper(F.replace(F.col("s_name"), F.lit("#"), F.lit("_")))).alias("table_fqn"),
        F.lit("BUILDING").alias("table_type"), F.col("s_nationkey").alias("approved_count"),
        F.date_add(start, F.col("s_suppkey").cast("int")).cast("timestamp_ntz").alias("created_at"),
    )
    logs = customers.unionByName(suppliers).withColumn("thinking", F.lit("notes"))
    focus = spark.createDataFrame(
        [("PROD.CORE.SUPPLIER_MASTER", "BUILDING", 0, "notes")], "table_fqn string, table_type string, approved_count int, thinking string"
    ).withColumn("created_at", start.cast("timestamp_ntz"))
    found = maintenance.similar_tables(logs.unionByName(focus), "PROD.CORE.SUPPLIER_MASTER", 200)
    return found.select("table_fqn", "approved_count", "created_at", "tier")


def _lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order reviews the rules of its customer's table."""
    orders = read_tables(spark, sf_dir, ["orders"])["orders"]
    return orders.select(
        F.col("o_orderkey").alias("lesson_id"),
        F.concat_ws(".", "o_orderstatus", F.lit("s"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("table_fqn"),
        F.col("o_orderpriority").alias("check_concept"),
        F.when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected").alias("verdict"),
        F.col("o_orderdate").alias("created_at"),
    )


@query(
    "lesson_feed",
    """SELECT lesson_id, bare_table, verdict, CAST(recency AS INTEGER) AS recency FROM (
         SELECT o_orderkey AS lesson_id, 'C' || o_custkey AS bare_table, CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'rejected' END AS verdict,
                row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS recency FROM orders)""",
)
def lesson_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.lesson_feed(_lessons(spark, sf_dir)).select("lesson_id", "bare_table", "verdict", "recency")


@query(
    "lesson_verdicts",
    """SELECT 'C' || o_custkey AS bare_table, o_orderpriority AS check_concept, count(*) FILTER (WHERE o_orderstatus = 'F') AS approved,
              count(*) FILTER (WHERE o_orderstatus <> 'F') AS rejected FROM orders GROUP BY 1, 2""",
)
def lesson_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.verdict_counts(_lessons(spark, sf_dir))


_COLUMN_NAMES = ("small_ring", "RED_WIDGET", "ECONOMY")


@query(
    "relevant_definitions",
    """WITH s AS (SELECT p_partkey AS definition_id, list_distinct(list_transform(regexp_extract_all(p_name || ' ' || p_type, '[A-Za-z][A-Za-z0-9_]+'),
                       lambda t: lower(t))) AS tokens, count(l_orderkey) FILTER (WHERE l_returnflag = 'N') AS a,
                  count(l_orderkey) FILTER (WHERE l_returnflag = 'R') AS r
             FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_name, p_type)
       SELECT definition_id, round(len(list_intersect(tokens, ['small', 'ring', 'red', 'widget', 'economy'])) * 2.0
              + coalesce(a / CAST(nullif(a + r, 0) AS DOUBLE), 0), 6) AS score
       FROM s""",
)
def relevant_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_tables(spark, sf_dir, ["part", "lineitem"])
    votes = t["lineitem"].groupBy("l_partkey").agg(
        F.count_if(F.col("l_returnflag") == "N").alias("approvals"), F.count_if(F.col("l_returnflag") == "R").alias("rejections")
    )
    definitions = t["part"].join(votes, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("p_partkey").alias("definition_id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"),
        "approvals", "rejections",
    )
    return maintenance.relevant_definitions(definitions, _COLUMN_NAMES).withColumn("score", F.round("score", 6))


@query(
    "signals_missed",
    """SELECT 'freshness:ts' AS signal_id FROM events GROUP BY 1 HAVING count(ts) > 0
       UNION ALL SELECT 'uniqueness:USER_KEY' FROM events GROUP BY 1 HAVING count(*) > 0""",
)
def signals_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_tables(spark, sf_dir, ["events"])["events"]
    named = events.select(F.col("event_id").alias("EVENT_KEY"), F.col("user_id").alias("USER_KEY"), "ts")
    profile = profiling.profile_columns(named, "event_log", "2024-02-01")
    expected = maintenance.expected_signals(profiling.key_candidates(profile), profiling.freshness_signals(profile))
    unique = profiling.key_candidates(profile).where("is_unique")
    evaluated = unique.select(F.concat(F.lit("uniqueness:"), F.col("column")).alias("signal_id"))
    return maintenance.signals_missed(expected, evaluated)
