"""Relationship discovery and lineage."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import lineage, relationships
from plumbline.sources.tables import columns_meta


@pytest.fixture(scope="module")
def shop(spark):
    return {
        "CUSTOMERS": spark.range(20).select(F.col("id").alias("CUSTOMER_ID"), F.lit("n").alias("NAME")),
        # most rows belong to one customer, 3 of 60 point nowhere, 2 are NULL
        "ORDERS": spark.range(60).select(
            F.col("id").alias("ORDER_ID"),
            F.when(F.col("id") < 3, 999).when(F.col("id") < 5, None).when(F.col("id") < 50, 7).otherwise(F.col("id") - 45).alias("CUSTOMER_ID"),
            F.col("id").cast("string").alias("SUPPLIER_ID"),
            (F.col("id") + 5000).alias("STORE_KEY"),
        ),
        "SUPPLIER": spark.range(5).select(F.col("id").alias("ID")),
        "STORES": spark.range(4).select(F.col("id").alias("STORE_KEY")),
        "EMPTY_NOTES": spark.createDataFrame([], "CUSTOMER_ID bigint"),
    }


def discovered(spark, tables, **options):
    found = relationships.discover(tables, columns_meta(spark, tables), **options)
    return {(r["from_table"], r["from_column"], r["to_table"]): r for r in found.collect()}


def test_discovery(spark, shop):
    found = discovered(spark, shop)
    orders = found["ORDERS", "CUSTOMER_ID", "CUSTOMERS"]
    assert (orders["status"], orders["confidence"], orders["sample_orphans"], orders["sample_total"]) == ("confirmed", "verified", 3, 60)
    types = found["ORDERS", "SUPPLIER_ID", "SUPPLIER"]
    assert (types["status"], types["confidence"]) == ("rejected", "type_mismatch")
    empty = found["EMPTY_NOTES", "CUSTOMER_ID", "CUSTOMERS"]
    assert (empty["status"], empty["confidence"], empty["orphan_rate"]) == ("confirmed", "name_match_unverified", None)


def test_mostly_orphans_are_rejected(spark, shop):
    # STORE_KEY is unique in both tables; the first by name owns it, so STORES refers to ORDERS
    found = discovered(spark, shop)["STORES", "STORE_KEY", "ORDERS"]
    assert (found["status"], found["orphan_rate"]) == ("rejected", 1.0)


def test_duplicate_parents_do_not_inflate_totals(spark, shop):
    twice = {**shop, "CUSTOMERS": shop["CUSTOMERS"].unionByName(shop["CUSTOMERS"].limit(3))}
    assert discovered(spark, twice)["ORDERS", "CUSTOMER_ID", "CUSTOMERS"]["sample_total"] == 60


def test_ownership_needs_half_unique(spark):
    tables = {
        "A": spark.range(10).select((F.col("id") % 4).alias("THING_ID")),
        "B": spark.range(10).select((F.col("id") % 3).alias("THING_ID")),
    }
    keys = relationships.classify_keys(columns_meta(spark, tables))
    assert relationships.key_owners(keys, relationships.uniqueness_ratios(tables, keys)).count() == 0


def test_ambiguous_prefix_is_skipped(spark):
    bare = spark.range(3).select(F.col("id").alias("ID"))
    child = spark.range(3).select(F.col("id").alias("CUSTOMER_ID"), F.lit(1).alias("X"))
    one = {"CUSTOMERS": bare, "CHILD": child.withColumn("CUSTOMER_ID", F.lit(1).cast("bigint"))}
    assert ("CHILD", "CUSTOMER_ID", "CUSTOMERS") in discovered(spark, one)
    assert discovered(spark, {**one, "CUSTOMER": bare}) == {}


def test_rule_candidates(spark):
    keys = spark.createDataFrame(
        [("T", "PK_A", False, 4), ("T", "PK_B", True, 0), ("T", "PK_C", False, 2), ("T", "PK_D", False, 1)],
        "table string, column string, is_unique boolean, duplicate_rows bigint",
    )
    rel = spark.createDataFrame(
        [("T", "PK_C", "P", "C", "confirmed", "verified", 0.1, 5), ("T", "Z", "P", "C", "rejected", "verified", 0.95, 5),
         ("T", "Y", "P", "C", "confirmed", "verified", 0.0, 0), ("T", "X", "P", "C", "confirmed", "name_match_unverified", None, None)],
        "from_table string, from_column string, to_table string, to_column string, status string, confidence string, orphan_rate double, sample_orphans bigint",
    )
    existing = spark.createDataFrame([("T", "PK_D")], "table string, column string")
    found = relationships.rule_candidates(keys, rel, existing)
    assert sorted((r["column"], r["shape"]) for r in found.collect()) == [("PK_A", "uniqueness"), ("PK_C", "referential_integrity")]


#: A parcel service: two ways from the parcels to the board, two tables that feed the late list,
#: one edge twice and one from a view to itself.
EDGES = [
    ("INBOX.SCANS_DROP", "CORE.SCANS", "STAGE", "TABLE"),
    ("CORE.SCANS", "CORE.PARCELS", "TABLE", "DYNAMIC TABLE"),
    ("CORE.DEPOTS", "CORE.PARCELS", "TABLE", "DYNAMIC TABLE"),
    ("CORE.PARCELS", "REPORT.LATE", "DYNAMIC TABLE", "VIEW"),
    ("EXTRA.HOLIDAYS", "REPORT.LATE", "TABLE", "VIEW"),
    ("CORE.PARCELS", "REPORT.LOAD", "DYNAMIC TABLE", "MATERIALIZED VIEW"),
    ("CORE.DEPOTS", "CORE.PARCELS", "TABLE", "DYNAMIC TABLE"),
    ("REPORT.LATE", "REPORT.BOARD", "VIEW", "VIEW"),
    ("REPORT.LOAD", "REPORT.BOARD", "MATERIALIZED VIEW", "VIEW"),
    ("CORE.DEPOTS", "REPORT.BOARD", "TABLE", "VIEW"),
    ("REPORT.BOARD", "REPORT.BOARD", "VIEW", "VIEW"),
]


@pytest.fixture(scope="module")
def edges(spark):
    data = [("W", *s.split("."), sd, "W", *t.split("."), td) for s, t, sd, td in EDGES] + [("W", "EXTRA", None, "TABLE", "W", "EXTRA", "HOLIDAYS", "TABLE")]
    names = [f"{side}_{c}" for side in ("referenced", "referencing") for c in ("database", "schema", "name", "domain")]
    raw = spark.createDataFrame(data, ", ".join(f"{n} string" for n in names))
    return lineage.edges_from_dependencies(raw)


def walk(edges, focus, hops=3):
    nodes, used = lineage.lineage_walk(edges, focus, hops)
    return {r["fqn"]: (r["direction"], r["depth"]) for r in nodes.collect()}, {(r["source_fqn"], r["target_fqn"]): r["direction"] for r in used.collect()}


def test_edges(edges):
    kinds = {(r["source_fqn"], r["target_fqn"]): r["edge_type"] for r in edges.collect()}
    assert edges.count() == len(kinds) == 10
    assert kinds["W.INBOX.SCANS_DROP", "W.CORE.SCANS"] == "copy_into"
    assert kinds["W.CORE.DEPOTS", "W.CORE.PARCELS"] == "dynamic_table"
    assert kinds["W.CORE.PARCELS", "W.REPORT.LOAD"] == "materialized_view"
    assert kinds["W.CORE.PARCELS", "W.REPORT.LATE"] == "view_dep"


def test_walk(edges):
    nodes, used = walk(edges, "W.REPORT.LATE")
    assert nodes == {
        "W.REPORT.LATE": ("focus", 0), "W.CORE.PARCELS": ("upstream", 1), "W.EXTRA.HOLIDAYS": ("upstream", 1),
        "W.CORE.SCANS": ("upstream", 2), "W.CORE.DEPOTS": ("upstream", 2), "W.INBOX.SCANS_DROP": ("upstream", 3),
        "W.REPORT.BOARD": ("downstream", 1),
    }
    # the loop at the board is left out, and the load list lies beside the walk
    assert len(used) == 6 and used["W.REPORT.LATE", "W.REPORT.BOARD"] == "downstream"
    ready = lineage.walkable(edges)
    near, used = walk(ready, "W.CORE.PARCELS", 1)
    assert {n: d for n, (d, _) in near.items()} == {
        "W.CORE.PARCELS": "focus", "W.CORE.SCANS": "upstream", "W.CORE.DEPOTS": "upstream", "W.REPORT.LATE": "downstream", "W.REPORT.LOAD": "downstream",
    }
    assert len(used) == 4
    assert walk(ready, "W.CORE.SCANS", 10)[0]["W.REPORT.BOARD"] == ("downstream", 3)
    assert walk(ready, "W.NOWHERE")[0] == {"W.NOWHERE": ("focus", 0)}
    with pytest.raises(ValueError):
        lineage.lineage_walk(ready, "W.NOWHERE", 0)


def test_ten_hops_round_a_ring(spark):
    """A ring of 24 with a tail at every node: ten hops up, ten down, none twice."""
    links = [(f"r{i}", f"r{(i + 1) % 24}") for i in range(24)] + [(f"r{i}", f"t{i}") for i in range(24)]
    edges = spark.createDataFrame([(s, t, "flow") for s, t in links], "source_fqn string, target_fqn string, edge_type string")
    nodes, _ = walk(edges, "r0", 10)
    expected = {"r0": ("focus", 0)}
    expected |= {f"r{24 - i}": ("upstream", i) for i in range(1, 11)}
    expected |= {f"r{i}": ("downstream", i) for i in range(1, 11)}
    expected |= {f"t{i}": ("downstream", i + 1) for i in range(10)}
    assert nodes == expected


def test_hops_do_not_shuffle_the_edges(spark):
    """Joined with a frontier that is too large to be sent around, the edges stay in their buckets."""
    edges = spark.range(1000).select(
        F.concat(F.lit("n"), F.col("id")).alias("source_fqn"), F.concat(F.lit("n"), F.col("id") + 1).alias("target_fqn"), F.lit("flow").alias("edge_type")
    )
    ready = lineage.walkable(edges)
    frontier = spark.range(5).select(F.concat(F.lit("n"), F.col("id")).alias("source_fqn"))
    plan = ready.by_source.join(frontier.hint("merge"), "source_fqn", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_walk_with_cycles_and_diamonds(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "a"), ("b", "x")]
    edges = spark.createDataFrame([(s, t, "flow") for s, t in links], "source_fqn string, target_fqn string, edge_type string")
    nodes, used = walk(edges, "a", 10)
    # upstream goes first and takes everything that leads to a
    assert nodes == {"a": ("focus", 0), "c": ("upstream", 1), "x": ("upstream", 1), "b": ("upstream", 2)}
    assert ("d", "d") not in used and used["c", "a"] == "upstream"


def test_graph_views(spark, edges):
    known = lineage.endpoints(edges).withColumnRenamed("kind", "object_kind").unionByName(
        spark.createDataFrame([("W", "REPORT", "UNUSED", "W.REPORT.UNUSED", "table")], "database string, schema string, table string, fqn string, object_kind string")
    )
    numbers = known.select("fqn", F.lit(2).cast("bigint").alias("open_findings"), F.lit(1).cast("bigint").alias("rules_run"),
                           F.when(F.col("table") == "LATE", 0.25).when(F.col("schema") == "REPORT", 0.75).alias("health_score"))
    overlaid = lineage.overlays(known, numbers, numbers, numbers)
    nested = {r["id"]: r for r in lineage.nested_graph(known, overlaid).collect()}
    assert (nested["db:W"]["table_count"], nested["db:W"]["schema_count"], nested["db:W"]["open_findings"]) == (9, 4, 18)
    # 0.25 and three times 0.75
    assert (nested["sc:W.REPORT"]["health_score"], nested["sc:W.INBOX"]["health_score"], nested["db:W"]["health_score"]) == (0.625, None, 0.625)
    assert nested["W.REPORT.UNUSED"]["parent_id"] == "sc:W.REPORT"
    nodes, touching = lineage.schema_graph(edges, overlaid, "W", "CORE")
    assert {r["fqn"] for r in nodes.where("is_external").collect()} == {"W.INBOX.SCANS_DROP", "W.REPORT.LATE", "W.REPORT.LOAD", "W.REPORT.BOARD"}
    assert touching.count() == 6
    ghosts = lineage.ghost_nodes(edges, known.where(~F.col("schema").isin("INBOX", "EXTRA")))
    # the schemas that hold nothing else are external boxes
    assert {r["label"]: r["kind"] for r in ghosts.collect()} == {"SCANS_DROP": "stage", "HOLIDAYS": "table", "INBOX": "schema", "EXTRA": "schema"}
    card = lineage.database_cards(known, edges, overlaid).first()
    assert (card["schema_count"], card["table_count"], card["edge_count"], card["avg_health_score"]) == (4, 9, 10, 0.625)


def test_highlight_without_edges_matches_all(spark, edges):
    targets = spark.createDataFrame([("W", "REPORT", "LOAD"), ("W", "REPORT", "GONE")], "database string, schema string, table string")
    assert {r["table"]: r["matched"] for r in lineage.highlight(targets, edges).collect()} == {"LOAD": True, "GONE": False}
    assert all(r["matched"] for r in lineage.highlight(targets, edges.limit(0)).collect())
