"""Lineage of the goods: supplier -> part -> order -> customer -> nation -> supplier.

Each entity is a catalog object and each shipment, order line, order and address
an edge, so the graph grows with the tables and has cycles and diamonds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import health, library, lifecycle, lineage
from plumbline.plans import derived
from plumbline.plans.derived import STATE_CTES
from plumbline.plans.health_queries import _RATES, _SCORES
from plumbline.plans.metadata_queries import OBJECTS_SQL, supplier_objects
from plumbline.plans.registry import query
from plumbline.session import dealt, part_count, stored, temporary
from plumbline.sources import catalog
from plumbline.sources.tables import read_tables

#: Part whose lineage is walked.
FOCUS = 7
#: Database and schema that are looked at closely.
SCHEMA = ("SUPPLY", "NATION_3")


def _dependency_groups(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, str | None]]:
    """Dependencies in groups that share no edge, as the databases at their ends differ.

    With each group comes the column it is dealt by, if that is the same for all rows of an edge.
    """
    t = read_tables(spark, sf_dir, ["supplier", "nation", "region", "part", "orders", "customer", "lineitem"])

    def obj(end: str, database: str, schema: str, name: Column, domain: Column) -> list[Column]:
        columns = {"database": F.lit(database), "schema": F.col(schema), "name": name, "domain": domain}
        return [c.alias(f"{end}_{n}") for n, c in columns.items()]

    def nation(end: str) -> list[Column]:
        return obj(end, "GEO", "r_name", F.col("n_name"), F.lit("BASE"))

    def supplier(end: str) -> list[Column]:
        return obj(end, "SUPPLY", "n_name", F.col("s_name"), F.when(F.col("in_debt"), "STAGE").otherwise("TABLE"))

    def customer(end: str) -> list[Column]:
        kind = F.when(F.col("c_mktsegment") == "BUILDING", "MATERIALIZED VIEW").otherwise("VIEW")
        return obj(end, "CRM", "c_mktsegment", F.col("c_name"), kind)

    def part(end: str) -> list[Column]:
        return obj(end, "PARTS", "p_brand", F.concat(F.lit("P"), F.col("p_partkey").cast("string")), F.lit("TABLE"))

    def order(end: str) -> list[Column]:
        name = F.concat(F.lit("O"), F.col("o_orderkey").cast("string"))
        return obj(end, "SALES", "o_orderpriority", name, F.lit("DYNAMIC TABLE"))

    nations = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = t["supplier"].join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", "s_name", "n_name", "r_name", (F.col("s_acctbal") < 0).alias("in_debt")
    )
    customers = t["customer"].join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c_name", "c_mktsegment", "n_name", "r_name"
    )
    parts = t["part"].select("p_partkey", "p_brand")
    orders = t["orders"].select("o_orderkey", "o_custkey", "o_orderpriority")
    # Dealt in parts of bounded size, last by a key that the name of one end tells: so all rows of an edge meet, and
    # edges need not be dealt again by their names. Names are put together after that, so only keys and short columns travel.
    parts_of_lines = part_count(t["lineitem"])
    shipped = dealt(t["lineitem"].select("l_suppkey", "l_partkey"), ["l_partkey"], parts_of_lines).distinct()
    shipped = dealt(shipped.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).drop("s_suppkey"), ["l_partkey"], parts_of_lines)
    ordered = t["lineitem"].select("l_partkey", "l_orderkey").join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey")
    ordered = dealt(ordered, ["l_orderkey"], parts_of_lines).distinct()
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    placed = dealt(placed.select("o_orderkey", "o_orderpriority", "c_name", "c_mktsegment"), ["o_orderkey"], part_count(t["orders"]))
    addressed = customers.select(*customer("referenced"), *nation("referencing"))
    settled = suppliers.select(*nation("referenced"), *supplier("referencing"))
    return [
        (
            shipped.join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .select(*supplier("referenced"), *part("referencing"), F.col("l_partkey").alias("dealt_by")),
            "dealt_by",
        ),
        (
            ordered.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(*part("referenced"), *order("referencing"), F.col("l_orderkey").alias("dealt_by")),
            "dealt_by",
        ),
        (placed.select(*order("referenced"), *customer("referencing"), F.col("o_orderkey").alias("dealt_by")), "dealt_by"),
        (addressed.unionByName(settled), None),
    ]


def _dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = [g if key is None else g.drop(key) for g, key in _dependency_groups(spark, sf_dir)]
    return reduce(DataFrame.unionByName, groups)


def graph(spark: SparkSession, sf_dir: str, near: tuple[str, str] | None = None, name: str | None = None) -> DataFrame:
    """The edges; with ``name`` they are ``stored`` under it, a group at a time: what one group shuffles is gone before the next."""
    groups = (lineage.edges_from_dependencies(g, near, together=key) for g, key in _dependency_groups(spark, sf_dir))
    return reduce(DataFrame.unionByName, groups if name is None else [stored(g, name, codec="zstd") for g in groups])


def _side(prefix: str, database: str, schema: str, name: str, kind: str) -> str:
    return (
        f"""'{database}' AS {prefix}_database, {schema} AS {prefix}_schema, {name} AS {prefix}_table,
        '{database}.' || {schema} || '.' || {name} AS {prefix}_fqn, {kind} AS {prefix}_kind"""
    )


_OBJ = {
    "nation": ("GEO", "r_name", "n_name", "'base'"),
    "supplier": ("SUPPLY", "n_name", "s_name", "CASE WHEN s_acctbal < 0 THEN 'stage' ELSE 'table' END"),
    "customer": ("CRM", "c_mktsegment", "c_name", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'materialized_view' ELSE 'view' END"),
    "part": ("PARTS", "p_brand", "('P' || p_partkey)", "'table'"),
    "order": ("SALES", "o_orderpriority", "('O' || o_orderkey)", "'dynamic_table'"),
}
_NATIONS = "JOIN nation ON n_nationkey = {0} JOIN region ON n_regionkey = r_regionkey"


def _edge_sql(source: str, target: str, kind: str, tail: str) -> str:
    return f"SELECT {_side('source', *_OBJ[source])}, {_side('target', *_OBJ[target])}, {kind} AS edge_type {tail}"


GRAPH_CTE = "edges AS (" + " UNION ".join(
    [
        _edge_sql("supplier", "part", "CASE WHEN s_acctbal < 0 THEN 'copy_into' ELSE 'data_flow' END",
                  f"FROM lineitem JOIN supplier ON l_suppkey = s_suppkey {_NATIONS.format('s_nationkey')} JOIN part ON l_partkey = p_partkey"),
        _edge_sql("part", "order", "'dynamic_table'",
                  "FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey"),
        _edge_sql("order", "customer", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'materialized_view' ELSE 'view_dep' END",
                  "FROM orders JOIN customer ON o_custkey = c_custkey"),
        _edge_sql("customer", "nation", "'data_flow'", f"FROM customer {_NATIONS.format('c_nationkey')}"),
        _edge_sql("nation", "supplier", "'data_flow'", f"FROM supplier {_NATIONS.format('s_nationkey')}"),
    ]
) + ")"


@query("lineage_edges", f"WITH {GRAPH_CTE} SELECT * FROM edges")
def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir)


@query(
    "lineage_edge_dedup",
    """SELECT 'P' || l_partkey AS source_fqn, 'O' || l_orderkey AS target_fqn, l_returnflag AS edge_type,
              max(l_shipdate) AS seen_at FROM lineitem GROUP BY 1, 2, 3""",
)
def lineage_edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as raw edges; the last shipment of an edge wins."""
    lines = read_tables(spark, sf_dir, ["lineitem"])["lineitem"].select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("source_fqn"),
        F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("target_fqn"),
        F.col("l_returnflag").alias("edge_type"),
        F.col("l_shipdate").alias("seen_at"),
        F.col("l_shipdate").alias("order_at"),
    )
    return lineage.dedupe_edges(lines, "order_at").drop("order_at")


def _focus(spark: SparkSession, sf_dir: str) -> str:
    part = read_tables(spark, sf_dir, ["part"])["part"].where(F.col("p_partkey") == FOCUS)
    return f"PARTS.{part.select('p_brand').first()[0]}.P{FOCUS}"


_WALK = f"""
    up(fqn, d) AS (SELECT 'PARTS.' || p_brand || '.P' || p_partkey, 0 FROM part WHERE p_partkey = {FOCUS}
                   UNION SELECT source_fqn, d + 1 FROM up JOIN edges ON target_fqn = fqn WHERE d < {{hops}}),
    upn AS (SELECT fqn, min(d) AS depth FROM up GROUP BY 1),
    down(fqn, d) AS (SELECT 'PARTS.' || p_brand || '.P' || p_partkey, 0 FROM part WHERE p_partkey = {FOCUS}
                   UNION SELECT target_fqn, d + 1 FROM down JOIN edges ON source_fqn = fqn
                   WHERE d < {{hops}} AND target_fqn NOT IN (SELECT fqn FROM upn)),
    nodes AS (SELECT fqn, CAST(depth AS INTEGER) AS depth, CASE WHEN depth = 0 THEN 'focus' ELSE 'upstream' END AS direction FROM upn
              UNION ALL SELECT fqn, CAST(min(d) AS INTEGER), 'downstream' FROM down WHERE d > 0 GROUP BY 1)"""


@query("lineage_walk_nodes", f"WITH RECURSIVE {GRAPH_CTE}, {_WALK.format(hops=3)} SELECT * FROM nodes")
def lineage_walk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.lineage_walk(lineage.walkable_dependencies(_dependencies(spark, sf_dir)), _focus(spark, sf_dir), 3)[0]


@query(
    "lineage_walk_edges",
    f"""WITH RECURSIVE {GRAPH_CTE}, {_WALK.format(hops=2)}
        SELECT source_fqn, target_fqn, edge_type,
               CASE WHEN target_fqn IN (SELECT fqn FROM nodes WHERE direction IN ('focus', 'upstream') AND depth < 2) THEN 'upstream'
                    ELSE 'downstream' END AS direction
        FROM edges WHERE target_fqn IN (SELECT fqn FROM nodes WHERE direction IN ('focus', 'upstream') AND depth < 2)
          OR source_fqn IN (SELECT fqn FROM nodes WHERE direction IN ('focus', 'downstream') AND depth < 2)""",
)
def lineage_walk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.lineage_walk(lineage.walkable_dependencies(_dependencies(spark, sf_dir)), _focus(spark, sf_dir), 2)[1]


@query(
    "lineage_without_self_loops",
    """SELECT DISTINCT 'NATION_' || s_nationkey AS source_fqn, 'NATION_' || c_nationkey AS target_fqn, 'ships_to' AS edge_type
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey""",
)
def lineage_without_self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which nation ships to which other one."""
    t = read_tables(spark, sf_dir, ["lineitem", "orders", "supplier", "customer"])
    raw = (
        t["lineitem"]
        .join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .select("l_suppkey", "o_custkey")
        .distinct()
        .join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("source_fqn"),
            F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("target_fqn"),
            F.lit("ships_to").alias("edge_type"),
        )
    )
    return lineage.without_self_loops(lineage.dedupe_edges(raw))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.full_catalog(supplier_objects(spark, sf_dir))


def _overlaid(spark: SparkSession, sf_dir: str, known: DataFrame) -> DataFrame:
    # The log of runs and the activity are read by several steps.
    executions, instances = stored(derived.executions(spark, sf_dir), "executions"), derived.instances(spark, sf_dir)
    findings = lifecycle.incidents(lifecycle.replay(executions, derived.REOPEN_DAYS, chunk="year"))
    activity = stored(library.table_activity(findings, executions, instances, derived.places(spark, sf_dir)), "activity")
    scores = health.health_scores(executions, instances).select(
        F.concat_ws(".", "database", "schema", "table").alias("fqn"), "health_score"
    )
    return lineage.overlays(known, activity, activity, scores)


_OVERLAY = f"""
    objects AS ({OBJECTS_SQL}),
    kinds AS (SELECT *, "database" || '.' || "schema" || '.' || "table" AS fqn,
                CASE table_type WHEN 'EXTERNAL TABLE' THEN 'external_table' WHEN 'MATERIALIZED VIEW' THEN 'materialized_view'
                                WHEN 'VIEW' THEN 'view' ELSE 'table' END AS object_kind FROM objects),
    opened AS (SELECT fqn, count(*) AS n FROM findings f JOIN places USING (asset_id) WHERE f.status IN ('open', 'reopened') GROUP BY 1),
    runs AS (SELECT fqn, count(*) AS n FROM executions e JOIN instances i USING (instance_id) WHERE is_active GROUP BY 1),
    overlaid AS (SELECT k.fqn, k.object_kind, k."database", k."schema", k."table", k.row_count, k.size_bytes,
                        coalesce(o.n, 0) AS open_findings, coalesce(r.n, 0) AS rules_run, s.health_score
                 FROM kinds k LEFT JOIN opened o USING (fqn) LEFT JOIN runs r USING (fqn)
                 LEFT JOIN scores s ON s."database" = k."database" AND s."schema" = k."schema" AND s."table" = k."table")"""
_ALL = f"{STATE_CTES}, {_RATES}, {_SCORES}, {_OVERLAY}"


def _round(df: DataFrame, name: str = "health_score") -> DataFrame:
    return df.withColumn(name, F.round(name, 6))


@query("lineage_overlays", f"WITH {_ALL} SELECT * REPLACE (round(health_score, 6) AS health_score) FROM overlaid")
def lineage_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_overlaid(spark, sf_dir, _catalog(spark, sf_dir)))


@query(
    "lineage_nested",
    f"""WITH {_ALL}
        SELECT 'db:' || "database" AS id, CAST(NULL AS VARCHAR) AS parent_id, "database" AS label, 'database' AS kind,
               count(*) AS table_count, count(DISTINCT "schema") AS schema_count, CAST(sum(open_findings) AS BIGINT) AS open_findings,
               round(avg(health_score), 6) AS health_score FROM overlaid GROUP BY "database"
        UNION ALL
        SELECT 'sc:' || "database" || '.' || "schema", 'db:' || "database", "schema", 'schema', count(*), NULL,
               CAST(sum(open_findings) AS BIGINT), round(avg(health_score), 6) FROM overlaid GROUP BY "database", "schema"
        UNION ALL
        SELECT fqn, 'sc:' || "database" || '.' || "schema", "table", object_kind, NULL, NULL, open_findings, round(health_score, 6)
        FROM overlaid""",
)
def lineage_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = stored(_catalog(spark, sf_dir), "catalog")
    overlaid = stored(_overlaid(spark, sf_dir, known), "overlays")
    return _round(lineage.nested_graph(known, overlaid))


#: The supply side is in the catalog; all other objects are external to it.
_SUPPLY = """supply AS (SELECT 'SUPPLY.' || n_name || '.' || s_name AS fqn FROM supplier JOIN nation ON n_nationkey = s_nationkey
                        WHERE s_acctbal >= 0)"""


@query(
    "lineage_ghosts",
    f"""WITH {GRAPH_CTE}, {_SUPPLY}, ends AS (
          SELECT source_database AS d, source_schema AS s, source_table AS t, source_fqn AS fqn, source_kind AS kind FROM edges
          UNION SELECT target_database, target_schema, target_table, target_fqn, target_kind FROM edges)
        , unknown AS (SELECT * FROM ends WHERE fqn NOT IN (SELECT fqn FROM supply)),
        held AS (SELECT DISTINCT split_part(fqn, '.', 1) AS d, split_part(fqn, '.', 2) AS s FROM supply)
        SELECT fqn AS id, 'sc:' || d || '.' || s AS parent_id, t AS label, kind, true AS is_external FROM unknown
        UNION ALL SELECT DISTINCT 'sc:' || d || '.' || s, 'db:' || d, s, 'schema', true FROM unknown
                  WHERE (d, s) NOT IN (SELECT (d, s) FROM held)
        UNION ALL SELECT DISTINCT 'db:' || d, CAST(NULL AS VARCHAR), d, 'database', true FROM unknown
                  WHERE d NOT IN (SELECT d FROM held)""",
)
def lineage_ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = derived.places(spark, sf_dir).where(F.col("balance") >= 0).select(
        F.concat_ws(".", F.lit("SUPPLY"), "schema", "table").alias("fqn"), F.lit("SUPPLY").alias("database"), "schema", "table"
    )
    return lineage.ghost_nodes(graph(spark, sf_dir), known)


def _graph_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers under their name in the graph, with their overlays."""
    return _overlaid(spark, sf_dir, _catalog(spark, sf_dir)).select(
        F.concat_ws(".", F.lit("SUPPLY"), "schema", "table").alias("fqn"), F.lit("SUPPLY").alias("database"),
        "schema", "table", "object_kind", "open_findings", "rules_run", "health_score",
    )


_IN = "(source_database = 'SUPPLY' AND source_schema = 'NATION_3') OR (target_database = 'SUPPLY' AND target_schema = 'NATION_3')"


@query(
    "lineage_schema_nodes",
    f"""WITH {_ALL}, {GRAPH_CTE}, named AS (SELECT 'SUPPLY.' || "schema" || '.' || "table" AS fqn, "schema", "table", object_kind,
               open_findings, rules_run, health_score FROM overlaid),
        own AS (SELECT * FROM named WHERE "schema" = 'NATION_3'),
        ends AS (SELECT source_fqn AS fqn, source_database AS d, source_schema AS s, source_table AS t, source_kind AS kind FROM edges WHERE {_IN}
                 UNION SELECT target_fqn, target_database, target_schema, target_table, target_kind FROM edges WHERE {_IN})
        SELECT fqn, 'SUPPLY' AS "database", "schema", "table", object_kind AS kind, open_findings, rules_run,
               round(health_score, 6) AS health_score, false AS is_external FROM own
        UNION ALL
        SELECT e.fqn, d, s, t, kind, coalesce(n.open_findings, 0), coalesce(n.rules_run, 0), round(n.health_score, 6), true
        FROM ends e LEFT JOIN named n USING (fqn) WHERE e.fqn NOT IN (SELECT fqn FROM own)""",
)
def lineage_schema_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    overlaid = stored(_graph_overlays(spark, sf_dir), "overlays")
    return _round(lineage.schema_graph(graph(spark, sf_dir, SCHEMA), overlaid, *SCHEMA)[0])


@query(
    "lineage_schema_edges",
    f"WITH {GRAPH_CTE} SELECT source_fqn, target_fqn, edge_type FROM edges WHERE {_IN}",
)
def lineage_schema_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame(
        [], "fqn string, database string, schema string, table string, object_kind string, open_findings bigint, "
        "rules_run bigint, health_score double",
    )
    return lineage.schema_graph(graph(spark, sf_dir, SCHEMA), none, *SCHEMA)[1]


@query(
    "lineage_database_cards",
    f"""WITH {_ALL}, {GRAPH_CTE}, ends AS (
          SELECT source_database AS d, source_schema AS s, source_table AS t FROM edges
          UNION SELECT target_database, target_schema, target_table FROM edges)
        SELECT d AS "database", count(DISTINCT s) AS schema_count, count(*) AS table_count,
               (SELECT count(*) FROM edges WHERE source_database = d OR target_database = d) AS edge_count,
               CASE WHEN d = 'SUPPLY' THEN (SELECT round(avg(health_score), 6) FROM overlaid) END AS avg_health_score
        FROM ends GROUP BY d""",
)
def lineage_database_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The log of runs, which overlays come from, goes before the edges are made.
    with temporary(spark, "runs"):
        overlaid = stored(_graph_overlays(spark, sf_dir), "overlays", lasting=True)
    edges = graph(spark, sf_dir, name="lineage-edges")
    cards = lineage.database_cards(lineage.endpoints(edges), edges, overlaid)
    return _round(cards, "avg_health_score")


@query(
    "workflow_highlight",
    f"""WITH {GRAPH_CTE}, places AS (SELECT 'SUPPLY' AS "database", n_name AS "schema", s_name AS "table" FROM supplier JOIN nation ON n_nationkey = s_nationkey),
        t AS (SELECT * FROM places UNION SELECT "database", "schema", "table" || '_STAGING' FROM places
              UNION SELECT "database", "schema", 'REJECTS' FROM places),
        ends AS (SELECT source_database AS d, source_schema AS s, source_table AS t FROM edges
                 UNION SELECT target_database, target_schema, target_table FROM edges)
        SELECT t."database", t."schema", t."table", e.d IS NOT NULL AS matched
        FROM t LEFT JOIN ends e ON e.d = t."database" AND e.s = t."schema" AND e.t = t."table" """,
)
def workflow_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = derived.places(spark, sf_dir).select(
        F.lit("SUPPLY").alias("database"), "schema", "table",
        F.array(F.concat("table", F.lit("_STAGING"))).alias("tables"),
        F.array(F.struct(F.lit("REJECTS").alias("table"), F.lit("ID").alias("column"))).alias("columns"),
    )
    edges = graph(spark, sf_dir, name="lineage-edges")
    return lineage.highlight(lineage.rule_targets(patterns), edges)
