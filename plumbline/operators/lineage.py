"""Lineage graphs as an edge table and a catalog table.

An edge has source_ and target_ database, schema, table, fqn and kind, and an
edge_type. The graph is never collected: walks are iterated joins of bucketed edges,
whose frontier is written to the shared folder after each hop.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import policy
from plumbline.session import bucket_count, bucketed, dealt, part_count, stored

EDGE_KEY = ("source_fqn", "target_fqn", "edge_type")


def normal_kind(domain: Column) -> Column:
    """Object kind of a catalog domain; an unknown domain keeps its name in lower case."""
    upper = F.upper(domain)
    chain = F.when(F.coalesce(domain, F.lit("")) == "", "table")
    for name, kind in policy.OBJECT_KINDS.items():
        chain = chain.when(upper == name, kind)
    return chain.otherwise(F.lower(domain))


def edge_type(source_domain: Column, target_domain: Column) -> Column:
    """What an edge does, judged by the objects at its ends."""
    source = F.upper(F.coalesce(source_domain, F.lit("")))
    target = F.upper(F.coalesce(target_domain, F.lit("")))
    return (
        F.when(F.contains(source, F.lit("STAGE")) | F.contains(source, F.lit("EXTERNAL LOCATION")), "copy_into")
        .when(F.contains(target, F.lit("DYNAMIC")), "dynamic_table")
        .when(F.contains(target, F.lit("MATERIALIZED VIEW")), "materialized_view")
        .when(F.contains(target, F.lit("VIEW")), "view_dep")
        .otherwise("data_flow")
    )


def fqn(database: Column, schema: Column, table: Column) -> Column:
    return F.concat_ws(".", database, F.coalesce(schema, F.lit("")), table)


def dedupe_edges(edges: DataFrame, order_by: str | None = None) -> DataFrame:
    """One edge per (source, target, type); the last by ``order_by`` wins.

    Without an order, and among equals, the smallest values of the other columns win.
    """
    rest = [c for c in edges.columns if c not in EDGE_KEY]
    if not rest:
        return edges.distinct()
    if order_by is not None:
        newest = edges.groupBy(*EDGE_KEY).agg(F.max(order_by).alias("__last"))
        edges = edges.join(newest, list(EDGE_KEY)).where(F.col(order_by).eqNullSafe(F.col("__last")))
    return _smallest(edges, rest)


def _smallest(edges: DataFrame, rest: list[str], *together: str) -> DataFrame:
    """The smallest values of ``rest`` of each edge, whose rows are alike in ``together``."""
    # Names begin alike; a number in front of them makes the sort by names short.
    return edges.groupBy(*together, F.xxhash64(*EDGE_KEY).alias("__h"), *EDGE_KEY).agg(F.min(F.struct(*rest)).alias("e")).select(
        *EDGE_KEY, *[F.col(f"e.{c}").alias(c) for c in rest]
    )


def edges_from_dependencies(
    dependencies: DataFrame, near: tuple[str, str] | None = None, parts: int | None = None, together: str | None = None
) -> DataFrame:
    """Edges referenced -> referencing; rows without a database or a name are dropped.

    Where rows of one edge disagree about its kinds, the smallest (source kind, target
    kind, edge type) counts. With ``near``, a database and a schema, edges with both ends elsewhere
    may be missing. With ``parts``, edges are dealt by their source to as many partitions; else to
    partitions of a size that does not grow with the files they come from. ``together`` names a column
    that is the same for all rows of an edge and by which the rows are dealt already: they stay where they are.
    """

    def side(prefix: str, alias: str) -> list[Column]:
        db, sc, tb = (F.col(f"{prefix}_{c}") for c in ("database", "schema", "name"))
        return [
            db.alias(f"{alias}_database"),
            sc.alias(f"{alias}_schema"),
            tb.alias(f"{alias}_table"),
            fqn(db, sc, tb).alias(f"{alias}_fqn"),
            normal_kind(F.col(f"{prefix}_domain")).alias(f"{alias}_kind"),
        ]

    complete = reduce(
        lambda a, b: a & b,
        [
            F.coalesce(F.col(c), F.lit("")) != ""
            for c in ("referenced_database", "referenced_name", "referencing_database", "referencing_name")
        ],
    )
    # Dealt by the edge before names are put together: fewer columns travel, and a row is sorted among its like only.
    ends = [fqn(*[F.col(f"{p}_{c}") for c in ("database", "schema", "name")]) for p in ("referenced", "referencing")]
    rows = dependencies.where(complete if near is None else complete & _may_touch(ends, ".".join(near)))
    columns = [
        *side("referenced", "source"),
        *side("referencing", "target"),
        edge_type(F.col("referenced_domain"), F.col("referencing_domain")).alias("edge_type"),
    ]
    if together is not None:
        edges = rows.select(F.col(together).alias("__together"), *columns)
        return _smallest(edges, [c for c in edges.columns if c not in ("__together", *EDGE_KEY)], "__together")
    shares = dealt(rows, ends, part_count(dependencies)) if parts is None else rows.repartition(parts, ends[0])
    return dedupe_edges(shares.select(*columns))


def _may_touch(ends: list[Column], prefix: str) -> Column:
    """Whether one of the full names begins with ``prefix``: all rows of an edge are alike in that.

    Said of the database first, which often is the same for a whole source of dependencies.
    """

    def side(end: Column, database: Column) -> Column:
        could = F.startswith(F.lit(prefix), database) | F.startswith(database, F.lit(prefix))
        return could & F.startswith(end, F.lit(prefix))

    return side(ends[0], F.col("referenced_database")) | side(ends[1], F.col("referencing_database"))


def without_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("source_fqn") != F.col("target_fqn"))


@dataclass(frozen=True)
class WalkableEdges:
    """Edges stored twice, in buckets by source and by target.

    A hop joins the table whose buckets fit: the edges stay where they are, and only the
    nodes that the hop starts from and those that it finds are shuffled.
    """

    by_source: DataFrame
    by_target: DataFrame


def walkable(edges: DataFrame) -> WalkableEdges:
    """Store edges for walks; one stored form serves any number of them."""
    return _both_ways(bucketed(edges.select(*EDGE_KEY), "edges-by-source", ["source_fqn"]))


def walkable_dependencies(dependencies: DataFrame) -> WalkableEdges:
    """``walkable`` of ``edges_from_dependencies``, which deals the edges as the first table needs them."""
    parts = bucket_count(dependencies.sparkSession)
    edges = edges_from_dependencies(dependencies, parts=parts).select(*EDGE_KEY)
    return _both_ways(bucketed(edges, "edges-by-source", ["source_fqn"], dealt=True))


def _both_ways(by_source: DataFrame) -> WalkableEdges:
    return WalkableEdges(by_source, bucketed(by_source, "edges-by-target", ["target_fqn"]))


def _walk(links: DataFrame, here: str, there: str, start: DataFrame, closed: list[DataFrame], hops: int) -> list[DataFrame]:
    """Stored frontiers (fqn, depth), one per hop that found something new.

    ``links`` is bucketed by ``here``; ``closed`` are nodes that the walk does not enter. Frontiers
    are bucketed too, so leaving out what is known shuffles only what the hop has found.
    """
    found: list[DataFrame] = []
    frontier = start
    for depth in range(1, hops + 1):
        reached = (
            links.join(frontier.select(F.col("fqn").alias(here)), here, "left_semi")
            .select(F.col(there).alias("fqn"))
            .distinct()
        )
        for known in [*closed, *found]:
            reached = reached.join(known.select("fqn"), "fqn", "left_anti")
        frontier = bucketed(reached.withColumn("depth", F.lit(depth)), "frontier", ["fqn"])
        if frontier.isEmpty():
            break
        found.append(frontier)
    return found


def lineage_walk(edges: DataFrame | WalkableEdges, focus: str, hops: int = 3) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within ``hops`` of a table; the walk ends early where nothing new is found.

    Nodes: fqn, depth, direction. The upstream side is walked first, and a node
    both sides reach belongs to it. Edges: the key and the side that uses them.
    For several walks give the edges as ``walkable``, which are then stored once.
    """
    if hops <= 0:
        raise ValueError("hops must be positive")
    ready = edges if isinstance(edges, WalkableEdges) else walkable(edges)
    start = ready.by_source.sparkSession.createDataFrame([(focus, 0)], "fqn string, depth int")
    up = _walk(ready.by_target, "target_fqn", "source_fqn", start, [start], hops)
    down = _walk(ready.by_source, "source_fqn", "target_fqn", start, [start, *up], hops)
    tagged = [start.withColumn("direction", F.lit("focus"))]
    tagged += [f.withColumn("direction", F.lit("upstream")) for f in up]
    tagged += [f.withColumn("direction", F.lit("downstream")) for f in down]
    nodes = reduce(DataFrame.unionByName, tagged)

    def expanded(side: str, name: str) -> DataFrame:
        inner = nodes.where(F.col("direction").isin("focus", side) & (F.col("depth") < hops))
        return inner.select(F.col("fqn").alias(name))

    def used(links: DataFrame, name: str, side: str) -> DataFrame:
        return without_self_loops(links).join(expanded(side, name), name, "left_semi").select(*EDGE_KEY, F.lit(side).alias("direction"))

    # As in a hop, each side reads the table whose buckets fit.
    upstream, downstream = used(ready.by_target, "target_fqn", "upstream"), used(ready.by_source, "source_fqn", "downstream")
    others = downstream.join(expanded("upstream", "target_fqn"), "target_fqn", "left_anti")
    return nodes, upstream.unionByName(others)


def overlays(catalog: DataFrame, open_findings: DataFrame, rules_run: DataFrame, scores: DataFrame) -> DataFrame:
    """Catalog tables with open findings, rules run and health score, by fqn."""
    return (
        catalog.where(F.col("table").isNotNull())
        .join(open_findings.select("fqn", "open_findings"), "fqn", "left")
        .join(rules_run.select("fqn", "rules_run"), "fqn", "left")
        .join(scores.select("fqn", "health_score"), "fqn", "left")
        .na.fill(0, ["open_findings", "rules_run"])
    )


def nested_graph(catalog: DataFrame, overlaid: DataFrame) -> DataFrame:
    """Database, schema and table nodes with parent, counts, open findings and mean health.

    Tables are first reduced to one row per schema; the rollup then works on those.
    """
    per_schema = overlaid.groupBy("database", "schema").agg(
        F.count(F.lit(1)).alias("tables"),
        F.sum("open_findings").alias("open_findings"),
        F.sum("health_score").alias("health_sum"),
        F.count("health_score").alias("health_n"),
    )
    schemas = catalog.where(F.col("schema").isNotNull()).select("database", "schema").distinct()
    zero = F.lit(0)
    containers = (
        schemas.join(per_schema, ["database", "schema"], "left")
        .rollup("database", "schema")
        .agg(
            F.grouping("schema").alias("is_database"),
            F.coalesce(F.sum("tables"), zero).alias("table_count"),
            F.count(F.lit(1)).alias("schema_count"),
            F.coalesce(F.sum("open_findings"), zero).alias("open_findings"),
            (F.sum("health_sum") / F.nullif(F.sum("health_n"), zero)).alias("health_score"),
        )
        .where(F.col("database").isNotNull())
    )
    is_db = F.col("is_database") == 1
    boxes = containers.select(
        F.when(is_db, F.concat(F.lit("db:"), "database"))
        .otherwise(F.concat(F.lit("sc:"), "database", F.lit("."), "schema"))
        .alias("id"),
        F.when(~is_db, F.concat(F.lit("db:"), "database")).alias("parent_id"),
        F.when(is_db, F.col("database")).otherwise(F.col("schema")).alias("label"),
        F.when(is_db, "database").otherwise("schema").alias("kind"),
        F.col("table_count"),
        F.when(is_db, F.col("schema_count")).alias("schema_count"),
        F.col("open_findings"),
        F.col("health_score"),
    )
    leaves = overlaid.select(
        F.col("fqn").alias("id"),
        F.concat(F.lit("sc:"), "database", F.lit("."), "schema").alias("parent_id"),
        F.col("table").alias("label"),
        F.col("object_kind").alias("kind"),
        F.lit(None).cast("bigint").alias("table_count"),
        F.lit(None).cast("bigint").alias("schema_count"),
        F.col("open_findings"),
        F.col("health_score"),
    )
    return boxes.unionByName(leaves)


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct (database, schema, table, fqn, kind) at either end of an edge."""

    def side(name: str) -> Column:
        return F.struct(
            *[F.col(f"{name}_{c}").alias(c) for c in ("database", "schema", "table", "fqn")],
            F.coalesce(f"{name}_kind", F.lit("table")).alias("kind"),
        )

    # Both ends from one pass: the edges may be long to make. A full name travels only where its parts do not tell it.
    usual = fqn(F.col("database"), F.col("schema"), F.col("table"))
    return (
        edges.select(F.inline(F.array(side("source"), side("target"))))
        .groupBy("database", "schema", "table", F.when(~F.col("fqn").eqNullSafe(usual), F.struct("fqn")).alias("unusual"))
        .agg(F.min("kind").alias("kind"))
        .select("database", "schema", "table", F.when(F.col("unusual").isNull(), usual).otherwise(F.col("unusual.fqn")).alias("fqn"), "kind")
    )


def ghost_nodes(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """Endpoints the catalog does not know, with the schemas and databases they lie in.

    A schema or database box is external too if the catalog has no object in it.
    ``catalog`` has fqn and table, and database and schema where boxes are wanted.
    """
    complete = F.col("database").isNotNull() & F.col("schema").isNotNull() & F.col("table").isNotNull()
    unknown = (
        endpoints(edges).where(complete).join(catalog.where(F.col("table").isNotNull()).select("fqn"), "fqn", "left_anti")
    )
    schema_id = F.concat(F.lit("sc:"), "database", F.lit("."), "schema")
    database_id = F.concat(F.lit("db:"), "database")
    external = F.lit(True).alias("is_external")

    def leaves(ends: DataFrame) -> DataFrame:
        return ends.select(F.col("fqn").alias("id"), schema_id.alias("parent_id"), F.col("table").alias("label"), "kind", external)

    if not {"database", "schema"} <= set(catalog.columns):
        return leaves(unknown)
    # Three steps read them.
    unknown = stored(unknown, "unknown-ends")
    tables = leaves(unknown)
    places = unknown.select("database", "schema").distinct()
    schemas = places.join(catalog.select("database", "schema"), ["database", "schema"], "left_anti").select(
        schema_id.alias("id"), database_id.alias("parent_id"), F.col("schema").alias("label"), F.lit("schema").alias("kind"), external
    )
    databases = (
        places.select("database").distinct().join(catalog.select("database"), "database", "left_anti").select(
            database_id.alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("database").alias("label"),
            F.lit("database").alias("kind"), external,
        )
    )
    return tables.unionByName(schemas).unionByName(databases)


def schema_graph(edges: DataFrame, overlaid: DataFrame, database: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one schema: all its tables and the direct neighbours."""

    def inside(side: str) -> Column:
        return (F.col(f"{side}_database") == database) & (F.col(f"{side}_schema") == schema)

    touching = edges.where(inside("source") | inside("target"))
    own = overlaid.where((F.col("database") == database) & (F.col("schema") == schema))
    neighbours = endpoints(touching).join(own.select("fqn"), "fqn", "left_anti")
    details = ["open_findings", "rules_run", "health_score"]
    known = neighbours.join(overlaid.select("fqn", *details), "fqn", "left").na.fill(
        0, ["open_findings", "rules_run"]
    )
    columns = ["fqn", "database", "schema", "table"]
    nodes = own.select(*columns, F.col("object_kind").alias("kind"), *details, F.lit(False).alias("is_external"))
    nodes = nodes.unionByName(known.select(*columns, "kind", *details, F.lit(True).alias("is_external")))
    return nodes, without_self_loops(touching).select(*EDGE_KEY)


def database_cards(catalog: DataFrame, edges: DataFrame, overlaid: DataFrame) -> DataFrame:
    """Schemas, tables, edges touching it and mean health of each database."""
    per_schema = catalog.groupBy("database", "schema").agg(F.count("table").alias("tables"))
    sizes = per_schema.groupBy("database").agg(
        F.count("schema").alias("schema_count"), F.sum("tables").alias("table_count")
    )
    ends = edges.select(
        F.explode(F.array_distinct(F.array("source_database", "target_database"))).alias("database")
    )
    counts = ends.groupBy("database").agg(F.count(F.lit(1)).alias("edge_count"))
    health = overlaid.groupBy("database").agg(F.avg("health_score").alias("avg_health_score"))
    return sizes.join(counts, "database", "left").join(health, "database", "left").na.fill(0, ["edge_count"])


def rule_targets(patterns: DataFrame) -> DataFrame:
    """Distinct (database, schema, table) a saved set of rules points at.

    ``patterns``: database, schema, table, tables array<string> and columns
    array<struct<table, column>> of the target configuration.
    """
    places = F.array_union(
        F.array(F.col("table")),
        F.array_union(
            F.coalesce("tables", F.array().cast("array<string>")),
            F.coalesce(F.transform("columns", lambda c: c["table"]), F.array().cast("array<string>")),
        ),
    )
    return (
        patterns.select("database", "schema", F.explode(places).alias("table"))
        .where(F.col("database").isNotNull() & F.col("schema").isNotNull() & F.col("table").isNotNull())
        .distinct()
    )


def highlight(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """Targets with ``matched``: do they occur on any edge. Without edges all match."""
    present = endpoints(edges).select("database", "schema", "table").distinct().withColumn("__hit", F.lit(True))
    if edges.isEmpty():
        return targets.withColumn("matched", F.lit(True))
    return targets.join(present, ["database", "schema", "table"], "left").select(
        "database", "schema", "table", F.coalesce("__hit", F.lit(False)).alias("matched")
    )
