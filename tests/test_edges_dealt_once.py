"""Edges that are dealt for what reads them, and edges near one schema."""

from pyspark.sql import functions as F

from plumbline.operators import lineage


def dependencies(spark, rows):
    ends = [f"{p}_{c}" for p in ("referenced", "referencing") for c in ("database", "schema", "name")]
    return spark.createDataFrame(rows, ", ".join(f"{e} string" for e in ends)).withColumns(
        {f"{p}_domain": F.lit("TABLE") for p in ("referenced", "referencing")}
    )


ROWS = [
    ("D", "S", "t", "E", "S", "u"), ("E", "S", "u", "E", "S", "v"), ("D", "S", "t", "E", "S", "u"), ("E", "S", "v", "E", "S", "v"),
    ("D.S", None, "x", "E", "S", "u"), (None, "S", "t", "E", "S", "u"), ("D", "S", "", "E", "S", "u"), ("F", "S", "a", "D", "S2", "b"), ("E", "S", "v", "D", "S", "t"),
]


def test_walkable_dependencies_are_shuffled_once_by_source(spark, rows):
    raw = dependencies(spark, ROWS)
    ready, plain = lineage.walkable_dependencies(raw), lineage.walkable(lineage.edges_from_dependencies(raw))
    for a, b in ((ready.by_source, plain.by_source), (ready.by_target, plain.by_target)):
        assert rows(a) == rows(b)
    dealt = lineage.edges_from_dependencies(raw, parts=4).select(*lineage.EDGE_KEY)
    steps = dealt._jdf.queryExecution().executedPlan().toString()
    assert steps.count("Exchange") == 1 and "REPARTITION_BY_NUM" in steps


def test_edges_near_a_schema(spark, rows):
    raw = dependencies(spark, ROWS)
    none = spark.createDataFrame([], "fqn string, database string, schema string, table string, object_kind string, open_findings bigint, rules_run bigint, health_score double")
    near, every = lineage.edges_from_dependencies(raw, ("D", "S")), lineage.edges_from_dependencies(raw)
    for a, b in zip(lineage.schema_graph(near, none, "D", "S"), lineage.schema_graph(every, none, "D", "S")):
        assert rows(a) == rows(b)
    assert 0 < near.count() < every.count()


def test_a_source_of_other_databases_is_not_read(spark):
    far = dependencies(spark, ROWS).withColumns({"referenced_database": F.lit("PARTS"), "referencing_database": F.lit("SALES")})
    plan = lineage.edges_from_dependencies(far, ("SUPPLY", "N"))._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan
