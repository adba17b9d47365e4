"""What edges leave on disk: no shuffle files of ended writes, no second dealing, no tables of steps that are done."""

import os
import time
from datetime import datetime

import pytest
from plumbline import session
from plumbline.operators import lineage
from plumbline.plans import lineage_queries
from pyspark.sql import functions as F

TABLES = {
    "region": ("r_regionkey int, r_name string", [(0, "ASIA"), (1, None)]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "INDIA", 0), (1, "CHINA", 0), (2, "MOON", 1), (1, "CHINA", 0)]),
    "supplier": (
        "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
        # Names and keys come twice, also with another balance, so that kinds of one edge differ.
        [(1, "S1", 0, 5.0), (2, "S1", 0, -5.0), (3, "S3", 1, None), (3, "S3", 1, 7.0), (4, None, 1, 1.0), (None, "S5", 1, 1.0), (6, "S6", 2, 1.0)],
    ),
    "customer": (
        "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
        [(1, "C1", 0, 1.0, "BUILDING"), (2, "C1", 1, 1.0, "BUILDING"), (3, "C3", 1, 1.0, None), (None, "C4", 1, 1.0, "X"), (5, "C5", 2, 1.0, "")],
    ),
    "part": (
        "p_partkey long, p_brand string",
        [(1, "B.P2"), (2, "B"), (2, "B"), (3, None), (3, ""), (4, "A"), (4, "B"), (None, "B")],
    ),
    "orders": (
        "o_orderkey long, o_custkey long, o_orderpriority string",
        [(1, 1, "LOW"), (1, 2, "LOW"), (2, 3, "LOW"), (2, 3, "HIGH"), (3, None, None), (3, 5, ""), (None, 1, "LOW"), (4, 9, "LOW")],
    ),
}
LINES = [(o, p, s) for o in (1, 2, 3, 4, 5, None) for p in (1, 2, 3, 4, 5, None) for s in (1, 2, 3, 4, 6, 7, None) if (o or 0) + (p or 0) != 4] * 2


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("star"))
    for name, (schema, values) in TABLES.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    lines = spark.createDataFrame(LINES, "l_orderkey long, l_partkey long, l_suppkey long").withColumns(
        {"l_quantity": F.lit(1.0), "l_extendedprice": F.lit(1.0), "l_discount": F.lit(0.01), "l_tax": F.lit(0.01), "l_shipdate": F.lit(datetime(2020, 1, 2))}
    )
    lines.coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return path


def shuffles(spark):
    """Numbers of the shuffles that have files."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n.split("_")[1] for n in names if n.startswith("shuffle_")}


def test_shuffle_files_go_with_the_write(spark):
    before, setting = shuffles(spark), spark.conf.get(session.CLEANUP)
    many = spark.range(1000).repartition(3, "id").selectExpr("id", "id % 7 AS k").groupBy("k").agg(F.count("id").alias("n"))
    for table in (session.stored(many, "many"), session.bucketed(many, "many", ["k"])):
        assert sorted(tuple(r) for r in table.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]
        assert spark.conf.get(session.CLEANUP) == setting
    for _ in range(40):
        if not (left := shuffles(spark) - before):
            break
        time.sleep(0.25)
    assert not left


def test_the_setting_comes_back_after_a_failure(spark):
    setting = spark.conf.get(session.CLEANUP)
    with pytest.raises(Exception):
        session.stored(spark.range(3).select(F.raise_error(F.lit("no")).alias("x")), "broken")
    assert spark.conf.get(session.CLEANUP) == setting


def test_rows_that_lie_together_are_not_dealt_again(spark, rows):
    ends = [f"{p}_{c}" for p in ("referenced", "referencing") for c in ("database", "schema", "name", "domain")]
    values = [("D", s, "t", k, "E", "S", f"u{i % 5}", "VIEW", i % 5) for i in range(40) for s, k in ((None, "STAGE"), ("", "TABLE"), ("S", "TABLE"))]
    values += [(None, "S", "t", "TABLE", "E", "S", "u1", "VIEW", 1), ("D", "S", "", "TABLE", "E", "S", "u1", "VIEW", 1)]
    raw = spark.createDataFrame(values, ", ".join(f"{e} string" for e in ends) + ", k int")
    every = lineage.edges_from_dependencies(raw.drop("k"))
    some = lineage.edges_from_dependencies(raw.repartition(3, "k"), together="k")
    assert some.columns == every.columns and rows(some) == rows(every) and len(rows(some)) == 15
    assert rows(lineage.edges_from_dependencies(raw.repartition(3, "k"), ("D", "S"), together="k")) == rows(every.where("source_schema = 'S'"))
    steps = lineage.edges_from_dependencies(raw.repartition(3, "k"), together="k")._jdf.queryExecution().executedPlan().toString()
    assert steps.count("Exchange") == 1


def test_groups_make_the_same_edges(spark, rows, folder):
    together = lineage.edges_from_dependencies(lineage_queries._dependencies(spark, folder))
    expected = rows(together)
    assert len({r[0].split(".")[0] for r in expected}) == 5
    for made in (lineage_queries.graph(spark, folder), lineage_queries.graph(spark, folder, name="edges")):
        assert made.columns == together.columns and rows(made) == expected


def test_cards_leave_edges_and_overlays_only(spark, rows, folder):
    top = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(top))
    cards = lineage_queries.lineage_database_cards(spark, folder)
    assert {f.rpartition("-")[0] for f in set(os.listdir(top)) - before} == {"overlays", "lineage-edges"}
    edges = rows(lineage.edges_from_dependencies(lineage_queries._dependencies(spark, folder)).select(
        "source_database", "target_database", *[f"{p}_{c}" for p in ("source", "target") for c in ("schema", "table", "fqn")]
    ))
    ends = {(e[0], *e[2:5]) for e in edges} | {(e[1], *e[5:8]) for e in edges}
    for d, schemas, tables, touching, _ in cards.collect():
        assert tables == sum(e[0] == d for e in ends) and touching == sum(d in e[:2] for e in edges)
        assert schemas == len({e[1] for e in ends if e[0] == d and e[1] is not None})


def test_ends_with_unusual_names(spark, rows):
    sides = ", ".join(f"{p}_{c} string" for p in ("source", "target") for c in ("database", "schema", "table", "fqn", "kind"))
    a, b, c, d = ("D", "S", "t", "D.S.t", "view"), ("D", "S", "t", "other", None), ("D", "S", "t", None, "view"), ("D", None, "t", "D..t", "stage")
    edges = spark.createDataFrame([a + b, b + c, c + d, a + a, d + a], sides)
    ends = lineage.endpoints(edges)
    assert ends.columns == ["database", "schema", "table", "fqn", "kind"]
    assert rows(ends) == sorted([a, (*b[:4], "table"), c, d], key=repr)
    # A full name that its parts tell does not travel.
    steps = lineage.endpoints(edges.where("source_fqn = 'D.S.t'"))._jdf.queryExecution().executedPlan().toString()
    dealt = steps[steps.index("hashpartitioning(") :].split("\n")[0]
    assert "fqn" not in dealt.split("ENSURE")[0].replace("unusual", "")
