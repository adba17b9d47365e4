"""Edges are dealt to more parts as their files grow, not to fewer and larger ones."""

from pyspark.sql import functions as F

from plumbline import session
from plumbline.operators import lineage
from test_edges_dealt_once import ROWS, dependencies


def test_parts_follow_the_files(spark, rows, tmp_path, monkeypatch):
    raw = dependencies(spark, ROWS)
    raw.coalesce(1).write.parquet(f"{tmp_path}/a b%20c")
    read = spark.read.parquet(f"{tmp_path}/a b%20c")
    monkeypatch.setattr(session, "PART_BYTES", 100)
    many = session.part_count(read)
    assert many > 8 and session.part_count(read.unionAll(read)) == many and session.part_count(raw) is None
    edges = lineage.edges_from_dependencies(read)
    assert edges.rdd.getNumPartitions() == many
    assert rows(edges) == rows(lineage.edges_from_dependencies(raw))
    monkeypatch.setattr(session, "MOST_PARTS", 9)
    assert session.part_count(read) == 9


def test_a_small_table_has_a_part_for_each_core(spark):
    read = spark.read.parquet("/root/testdata/sf0.001/nation.parquet").where(F.lit(True))
    assert session.part_count(read) == spark.sparkContext.defaultParallelism
