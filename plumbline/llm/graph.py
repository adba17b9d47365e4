"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import fresh_path


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; a component is named by its smallest node.

    Rounds of large-star and small-star: every node hands the smallest of its neighbours to
    the larger ones, then to the smaller ones, until all point at the smallest of their
    component. Minima are combined before the shuffle; each round is a written table.
    """
    spark = links.sparkSession
    folder, turn, before = fresh_path(spark, "components"), 0, None
    edges = links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    while True:
        edges.write.parquet(f"{folder}/{turn}")
        edges = spark.read.schema("u long, v long").parquet(f"{folder}/{turn}")
        now = tuple(
            edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        )
        if now == before or not now[0]:
            break
        before, turn = now, turn + 1
        both = edges.select("u", "v").unionAll(edges.select(F.col("v"), F.col("u")))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = moved.unionAll(smallest.select("u", F.col("m").alias("v"))).distinct()
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(edges.select(F.col("v"), F.col("v")).distinct())
