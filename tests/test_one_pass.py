"""Steps that are made once, and words that never move."""

from pyspark.sql import functions as F

from plumbline.operators import lineage, similarity


def edges(spark):
    rows = [("D", "S", "t", "E", "S", "u"), ("E", "S", "u", "E", "S", "v"), ("D", "S", "t", "E", "S", "u"), ("E", "S", "v", "E", "S", "v")]
    ends = [f"{p}_{c}" for p in ("referenced", "referencing") for c in ("database", "schema", "name")]
    raw = spark.createDataFrame(rows, ends).withColumns({f"{p}_domain": F.lit("TABLE") for p in ("referenced", "referencing")})
    return lineage.edges_from_dependencies(raw)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_edges_are_made_once(spark, rows):
    made = edges(spark)
    each = plan(made).count("LogicalRDD")
    assert each and plan(lineage.endpoints(made)).count("LogicalRDD") == each
    catalog = spark.createDataFrame([("D.S.t", "D", "S", "t")], "fqn string, database string, schema string, table string")
    ghosts = lineage.ghost_nodes(made, catalog)
    assert "referenced_name" not in plan(ghosts)
    assert rows(ghosts, "id") == [("E.S.u",), ("E.S.v",), ("db:E",), ("sc:E.S",)]


def test_edges_are_sorted_after_they_are_dealt(spark):
    steps = edges(spark)._jdf.queryExecution().executedPlan().toString()
    assert steps.count("Exchange") == 1
    assert "partial_min" not in steps[steps.index("Exchange") :]


def test_used_edges_stay_in_their_buckets(spark, rows):
    ready = lineage.walkable(edges(spark))
    used = lineage.lineage_walk(ready, "E.S.u", 2)[1]
    assert rows(used, "source_fqn", "target_fqn", "direction") == [("D.S.t", "E.S.u", "upstream"), ("E.S.u", "E.S.v", "downstream")]
    assert "target_fqn" in used.columns and "left_outer" not in plan(used).lower() and "LeftOuter" not in plan(used)


def test_words_of_one_side_do_not_move(spark, rows):
    sets = spark.createDataFrame(
        [("left", 1, 3, ["a", "b", "x"]), ("left", 2, 1, ["y"]), ("right", 3, 2, ["a", "b"])], "side string, word_key long, size int, words array<string>"
    )
    found = similarity._ranked(sets).select("side", "word_key", (F.size("ranked")).alias("n"))
    assert rows(found) == [("left", 1, 2), ("right", 3, 2)]
