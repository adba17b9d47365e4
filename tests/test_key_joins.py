"""What reaches the joins of key checks and inclusions: counters of a column, not its values."""

from plumbline.operators import checks, inclusion
from plumbline.operators.checks import build_check


def rows_of_joins(df):
    """The most rows that come out of a join of the plan that ran."""
    df.collect()
    found, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        else:
            below = node.children()
            todo += [below.apply(i) for i in range(below.size())]
        if "Join" in name:
            found.append(node.metrics().apply("numOutputRows").value())
    return max(found)


def tables(spark):
    child = spark.createDataFrame([(i if i % 10 else None, i % 700) for i in range(1000)], "id long, ref long")
    parent = spark.createDataFrame([(i,) for i in range(600)], "key long")
    return {"child": child, "parent": parent}


def test_key_checks(spark, rows):
    found = checks.scan(
        tables(spark),
        [
            build_check("uniqueness", "child", {"column": "id"}, rule="id"),
            build_check("uniqueness", "child", {"column": "ref"}, rule="ref"),
            build_check("referential_integrity", "child", {"column": "ref", "ref_table": "parent", "ref_column": "key"}, rule="parent"),
            build_check("referential_integrity", "child", {"column": "id", "ref_table": "parent", "ref_column": "key"}, rule="id_parent"),
        ],
    )
    assert rows(found, "rule", "fail_count", "total_count") == [("id", 0, 1000), ("id_parent", 360, 1000), ("parent", 100, 1000), ("ref", 600, 1000)]
    assert rows_of_joins(found) < 50


def test_orphans(spark, rows):
    index = inclusion.index_values(tables(spark), [("child", "id"), ("child", "ref"), ("parent", "key")])
    pairs = spark.createDataFrame([(0, 2), (1, 2), (2, 1)], "from_place int, to_place int")
    found = index.orphans(pairs)
    assert rows(found, "from_place", "to_place", "total", "orphans") == [(0, 2, 1000, 360), (1, 2, 1000, 100), (2, 1, 600, 0)]
    assert rows_of_joins(found) < 50
