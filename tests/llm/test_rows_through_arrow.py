"""Whole rows are not held back while Python is asked about their ids."""

from pyspark.sql import functions as F

from plumbline.llm import jaccard
from plumbline.llm.idfilter import known_ids
from plumbline.llm.rows import keep_rows

TEXT = "one two three four five six seven eight nine ten"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_representatives_ask_no_condition_of_whole_rows(documents):
    kept = jaccard.representatives(documents([(1, TEXT), (2, TEXT), (3, "other words in this one row"), (None, TEXT)]))
    assert "ArrowEvalPython" not in plan(kept) and "MapInArrow" in plan(kept)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]


def test_rows_are_kept_by_id_whatever_its_type_and_the_columns_names(spark):
    known = known_ids(spark.createDataFrame([(2,), (3,), (None,)], "x long"))
    rows = spark.createDataFrame([("2", 1, [1]), ("9", 2, None), (None, 3, []), ("7", 4, [2])], "`a.b` string, id int, c0 array<int>").toDF("doc_id", "id", "a.b")
    with_ids = keep_rows(rows, "doc_id", known)
    assert with_ids.columns == rows.columns and [tuple(r) for r in with_ids.collect()] == [("2", 1, [1])]
    assert sorted(r["id"] for r in keep_rows(rows, "doc_id", known, others=True).collect()) == [2, 3, 4]


def test_one_text_of_each_class_is_packed(spark):
    docs = spark.createDataFrame([(1, TEXT), (1, TEXT), (2, TEXT.upper()), (3, "a b c d e f"), (4, None)], "doc_id long, text string").coalesce(1)
    chosen = known_ids(docs.where("doc_id <> 3").select("doc_id"))
    found = docs.mapInArrow(jaccard._text_rows(chosen), "class long, packed binary")
    assert found.count() == 1 and found.where(F.col("class").isNull()).isEmpty()
