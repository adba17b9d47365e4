import random

import corpus_pipeline
from pyspark.sql import functions as F

from plumbline.llm import jaccard
from plumbline.llm.idfilter import id_filter

SF_DIR = "/root/testdata/sf0.001"


def test_run_is_the_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        if name != "encoding":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    expected = sorted((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in docs.collect())
    found = sorted((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, SF_DIR).collect())
    assert found == expected and 100 < len(found) < 200


def test_filtering_stages_keep_odd_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60)
    odd = docs.withColumn("a.b", F.lit(1)).withColumn("row", F.lit("r")).withColumn("_id", F.lit(2)).withColumn("_leaked", F.lit(3))
    for stage in (corpus_pipeline.deduplicated, corpus_pipeline.decontaminated, corpus_pipeline.redacted):
        plain, kept = stage(spark, docs, SF_DIR), stage(spark, odd, SF_DIR)
        assert kept.columns == odd.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in plain.collect())


def test_repeated_ids_with_different_texts_leave_one_row(documents):
    rows = [(5, "one two three four five six"), (5, "other words in this one row"), (6, "one two three four five six"), (None, "x y"), (None, "x y")]
    kept = jaccard.representatives(documents(rows)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["5", "None", "None"]


def test_filter_holds_for_all_ids(spark):
    rng = random.Random(1)
    ids = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(3000)] + [0, -1]
    others = [(i,) for i in range(1, 20001)]
    held = id_filter(spark.createDataFrame([(i,) for i in ids] + [(None,)], "x long"))
    assert spark.createDataFrame([(i,) for i in ids], "id long").where(held(F.col("id"))).count() == len(ids)
    assert spark.createDataFrame(others + [(None,)], "id long").where(held(F.col("id"))).count() < 20
    assert spark.range(100).where(id_filter(spark.createDataFrame([], "x long"))(F.col("id"))).count() == 0
