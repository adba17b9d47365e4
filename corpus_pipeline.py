"""A document pipeline over the operators of ``plumbline.llm``.

Stages, in order: documents whose language cannot be told go; of each group of near
duplicates the one with the smallest id stays; documents that hold a benchmark item go;
personal data is replaced by marks; the rest is encoded. All stages but the last return
the columns of ``documents``; each works on the whole output of the one before, which is
written as Parquet and read again.

Defined cases: rows with a null or empty text go in the first stage; of repeated rows one
stays; rows without id are kept by the second and third stage, which name documents by id;
an empty table gives an empty result; other columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, jaccard, langid, pii
from plumbline.session import fresh_path

#: Least probability of the predicted language. The network knows four languages in the
#: test tables, so a guess has 0.25.
LEAST_SCORE = 0.4


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a determined language."""
    return langid.accepted(docs, langid.fit(docs), LEAST_SCORE)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; ``n_chars`` follows, where the table has it."""
    out = pii.redact_column(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select([F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: (doc_id, ids, n_tokens)."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = bpe.encode_documents(docs, path, public_tokenizers.PATTERN)
    return tokens.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language", identified),
    ("near_duplicates", deduplicated),
    ("benchmark", decontaminated),
    ("personal_data", redacted),
    ("encoding", encoded),
]

#: The language network cannot be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_path(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{number}-{name}")
    return docs
