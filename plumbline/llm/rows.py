"""Whole rows through Arrow, whatever their columns are called."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.kept import begin


def map_rows(docs: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` that keeps the schema; only the column ``text`` keeps its name inside.

    Names with dots or quotes, which Spark would read as paths, are put aside meanwhile.
    """
    inner = [f.name if f.name == "text" else f"c{i}" for i, f in enumerate(docs.schema.fields)]
    schema = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(inner, docs.schema.fields)])
    return docs.toDF(*inner).mapInArrow(function, schema).toDF(*docs.columns)


def keep_rows(
    docs: DataFrame, column: str, known: Callable[[], Callable[[pa.Array], np.ndarray]], others: bool = False
) -> DataFrame:
    """The rows whose id, ``column`` as a long, ``known`` (see ``idfilter.known_ids``) lets through; with ``others`` all but these.

    Rows pass through Arrow in batches. With a condition, Spark would hold whole rows until Python has answered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("ids")
        might = known()
        for batch in batches:
            keep = might(batch.column(batch.num_columns - 1))
            yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array(~keep if others else keep, pa.bool_()))

    inner = [f"c{i}" for i in range(len(docs.columns))]
    schema = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(inner, docs.schema.fields)])
    named = docs.toDF(*inner).select("*", F.col(inner[docs.columns.index(column)]).cast("long").alias("id"))
    return named.mapInArrow(run, schema).toDF(*docs.columns)


@contextmanager
def few_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, jobs of the session read, and hand to Python workers, this many rows at a time."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
