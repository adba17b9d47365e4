"""A filter of fixed size that tells which rows of a table can be left where they are.

Joins of whole texts with a few ids would shuffle all texts. A Bloom filter of the ids is sent
around instead: rows it does not know have no partner for sure, and only the others take part in
the join, which stays exact. Its size is the same for any number of ids; the more there are, the more
rows go the long way.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.kept import begin
from plumbline.llm.shingles import mixed

BITS = 1 << 26
SLICES = 64
_SALT = np.uint64(0x5851F42D4C957F2D)


def _places(ids: np.ndarray) -> np.ndarray:
    """Two bits of each id."""
    keys = ids.astype(np.int64).view(np.uint64)
    return np.concatenate([mixed(keys), mixed(keys ^ _SALT)]) & np.uint64(BITS - 1)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of a task's ids, in compressed slices."""
    begin("ids")
    bits = np.zeros(BITS >> 3, np.uint8)
    for batch in batches:
        at = _places(batch.column(0).drop_null().to_numpy())
        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
    if bits.any():
        parts = [zlib.compress(part.tobytes(), 1) for part in bits.reshape(SLICES, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "bits"])


def _united(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(b), np.uint8) for b in pdf["bits"]])
    return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "bits": [zlib.compress(total.tobytes(), 1)]})


def known_ids(ids: DataFrame) -> Callable[[], Callable[[pa.Array], np.ndarray]]:
    """From a table of one column of ids: what a task calls for a function that tells which ids may be in it.

    It holds for all ids of the table and for few others; NULL is none.
    """
    context = ids.sparkSession.sparkContext
    form = "slice int, bits binary"
    parts = ids.mapInArrow(_marked, form).withColumn("salt", F.pmod(F.xxhash64("bits"), F.lit(32)))
    # United in two steps, so no group grows with the tasks.
    rows = parts.groupBy("slice", "salt").applyInPandas(_united, form).groupBy("slice").applyInPandas(_united, form).collect()
    bits = np.zeros((SLICES, (BITS >> 3) // SLICES), np.uint8)
    for row in rows:
        bits[row["slice"]] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    known = context.broadcast(zlib.compress(bits.tobytes(), 1))

    def opened() -> Callable[[pa.Array], np.ndarray]:
        table = np.frombuffer(zlib.decompress(known.value), np.uint8)

        def might(ids: pa.Array) -> np.ndarray:
            at = _places(ids.fill_null(0).to_numpy(zero_copy_only=False))
            hit = (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            return hit.reshape(2, -1).all(axis=0) & ids.is_valid().to_numpy(zero_copy_only=False)

        return might

    return opened


def id_filter(ids: DataFrame) -> Callable[[Column], Column]:
    """From a table of one column of ids: a condition that holds for all of them, and for few others. NULL is none.

    Spark keeps rows in memory while the condition is asked for; for whole texts see ``known_ids``.
    """
    opened = known_ids(ids)

    @F.pandas_udf("boolean")
    def might(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = opened()
        for ids in values:
            yield pd.Series(held(pa.array(ids.to_numpy())))

    return lambda column: column.isNotNull() & might(F.coalesce(column.cast("long"), F.lit(0)))
