"""Extendible hashing: shards named by hash-prefix bits, split only where they are too large.

A document's address is the first 60 bits of the MD5 of its key. A shard is a prefix of
that address. Shard sizes are summed per prefix; a prefix whose bytes exceed the limit is
split on one more bit, all others stay as they are, so shards differ in depth. The
directory lists, for every shard, the slots it fills at the depth of the deepest one.

Only (key, byte count) is read and moved, never the texts, and sizes are pre-aggregated
per cell (a prefix a few bits deeper than the expected depth), so a source or key that
holds a third of all rows costs one counter per task. No size is brought to the driver
but the total and the number of cells that need more bits.

Defined cases: a null text counts 0 bytes and a null key is hashed as the empty text. Rows
with equal keys share an address and cannot be told apart by any bit; if they exceed the
limit by themselves, as a document longer than the limit does, they form a shard at the
full depth with ``fits`` false. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import fresh_path

ADDRESS_BITS = 60
#: Bits that cells are deeper than an even distribution of bytes would need.
SPARE_BITS = 6


def _address(key):
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, ADDRESS_BITS // 4), 16, 10).cast("long")


def _prefix(address, bits: int):
    return F.shiftright(address, ADDRESS_BITS - bits)


def directory(docs: DataFrame, max_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cells and the shard each belongs to: (bits, cell, depth, shard_bytes, fits).

    ``cell`` is the first ``bits`` bits of the addresses it covers. Cells that no prefix
    of theirs fits are looked at again with more bits, which reads only their own rows.
    """
    if max_bytes < 1:
        raise ValueError("max_bytes has to be positive")
    spark = docs.sparkSession
    sizes = docs.select(
        _address(F.col(key)).alias("address"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("bytes"),
    )
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    bits = min(ADDRESS_BITS, math.ceil(math.log2(max(total / max_bytes, 1))) + SPARE_BITS)
    done, start, path = None, 0, fresh_path(spark, "shard-cells")
    while True:
        cells = sizes.groupBy(_prefix(F.col("address"), bits).alias("cell")).agg(
            F.sum("bytes").alias("bytes")
        )
        levels = cells.select(
            "cell", "bytes", F.explode(F.sequence(F.lit(start), F.lit(bits))).alias("depth")
        ).withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"))
        chosen = (
            levels.join(sums, ["depth", "prefix"])
            .where((F.col("shard_bytes") <= max_bytes) | (F.col("depth") == bits))
            .groupBy("cell")
            .agg(F.min_by(F.struct("depth", "shard_bytes"), "depth").alias("best"))
            .select(
                F.lit(bits).alias("bits"),
                "cell",
                F.col("best.depth").alias("depth"),
                F.col("best.shard_bytes").alias("shard_bytes"),
                (F.col("best.shard_bytes") <= max_bytes).alias("fits"),
            )
        )
        chosen.write.parquet(f"{path}/{bits}")
        chosen = spark.read.schema(chosen.schema).parquet(f"{path}/{bits}")
        if bits == ADDRESS_BITS:
            return chosen if done is None else done.unionByName(chosen)
        ready = chosen.where("fits")
        done = ready if done is None else done.unionByName(ready)
        open_cells = chosen.where(~F.col("fits")).select("cell")
        if open_cells.isEmpty():
            return done
        sizes = sizes.join(
            open_cells, _prefix(F.col("address"), bits) == F.col("cell"), "left_semi"
        )
        start, bits = bits + 1, min(ADDRESS_BITS, bits + 12)


def slots(cells: DataFrame) -> DataFrame:
    """The directory by shard: its slots at the depth of the deepest shard."""
    shards = cells.select(
        F.expr("shiftright(cell, bits - depth)").alias("prefix"), "depth", "shard_bytes", "fits"
    ).distinct()
    global_depth = shards.agg(F.max("depth")).first()[0] or 0
    return shards.withColumn("global_depth", F.lit(global_depth)).select(
        _name(F.col("prefix"), F.col("depth")).alias("shard"),
        "depth",
        "global_depth",
        F.expr("shiftleft(prefix, global_depth - depth)").alias("first_slot"),
        F.expr("shiftleft(prefix + 1, global_depth - depth) - 1").alias("last_slot"),
        "shard_bytes",
        "fits",
    )


def _name(prefix, depth):
    return F.when(depth == 0, "").otherwise(F.lpad(F.bin(prefix), depth, F.lit("0")))


def assign(docs: DataFrame, max_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc, shard, depth, shard_bytes, fits), ``doc`` being its row."""
    cells = directory(docs, max_bytes, key, text)
    depths = [r[0] for r in cells.select("bits").distinct().collect()]  # at most five values
    rows = docs.select(F.struct("*").alias("doc"), _address(F.col(key)).alias("address"))
    candidates = F.array(
        *[F.struct(F.lit(b).alias("bits"), _prefix(F.col("address"), b).alias("cell")) for b in depths]
    )
    if not depths:
        candidates = F.array().cast("array<struct<bits:int,cell:bigint>>")
    return (
        rows.select("doc", F.explode(candidates).alias("at"))
        .select("doc", "at.bits", "at.cell")
        .join(cells, ["bits", "cell"])
        .select(
            "doc",
            _name(F.expr("shiftright(cell, bits - depth)"), F.col("depth")).alias("shard"),
            "depth",
            "shard_bytes",
            "fits",
        )
    )


def write_shards(docs: DataFrame, max_bytes: int, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Write one folder per shard below ``path``; the files hold the rows as column ``doc``."""
    placed = assign(docs, max_bytes, key, text).select("doc", F.concat(F.lit("b"), "shard").alias("shard"))
    placed.repartition("shard").write.partitionBy("shard").parquet(path)


def shards(docs: DataFrame, max_bytes: int) -> DataFrame:
    """``assign`` with the document id only."""
    return assign(docs, max_bytes).select("doc.doc_id", "shard", "depth", "shard_bytes", "fits")


