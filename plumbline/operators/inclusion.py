"""Which columns hold which values, for many columns at once.

Every key column of every table goes into one table (place, value, n): the column's place in
a list of names, the value in a spelling that equal values of any type of a family share, and the
number of rows. Each table is scanned once for all its columns, and repeated values are
counted before the shuffle, so a value that fills a third of a table is one row per task.
Distinct counts, uniqueness and the inclusion of any pair of columns follow from this table by
one aggregation each; the number of pairs decides no plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import stored

#: Longer values are named by their digest.
LONGEST_VALUE = 64


def spelling(value: Column, kind: T.DataType) -> Column:
    """Equal values of one type family are spelled alike, values of different families never; NULL stays NULL.

    Families: numbers, texts, dates and timestamps, booleans, binary. A number is written without
    trailing zeros, a date as the timestamp of its midnight.
    """
    if isinstance(kind, T.IntegralType):
        tag, text = "n", value.cast("string")
    elif isinstance(kind, T.DecimalType):
        tag, text = "n", F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    elif isinstance(kind, T.FractionalType):
        number = value.cast("double")
        whole = (number == F.floor(number)) & (F.abs(number) < 2**53)
        tag, text = "n", F.when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string"))
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        tag, text = "d", value.cast("timestamp_ntz").cast("string")
    elif isinstance(kind, T.BooleanType):
        tag, text = "b", value.cast("string")
    elif isinstance(kind, T.BinaryType):
        tag, text = "x", F.hex(value)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        tag, text = "j", F.to_json(F.struct(value.alias("v")))
    else:
        tag, text = "t", value.cast("string")
    short = F.concat(F.lit(tag), text)
    long = F.concat(F.lit(f"{tag}#"), F.sha2(text, 256))
    # A short text that looks like the digest of a long one would have to be longer than it may.
    return F.when(value.isNotNull(), F.when(F.length(text) > LONGEST_VALUE, long).otherwise(short))


def key_spelling(df: DataFrame, columns: Sequence[str]) -> Column:
    """The spelling of a column, or of a tuple of columns, which is NULL if one of them is."""
    parts = [spelling(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns]
    if len(parts) == 1:
        return parts[0]
    complete = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    tuple_ = F.to_json(F.array(*parts))
    return F.when(complete, F.concat(F.lit("k"), F.when(F.length(tuple_) > LONGEST_VALUE, F.sha2(tuple_, 256)).otherwise(tuple_)))


def value_counts(tables: Mapping[str, DataFrame], names: Sequence[tuple[str, str | tuple[str, ...]]]) -> DataFrame:
    """(place, value, n) of the columns ``names``, which are (table, column or tuple of columns); NULL is a value too."""
    parts = []
    for table in dict.fromkeys(t for t, _ in names):
        df = tables[table]
        cells = [
            F.struct(
                F.lit(place).alias("place"),
                key_spelling(df, [columns] if isinstance(columns, str) else columns).alias("value"),
            )
            for place, (t, columns) in enumerate(names)
            if t == table
        ]
        parts.append(df.select(F.inline(F.array(*cells))))
    return reduce(DataFrame.unionByName, parts).groupBy("place", "value").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class ValueIndex:
    """The stored value counts of some columns."""

    counts: DataFrame
    names: tuple[tuple[str, str], ...]

    @property
    def spark(self) -> SparkSession:
        return self.counts.sparkSession

    def places(self) -> DataFrame:
        """(place, table, column); metadata."""
        rows = [(i, *name) for i, name in enumerate(self.names)]
        return self.spark.createDataFrame(rows, "place int, table string, column string")

    def statistics(self) -> DataFrame:
        """(place, total, non_null, distinct_count), also of columns without rows."""
        counted = self.counts.groupBy("place").agg(
            F.sum("n").alias("total"),
            F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("non_null"),
            F.count("value").alias("distinct_count"),
        )
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("total", "non_null", "distinct_count")}
        return self.places().select("place").join(counted, "place", "left").withColumns(zero)

    def uniqueness(self) -> DataFrame:
        """(table, column, ratio): distinct values per row."""
        ratio = F.coalesce(F.col("distinct_count") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
        return self.places().join(self.statistics(), "place").select("table", "column", ratio.alias("ratio"))

    def matched(self, pairs: DataFrame) -> DataFrame:
        """(from_place, to_place, matched): rows of the first column whose value the second one has, where there are any.

        A value's holders are at most the columns of the index, so they fit into one row.
        """
        parents = pairs.groupBy(F.col("from_place").alias("place")).agg(F.collect_set("to_place").alias("parents"))
        holders = (
            self.counts.where("value IS NOT NULL")
            .groupBy("value")
            .agg(F.collect_list(F.struct("place", "n")).alias("holders"))
            .where(F.size("holders") > 1)
        )
        # Values with the same holders count as one: joined singly, a column's values would all meet in one task.
        children = (
            holders.select(F.array_sort("holders.place").alias("known"), F.inline("holders"))
            .groupBy("place", "known")
            .agg(F.sum("n").alias("n"))
        )
        met = children.join(parents, "place").select(
            F.col("place").alias("from_place"), "n", F.explode(F.array_intersect("known", "parents")).alias("to_place")
        )
        return met.groupBy("from_place", "to_place").agg(F.sum("n").alias("matched"))

    def orphans(self, pairs: DataFrame) -> DataFrame:
        """``pairs(from_place, to_place, …)`` plus total rows of the first column and orphans.

        An orphan is a row with a value that the second column does not have; NULL is none.
        """
        counts = self.statistics().select(F.col("place").alias("from_place"), "total", "non_null")
        kept = stored(pairs, "column-pairs")
        return (
            kept.join(counts, "from_place")
            .join(self.matched(kept.select("from_place", "to_place")), ["from_place", "to_place"], "left")
            .withColumn("orphans", F.col("non_null") - F.coalesce("matched", F.lit(0)))
            .drop("non_null", "matched")
        )


def index_values(tables: Mapping[str, DataFrame], names: Sequence[tuple[str, str]]) -> ValueIndex:
    """Count the values of the columns ``names`` and store the counts."""
    return ValueIndex(stored(value_counts(tables, names), "value-counts"), tuple(names))


def inclusions(index: ValueIndex, most_orphans: float = 0.0) -> DataFrame:
    """(from_table, from_column, to_table, to_column, total, orphans) of all pairs of columns where the second holds the first.

    Found from the values alone, whatever the columns are called. Columns without a value are
    in no pair. ``most_orphans`` is the share of the filled rows that may have no match.
    """
    every = index.matched(_all_pairs(index))
    counts = index.statistics().where("non_null > 0").select(F.col("place").alias("from_place"), "total", "non_null")
    kept = every.join(counts, "from_place").withColumn("orphans", F.col("non_null") - F.col("matched"))
    kept = kept.where(F.col("orphans") <= F.col("non_null") * F.lit(most_orphans))
    ends = [
        index.places().select(F.col("place").alias(f"{side}_place"), F.col("table").alias(f"{side}_table"), F.col("column").alias(f"{side}_column"))
        for side in ("from", "to")
    ]
    return kept.join(ends[0], "from_place").join(ends[1], "to_place").select(
        "from_table", "from_column", "to_table", "to_column", "total", "orphans"
    )


def _all_pairs(index: ValueIndex) -> DataFrame:
    """All ordered pairs of columns; metadata."""
    n = len(index.names)
    rows = [(a, b) for a in range(n) for b in range(n) if a != b]
    return index.spark.createDataFrame(rows, "from_place int, to_place int")
