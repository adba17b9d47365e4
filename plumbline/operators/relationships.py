"""Foreign-key discovery from names, types, uniqueness and orphan rates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline import policy
from plumbline.functions.naming import key_name, own_key_names, types_joinable
from plumbline.functions.time import AsOf, hours_before
from plumbline.operators.inclusion import index_values
from plumbline.policy import NamingPolicy

PAIR = ("from_table", "from_column", "to_table", "to_column")


def classify_keys(columns_meta: DataFrame, naming: NamingPolicy = NamingPolicy()) -> DataFrame:
    """columns_meta plus key_name, is_key_shaped and is_fk_shaped (not the table's own key)."""
    named = columns_meta.withColumn("key_name", key_name(F.col("column"), naming))
    own = own_key_names(F.col("table"))
    return named.withColumn("is_key_shaped", F.col("key_name").rlike(naming.key_shape)).withColumn(
        "is_fk_shaped",
        F.col("key_name").rlike(naming.foreign_key_shape) & ~F.array_contains(own, F.col("key_name")),
    )


def _key_columns(keys: DataFrame, condition: str) -> list[tuple[str, str]]:
    """Names of columns, which are metadata and decide what is scanned."""
    rows = keys.where(condition).select("table", "column").distinct().collect()
    return sorted((r["table"], r["column"]) for r in rows)


def uniqueness_ratios(tables: Mapping[str, DataFrame], keys: DataFrame) -> DataFrame:
    """(table, column, ratio): distinct values per row of every key-shaped column.

    ``keys`` is metadata. Each table is read once, whatever the number of its keys.
    """
    return index_values(tables, _key_columns(keys, "is_key_shaped")).uniqueness()


def key_owners(keys: DataFrame, ratios: DataFrame) -> DataFrame:
    """(key_name, table, column, ratio): the table where a key name is most unique, if it is at all.

    Relative uniqueness tells an owner from the tables that refer to it, even if
    the owner has some duplicates. Equal ratios go to the first table by name.
    """
    named = ratios.join(keys.select("table", "column", "key_name", "data_type"), ["table", "column"])
    best = named.groupBy("key_name").agg(
        F.min_by(F.struct("table", "column", "data_type", "ratio"), F.struct(-F.col("ratio"), F.col("table"))).alias("o")
    )
    return best.select("key_name", "o.table", "o.column", "o.data_type", "o.ratio").where(
        F.col("ratio") >= policy.MIN_OWNER_RATIO
    )


def _foreign(keys: DataFrame) -> DataFrame:
    return keys.where("is_fk_shaped").select(
        F.col("table").alias("from_table"),
        F.col("column").alias("from_column"),
        F.col("data_type").alias("from_type"),
        "key_name",
    )


def exact_candidates(keys: DataFrame, owners: DataFrame) -> DataFrame:
    """A foreign-key name that another table owns."""
    target = owners.select(
        "key_name",
        F.col("table").alias("to_table"),
        F.col("column").alias("to_column"),
        F.col("data_type").alias("to_type"),
    )
    return (
        _foreign(keys)
        .join(target, "key_name")
        .where(F.col("from_table") != F.col("to_table"))
        .select(*PAIR, "from_type", "to_type", F.lit(0).alias("priority"))
    )


def prefix_candidates(keys: DataFrame, owners: DataFrame, self_references: bool = False) -> DataFrame:
    """``CUSTOMER_ID`` -> the bare key of table CUSTOMER or CUSTOMERS, unless both exist."""
    tables = keys.select("table").distinct().select(
        F.col("table").alias("to_table"), F.upper("table").alias("table_name")
    )
    stem = F.regexp_replace("key_name", r"(_ID|_KEY|_REF)$", "")
    wanted = (
        _foreign(keys)
        .where(F.col("key_name").rlike(r".(_ID|_KEY|_REF)$"))
        .withColumn("stem", stem)
        .withColumn("table_name", F.explode(F.array(F.col("stem"), F.concat("stem", F.lit("S")))))
        .join(tables, "table_name")
    )
    found = F.count(F.lit(1)).over(W.partitionBy("from_table", "from_column"))
    single = wanted.withColumn("found", found).where(F.col("found") == 1)
    bare = owners.where(F.col("key_name").isin(*policy.BARE_KEY_NAMES)).select(
        F.col("table").alias("to_table"), F.col("column").alias("to_column"), F.col("data_type").alias("to_type")
    )
    if not self_references:
        single = single.where(F.col("from_table") != F.col("to_table"))
    return single.join(bare, "to_table").select(*PAIR, "from_type", "to_type", F.lit(1).alias("priority"))


def candidates(keys: DataFrame, owners: DataFrame) -> DataFrame:
    """Exact and prefix candidates, each pair once; type_ok tells whether they can be joined."""
    both = exact_candidates(keys, owners).unionByName(prefix_candidates(keys, owners))
    once = both.groupBy(*PAIR).agg(
        F.min("priority").alias("priority"), F.first("from_type").alias("from_type"), F.first("to_type").alias("to_type")
    )
    return once.select(
        *PAIR,
        "from_type",
        "to_type",
        F.when(F.col("priority") == 0, "exact").otherwise("prefix").alias("match"),
        types_joinable(F.col("from_type"), F.col("to_type")).alias("type_ok"),
    )


def discover(
    tables: Mapping[str, DataFrame],
    columns_meta: DataFrame,
    naming: NamingPolicy = NamingPolicy(),
) -> DataFrame:
    """The relationship catalog with the orphan rate of every candidate that can be joined.

    Each table is scanned once for the values of all its key columns. Owners, candidates and
    orphan rates all follow from these counts: a candidate is a row, not a branch of the plan.
    """
    keys = classify_keys(columns_meta, naming)
    index = index_values(tables, _key_columns(keys, "is_key_shaped OR is_fk_shaped"))
    shaped = keys.where("is_key_shaped").select("table", "column")
    owners = key_owners(keys, index.uniqueness().join(shaped, ["table", "column"], "left_semi"))
    listed = candidates(keys, owners)
    places = [
        index.places().select(
            F.col("table").alias(f"{side}_table"), F.col("column").alias(f"{side}_column"), F.col("place").alias(f"{side}_place")
        )
        for side in ("from", "to")
    ]
    placed = listed.join(places[0], ["from_table", "from_column"]).join(places[1], ["to_table", "to_column"])
    counted = index.orphans(placed.select(*PAIR, "type_ok", "from_place", "to_place"))
    fits, empty = F.col("type_ok"), F.col("total") == 0
    rate = F.col("orphans") / F.nullif(F.col("total"), F.lit(0))
    return counted.select(
        *PAIR,
        F.when(~fits | (rate >= policy.ORPHAN_REJECT_RATE), "rejected").otherwise("confirmed").alias("status"),
        F.when(~fits, "type_mismatch").when(empty, "name_match_unverified").otherwise("verified").alias("confidence"),
        F.when(fits, rate).alias("orphan_rate"),
        F.when(fits & ~empty, F.col("total")).alias("sample_total"),
        F.when(fits & ~empty, F.col("orphans")).alias("sample_orphans"),
    )


def catalog_is_fresh(relationships: DataFrame, tables: DataFrame, as_of: AsOf, hours: int = 24) -> DataFrame:
    """(table, fresh): is a table covered and was its oldest relationship verified recently.

    ``relationships`` has from_table, to_table, last_verified_at.
    """
    covered = (
        relationships.select(
            F.explode(F.array("from_table", "to_table")).alias("table"), "last_verified_at"
        )
        .groupBy("table")
        .agg(F.min("last_verified_at").alias("oldest"))
    )
    return tables.select("table").distinct().join(covered, "table", "left").select(
        "table", F.coalesce(F.col("oldest") > hours_before(as_of, hours), F.lit(False)).alias("fresh")
    )


def rule_candidates(key_candidates: DataFrame, relationships: DataFrame, existing: DataFrame) -> DataFrame:
    """Rules the facts call for: uniqueness of repeating keys, integrity of leaky references.

    ``existing``: table, column of instances already there. A confirmed foreign key
    may repeat, so it gets no uniqueness rule.
    """
    foreign = relationships.where(F.col("status") == "confirmed").select(
        F.col("from_table").alias("table"), F.col("from_column").alias("column")
    )
    taken = existing.select("table", "column").unionByName(foreign).distinct()
    unique = (
        key_candidates.where(~F.col("is_unique"))
        .join(taken, ["table", "column"], "left_anti")
        .select(
            "table", "column", F.lit("uniqueness").alias("shape"), F.lit(None).cast("string").alias("ref_table"),
            F.lit(None).cast("string").alias("ref_column"), F.lit("high").alias("severity"),
            F.col("duplicate_rows").alias("violations"),
        )
    )
    leaky = relationships.where(
        (F.col("status") == "confirmed") & (F.col("confidence") == "verified") & (F.col("orphan_rate") > 0)
    ).select(
        F.col("from_table").alias("table"), F.col("from_column").alias("column"),
        F.lit("referential_integrity").alias("shape"), F.col("to_table").alias("ref_table"),
        F.col("to_column").alias("ref_column"), F.lit("high").alias("severity"),
        F.col("sample_orphans").alias("violations"),
    )
    return unique.unionByName(leaky)
