"""Column expressions over rule texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import policy


def word_tokens(text: Column) -> Column:
    """Distinct lower-cased words (letters, digits, underscore) of the whole text."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    )


def significant_words(text: Column) -> Column:
    """Distinct words longer than two letters that are not stop words."""
    long_words = F.filter(word_tokens(text), lambda w: F.length(w) > 2)
    return F.array_except(long_words, F.array(*[F.lit(w) for w in policy.STOP_WORDS]))


def overlap_of_sets(a: Column, b: Column) -> Column:
    """Share of the smaller word set that occurs in the other one; 0 if either is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.nullif(smaller, F.lit(0))
    )


def word_overlap(a: Column, b: Column) -> Column:
    return overlap_of_sets(significant_words(a), significant_words(b))


def normal_name(name: Column) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit(""))))


def canonical_json(config: Column) -> Column:
    """JSON with sorted keys and no blanks; NULL gives ``{}``.

    ``config`` is a map or a struct whose fields are declared in alphabetical
    order: NULL fields are left out, which is how a missing key looks.
    """
    return F.coalesce(F.to_json(config), F.lit("{}"))


def canonical_map_json(config: Column) -> Column:
    """As ``canonical_json`` for a map column, whose entries come in any order."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(config)))
    return F.coalesce(F.to_json(ordered), F.lit("{}"))


def fingerprint(
    definition_id: Column,
    scope: Column,
    database: Column,
    schema: Column,
    table: Column,
    target_json: Column,
    threshold_json: Column,
) -> Column:
    """sha256 identity of a rule instance."""
    parts = [definition_id, scope, database, schema, table, target_json, threshold_json]
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)
