"""Column expressions over names and type names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import policy
from plumbline.policy import NamingPolicy


def base_type(data_type: Column) -> Column:
    """``NUMBER(38,0)`` -> ``NUMBER``; an unknown type becomes the empty string."""
    return F.upper(F.trim(F.split(F.coalesce(data_type, F.lit("")), r"\(")[0]))


def nullable_flag(value: Column) -> Column:
    """YES/TRUE/1/Y -> true, other text -> false, NULL -> NULL (unknown)."""
    return F.upper(value.cast("string")).isin("YES", "TRUE", "1", "Y")


def type_family(data_type: Column) -> Column:
    """Join family of a type, NULL when it is unknown."""
    base = base_type(data_type)
    chain = F
    for family, members in policy.TYPE_FAMILIES.items():
        chain = chain.when(base.isin(*members), family)
    return chain


def types_joinable(left: Column, right: Column) -> Column:
    """False only if both families are known and differ."""
    return F.coalesce(type_family(left) == type_family(right), F.lit(True))


def key_name(column: Column, naming: NamingPolicy) -> Column:
    """Upper-cased name with the policy's prefix removed."""
    upper = F.upper(column)
    return F.regexp_replace(upper, naming.strip_prefix, "") if naming.strip_prefix else upper


def own_key_names(table: Column) -> Column:
    """Array of names a table would give its own key.

    Full name, singular (only where dropping the S leaves a consonant) and the
    acronym of a name of several words, each with ``_ID`` and ``_KEY``.
    """
    name = F.upper(table)
    singular = F.when(
        name.rlike("[^AEIOU]S$") & (F.length(name) >= 4), F.regexp_replace(name, "S$", "")
    )
    words = F.filter(F.split(name, "_"), lambda w: w != "")
    acronym = F.when(
        F.contains(name, F.lit("_")),
        F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""),
    )
    stems = F.array_compact(F.array(name, singular, acronym))
    suffixed = F.flatten(
        F.transform(stems, lambda s: F.array(F.concat(s, F.lit("_ID")), F.concat(s, F.lit("_KEY"))))
    )
    return F.array_union(suffixed, F.array(*[F.lit(n) for n in policy.UNIVERSAL_KEY_NAMES]))


def contains_any(text: Column, fragments: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(f)) for f in fragments])


def starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(text, F.lit(p)) for p in prefixes])


def matches_any(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def severity_rank(severity: Column) -> Column:
    """critical 0 ... info 4; an unknown severity ranks as medium."""
    chain = F
    for name, rank in policy.SEVERITY_RANK.items():
        chain = chain.when(F.lower(severity) == name, rank)
    return chain.otherwise(2)


def severity_weight(severity: Column) -> Column:
    chain = F
    for name, weight in policy.SEVERITY_WEIGHT.items():
        chain = chain.when(F.lower(severity) == name, weight)
    return chain.otherwise(policy.DEFAULT_SEVERITY_WEIGHT)
