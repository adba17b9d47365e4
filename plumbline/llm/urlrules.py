"""URL filters by given rules and by association rules mined from URLs they label.

A given rule (host, path, verdict) fits its host and all subdomains if the path of the URL
starts with the rule's; the longest rule that fits decides. URLs that no rule fits are judged
by rules that FP-growth mines from the URLs that one fits:

1. A URL becomes a set of tokens: scheme, host labels, path segments with digits as ``#``,
   file extension, query keys, fragment.
2. Frequent tokens are counted over all labelled URLs. A labelled URL keeps all its frequent tokens
   and gets its verdict as one more item. (A caller may name a ``width``; then it keeps that many, those
   whose share of blocked URLs differs most from the share of all.)
3. Spark's FP-growth finds the frequent sets; sets with a verdict become rules. Rules of low
   support or confidence go, as do long ones and those that a part of themselves replaces.
4. Rules are ordered by confidence and support. The inverted index lists each under its rarest
   token, so a URL meets only rules of its own tokens, and the first one that it fits decides.

FP-growth finds frequent sets of every size, up to 2^n of n tokens that come together, though rules have at
most ``longest``. Where a URL has more than ``at_once`` frequent tokens, they are dealt into groups, and
a URL is mined once per choice of at most ``longest`` of its groups, in one run that keeps the choices
apart. A set is counted in full where the choice is exactly the groups of its tokens, and taken from there
only, so no rule is lost and none is counted twice. A basket then has at most ``at_once`` tokens (or ``longest``).
Of n frequent tokens of a URL there are at most n^longest sets, and a frequent set uses ``min_support`` of all
URLs: that bounds rules, however large the table is. Frequent tokens are at most the mean
number of tokens / min_support. Judging shuffles nothing.

Defined cases: a URL that is null or has no ``://`` has no host, path or tokens; without a
rule that fits, or without any labelled URL, the verdict is allow; repeated rows are judged
and counted each; a row without id keeps its null; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import stored

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Mark of the item that holds the verdict. No token begins with it.
_VERDICT = "="
#: Between the choice of groups and an item.
_IN = "\n"


@dataclass(frozen=True)
class Rule:
    """A given rule."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Settings:
    """Bounds of the mined rules."""

    min_support: float = 0.005
    min_confidence: float = 0.8
    #: Tokens that a labelled URL is mined by (None: all its frequent ones), and tokens of a rule.
    width: int | None = None
    longest: int = 4
    #: Tokens of a basket; it changes no rule.
    at_once: int = 10


@dataclass(frozen=True)
class Mined:
    """A mined rule: URLs with all tokens have the verdict."""

    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: float


def _lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _rest(url: Column) -> Column:
    """What follows the first ``://``."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.coalesce(_lowered(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL."""

    def named(kind: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(kind), v))

    rest = _rest(url)
    segments = F.transform(F.split(_lowered(path(url)), "/"), lambda s: F.regexp_replace(s, "[0-9]+", "#"))
    queries = F.split(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), "&")
    keys = F.transform(queries, lambda q: F.substring_index(q, "=", 1))
    parts = F.concat(
        named("scheme:", F.array(_lowered(F.substring_index(url, "://", 1)))),
        named("host:", F.split(host(url), r"\.")),
        named("path:", segments),
        named("type:", F.array(F.regexp_extract(_lowered(path(url)), r"\.([a-z0-9]+)$", 1))),
        named("query:", keys),
        F.when(F.contains(rest, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(F.instr(url, "://") > 0, F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))


def given(host_: Column, path_: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    # The first condition that holds decides, so the longest rule goes last into the chain.
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host_ == rule.host) | host_.endswith(f".{rule.host}")) & path_.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _groups(labelled: DataFrame, placed: Callable[[list[str]], list[int]], known: int, settings: Settings) -> int:
    """Into how many groups the ``known`` tokens are dealt, so that ``longest`` groups of a URL have ``at_once`` tokens.

    The least of some numbers that does for every URL; one group if all fit at once, else one per token at worst.
    """
    trials = [1]
    while trials[-1] < known:
        trials.append(min(max(settings.longest + 1, math.ceil(trials[-1] * 1.5)), known))

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = [0] * len(trials)
        for batch in batches:
            for own in batch.column(0).to_pylist():
                places = placed(own)
                # The first trial is the hardest one; where it is met, all are.
                for i, n in enumerate(trials):
                    size = sum(sorted(Counter(at % n for at in places).values(), reverse=True)[: settings.longest])
                    most[i] = max(most[i], size)
                    if i == 0 and size <= settings.at_once:
                        break
        yield pa.RecordBatch.from_arrays([pa.array(range(len(trials)), pa.int32()), pa.array(most, pa.int32())], ["trial", "most"])

    found = labelled.select("tokens").mapInArrow(widest, "trial int, most int").groupBy("trial").agg(F.max("most").alias("most"))
    most = {row["trial"]: row["most"] for row in found.collect()}
    return next((n for i, n in enumerate(trials) if most.get(i, 0) <= settings.at_once), known)


def mine(labelled: DataFrame, settings: Settings = Settings()) -> list[Mined]:
    """The association rules of ``labelled(tokens, verdict)``, the most certain first."""
    spark = labelled.sparkSession
    total, blocked = labelled.agg(F.count("*"), F.count_if(F.col("verdict") == BLOCK)).first()
    if not total:
        return []
    counted = (
        labelled.select(F.explode("tokens").alias("token"), (F.col("verdict") == BLOCK).cast("long").alias("blocked"))
        .groupBy("token")
        .agg(F.count("*").alias("n"), F.sum("blocked").alias("blocked"))
        # What all URLs have tells nothing.
        .where((F.col("n") >= settings.min_support * total) & (F.col("n") < total))
    )
    known = counted.collect()
    numbers = {row["token"]: row["n"] for row in known}
    telling = sorted(known, key=lambda row: (-abs(row["blocked"] / row["n"] - blocked / total), row["token"]))
    if not telling:
        return []
    # Places in this order; a URL keeps its first ``width`` ones, if there is a width.
    rank = spark.sparkContext.broadcast({row["token"]: i for i, row in enumerate(telling)})
    width, longest = settings.width, settings.longest

    def placed(own: list[str]) -> list[int]:
        place = rank.value
        return sorted(place[t] for t in own if t in place)[:width]

    groups = _groups(labelled, placed, len(telling), settings)
    names = [row["token"] for row in telling]

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = []
            for own, verdict in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_group: dict[int, list[int]] = {}
                for at in placed(own):
                    by_group.setdefault(at % groups, []).append(at)
                for size in range(1, min(longest, len(by_group)) + 1):
                    for choice in combinations(sorted(by_group), size):
                        mark = " ".join(map(str, choice)) + _IN
                        items.append([mark + str(at) for g in choice for at in by_group[g]] + [mark + _VERDICT + verdict])
                    if len(items) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.string()))], ["items"])
                        items = []
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.string()))], ["items"])

    baskets = stored(labelled.select("tokens", "verdict").mapInArrow(chosen, "items array<string>"), "url-baskets")
    n_baskets = baskets.count()
    if not n_baskets:
        return []
    # The count that a set needs, as a share of the baskets; half a count less rounds up to it.
    least = max(math.ceil(settings.min_support * total), 1)
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n_baskets, minConfidence=settings.min_confidence).fit(baskets)
    bare = F.transform("antecedent", lambda t: F.substring_index(t, _IN, -1))
    exact = F.array_join(F.array_sort(F.array_distinct(F.transform("bare", lambda t: F.try_mod(t.cast("int"), F.lit(groups))))), " ")
    wanted = (
        model.associationRules.where(F.contains(F.col("consequent")[0], F.lit(_IN + _VERDICT)) & (F.size("antecedent") <= longest))
        .select(
            bare.alias("bare"), F.substring_index(F.col("antecedent")[0], _IN, 1).alias("choice"),
            F.substring_index(F.col("consequent")[0], _IN + _VERDICT, -1).alias("verdict"), "confidence", "support",
        )
        .where(~F.exists("bare", lambda t: t.startswith(_VERDICT)))
        .where(F.col("choice") == exact)
    )
    rules = []
    for row in wanted.collect():
        own = [names[int(t)] for t in row["bare"]]
        support = round(row["support"] * n_baskets) / total
        rules.append(Mined(tuple(sorted(own, key=lambda t: (numbers[t], t))), row["verdict"], row["confidence"], support))
    return ranked(rules)


def ranked(rules: list[Mined]) -> list[Mined]:
    """Without rules that one of fewer of their tokens replaces, ordered by confidence, then support."""
    certain = {(frozenset(r.tokens), r.verdict): r.confidence for r in rules}

    def replaced(rule: Mined) -> bool:
        parts = (frozenset(p) for n in range(1, len(rule.tokens)) for p in combinations(rule.tokens, n))
        return any(certain.get((p, rule.verdict), -1.0) >= rule.confidence for p in parts)

    kept = [r for r in rules if not replaced(r)]
    return sorted(kept, key=lambda r: (-r.confidence, -r.support, len(r.tokens), r.tokens, r.verdict))


def inverted(rules: list[Mined]) -> dict[str, list[tuple[int, frozenset[str]]]]:
    """Per token the rules it is the rarest of, by rank, with their other tokens."""
    index: dict[str, list[tuple[int, frozenset[str]]]] = {}
    for rank, rule in enumerate(rules):
        # ``mine`` puts the rarest token first.
        index.setdefault(rule.tokens[0], []).append((rank, frozenset(rule.tokens[1:])))
    return index


def first_fit(index: dict[str, list[tuple[int, frozenset[str]]]], own: list[str]) -> int | None:
    """The rank of the first rule whose tokens are all among ``own``."""
    have, best = set(own), None
    for token in own:
        for rank, others in index.get(token, ()):
            if best is not None and rank >= best:
                break
            if others <= have:
                best = rank
                break
    return best


def split(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict, tokens) by the given rules alone."""
    url = F.col("url").cast("string")
    parts = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"), tokens(url).alias("tokens")
    )
    fit = given(F.col("host"), F.col("path"), rules)
    return parts.withColumn("fit", fit).select("page_id", "host", "path", "fit.rule", "fit.verdict", "tokens")


def judge(pages: DataFrame, rules: list[Rule], settings: Settings = Settings()) -> DataFrame:
    """One row per page: (page_id, host, path, rule, verdict, pattern).

    ``pattern`` holds the tokens of the mined rule that decided.
    """
    parts = split(pages, rules)
    mined = mine(parts.where("rule IS NOT NULL"), settings)
    known = pages.sparkSession.sparkContext.broadcast((mined, inverted(mined)))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, index = known.value
        for batch in batches:
            verdicts, patterns = batch.column(4).to_pylist(), [None] * batch.num_rows
            for i, own in enumerate(batch.column(5).to_pylist()):
                if verdicts[i] is None:
                    at = first_fit(index, own)
                    verdicts[i] = ALLOW if at is None else found[at].verdict
                    patterns[i] = None if at is None else " ".join(found[at].tokens)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(verdicts, pa.string()), pa.array(patterns, pa.string())],
                ["page_id", "host", "path", "rule", "verdict", "pattern"],
            )

    return parts.mapInArrow(decide, "page_id long, host string, path string, rule string, verdict string, pattern string")
