"""Is this rule text already in the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import policy
from plumbline.functions.text import normal_name, overlap_of_sets, significant_words, word_overlap
from plumbline.session import stored


def _with_words(df: DataFrame) -> DataFrame:
    """Adds the sorted word set and a 128-bit key of it; rows without words have size 0."""
    text = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit("")))
    words = df.withColumn("words", F.array_sort(significant_words(text)))
    key = F.struct(F.xxhash64("words").alias("a"), F.xxhash64(F.lit(1), F.col("words")).alias("b"))
    return words.withColumn("word_key", key).withColumn("size", F.size("words"))


def _word_sets(df: DataFrame) -> DataFrame:
    """Distinct word sets: copies of a text are compared once, however many there are."""
    return (
        df.where(F.col("size") > 0)
        .groupBy("word_key", "size")
        .agg(F.min("id").alias("first_id"), F.first("words").alias("words"))
    )


#: Rare words that a pair has to share before its word sets are read.
SHARED = 3


def _needed(size: Column, threshold: float) -> Column:
    """Words that a set has to share with a larger one."""
    return F.greatest(F.ceil(size * F.lit(threshold) - F.lit(1e-9)).cast("int"), F.lit(1))


def _ranked(sets: DataFrame) -> DataFrame:
    """``sets(side, word_key, size, words)`` with ``ranked``: hashes of the words both sides have, the rarest first.

    One order for all sets: words of one side only, which no pair shares, then by the number of
    sets that hold a word, then by hash. ``ahead`` is the number of words of one side only; sets
    without others are left out.
    """
    tokens = sets.select("side", "word_key", "size", F.explode(F.transform("words", lambda w: F.xxhash64(w))).alias("word"))
    frequency = tokens.withColumn("left", F.col("side") == "left").groupBy("word").agg(F.count(F.lit(1)).alias("sets"), (F.min("left") != F.max("left")).alias("both"))
    # Stored, their size is known before the words of all sets move.
    shared = stored(frequency.where("both").drop("both"), "shared-words")
    return (
        tokens.join(shared, "word")
        .groupBy("side", "word_key", "size")
        .agg(F.sort_array(F.collect_list(F.struct("sets", "word"))).alias("r"))
        .select("side", "word_key", "size", (F.col("size") - F.size("r")).alias("ahead"), F.col("r.word").alias("ranked"))
    )


def _rare_pairs(ranked: DataFrame, threshold: float, small: str, large: str, strict: bool) -> DataFrame:
    """(small_key, large_key) of pairs that share enough rare words, ``small`` sets being no larger.

    A set of s words has to share o of them, so with s - o + k of its words, whichever, it
    shares at least k. Taking the rarest ones, most pairs fall out by counting. A word at place i
    of one and j of the other set can be among the first k shared ones only if the words that
    follow leave room for the rest.
    """
    needed = _needed(F.col("size"), threshold)
    k = F.least(F.lit(SHARED), needed)
    first = F.least(F.col("size"), F.col("size") - needed + k) - F.col("ahead")
    rare = ranked.where(F.col("side") == small).select(
        F.col("word_key").alias("small_key"),
        F.col("size").alias("small_size"),
        needed.alias("needed"),
        k.alias("k"),
        F.col("ahead").alias("small_ahead"),
        F.posexplode(F.slice("ranked", F.lit(1), F.greatest(first, F.lit(0)))).alias("i", "word"),
    ).withColumn("i", F.col("i") + F.col("small_ahead"))
    every = ranked.where(F.col("side") == large).select(
        F.col("word_key").alias("large_key"), F.col("size").alias("large_size"), "ahead", F.posexplode("ranked").alias("j", "word")
    ).select("large_key", "large_size", (F.col("j") + F.col("ahead")).alias("j"), "word")
    fits = F.col("small_size") < F.col("large_size") if strict else F.col("small_size") <= F.col("large_size")
    room = F.least(F.col("small_size") - F.col("i"), F.col("large_size") - F.col("j")) + F.col("k") - 1 >= F.col("needed")
    return (
        rare.join(every, "word")
        .where(fits & room)
        .groupBy("small_key", "large_key")
        .agg(F.count(F.lit(1)).alias("n"), F.first("k").alias("k"))
        .where(F.col("n") >= F.col("k"))
        .select("small_key", "large_key")
    )


def candidate_pairs(ranked: DataFrame, threshold: float) -> DataFrame:
    """(left_key, right_key): the pairs of a left and a right set whose words are worth comparing.

    Two sets of one size meet once, with the left one as the smaller.
    """
    left_small = _rare_pairs(ranked, threshold, "left", "right", strict=False)
    right_small = _rare_pairs(ranked, threshold, "right", "left", strict=True)
    return left_small.select(F.col("small_key").alias("left_key"), F.col("large_key").alias("right_key")).unionByName(
        right_small.select(F.col("large_key").alias("left_key"), F.col("small_key").alias("right_key"))
    )


def best_matches(
    candidates: DataFrame, library: DataFrame, threshold: float = policy.SIMILARITY_THRESHOLD
) -> DataFrame:
    """(id, match_id, score, matched_by) for candidates the library already has.

    Both inputs: id, name, description. An equal name (trimmed, lower case) decides
    first. Otherwise the entry with the largest word overlap wins if it reaches the
    threshold; equal scores and equal names go to the smallest id.

    The overlap join is exact. Pairs are found through several rare words of the
    smaller set, counted before any word set is joined, and verified on the word sets.
    """
    # Splitting texts into words is the costly part and several steps need the words.
    wanted = stored(_with_words(candidates).select("id", "name", "words", "word_key", "size"), "candidate-words")
    known = stored(_with_words(library).select("id", "name", "words", "word_key", "size"), "library-words")
    by_name = (
        known.withColumn("key", normal_name(F.col("name")))
        .where(F.col("key") != "")
        .groupBy("key")
        .agg(F.min("id").alias("name_id"))
    )
    named = wanted.withColumn("key", normal_name(F.col("name"))).join(by_name, "key", "left").select(
        "id", "word_key", "size", "words", "name_id"
    )
    left = _word_sets(named.where(F.col("name_id").isNull()))
    right = _word_sets(known)
    both = left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right")))
    # Every word of a set carries the set's key, so sets get short ones.
    both = both.withColumnRenamed("word_key", "long_key").withColumn("word_key", F.monotonically_increasing_id())
    both = stored(both, "word-sets")
    left, right = both.where(F.col("side") == "left"), both.where(F.col("side") == "right")
    pairs = candidate_pairs(stored(_ranked(both), "ranked-words"), threshold)
    scored = (
        pairs.join(right.select(F.col("word_key").alias("right_key"), F.col("words").alias("right_words"), F.col("first_id").alias("match_id")), "right_key")
        .join(left.select(F.col("word_key").alias("left_key"), "long_key", F.col("words").alias("left_words")), "left_key")
        .withColumn("score", overlap_of_sets(F.col("left_words"), F.col("right_words")))
        .where(F.col("score") >= threshold)
    )
    best = (
        scored.groupBy("left_key")
        .agg(
            F.first("long_key").alias("word_key"),
            F.min_by(F.struct("match_id", "score"), F.struct(-F.col("score"), F.col("match_id"))).alias("m"),
        )
        .select("word_key", F.col("m.match_id").alias("text_id"), F.col("m.score").alias("text_score"))
    )
    joined = named.select("id", "word_key", "name_id").join(best, "word_key", "left")
    is_named = F.col("name_id").isNotNull()
    return joined.where(is_named | F.col("text_id").isNotNull()).select(
        "id",
        F.coalesce("name_id", "text_id").alias("match_id"),
        F.when(~is_named, F.col("text_score")).alias("score"),
        F.when(is_named, "name").otherwise("text").alias("matched_by"),
    )


def suppress_known(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds existing_id, suppressed and reason to candidates by fingerprint.

    ``existing``: fingerprint, instance_id, status, rejection_reason. Active and
    pending instances suppress a candidate. A rejected one does too, unless the
    new evidence has little to do with the reason for the rejection.
    """
    found = existing.groupBy("fingerprint").agg(
        F.max_by(F.struct("instance_id", "status", "rejection_reason"), "instance_id").alias("x")
    )
    joined = candidates.join(found, "fingerprint", "left")
    evidence = F.coalesce("evidence", F.lit(""))
    differs = (evidence != "") & (
        word_overlap(evidence, F.coalesce("x.rejection_reason", F.lit(""))) < policy.REPROPOSE_BELOW
    )
    status = F.col("x.status")
    reason: Column = (
        F.when(status == "active", "already_active")
        .when(status == "pending", "already_pending")
        .when((status == "rejected") & ~differs, "previously_rejected")
    )
    return joined.select(
        *candidates.columns,
        F.col("x.instance_id").alias("existing_id"),
        reason.isNotNull().alias("suppressed"),
        reason.alias("reason"),
    )


def collapse_same_names(proposals: DataFrame) -> DataFrame:
    """One proposal per normalised name: the one with the smallest id."""
    rest = [c for c in proposals.columns if c != "id"]
    kept = proposals.groupBy(normal_name(F.col("name")).alias("__key")).agg(
        F.min("id").alias("id"), F.min_by(F.struct(*rest), "id").alias("p"), F.count(F.lit(1)).alias("collapsed")
    )
    return kept.select("id", *[F.col(f"p.{c}").alias(c) for c in rest], "collapsed")
