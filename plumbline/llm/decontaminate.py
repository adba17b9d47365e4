"""Benchmark decontamination with Spark expressions only.

Texts are lower-cased, everything but letters and digits divides words. A window of a
document has as many words as a benchmark item. A window without a 5-word shingle of the
item is not similar to it, and one whose shared shingles are all aligned to its right, or
all to its left, loses none of them when it moves there by a word. So the best windows lie
at or between starts at which a shingle is aligned with its place in the item. Windows are
laid at all of these, as far as enough of their shingles occur in items of that length to
reach the threshold. From there:

1. Each window and each item gets a 64-bit SimHash of its shingles, a repeated shingle
   counting as often as it occurs.
2. The bits are cut into RADIUS + 1 blocks. Two fingerprints that differ in at most RADIUS
   bits agree in a whole block, so a join on (item length, block number, block) finds all
   of them. At the threshold, fingerprints differ in 10 bits on average with a deviation
   of 3; the radius lies five deviations beyond.
3. Candidates are verified by the exact weighted similarity of their shingle bags: the sum
   of the smaller counts over the sum of the larger ones, 0.8 or more.

Of equally similar windows an aligned one counts, then the first.

Texts are never exploded with their rows: only (document, position, hash) is, and windows
go back to the documents that have any. The items' shingles are broadcast by Spark if it
finds them small, or else both sides are shuffled, where a passage that a third of the
documents hold is split by AQE. Results are combined per (document, item).

Defined cases: null and empty texts match nothing; a text of fewer than five words is one
shingle as a whole, so short items match only documents that consist of them; repeated
document rows give one result; a document or item without id is not reported; empty tables
give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import stored, temporary

SHINGLE_WORDS = 5
BITS = 64
RADIUS = 24
BORDERS = [k * BITS // (RADIUS + 1) for k in range(RADIUS + 2)]


def words_of(column):
    plain = F.trim(F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(plain) > 0, F.split(plain, " "))


def shingles_of(words):
    """Hashes of the shingles in order of position."""
    hashed = F.transform(
        F.sequence(F.lit(0), F.size(words) - SHINGLE_WORDS),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE_WORDS)]),
    )
    return F.when(F.size(words) >= SHINGLE_WORDS, hashed).when(
        F.size(words) > 0, F.array(F.xxhash64(words))
    )


def simhash(shingles):
    """Bit j is set if more than half of the shingles have it set."""
    half = F.size(shingles)
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        lambda j: F.aggregate(
            shingles, F.lit(0), lambda n, h: n + F.call_function("getbit", h, j).cast("int")
        ),
    )
    marks = F.transform(bits, lambda n, j: F.when(2 * n > half, F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(marks, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def blocks_of(fingerprint):
    """(block number, block) of every block."""
    return F.array(
        *[
            F.struct(
                F.lit(k).alias("block"),
                F.shiftrightunsigned(fingerprint, low).bitwiseAND((1 << (high - low)) - 1).alias("bits"),
            )
            for k, (low, high) in enumerate(zip(BORDERS, BORDERS[1:]))
        ]
    )


def shared_weight(a, b):
    """The sum of the smaller counts of the shingles of two bags."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    repeated = F.aggregate(
        F.array_distinct(b),
        F.lit(0),
        lambda n, x: n + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))),
    )
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(repeated)


def dense_starts(ats, n_grams):
    """Starts of runs of ``n_grams`` shingles that hold four fifths as many of the places ``ats``, ascending.

    A window can share no more than that with an item, and the union is no smaller than the item.
    """
    need = F.ceil(4 * n_grams / 5).cast("int")
    firsts = F.when(F.size(ats) >= need, F.slice(ats, 1, F.size(ats) - need + 1)).otherwise(F.array().cast("array<int>"))
    lasts = F.when(F.size(ats) >= need, F.slice(ats, need, F.size(ats) - need + 1)).otherwise(F.array().cast("array<int>"))
    spans = F.zip_with(firsts, lasts, lambda first, last: F.struct((last - n_grams + 1).alias("low"), first.alias("high")))
    close = F.filter(spans, lambda x: x["low"] <= x["high"])
    return F.array_distinct(F.flatten(F.transform(close, lambda x: F.sequence(F.greatest(F.lit(0), x["low"]), x["high"]))))


def between(starts, reach):
    """Ascending ``starts`` and all numbers between neighbours that are at most ``reach`` apart."""
    following = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.element_at(starts, -1)))
    return F.flatten(
        F.zip_with(
            starts,
            following,
            lambda a, b: F.when((b > a) & (b - a <= reach), F.sequence(a, b - 1)).otherwise(F.array(a)),
        )
    )


def _inside(starts):
    """``starts`` moved to where a window of the document begins."""
    room = F.col("length") - F.col("n_words")
    return F.array_distinct(F.transform(starts, lambda s: F.greatest(F.lit(0), F.least(s, room))))


def _items(benchmark: DataFrame) -> DataFrame:
    rows = benchmark.where("item_id IS NOT NULL").select("item_id", words_of(F.col("text")).alias("words"))
    sized = rows.where("words IS NOT NULL").select(
        "item_id", F.size("words").alias("n_words"), shingles_of(F.col("words")).alias("shingles")
    )
    return sized.withColumn("fingerprint", simhash(F.col("shingles")))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The best window per document and item: (doc_id, item_id, start_word, shared, united)."""
    items = stored(_items(benchmark), "benchmark-items")
    grams = items.select("item_id", "n_words", F.posexplode("shingles").alias("item_at", "gram"))
    offsets = grams.select("gram", "n_words", "item_at").distinct()
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", words_of(F.col("text")).alias("words"))
    hashed = texts.select(
        "doc_id", F.size("words").alias("length"), shingles_of(F.col("words")).alias("shingles")
    )
    # The outer form: for the inner one Spark would test the shingles for null before it
    # makes them, by an expression that splits the text anew for every shingle.
    spots = (
        hashed.select("doc_id", "length", F.posexplode_outer("shingles").alias("at", "gram"))
        .join(offsets, "gram")
        .select("doc_id", "length", "n_words", "at", (F.col("at") - F.col("item_at")).alias("start"))
    )
    found = spots.groupBy("doc_id", "length", "n_words").agg(
        F.array_sort(F.collect_set("at")).alias("ats"), F.array_sort(F.collect_set("start")).alias("starts")
    )
    places = stored(
        found.withColumn("n_grams", F.greatest(F.lit(1), F.col("n_words") - (SHINGLE_WORDS - 1)))
        .withColumn("dense", dense_starts(F.col("ats"), F.col("n_grams")))
        .where(F.size("dense") > 0)
        .withColumn("aligned", _inside(F.col("starts")))
        .withColumn("laid", F.array_intersect(_inside(between(F.col("starts"), 2 * F.col("n_grams"))), F.col("dense")))
        .select(
            "doc_id",
            "length",
            F.transform(
                "laid",
                lambda s: F.struct(
                    F.col("n_words").alias("n_words"), s.alias("start"), F.array_contains("aligned", s).alias("aligned")
                ),
            ).alias("places"),
        )
        .groupBy("doc_id", "length")
        .agg(F.flatten(F.collect_list("places")).alias("places")),
        "benchmark-windows",
    )
    windows = (
        hashed.join(places, ["doc_id", "length"])
        .select("doc_id", "shingles", F.explode("places").alias("place"))
        .select(
            "doc_id",
            "place.n_words",
            "place.start",
            "place.aligned",
            F.slice(
                "shingles", F.col("place.start") + 1, F.greatest(F.lit(1), F.col("place.n_words") - (SHINGLE_WORDS - 1))
            ).alias("window"),
        )
        .withColumn("fingerprint", simhash(F.col("window")))
    )
    windows = stored(windows, "benchmark-prints")
    probes = windows.withColumn("key", F.explode(blocks_of(F.col("fingerprint"))))
    targets = items.select("item_id", "n_words", "shingles", F.col("fingerprint").alias("item_print")).withColumn(
        "key", F.explode(blocks_of(F.col("item_print")))
    )
    near = probes.join(targets, ["n_words", "key"]).where(
        F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= RADIUS
    )
    # A pair agrees in several blocks; it is verified in the first of them.
    first = F.array_position(
        F.transform(
            F.arrays_zip(blocks_of(F.col("fingerprint")).alias("a"), blocks_of(F.col("item_print")).alias("b")),
            lambda p: p["a"]["bits"] == p["b"]["bits"],
        ),
        True,
    )
    verified = (
        near.where(first == F.col("key.block") + 1)
        .withColumn("shared", shared_weight(F.col("window"), F.col("shingles")))
        .withColumn("united", F.size("window") + F.size("shingles") - F.col("shared"))
        .where(5 * F.col("shared") >= 4 * F.col("united"))
    )
    best = F.max_by(
        F.struct(F.col("start").alias("start_word"), "shared", "united"),
        F.struct(F.col("shared") / F.col("united"), "aligned", -F.col("start")),
    )
    return verified.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", "best.start_word", "best.shared", "best.united"
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item; rows without an id stay.

    The ids found are stored first, so Spark knows how few they are and leaves the texts in place.
    """
    with temporary(docs.sparkSession, "benchmark-leaks"):
        found = leaks(docs, benchmark).select(F.col("doc_id").alias("_leaked")).distinct()
        leaked = stored(found, "leaked", lasting=True)
    return docs.join(leaked, docs["doc_id"].cast("long") == leaked["_leaked"], "left_anti")
