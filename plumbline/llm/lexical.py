"""Ranked lexical search over a length-stratified index.

A document with ``n`` terms has the normaliser ``m = 50 + (50 * n * N) div L``; documents of equal
``m`` are one stratum. A stratum is stored in blocks of bounded size, one row each: the
documents, and per term its postings in runs of equal ``tf``. Within a stratum the impact of
a posting depends on ``tf`` alone, so it is worked out once per run length and not per posting.

``search`` ranks all documents for each item:

1. One pass over the index counts, per term asked for and stratum, the documents and the
   highest ``tf``. That gives the weights, and for each item and stratum the highest score
   that a document there can have.
2. Each item visits its ``HEAD_STRATA`` strata with the highest bounds first. The score of
   its k-th document is a floor for the rest.
3. All other strata are read with these floors. A block is scored for the items whose bound
   in the block reaches their floor; the blocks of a batch are visited by falling bounds, and
   floors rise as documents are found. Bounds are exact, so nothing is lost.

No group grows with the corpus: blocks are dealt by hash within their stratum, tasks keep k documents
per item, and what is sent around are the terms of at most ``CHUNK_PAIRS`` (item, term) pairs at a
time, or of one item. More items are searched chunk after chunk.

Defined cases: a null or empty text has no terms, is not counted and found by nothing;
rows without ``doc_id`` are documents and come last among equal scores; repeated rows are
documents of their own; items without terms or without documents have no rows; rows with one
``item_id`` are one item with the terms of all (null is an id); an empty table gives an empty
result; other columns are ignored. Scores are exact up to 2^53.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import stored

#: Postings in a block, unless one document has more.
BLOCK_POSTINGS = 1 << 15
#: Strata that an item visits before the floors are known.
HEAD_STRATA = 6
#: (item, term) pairs that are searched for at the same time.
CHUNK_PAIRS = 200_000
#: Scores that a task works out at the same time.
CELLS = 1 << 20

#: ASCII bytes that are no letter or digit divide terms; A-Z count as a-z.
_TERM_BYTES = bytes(
    b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def impact(tf, m):
    """What a term with weight 1 adds to the score; for numbers and numpy arrays."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


@dataclass
class Index:
    """Blocks of documents with their postings, the number of documents with terms, and of all their terms."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms and their numbers of every document; ``place`` tells repeated rows of a task apart."""
    place = 0
    for batch in batches:
        for begin in range(0, batch.num_rows, 500):
            part = batch.slice(begin, 500)
            words, numbers, lengths, sizes = [], [], [], []
            for text in part.column(1):
                own = terms_of(text.as_py())
                counts = Counter(own)
                words += counts
                numbers += counts.values()
                lengths.append(len(own))
                sizes.append(len(counts))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(np.arange(place, place + part.num_rows, dtype=np.int64)),
                    pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(words, pa.binary())),
                    pa.ListArray.from_arrays(offsets, pa.array(numbers, pa.int32())),
                ],
                ["doc_id", "place", "n", "terms", "tfs"],
            )
            place += part.num_rows


_BLOCK = "m long, doc_ids array<long>, terms array<binary>, runs array<int>, tfs array<int>, sizes array<int>, places array<int>"
_BLOCK_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]


def _block(key: tuple, rows: pa.Table) -> pa.Table:
    """One row for a block: postings sorted by term, tf and document."""
    rows = rows.sort_by([("doc_id", "ascending")])  # nulls last
    lists = rows["terms"].combine_chunks()
    words = lists.flatten().dictionary_encode()
    spelled = words.dictionary
    order = pc.array_sort_indices(spelled)
    rank = np.empty(len(spelled), np.int64)
    rank[order.to_numpy()] = np.arange(len(spelled))
    term = rank[words.indices.to_numpy()]
    tf = rows["tfs"].combine_chunks().flatten().to_numpy()
    place = np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy())
    by = np.lexsort((place, tf, term))
    term, tf, place = term[by], tf[by], place[by]
    begins = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(tf, prepend=0) != 0))
    whole = [
        rows["doc_id"].combine_chunks(),
        spelled.take(order),
        pa.array(np.bincount(term[begins], minlength=len(spelled)).astype(np.int32)),
        pa.array(tf[begins].astype(np.int32)),
        pa.array(np.diff(np.append(begins, len(tf))).astype(np.int32)),
        pa.array(place.astype(np.int32)),
    ]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in whole]
    return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), *lists], _BLOCK_NAMES)


def build_index(docs: DataFrame) -> Index:
    """The index of all rows of ``docs(doc_id, text)``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = stored(
        texts.mapInArrow(_counted, "doc_id long, place long, n long, terms array<binary>, tfs array<int>"), "lexical-terms"
    ).where("n > 0")
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    placed = counted.withColumn("m", F.expr(f"50 + (50 * n * {n_docs}L) div {max(n_terms, 1)}L"))
    strata = stored(
        placed.groupBy("m").agg(F.ceil(F.sum(F.size("terms")) / BLOCK_POSTINGS).alias("n_blocks")), "lexical-strata"
    )
    dealt = placed.join(strata, "m").withColumn("block", F.expr("pmod(xxhash64(doc_id, place), n_blocks)"))
    blocks = dealt.select("m", "block", "doc_id", "terms", "tfs").groupBy("m", "block").applyInArrow(_block, _BLOCK)
    return Index(stored(blocks, "lexical-index"), n_docs, n_terms)


def _values(row: pa.RecordBatch, name: str) -> np.ndarray:
    return row.column(name).flatten().to_numpy(zero_copy_only=False)


class _Found:
    """The terms of a vocabulary that a block has: their numbers, postings and highest tf."""

    def __init__(self, row: pa.RecordBatch, vocabulary: pa.Array):
        at = pc.index_in(row.column("terms").flatten(), value_set=vocabulary)
        self.slots = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        self.terms = at.drop_null().to_numpy()
        runs = _values(row, "runs")
        run_ends = np.cumsum(runs)
        self.tfs, sizes = _values(row, "tfs").astype(np.int64), _values(row, "sizes")
        post_ends = np.cumsum(sizes)
        self.sizes = sizes
        ends = run_ends[self.slots]
        self.begins = (post_ends[ends - runs[self.slots]] - sizes[ends - runs[self.slots]]) if len(ends) else ends
        self.lengths = post_ends[ends - 1] - self.begins
        #: Runs are sorted by tf.
        self.highest = self.tfs[ends - 1]


def _matches(vocabulary) -> object:
    """Per term asked for and stratum: documents and highest tf, added up per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary.value, pa.binary())
        width = len(known)
        keys, dfs, tops = (np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            parts = [(keys, dfs, tops)]
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                found = _Found(row, known)
                parts.append((row.column("m")[0].as_py() * width + found.terms, found.lengths, found.highest))
            keys, dfs, tops = (np.concatenate(x) for x in zip(*parts))
            keys, where = np.unique(keys, return_inverse=True)
            dfs = np.bincount(where, dfs, len(keys)).astype(np.int64)
            highest = np.zeros(len(keys), np.int64)
            np.maximum.at(highest, where, tops)
            tops = highest
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in ((keys % max(width, 1)).astype(np.int32), keys // max(width, 1), dfs, tops)],
            ["term", "m", "df", "tf"],
        )

    return run


@dataclass
class _Asked:
    """Items as pairs (item, term, weight), sorted by item; sent to the executors."""

    vocabulary: list[bytes]
    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    n_items: int
    k: int
    floors: np.ndarray
    #: Per stratum the items that visit it first.
    heads: dict[int, np.ndarray]


class _Best:
    """The k best documents per item that a task has seen, and the floors they give."""

    def __init__(self, asked: _Asked):
        self.k, self.floors = asked.k, np.maximum(asked.floors, 1)
        self.kept = [np.zeros(0, np.int64) for _ in range(3)] + [np.zeros(0, bool)]
        self.fresh: list[list[np.ndarray]] = []
        self.n_fresh = 0

    def add(self, *columns: np.ndarray) -> None:
        """Items, scores, ids, and whether an id is null."""
        self.fresh.append(list(columns))
        self.n_fresh += len(columns[0])
        if self.n_fresh > max(4096, len(self.kept[0])):
            self.settle()

    def settle(self) -> None:
        item, score, ids, null = (np.concatenate(x) for x in zip(self.kept, *self.fresh))
        order = np.lexsort((ids, null, -score, item))
        item = item[order]
        begins = np.flatnonzero(np.diff(item, prepend=-1))
        rank = np.arange(len(item)) - np.repeat(begins, np.diff(np.append(begins, len(item))))
        take = order[rank < self.k]
        last = rank == self.k - 1
        self.floors[item[last]] = np.maximum(self.floors[item[last]], score[order][last])
        self.kept = [score_or_id[take] for score_or_id in (np.concatenate(x) for x in zip(self.kept, *self.fresh))]
        self.fresh, self.n_fresh = [], 0


def _visit(row: pa.RecordBatch, found: _Found, pairs: np.ndarray, slots: np.ndarray, asked: _Asked, best: _Best) -> None:
    """Score a block's documents for the items of ``pairs``; ``slots`` are the places of their terms in ``found``."""
    m = row.column("m")[0].as_py()
    ids = row.column("doc_ids").flatten()
    null = ids.is_null().to_numpy(zero_copy_only=False)
    ids = pc.fill_null(ids, 0).to_numpy()
    places = _values(row, "places")
    # Once per run, then spread over its postings.
    impacts = np.repeat(impact(found.tfs, m), found.sizes)
    # Items are taken in groups of bounded size.
    starts = np.flatnonzero(np.diff(asked.item[pairs], prepend=-1))
    cost = np.maximum(np.add.reduceat(found.lengths[slots], starts), len(ids))
    group = (np.cumsum(cost) - cost) // CELLS
    for g in np.unique(group):
        first = int(np.searchsorted(group, g))
        last = int(np.searchsorted(group, g, side="right"))
        begin, end = starts[first], starts[last] if last < len(starts) else len(pairs)
        own, at = pairs[begin:end], slots[begin:end]
        items, number = np.unique(asked.item[own], return_inverse=True)
        lengths = found.lengths[at]
        spread = np.repeat(found.begins[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        cells = np.repeat(number * len(ids), lengths) + places[spread]
        parts = np.repeat(asked.weight[own], lengths) * impacts[spread]
        # Sums of integers below 2^53 are exact.
        scores = np.bincount(cells, parts, len(items) * len(ids)).astype(np.int64).reshape(len(items), len(ids))
        which, doc = np.nonzero(scores >= best.floors[items][:, None])
        best.add(items[which], scores[which, doc], ids[doc], null[doc])


def _searched(asked_everywhere, head: bool):
    """The best documents of a task's blocks for every item: strata that an item visits first, or all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = asked_everywhere.value
        known = pa.array(asked.vocabulary, pa.binary())
        best = _Best(asked)
        for batch in batches:
            visits = []
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                m = row.column("m")[0].as_py()
                firsts = np.zeros(asked.n_items, bool)
                firsts[asked.heads.get(m, [])] = True
                found = _Found(row, known)
                slot = np.full(len(known), -1, np.int64)
                slot[found.terms] = np.arange(len(found.terms))
                pairs = np.flatnonzero((slot[asked.term] >= 0) & (firsts[asked.item] == head))
                if len(pairs):
                    top = asked.weight[pairs] * impact(found.highest[slot[asked.term[pairs]]], m)
                    bounds = np.bincount(asked.item[pairs], top, asked.n_items)
                    visits.append((bounds.max(), k, row, found, pairs, slot, bounds))
            for _, _, row, found, pairs, slot, bounds in sorted(visits, key=lambda v: (-v[0], v[1])):
                pairs = pairs[(bounds >= best.floors)[asked.item[pairs]]]
                if len(pairs):
                    _visit(row, found, pairs, slot[asked.term[pairs]], asked, best)
                    best.settle()
        best.settle()
        item, score, ids, null = best.kept
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.array(ids, pa.int64(), mask=null), pa.array(score)], ["item", "doc_id", "score"]
        )

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [sorted(set(terms_of(t.as_py()))) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], ["item_id", "terms"])


def _best_ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_chunk(index: Index, items: list, k: int) -> DataFrame:
    """The best documents of a bounded number of items: (item, rank, doc_id, score)."""
    spark = index.blocks.sparkSession
    vocabulary = sorted({t for row in items for t in row["terms"]})
    number = {t: i for i, t in enumerate(vocabulary)}
    words = spark.sparkContext.broadcast(vocabulary)
    strata = stored(
        index.blocks.drop("doc_ids", "places")
        .mapInArrow(_matches(words), "term int, m long, df long, tf long")
        .groupBy("term", "m")
        .agg(F.sum("df").alias("df"), F.max("tf").alias("tf")),
        "lexical-matches",
    )
    # At most one row per term of the chunk.
    weights = {
        row["term"]: math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * row["df"] + 1)))
        for row in strata.groupBy("term").agg(F.sum("df").alias("df")).collect()
    }
    pairs = [(i, number[t], weights[number[t]]) for i, row in enumerate(items) for t in row["terms"] if number[t] in weights]
    item, term, weight = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ([], [], [])))
    asked = _Asked(vocabulary, item, term, weight, len(items), k, np.zeros(len(items), np.int64), {})

    wanted = spark.createDataFrame([(int(i), int(t), int(w)) for i, t, w in pairs], "item int, term int, weight long")
    best_strata = Window.partitionBy("item").orderBy(F.desc("bound"), "m")
    heads = (
        strata.join(wanted, "term")
        .groupBy("item", "m")
        .agg(F.sum(F.expr("weight * ((1000000000 * tf) div (1000 * tf + 20 * m))")).alias("bound"))
        .where("bound > 0")
        .withColumn("place", F.row_number().over(best_strata))
        .where(F.col("place") <= HEAD_STRATA)
        .select("item", "m")
    )
    # At most HEAD_STRATA rows per item of the chunk.
    visits: dict[int, list[int]] = {}
    for row in heads.collect():
        visits.setdefault(row["m"], []).append(row["item"])
    asked.heads = {m: np.array(i, np.int64) for m, i in visits.items()}
    form = "item int, doc_id long, score long"
    first_read = index.blocks.where(F.col("m").isin(list(asked.heads)) if asked.heads else F.lit(False))
    head = stored(_best_ranked(first_read.mapInArrow(_searched(spark.sparkContext.broadcast(asked), True), form), k), "lexical-head")
    floors = np.zeros(len(items), np.int64)
    for row in head.where(F.col("rank") == k).select("item", "score").collect():
        floors[row["item"]] = row["score"]
    rest = _Asked(**{**vars(asked), "floors": floors})
    others = index.blocks.mapInArrow(_searched(spark.sparkContext.broadcast(rest), False), form)
    return _best_ranked(head.drop("rank").unionByName(others), k)


def search(index: Index, items: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` best documents of every item: (item_id, rank, doc_id, score)."""
    spark = index.blocks.sparkSession
    texts = items.select("item_id", F.col("text").cast("string").alias("text"))
    id_type = texts.schema["item_id"].dataType
    form = T.StructType([T.StructField("item_id", id_type), T.StructField("terms", T.ArrayType(T.BinaryType()))])
    wanted = stored(
        texts.mapInArrow(_item_terms, form)
        .select("item_id", F.explode("terms").alias("term"))
        .groupBy("item_id")
        .agg(F.array_sort(F.collect_set("term")).alias("terms")),
        "lexical-items",
    )
    n_pairs = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    chunks = -(-n_pairs // CHUNK_PAIRS)
    result = T.StructType([T.StructField("item_id", id_type), *_result().fields])
    found = []
    for c in range(chunks):
        chosen = wanted.where(F.expr(f"pmod(xxhash64(item_id), {chunks}) = {c}")).collect()
        if chosen:
            ranked = _search_chunk(index, chosen, k)
            names = spark.createDataFrame([(i, row["item_id"]) for i, row in enumerate(chosen)], T.StructType([T.StructField("item", T.IntegerType()), result.fields[0]]))
            found.append(ranked.join(names, "item").select(result.names))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], result)


def _result() -> T.StructType:
    return T.StructType().add("rank", T.IntegerType()).add("doc_id", T.LongType()).add("score", T.LongType())
