"""Near duplicates by a prefix-tree join on word shingles.

1. Every text becomes a set of 5-word shingles. Equal sets are one class.
2. Shingles have one global order, rare ones first: by a level taken from a counting sketch
   of fixed size over all documents, then by hash. Any such order is exact; the sketch only
   decides how few candidates there are.
3. Two sets with a Jaccard similarity of 0.8 share COMMON shingles among their first
   n - ceil(0.8 n) + COMMON. These prefixes are shuffled by shingle. Shingles that only one
   class has, over all runs, are dropped, and then classes with fewer than COMMON left. For each other
   shingle, the class that has it at the earliest place is a candidate for the rest: the
   original of near copies has fewer rare shingles of its own before it than they have.
4. Candidates are checked exactly: the sets that meet one probe are stored in a tree of
   their ordered shingles, so that common beginnings are counted once, and a subtree is
   left as soon as the shingles that remain cannot reach the overlap it needs.
5. Linked classes are joined to components. What shares a shingle so early that it can be
   the first of a similar pair, but is in different components, is checked in the same way,
   so no link between components is missed, while a group of thousands of near copies is
   never expanded into pairs.

No group is collected: prefixes are streamed in sorted runs, shingles that many classes
share are split over several runs, and a class is sent once per task however many copies
it has. Shingles and classes are told apart by 58 and 64 bits of hash.

Defined cases: a text without words, or a null, has an empty set and is linked with
nothing; repeated rows are copies; rows with a null id take part but are named by no
component unless they are alone; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.graph import components
from plumbline.llm.idfilter import known_ids
from plumbline.llm.kept import begin
from plumbline.llm.rows import few_rows, keep_rows
from plumbline.llm.shingles import forget, shingle_set
from plumbline.session import bucket_count, bucketed, stored, temporary

#: Cells of the counting sketch, and slices it is added up in.
CELLS = 1 << 20
SLICES = 64
LEVEL_BITS = 6
#: Occurrences of a shingle beyond which its classes are split over several runs.
RUN_ROWS = 8192
#: Shingles that two similar sets share in their prefixes, if they have as many in common.
COMMON = 6
#: Sets stored in one tree.
TREE_SETS = 256
#: Texts read, and handed to a Python worker, at once.
ROWS_AT_ONCE = 2000


def prefix_length(size: int) -> int:
    """So many first shingles that similar sets share at least ``COMMON`` of them, or all they need."""
    return min(size, size - (4 * size + 4) // 5 + COMMON)


def needed_overlap(a: int, b: int) -> int:
    """The smallest overlap with 100 * overlap >= 80 * union."""
    return -(-4 * (a + b) // 9)


class Tree:
    """Ordered sets in a path-compressed prefix tree."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.root = self._node(order, 0) if order else None

    def _node(self, members: list[int], depth: int) -> tuple:
        """(first depth, end depth, a member, members that end here, children, smallest and largest size)."""
        first, last = self.sets[members[0]], self.sets[members[-1]]
        # Members are sorted, so what the first and the last share all share.
        length = min(len(first), len(last))
        differ = np.nonzero(first[depth:length] != last[depth:length])[0]
        end = depth + int(differ[0]) if len(differ) else length
        ends = [m for m in members if len(self.sets[m]) == end]
        rest = [m for m in members if len(self.sets[m]) > end]
        children, begin = [], 0
        for i in range(1, len(rest) + 1):
            if i == len(rest) or self.sets[rest[i]][end] != self.sets[rest[begin]][end]:
                children.append(self._node(rest[begin:i], end))
                begin = i
        sizes = [len(self.sets[m]) for m in members]
        return depth, end, members[0], ends, children, min(sizes), max(sizes)

    def probe(self, other: np.ndarray) -> list[int]:
        """The sets similar enough to ``other``."""
        found, todo = [], [(self.root, 0)] if self.root else []
        size = len(other)
        while todo:
            (depth, end, member, ends, children, least, most), shared = todo.pop()
            segment = self.sets[member][depth:end]
            if end > depth:
                at = np.searchsorted(other, segment)
                shared += int((other[np.minimum(at, size - 1)] == segment).sum()) if size else 0
                passed = int(np.searchsorted(other, segment[-1], side="right"))
            else:
                passed = 0
            found += [m for m in ends if shared >= needed_overlap(len(self.sets[m]), size)]
            # Below, at most the rest of the longest set and the rest of ``other`` can be shared.
            if children and shared + min(most - end, size - passed) >= needed_overlap(least, size):
                todo += [(child, shared) for child in children]
        return found


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and class of every document; at the end of the task, its share of the sketch."""
    begin("shingles", forget)
    counts, waiting, held = np.zeros(CELLS, np.int64), [], 0
    for batch in batches:
        sizes, classes = [], []
        for text in batch.column(1):
            own = shingle_set(text.as_py())
            sizes.append(len(own))
            classes.append(class_of(own) if len(own) else None)
            waiting.append(own >> np.uint64(44))
            held += len(own)
            if held > 1 << 20:
                counts += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=CELLS)
                waiting, held = [], 0
        yield _summary(batch.column(0), sizes, classes, None, None)
    if waiting:
        counts += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=CELLS)
    if counts.any():
        blobs = [zlib.compress(part.tobytes(), 1) for part in counts.reshape(SLICES, -1)]
        nothing = [None] * SLICES
        yield _summary(pa.array(nothing, pa.int64()), nothing, nothing, list(range(SLICES)), blobs)


def _summary(ids, sizes, classes, slices, blobs) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(sizes, pa.int64()),
            pa.array(classes, pa.int64()),
            pa.array(slices or [None] * n, pa.int32()),
            pa.array(blobs or [None] * n, pa.binary()),
        ],
        ["doc_id", "n_shingles", "class", "slice", "counts"],
    )


def class_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(b), np.int64) for b in pdf["counts"])
    return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})


def sketch_levels(summaries: DataFrame) -> np.ndarray:
    """The level of each cell: a rounded logarithm of its count. Fixed size, so it may be sent around.

    The shares of the tasks are added up in two steps, so no group grows with the tasks.
    """
    parts = summaries.where("slice IS NOT NULL").select("slice", "counts", F.pmod(F.xxhash64("counts"), F.lit(32)).alias("salt"))
    form = "slice int, counts binary"
    total = parts.groupBy("slice", "salt").applyInPandas(_added, form).groupBy("slice").applyInPandas(_added, form)
    cells = np.zeros((SLICES, CELLS // SLICES), np.int64)
    for row in total.collect():
        cells[row["slice"]] = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    return levels_of(cells.reshape(-1))


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Levels in steps of a factor 2^(2/3), counted from half the mean of all cells."""
    base = max(counts.mean() / 2, 1.0)
    return np.clip(np.ceil(1.5 * np.log2(np.maximum(counts / base, 1.0))), 0, (1 << LEVEL_BITS) - 1).astype(np.uint64)


def ordered(shingles: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Shingles as numbers in the global order, ascending."""
    level = levels[(shingles >> np.uint64(44)).astype(np.int64)]
    return np.sort((level << np.uint64(64 - LEVEL_BITS)) | (shingles >> np.uint64(LEVEL_BITS)))


def _prefixes(levels, mean: float, run_rows: int):
    """Rows (token, salt, class, size) of the prefixes; a class once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("shingles", forget)
        table, seen, held, n = levels.value, set(), [], 0
        for batch in batches:
            for text in batch.column(0):
                own = shingle_set(text.as_py())
                if not len(own) or (name := class_of(own)) in seen:
                    continue
                seen.add(name)
                tokens = ordered(own, table)[: prefix_length(len(own))]
                held.append((tokens, name, len(own)))
                n += len(tokens)
                if n > 200_000:
                    yield _posting(held, mean, run_rows)
                    held, n = [], 0
        if held:
            yield _posting(held, mean, run_rows)

    return run


def _posting(held: list[tuple[np.ndarray, int, int]], mean: float, run_rows: int) -> pa.RecordBatch:
    lengths = [len(t) for t, _, _ in held]
    tokens = np.concatenate([t for t, _, _ in held])
    classes = np.repeat(np.array([c for _, c, _ in held], np.int64), lengths)
    sizes = np.repeat(np.array([s for _, _, s in held], np.int32), lengths)
    places = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
    level = (tokens >> np.uint64(64 - LEVEL_BITS)).astype(np.float64)
    # The number of rows the shingle may have, judged by its level.
    runs = np.maximum(1, np.where(level > 0, mean / 2 * 2 ** (level / 1.5), 0) / run_rows).astype(np.uint64)
    salt = ((classes.view(np.uint64) >> np.uint64(8)) % runs).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(tokens.view(np.int64)), pa.array(salt), pa.array(classes), pa.array(sizes), pa.array(places), pa.array(runs > 1)],
        ["token", "salt", "class", "size", "pos", "split"],
    )


_SHARED = "token long, class long, size int, pos int, center long, center_size int, center_pos int, split boolean, lone boolean"
_SHARED_NAMES = [c.split()[0] for c in _SHARED.split(", ")]


def _runs(batches: Iterator[pa.RecordBatch], lone: bool = False) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (token, salt, pos, class): those of runs with several classes, with the first one.

    With ``lone``, also the only class of a run of a split shingle, marked as such: other
    runs of the shingle may hold more. Of the run that is open, only its first row and its last class are kept between batches.
    """
    first, latest, emitted = None, None, False
    for batch in batches:
        rows = batch.to_pandas()
        rows = rows[["token", "salt", "class", "size", "pos", "split"]]
        if first is not None:
            rows = pd.concat([first, rows], ignore_index=True)
        token, salt, name = (rows[c].to_numpy() for c in ("token", "salt", "class"))
        starts = np.ones(len(rows), bool)
        starts[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
        fresh = starts.copy()
        fresh[1:] |= name[1:] != name[:-1]
        begin = np.maximum.accumulate(np.where(starts, np.arange(len(rows)), 0))
        center = name[begin]
        number = np.cumsum(starts) - 1
        # A batch may begin with the class that the one before ended with.
        fresh &= starts | (name != center)
        if first is not None:
            fresh &= starts | (number > 0) | (name != latest)
        several = np.bincount(number, weights=fresh)[number] > 1
        take = fresh & several
        if first is not None and emitted:
            take[0] = False
            take |= fresh & (number == 0) & ~starts
        alone = starts & ~several & rows["split"].to_numpy(bool) & lone
        alone[begin[-1]] = False
        if first is not None and emitted:
            alone[0] = False
        take |= alone
        out = rows[take]
        if len(out):
            at = begin[take]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[c].to_numpy()) for c in ("token", "class", "size", "pos")]
                + [pa.array(center[take])]
                + [pa.array(rows[c].to_numpy()[at]) for c in ("size", "pos")]
                + [pa.array(out["split"].to_numpy()), pa.array(alone[take])],
                _SHARED_NAMES,
            )
        last = begin[-1]
        emitted = bool(several[-1]) or (emitted and last == 0 and first is not None)
        first, latest = rows.iloc[[last]], name[-1]
    if lone and first is not None and not emitted and first["split"].iloc[0]:
        own = [pa.array(first[c].to_numpy()) for c in ("class", "size", "pos")]
        marks = [pa.array([True]), pa.array([True])]
        yield pa.RecordBatch.from_arrays([pa.array(first["token"].to_numpy()), *own, *own, *marks], _SHARED_NAMES)


def _text_rows(chosen: Callable[[], Callable[[pa.Array], np.ndarray]]):
    """One packed text per class, of the documents that ``chosen`` lets through; a class once per task.

    A text is a third of the size of its set, which it is read into again where it is compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("shingles", forget)
        might, seen = chosen(), set()
        for batch in batches:
            batch = batch.filter(pa.array(might(batch.column(0)), pa.bool_()))
            for start in range(0, batch.num_rows, 500):
                names, packed = [], []
                for text in batch.column(1).slice(start, 500):
                    own = shingle_set(text.as_py())
                    if len(own) and (name := class_of(own)) not in seen:
                        seen.add(name)
                        names.append(name)
                        packed.append(zlib.compress(text.as_py().encode("utf-8", "surrogatepass"), 6))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(packed, pa.binary())], ["class", "packed"])

    return run


def _checked(levels):
    """Rows (b, b_packed, a, a_packed) to linked pairs; neighbouring rows with one b share a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("shingles", forget)
        table = levels.value

        def unpacked(data: pa.Scalar) -> np.ndarray:
            return ordered(shingle_set(zlib.decompress(data.as_py()).decode("utf-8", "surrogatepass")), table)

        for batch in batches:
            probes, names = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            linked = ([], [])
            start = 0
            for i in range(1, len(probes) + 1):
                if i == len(probes) or probes[i] != probes[start] or i - start == TREE_SETS:
                    sets = [unpacked(x) for x in batch.column(3).slice(start, i - start)]
                    for m in Tree(sets).probe(unpacked(batch.column(1)[start])):
                        linked[0].append(names[start + m])
                        linked[1].append(probes[start])
                    start = i
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in linked], ["a", "b"])

    return run


def _verify(pairs: DataFrame, texts: DataFrame, levels) -> DataFrame:
    """The pairs (a, b) of classes that are linked.

    ``texts`` is bucketed by class: the pairs come to their first text, and this one goes to the second.
    """
    with_a = pairs.join(texts.select(F.col("class").alias("a"), F.col("packed").alias("a_packed")), "a")
    both = with_a.join(texts.select(F.col("class").alias("b"), F.col("packed").alias("b_packed")), "b")
    return both.select("b", "b_packed", "a", "a_packed").mapInArrow(_checked(levels), "a long, b long")


def _early(size_a: str, pos_a: str, size_b: str, pos_b: str, common: int = COMMON):
    """Whether a common shingle at these places can be one of the first ``common`` of a similar pair.

    From the first common shingle on, both sets have to hold the overlap they need; the
    next ones lie one place further each.
    """
    a, i, b, j = (F.col(c) for c in (size_a, pos_a, size_b, pos_b))
    return F.least(a - i, b - j) + (common - 1) >= _needed(a, b)


def _needed(a, b):
    """``needed_overlap`` as a column."""
    return F.floor((4 * (a + b) + 8) / 9)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with few_rows(spark, ROWS_AT_ONCE):
        summaries = stored(
            texts.mapInArrow(_summaries, "doc_id long, n_shingles long, class long, slice int, counts binary"),
            "jaccard-sizes",
        )
    table = sketch_levels(summaries)
    members = summaries.where("slice IS NULL").select("doc_id", "n_shingles", "class")
    mean = (members.agg(F.sum("n_shingles")).first()[0] or 0) / CELLS
    levels = spark.sparkContext.broadcast(table)

    prefixes = texts.select("text").mapInArrow(
        _prefixes(levels, max(mean, 2.0), RUN_ROWS), "token long, salt int, class long, size int, pos int, split boolean"
    )
    runs = stored(
        prefixes.repartition("token", "salt")
        .sortWithinPartitions("token", "salt", "pos", "class")
        .mapInArrow(partial(_runs, lone=True), _SHARED),
        "jaccard-shared",
    )
    # A class alone in its run stays if the shingle has another run, so another class.
    crossing = (
        runs.where("split").select("token", "center").distinct()
        .groupBy("token").agg(F.min("center").alias("low"), F.max("center").alias("high")).where("low < high")
    )
    lone = stored(runs.where("lone").join(crossing.select("token"), "token", "left_semi"), "jaccard-lone")
    shared = runs.where("NOT lone").unionByName(lone).drop("lone")
    # Without COMMON shared shingles (or all it needs, if fewer) a class has no partner.
    wanted = stored(
        shared.groupBy("class", "size")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= F.least(F.lit(COMMON), F.ceil(F.col("size") * 4 / 5)))
        .join(members.where("class IS NOT NULL"), "class")
        .groupBy("class")
        .agg(F.min("doc_id").alias("doc_id")),
        "jaccard-wanted",
    )
    # Each class is compared first with the class it shares most prefix shingles with.
    best = (
        shared.where("class <> center")
        .where(_early("size", "pos", "center_size", "center_pos"))
        .groupBy(F.col("class").alias("a"), F.col("center").alias("b"))
        .agg(F.count("*").alias("n"))
        .groupBy("a")
        .agg(F.max(F.struct("n", "b")).alias("best"))
        .select("a", F.col("best.b").alias("b"))
    )
    heads = shared.where("split").select("token", "center", "center_size", "center_pos").distinct()
    tops = heads.groupBy("token").agg(F.min(F.struct("center_pos", "center", "center_size")).alias("top"))
    across = (
        heads.join(tops, "token")
        .where(F.col("center") != F.col("top.center"))
        .where(_early("center_size", "center_pos", "top.center_size", "top.center_pos"))
        .select(F.col("center").alias("a"), F.col("top.center").alias("b"))
    )
    # One document per class gives its set. Its text is packed where it is read, as Spark holds whole rows while
    # it asks a condition, and dealt by class once, so that pairs can come to it.
    chosen = known_ids(wanted.select("doc_id"))
    with few_rows(spark, ROWS_AT_ONCE):
        found = texts.mapInArrow(_text_rows(chosen), "class long, packed binary").repartition(bucket_count(spark), "class")
        once = found.join(wanted.select("class"), "class", "left_semi").groupBy("class").agg(F.first("packed").alias("packed"))
        packed = bucketed(once, "jaccard-texts", ["class"], dealt=True)
        links = stored(_verify(best.unionAll(across).distinct(), packed, levels), "jaccard-links")
    first = components(links)

    named = shared.join(wanted.select("class"), "class").join(first.withColumnRenamed("node", "class"), "class", "left").select(
        "token", "class", "size", "pos", F.coalesce("component", "class").alias("component")
    )
    # Across components, the first shingle that a pair shares is enough. It lies so early in both that
    # the overlap they need fits behind it, which leaves out what many texts share at their ends.
    room = F.floor((4 * F.col("size") + 4) / 5)
    named = stored(named.where(F.col("size") - F.col("pos") >= room).distinct(), "jaccard-named")
    mixed = named.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    left = named.join(mixed, "token").select("token", *[F.col(c).alias(f"{c}_a") for c in ("class", "size", "pos", "component")])
    right = named.select("token", *[F.col(c).alias(f"{c}_b") for c in ("class", "size", "pos", "component")])
    across = (
        left.join(right, "token")
        .where("component_a < component_b")
        .where(_early("size_a", "pos_a", "size_b", "pos_b", common=1))
        .select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
        .distinct()
    )
    with few_rows(spark, ROWS_AT_ONCE):
        more = stored(_verify(across, packed, levels), "jaccard-more")
    if not more.isEmpty():
        first = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))

    classes = members.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("smallest"))
    grouped = classes.join(first.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "component", F.coalesce("component", "class")
    )
    smallest = grouped.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = grouped.join(smallest, "component").select("class", "component_id")
    return members.join(named, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id names their component; of repeated ids one row.

    Rows without an id cannot be named and are kept.
    """
    with temporary(docs.sparkSession, "near-duplicates"):
        found = near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
        dropped = stored(found, "jaccard-dropped", lasting=True)
    repeated = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    repeated = repeated.groupBy("doc_id").count().where("count > 1").select("doc_id")
    doubtful = known_ids(dropped.unionAll(repeated))
    # Only rows that may go, or may be there twice, are shuffled. They are paired as structs, so no
    # column of theirs can clash.
    rows = keep_rows(docs, "doc_id", doubtful).select(F.col("doc_id").cast("long").alias("_id"), F.struct("*").alias("row"))
    left = (
        rows.join(dropped.select(F.col("doc_id").alias("_id")), "_id", "left_anti")
        .groupBy("_id")
        .agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        .select("row.*")
    )
    return keep_rows(docs, "doc_id", doubtful, others=True).unionByName(left)
