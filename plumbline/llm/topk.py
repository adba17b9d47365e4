"""Exact top-k search by inner product over whole-number vectors.

Vectors are ordered by length. Norm quantiles cut the table into levels; a level is dealt
into groups of bounded size. The queries, in blocks, first meet the level of the longest
vectors, which gives every query a score that its k best reach at least. After that a
query only visits levels whose longest vector could still reach that score, by the
Cauchy-Schwarz inequality.

Inside a group, vectors are processed by descending length and rotated by the singular
vectors of a sample, so that few coordinates hold most of a product. The product of the
leading coordinates plus that of the lengths of the rest bounds the score; only where the
bound reaches the query's k-th best so far is the exact whole-number product taken. The
rotation comes from a bounded sample and decides speed only; bounds have room for rounding.

Queries are repeated once per group they visit, and no
task holds much more than GROUP_ROWS vectors and a block of BLOCK_ROWS queries, which it
works on QUERY_ROWS at a time, however many vectors are equal and queries are asked. A group
is repeated for each block that visits its level. The driver sees the quantiles, the counts of levels
and the sample.

Defined cases: a vector that is null, or holds a null or non-finite component, takes no
part, nor does a row without id; vectors of another length than the query's are no
candidates; equal rows count once; different vectors under one id are candidates each, the
smallest of them being the query; products beyond 64 bits are cut off at the largest long;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import stored

SCALE = 1024
#: Norm levels; vectors in a group; queries in a block and in a step; vectors the rotation is fitted on.
LEVELS = 8
GROUP_ROWS = 32_768
BLOCK_ROWS = 32_768
QUERY_ROWS = 512
SAMPLE_ROWS = 4096
#: Leading coordinates of the rotated vectors.
LEADING = 16
#: Candidates that are bounded in one step.
STEP = 2048

_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def scaled(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v, dim, norm): whole-number vectors of the rows that take part, equal rows once."""
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("x")
    )
    usable = rows.where(
        "id IS NOT NULL AND x IS NOT NULL AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) "
        "AND abs(c) < double('infinity'))"
    )
    whole = usable.select("id", F.transform("x", lambda c: F.floor(F.lit(float(SCALE)) * c).cast("double")).alias("v"))
    return whole.distinct().withColumn("dim", F.size("v")).withColumn(
        "norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    )


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """By dimension the singular vectors of the sample, those of the most weight first."""
    sample = rows.select("v", F.xxhash64("id").alias("place")).orderBy("place").limit(SAMPLE_ROWS).collect()
    by_dim: dict[int, list] = {}
    for row in sample:
        by_dim.setdefault(len(row["v"]), []).append(row["v"])
    out = {}
    for dim, chosen in by_dim.items():
        if dim:
            x = np.array(chosen)
            out[dim] = np.linalg.svd(x / max(np.abs(x).max(), 1.0), full_matrices=len(x) < dim)[2].T
    return out


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit numbers."""
    most = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * queries.shape[1]
    if most < _EXACT:
        return (queries @ vectors.T).astype(np.int64)
    whole = np.array([[int(c) for c in q] for q in queries], object)
    other = np.array([[int(c) for c in v] for v in vectors], object)
    return np.clip(whole @ other.T, -_LONG - 1, _LONG).astype(np.int64)


class Group:
    """Vectors of one dimension, longest first, with rotated parts and residual lengths."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray | None):
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        order = np.lexsort((ids, -norms))
        self.ids, self.vectors, self.norms = ids[order], vectors[order], norms[order]
        self.rotation = rotation
        self.lead, self.rest = split(self.vectors, rotation)


def split(vectors: np.ndarray, rotation: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The leading rotated coordinates, and the length of what they leave out."""
    if rotation is None:
        return np.zeros((len(vectors), 0)), np.sqrt((vectors * vectors).sum(axis=1))
    turned = vectors @ rotation
    return turned[:, :LEADING], np.sqrt((turned[:, LEADING:] ** 2).sum(axis=1))


def best_of(group: Group, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> pd.DataFrame:
    """For each query the k best of the group among scores of at least its floor."""
    lead, rest = split(queries, group.rotation)
    norms = np.sqrt((queries * queries).sum(axis=1))
    floors = floors.astype(float)
    held: list[list] = [[] for _ in ids]
    for start in range(0, len(group.ids), STEP):
        part = slice(start, start + STEP)
        # Lengths only fall from here on, so a query may be through.
        room = 1e-9 * norms * group.norms[start] + 1e-6
        active = np.nonzero(norms * group.norms[start] + room >= floors)[0]
        if not len(active):
            break
        bounds = lead[active] @ group.lead[part].T + rest[active][:, None] * group.rest[part][None]
        possible = bounds + room[active][:, None] >= floors[active][:, None]
        for row, q in enumerate(active):
            chosen = np.nonzero(possible[row])[0] + start
            chosen = chosen[group.ids[chosen] != ids[q]]
            if not len(chosen):
                continue
            scores = products(queries[q : q + 1], group.vectors[chosen])[0]
            both = held[q] + list(zip((-scores).tolist(), group.ids[chosen].tolist()))
            both.sort()
            held[q] = both[:k]
            if len(both) >= k:
                floors[q] = max(floors[q], -held[q][-1][0])
    rows = [(int(q), v, -s) for q, best in zip(ids, held) for s, v in best]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")


_FOUND = "query_id long, vec_id long, score long"


def _search(rotation: dict[int, np.ndarray], k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame(columns=["query_id", "vec_id", "score"]).astype("int64")]
        if len(candidates) and len(queries):
            dim = int(candidates["dim"].iloc[0])
            vectors = np.array(candidates["v"].tolist(), float).reshape(len(candidates), dim)
            group = Group(candidates["id"].to_numpy(np.int64), vectors, rotation.get(dim))
            for start in range(0, len(queries), QUERY_ROWS):
                block = queries.iloc[start : start + QUERY_ROWS]
                own = np.array(block["v"].tolist(), float).reshape(len(block), dim)
                parts.append(best_of(group, block["id"].to_numpy(np.int64), own, block["floor"].to_numpy(float), k))
        return pd.concat(parts, ignore_index=True)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of ``vectors`` for each row of ``queries``."""
    rows = stored(scaled(vectors, id_column, vector_column), "vectors")
    asked = stored(
        scaled(queries, id_column, vector_column).groupBy("id", "dim").agg(F.min("v").alias("v"))
        .groupBy("id").agg(F.min(F.struct("v", "dim")).alias("q")).select("id", "q.v", "q.dim"),
        "queries",
    ).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)))
    rotation = rotations(rows)
    # Levels by descending norm; equal norms share one and are dealt to groups by id.
    shares = [1 - (i + 1) / LEVELS for i in range(LEVELS - 1)]
    cuts = rows.agg(F.percentile_approx("norm", shares, 10_000)).first()[0] or [0.0] * len(shares)
    level = F.lit(0)
    for i, cut in enumerate(cuts):
        level = F.when(F.col("norm") < cut, i + 1).otherwise(level)
    leveled = rows.withColumn("level", level)
    counts = leveled.groupBy("dim", "level").agg(F.count("*").alias("n"), F.max("norm").alias("longest"))
    sized = stored(counts.withColumn("groups", F.ceil(F.col("n") / GROUP_ROWS).cast("long")), "levels")
    dealt = leveled.join(sized.select("dim", "level", "groups"), ["dim", "level"]).withColumn(
        "part", F.pmod(F.xxhash64("id", "v"), F.col("groups"))
    ).select("dim", "level", "part", "id", "v")
    # Ids of queries are distinct, so their hash deals them evenly.
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    keys = ["dim", "level", "part", "block"]

    def met(those: DataFrame, which: DataFrame) -> DataFrame:
        """Each query with a floor and its block, once for every level it has to visit."""
        pairs = those.join(which.select("dim", "level", "groups", "longest"), "dim")
        useful = pairs.where(F.col("norm") * F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("floor"))
        return useful.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))

    def searched(candidates: DataFrame, those: DataFrame, which: DataFrame) -> DataFrame:
        visits = met(those, which)
        levels = stored(visits.select("dim", "level", "block").distinct(), "visits")
        repeated = candidates.join(levels, ["dim", "level"]).select(*keys, "id", "v")
        parts = visits.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).select(
            *[F.col(c).alias(c) for c in (*keys, "id", "v", "floor")]
        )
        return repeated.groupBy(*keys).cogroup(parts.groupBy(*keys)).applyInPandas(_search(rotation, k), _FOUND)

    head = sized.groupBy("dim").agg(F.min("level").alias("level"))
    heads = sized.join(head, ["dim", "level"], "left_semi")
    nothing = asked.withColumn("floor", F.lit(float("-inf")))
    first = stored(
        _ranked(searched(dealt.join(head, ["dim", "level"], "left_semi"), nothing, heads), k).drop("rank"), "first-scores"
    )
    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least"))
    bounded = asked.join(floors, asked["id"] == floors["query_id"], "left").select(
        "id", "v", "dim", "norm", F.when(F.col("n") >= k, F.col("least")).otherwise(float("-inf")).alias("floor")
    )
    others = sized.join(head, ["dim", "level"], "left_anti")
    rest = searched(dealt.join(head, ["dim", "level"], "left_anti"), bounded, others)
    return _ranked(first.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")
