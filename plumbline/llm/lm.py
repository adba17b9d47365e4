"""Stupid-backoff scores of a corpus under its own n-gram counts, a document's own left out.

Words and word pairs of every document are counted. The count of a pair divided by that of
its first word scores the second word; a pair that no other document has is scored by the
word alone, times ALPHA; a word that no other document has counts as seen once, times ALPHA
again. A document's score is the mean logarithm over its words.

Documents are dealt to chunks of a few megabytes by the hash of id and text. A chunk counts
its n-grams before anything is shuffled and sends them to buckets by ranges of their hash,
one packed row per chunk and bucket. A bucket adds up the counts of all chunks and sends
each chunk the totals of just the n-grams it asked for, where they are joined to the
exploded n-grams and summed per document. Chunks and buckets grow in number with the
input, not in size; a frequent n-gram is one entry per chunk. Nothing but the number of
bytes and words passes the driver.

N-grams are told apart by 64 bits of hash. Defined cases: null texts and texts without
words have null scores, as has a document that is alone in having words; repeated rows are
documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shingles import ngrams, word_hashes
from plumbline.session import stored

ALPHA = 0.4
#: Bytes of text in a chunk, and bytes of text whose n-grams share a bucket.
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 24 << 20


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs; the first byte says how many."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + planes.T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T
    out = np.zeros((len(planes), 8), np.uint8)
    out[:, :width] = planes
    return out.reshape(-1).view("<u8")


def _bucket_starts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets begin and end in sorted keys."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


def _grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    words = word_hashes(text or "")
    return ngrams(words, 1), ngrams(words, 2)


def _count(buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [g for text in pdf["text"] for g in _grams(text)]
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        starts = _bucket_starts(keys, buckets)
        rows = []
        for b in np.nonzero(np.diff(starts))[0]:
            low, high = starts[b], starts[b + 1]
            steps = np.diff(keys[low:high], prepend=np.uint64(0))
            head = int(steps[0])
            steps[0] = 0
            rows.append((int(b), int(pdf["chunk"].iloc[0]), str(head), _packed(steps), _packed(counts[low:high])))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "head", "steps", "counts"])

    return run


def _total(pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals for the n-grams of each chunk, in the order it sent them."""
    asked, counts = [], []
    for head, steps, own in zip(pdf["head"], pdf["steps"], pdf["counts"]):
        deltas = _unpacked(steps).copy()
        deltas[0] = np.uint64(int(head))
        asked.append(np.cumsum(deltas, dtype=np.uint64))
        counts.append(_unpacked(own).astype(np.int64))
    every = np.concatenate(asked)
    order = np.argsort(every, kind="stable")
    sorted_keys = every[order]
    new = np.ones(len(every), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    sums = np.add.reduceat(np.concatenate(counts)[order], np.nonzero(new)[0])
    totals = np.empty(len(every), np.int64)
    totals[order] = sums[np.cumsum(new) - 1]
    cuts = np.cumsum([len(a) for a in asked])[:-1]
    return pd.DataFrame(
        {"chunk": pdf["chunk"], "bucket": pdf["bucket"], "totals": [_packed(t) for t in np.split(totals, cuts)]}
    )


def _score(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """Per document: words, sum of logarithms without the corpus size, and how often it is missing."""
    grams = [_grams(text) for text in docs["text"]]
    keys = np.unique(np.concatenate([g for pair in grams for g in pair]))
    parts = [_unpacked(t) for t in answers.sort_values("bucket")["totals"]]
    totals = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    sizes, sums, alone = [], [], []
    for words, pairs in grams:
        n = len(words)
        sizes.append(n)
        if not n:
            sums.append(0.0)
            alone.append(0)
            continue
        word, pair = _others(keys, totals, words), _others(keys, totals, pairs)
        by_word = np.log(np.maximum(word, ALPHA))
        by_word[1:] += math.log(ALPHA)
        used = by_word.copy()
        known = np.zeros(n, bool)
        known[1:] = pair > 0
        before = np.maximum(word[:-1], 1)
        used[1:][known[1:]] = np.log(pair[pair > 0] / before[pair > 0])
        sums.append(float(used.sum()))
        alone.append(int(n - known.sum()))
    return pd.DataFrame({"doc_id": docs["doc_id"], "n_words": sizes, "logs": sums, "n_alone": alone})


def _others(keys: np.ndarray, totals: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The counts of ``grams`` in all other documents."""
    distinct, at, own = np.unique(grams, return_inverse=True, return_counts=True)
    return (totals[np.searchsorted(keys, distinct)] - own)[at]


def scores(docs: DataFrame) -> DataFrame:
    """One row per document: (doc_id, n_words, n_backed_off, score)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    chunks, buckets = max(1, -(-size // CHUNK_BYTES)), max(1, -(-size // BUCKET_BYTES))
    dealt = texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    counted = dealt.groupBy("chunk").applyInPandas(
        _count(buckets), "bucket long, chunk long, head string, steps binary, counts binary"
    )
    answers = counted.groupBy("bucket").applyInPandas(_total, "chunk long, bucket long, totals binary")
    parts = stored(
        dealt.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInPandas(_score, "doc_id long, n_words long, logs double, n_alone long"),
        "lm-parts",
    )
    total = parts.agg(F.sum("n_words")).first()[0] or 0
    rest = F.lit(total) - F.col("n_words")
    score = (F.col("logs") - F.col("n_alone") * F.log(rest)) / F.col("n_words")
    # The first word has no pair to fall back from.
    backed_off = F.col("n_alone") - 1
    has_score = (F.col("n_words") > 0) & (rest > 0)
    return parts.select(
        "doc_id",
        "n_words",
        F.when(F.col("n_words") > 0, backed_off).otherwise(0).alias("n_backed_off"),
        F.when(has_score, score).alias("score"),
    )
