"""Language identification by a small convolutional network over bytes.

A text is cut into windows of a fixed number of bytes. Bytes are embedded, filters of
several widths run over them, each filter keeps its maximum over the window, and a softmax
over the languages follows. The network is trained with numpy on labelled windows. A
document's probabilities are the means over all its windows, weighted by their bytes, so
the whole text counts.

Training data is a bounded sample: for each language the ``per_language`` labelled documents
with the smallest hash of their id, and of each ``windows_per_doc`` excerpts; of more than
``languages`` languages those with the most labels are learned. The bound does
not depend on the size of the table; prediction reads every document and shuffles nothing.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a language
label that is null teaches nothing; without any labelled text all documents are ``und``;
repeated rows give repeated results; an empty table gives an empty result; other columns
are ignored and only the text enters a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.kept import begin
from plumbline.llm.rows import map_rows
from plumbline.session import stored

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Settings:
    """Sizes of the network and bounds of the training sample."""

    window: int = 128
    embedding: int = 6
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 12
    per_language: int = 400
    windows_per_doc: int = 6
    languages: int = 64
    epochs: int = 14
    batch: int = 128
    rate: float = 0.01
    seed: int = 7


@dataclass
class Network:
    """Weights. All widths are one matrix over the widest filter, narrow ones padded with zeros."""

    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    mask: np.ndarray
    window: int

    @property
    def width(self) -> int:
        return self.filters.shape[0] // self.embedding.shape[1]

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.out, self.out_bias]

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """Embedded bytes, the ``width`` neighbours of each position side by side."""
        embedded = self.embedding[windows]
        places = windows.shape[1] - self.width + 1
        return np.concatenate([embedded[:, k : k + places] for k in range(self.width)], axis=2)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        columns = self.columns(windows)
        n, places, size = columns.shape
        sums = (columns.reshape(n * places, size) @ self.filters).reshape(n, places, -1)
        pooled = np.maximum(sums.max(axis=1) + self.bias, 0)
        return softmax(pooled @ self.out + self.out_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut(text: bytes, window: int) -> np.ndarray:
    """All bytes of ``text`` as rows of ``window`` bytes, the last one filled up with zeros.

    ASCII capitals become small, so a text in capitals looks like any other.
    """
    data = np.frombuffer(text.lower(), np.uint8)
    rows = np.zeros((max(1, -(-len(data) // window)), window), np.uint8)
    rows.reshape(-1)[: len(data)] = data
    return rows


def new_network(languages: list[str], settings: Settings) -> Network:
    rng = np.random.default_rng(settings.seed)
    widest, e, f = max(settings.widths), settings.embedding, settings.filters
    mask = np.zeros((widest * e, f * len(settings.widths)), np.float32)
    for k, width in enumerate(settings.widths):
        mask[: width * e, k * f : (k + 1) * f] = 1
    filters = rng.normal(0, 1 / np.sqrt(widest * e), mask.shape).astype(np.float32) * mask
    embedding = rng.normal(0, 1, (256, e)).astype(np.float32)
    out = rng.normal(0, 0.1, (mask.shape[1], len(languages))).astype(np.float32)
    zeros = np.zeros(mask.shape[1], np.float32)
    return Network(
        languages, embedding, filters, zeros, out, np.zeros(len(languages), np.float32), mask, settings.window
    )


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], settings: Settings) -> Network:
    """Fit by Adam on the cross entropy; languages weigh the same whatever their counts."""
    net = new_network(languages, settings)
    rng = np.random.default_rng(settings.seed)
    counts = np.bincount(labels, minlength=len(languages))
    weights = (len(labels) / (len(languages) * np.maximum(counts, 1))).astype(np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for _ in range(settings.epochs):
        order = rng.permutation(len(labels))
        for start in range(0, len(order), settings.batch):
            chosen = order[start : start + settings.batch]
            step += 1
            for p, g, (m, v) in zip(net.parameters(), gradients(net, windows[chosen], labels[chosen], weights), moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def gradients(net: Network, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    columns = net.columns(windows)
    n, places, size = columns.shape
    sums = (columns.reshape(n * places, size) @ net.filters).reshape(n, places, -1)
    best = sums.argmax(axis=1)
    pooled = np.take_along_axis(sums, best[:, None, :], 1)[:, 0] + net.bias
    active = np.maximum(pooled, 0)
    error = softmax(active @ net.out + net.out_bias)
    error[np.arange(n), labels] -= 1
    error *= (weights[labels] / n)[:, None]
    back = (error @ net.out.T) * (pooled > 0)
    # Only the position of the maximum passes a gradient on.
    at = columns[np.arange(n)[:, None], best]
    d_filters = np.einsum("nf,nfs->sf", back, at, optimize=True) * net.mask
    d_at = (back[:, :, None] * net.filters.T[None]).reshape(n, -1, net.width, net.embedding.shape[1])
    hit = windows[np.arange(n)[:, None, None], best[:, :, None] + np.arange(net.width)]
    d_embedding = np.zeros_like(net.embedding)
    np.add.at(d_embedding, hit.reshape(-1), d_at.reshape(-1, net.embedding.shape[1]))
    return [d_embedding, d_filters, back.sum(0), active.T @ error, error.sum(0)]


def training_sample(docs: DataFrame, settings: Settings) -> DataFrame:
    """The bounded sample: (lang, excerpt). Each task keeps its smallest hashes before the shuffle."""
    place = F.xxhash64(F.lit(settings.seed), F.col("doc_id"), F.col("text"))
    length = F.length("text")
    excerpts = F.array(
        *[
            F.substr("text", (F.pmod(F.xxhash64(place, F.lit(k)), F.greatest(length - settings.window, F.lit(1))) + 1).cast("int"), F.lit(settings.window))
            for k in range(settings.windows_per_doc)
        ]
    )
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        F.col("lang").cast("string").alias("lang"), place.alias("place"), excerpts.alias("excerpts")
    )
    # The smallest of each part, then of all parts, so no task holds all rows of a frequent language.
    rows = rows.withColumn("part", F.pmod(F.col("place"), F.lit(16)))
    for keys in (["lang", "part"], ["lang"]):
        first = Window.partitionBy(*keys).orderBy("place")
        rows = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= settings.per_language).drop("n")
    return rows.drop("place", "part")


def fit(docs: DataFrame, settings: Settings = Settings()) -> Network | None:
    """Train on the labelled rows of ``docs``; None if there are none."""
    rows = stored(training_sample(docs, settings), "language-sample")
    # The languages with the most labels, as many as the network may have; equal ones by name.
    known = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(settings.languages)
    sample = rows.join(known.select("lang"), "lang", "left_semi").collect()
    if not sample:
        return None
    languages = sorted({r["lang"] for r in sample})
    windows, labels = [], []
    for row in sorted(sample, key=lambda r: (r["lang"], r["excerpts"])):
        seen = set()
        for k, excerpt in enumerate(row["excerpts"]):
            # Short texts are read with fewer words too, so that they are known as well.
            part = excerpt if k % 2 == 0 else excerpt[: 12 + 16 * k]
            if part and part not in seen and _LETTER.search(part):
                seen.add(part)
                windows.append(cut(part.encode(), settings.window)[0])
                labels.append(languages.index(row["lang"]))
    return train(np.array(windows), np.array(labels), languages, settings)


def predict(net: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and probability of each text."""
    names, scores, pending, owners, held = [UNDETERMINED] * len(texts), [0.0] * len(texts), [], [], 0
    if net is None:
        return names, scores
    totals = np.zeros((len(texts), len(net.languages)))

    def flush() -> None:
        nonlocal held
        if pending:
            windows = np.concatenate(pending)
            used = (windows > 0).sum(axis=1).astype(np.float64)
            step = 512
            for s in range(0, len(windows), step):
                got = net.probabilities(windows[s : s + step]) * used[s : s + step, None]
                np.add.at(totals, np.array(owners[s : s + step]), got)
            pending.clear()
            owners.clear()
            held = 0

    for i, text in enumerate(texts):
        if text and _LETTER.search(text):
            rows = cut(text.encode(), net.window)
            pending.append(rows)
            owners.extend([i] * len(rows))
            held += len(rows)
            if held >= 2048:
                flush()
    flush()
    for i, total in enumerate(totals):
        if (whole := total.sum()) > 0:
            best = int(total.argmax())
            names[i], scores[i] = net.languages[best], min(1.0, float(total[best] / whole))
    return names, scores


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """One row per document: (doc_id, lang_pred, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("langid")
        for batch in batches:
            names, scores = [], []
            for start in range(0, batch.num_rows, 200):
                got = predict(net, batch.column(1).slice(start, 200).to_pylist())
                names += got[0]
                scores += got[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, net: Network | None, least: float) -> DataFrame:
    """The rows of ``docs`` whose language is determined with a score of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("langid")
        for batch in batches:
            texts, keep = batch.column(batch.schema.get_field_index("text")), []
            for start in range(0, batch.num_rows, 200):
                names, scores = predict(net, texts.slice(start, 200).to_pylist())
                keep += [n != UNDETERMINED and s >= least for n, s in zip(names, scores)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_rows(docs, run)


def held_out(doc_id):
    """Whether a document takes no part in training: crc32 of its id modulo 3 is 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1
