"""Alignment of two tokenizers by lockstep merging.

Each text is encoded twice, and the end offsets of both token rows are merged. Offsets where
a token of A and a token of B end together cut the text into groups, and each such pair of
tokens is a link. All texts of a batch are merged at the same time: one state vector holds
a pointer into A and one into B per lane, every step moves the pointer of the smaller end
(both where the ends are equal, which emits a link and a cut), and lanes that are done are
compacted away. A lane is a span of ``LANE_BYTES`` bytes of the batch, since ends in different
spans can be merged independently; so a long text is many lanes and not many steps.

Before a run of spaces in front of a word both tokenizers always cut, if they are of the usual kind, which is
checked. Texts are then merged word by word, and a word that comes again, in the batch or
later, brings its tokens and groups along; other texts are merged whole.

``alignments`` gives the tokens and the sizes of the groups. ``link_counts`` adds up how often
two ids are linked in the corpus. Two linked tokens end at the same byte, so the bytes of
one are a suffix of the other's: an id pair is named by a token and a length, and there are
no more pairs than both vocabularies have bytes, times the ids that share the same bytes.
That is the bound of what is sent to the driver and the executors (``most_pairs``), at any
size of the corpus.

Defined cases: texts that are null or empty, or that one tokenizer does not give back byte by
byte, have no tokens; repeated rows are counted each; a row without id keeps its null; an
empty table gives an empty result; other columns are ignored. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bpe import Vocabulary
from plumbline.llm.pieces import is_plain
from plumbline.llm.rows import few_rows
from plumbline.session import stored

#: Bytes of text in a lane, and characters of text that are merged at the same time (or one text).
LANE_BYTES = 512
BATCH_CHARS = 200_000
#: Documents that are handed to a Python worker at once: a row holds all tokens of a document.
ROWS_AT_ONCE = 500
#: Encoded words a worker keeps before it starts afresh, and the longest text given to the ranks.
KEPT_WORDS = 250_000
RANKED_CHARS = 100_000
#: Fixed value: the pattern that byte-level tokenizer files stand for by name.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts that show whether a model keeps white space and characters as they are.
_PROBES = ["a", " a", "a ", "a  b   c", "\n x\t", "ﬁ ①x　y", "naïve e\u0301 É", "日本 語"]


@lru_cache(1)
def byte_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for.

    Printable bytes of Latin-1 stand for themselves, the others for 256, 257 and so on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_ranks(described: dict, checked: bool = False) -> dict[bytes, int] | None:
    """The vocabulary of a ``tokenizers`` file as ranks, if merging by rank is sure to give the same tokens.

    The file merges listed pairs, ranks merge any neighbours that spell a token. Both agree if
    the list follows the ids and every token, spelled out and merged by the ranks below its
    own, ends in the two parts that the list merges to it: as long as nothing has merged across the borders
    of a token's bytes, they merge as they do alone. None if that does not hold; ``checked``
    says that it is known to.
    """
    model, symbols = described["model"], byte_symbols()
    pre = described["pre_tokenizer"]
    usual = pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
    if not usual or described["normalizer"] or model.get("ignore_merges") or not set(symbols) <= set(model["vocab"]):
        return None
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    built = [model["vocab"][a + b] for a, b in pairs]
    if any(x >= y for x, y in zip(built, built[1:])):
        return None
    spelled = {s: bytes(symbols[c] for c in s) for s in [*symbols, *(a + b for a, b in pairs)]}
    ranks = {data: model["vocab"][s] for s, data in spelled.items()}
    if checked:
        return ranks
    plain = Vocabulary(ranks)
    alike = all(plain.merge(spelled[a + b], i) == [ranks[spelled[a]], ranks[spelled[b]]] for (a, b), i in zip(pairs, built))
    return ranks if alike else None


def described(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


class ByteLevel:
    """A byte-level tokenizer of a ``tokenizers`` file, which gets a space before each text.

    With ``ranked``, which only a file that ``merge_ranks`` accepts may have, ``tiktoken`` does the
    work for plain texts, three times as fast; the file's own tokenizer is loaded when it is needed.
    """

    def __init__(self, path: str, ranked: bool = False):
        self._path, self._loaded = path, None
        symbols, vocabulary = byte_symbols(), described(path)["model"]["vocab"]
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.tokens[i] = bytes(symbols[c] for c in piece) if all(c in symbols for c in piece) else piece.encode()
        self._ranked = self._encoding() if ranked else None

    def _encoding(self):
        import tiktoken

        ranks = merge_ranks(described(self._path), checked=True)
        return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _own(self):
        if self._loaded is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._loaded = Tokenizer.from_file(self._path)
            # The strings of special tokens are ordinary text.
            self._loaded.encode_special_tokens = True
        return self._loaded

    def encode(self, texts: list[str]) -> list[list[int] | None]:
        """Ids per text, which begins with a space; None where they do not give back its bytes."""
        out: list[list[int] | None] = [None] * len(texts)
        others = []
        for i, text in enumerate(texts):
            if self._ranked and len(text) <= RANKED_CHARS and is_plain(text):
                # All bytes are tokens, so nothing can be lost.
                out[i] = self._ranked.encode_ordinary(text)
            else:
                others.append(i)
        if others:
            encoded = self._own().encode_batch([texts[i] for i in others], add_special_tokens=False)
            for i, e in zip(others, encoded):
                out[i] = _faithful(e.ids, self.tokens, texts[i])
        return out

    @property
    def cuts(self) -> bool:
        """Whether plain texts are cut before spaces."""
        return self._ranked is not None


def _faithful(ids: list[int], tokens: list[bytes], text: str) -> list[int] | None:
    return ids if b"".join(map(tokens.__getitem__, ids)) == text.encode() else None


class Pieces:
    """A ``sentencepiece`` model, which adds the space itself.

    If no piece has a space behind another character, nothing merges across the beginning of a run of spaces.
    """

    def __init__(self, path: str):
        import sentencepiece

        self._own = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self._own.get_piece_size()
        names = self._own.id_to_piece(list(range(size)))
        self.tokens = [
            bytes([int(piece[3:-1], 16)]) if self._own.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(names)
        ]
        self._space = self._own.piece_to_id("▁")
        spaced = self.tokens[self._space] == b" " and not any(re.search("[^▁]▁", piece) for piece in names)
        # A model that rewrites characters, or white space, is used on whole texts.
        self.cuts = spaced and all(self._by_words(t) == self._own.encode(t) for t in _PROBES)

    def _by_words(self, text: str) -> list[int]:
        return [i for ids in self.encode(words_of(" " + text)) for i in ids or ()]

    def encode(self, texts: list[str]) -> list[list[int] | None]:
        """Ids per text, which begins with a space; None where they do not give back its bytes."""
        # The model puts back the space that is taken off here, unless nothing else is left.
        encoded = self._own.encode([t[1:] for t in texts], num_threads=1)
        # The mark of a space would be given back as a space.
        return [
            None if "▁" in t else _faithful(ids if t != " " else [self._space], self.tokens, t) for t, ids in zip(texts, encoded)
        ]


#: Runs of spaces with what follows them up to the next space.
words_of = re.compile(" +[^ ]*").findall
#: A space between other white space and more white space, or the end, is one piece with what is before it.
_joined_space = re.compile(r"[^\S ] (?:\s|\Z)").search


#: What is known of a text: the ids of both tokenizers, and how many of each are in its groups.
FIELDS = ("a_ids", "b_ids", "a_sizes", "b_sizes")


class Pair:
    """Two tokenizers with the byte lengths of their tokens, and the words merged so far.

    The fields of all words lie in a row, so texts are put together from them by one gather.
    """

    def __init__(self, a: str, b: str, ranked: bool = False):
        self.a, self.b = (ByteLevel(p, ranked) if p.endswith(".json") else Pieces(p) for p in (a, b))
        self.lengths_a, self.lengths_b = (np.array([len(t) for t in x.tokens], np.int64) for x in (self.a, self.b))
        self._cuts = self.a.cuts and self.b.cuts
        self._forget()

    def _forget(self) -> None:
        self._places: dict[str, int] = {}
        self._flat = [np.zeros(0, np.int32) for _ in FIELDS]
        self._ends = [np.zeros(1, np.int64) for _ in FIELDS]

    def align(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per field the values of all texts in a row, and where each text begins, with the end.

        A text has no tokens if those of a tokenizer do not give it back with a space before it.
        """
        spans = [self._spans(t) if t else [] for t in texts]
        if len(self._places) > KEPT_WORDS:
            self._forget()
        places = self._places
        # Long ones go last, so that they can be forgotten again.
        fresh = sorted(set(chain.from_iterable(spans)).difference(places), key=lambda w: len(w) > 64)
        n_kept = len(places) + sum(len(w) <= 64 for w in fresh)
        places.update(zip(fresh, range(len(places), len(places) + len(fresh))))
        for k, (flat, ends) in enumerate(self._merged(fresh)):
            self._ends[k] = np.concatenate([self._ends[k], len(self._flat[k]) + ends])
            self._flat[k] = np.concatenate([self._flat[k], flat])
        counts = [len(s) for s in spans]
        words = np.fromiter(map(places.__getitem__, chain.from_iterable(spans)), np.int64, sum(counts))
        of = np.repeat(np.arange(len(texts)), counts)
        lost = np.diff(self._ends[0])[words] == 0
        if lost.any():
            whole = np.bincount(of, lost, len(texts))[of] == 0
            words, of = words[whole], of[whole]
        out = []
        for k in range(len(FIELDS)):
            lengths = np.diff(self._ends[k])[words]
            begins = self._ends[k][words] - (np.cumsum(lengths) - lengths)
            values = self._flat[k][np.repeat(begins, lengths) + np.arange(lengths.sum())]
            sums = np.bincount(of, lengths, len(texts)).astype(np.int64)
            out.append((values, np.append(0, np.cumsum(sums))))
        for word in fresh[n_kept - len(places) :] if n_kept < len(places) else ():
            del places[word]
        for k in range(len(FIELDS)):
            self._ends[k] = self._ends[k][: n_kept + 1]
            self._flat[k] = self._flat[k][: self._ends[k][-1]]
        return out

    def _spans(self, text: str) -> list[str]:
        """The text in parts that begin and end with a cut."""
        text = " " + text
        return words_of(text) if self._cuts and is_plain(text) and not _joined_space(text) else [text]

    def _merged(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per field the values of all texts, merged at the same time, and the texts' ends; none where bytes are lost."""
        ids = [p if None not in p else ((), ()) for p in zip(self.a.encode(texts), self.b.encode(texts))]
        out = []
        for k in (0, 1):
            ends = np.cumsum(np.fromiter((len(p[k]) for p in ids), np.int64, len(ids)))
            out.append((np.fromiter(chain.from_iterable(p[k] for p in ids), np.int32, int(ends[-1]) if len(ends) else 0), ends))
        links = merge(np.cumsum(self.lengths_a[out[0][0]]), np.cumsum(self.lengths_b[out[1][0]]))
        # Every text ends with a cut, so groups are sizes between links, of all texts in a row.
        groups = np.searchsorted(links[0], out[0][1])
        return out + [(np.diff(x, prepend=-1).astype(np.int32), groups) for x in links]

    @property
    def most_pairs(self) -> int:
        """No corpus can link more different id pairs than this."""
        spelled = Counter(self.b.tokens), Counter(self.a.tokens)
        suffixes = (Counter(t[i:] for t in set(x.tokens) for i in range(len(t))) for x in (self.a, self.b))
        copies = max(max(spelled[0].values()), max(spelled[1].values()))
        return copies * sum(sum(n for s, n in found.items() if s in of) for found, of in zip(suffixes, spelled))


@lru_cache(1)
def tokenizers(a: str, b: str, ranked: bool = False) -> Pair:
    """Both tokenizers, kept as long as the Python worker lives."""
    return Pair(a, b, ranked)


@lru_cache(1)
def _vocabulary_sizes(a: str, b: str) -> tuple[int, int]:
    return tuple(len(ByteLevel(p).tokens if p.endswith(".json") else Pieces(p).tokens) for p in (a, b))


def merge(ends_a: np.ndarray, ends_b: np.ndarray, lane: int = LANE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """The places of the A and of the B tokens that end together, ascending.

    ``ends_a`` and ``ends_b`` are the ascending end offsets of the tokens of all texts, laid in a row.
    """
    if not len(ends_a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # The pointers of a lane begin at the first ends beyond its first byte.
    bounds = np.arange(lane, ends_a[-1], lane)
    cuts_a, cuts_b = (np.searchsorted(ends, bounds, side="right") for ends in (ends_a, ends_b))
    i, stop_a = np.append(0, cuts_a), np.append(cuts_a, len(ends_a))
    j, stop_b = np.append(0, cuts_b), np.append(cuts_b, len(ends_b))
    links_a, links_b = [], []
    while True:
        open_ = (i < stop_a) & (j < stop_b)
        if not open_.all():
            # No more ends can meet in a lane whose A or B tokens are used up.
            i, stop_a, j, stop_b = i[open_], stop_a[open_], j[open_], stop_b[open_]
            if not len(i):
                break
        a, b = ends_a[i], ends_b[j]
        met = a == b
        links_a.append(i[met])
        links_b.append(j[met])
        i, j = i + (a <= b), j + (b <= a)
    found_a, found_b = np.concatenate(links_a), np.concatenate(links_b)
    order = np.argsort(found_a)
    return found_a[order], found_b[order]


def _batches(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of bounded size, each with the place of its first text."""
    held, chars, begin = [], 0, 0
    for k, text in enumerate(texts):
        held.append(text.as_py())
        chars += len(held[-1] or "")
        if chars >= BATCH_CHARS:
            yield begin, held
            held, chars, begin = [], 0, k + 1
    if held:
        yield begin, held


_ALIGNED = pa.schema(
    [("doc_id", pa.int64())] + [(name, pa.list_(pa.int32())) for name in FIELDS]
)


def alignments(docs: DataFrame, a: str, b: str) -> DataFrame:
    """One row per document: (doc_id, a_ids, b_ids, a_sizes, b_sizes).

    The sizes are the numbers of A and of B tokens in each group; the last tokens of a group
    are linked. ``a`` and ``b`` are files that every executor can open: a ``tokenizers`` file
    (.json, byte level) or a ``sentencepiece`` model.
    """

    # Looked into once, by the driver.
    ranked = all(merge_ranks(described(p)) is not None for p in (a, b) if p.endswith(".json"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(a, b, ranked)
        for batch in batches:
            for begin, texts in _batches(batch.column(1)):
                lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v)) for v, o in own.align(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), *lists], schema=_ALIGNED)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(align, "doc_id long, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and where each row begins, with the end."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _linked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The id pairs of all links of a batch as numbers, and where each row's links begin, with the end."""
    pairs = []
    for ids, sizes in (("a_ids", "a_sizes"), ("b_ids", "b_sizes")):
        tokens, _ = _lists(batch.column(ids))
        groups, starts = _lists(batch.column(sizes))
        # All tokens of a text are in its groups, so the ends of the groups run on from text to text.
        pairs.append(tokens[np.cumsum(groups, dtype=np.int64) - 1].astype(np.int64))
    return pairs[0] << 32 | pairs[1], starts


def _rows(batches: Iterator[pa.RecordBatch], tokens: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Batches cut so that one has about ``tokens`` tokens, or one row."""
    for batch in batches:
        offsets = batch.column("a_ids").offsets.to_numpy()
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + tokens, side="right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def link_counts(aligned: DataFrame) -> DataFrame:
    """(a_id, b_id, n): how many links of the corpus hold the two ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in _rows(batches):
            fresh, n = np.unique(_linked(batch)[0], return_counts=True)
            pairs, where = np.unique(np.concatenate([pairs, fresh]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n]), len(pairs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in ((pairs >> 32).astype(np.int32), pairs.astype(np.int32), counts)], ["a_id", "b_id", "n"]
        )

    return aligned.mapInArrow(count, "a_id int, b_id int, n long").groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))


def _strings(tokens: int, ends: str) -> list[np.ndarray]:
    """For each of both endings, the decimal of every id with it behind."""
    return [np.array([f"{i}{end}".encode() for i in range(tokens)], object) for end in ends]


def _spelled(ids_a, ids_b, sizes_a, sizes_b, strings_a, strings_b) -> bytes:
    """The groups of one text: ``a1,a2|b1;a3|b2,b3``."""
    out = np.empty(len(ids_a) + len(ids_b), object)
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    for ids, sizes, ends, before, strings in (
        (ids_a, sizes_a, ends_a, ends_b - sizes_b, strings_a),
        (ids_b, sizes_b, ends_b, ends_a, strings_b),
    ):
        places = np.arange(len(ids)) + np.repeat(before, sizes)
        out[places] = strings[0][ids]
        out[places[ends - 1]] = strings[1][ids[ends - 1]]
    return b"".join(out.tolist())[:-1]


def digests(aligned: DataFrame, counts: DataFrame, a: str, b: str) -> DataFrame:
    """Per document the sizes of its alignment, how common its links are, and a digest of its groups.

    ``n_best`` counts links whose id pair is the most common one of its B id, ties included;
    ``count_sum`` adds up the corpus-wide counts of all links.
    """
    spark = aligned.sparkSession
    # At most ``most_pairs`` rows.
    table = counts.toArrow()
    pairs = table["a_id"].to_numpy().astype(np.int64) << 32 | table["b_id"].to_numpy()
    order = np.argsort(pairs)
    pairs, n = pairs[order], table["n"].to_numpy()[order]
    ids_b = pairs & 0xFFFFFFFF
    highest = np.zeros(int(ids_b.max(initial=-1)) + 1, np.int64)
    np.maximum.at(highest, ids_b, n)
    known = spark.sparkContext.broadcast((pairs, n, n == highest[ids_b]))
    sizes = _vocabulary_sizes(a, b)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        strings_a, strings_b = (_strings(n, ends) for n, ends in zip(sizes, (",|", ",;")))
        for batch in _rows(batches):
            linked, starts = _linked(batch)
            places = np.searchsorted(pairs, linked)
            sums, bests = (np.append(0, np.cumsum(x[places], dtype=np.int64))[starts] for x in (n, best))
            lists = [_lists(batch.column(c)) for c in ("a_ids", "b_ids", "a_sizes", "b_sizes")]
            hashed = [
                hashlib.sha256(
                    _spelled(*(v[s[k] : s[k + 1]] for v, s in lists), strings_a, strings_b)
                ).hexdigest()
                if starts[k + 1] > starts[k]
                else ""
                for k in range(batch.num_rows)
            ]
            lengths = [np.diff(s).astype(np.int64) for _, s in lists]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")]
                + [pa.array(x) for x in (lengths[0], lengths[1], lengths[2], lengths[3], np.diff(bests), np.diff(sums))]
                + [pa.array(hashed, pa.string())],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    return aligned.mapInArrow(
        digest,
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
    )


def measure(docs: DataFrame, a: str, b: str) -> DataFrame:
    """``digests`` of all documents, with every step stored: alignments, link counts, result."""
    with few_rows(docs.sparkSession, ROWS_AT_ONCE):
        aligned = stored(alignments(docs, a, b), "alignments")
        counts = stored(link_counts(aligned), "link-counts")
        return stored(digests(aligned, counts, a, b), "alignment-digests")
