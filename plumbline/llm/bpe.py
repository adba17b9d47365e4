"""Byte-level BPE by prefix dynamic programming.

A sequence of tokens is the encoding of its bytes exactly if every neighbouring pair is:
if encoding the bytes of the pair gives the pair back. So each prefix of a piece has one
last token, namely the token that ends there and fits the last token of the prefix before
it. The table of last tokens is the encoding of every prefix at once: appending bytes
extends it, and an edit cuts it back to the first changed byte and extends it again.

The tokens that end at a byte come from an automaton that is built as bytes are read: its
states are the beginnings of tokens, and each knows the tokens that end with it.

Texts are split by a pattern first, and each piece is encoded by itself. Encoded pieces are
kept in a table of bounded size per Python worker. Every document is handled inside its
own task; nothing is shuffled.

Defined cases: null texts are empty; an empty text has no tokens; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.kept import begin
from plumbline.llm.pieces import Splitter

#: Entries of encoded pieces, of checked pairs and of steps of the automaton after which a worker
#: makes room. Pieces that come again are kept.
KEPT_PIECES = 200_000
KEPT_PAIRS = 500_000
KEPT_STEPS = 500_000
#: Stands for the token before the first one; every token may follow it.
_NOTHING = -1


_FIRST, _SECOND = itemgetter(0), itemgetter(1)


class _State(dict):
    """What was read last, as far as a token can go on from it; by the next byte, the next state."""

    __slots__ = ("read", "ends", "vocabulary")

    def __init__(self, vocabulary: Vocabulary, read: bytes):
        super().__init__()
        self.vocabulary = vocabulary
        self.read = read
        #: Length, rank and neighbours of the tokens that end here and that merging can build, longest first.
        self.ends = tuple(
            (len(read) - i, vocabulary.built[read[i:]], vocabulary.before(vocabulary.built[read[i:]]))
            for i in range(len(read))
            if read[i:] in vocabulary.built
        )

    def __missing__(self, byte: int) -> _State:
        found = self[byte] = self.vocabulary.state(self.read + bytes((byte,)))
        return found


class _Before(dict):
    """Whether one token may stand right behind another one, by that one."""

    __slots__ = ("vocabulary", "token")

    def __init__(self, vocabulary: Vocabulary, token: int):
        super().__init__({_NOTHING: True})
        self.vocabulary = vocabulary
        self.token = token

    def __missing__(self, left: int) -> bool:
        found = self[left] = self.vocabulary.adjacent(left, self.token)
        self.vocabulary._pairs += 1
        return found


class Vocabulary:
    """Tokens with ranks, and which of them may stand next to each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        #: Tokens by rank; a rank that is not taken has none.
        self.tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        self._edges: dict[int, tuple[tuple[int, ...], tuple[int, ...]] | None] = {}
        self._before: dict[int, _Before] = {}
        #: Tokens that merging can build; others only stand for a whole piece.
        self.built = {token: rank for token, rank in ranks.items() if self.edges(rank)}
        self._beginnings = {token[:n] for token in self.built for n in range(1, len(token) + 1)}
        self._states: dict[bytes, _State] = {}
        self._steps = self._pairs = 0
        self.start = self.state(b"")

    def state(self, read: bytes) -> _State:
        """The state after ``read``: its longest end that a token begins with."""
        while read and read not in self._beginnings:
            read = read[1:]
        self._steps += 1
        found = self._states.get(read)
        if found is None:
            found = self._states[read] = _State(self, read)
        return found

    def before(self, token: int) -> _Before:
        if token not in self._before:
            self._before[token] = _Before(self, token)
        return self._before[token]

    def make_room(self) -> None:
        """Forget steps of the automaton and checked pairs if there are too many; they come back as they are needed."""
        if self._pairs >= KEPT_PAIRS:
            for pairs in self._before.values():
                pairs.clear()
                pairs[_NOTHING] = True
            self._pairs = 0
        if self._steps >= KEPT_STEPS:
            for state in self._states.values():
                state.clear()
            self._states, self._steps = {b"": self.start}, 0

    def merge(self, piece: bytes, below: float = float("inf")) -> list[int]:
        """The plain algorithm: merge the pair of the lowest rank, the leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            pairs = [self.ranks.get(a + b, below) for a, b in zip(parts, parts[1:])]
            best = min(pairs)
            if best >= below:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def edges(self, token: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        """The tokens that stand at the left and at the right edge while ``token`` is built.

        Each from the token itself down to a byte. None if merging never builds the token.
        """
        if token not in self._edges:
            data = self.tokens[token]
            if len(data) == 1:
                self._edges[token] = ((token,), (token,))
            else:
                halves = self.merge(data, token)
                known = [self.edges(h) for h in halves] if len(halves) == 2 else [None]
                if None in known:
                    self._edges[token] = None
                else:
                    self._edges[token] = ((token, *known[0][0]), (token, *known[1][1]))
        return self._edges[token]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether encoding the bytes of both gives these two tokens.

        Goes back in time over the merges that built them, the latest first. If the tokens
        at the border could have merged before that, they would have.
        """
        lefts, rights = self.edges(left)[1], self.edges(right)[0]
        i = j = 0
        before = float("inf")
        while True:
            x, y = lefts[i], rights[j]
            joined = self.ranks.get(self.tokens[x] + self.tokens[y])
            if joined is not None and joined < before:
                return False
            x_last, y_last = i == len(lefts) - 1, j == len(rights) - 1
            if x_last and y_last:
                return True
            if y_last or (not x_last and x > y):
                before, i = x, i + 1
            else:
                # Of equal ranks the left one merges first, so here an equal one is earlier.
                before, j = y + 1, j + 1


class Prefixes:
    """The last token of every prefix of a growing piece of bytes."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary = vocabulary
        self.piece = bytearray()
        #: By number of bytes; without bytes there is nothing.
        self.last: list[int] = [_NOTHING]
        self._state = vocabulary.start
        self.append(piece)

    def append(self, more: bytes) -> None:
        last, state, end = self.last, self._state, len(self.piece)
        self.piece += more
        for byte in more:
            state = state[byte]
            end += 1
            for length, token, follows in state.ends:
                if follows[last[end - length]]:
                    last.append(token)
                    break
        self._state = state

    def edit(self, start: int, end: int, replacement: bytes) -> None:
        """Replace bytes; only what begins at ``start`` is encoded again."""
        tail = bytes(self.piece[end:])
        del self.piece[start:], self.last[start + 1 :]
        # No token is longer than these bytes.
        self._state = self.vocabulary.start
        for byte in self.piece[max(0, start - self.vocabulary.longest) :]:
            self._state = self._state[byte]
        self.append(replacement + tail)

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes, by default of all."""
        at = len(self.piece) if end is None else end
        out = []
        while at:
            token = self.last[at]
            out.append(token)
            at -= len(self.vocabulary.tokens[token])
        return out[::-1]


class Encoder:
    """Texts to tokens and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.split = Splitter(pattern)
        self.pattern = self.split.pattern
        self._pieces = _Pieces(self.vocabulary)

    def encode(self, text: str) -> list[int]:
        return self._ids(self._found(text))

    def encode_spelled(self, text: str) -> tuple[list[int], bytes]:
        """The ids, and the same as decimals with spaces between."""
        found = self._found(text)
        return self._ids(found), b" ".join(map(_SECOND, found))

    @staticmethod
    def _ids(found: list[tuple[tuple[int, ...], bytes]]) -> list[int]:
        return list(chain.from_iterable(map(_FIRST, found)))

    def _found(self, text: str) -> list[tuple[tuple[int, ...], bytes]]:
        if len(self._pieces) >= KEPT_PIECES:
            self._pieces.turn()
        self.vocabulary.make_room()
        return list(map(self._pieces.__getitem__, self.split(text)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


class _Pieces(dict):
    """The ids of a piece, and the same as decimals; worked out when they are first needed.

    Pieces not needed between two turns go, so frequent ones stay and the number is bounded.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.earlier: dict[str, tuple[tuple[int, ...], bytes]] = {}

    def turn(self) -> None:
        self.earlier = dict(self)
        self.clear()

    def __missing__(self, piece: str) -> tuple[tuple[int, ...], bytes]:
        found = self.earlier.get(piece)
        if found is None:
            data = piece.encode()
            whole = self.vocabulary.ranks.get(data)
            ids = (whole,) if whole is not None else tuple(Prefixes(self.vocabulary, data).tokens())
            found = ids, " ".join(map(str, ids)).encode()
        if len(piece) < 64:
            self[piece] = found
        return found


class EditableText:
    """An encoded text that can be changed in place.

    Pieces are kept with their prefix tables. An edit encodes again only from the piece
    before it up to where the old and the new splitting meet.
    """

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder = encoder
        self.pieces = [(p, self._encode(p)) for p in encoder.pattern.findall(text)]

    def _encode(self, piece: str) -> Prefixes:
        return Prefixes(self.encoder.vocabulary, piece.encode())

    @property
    def text(self) -> str:
        return "".join(p for p, _ in self.pieces)

    def append(self, more: str) -> None:
        length = sum(len(p) for p, _ in self.pieces)
        self.edit(length, length, more)

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace the characters from ``start`` to ``end``."""
        text = self.text
        bounds = [0]
        for piece, _ in self.pieces:
            bounds.append(bounds[-1] + len(piece))
        # A split can depend on the piece before and on one character behind it.
        keep = max(0, sum(b <= start for b in bounds) - 3)
        changed = text[:start] + replacement + text[end:]
        shift, old, fresh = len(replacement) - (end - start), dict(zip(bounds, range(len(bounds)))), []
        tail = len(self.pieces)
        for m in self.encoder.pattern.finditer(changed, bounds[keep]):
            at = old.get(m.start() - shift)
            if m.start() >= start + len(replacement) + 1 and at is not None:
                tail = at
                break
            fresh.append(m[0])
        before = self.pieces[keep:tail]
        done = []
        for i, piece in enumerate(fresh):
            if i < len(before):
                prefixes = before[i][1]
                was, now = bytes(prefixes.piece), piece.encode()
                same = next((k for k, (a, b) in enumerate(zip(was, now)) if a != b), min(len(was), len(now)))
                prefixes.edit(same, len(was), now[same:])
            else:
                prefixes = self._encode(piece)
            done.append((piece, prefixes))
        self.pieces[keep:tail] = done

    def tokens(self) -> list[int]:
        ranks = self.encoder.vocabulary.ranks
        out: list[int] = []
        for piece, prefixes in self.pieces:
            whole = ranks.get(piece.encode())
            out += [whole] if whole is not None else prefixes.tokens()
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one token in base64 and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file, kept while the Python worker runs tasks of this operator."""
    return Encoder(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: (doc_id, ids).

    ``path`` is a rank file that every executor can open, such as one of an installed package.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("bpe", encoder.cache_clear)
        own = encoder(path, pattern)
        for batch in batches:
            for small in _slices(batch):
                ids = [own.encode(t or "") for t in small.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [small.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
                )

    return _texts(docs).mapInArrow(encode, "doc_id long, ids array<int>")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document the number and digest of its token ids, and the digest of what they decode to."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("bpe", encoder.cache_clear)
        own = encoder(path, pattern)
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for text in batch.column(1):
                ids, spelled = own.encode_spelled(text.as_py() or "")
                counts.append(len(ids))
                encoded.append(hashlib.sha256(spelled).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded), pa.array(decoded)],
                schema=pa.schema(
                    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
                ),
            )

    return _texts(docs).mapInArrow(
        digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
