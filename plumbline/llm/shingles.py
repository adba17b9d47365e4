"""Word shingles as 64-bit hashes, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 5
#: Word hashes a worker keeps before it starts afresh.
KEPT_WORDS = 250_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value


_words = _Words()


def forget() -> None:
    _words.clear()


def word_hashes(text: str) -> np.ndarray:
    """One hash per word: words are divided by ASCII white space, A-Z count as a-z."""
    if len(_words) > KEPT_WORDS:
        _words.clear()
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def ngrams(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` words."""
    places = len(words) - size + 1
    if places < 1:
        return np.zeros(0, np.uint64)
    out = words[:places].copy()
    for k in range(1, size):
        out = out * _ODD + words[k : k + places]
    return mixed(out + np.uint64(size))


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles, ascending; a shorter text is one shingle, one without words none."""
    words = word_hashes(text or "")
    return np.unique(ngrams(words, min(SHINGLE_WORDS, len(words)))) if len(words) else words
