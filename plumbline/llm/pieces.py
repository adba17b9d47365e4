"""Splitting texts by a tokenizer's pattern.

The patterns name Unicode classes, which the ``regex`` package looks up character by character.
Texts of ``PLAIN`` characters only are split by the standard library instead, with the classes
written out over these characters. Which of them are letters, numbers or white space has
been settled since long before any library in use, so both ways give the same pieces.
"""

from __future__ import annotations

import re
from functools import lru_cache

import regex

#: Latin blocks, general punctuation and the euro sign.
PLAIN = (range(0x250), range(0x2010, 0x2028), range(0x20AC, 0x20AD))
_plain = re.compile("[" + "".join(f"\\u{r[0]:04x}-\\u{r[-1]:04x}" for r in PLAIN) + "]*").fullmatch
_CLASSES = (r"\p{L}", r"\p{N}", r"\s", r"\S")


@lru_cache
def _members(name: str) -> str:
    """The plain characters of a class, for use between brackets."""
    own = regex.compile(name)
    return "".join(re.escape(chr(c)) for r in PLAIN for c in r if own.fullmatch(chr(c)))


def written_out(pattern: str) -> str | None:
    """The pattern with its classes as lists of plain characters; None if it has others."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        name = next((c for c in _CLASSES if pattern.startswith(c, i)), None)
        if name:
            out.append(_members(name) if inside else f"[{_members(name)}]")
            i += len(name)
            continue
        if pattern[i] == "\\":
            if pattern[i + 1 : i + 2] in ("p", "P", "w", "W", "d", "D", "b", "B", "X", "R"):
                return None
            out.append(pattern[i : i + 2])
            i += 2
            continue
        inside = pattern[i] == "[" or inside and pattern[i] != "]"
        out.append(pattern[i])
        i += 1
    return "".join(out)


class Splitter:
    """The matches of a pattern without groups, from left to right."""

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)
        plain = written_out(pattern)
        self._plain = re.compile(plain).findall if plain else self.pattern.findall

    def __call__(self, text: str) -> list[str]:
        return self._plain(text) if _plain(text) else self.pattern.findall(text)


def is_plain(text: str) -> bool:
    return _plain(text) is not None
