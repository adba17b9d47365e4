"""Personal data in plain and in disguised form, with spans in the source text.

Plain identifiers are found by fixed patterns. For disguised ones a text runs through two
transducers: the first maps look-alike characters to ASCII one to one, the second rewrites
spelled digits, digit-like letters between digits, invisible characters and the forms of
"at" and "dot", and notes which stretch of the source each output stretch came from. The
patterns then run on the normalised text, and hits that touch a rewritten stretch are
mapped back to source characters.

Every whole text is scanned inside its own task; nothing is shuffled. The patterns are
written so that each takes time in proportion to the text, also on very long runs of one
character. Defined cases: null texts are empty; repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.kept import begin
from plumbline.llm.rows import map_rows

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match that fails from the start of a run of digits fails from anywhere inside it.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each ``@``: the run of local characters before it, the domain behind it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        hit = _DOMAIN.match(text, at + 1) if start < at else None
        if hit:
            yield start, hit.end()
            free = hit.end()
        else:
            free = at + 1
        at = text.find("@", free)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain identifiers, by kind, then start."""
    found = [("email", s, e) for s, e in _emails(text)]
    if not _DIGITS.search(text):
        return found
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


#: Letters of other scripts that look like Latin ones, and dashes.
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιν‐‑‒–—−․",
        "aeopcyxijshdqwABEKMHOPCTXIJSABEZHIKMNOPTYXoiv------.",
        strict=True,
    )
)
_KEPT = re.compile(r"[A-Za-z0-9@.+()\x20-]")


@lru_cache(1)
def _alike() -> tuple[dict[int, str], frozenset[str]]:
    """Characters with a look-alike: those above and all that compatibility forms fold to one."""
    table = {ord(k): v for k, v in LOOKALIKES.items()}
    for code in (*range(0xA0, 0x3400), *range(0xFB00, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200), *range(0x1FBF0, 0x1FBFA)):
        folded = unicodedata.normalize("NFKC", chr(code))
        if len(folded) == 1 and _KEPT.fullmatch(folded):
            table.setdefault(code, folded)
        elif (digit := unicodedata.digit(chr(code), None)) is not None:
            table.setdefault(code, str(digit))
    return table, frozenset(map(chr, table))


DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
REPEATS = {"double": 2, "triple": 3}
DIGIT_LETTERS = str.maketrans("OoQIl|ZSB", "000111258")

#: Domain endings after which a bare "at" counts although the dot is plain.
_ENDINGS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu"
_NUMBER = rf"(?:(?:{'|'.join(REPEATS)})[\x20-])?(?:{'|'.join(DIGIT_WORDS)})"
_REWRITE = re.compile(
    rf"""
      (?P<gone>[\u00ad\u200b-\u200f\u2060\ufeff]+)
    | (?P<at>\s*(?:\[\s*(?:at|@)\s*\]|\(\s*(?:at|@)\s*\)|\{{\s*(?:at|@)\s*\}}|<\s*(?:at|@)\s*>)\s*)
    | (?P<dot>\s*(?:\[\s*(?:dot|\.)\s*\]|\(\s*(?:dot|\.)\s*\)|\{{\s*(?:dot|\.)\s*\}}|<\s*(?:dot|\.)\s*>)\s*)
    | (?P<at_word>\x20+at\x20+(?=[A-Za-z0-9-]+(?:\x20+dot\x20+[A-Za-z0-9]|\s*[\[({{<]\s*(?:dot|\.)|(?:\.[A-Za-z0-9-]+)*\.(?:{_ENDINGS})\b)))
    | (?P<dot_word>(?<=[A-Za-z0-9])\x20+dot\x20+(?=[A-Za-z0-9]))
    | (?P<at_sign>(?<=[A-Za-z0-9])\x20+@\x20*(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@\x20+(?=[A-Za-z0-9]))
    | (?P<plus>(?<![A-Za-z])plus\x20+(?=[0-9(]|{_NUMBER}))
    | (?P<digits>(?<![A-Za-z]){_NUMBER}(?:(?:,\x20|[\x20-])?{_NUMBER})*(?![A-Za-z]))
    | (?P<letters>(?<=[0-9])[OoQIl|ZSB](?=[\x20-]?[0-9])|(?<=[0-9][\x20-])[OoQIl|ZSB](?=[0-9]))
    """,
    re.X | re.I,
)
_ONE_NUMBER = re.compile(_NUMBER, re.I)
#: Holds wherever ``_REWRITE`` does; small letters, so that the search stays cheap. The last
#: word of a spelled number is digit words run together, with no letter on either side.
_TRIGGER = re.compile(
    r"(?<![a-z])(?:(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)+|plus)(?![a-z])"
    r"|[\[({<]\s*(?:at|dot|@|\.)\s*[\])}>]|\s@|@\s|\x20dot\x20"
    r"|\x20at\x20+[a-z0-9-]+(?:\.[a-z0-9-]|\s*[\[({<])"
    r"|[0-9][\x20-]?[oqil|zsb][\x20-]?[0-9]|[­​-‏⁠﻿]"
)


def _small(text: str) -> str:
    """Lower case; patterns that ignore case take dotless and dotted i for one letter."""
    small = text.lower()
    return small if small.isascii() else small.replace("i\u0307", "i").replace("\u0131", "i")


def _spoken(words: str) -> str:
    out = []
    for m in _ONE_NUMBER.finditer(_small(words)):
        parts = re.split(r"[\x20-]", m[0])
        out.append(DIGIT_WORDS[parts[-1]] * (REPEATS[parts[0]] if len(parts) > 1 else 1))
    return "".join(out)


def _rewritten(m: re.Match) -> str:
    kind = m.lastgroup
    if kind == "gone":
        return ""
    if kind in ("at", "at_word", "at_sign"):
        return "@"
    if kind in ("dot", "dot_word"):
        return "."
    if kind == "plus":
        return "+"
    return _spoken(m[0]) if kind == "digits" else m[0].translate(DIGIT_LETTERS)


def normalise(text: str) -> tuple[str, list[int], list[int], list[bool]]:
    """The normalised text and its stretches: output starts, source starts, rewritten or not.

    The lists end with the lengths of both texts.
    """
    table, alike = _alike()
    same = text if text.isascii() or alike.isdisjoint(set(text)) else text.translate(table)
    parts, outs, sources, changed = [], [], [], []
    position = length = 0

    def add(piece: str, source: int, rewritten: bool) -> None:
        nonlocal length
        parts.append(piece)
        outs.append(length)
        sources.append(source)
        changed.append(rewritten)
        length += len(piece)

    if _TRIGGER.search(_small(same)):
        for m in _REWRITE.finditer(same):
            if m.start() > position:
                add(same[position : m.start()], position, False)
            add(_rewritten(m), m.start(), True)
            position = m.end()
    if position < len(same):
        add(same[position:], position, False)
    return "".join(parts), [*outs, length], [*sources, len(text)], changed


def find_disguised(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Source spans of identifiers that only the normalised text shows."""
    normal, outs, sources, changed = normalise(text)
    if normal == text:
        return []
    seen, added = set(plain), []
    for kind, start, end in find(normal):
        first, last = bisect_right(outs, start) - 1, bisect_right(outs, end - 1) - 1
        while not changed[first] and outs[first + 1] <= start:
            first += 1
        source_start = sources[first] if changed[first] else sources[first] + start - outs[first]
        source_end = sources[last + 1] if changed[last] else sources[last] + end - outs[last]
        span = (kind, source_start, source_end)
        if span in seen:
            continue
        touched = any(changed[first : last + 1]) or normal[start:end] != text[source_start:source_end]
        if touched:
            seen.add(span)
            added.append(span)
    return added


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Plain identifiers, and all of them with the disguised ones, by kind, then start."""
    plain = find(text)
    both = plain + find_disguised(text, plain)
    return plain, sorted(both, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """``text`` with a mark such as ``[EMAIL]`` in place of each stretch of spans.

    Overlapping spans are one stretch, named after the span that begins first.
    """
    out, position, ordered = [], 0, sorted(found, key=lambda s: (s[1], -s[2]))
    while ordered:
        kind, start, end = ordered.pop(0)
        while ordered and ordered[0][1] < end:
            end = max(end, ordered.pop(0)[2])
        out += [text[position:start], f"[{kind.upper()}]"]
        position = end
    return "".join([*out, text[position:]])


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin("pii")
    for batch in batches:
        columns = {name: [] for name in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_disguised")}
        for text in batch.column(1).to_pylist():
            plain, every = spans(text or "")
            for kind in KINDS:
                columns[f"n_{kind}"].append(sum(k == kind for k, _, _ in plain))
            columns["base_sha256"].append(hashlib.sha256(_joined(plain).encode()).hexdigest())
            columns["spans"].append(_joined(every))
            columns["n_disguised"].append(len(every) - len(plain))
        arrays = [pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in columns.items()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *columns])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of plain identifiers, all spans as text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _digest_batches,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long",
    )


def _redact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin("pii")
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = [t if t is None else redact(t, spans(t)[1]) for t in batch.column(at).to_pylist()]
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))


def redact_column(docs: DataFrame) -> DataFrame:
    """``docs`` with the identifiers in ``text`` replaced; null texts stay null."""
    return map_rows(docs, _redact_batches)
