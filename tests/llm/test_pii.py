import random
import re

import pytest

from plumbline.llm import pii


def plain(text):
    """The patterns as they are written, without any shortcut."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        total = sum(sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.findall("[0-9]", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_random_texts_like_the_patterns():
    rng = random.Random(5)
    parts = ["a", "b.c", "@", ".", "-", "1", "25", "255", "256", "0", "+", " ", "(", ")", "%", "4111111111111111", "é", "٣", "\n", "+1 (988) 555-2485", "x@y.z"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.find(text) == plain(text), text


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("mail bob (at) example dot com now", "email", "bob (at) example dot com"),
        ("write jane.doe [at] mail [dot] org", "email", "jane.doe [at] mail [dot] org"),
        ("user＠example．com", "email", "user＠example．com"),
        ("to jоhn@example.com.", "email", "jоhn@example.com"),
        ("x b​ob@ex.com", "email", "b​ob@ex.com"),
        ("plus four nine one five one two three four five six seven", "phone", "plus four nine one five one two three four five six seven"),
        ("ip one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
        ("card four one one one " + "one " * 12, "card", ("four one one one " + "one " * 12).strip()),
        ("card 41l1 1111 1111 1111", "card", "41l1 1111 1111 1111"),
        ("ip １９２.168.0.1", "ip", "１９２.168.0.1"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, part):
    _, every = pii.spans(text)
    assert (kind, text.index(part), text.index(part) + len(part)) in every
    assert part not in pii.redact(text, every)


def test_plain_spans_stay():
    text = "a dot b@example.com and 1.2.3.4"
    base, every = pii.spans(text)
    assert set(base) <= set(every) and len(base) == 2


@pytest.mark.parametrize("text", ["", "the one at two points", "at the dot of nine", "one two three", "plus one", "Él está en casa", "look at it. Then go"])
def test_clean_texts_have_nothing(text):
    assert pii.spans(text) == ([], [])


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "a@" * 60_000, "one " * 50_000, "[" * 100_000])
def test_long_runs_take_linear_time(text):
    pii.spans(text)


def test_scan_and_redact(documents):
    docs = documents([(1, "a@b.co"), (2, None), (3, ""), (1, "a@b.co"), (None, "x at y dot com")])
    rows = {(r["doc_id"], r["n_email"], r["spans"], r["n_disguised"]) for r in pii.scan(docs).collect()}
    assert rows == {(1, 1, "email:0:6", 0), (2, 0, "", 0), (3, 0, "", 0), (None, 0, "email:0:14", 1)}
    assert pii.scan(docs.limit(0)).count() == 0
    redacted = pii.redact_column(docs)
    assert redacted.schema == docs.schema
    assert {r["text"] for r in redacted.collect()} == {"[EMAIL]", None, ""}
