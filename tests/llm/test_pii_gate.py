"""The test for disguises lets through whatever the transducer rewrites."""

import random
import re

import pytest

from plumbline.llm import pii


@pytest.mark.parametrize(
    "text, kind",
    [
        ("card fouroneoneone oneoneoneone oneoneoneone oneoneoneone", "card"),
        ("+1fivefivefiveonetwothreefour567", "phone"),
        ("+1 800 triple oh 1234", "phone"),
        ("+1 5oh5 555 1234", "phone"),
        ("bob at -x.-y.com", "email"),
        ("+1 fıve five five 555 1234", "phone"),
    ],
)
def test_forms_of_the_transducer(text, kind):
    _, every = pii.spans(text)
    assert kind in [k for k, _, _ in every]


def test_spans_with_and_without_the_gate_agree(monkeypatch):
    rng = random.Random(3)
    parts = [*pii.DIGIT_WORDS, *pii.REPEATS, "one", "oh", "Oh", "NINE", "fıve", "SİX", "plus ", "+1", "800", "5", "1234", " ", " ", " ", "-", ", ", "l", "O", "|", "q"]
    parts += [" at ", " dot ", "(at)", "[ dot ]", "<.>", "{@}", " @ ", "@", ".", "com", ".com", "bob", "x-y", "­", "​", "ı", "a", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(30_000)]
    gated = [pii.normalise(t) for t in texts]
    monkeypatch.setattr(pii, "_TRIGGER", re.compile(""))
    for text, got in zip(texts, gated):
        assert got[0] == pii.normalise(text)[0], text
