"""What a worker keeps of encoded pieces."""

import random

import public_tokenizers
import tiktoken

from plumbline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_frequent_pieces_stay_and_the_rest_goes(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 20)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 30)
    monkeypatch.setattr(bpe, "KEPT_STEPS", 40)
    own = bpe.Encoder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.vocabulary.ranks, special_tokens={})
    made = []
    plain = bpe.Prefixes.__init__
    monkeypatch.setattr(bpe.Prefixes, "__init__", lambda self, *a: made.append(bytes(a[-1])) or plain(self, *a))
    rng = random.Random(4)
    for _ in range(300):
        text = "qwxyzzy " + " ".join("".join(rng.choices("aeinrst", k=9)) for _ in range(3))
        assert own.encode_spelled(text)[0] == theirs.encode_ordinary(text)
    assert made.count(b"qwxyzzy") == 1
    assert len(own._pieces) + len(own._pieces.earlier) < 60 and own.vocabulary._pairs < 100 and own.vocabulary._steps < 150
