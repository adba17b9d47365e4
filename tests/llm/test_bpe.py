import random

import public_tokenizers
import pytest
import tiktoken

from plumbline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "e", " ", "\n", "!", "!!", "é", "ß", "1", "the", "ing", "\t", "  ", "ö", "日本", "😀", "_", "-", "=", "​", "s", "'s", "'", "\r", "<|endoftext|>"]


@pytest.fixture(scope="module")
def own():
    return bpe.encoder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.vocabulary.ranks, special_tokens={})


def random_text(rng):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30)))


def test_random_texts(own, theirs):
    rng = random.Random(1)
    for _ in range(4000):
        text = random_text(rng)
        ids = own.encode(text)
        assert ids == theirs.encode_ordinary(text)
        assert own.decode(ids).decode() == text


def test_every_prefix_is_encoded(own):
    piece = " internationalisations!!".encode()
    table = bpe.Prefixes(own.vocabulary, piece)
    for end in range(len(piece) + 1):
        assert table.tokens(end) == own.vocabulary.merge(piece[:end])


def test_appends_and_edits_of_bytes(own):
    rng = random.Random(2)
    table = bpe.Prefixes(own.vocabulary, b"abc")
    data = b"abc"
    for _ in range(300):
        i = rng.randint(0, len(data))
        j = rng.randint(i, min(len(data), i + 4))
        new = rng.choice(PARTS).encode()
        data = data[:i] + new + data[j:]
        table.edit(i, j, new)
        assert table.tokens() == own.vocabulary.merge(data)


def test_edits_of_texts(own, theirs):
    rng = random.Random(3)
    for _ in range(400):
        text = random_text(rng)
        edited = bpe.EditableText(own, text)
        for _ in range(4):
            i = rng.randint(0, len(text))
            j = rng.randint(i, min(len(text), i + 5))
            new = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 4)))
            text = text[:i] + new + text[j:]
            edited.edit(i, j, new)
            assert edited.text == text and edited.tokens() == theirs.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20_000, "!" * 20_000, " " * 20_000, "1234567890" * 2000])
def test_long_pieces(own, theirs, text):
    assert own.encode(text) == theirs.encode_ordinary(text)


def test_documents(documents, theirs):
    docs = documents([(1, "Hello the ing"), (2, None), (3, ""), (1, "Hello the ing"), (None, "x")])
    rows = [(r["doc_id"], r["n_tokens"]) for r in bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()]
    n = len(theirs.encode_ordinary("Hello the ing"))
    assert sorted(rows, key=str) == sorted([(1, n), (1, n), (2, 0), (3, 0), (None, 1)], key=str)
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert ids[1] == theirs.encode_ordinary("Hello the ing") and ids[2] == []
    assert bpe.encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
