import random

import public_tokenizers
import regex
from tokenizers import Tokenizer

from plumbline.llm import align, pieces


def test_plain_texts_split_alike():
    rng = random.Random(4)
    chars = [chr(c) for r in pieces.PLAIN for c in r]
    common = "  \n\t's'llabcZ19!?-é²½"
    split, whole = pieces.Splitter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN)
    for _ in range(20000):
        text = "".join(rng.choice(common if rng.random() < 0.7 else chars) for _ in range(rng.randint(0, 25)))
        assert pieces.is_plain(text) and split(text) == whole.findall(text)
    for text in ("日本 語", "a😀b", "a​b", "힣 x"):
        assert not pieces.is_plain(text) and split(text) == whole.findall(text)
    assert pieces.written_out(r"\w+|\p{Lu}") is None
    assert pieces.Splitter(r"\w+").__call__("ab c") == ["ab", "c"]


def test_every_plain_character_in_the_tokenizer_file():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, plain = align.ByteLevel(path, ranked=True), Tokenizer.from_file(path)
    assert align.merge_ranks(align.described(path)) is not None
    plain.encode_special_tokens = True
    assert align.BYTE_LEVEL_PATTERN == public_tokenizers.PATTERN
    texts = [f"a{c} 1{c} !{c}  {c}x{c}{c} '{c}" for c in (chr(c) for r in pieces.PLAIN for c in r)] + ["日本 a", " the the  ", "x" * 150_000]
    texts = [" " + t for t in texts]
    assert own.encode(texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_are_encoded_as_in_whole_texts():
    own = align.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    assert own.cuts
    rng = random.Random(6)
    parts = [" ", "  ", "the", "ing", "\n", "é", "日", "１", "ﬁ", "e\u0301", "</s>", "<unk>", "<0x41>", "\t", "x", "1", "　", "\u200b", "😀"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 20)))
        assert own._own.encode(text) == own._by_words(text), text


def test_ranks_are_refused_where_merges_differ():
    symbols = {s: i for i, s in enumerate(align.byte_symbols())}
    pre = {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}

    def ranks(merges):
        vocabulary = dict(symbols)
        for a, b in merges:
            vocabulary.setdefault(a + b, len(vocabulary))
        return align.merge_ranks({"normalizer": None, "pre_tokenizer": pre, "model": {"vocab": vocabulary, "merges": merges}})

    assert ranks([("a", "b"), ("ab", "c")])[b"abc"] == 257
    # by rank, "abc" is built from "ab" and "c", while the list merges "a" and "bc"
    assert ranks([("a", "b"), ("b", "c"), ("a", "bc")]) is None
