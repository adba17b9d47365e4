import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from plumbline.llm import align

A, B = (public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [
    "the quick brown fox", "naïve café, 日本語 text 😀", "", None, "a", "  two  spaces\n\nand lines\t", "<|endoftext|> is text</s>",
    "a▁b keeps no byte of its own", "internationalisation " * 300, "x" * 5000, "the quick brown fox", "\x00\x01 control",
]


def plain(texts):
    """Every document's expected row, worked out with loops over byte offsets."""
    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    symbols = {s: b for s, b in align.byte_symbols().items()}
    words = {i: p for p, i in json.load(open(A))["model"]["vocab"].items()}
    groups = []
    for text in texts:
        ids_a = own.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = pieces.encode(text) if text else []
        bytes_a = [bytes(symbols[c] for c in words[i]) for i in ids_a]
        bytes_b = []
        for i in ids_b:
            p = pieces.id_to_piece(i)
            bytes_b.append(bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode())
        if not text or b"".join(bytes_a) != b" " + text.encode() or b"".join(bytes_b) != b" " + text.encode():
            groups.append([])
            continue
        ends_a, ends_b, at = {}, {}, 0
        for k, t in enumerate(bytes_a):
            at += len(t)
            ends_a[at] = k
        at = 0
        for k, t in enumerate(bytes_b):
            at += len(t)
            ends_b[at] = k
        own_groups, was_a, was_b = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            own_groups.append((ids_a[was_a : ends_a[end] + 1], ids_b[was_b : ends_b[end] + 1]))
            was_a, was_b = ends_a[end] + 1, ends_b[end] + 1
        groups.append(own_groups)
    counts = Counter((a[-1], b[-1]) for g in groups for a, b in g)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = []
    for g in groups:
        links = [(a[-1], b[-1]) for a, b in g]
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        rows.append(
            (
                sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g),
                sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
                hashlib.sha256(spelled.encode()).hexdigest() if g else "",
            )
        )
    return rows


def spark_rows(docs):
    return align.measure(docs, A, B)


def test_against_loops(documents):
    rng = random.Random(3)
    alphabet = ["the ", "ing", " ", "é", "日", "ß", "\n", "1234", "</s>", "ation", "X", "　"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    found = spark_rows(documents(list(enumerate(texts)))).collect()
    expected = plain(texts)
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == dict(enumerate(expected))
    assert expected[0][0] and expected[7] == (0, 0, 0, 0, 0, 0, "")


def test_null_ids_and_repeated_rows(documents):
    found = spark_rows(documents([(None, "one text"), (3, "one text"), (3, "one text")])).collect()
    assert sorted((r["doc_id"] or -1) for r in found) == [-1, 3, 3]
    assert {r["count_sum"] for r in found} == {3 * found[0]["n_links"]}


def test_empty_table(documents):
    assert spark_rows(documents([(1, "x")]).limit(0)).count() == 0


@pytest.mark.parametrize("lane", [1, 2, 7, 1000])
def test_merge_in_lanes(lane):
    rng = np.random.default_rng(lane)
    for _ in range(40):
        size = int(rng.integers(1, 200))
        a, b = (np.unique(np.append(np.flatnonzero(rng.random(size) < 0.5) + 1, size)) for _ in range(2))
        i, j = align.merge(a, b, lane)
        common = np.intersect1d(a, b)
        assert a[i].tolist() == common.tolist() == b[j].tolist()
    assert [len(x) for x in align.merge(np.zeros(0, np.int64), np.zeros(0, np.int64), lane)] == [0, 0]


def test_word_by_word_is_as_whole(monkeypatch):
    """Texts cut into words, with words kept from before, against texts merged whole."""
    cut, whole = align.Pair(A, B, True), align.Pair(A, B, True)
    assert cut._cuts
    whole._cuts = False
    monkeypatch.setattr(align, "KEPT_WORDS", 500)
    rng = random.Random(9)
    parts = [" ", "  ", "\n", "\t", "\u00a0", "the", "ing", "'s", "!", "é", "12", "X", "</s>", "日", "▁"]
    for _ in range(300):
        texts = ["".join(rng.choice(parts[: rng.choice([9, 13, 15])]) for _ in range(rng.choice([3, 20, 200]))) for _ in range(20)]
        for one, other in zip(cut.align(texts), whole.align(texts)):
            assert one[0].tolist() == other[0].tolist() and one[1].tolist() == other[1].tolist()


def test_pairs_are_bounded(documents):
    pair = align.tokenizers(A, B)
    assert pair.most_pairs < 2_000_000
    aligned = align.alignments(documents(list(enumerate(TEXTS))), A, B)
    for row in align.link_counts(aligned).collect():
        a, b = pair.a.tokens[row["a_id"]], pair.b.tokens[row["b_id"]]
        assert a.endswith(b) or b.endswith(a)
