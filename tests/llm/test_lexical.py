import math
import random
import re
from collections import Counter

import pytest

from plumbline.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """Every item's ranking, scored document by document."""
    held = [(i, words(t)) for i, t in docs]
    held = [(i, Counter(w), len(w)) for i, w in held if w]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(words(t))
    rows = []
    for item, terms in wanted.items():
        scored = []
        for i, counts, n in held:
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * counts[t]) // (1000 * counts[t] + 20 * m))
                for t in terms
                if t in counts
            )
            if score > 0:
                scored.append((-score, i is None, i, score))
        scored.sort(key=lambda r: r[:2] + (r[2] or 0,))
        rows += [(item, rank + 1, r[2], r[3]) for rank, r in enumerate(scored[:k])]
    return sorted(rows, key=repr)


def items_of(spark, rows):
    return spark.createDataFrame([(*r, 7) for r in rows], "item_id long, text string, term int")


@pytest.fixture
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "THE", "é", "日本", "ÀÉ", "x1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]

    def text(size):
        return rng.choice([" ", ", ", "-", "\n", "_"]).join(rng.choices(vocabulary, weights, k=size))

    docs = [(i, text(rng.choice([1, 3, 10, 40, 40, 40, 400]))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, "?!"), (None, docs[3][1]), (None, "w1 w1"), (7, docs[7][1]), (7, docs[7][1])]
    docs += [(600 + i, docs[0][1]) for i in range(30)] + [(900, " ".join(vocabulary) * 300)]
    items = [(i, text(rng.randint(1, 30))) for i in range(12)] + [(50, "nothing known"), (51, None), (52, ""), (3, "w2 w59"), (None, "w3 the")]
    return docs, items


@pytest.mark.parametrize("block, cells", [(1 << 15, 1 << 20), (60, 50)])
def test_against_every_document(spark, documents, rows, corpus, monkeypatch, block, cells):
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", block)
    monkeypatch.setattr(lexical, "CELLS", cells)
    docs, items = corpus
    index = lexical.build_index(documents(docs))
    assert rows(lexical.search(index, items_of(spark, items), 10)) == plain(docs, items, 10)


def test_chunks_of_items(spark, documents, rows, corpus, monkeypatch):
    monkeypatch.setattr(lexical, "CHUNK_PAIRS", 40)
    docs, items = corpus
    index = lexical.build_index(documents(docs))
    assert rows(lexical.search(index, items_of(spark, items), 3)) == plain(docs, items, 3)


def test_strata_hold_all_documents(documents, corpus):
    docs, _ = corpus
    index = lexical.build_index(documents(docs))
    assert (index.n_docs, index.n_terms) == (sum(bool(words(t)) for _, t in docs), sum(len(words(t)) for _, t in docs))
    assert sum(len(r["doc_ids"]) for r in index.blocks.collect()) == index.n_docs


def test_empty_tables(spark, documents, rows):
    none = documents([(1, "a")]).limit(0)
    assert rows(lexical.search(lexical.build_index(none), items_of(spark, [(1, "a")]))) == []
    index = lexical.build_index(documents([(1, "a b"), (2, "c")]))
    assert rows(lexical.search(index, items_of(spark, [(1, "a")]).limit(0))) == []
    assert [r[:3] for r in rows(lexical.search(index, items_of(spark, [(1, "A? c")])))] == [(1, 1, 2), (1, 2, 1)]
