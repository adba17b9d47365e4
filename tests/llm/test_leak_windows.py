"""Leaks against the similarity of every window of a document."""

import random
from collections import Counter

from plumbline.llm import decontaminate


def grams(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def best_of_all(doc, item):
    """(shared, united) of the most similar item-sized window."""
    theirs, best = Counter(grams(item)), (0, 1)
    for start in range(max(1, len(doc) - len(item) + 1)):
        own = Counter(grams(doc[start : start + len(item)]))
        shared = (own & theirs).total()
        united = own.total() + theirs.total() - shared
        if shared * best[1] > best[0] * united:
            best = shared, united
    return best


def test_the_best_window_lies_between_alignments(spark, documents):
    item = [f"w{i}" for i in range(58)]
    short = ["x", *item[1:29], "new", "words", *item[29:57], "y"]
    long_item = [f"v{i}" for i in range(254)]
    long = ["x"] * 10 + long_item[10:127] + [f"n{i}" for i in range(20)] + long_item[127:244] + ["y"] * 10
    around = [f"a{i}" for i in range(30)]
    docs = documents([(1, " ".join(around + short + around)), (2, " ".join(around + long + around))])
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(long_item))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["shared"], r["united"]) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert got[1, 1] == (31, 48, 60)
    assert (2, 2) not in got or got[2, 2][1:] == best_of_all(around + long + around, long_item)


def test_like_all_windows(spark, documents):
    rng = random.Random(8)
    items = {i: [f"w{rng.randrange(40 if i % 3 else 6)}" for _ in range(rng.choice([5, 6, 20, 58, 58]))] for i in range(12)}
    rows = {}
    for doc in range(150):
        passage = list(items[rng.randrange(12)])
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            at = rng.randrange(len(passage) + 1)
            kind = rng.random()
            if kind < 0.4:
                passage[at:at] = [f"n{rng.randrange(9)}" for _ in range(rng.randint(1, 3))]
            elif kind < 0.7:
                del passage[at : at + rng.randint(1, 2)]
            else:
                passage[at : at + 1] = ["other"]
        edge = rng.choice([0, 2, 30])
        rows[doc] = [f"e{rng.randrange(50)}" for _ in range(edge)] + passage + [f"e{rng.randrange(50)}" for _ in range(edge)]
    want = {}
    for doc, words in rows.items():
        for item, theirs in items.items():
            if len(words) >= 5:
                shared, united = best_of_all(words, theirs)
                if 5 * shared >= 4 * united:
                    want[doc, item] = shared, united
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = decontaminate.leaks(documents([(d, " ".join(w)) for d, w in rows.items()]), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]): (r["shared"], r["united"]) for r in found} == want
