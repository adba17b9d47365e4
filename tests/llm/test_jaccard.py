import random
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import jaccard
from plumbline.llm.graph import components


def brute(rows):
    sets = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        if len(words) >= 5:
            sets[doc] = frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        else:
            sets[doc] = frozenset([tuple(words)] if words else [])
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = [d for d in sets if sets[d]]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def planted(seed):
    """Near copies around the threshold, chains of them, shared passages, short and empty texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(60)]
    rows, doc = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one  TWO"), (5, "one two three")], 6
    for _ in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([6, 12, 40, 150]))]
        if rng.random() < 0.4:
            text += passage
        for _ in range(rng.randint(1, 6)):
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((doc, " ".join(text)))
            doc += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_like_all_pairs(documents, seed):
    rows = planted(seed)
    assert result(jaccard.near_duplicates(documents(rows))) == brute(rows)


def test_split_runs(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "RUN_ROWS", 1)
    rows = planted(3)
    assert result(jaccard.near_duplicates(documents(rows))) == brute(rows)


def test_repeated_rows_empty_table_and_representatives(documents):
    rows = [(7, "a b c d e f g h"), (7, "a b c d e f g h"), (9, "A B c d e f g h"), (None, "p q r s t u"), (8, None)]
    docs = documents(rows)
    assert result(jaccard.near_duplicates(docs)) == {7: (4, 7), 9: (4, 7), None: (2, None), 8: (0, 8)}
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["7", "8", "None"]
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_tree_like_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sets = [np.unique(rng.integers(0, 30, rng.integers(1, 25)).astype(np.uint64)) for _ in range(20)]
        tree = jaccard.Tree(sets)
        probe = np.unique(rng.integers(0, 30, 20).astype(np.uint64))
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= 80 * len(np.union1d(s, probe))]
        assert sorted(tree.probe(probe)) == want
    assert jaccard.Tree([]).probe(np.zeros(0, np.uint64)) == []


def test_runs_over_batches():
    """Runs that go over several batches give what one batch gives."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = sorted((int(t), int(s), int(c)) for t, s, c in zip(rng.integers(0, 40, 400), rng.integers(0, 2, 400), rng.integers(0, 9, 400)))
    names = ["token", "salt", "class", "size", "pos", "split"]

    def batches(step):
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in part], pa.int64()) for k in range(3)] + [pa.array([r[2] for r in part], pa.int32())] * 2 + [pa.array([True] * len(part))], names
            )

    groups = defaultdict(set)
    for token, salt, name in rows:
        groups[token, salt].add(name)
    want = sorted((t, c, min(g)) for (t, s), g in groups.items() if len(g) > 1 for c in g)
    for step in (1, 2, 3, 7, 400):
        got = [r for b in jaccard._runs(batches(step)) for r in b.to_pylist()]
        assert sorted((r["token"], r["class"], r["center"]) for r in got) == want
        assert all(r["size"] == r["class"] and r["center_size"] == r["center"] for r in got)


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    label = {}
    for a, b in links:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in label.items() if n in linked}
