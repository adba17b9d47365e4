"""Language identification, n-gram scores, top-k search and the pipeline."""

import math
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
import oracle
from plumbline.llm import jaccard, langid, lm, pii, queries, topk

SF_DIR = "/root/testdata/sf0.001"
QUICK = langid.Settings(per_language=60, epochs=6)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_like_their_sql(spark, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    assert oracle.differences(df, oracle.connect(SF_DIR), queries.SQL[name]) == []


def test_all_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry_points.queries())


def test_gradients_like_differences():
    rng = np.random.default_rng(0)
    net = langid.new_network(["a", "b", "c"], langid.Settings(window=12, embedding=3, filters=4))
    for p in net.parameters():
        p[...] = rng.normal(0, 0.5, p.shape) * (net.mask if p is net.filters else 1)
    windows, labels = rng.integers(0, 5, (6, 12)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    weights = np.ones(3, np.float32)

    def loss():
        return -np.log(net.probabilities(windows)[np.arange(6), labels]).mean()

    for p, g in zip(net.parameters(), langid.gradients(net, windows, labels, weights)):
        for at in list(zip(*np.nonzero(g)))[:5]:
            kept, step = p[at], 1e-2
            p[at] = kept + step
            up = loss()
            p[at] = kept - step
            down = loss()
            p[at] = kept
            assert abs((up - down) / (2 * step) - g[at]) < 0.02 + 0.05 * abs(g[at])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.held_out(docs["doc_id"])
    found = langid.identify(docs, langid.fit(docs.where(~out)))
    rows = found.join(docs.where(out).select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 250
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_cases(documents):
    rows = [(i, "der die das und ist nicht " * 9, "de") for i in range(8)] + [(10 + i, "the of and that with this " * 9, "en") for i in range(8)]
    docs = documents(rows + [(30, "no label", None), (31, None, "en"), (32, " 12 !?", "de")])
    net = langid.fit(docs, QUICK)
    assert net.languages == ["de", "en"]
    odd = documents([(1, None), (2, ""), (3, "123 !"), (4, "das ist nicht " * 9000), (4, "x"), (None, "the that with")])
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(odd, net).collect()]
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "de"), (None, "en")} <= set(got) and len(got) == 6
    assert langid.accepted(odd, net, 0.4).count() == 3
    assert langid.identify(odd.limit(0), net).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.fit(odd, QUICK)).collect()} == {"und"}


def test_scores_like_counting(documents, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 40)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 60)
    rows = [(1, "a b a b c"), (2, "A  b\td"), (3, "e"), (4, None), (5, ""), (6, "a b a b c"), (6, "a b a b c"), (None, "b a " * 40)]
    got = sorted(((str(r["doc_id"]), r["n_words"], r["n_backed_off"], r["score"]) for r in lm.scores(documents(rows)).collect()), key=str)
    words = [(t or "").lower().split() for _, t in rows]
    ones, twos = Counter(w for d in words for w in d), Counter(p for d in words for p in zip(d, d[1:]))
    want = []
    for (doc, _), d in zip(rows, words):
        c1, c2, rest = ones - Counter(d), twos - Counter(zip(d, d[1:])), sum(ones.values()) - len(d)
        total, fell = 0.0, 0
        for i, w in enumerate(d):
            if i and c2[d[i - 1], w]:
                total += math.log(c2[d[i - 1], w] / c1[d[i - 1]])
            else:
                total += math.log(max(c1[w], lm.ALPHA) / rest) + (math.log(lm.ALPHA) if i else 0)
                fell += i > 0
        want.append((str(doc), len(d), fell, total / len(d) if d else None))
    for g, w in zip(got, sorted(want, key=str)):
        assert g[:3] == w[:3] and (g[3] == w[3] if w[3] is None else abs(g[3] - w[3]) < 1e-9)
    assert lm.scores(documents(rows).limit(0)).count() == 0
    assert lm.scores(documents([(1, "alone")])).first()["score"] is None


def test_packed_numbers():
    for values in ([0], [5, 0, 255], [1 << 40, 3], [(1 << 64) - 1, 0]):
        assert lm._unpacked(lm._packed(np.array(values, np.uint64))).tolist() == values


def test_top_k_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_ROWS", 40)
    monkeypatch.setattr(topk, "STEP", 16)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.2, (300, 24)) * rng.uniform(0.1, 3, (300, 1))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(1000 + i, [0.5] * 24) for i in range(150)]
    rows += [(2000, None), (2001, [None] * 24), (2100, [float("nan")] * 24), (2200, [float("inf")] * 24), (None, [1.0] * 24)]
    rows += [(3000, [1.0, 2.0]), (3001, [-1.0, 2.0]), (4000, []), (4001, []), (5000, [1e30, 1.0, 1e30]), (5001, [1e30, 1.0, 1e30]), (0, rows[0][1])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, level int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(frame, frame.where("vec_id % 100 = 0")).collect()}
    usable = {i: [math.floor(1024 * c) for c in v] for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    want = {}
    for q in (i for i in usable if i % 100 == 0):
        scored = [(-min((1 << 63) - 1, sum(a * b for a, b in zip(usable[q], v))), i) for i, v in usable.items() if i != q and len(v) == len(usable[q])]
        for rank, (s, i) in enumerate(sorted(scored)[:10], 1):
            want[q, rank] = (i, -s)
    assert got == want
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_pipeline(spark):
    """Each stage against what its operator says of the stage's own input."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", None, None, None), (10**6 + 2, "mail the editor at once: bob (at) example dot com and that is all of it", "en", "s", 1)], docs.schema)
    rows = docs.unionByName(extra)
    kept = corpus_pipeline.identified(spark, rows, SF_DIR)
    ids = {r["doc_id"] for r in kept.collect()}
    assert {10**6, 10**6 + 1}.isdisjoint(ids) and 10**6 + 2 in ids
    assert len(ids) >= 0.99 * docs.count()
    one = corpus_pipeline.deduplicated(spark, docs, SF_DIR)
    named = jaccard.near_duplicates(docs).collect()
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({r["component_id"] for r in named})
    clean = corpus_pipeline.decontaminated(spark, docs, SF_DIR)
    assert clean.columns == docs.columns and 0 < docs.count() - clean.count() < 20
    hidden = corpus_pipeline.redacted(spark, rows, SF_DIR)
    assert hidden.columns == docs.columns
    for r in hidden.where("text IS NOT NULL").collect():
        assert r["n_chars"] == len(r["text"]) and not pii.find(r["text"])
    assert corpus_pipeline.encoded(spark, docs, SF_DIR).columns == ["doc_id", "ids", "n_tokens"]
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
