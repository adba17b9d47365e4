"""Queries meet a group in blocks of bounded size."""

import numpy as np

from plumbline.llm import topk


def test_no_task_gets_all_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_ROWS", 100)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 10, raising=False)
    search = topk._search

    def bounded(rotation, k):
        run = search(rotation, k)

        def checked(candidates, queries):
            if len(queries) > 40:
                raise ValueError(f"{len(queries)} queries in one task")
            return run(candidates, queries)

        return checked

    monkeypatch.setattr(topk, "_search", bounded)
    x = np.floor(np.random.default_rng(5).normal(0, 200, (400, 8)))
    frame = spark.createDataFrame([(i, [float(c) / 1024 for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(frame, frame.where("vec_id % 4 = 0"), k=3).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for q in range(0, 400, 4):
        scored = sorted((-int(x[q] @ x[i]), i) for i in range(400) if i != q)[:3]
        assert got[q] == {rank: (i, -s) for rank, (s, i) in enumerate(scored, 1)}
