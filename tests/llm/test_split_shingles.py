"""Near duplicates whose shingles are split over runs with a single class each."""

import pytest

from plumbline.llm import jaccard


@pytest.mark.parametrize("seed", range(3))
def test_many_exact_copies_and_one_near_copy(documents, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "RUN_ROWS", 4)
    words = [f"t{seed}w{i}" for i in range(60)]
    near = [*words[:59], "other"]
    rows = [(i, " ".join(words)) for i in range(200)] + [(500, " ".join(near))]
    rows += [(600 + i, " ".join(f"u{i}w{j}" for j in range(40))) for i in range(5)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(documents(rows)).collect()}
    assert got == {i: 0 for i in [*range(200), 500]} | {600 + i: 600 + i for i in range(5)}


def test_lone_classes_of_split_runs_over_batches():
    import pyarrow as pa

    rows = [(1, 0, 7), (1, 1, 8), (2, 0, 3), (2, 0, 3), (2, 1, 4), (2, 1, 5), (3, 0, 9)]
    names = ["token", "salt", "class", "size", "pos", "split"]

    def batches(step):
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            whole = [pa.array([r[k] for r in part], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*whole, *[pa.array([1] * len(part), pa.int32())] * 2, pa.array([r[0] < 3 for r in part])], names
            )

    for step in (1, 2, 3, 7):
        got = sorted((r["token"], r["class"], r["center"], r["lone"]) for b in jaccard._runs(batches(step), lone=True) for r in b.to_pylist())
        assert got == [(1, 7, 7, True), (1, 8, 8, True), (2, 3, 3, True), (2, 4, 4, False), (2, 5, 4, False)]
