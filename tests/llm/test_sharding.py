import hashlib
from collections import defaultdict

import pytest

from plumbline.llm import sharding


def brute(rows, limit):
    """Split one bucket after another on the next bit."""
    sized = []
    for doc, text in rows:
        bits = bin(int(hashlib.md5(("" if doc is None else str(doc)).encode()).hexdigest()[:15], 16))[2:].zfill(60)
        sized.append((doc, bits, len((text or "").encode())))
    out, todo = defaultdict(list), [("", sized)]
    while todo:
        prefix, bucket = todo.pop()
        total = sum(b for _, _, b in bucket)
        if total <= limit or len(prefix) == 60:
            for doc, _, _ in bucket:
                out[doc].append((prefix, len(prefix), total, total <= limit))
            continue
        for bit in "01":
            part = [x for x in bucket if x[1].startswith(prefix + bit)]
            if part:
                todo.append((prefix + bit, part))
    return out


@pytest.mark.parametrize("limit", [1, 90, 700, 10**6])
def test_like_splitting_one_by_one(documents, limit):
    rows = [(i, "ä" * (i * 7 % 90)) for i in range(60)] + [(None, "x"), (61, None), (62, ""), (63, "y" * 800), (5, "twice" * 30)]
    got = defaultdict(list)
    for r in sharding.shards(documents(rows), limit).collect():
        got[r["doc_id"]].append((r["shard"], r["depth"], r["shard_bytes"], r["fits"]))
    assert got == brute(rows, limit)


def test_directory_covers_every_slot(documents):
    cells = sharding.directory(documents([(i, "x" * 50) for i in range(200)]), 600)
    slots = sorted((r["first_slot"], r["last_slot"]) for r in sharding.slots(cells).collect())
    assert slots[0][0] == 0 and all(a[1] + 1 == b[0] for a, b in zip(slots, slots[1:]))
    assert slots[-1][1] + 1 == 2 ** max(r["global_depth"] for r in sharding.slots(cells).collect())


def test_files_and_empty_table(spark, documents, tmp_path):
    docs = documents([(i, "x" * 50) for i in range(40)])
    sharding.write_shards(docs, 400, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(r["doc_id"] for r in back.select("doc.doc_id").collect()) == list(range(40))
    assert back.selectExpr("shard", "octet_length(doc.text) AS n").groupBy("shard").sum("n").agg({"sum(n)": "max"}).first()[0] <= 400
    assert sharding.shards(docs.limit(0), 400).count() == 0
    with pytest.raises(ValueError):
        sharding.shards(docs, 0)
