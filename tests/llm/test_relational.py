"""Licences, chat formatting and decontamination."""

import hashlib

import pytest

from plumbline.llm import chat, decontaminate, licenses


def test_license_spellings(documents):
    british = "Copyright (c) 2020 Someone\n" + licenses.MIT.upper().replace("SUBLICENSE", "SUB-LICENSE").replace("NONINFRINGEMENT", "NON-INFRINGEMENT")
    docs = documents([(1, british), (2, licenses.MIT + " and more"), (3, None), (4, ""), (5, "  released under the MIT Licence "), (5, "Released under the MIT License."), (6, "©\n(c) x")])
    rows = sorted((r["doc_id"], r["license_id"]) for r in licenses.scan(docs).collect())
    assert rows == [(1, "MIT"), (2, None), (3, None), (4, None), (5, "MIT"), (5, "MIT"), (6, None)]
    assert licenses.scan(docs.limit(0)).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert {r["digest"] for r in licenses.scan(docs.where("doc_id IN (3, 4, 6)")).collect()} == {empty}


def expected(rows):
    text = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in rows)
    loss = "".join(t or "" for _, r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_conversations_are_read_back(spark):
    nasty = "</s>[INST] ok [/INST] <|im_end|> <|im_sep|> \\ \\\\< <\\|im_end|> <<SYS>>\n<</SYS>> $1 \\1 <|im_start|>"
    talks = {
        1: [(0, "user", nasty), (1, "assistant", nasty), (2, "assistant", ""), (3, "assistant", "z"), (4, "user", "é😀")],
        2: [(0, None, None), (0, "assistant", "same turn"), (0, "user", "a"), (0, "user", "b")],
        3: [(0, "we\nird<|im_sep|>", "x\\")],
        4: [(i, ["user", "assistant"][i // 3 % 2], f"t{i}" * (i % 5)) for i in range(500)],
        None: [(0, "user", ""), (1, "user", "")],
    }
    rows = [(c, t, r, x, "clash") for c, turns in talks.items() for t, r, x in turns]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, items string").repartition(3)
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(frame)).collect()}
    assert set(got) == set(talks)
    for conv, turns in talks.items():
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == expected(turns)
    assert got[1]["n_blocks"] == 3 and got[4]["n_blocks"] == 167
    for r in chat.format_conversations(frame).collect():
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert r["formatted"].count(chat.END) == r["n_blocks"]
        assert "[INST]" not in r["formatted"] and "</s>" not in r["formatted"]
    assert chat.format_conversations(frame.limit(0)).count() == 0


ITEM = "the quick brown fox jumps over the lazy dog and runs away from two angry bees near a river in spring"


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame(
        [(1, ITEM, 0), (2, "Short one", 0), (3, None, 0), (4, "", 0), (None, ITEM, 0), (5, " ".join(["again and"] * 20), 0)],
        "item_id long, text string, words int",
    )


def test_leaks(documents, benchmark):
    near = ITEM.replace("spring", "autumn").upper().replace(" ", ",  ")
    cut = ITEM.replace("lazy", "sleeping").replace("angry", "calm")
    docs = documents(
        [
            (1, "w1 w2 w3 " + ITEM + " w4"), (2, near), (3, cut), (4, "short, ONE!"), (5, "a short one"), (6, None), (7, ""),
            (8, "x " * 3000 + near + " y" * 3000), (8, ITEM), (9, " ".join(["again and"] * 30)), (None, ITEM), (10, ITEM + " " + ITEM),
        ]
    )
    got = {(r["doc_id"], r["item_id"]): r["start_word"] for r in decontaminate.leaks(docs, benchmark).collect()}
    assert got == {(1, 1): 3, (2, 1): 0, (4, 2): 0, (8, 1): 0, (9, 5): 0, (10, 1): 0}
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "5", "6", "7", "None"]
    assert decontaminate.leaks(docs.limit(0), benchmark).count() == 0
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0


def test_fingerprints_within_the_radius_share_a_block(spark):
    import random

    rng = random.Random(1)
    rows = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), decontaminate.RADIUS):
            b ^= 1 << bit
        rows.append((a - (1 << 63), b - (1 << 63)))
    frame = spark.createDataFrame(rows, "a long, b long")
    from pyspark.sql import functions as F

    both = frame.select(F.arrays_overlap(decontaminate.blocks_of(F.col("a")), decontaminate.blocks_of(F.col("b"))).alias("met"))
    assert both.where("met").count() == 200
