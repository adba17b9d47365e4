"""Licence digests do not depend on where lines are wrapped."""

import re
import textwrap

from plumbline.llm import licenses


def wrapped(text, width):
    """Paragraphs wrapped anew; lines that state a copyright stay lines."""
    out, block = [], []
    for line in [*text.splitlines(), ""]:
        states = re.match(r"\W*(copyright\W*(\(c\)|\[yyyy)|all rights reserved\.?$)", line, re.I)
        if line.strip() and not states:
            block.append(line.strip())
            continue
        out += textwrap.wrap(" ".join(block), width, break_long_words=False, break_on_hyphens=False)
        block = []
        out.append(line)
    return "\n".join(out)


def test_known_texts_at_several_widths(documents):
    texts = licenses.KNOWN + licenses.FULL_TEXTS
    wanted, rows = {}, []
    for name, text in texts:
        for width in (20, 38, 51, 60, 64, 68, 72, 76, 80, 100, 10_000):
            wanted[len(rows)] = name
            rows.append((len(rows), "Copyright (c) 2019, Jane Doe\nAll rights reserved.\n\n" + wrapped(text, width)))
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(documents(rows)).collect()}
    assert {i: got[i] for i in wanted if got[i] != wanted[i]} == {}


def test_usual_layouts(documents):
    isc = """Copyright 2020 Jane Doe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""" + licenses.ISC[licenses.ISC.index("\n\nTHE") :]
    mit = licenses.MIT.replace("COPYRIGHT HOLDERS BE", "\nCOPYRIGHT HOLDERS BE")
    lines = ["Copyright Jane Doe and others", "# Copyright: The Foo Authors", "(c) Foo Ltd.", "© Foo", "Copyright by Foo. All rights reserved."]
    docs = [(1, isc), (2, mit), *[(10 + i, f"MIT License\n{line}\n\n{licenses.MIT}") for i, line in enumerate(lines)]]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(documents(docs)).collect()}
    assert got == {1: "ISC"} | {i: "MIT" for i in (2, 10, 11, 12, 13, 14)}
