import pytest

from corpusloom.llm import licences as L

LINES = {
    "mit": "Released under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "bsd": "Use of this source code is governed by a BSD-style license.",
    "proprietary": "ALL RIGHTS   RESERVED!",
}


@pytest.fixture(scope="module")
def model(spark):
    return L.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def python_score(model, text):
    """The same model, word by word."""
    import math
    import re

    w = re.findall("[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower())
    g = set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}
    s = [b + sum(model.weights[x][c] for x in g if x in model.weights) for c, b in enumerate(model.intercepts)]
    top = max(s)
    return model.classes[s.index(top)], 1 / sum(math.exp(x - top) for x in s)


def rows():
    out = [(i, f"Some words here.\n{line}\r\nand the rest") for i, line in enumerate(LINES.values())]
    out += [(20, None), (21, ""), (22, "\n \n"), (23, "He lost his driving license and had to walk home."), (24, "the text of the day " * 20_000), (25, LINES["mit"] + "\n" + LINES["gpl"]), (26, LINES["mit"]), (26, LINES["mit"]), (None, LINES["gpl"].lower())]
    return out


def test_families_and_odd_rows(spark, model):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows()], "doc_id long, text string, found string, family int")
    out = L.scan(df, model).collect()
    assert len(out) == len(rows())
    got = {}
    for r in out:
        got.setdefault(r.doc_id, set()).update(f.family for f in r.found if f.confirmed)
    assert [got[i] for i in range(len(LINES))] == [{f} for f in LINES]
    assert got[25] == {"mit", "gpl"} and got[26] == {"mit"} and got[None] == {"gpl"}
    assert all(not got[i] for i in (20, 21, 22, 23, 24))
    assert {r.doc_id: r.n_paragraphs for r in out}[22] == 0 and {r.doc_id: r.n_paragraphs for r in out}[0] == 3


def test_prefilter_and_scores_equal_a_plain_version(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    text = {r.doc_id: r.text for r in docs.collect()} | {100_000 + i: t for i, (_, t) in enumerate(rows()) if t}
    df = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    for r in L.scan(df, model).collect():
        ps = [p for p in text[r.doc_id].replace("\r", "\n").split("\n") if p.strip(" ")]
        assert r.n_paragraphs == len(ps)
        want = [(i + 1, *python_score(model, p)) for i, p in enumerate(ps)]
        want = [(i, f, p) for i, f, p in want if f != L.NONE]
        assert [f.paragraph for f in r.found] == [i for i, _, _ in want], r
        for f, (_, name, p) in zip(r.found, want):
            assert f.family == (name if p >= model.threshold else L.UNKNOWN) and abs(f.probability - p) < 1e-9


def test_hard_wrapped_notices(spark, model):
    import textwrap

    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy and modify it."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    fold = lambda t, n, mark="": "\n".join(mark + x for x in textwrap.wrap(t, n))
    texts = {(f, n): "Some words of the day.\n" + fold(t, n, " * ") + "\nand the rest" for f, t in (("mit", mit), ("bsd", bsd), ("gpl", gpl)) for n in (30, 50, 70)}
    rows = [(i, t) for i, t in enumerate(texts.values())] + [(20, fold("He lost his driving license and had to walk home. " * 9, 40)), (21, None)]
    got = {r.doc_id: set(r.joined) | {f.family for f in r.found if f.confirmed} for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[i] for i in range(len(texts))] == [{f} for f, _ in texts]
    assert got[20] == got[21] == set()


def test_empty(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    assert L.licences(e).count() == 0
