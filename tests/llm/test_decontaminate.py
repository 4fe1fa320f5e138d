import hashlib

import numpy as np

from corpusloom.llm import decontaminate as D
from corpusloom.llm.common import words_of

DOCS = "doc_id long, text string, item_id string, spans int"


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words_of(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[a : a + n]), set()).add(i)
    sizes = {len(k) for k in wins}
    out = []
    for d, t in docs:
        w = words_of(t)
        hit, who = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in wins:
                    hit |= set(range(a, a + n))
                    who |= {str(i) for i in wins[k] if i is not None}
        out.append((d, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def corpus(seed=1):
    r = np.random.default_rng(seed)
    word = lambda: "".join(r.choice(list("abé"), 1 + r.integers(2)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(int(n))) for i, n in enumerate([30, 12, 10, 9, 3, 25])] + [(None, text(11)), (7, ""), (8, None), (2, text(14)), (9, "zz " * 12)]
    docs = [(0, None), (1, ""), (2, "... !?"), (3, text(5)), (3, text(5)), (None, text(40))]
    for d in range(4, 60):
        t = text(int(r.integers(0, 60)))
        if d % 2:
            w = (items[d % 7][1] or "").split()
            a = int(r.integers(0, max(1, len(w) - 4)))
            t += " " + ",".join(w[a : a + int(r.integers(4, 20))]).upper() + ". " + text(8)
        docs.append((d, t))
    return docs + [(99, "ZZ-" * 40), (100, text(4) + " x" * 50_000 + " " + items[0][1]), (101, items[5][1]), (101, items[5][1])], items


def run(spark, docs, items, **kw):
    a = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    return sorted((tuple(r) for r in D.report(a, b, **kw).collect()), key=repr)


def test_like_brute_force_and_in_blocks(spark):
    docs, items = corpus()
    want = brute(docs, items)
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, block_bytes=150) == want


def test_empty_tables_and_clean(spark):
    docs, items = corpus(2)
    assert run(spark, [], items) == []
    assert all(not r[5] for r in run(spark, docs, []))
    a = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    kept = D.clean(a, b)
    assert kept.columns == a.columns
    assert sorted((r[0] for r in kept.collect()), key=repr) == sorted((r[0] for r in brute(docs, items) if not r[5]), key=repr)


def test_repetitions_cost_no_more_than_other_texts():
    import time

    words = "la " * 20_000
    docs = [(1, words), (2, "a b " * 10_000), (3, "x " + words)]
    items = [(str(i), words) for i in range(3)] + [("4", "b a " * 10_000), ("5", "c " + "la " * 9), ("6", "la la")]
    began = time.time()
    index = D.Index(items, 10, 5)
    got = [x for d, t in docs for x in index.scan([t], D.WordHasher())]
    assert time.time() - began < 5
    want = {d: (n, hit, who) for d, n, hit, who, *_ in brute(docs, items)}
    assert [(n, sum(b - a for a, b in spans), len(who)) for n, spans, who in got] == [want[d] for d, _ in docs]
