from collections import defaultdict

import numpy as np

from corpusloom.llm import spans as S
from corpusloom.llm.common import table, words_of


def brute(rows, run=S.RUN, least=S.MIN_WORDS):
    found = defaultdict(list)
    cut = []
    for r, (d, t) in enumerate(rows):
        at = S.sentences(t) if t else [0]
        own = [t[a:b] for a, b in zip(at, at[1:])]
        cut.append(own)
        some = [(i, words_of(x)) for i, x in enumerate(own) if words_of(x)]
        for i in range(len(some)):
            for j in range(i + run, len(some) + 1):
                if sum(len(w) for _, w in some[i:j]) >= least:
                    found[tuple(tuple(w) for _, w in some[i:j])].append(((d is not None, d or 0, r, some[i][0]), some[j - 1][0] + 1))
                    break
    gone, firsts = defaultdict(set), defaultdict(set)
    for occ in found.values():
        first = min(occ)[0]
        for at, b in occ:
            if at != first:
                gone[at[2]] |= set(range(at[3], b))
                firsts[at[2]] |= {first[1]} if first[0] else set()  # ids that are null are not listed
    return sorted(((d, None if t is None else "".join(x for i, x in enumerate(cut[r]) if i not in gone[r]), len(cut[r]), len(gone[r]), sorted(firsts[r])) for r, (d, t) in enumerate(rows)), key=repr)


def corpus():
    r = np.random.default_rng(0)
    sent = lambda: " ".join(f"w{int(x)}" for x in r.integers(0, 300, int(r.integers(1, 9)))).capitalize() + str(r.choice([". ", "! ", ".\n", "? "]))
    shared = ["".join(sent() for _ in range(9)) for _ in range(4)]
    rows = []
    for i in range(120):
        t = "".join(sent() for _ in range(int(r.integers(0, 12))))
        if i % 3 == 0:
            t = t + shared[i % 4].upper() + "".join(sent() for _ in range(3))
        rows.append((i, t))
    rows += [(200, None), (201, ""), (202, "... !!! \n\n"), (203, shared[0]), (203, shared[0]), (None, rows[0][1]), (204, "One. Two. Three."), (205, "One. Two. Three."), (206, "a b c d e. " * 3000), (207, "語語。語二三。" * 20)]
    return rows


def run(spark, rows):
    df = table(spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, row int, cover int"), "t")
    return df, S.deduplicate(df)


def test_like_brute_force(spark):
    df, got = run(spark, corpus())
    rows = [(x.doc_id, x.text) for x in df.collect()]  # in the order of the scan
    have = sorted(((x.doc_id, x.text, x.n_sentences, x.n_removed, sorted(x.firsts)) for x in got.collect()), key=repr)
    want = brute(rows)
    assert have == want
    assert sum(x[3] > 0 for x in want) > 30


def test_empty(spark):
    assert run(spark, [])[1].count() == 0


def test_hot_spans_and_input_that_is_no_scan(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_LEAST", 5)  # most shared passages are broadcast, the others are joined by a shuffle
    rows = [(i, t) for i, t in corpus() if i is not None and i < 203]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    have = sorted(((x.doc_id, x.text, x.n_sentences, x.n_removed, sorted(x.firsts)) for x in S.deduplicate(df).collect()), key=repr)
    assert have == brute(rows)


def test_planted_passages_and_repeats_within_a_document(spark):
    r = np.random.default_rng(1)
    words = lambda n: [f"v{int(x)}" for x in r.integers(0, 5000, n)]
    prose = lambda: " ".join(" ".join(words(int(r.integers(8, 30)))) + "." for _ in range(12))
    rows, planted = [], set()
    for i in range(100):  # a passage of 51 to 120 words, cut out and put in at any word
        src, n = prose().split(" "), int(r.integers(51, 121))
        a = int(r.integers(0, len(src) - n))
        host = prose().split(" ")
        b = int(r.integers(0, len(host)))
        rows += [(2 * i, " ".join(src)), (2 * i + 1, " ".join(host[:b] + src[a : a + n] + host[b:]))]
        planted.add(2 * i + 1)
    for i in range(100):  # only itself repeats
        rows.append((200 + i, prose() + " " + (" ".join(words(15)) + ". ") * 5))
    df = table(spark.createDataFrame(rows, "doc_id long, text string"), "t")
    share = lambda got: (len(got & planted) / 100, 1 - len(got - planted) / 200)
    touched = lambda *a, **k: {x.doc_id for x in S.deduplicate(df, *a, **k).where("n_removed > 0").collect()}
    caught, left = share(touched(1, 15, across=True))
    assert caught >= 0.9 and left >= 0.95
    caught, left = share(touched(3, 12))
    assert caught < 0.9 and left < 0.95
