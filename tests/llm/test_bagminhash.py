from collections import Counter, defaultdict

import numpy as np

from corpusloom.llm import bagminhash as B
from corpusloom.llm.common import words_of


def bag(text):
    w = words_of(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows, threshold=0.8):
    bags = [bag(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and similarity(bags[i], bags[j]) >= threshold:
                up[max(top(i), top(j))] = min(top(i), top(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(i)
    out = []
    for own in groups.values():
        name = min((rows[i][0] for i in own if rows[i][0] is not None), default=None)
        out += [(rows[i][0], name, len(own), sum(1 for j in own if bags[j] == bags[i])) for i in own]
    return sorted(out, key=repr)


def corpus(seed=0, groups=12):
    r = np.random.default_rng(seed)
    vocab = ["w%d" % i for i in range(500)]
    rows, n = [], 0
    for _ in range(groups):
        base = list(r.choice(vocab, int(r.integers(30, 200))))
        for _ in range(int(r.integers(1, 12))):
            w = list(base)
            for _ in range(int(r.integers(0, max(1, len(w) // 35)))):
                w[int(r.integers(len(w)))] = str(r.choice(vocab))
            rows.append((n, " ".join(w)))
            n += 1
    line = "the same line again and again "
    rows += [(n, line * 40 + "end"), (n + 1, line * 41 + "end"), (n + 2, line * 90 + "end"), (n + 3, "two words"), (n + 4, "Two  WORDS!"), (n + 5, "words two"), (n + 6, ""), (n + 7, "..."), (None, None), (None, "two words"), (3, rows[3][1]), (3, rows[3][1]), (n + 8, "long " * 4000)]
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 7, "k") for d, t in rows], "doc_id long, text string, n int, node string")
    return df, B.near_duplicates(df)


def test_like_brute_force(spark):
    rows = corpus()
    _, got = run(spark, rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_near_copies_without_an_id(spark):
    r = np.random.default_rng(7)
    word = lambda n: [f"u{i}" for i in r.integers(0, 10**6, n)]
    base, other, chain = word(100), word(100), word(110)
    rows = [(1, " ".join(base)), (None, " ".join([*base[:-1], "x"])), (None, " ".join([*base[:-1], "x"]))]  # beside a named one
    rows += [(None, " ".join(other)), (None, " ".join(["y", *other[1:]]))]  # only rows without an id
    rows += [(2, " ".join(chain[:90])), (None, " ".join(chain[9:99])), (3, " ".join(chain[18:108]))]  # the bridge has none
    rows += [(4, " ".join(word(50))), (None, " ".join(word(50)))]
    want = brute(rows)
    assert {(1, 1, 3, 1), (2, 2, 3, 1), (3, 2, 3, 1)} <= set(want)
    assert sorted((tuple(x) for x in run(spark, rows)[1].collect()), key=repr) == want


def test_bridges_are_found_when_no_centre_reaches(spark):
    r = np.random.default_rng(4)  # a chain: neighbours are alike, ends are not
    words = [f"v{i}" for i in r.integers(0, 10**6, 400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 160])) for i in range(40)]
    # and a group whose members are mostly a little too far from one another
    base = [f"b{i}" for i in range(120)]
    for i in range(60):
        w = list(base)
        for _ in range(int(r.integers(1, 6))):
            w[int(r.integers(len(w)))] = f"x{int(r.integers(40))}"
        rows.append((100 + i, " ".join(w)))
    want = brute(rows)
    assert sorted((tuple(x) for x in run(spark, rows)[1].collect()), key=repr) == want


def test_deduplicate_keeps_one_of_each_class(spark):
    rows = corpus(1, 6)
    df, _ = run(spark, rows)
    kept = B.deduplicate(df)
    assert kept.columns == df.columns
    got = Counter(r.doc_id for r in kept.collect())
    want = Counter({name: 1 for d, name, _, _ in brute(rows) if name is not None})
    want[None] = 2  # rows without an id stay
    assert got == want


def test_deduplicate_with_several_texts_under_one_id(spark):
    r = np.random.default_rng(8)
    word = lambda n: [f"u{i}" for i in r.integers(0, 10**6, n)]
    a, b, c, d = (word(100) for _ in range(4))
    near = lambda w: " ".join([*w[:-1], "x"])
    a, b, c, d, alone = (a, near(a)), (b, near(b)), (c, near(c)), (d, near(d)), " ".join(word(60))
    rows = [(1, " ".join(a[0])), (5, a[1]), (5, alone)]  # 5 loses one text and keeps another
    rows += [(2, " ".join(b[0])), (2, b[1]), (2, b[1]), (3, b[1])]  # near copies under one id
    rows += [(6, " ".join(c[0])), (7, c[1]), (6, " ".join(d[0])), (8, d[1])]  # 6 names two classes
    df, _ = run(spark, rows)
    got = sorted((x.doc_id, x.text) for x in B.deduplicate(df).collect())
    assert [x for x in got if x[0] != 2] == sorted([rows[0], rows[2], rows[7], rows[9]])
    assert len(got) == 5 and [t in (" ".join(b[0]), b[1]) for i, t in got if i == 2] == [True]


def test_empty(spark):
    df, got = run(spark, [])
    assert got.count() == 0
    assert B.deduplicate(df).count() == 0


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(2)
    a = {int(k): int(w) for k, w in zip(r.integers(1, 1 << 60, 50), r.choice([1, 1, 2, 3, 6, 40], 50), strict=True)}
    b = a | {k: int(r.integers(1, 9)) for k in list(a)[:20]}
    want = sum(min(a[k], b[k]) for k in a) / sum(max(a[k], b[k]) for k in a)
    same = []
    for _ in range(60):
        x = int(r.integers(1, 1 << 62))
        d, s, w = zip(*sorted([(0, k ^ x, v) for k, v in a.items()] + [(1, k ^ x, v) for k, v in b.items()]), strict=True)
        sig = B.Sketcher.signatures(np.array(d), np.array(s, np.uint64), np.array(w), 2)
        same.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(same) - want) < 4 * (want * (1 - want) / 128 / 60) ** 0.5


def test_large_buckets_give_the_same_classes(spark, monkeypatch):
    monkeypatch.setattr(B, "HOT_LEAST", 3)  # so that buckets of a small corpus are large ones
    r = np.random.default_rng(9)
    base = [f"b{i}" for i in range(120)]
    rows = corpus(5, 6)
    for i in range(50):  # mostly a little too far from one another: several components in a bucket
        w = list(base)
        for _ in range(int(r.integers(1, 6))):
            w[int(r.integers(len(w)))] = f"x{int(r.integers(40))}"
        rows.append((1000 + i, " ".join(w)))
    _, got = run(spark, rows)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(rows)


def test_tables_are_packed(spark):
    key, off = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    had, was = spark.conf.get(key), spark.conf.get(off)
    rows = [(i, "w%d of some words that go on %d" % (i // 2, i // 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    try:
        spark.conf.set(key, "60")
        spark.conf.set(off, "false")
        own = B.Grouping(df)
        files = [len(own.nodes.inputFiles()), len(own.buckets.inputFiles())]
        assert own.nodes.count() == 200 and max(files) <= 24  # four for each of four cores are fewer
        own.close()
    finally:
        spark.conf.set(key, had)
        spark.conf.set(off, was)
