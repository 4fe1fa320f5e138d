import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import topk


def brute(rows, ask, k=5):
    ok = {}
    full = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        full.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    for i, v in full:
        if ask(i):
            ok[i] = min(ok.get(i, v), v)
    out = []
    for q, v in ok.items():
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in full if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


def test_like_brute_force(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in r.normal(size=8) + 2 * (i % 3)]) for i in range(700)]
    rows += [(1000 + i, [1.0] * 8) for i in range(300)]  # many copies of one vector
    rows += [(2000, None), (2050, [None] * 8), (2100, [float("nan")] * 8), (2150, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (3000, [1.0] * 3), (3050, [2.0] * 3), (3100, [5.0]), (3150, []), (50, [9.0] * 8), (4000, [3e6] * 8), (4050, [-3e6] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    want = brute(rows, lambda i: i % 50 == 0)
    ask = df.where("vec_id % 50 = 0")
    get = lambda **kw: sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_k(df, ask, **kw).collect())
    assert get() == want
    monkeypatch.setattr(topk, "SAMPLE", 20)
    assert get(chunk=7, block=16) == want


def test_pruning_skips_blocks():
    r = np.random.default_rng(1)
    blocks = [(np.arange(64) + 64 * b, r.integers(-5, 5, (64, 4)) + 100 * (b == 3)) for b in range(20)]
    seen = []
    real = topk.dot
    topk.dot = lambda a, b: (seen.append(len(b)), real(a, b))[1]
    try:
        best = topk.search(blocks, np.array([-1]), np.full((1, 4), 10), np.full(1, np.iinfo(np.int64).min), 5)
    finally:
        topk.dot = real
    assert set(best.id[0]) <= set(range(192, 256)) and len(seen) == 3  # two for the bounds, one block


def test_empty(spark):
    e = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(e, e).count() == 0


def test_large_components_are_exact_or_an_error(spark):
    r = np.random.default_rng(6)
    vs = r.integers(-3, 4, (120, 6)).astype(float)
    vs[r.integers(0, 120, 40), r.integers(0, 6, 40)] = 1e9 + 0.25
    vs[::7] = np.round(vs[::7] % 5)
    small = [i for i in range(120) if np.abs(vs[i]).max() < 100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vs)], "vec_id long, embedding array<double>")
    asked = [i for i in small if i % 3 == 0]
    got = defaultdict(list)
    for x in topk.top_k(df, df.where(F.col("vec_id").isin(asked)), block=8, chunk=5).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    ints = [[int(np.floor(256 * c)) for c in v] for v in vs]
    for i in asked:
        scores = sorted(((-sum(a * b for a, b in zip(ints[i], ints[j])), j) for j in range(120) if j != i))[:5]
        assert got[i] == [(j, -s) for s, j in scores]
    with pytest.raises(Exception, match="fits no long"):
        topk.top_k(df, df).collect()
