import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import pfair


@pytest.mark.parametrize("seed", range(6))
def test_less_than_one_block_from_the_fluid_schedule(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 9))
    blocks = {f"s{i}": int(r.integers(0, 400)) for i in range(n)}
    weights = {s: float(r.random() ** 3 + 0.001) for s in blocks}
    period = 64
    rows = pfair.segments(blocks, weights, period)
    slot_of = defaultdict(dict)
    for x in rows:
        for b in range(x["per"] * x["times"]):
            slot_of[x["src"]][x["first"] + b] = x["start"] + b // x["per"] * x["length"] + x["slots"][b % x["per"]]
    total = sum(blocks.values())
    assert sorted(s for own in slot_of.values() for s in own.values()) == list(range(total))  # dense, each slot once
    for s, own in slot_of.items():
        assert len(own) == blocks[s] and all(own[k] < own[k + 1] for k in range(len(own) - 1))
    # within one block of the shares in every segment, at every slot
    for start in sorted({x["start"] for x in rows}):
        own = [x for x in rows if x["start"] == start]
        share = pfair.shares({x["src"]: weights[x["src"]] for x in own}, period)
        got, length = Counter(), own[0]["length"]
        who = {slot: x["src"] for x in own for slot in x["slots"]}
        full = all(x["per"] == share[x["src"]] for x in own)
        for t in range(length):
            got[who[t]] += 1
            if full:
                for x in own:
                    assert abs(got[x["src"]] - (t + 1) * share[x["src"]] / period) < 1
    if blocks:
        assert sum(pfair.shares(weights, period).values()) == max(period, n) or n > period


def corpus():
    r = np.random.default_rng(9)
    rows = [(i, "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"src{int(r.integers(5))}"), f"t{i}", i) for i in range(3000)]
    return rows + [(7, "hot", "again", 1), (7, "hot", "again", 1), (None, "hot", "n", 1), (None, None, "n", 1)]


def test_every_row_has_a_place_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(pfair, "BUCKET_ROWS", 100)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, slot int")
    out = pfair.mix(df, block_rows=8).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter((a, b) for a, b, _, _ in rows)
    assert len({r.position for r in out}) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.slot].append(r)
    assert all(len({(r.source, r.block) for r in own}) == 1 and len(own) <= 8 for own in by.values())
    n = Counter(b for _, b, _, _ in rows)
    assert len(by) == sum(-(-c // 8) for c in n.values()) == max(by) + 1
    # while all sources last, each holds its share
    w = {s: math.sqrt(c) for s, c in n.items()}
    got, order = Counter(), [by[t][0].source for t in sorted(by)]
    blocks = {s: -(-c // 8) for s, c in n.items()}
    for t, s in enumerate(order):
        got[s] += 1
        if any(got[x] >= blocks[x] for x in blocks):
            break
        assert all(abs(got[x] - (t + 1) * w[x] / sum(w.values())) < 1.5 for x in w)  # shares are multiples of 1/1024


def test_interleave_keeps_rows_and_order(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, slot int")
    kept = pfair.interleave(df, weights={"hot": 0.5, "src1": 0.25, "src2": 0.25}, block_rows=4, part_rows=500)
    assert kept.columns == df.columns
    got = [tuple(r) for r in kept.collect()]
    assert Counter(got) == Counter(rows)
    first = Counter(r[1] for r in got[:400])
    assert abs(first["hot"] - 200) <= 8 and abs(first["src1"] - 100) <= 8
    assert pfair.mix(df.limit(0)).count() == 0


def test_many_sources_take_seconds():
    import time

    r = np.random.default_rng(1)
    blocks = {f"s{i}": int(x) for i, x in enumerate(r.integers(1, 1000, 1000))}
    began = time.time()
    rows = pfair.segments(blocks, {s: math.sqrt(n) for s, n in blocks.items()}, 16_384)
    assert time.time() - began < 30
    slots = np.concatenate([x["start"] + x["length"] * np.arange(x["times"])[:, None] + np.array(x["slots"], int)[None, :] for x in rows], axis=None)
    assert len(slots) == sum(blocks.values()) and len(np.unique(slots)) == len(slots) == slots.max() + 1


def test_a_large_plan_is_a_table(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), "doc_id long, source string, text string, slot int")
    want = sorted(map(tuple, pfair.mix(df, block_rows=8).collect()), key=repr)
    monkeypatch.setattr(pfair, "PLAN_NUMBERS", 300)
    assert sorted(map(tuple, pfair.mix(df, block_rows=8).collect()), key=repr) == want
