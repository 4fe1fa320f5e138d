import hashlib
from collections import Counter

import numpy as np

import corpus_pipeline
from corpusloom.llm import shards

from . import test_bagminhash, test_decontaminate


def test_like_brute_force(spark, tmp_path):
    rows = test_bagminhash.corpus(3, 8)
    items = [(1, " ".join(rows[0][1].split()[5:20])), (2, "never seen words in here at all my friend yes")]
    rows = [r for r in rows if r[0] is not None and rows.index(r) == max(i for i, x in enumerate(rows) if x[0] == r[0])]  # ids are unique
    rows = list(dict(rows).items())
    rows += [(900, None), (901, " 12 34 !"), (902, "some words, then " + items[0][1] + " and more"), (903, "clean text of its own")]
    d = str(tmp_path / "in")
    spark.createDataFrame([(i, t, "en" if i % 2 else None, f"src{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = corpus_pipeline.run(spark, d).collect()
    kept = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    kept = [(i, t) for i, t in kept if i in {name for _, name, _, _ in test_bagminhash.brute(kept)}]
    bad = {r[0] for r in test_decontaminate.brute(kept, items) if r[5]}
    own = shards.Tokenizer(shards.vocabulary())
    want = Counter()
    for i, t in kept:
        if i not in bad:
            ids = np.array([*own.encoding.encode_ordinary(t), shards.END], "<u2")
            for k in range(0, len(ids), shards.SEQ_LEN):
                want[(i, k // shards.SEQ_LEN, hashlib.sha256(ids[k : k + shards.SEQ_LEN].tobytes()).hexdigest())] += 1
    assert bad and 903 not in bad
    assert Counter((r.doc_id, r.seq_no, r.tokens_sha256) for r in got) == want
    assert sorted(r.slot for r in got) == list(range(len(got)))


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, at string, `key` string, `row.x` int"


def run_on(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return corpus_pipeline.run(spark, path).collect()


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    extra = ("n", "a", "k", 1)
    clean = "der Hund und die Katze gehen heute durch den alten Wald"
    other = "a wholly different text that stands here once and has its own words"
    rows = [
        (1, clean, "de", "s", 9, *extra), (1, clean, "de", "s", 9, *extra), (2, clean, "de", None, 9, *extra),
        (None, other, "en", None, None, None, None, None, None), (3, None, None, None, None, *extra), (4, "", "en", "s", 0, *extra),
        (5, "so: one two three four five six seven eight nine ten and out", "en", "s", 9, *extra), (6, "word " * 30_000, "en", "s", 9, *extra),
    ]
    got = run_on(spark, str(tmp_path / "in"), rows)
    assert {r.doc_id for r in got} == {1, 6, None}
    assert Counter(r.doc_id for r in got if r.seq_no == 0) == Counter({1: 1, 6: 1, None: 1})
    assert sorted(r.slot for r in got) == list(range(len(got)))


def test_empty_table(spark, tmp_path):
    assert run_on(spark, str(tmp_path / "in"), []) == []
