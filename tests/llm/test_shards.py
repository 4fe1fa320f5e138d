import hashlib
import os
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import shards
from corpusloom.llm.common import table

VOCAB = shards.vocabulary()


def test_ids_are_the_tokenizers():
    own = shards.Tokenizer(VOCAB)
    for t in ["", " ", "a  b   c\n\n d \n", "it's we'LL don't _x_ 12,345", "Ünïcödé — “q” ² \x1c 語 🙂", "<|endoftext|>"]:
        assert own.encode(t).tolist() == own.encoding.encode_ordinary(t), t
        assert own.encoding.decode(own.encode(t).tolist()) == t


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_feistel_is_a_permutation(n):
    p = shards.feistel(np.arange(n), n, 42)
    assert sorted(p.tolist()) == list(range(n))
    assert (shards.feistel(p, n, 42, inverse=True) == np.arange(n)).all()
    if n >= 64:
        assert (p != shards.feistel(np.arange(n), n, 43)).any() and (p != np.arange(n)).mean() > 0.9


def test_round_trip_and_resume(spark, tmp_path):
    words = "the quick brown été fox 12 jumps over\nthe lazy dog. ".split(" ")
    r = np.random.default_rng(0)
    rows = [(i, " ".join(r.choice(words, int(r.integers(0, 60))))) for i in range(150)] + [(None, "x y"), (7, None), (8, ""), (9, "z " * 30_000), (3, "again"), (3, "again")]
    docs = table(spark.createDataFrame([(i, t, 5, "k") for i, t in rows], "doc_id long, text string, slot int, tokens string"), "t")
    path = str(tmp_path / "out")
    shards.write_shards(docs, path, VOCAB, seq_len=16, width=300)
    own = shards.Tokenizer(VOCAB)
    want, of = Counter(), {}
    for i, t in rows:
        if t is not None:
            ids = [*own.encoding.encode_ordinary(t), shards.END]
            for k in range(0, len(ids), 16):
                want[(i, k // 16, tuple(ids[k : k + 16]))] += 1
    total = sum(want.values())
    got = shards.read_shards(spark, path, 16).collect()
    assert Counter((x.doc_id, x.seq_no, tuple(np.frombuffer(x.tokens, "<u2").tolist())) for x in got) == want
    assert sorted(x.slot for x in got) == list(range(total)) and len({x.shard for x in got}) > 5
    index = shards.shard_index(spark, path, 16)
    assert sum(n for *_, n in index) == total and all(os.path.getsize(f.removeprefix("file:")) == n * shards.stride(16) for _, f, _, n in index)
    for x in got[:50]:  # any record stands at its byte
        name, at = shards.position(index, x.slot, 16)
        with open(name.removeprefix("file:"), "rb") as f:
            f.seek(at)
            rec = f.read(shards.stride(16))
        assert rec[: 2 * x.n_tokens] == x.tokens and rec[-1] == 0
    again = str(tmp_path / "again")
    shards.write_shards(docs, again, VOCAB, seq_len=16, width=300)
    assert sorted(map(tuple, shards.read_shards(spark, again, 16).collect())) == sorted(map(tuple, got))
    shards.write_shards(docs, again + "k", VOCAB, seq_len=16, key=5, width=300)
    assert sorted(map(tuple, shards.read_shards(spark, again + "k", 16).collect())) != sorted(map(tuple, got))


def test_empty_table(spark, tmp_path):
    docs = table(spark.createDataFrame([], "doc_id long, text string"), "t")
    assert shards.materialise(docs, str(tmp_path / "out")).count() == 0
    only_null = table(spark.createDataFrame([(1, None)], "doc_id long, text string"), "t")
    assert shards.materialise(only_null, str(tmp_path / "o2")).count() == 0
    one = table(spark.createDataFrame([(1, "")], "doc_id long, text string"), "t")
    row = shards.materialise(one, str(tmp_path / "o3")).first()
    assert (row.slot, row.n_tokens, row.tokens_sha256) == (0, 1, hashlib.sha256(np.array([shards.END], "<u2").tobytes()).hexdigest())
