import zlib

import numpy as np

from corpusloom.llm import langid

EN = "the quick brown fox and the lazy dog went with the other one to the house of the king that was there"
DE = "der schnelle braune fuchs und der faule hund gingen mit dem anderen zu dem haus des königs das dort war"


def brute(text, e, dim):
    v = np.zeros(dim)
    word = []
    for c in text.lower() + " ":
        if c.isalpha():
            word.append(ord(c))
        elif word:
            w = [32, *word, 32]
            for a, b, d in zip(w, w[1:], w[2:]):
                v += np.roll(e.letter(a), 2).astype(float) * np.roll(e.letter(b), 1) * e.letter(d)
            word = []
    return v


def test_encoder_is_the_sum_of_bound_trigrams(monkeypatch):
    e = langid.Encoder(256)
    texts = [None, "", "123 ...", "a", "Été à la mer!", EN, "語" * 5 + " 𝒳y x", DE + "\n" + EN]
    want = np.stack([brute(t or "", e, 256) for t in texts])
    assert np.allclose(e.encode(texts), want)
    monkeypatch.setattr(langid, "SEGMENT", 11)
    monkeypatch.setattr(langid, "CHUNK", 3)
    assert np.allclose(e.encode(texts), want)
    wide = [" ".join(chr(0x4E00 + 3 * i) + chr(0x4E00 + 7 * i) for i in range(400))]
    monkeypatch.setattr(langid, "SEGMENT", 10**6)
    assert np.allclose(e.encode(wide), [brute(wide[0], e, 256)])


def test_learns_from_the_right_rows_and_handles_odd_ones(spark):
    r = np.random.default_rng(3)
    rows = [(i, " ".join(r.permutation((EN if i % 2 else DE).split())[:9]), "en" if i % 2 else "de", 1.5) for i in range(200)]
    # a held-out row never teaches: its labels are wrong on purpose
    rows = [(i, t, ("xx" if zlib.crc32(str(i).encode()) % 4 == 2 else k), s) for i, t, k, s in rows]
    odd = [(None, None, None, None), (900, None, "en", 1.0), (901, "", "en", 1.0), (902, "12 !?", None, 1.0), (903, EN, None, 1.0), (903, EN, None, 1.0), (904, (DE + " ") * 3000, None, 1.0)]
    got = langid.identify(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double"), per_lang=1000)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    out = got.collect()
    assert len(out) == len(rows) + len(odd)
    by = {x.doc_id: x for x in out}
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in out)
    assert all(by[i].lang_pred == ("en" if i % 2 else "de") for i in range(200))
    assert [by[i].lang_pred for i in (None, 900, 901, 902, 903, 904)] == ["und", "und", "und", "und", "en", "de"]
    assert all(0 <= x.score <= 1 for x in out) and by[901].score == 0


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(empty).collect() == []
    assert langid.identify(spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")).first().lang_pred == "und"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def test_a_language_of_copies_is_learned_and_others_can_be_refused(spark):
    r = np.random.default_rng(2)
    rows = [(i, " ".join(r.permutation(EN.split())[:9]), "en") for i in range(400)] + [(1000 + i, DE, "de") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, prototypes = langid.train(df, per_lang=50)
    assert langs == ["de", "en"]
    odd = spark.createDataFrame([(1, EN, "x"), (2, DE, None), (3, None, "en"), (4, "12", "de"), (5, "語" * 9, "en")], "doc_id long, text string, lang string")
    kept = lambda **kw: sorted(x.doc_id for x in langid.accept(odd, langs, prototypes, **kw).collect())
    assert kept(allowed=["de"]) == [2] and kept(noise=4) == [1, 2] and set(kept()) <= {1, 2, 5}
    assert kept(allowed=["de", "en", "und"], noise=4) == [1, 2, 3, 4]
    assert langid.accept(odd, [], prototypes[:0]).count() == 0
