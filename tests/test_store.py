"""Run store, records, boards and heads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import numbers
from corpusloom.operators import boards, dom, heads, records
from corpusloom.plans import experiments
from corpusloom.sources import runs


def test_run_lifecycle(spark, tmp_path):
    d = str(tmp_path / "store")
    for i in ("a", "b"):
        runs.start(spark, d, {"id": i, "experiment": "x", "ts": "2024-01-01T00:00:00Z", "config": {"seed": i}})
    with pytest.raises(Exception, match="(?i)exist"):
        runs.start(spark, d, {"id": "a"})
    with pytest.raises(KeyError):
        runs.finish(spark, d, "zz", {}, [])
    runs.finish(spark, d, "a", {"best_val": 0.5, "test": {"wild": 0.4}}, [{"epoch": 2, "val": 0.5, "loss": 1.0}, {"epoch": 1, "val": 0.4, "loss": 2.0}])
    with pytest.raises(Exception, match="(?i)exist"):
        runs.finish(spark, d, "a", {"best_val": 0.6}, [])
    assert [r.id for r in runs.pending(spark, d).collect()] == ["b"]
    x = runs.records(spark, d).first()
    assert (x.id, x.config, x.test, x.val_by_epoch, x.epochs) == ("a", {"seed": "a"}, {"wild": 0.4}, [0.4, 0.5], [1, 2])
    assert runs.run(spark, d, "b").first().best_val is None
    with pytest.raises(KeyError):
        runs.run(spark, d, "c")
    assert {r.run for r in runs.files_per_run(spark, d).collect()} == {"a", "b"}
    out = str(tmp_path / "lines")
    runs.write_json_lines(spark.createDataFrame([(1, None)], "a int, b string"), out)
    assert spark.read.text(out).first()[0] == '{"a":1,"b":null}'
    assert runs.curves(spark, str(tmp_path / "nothing")).count() == 0


def test_records(spark):
    df = spark.createDataFrame([("r1", "m", 8, 100, None, "x"), ("r2", "m", 8, None, "de", ""), ("r3", "m", 8, None, None, None)], "id string, model string, layers int, train_limit int, holdout string, note string")
    assert [r.s for r in df.select(records.section(df).alias("s")).collect()] == ["ladder", "holdout", "full"]
    assert [r.id for r in records.promotable(df).collect()] == ["r3"]
    assert df.select(records.cell(df).alias("c")).distinct().count() == 3
    assert [r.note for r in records.with_defaults(df, {"note": "-"}).collect()] == ["x", "-", "-"]
    judged = {r.id: (r.verdict, r.reason) for r in records.judged(df, F.col("note") == "x", {"no note": F.col("note").isNull()}).collect()}
    assert judged == {"r1": ("dropped", "drift"), "r2": ("valid", None), "r3": ("error", "no note")}
    with pytest.raises(ValueError, match="malformed"):
        records.checked(df, F.lit(False), {"no note": F.col("note").isNull()})
    flat = records.flattened(spark.createDataFrame([(1, '{"a": 1, "c": {"d": "x", "e": 2}}')], "id int, j string"), "id", F.col("j"))
    assert {(r.name, r.value) for r in flat.collect()} == {("a", "1"), ("c.d", "x"), ("c.e", "2")}
    cells = records.nested(spark.createDataFrame([("m", "b", 0.2), ("m", "b", 0.1), ("m", "a", 0.3)], "model string, board string, f1 double"), "model", "board", "f1").first().cells
    assert cells == {"a": [0.3], "b": [0.1, 0.2]}
    values = spark.createDataFrame([("z",), ("b",), ("a",), ("q",)], "v string")
    assert [r.v for r in values.orderBy(records.ranked(F.col("v"), ["q", "b"])).collect()] == ["q", "b", "a", "z"]
    assert records.unequal_groups(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "g string, m int"), "g", "m").first().g == "b"


@pytest.mark.parametrize("change", [
    {"name": ""}, {"name": "a/b"}, {"recipe": None}, {"board": 3}, {"other": 1}, {"sweep": {"layers": 4}}, {"sweep": {"layers": []}}, {"sweep": {"layers": [4, 4]}},
    {"sweep": {"seed": [1]}}, {"sweep": {"board": ["a"]}}, {"fixed": {"head": 1}, "sweep": {"head": [1]}}, {"fixed": {"recipe": "r"}}, {"seeds": []}, {"seeds": [1, 1]}, {"seeds": ["1"]},
    {"seeds": [True]}, {"holdout": "de", "train_limit": 5}, {"train_limit": 0}, {"sweep": [1]},
])
def test_invalid_specs(change):
    good = {"name": "x", "recipe": "table", "board": "wild", "sweep": {"layers": [4, 8]}, "seeds": [0, 1]}
    assert experiments.validate(good) == good
    with pytest.raises(ValueError):
        experiments.validate(good | change)


HTML = '<html><body><nav><a href="/">Home</a></nav><article><h1>Title</h1><p>First  text,\n long enough</p><ul><li>item</li></ul></article><footer>Foot</footer></body></html>'


def test_masks_and_markdown(spark):
    pages = spark.createDataFrame([(1, HTML), (2, "")], "page_id int, html string")
    lines = [r.text for r in dom.lines(pages).where("page_id = 1 and not blank").orderBy("idx").collect()]
    masks = spark.createDataFrame([(1, [int("text" in x or "Title" in x) for x in lines]), (2, [])], "page_id int, mask array<int>")
    out = {r.page_id: r for r in boards.marked(pages, masks).collect()}
    assert out[1].markdown == "# Title\nFirst text, long enough" and "Foot" not in out[1].main_html and "<p>" in out[1].main_html and "cc-select" not in out[1].main_html
    assert out[2].markdown == ""
    with pytest.raises(Exception, match="labels for"):
        boards.marked(pages, masks.withColumn("mask", F.array(F.lit(1)))).collect()
    again = {r.page_id: r.markdown for r in dom.markdown(pages).collect()}
    assert "# Title" in again[1] and "* item" in again[1]
    assert spark.createDataFrame([("<p>a\n b</p><p> </p><P class=x>c<b>d</b></p>",), (None,)], "h string").select(boards.clean_reference(F.col("h")).alias("t")).collect()[0].t == "a b\ncd"


def test_boards_extractors_and_matrix(spark):
    @boards.register("broken", "text")
    def broken(html):
        raise RuntimeError("no")

    try:
        pages = spark.createDataFrame([(i, HTML.replace("Title", f"T{i}"), "val" if i % 2 else "test") for i in range(6)] + [(9, "<p>no article</p>", "val")], "page_id int, html string, fold string")
        got = boards.extracted(pages, "broken").collect()
        assert all(r.text is None and r.error == "RuntimeError: no" for r in got)
        assert "Foot" not in boards.extracted(pages, "dense").first().text
        b = boards.PagesBoard("own", pages)
        one = boards.matrix({n: (lambda p, n=n: boards.extracted(p, n)) for n in ("article", "everything")}, [b], "val").collect()
        by = {r.model: r for r in one}
        assert by["article"].f1 == 1.0 and by["article"].n == 3 and by["article"].n_null == 1 and by["everything"].f1 < 1
        refs = b.references("test")
        assert b.scorer("test")(refs.select("page_id", F.col("ref").alias("pred"))) == 1.0
        with pytest.raises(Exception, match="no prediction"):
            boards.answered(refs, refs.limit(0).withColumn("pred", F.lit("")), "page_id").collect()
        assert boards.fold_prefix(pages, "page_id", "fold", 2).groupBy("fold").count().where("count = 2").count() == 2
        folds = boards.Folds(pages)
        assert folds.get(fold="val") is folds.get(fold="val") and folds.get(fold="val").count() == 4
        folds.close()
        with pytest.raises(ValueError, match="both"):
            boards.apart(pages, pages, "page_id")
        assert boards.subset(pages.where("page_id < 3"), pages, "page_id").first().within
    finally:
        del boards.EXTRACTORS["broken"]


def test_heads_windows_and_artefacts(spark, tmp_path):
    r = np.random.default_rng(0)
    for n in (1, 4, 5, 9, 23):
        w = heads.windows(n, 4)
        assert [i for _, _, lo, hi in w for i in range(lo, hi)] == list(range(n)) and all(a <= lo <= hi <= b for a, b, lo, hi in w)
    xs = {i: r.normal(size=(int(r.integers(0, 12)), 3)) for i in range(20)}
    pages = spark.createDataFrame([(i, x.tolist()) for i, x in xs.items()], "page_id int, vectors array<array<double>>")
    weights = {"linear": {"v": r.normal(size=3), "o": 0.1}, "transformer": {"q": r.normal(size=(3, 2)), "k": r.normal(size=(3, 2)), "p": r.normal(size=(3, 2)), "r": r.normal(size=(2, 3)), "v": r.normal(size=3), "o": 0.0},
               "trees": {"column": [0, 2], "threshold": [0.0, 0.5], "below": [-1.0, 0.3], "above": [1.0, -0.2], "o": 0.0}}
    for kind, w in weights.items():
        heads.save(spark, str(tmp_path / kind), kind, w)
        back, own = heads.load(spark, str(tmp_path / kind))
        assert back == kind
        head = heads.HEADS[kind]({k: np.asarray(v, float) for k, v in w.items()})
        for x in heads.infer(pages, "page_id", back, own).collect():  # batches give what single pages give
            assert np.allclose(x.probs, head(xs[x.page_id]) if len(xs[x.page_id]) else [], atol=1e-6)
    small = {x.page_id: x.probs for x in heads.infer(pages, "page_id", "linear", weights["linear"], size=3).collect()}
    assert all(np.allclose(small[i], 1 / (1 + np.exp(-(x @ weights["linear"]["v"] + 0.1))), atol=1e-6) for i, x in xs.items() if len(x))
    assert {x.page_id: x.probs for x in heads.export(pages, heads.infer(pages.where("page_id < 3"), "page_id", "linear", weights["linear"]), "page_id").collect()}[7] == []


def test_probabilities_next_to_a_threshold(spark):
    pages = spark.createDataFrame([(1, [[4e-7], [-4e-7], [0.0]])], "page_id int, vectors array<array<double>>")
    probs = heads.infer(pages, "page_id", "linear", {"v": [1.0], "o": 0.0})
    assert probs.select(F.transform("probs", lambda p: p > 0.5)).first()[0] == [True, False, False]
    assert probs.select(F.transform("probs", lambda p: p < 0.5)).first()[0] == [False, True, False]


def test_infer_tokens(spark):
    table = spark.createDataFrame([(1, [1.0, 3.0]), (2, [5.0, 1.0]), (2, [0.0, 4.0]), (2, [5.0, 1.0]), (3, [None, None]), (4, []), (5, [None, 2.0]), (6, [float("nan"), 0.0]), (9, None)], "token long, vector array<float>")
    kind, w = "page_id int, tokens array<array<array<int>>>", {"v": [1.0, 2.0], "o": 0.0}
    pages = spark.createDataFrame([(1, [[[1, 2, 7], [], [1, 3, 4, 9]]]), (2, [[[1], [2]], [[2, 1, 1]]]), (3, []), (4, [[[6], [1], [5, 1]]])], kind)
    known = heads.vocabulary(pages.select("page_id", F.explode("tokens").alias("tokens")), table, 2)
    assert known[0].tolist() == [1, 2, 5, 6] and known[2].tolist() == [1, 3, 1, 1]
    got = {r.page_id: np.array(r.probs) for r in heads.infer_tokens(pages, "page_id", known, "linear", w, 2).collect()}
    p = lambda *x: 1 / (1 + np.exp(-np.mean(x)))  # noqa: E731 - of the tokens' scores: 1 and (0, 4) give 1, (5, 1) gives -1
    assert np.allclose(got[1], [p(1, 1, -1, -1), 0.5, p(1)], atol=1e-4)
    assert np.allclose(got[2], [p(1, 1, 1, 1, -1, -1), p(1, -1, -1), p(1, 1, 1, 1, -1, -1)], atol=1e-4)  # page 2 came in two rows
    assert not len(got[3]) and np.isnan(got[4][0]) and np.allclose(got[4][1:], [p(1), p(0, 1)], atol=1e-4)
    none = heads.vocabulary(pages.select("page_id", F.explode("tokens").alias("tokens")), table.where("token > 9"), 2)
    assert [r.probs for r in heads.infer_tokens(pages.where("page_id = 2"), "page_id", none, "linear", w).collect()] == [[0.5] * 3]
    many = spark.createDataFrame([(i, [[[1 + i % 2]] * (i % 40 * 100)]) for i in range(60)], kind)  # over several runs of blocks
    got = {r.page_id: np.array(r.probs) for r in heads.infer_tokens(many.coalesce(1), "page_id", known, "linear", w).collect()}
    assert all(len(got[i]) == i % 40 * 100 and np.allclose(got[i], p(-1, 1, -1) if i % 2 else p(1), atol=1e-4) for i in range(60))


def test_page_vectors_and_recipe(spark, tmp_path):
    table = spark.createDataFrame([("a", [1.0, 3.0]), ("b", [5.0, 1.0])], "token string, vector array<float>")
    blocks = spark.createDataFrame([(1, 0, "A b c", [9.0]), (1, 1, "", [8.0]), (1, 2, "a", [7.0])], "page_id int, idx int, text string, feats array<float>")
    got = heads.page_vectors(blocks, table, "page_id", 2, "feats").first().vectors
    assert np.allclose(got, [[0, 0, 9], [0, 0, 8], [-1, 1, 7]], atol=1e-4)
    row = spark.createDataFrame([([1.0, 5.0, 3.0], [1.0, 1.0, 1.0], [1.0, 2.0, 2.0])], "f array<double>, m array<double>, s array<double>")
    assert row.select(heads.live_features(F.col("f"), F.col("m"), F.col("s"), [2, 1])).first()[0] == [1.0, 2.0]
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 2))
    df = spark.createDataFrame([(v.tolist(), int(v[0] + v[1] > 0)) for v in x], "vector array<double>, label int")
    result, curve = heads.RECIPES["table"]({"path": str(tmp_path / "head")}, {"train": df, "val": df})
    assert result["val_f1"] > 0.95 and len(curve) == 4 and heads.load(spark, str(tmp_path / "head"))[0] == "linear"
    m = spark.createDataFrame([([[1.0, -2.0], [100.0, 0.3]],)], "m array<array<double>>").select(numbers.quantize_channels(F.col("m"))).first()[0]
    assert abs(m[0][0] - 1) < 2 / 127 and m[1] == [100.0, 0.0]
