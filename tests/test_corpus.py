import gzip
import io
import json
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ledger, model, splits
from corpusloom.plans import experiments as X
from corpusloom.sources import files
from corpusloom.streaming import pages as stream


def test_split_keeps_sites_whole(spark):
    r = np.random.default_rng(0)
    rows = [(i, f"s{int(r.integers(40))}", "en", "mid") for i in range(600)] + [(1000 + i, "huge", "en", "mid") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id int, site string, language string, level string")
    got = {x.site: x for x in splits.site_split(df, "site", "language", "level").collect()}
    assert len(got) == 41 and got["huge"].fold == "train"
    val = sum(x.n for x in got.values() if x.fold == "val")
    assert 80 <= val <= 112


def test_nested_subsets(spark):
    rows = [(i, "val" if i < 50 else "train", ["simple", "mid", "hard"][(i % 10 >= 6) + (i % 10 >= 9)]) for i in range(550)] + [(900, "test", None)]
    df = spark.createDataFrame(rows, "id int, fold string, level string")
    sets = {n: {x.id: x.level for x in splits.nested_subset(df, "id", "level", "fold", n).collect()} for n in (50, 100, 1000)}
    assert set(sets[50]) < set(sets[100]) < set(sets[1000]) and len(sets[1000]) == 500
    for n in (50, 100):
        for level, share in (("simple", 0.6), ("mid", 0.3), ("hard", 0.1)):
            assert abs(sum(x == level for x in sets[n].values()) - share * n) <= 2


def test_merge_and_overlap(spark):
    a = spark.createDataFrame([(1, "a1", None), (2, "a2", "y")], "k int, u string, g string")
    b = spark.createDataFrame([(2, "b2", "z"), (3, "b3", "w")], "k int, u string, g string")
    assert sorted(tuple(r) for r in splits.merge(a, b, "k", {"u": "big", "g": "small"}).collect()) == [(1, "a1", None, "full"), (2, "a2", "z", "both"), (3, "b3", "w", "test")]
    assert sorted(tuple(r) for r in splits.unpaired(a, b, "k").collect()) == [(1, "left"), (3, "right")]
    assert splits.replicated(a, b, 0).count() == 2 and splits.replicated(a, b, 2).count() == 6


def test_ledger(spark):
    runs = spark.createDataFrame([(1, "m", 0, 0.5, 544, 1), (2, "m", 1, 0.7, 544, 2), (3, "m", 1, 0.9, 544, 3), (4, "n", 0, 0.1, 20, 1)], "id int, model string, seed int, f1 double, n int, ts int")
    last = ledger.latest(runs, ["model", "seed"], "ts", "id")
    assert sorted(r.id for r in last.collect()) == [1, 3, 4]
    shown = {r.model: r.shown for r in ledger.seeds(last, ["model"], "f1").collect()}
    assert shown == {"m": "0.7000±0.2828", "n": "0.1000"}
    with pytest.raises(ValueError, match="fewer pages"):
        ledger.guard(runs.withColumn("board", F.lit("b")), "board", "n")
    lat = ledger.latency(spark.createDataFrame([("a", float(i)) for i in range(10)], "g string, ms double"), ["g"], "ms").first()
    assert (lat.n, lat.median, lat["mean"], lat.p90) == (10, 4.5, 4.5, 9.0)
    none = ledger.ratios(spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0)], "p int, m string, ms double"), "p", "m", "ms", "a")
    assert none.count() == 0
    md = ledger.report(last, ["model", "seed", "f1"], ["model", "seed"]).first().markdown
    assert md.splitlines()[2] == "| m | 0 | 0.5 |" and len(md.splitlines()) == 5


def test_windows_packing_and_heads(spark):
    t = spark.createDataFrame([(1, 0, 0, 1, 10), (1, 1, 2, 3, 10), (1, 2, None, None, 10), (1, 3, 4, 5, 10), (1, 4, 6, 9, 10), (2, 0, 0, 2, 3)], "p int, idx int, first int, last int, n int")
    got = sorted(tuple(r) for r in model.window_samples(t, "p", 4, 2).collect())
    assert got == [(1, 0, 4, 0, 3), (1, 2, 6, 1, 4), (1, 4, 8, 3, 4), (1, 6, 10, 4, 5), (2, 0, 3, 0, 1)]
    own = sorted((r.start, r.lo, r.hi) for r in model.owned(spark.createDataFrame([(1, 0), (1, 4)], "p int, start int"), "p", 6).collect())
    assert own == [(0, 0, 5), (4, 1, 6)]
    rows = [(i, int(n)) for i, n in enumerate(np.random.default_rng(1).integers(1, 3000, 300))]
    b = model.packed(spark.createDataFrame(rows, "id int, n int"), "id", "n", 16, 4096, 2500).groupBy("part", "batch").agg(F.count("*").alias("c"), F.max("n").alias("m"), F.min("n").alias("lo")).collect()
    assert sum(x.c for x in b) == 300 and all(x.c <= 16 and (x.c == 1 or x.c * x.m <= 4096) for x in b) and all(x.c == 1 for x in b if x.m > 2500)
    r = np.random.default_rng(2)
    w = {f"{d}{k}": r.normal(size=s) for d in "fb" for k, s in (("W", (9, 2)), ("U", (9, 3)), ("c", (9,)))} | {"v": r.normal(size=6), "o": 0.1}
    p = spark.createDataFrame([(1, [[0.1, 0.2], [0.3, -1.0], [2.0, 0.5]]), (2, [])], "id int, x array<array<double>>")
    probs = {x.id: x.probs for x in model.gru(p, "id", "x", w).collect()}
    assert len(probs[1]) == 3 and probs[2] == [] and all(0 < x < 1 for x in probs[1])
    f = spark.createDataFrame([([1.0, 1.0, 0.0],), ([5.0, 0.0, 4.0],), ([3.0, 1.0, 2.0],)], "v array<double>")
    z = [x.v for x in model.standardized(f.limit(3), model.column_stats(f.where("v[0] <> 3"), "v", [0, 2]), "v", [0, 2]).collect()]
    assert z == [[-1.0, 1.0, -1.0], [1.0, 0.0, 1.0], [0.0, 1.0, 0.0]]


def test_specs_and_pipeline(spark, tmp_path):
    spec = {"name": "x", "recipe": "r", "board": "b", "sweep": {"a": [1, 2, 3]}, "seeds": [0, 1, 2]}
    rows = [json.loads(r.config) for r in X.expand(spark, spec).orderBy("n").collect()]
    assert [(r["a"], r["seed"]) for r in rows] == [(a, s) for a in (1, 2, 3) for s in (0, 1, 2)] and rows[0]["board"] == "b"
    for bad in ({**spec, "zz": 1}, {**spec, "sweep": {"a": []}}, {**spec, "seeds": [1, 1]}, {"name": "x"}, {**spec, "seeds": []}):
        with pytest.raises(ValueError):
            X.validate(bad)
    ran = []
    p = X.Pipeline(spark, str(tmp_path / "p")).stage("one", lambda s, i: (ran.append(1), s.range(5))[1], lambda d: X.expect(d, small=F.col("id") < 9)).stage("two", lambda s, i: i["one"].selectExpr("id * 2 as id"))
    assert sorted(r.id for r in p.run()["two"].collect()) == [0, 2, 4, 6, 8]
    p.run()
    assert ran == [1]  # what is written is not made again
    with pytest.raises(ValueError, match="low"):
        X.expect(spark.range(5), low=F.col("id") < 3)
    with pytest.raises(ValueError):
        X.unique(spark.createDataFrame([(1,), (1,)], "k int"), "k")


def test_sources(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.html").write_text("<p>é</p>", encoding="utf-8")
    (d / "b.html").write_bytes("<p>très bien, été à la mer où il fait chaud</p>".encode("latin-1"))
    (d / "a.json").write_text('{"title": "A"}')
    got = {r.file_id: r for r in files.pairs(spark, str(d), "title string").collect()}
    assert got["a"].title == "A" and got["a"].html == "<p>é</p>" and not got["a"].fallback
    assert got["b"].fallback and got["b"].title is None and "<p>" in got["b"].html
    (d / "c.gz").write_bytes(gzip.compress(b"hello"))
    assert files.binary(spark, str(d), "*.gz").select(files.gunzip("content").cast("string")).first()[0] == "hello"
    for name, ok in (("x/y.txt", True), ("../evil", False)):
        buf = io.BytesIO()
        with tarfile.open(fileobj=buf, mode="w:gz") as t:
            info = tarfile.TarInfo(name)
            info.size = 3
            t.addfile(info, io.BytesIO(b"abc"))
        df = spark.createDataFrame([(bytearray(buf.getvalue()),)], "content binary")
        if ok:
            assert files.untar(df, "x/").first().name == name
        else:
            with pytest.raises(Exception, match="leaves the archive"):
                files.untar(df).collect()
    table = str(tmp_path / "t")
    files.rewrite(spark.range(3), table)
    files.rewrite(spark.read.parquet(table).where("id > 0"), table, lambda n: X.expect(n, some=F.col("id") > 0))
    assert spark.read.parquet(table).count() == 2
    with pytest.raises(ValueError):
        files.rewrite(spark.read.parquet(table), table, lambda n: X.expect(n, some=F.col("id") > 1))
    assert spark.read.parquet(table).count() == 2
    split = spark.createDataFrame([("p1", "train", 1), ("p2", "val", None)], "track_id string, fold string, level int")
    files.write_json_map(split, "track_id", str(tmp_path / "m"))
    assert sorted(tuple(r) for r in files.json_map(spark, str(tmp_path / "m"), "struct<fold:string,level:int>").collect()) == [("p1", "train", 1), ("p2", "val", None)]
    files.start_run(spark.range(1), str(tmp_path / "run"))
    with pytest.raises(Exception, match="(?i)exists"):
        files.start_run(spark.range(1), str(tmp_path / "run"))
    with pytest.raises(ValueError, match="manifest"):
        files.pinned(files.binary(spark, str(d)), "0")
    assert files.yaml_table(spark, "- {a: 1, b: x}\n- {a: 2}", "a:int,b:string").count() == 2
    assert files.environment(spark)["spark"]


def test_streams(spark, tmp_path):
    src = tmp_path / "s"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(str(src))
    batch = spark.read.parquet(str(src))
    events = spark.readStream.schema(batch.schema).parquet(str(src))
    out = stream.drain(stream.latencies(events, delay="60 days"), str(tmp_path / "o"), str(tmp_path / "c"))
    want = {(r.start, r.event_type): r.n for r in stream.latencies(batch).collect()}
    assert all(want[(r.start, r.event_type)] == r.n for r in out.collect())
    pages = tmp_path / "p"
    spark.read.parquet("/root/testdata/sf0.001/pages.parquet").write.parquet(str(pages))
    lines = stream.drain(stream.labelled(stream.page_stream(spark, str(pages))), str(tmp_path / "lo"), str(tmp_path / "lc"))
    from corpusloom.operators import dom

    assert lines.count() == dom.lines(spark.read.parquet(str(pages))).count() > 0
    assert os.path.exists(tmp_path / "lc")
