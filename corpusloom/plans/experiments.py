"""Experiment specs, sweeps, resume, pipelines with checks."""

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = {"name", "recipe", "board", "extra", "model", "sweep", "seeds", "note", "fixed", "holdout", "train_limit"}


def validate(spec: dict) -> dict:
    """The spec, or an error that names what is wrong with it."""
    wrong = problems(spec)
    if wrong:
        raise ValueError("; ".join(wrong))
    return spec


def problems(spec: dict) -> list[str]:
    if not isinstance(spec, dict):
        return ["a spec is a map"]
    out = [f"unknown keys: {sorted(map(str, unknown))}"] if (unknown := set(spec) - KEYS) else []
    out += [f"{k} is missing" for k in ("name", "recipe", "board") if not spec.get(k) or not isinstance(spec[k], str)]
    sweep, fixed, seeds = spec.get("sweep") or {}, spec.get("fixed") or {}, spec.get("seeds", [0])
    for part, value in (("sweep", sweep), ("fixed", fixed)):
        if not isinstance(value, dict):
            return [*out, f"{part} is a map"]
    for k, v in sweep.items():
        if not isinstance(v, list) or not v:
            out.append(f"sweep.{k} needs a list of values")
        elif len({json.dumps(x, sort_keys=True) for x in v}) != len(v):
            out.append(f"sweep.{k} repeats a value")
    own = {"recipe", "board", "model", "extra"} & set(spec)
    out += [f"{k} is both swept and given" for k in sorted(set(sweep) & (set(fixed) | own))]
    out += [f"{k} is both fixed and given" for k in sorted(set(fixed) & own)]
    if "seed" in sweep or "seed" in fixed:
        out.append("seeds stand in seeds")
    if not isinstance(seeds, list) or not seeds:
        out.append("seeds needs a list")
    elif not all(isinstance(s, int) and not isinstance(s, bool) and s >= 0 for s in seeds) or len(set(seeds)) != len(seeds):
        out.append("seeds need to be distinct whole numbers")
    if spec.get("holdout") is not None and spec.get("train_limit") is not None:
        out.append("holdout and train_limit exclude one another")
    if (n := spec.get("train_limit")) is not None and (not isinstance(n, int) or n <= 0):
        out.append("train_limit is a positive number")
    if isinstance(spec.get("name"), str) and spec["name"] and not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", spec["name"]):
        out.append("name has characters that a folder should not have")
    return out


def expand(spark: SparkSession, spec: dict) -> DataFrame:
    """One row per run: n (order: axes as written, seeds innermost), config (JSON, keys sorted)."""
    validate(spec)
    out = spark.range(1).select(F.struct().alias("o")).select(F.array().cast("array<int>").alias("o"), F.create_map().cast("map<string,string>").alias("m"))
    axes = {**(spec.get("sweep") or {}), "seed": spec.get("seeds", [0])}
    for axis, values in axes.items():
        own = F.array(*(F.lit(json.dumps(v)) for v in values))
        out = out.select("o", "m", F.posexplode(own).alias("p", "v")).select(F.array_append("o", F.col("p")).alias("o"), F.map_concat("m", F.create_map(F.lit(axis), F.col("v"))).alias("m"))
    fixed = {k: spec[k] for k in ("recipe", "board", "extra", "model") if spec.get(k) is not None} | (spec.get("fixed") or {})
    whole = F.map_concat("m", F.create_map(*(x for k, v in fixed.items() for x in (F.lit(k), F.lit(json.dumps(v)))))) if fixed else F.col("m")
    pairs = F.transform(F.array_sort(F.map_entries(whole)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"]))
    rows = out.select("o", F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")).alias("config"))
    place, width = F.lit(0).cast("bigint"), 1
    sizes = [len(v) for v in axes.values()]
    for i in range(len(sizes) - 1, -1, -1):
        place, width = place + F.element_at("o", i + 1) * width, width * sizes[i]
    return rows.select(place.alias("n"), "config")


def todo(configs: DataFrame, done: DataFrame) -> DataFrame:
    """Configs that this launch has not finished."""
    return configs.join(done.select("config").distinct(), "config", "left_anti")


def expect(df: DataFrame, **checks) -> DataFrame:
    """Raises unless every named condition holds for all rows; one pass."""
    got = df.agg(F.count(F.lit(1)).alias("__n"), *(F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items())).first()
    if bad := {k: got[k] for k in checks if got[k]}:
        raise ValueError(f"of {got['__n']} rows, checks failed: {bad}")
    return df


def unique(df: DataFrame, *key: str) -> DataFrame:
    """Raises if a key occurs twice."""
    twice = df.groupBy(*key).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"keys occur more than once: {twice}")
    return df


class Pipeline:
    """Named stages; each is written below ``path`` and read back, and its checks run before the next stage.

    A stage whose folder is complete (Spark's _SUCCESS file) is not run again: a broken run goes on where it stopped.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.stages = spark, path.rstrip("/"), []

    def stage(self, name: str, fn, check=None) -> "Pipeline":
        self.stages.append((name, fn, check))
        return self

    def done(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def run(self) -> dict[str, DataFrame]:
        out: dict[str, DataFrame] = {}
        for i, (name, fn, check) in enumerate(self.stages):
            path = f"{self.path}/{i:02d}-{name}"
            if not self.done(path):
                fn(self.spark, out).write.mode("overwrite").parquet(path)
            out[name] = self.spark.read.parquet(path)
            if check:
                check(out[name])
        return out
