"""The run store: one folder for each run, with what it was asked (run), what came out (result) and its curves.

A run's folder must not exist when it starts, and a run is finished once: both are new folders that Spark commits, so a
driver that dies leaves either a pending run or a finished one.  Other files beside these three are never read.
"""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "id string, experiment string, ts timestamp, config map<string,string>"
RESULT = "id string, best_val double, test map<string,double>"
CURVE = "id string, epoch int, val double, loss double"


def literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few records of the driver as a table."""
    text = json.dumps(rows, default=str)
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def start(spark: SparkSession, path: str, run: dict) -> None:
    """An error if the run is there already."""
    literal(spark, [run], RUN).write.mode("errorifexists").json(f"{path}/{run['id']}/run")


def finish(spark: SparkSession, path: str, run_id: str, result: dict, curves: list[dict]) -> None:
    """An error if the run was not started or is finished."""
    run(spark, path, run_id)
    if not pending(spark, path).where(F.col("id") == run_id).count():
        raise FileExistsError(f"results of run {run_id} exist")
    literal(spark, [c | {"id": run_id} for c in curves], CURVE).write.mode("overwrite").json(f"{path}/{run_id}/curves")
    literal(spark, [result | {"id": run_id}], RESULT).write.mode("errorifexists").json(f"{path}/{run_id}/result")


def _read(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*/{part}")
    there = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/*/{part}") if there else spark.createDataFrame([], schema)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs with their results; best_val is null for those that are pending."""
    return _read(spark, path, "run", RUN).join(_read(spark, path, "result", RESULT), "id", "left")


def curves(spark: SparkSession, path: str) -> DataFrame:
    """The curves of finished runs."""
    return _read(spark, path, "curves", CURVE).join(_read(spark, path, "result", RESULT).select("id"), "id", "left_semi")


def pending(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "run", RUN).join(_read(spark, path, "result", RESULT), "id", "left_anti")


def run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """One run, by its id; an error if it is not there."""
    found = runs(spark, path).where(F.col("id") == run_id)
    if found.count() != 1:
        raise KeyError(f"no run {run_id}")
    return found


def records(spark: SparkSession, path: str) -> DataFrame:
    """Finished runs as records again: config, result, and the curves as arrays in the order of epochs."""
    order = F.array_sort(F.collect_list(F.struct("epoch", "val", "loss")))  # a run's epochs
    lines = curves(spark, path).groupBy("id").agg(order.alias("c")).select("id", F.col("c.epoch").alias("epochs"), F.col("c.val").alias("val_by_epoch"), F.col("c.loss").alias("loss_by_epoch"))
    return runs(spark, path).where("best_val is not null").join(lines, "id", "left")


def files_per_run(spark: SparkSession, path: str) -> DataFrame:
    """run, files: how many files lie below each run's folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")  # contents are not read
    base = path.rstrip("/").rsplit("/", 1)[-1]
    return found.groupBy(F.regexp_extract("path", rf"/{base}/([^/]+)/", 1).alias("run")).agg(F.count(F.lit(1)).alias("files"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a line; nulls are written, an existing folder is an error."""
    df.write.option("ignoreNullFields", False).mode("errorifexists").json(path)
