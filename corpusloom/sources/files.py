"""Scans and sinks: JSON lines, whole-file JSON maps, file pairs, wild HTML, checksums, guarded rewrites."""

import gzip
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

PAGE = "track_id string, html string, url string, main_html string, convert_main_content string, groundtruth_content string, meta struct<language:string,level:string>"
RUN = "id string, experiment string, launch string, kind string, note string, config string, result string, started string, ended string"


def json_lines(spark: SparkSession, path: str, schema: str = PAGE, columns: list[str] | None = None) -> DataFrame:
    """One object a line, an explicit schema, malformed lines are errors; only the stated columns are read."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df.select(*columns) if columns else df


def json_map(spark: SparkSession, path: str, value: str, key: str = "track_id") -> DataFrame:
    """A file that is one object {key: value}: a row per key; value is a DDL type, structs become columns."""
    rows = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias(key, "v"))
    return rows.select(key, "v.*") if value.startswith("struct") else rows.withColumnRenamed("v", "value")


def write_json_map(df: DataFrame, key: str, path: str) -> None:
    """The inverse of json_map, for tables that one row can hold (split maps, reports)."""
    value = F.struct(*(c for c in df.columns if c != key))
    df.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), value))))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z0-9]+)*$", 1)


def binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")


def pairs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Folders of <id>.json and <id>.html: file_id, the JSON columns, html; a file without its partner has nulls."""
    meta = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(path).withColumn("file_id", stem(F.col("_metadata.file_path")))
    html = decoded(binary(spark, path, "*.html")).select(stem(F.col("path")).alias("file_id"), F.col("text").alias("html"), "fallback")
    return meta.join(html, "file_id", "full_outer")


@F.pandas_udf(StringType())
def _guess(content: pd.Series) -> pd.Series:
    from charset_normalizer import from_bytes

    def one(b):
        best = from_bytes(b).best()
        return str(best) if best is not None else b.decode("utf-8", "replace")

    return content.map(one, na_action="ignore")


def decoded(files: DataFrame) -> DataFrame:
    """Adds text and fallback: strict UTF-8 in the JVM; only files that are not UTF-8 go to a detector."""
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    good = files.where(ok).withColumns({"text": F.col("content").cast("string"), "fallback": F.lit(False)})
    bad = files.where(~ok).withColumns({"text": _guess("content"), "fallback": F.lit(True)})
    return good.unionByName(bad).drop("content")


@F.pandas_udf(BinaryType())
def gunzip(content: pd.Series) -> pd.Series:
    return content.map(gzip.decompress, na_action="ignore")


def untar(files: DataFrame, prefix: str = "") -> DataFrame:
    """name, content of the regular files below a prefix of tar (or tar.gz) files; members that leave the tree are errors."""

    def each(batches):
        import io
        import tarfile

        for pdf in batches:
            for content in pdf["content"]:
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.name.startswith("/") or ".." in m.name.split("/"):
                            raise ValueError(f"{m.name} leaves the archive")
                        if m.isfile() and m.name.startswith(prefix):
                            yield pd.DataFrame({"name": [m.name], "content": [tar.extractfile(m).read()]})

    return files.select("content").mapInPandas(each, "name string, content binary")


def checksums(files: DataFrame) -> DataFrame:
    return files.select(stem(F.col("path")).alias("name"), F.sha2("content", 256).alias("sha256"))


def manifest(sums: DataFrame, name: str = "name", sha: str = "sha256") -> DataFrame:
    """One checksum over the sorted lines 'sha256  name'."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.concat(F.col(sha), F.lit("  "), F.col(name)).alias("l"))))
    return sums.agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["l"]), "\n"), 256).alias("manifest"), F.count(F.lit(1)).alias("n"))


def pinned(files: DataFrame, expected: str) -> DataFrame:
    """The files, or an error if their manifest differs."""
    got = manifest(checksums(files)).first()["manifest"]
    if got != expected:
        raise ValueError(f"manifest {got}, expected {expected}")
    return files


def rewrite(df: DataFrame, path: str, gate=None) -> None:
    """Replaces a table after a gate has passed on what was written beside it; the input may be the table itself."""
    spark = df.sparkSession
    side, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    df.write.parquet(side)
    if gate:
        gate(spark.read.parquet(side))
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(jpath(path))
    if there and not fs.rename(jpath(path), jpath(old)):
        raise OSError(f"{path} cannot be moved")
    if not fs.rename(jpath(side), jpath(path)):
        raise OSError(f"{side} cannot be moved")
    if there:
        fs.delete(jpath(old), True)


def start_run(df: DataFrame, path: str) -> None:
    """A run's folder must not exist yet."""
    df.write.mode("errorifexists").json(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records below a folder, other files aside."""
    return spark.read.schema(RUN).option("pathGlobFilter", "run*.json").option("recursiveFileLookup", True).json(path)


def yaml_table(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """A small YAML list (specs, run records) as rows."""
    import json

    import yaml

    rows = yaml.safe_load(text)
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows if isinstance(rows, list) else [rows], default=str)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def environment(spark: SparkSession) -> dict[str, str]:
    """What stands beside a timing."""
    import os
    import platform

    return {"spark": spark.version, "python": platform.python_version(), "cpus": str(os.cpu_count()), "master": spark.sparkContext.master, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}
