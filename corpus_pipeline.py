"""From raw documents to token shards: language ID, near-duplicates, decontamination, mixing, token shards.

Each stage works on all that the one before it kept, written as Parquet in the shared folder and read again.  All but the
last return the columns of documents.  The result has one row per record of the shards that were written.

Defined cases: null and letterless texts go in the first stage.  Rows whose id is null are never near copies of others and
stay; a null source is a source of its own.  Of repeated rows one stays.  Extra columns travel along, whatever their names.
Empty tables give no rows.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bagminhash, decontaminate, langid, pfair, shards
from corpusloom.llm.common import shared_dir, table

#: Languages to keep; None: every learned one.
LANGUAGES = None
#: Trained profiles, hashed signatures and a permutation have no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language by the trained prototypes is none, or not one of LANGUAGES, go."""
    langs, prototypes = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.accept(docs, langs, prototypes, LANGUAGES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return bagminhash.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    return pfair.interleave(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the shards; one row per record."""
    return shards.materialise(docs, f"{shared_dir(spark)}/pipeline-shards-{uuid.uuid4().hex}")


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents below sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, f"pipeline-{k}")
    return docs
