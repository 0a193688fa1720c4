"""Pipeline over documents: quality, near duplicates, benchmark leaks, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but the last return
the columns of documents; the last adds size, source_size, target, copies and taken, and leaves out documents of which the mix takes no copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, mixing, neardup, pii, quality
from corpusloom.llm.scratch import materialise, shielded


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return shielded(docs, lambda d: quality.score(d, model, keep=True).filter("_predicted = 1").select(*d.columns))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class, its document of the least doc_id."""
    return neardup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it replaced by their kinds."""
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies. Each row is decided for itself; columns of docs named like one of those added give way to it."""
    return mixing.mix(docs, keep=True).filter("copies > 0")


STAGES = [
    ("quality_classifier", keep_good),
    ("minhash_neardup", keep_one_copy),
    ("benchmark_decontamination", drop_leaks),
    ("pii", hide_private),
    ("source_mixing", mix_sources),
]

#: The first stages train models and cluster, which SQL can't express; tests/llm hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
