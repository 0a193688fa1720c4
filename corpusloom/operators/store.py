"""Stored results as Parquet tables: insert if absent, lookups, newest first, totals, cascade delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, computed once: what uses it reads its rows instead of planning and computing it anew. Rows go to spark.checkpoint.dir if that is set, else to the executors' own storage."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.localCheckpoint()


#: Rows up to which a lexicon goes to every task.
LEXICON = 100_000


def lexicon(df: DataFrame) -> DataFrame:
    """df, computed once and, if it has at most LEXICON rows, sent to every task, so that what looks things up in it stays where it is; larger ones are shuffled."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= LEXICON else df


def with_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("file_hash", F.sha2(F.col(content).cast("binary"), 256))


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str = "file_hash", order: str = "created_at") -> DataFrame:
    """Rows of new to append: one for each key that existing lacks, the earliest."""
    fresh = new.join(existing.select(key).distinct(), key, "left_anti")
    return fresh.withColumn("_i", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("_i = 1").drop("_i")


def dedupe(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_i", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("_i = 1").drop("_i")


def newest(df: DataFrame, at: str, tie: str, limit: int, least: int = 1, most: int = 200) -> DataFrame:
    if not least <= limit <= most:
        raise ValueError(f"limit must be {least} to {most}")
    return df.orderBy(F.col(at).desc(), tie).limit(limit)


def totals(df: DataFrame, score: str) -> DataFrame:
    """One row: n, mean (one decimal), best; 0 without rows."""
    return df.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(score), F.lit(0.0)), 1).alias("mean"), F.coalesce(F.max(score), F.lit(0)).alias("best"))


def by_group(df: DataFrame, group: str, score: str, k: int = 10) -> DataFrame:
    """group, n, mean of the k largest groups, ties by name; null groups are left out."""
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(score), 1).alias("mean")).orderBy(F.col("n").desc(), group).limit(k)


def cascade_delete(parents: DataFrame, parent_id: str, children: DataFrame, foreign: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the rows of `gone` (column parent_id) and their children."""
    ids = gone.select(parent_id).distinct()
    return parents.join(ids, parent_id, "left_anti"), children.join(ids.withColumnRenamed(parent_id, foreign), foreign, "left_anti")


def orphans(children: DataFrame, foreign: str, parents: DataFrame, parent_id: str) -> DataFrame:
    return children.join(parents.select(F.col(parent_id).alias(foreign)).distinct(), foreign, "left_anti")


def ordinals(df: DataFrame, at: str, *by: str) -> DataFrame:
    """Number of each row within its group, oldest first."""
    return df.withColumn("ordinal", F.row_number().over(W.partitionBy(*by).orderBy(at)))


def lookup(df: DataFrame, key: str, *values) -> DataFrame:
    """Rows with one of the keys; the filter reaches the scan. Unknown keys give no rows."""
    return df.filter(F.col(key).isin(*values))


def with_payload(df: DataFrame, keep: list[str], payload: str = "payload") -> DataFrame:
    """The kept columns and one JSON string of all others; nulls are written, so a payload has every field."""
    rest = [c for c in df.columns if c not in keep]
    return df.select(*keep, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias(payload))


def read_payload(df: DataFrame, schema: str, payload: str = "payload") -> DataFrame:
    """The other columns and the payload's fields by the given schema; text that is no JSON gives nulls."""
    return df.withColumn("_p", F.from_json(payload, schema)).select(*(c for c in df.columns if c != payload), "_p.*")


def matches_to_store(matches: DataFrame, resume: str, title: str, score: str) -> DataFrame:
    """id (random), resume_id, job_title, score, created_at, payload (all columns as JSON): rows to append to the table of matches."""
    body = F.to_json(F.struct(*matches.columns), {"ignoreNullFields": "false"})
    return matches.select(F.replace(F.uuid(), F.lit("-"), F.lit("")).alias("id"), F.col(resume).alias("resume_id"), F.col(title).alias("job_title"), F.col(score).alias("score"), F.current_timestamp().alias("created_at"), body.alias("payload"))
