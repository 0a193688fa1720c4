"""The registered queries of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, langid, mixing, neardup, pii, quality, repeats, suffixtree


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int):
    """crc32(doc_id as text) mod n; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op4_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.filter(fold(5) != 0))
    return langid.predict(docs, model).select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = suffixtree.score(docs, docs.filter(fold(7) != 2))
    return out.select("doc_id", F.coalesce(fold(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), folds=3, held=1)
    return quality.score(docs, model).select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_neardup": op3_neardup,
    "op4_word_repeats": op4_word_repeats,
    "op5_language_id": op5_language_id,
    "op6_pii": op6_pii,
    "op7_suffix_tree": op7_suffix_tree,
    "op8_byte_repeats": op8_byte_repeats,
    "op9_ann": op9_ann,
    "op10_quality": op10_quality,
}

ORACLE = {
    "op1_mixing": r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
per2 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM per),
per3 AS (SELECT source, source_size, CASE k % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap, k FROM per2),
lev AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM per3)
    - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / ((SELECT sum(w) FROM per3) - coalesce(sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lv FROM per3),
goal AS (SELECT source, source_size, round(least(w * (SELECT max(lv) FROM lev), cap), 6) AS target FROM lev),
d AS (SELECT base.*, source_size, target, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target / CAST(source_size AS DOUBLE)) ELSE 0.0::DOUBLE END AS e
      FROM base JOIN goal ON base.source IS NOT DISTINCT FROM goal.source),
d2 AS (SELECT *, CAST(floor(e) AS BIGINT) AS whole, e - floor(e) AS p FROM d),
d3 AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q, target - sum(whole * size) OVER (PARTITION BY source) AS rest FROM d2),
d4 AS (SELECT *, CASE WHEN p > 0 AND sum(size) OVER (PARTITION BY source, p > 0 ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0 <= rest THEN 1 ELSE 0 END AS more FROM d3)
SELECT doc_id, size, source_size, target, CAST(size * (whole + more) AS BIGINT) AS taken FROM d4
""",
}
