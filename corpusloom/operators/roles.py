"""Category profiles, prediction from weighted profiles, keywords, confidence."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, SQLTransformer, StopWordsRemover, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYWORDS, MARGIN = 25, 0.08
TRAINED_FLOOR, TRAINED_MARGIN = 1.15, 0.20  # of the uniform share


def profiles(labelled: DataFrame, role: str, item: str, feature: str) -> DataFrame:
    """role, feature, weight: the share of the role's items that mention the feature (distinct per item)."""
    n = labelled.groupBy(role).agg(F.count_distinct(item).alias("_n"))
    got = labelled.filter(F.col(feature).isNotNull()).groupBy(role, feature).agg(F.count_distinct(item).alias("_k"))
    return got.join(n, role).select(role, feature, (F.col("_k") / F.col("_n")).alias("weight"))


def spread(prof: DataFrame, role: str, feature: str) -> DataFrame:
    """feature, spread: the number of roles that mention it."""
    return prof.groupBy(feature).agg(F.count_distinct(role).alias("spread"))


def keywords(prof: DataFrame, role: str, feature: str, k: int = KEYWORDS) -> DataFrame:
    """role, feature, score, rank: weight * ln(1 + roles / spread), the k highest of each role."""
    n = prof.agg(F.count_distinct(role).alias("_r"))
    scored = prof.join(spread(prof, role, feature), feature).crossJoin(F.broadcast(n))  # one row
    scored = scored.withColumn("score", F.col("weight") * F.log(1 + F.col("_r") / F.col("spread")))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(role).orderBy(F.round(F.col("score"), 9).desc(), feature))).filter(F.col("rank") <= k).select(role, feature, "score", "rank")


def predict(has: DataFrame, doc: str, prof: DataFrame, role: str, feature: str) -> DataFrame:
    """doc, role, score, rank, margin (to the next), summary: covered over total weight of every role that shares a feature with the document."""
    total = prof.groupBy(role).agg(F.sum("weight").alias("_t"))
    got = has.select(doc, feature).distinct().join(prof, feature).groupBy(doc, role).agg(F.sum("weight").alias("_c")).join(total, role)
    got = got.withColumn("score", F.col("_c") / F.col("_t"))
    w = W.partitionBy(doc).orderBy(F.round(F.col("score"), 9).desc(), role)
    return got.select(doc, role, "score", F.row_number().over(w).alias("rank"), (F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0))).alias("margin"))


def top_with_alternatives(ranked: DataFrame, doc: str, role: str, k: int = 3) -> DataFrame:
    """doc, role, confidence, confident, alternatives (the next k), summary."""
    alt = F.array_sort(F.collect_list(F.when(F.col("rank").between(2, k + 1), F.struct("rank", F.col(role).alias("role"), "score"))))
    one = ranked.filter(F.col("rank") <= k + 1).groupBy(doc).agg(F.max(F.when(F.col("rank") == 1, F.col(role))).alias("role"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("confidence"), F.max(F.when(F.col("rank") == 1, F.col("margin"))).alias("margin"), alt.alias("alternatives"))
    return one.withColumn("confident", F.col("margin") >= MARGIN).withColumn("summary", summary(F.col("role"), F.col("confident"), F.try_element_at("alternatives", F.lit(1))["role"]))


def summary(role: Column, confident: Column, runner_up: Column) -> Column:
    return F.when(role.isNull(), "No role could be predicted.").when(confident | runner_up.isNull(), F.concat(F.lit("Reads as "), role, F.lit("."))).otherwise(F.concat(F.lit("Between "), role, F.lit(" and "), runner_up, F.lit(".")))


def softmax(values: Column) -> Column:
    """Of an array of margins."""
    top = F.array_max(values)
    e = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda v: v / total)


class SublinearTf(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """1 + ln(count) for every count of a sparse vector."""

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in (("inputCol", inputCol), ("outputCol", outputCol)) if v})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        @F.udf(VectorUDT())
        def log_counts(v):
            return Vectors.sparse(v.size, v.indices, 1 + np.log(v.values))

        return dataset.withColumn(self.getOutputCol(), log_counts(self.getInputCol()))


def train_classifier(docs: DataFrame, text_col: str = "text", label_col: str = "label", min_df: int = 1, vocabulary: int = 1 << 22) -> PipelineModel:
    """Spark ML pipeline: tokens without stop words, one- and two-grams, 1 + ln(tf), idf, unit length, one-vs-rest linear SVM on balanced class weights.

    Like a batch trainer in kind, not in digits. vocabulary bounds the grams held (the most frequent stay). Rows without a label are left out.
    """
    known = docs.filter(F.col(label_col).isNotNull())
    sizes = known.groupBy(label_col).agg(F.count("*").alias("_c"))  # a row a label
    all_ = sizes.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    weights = sizes.crossJoin(F.broadcast(all_)).select(label_col, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("_balance"))
    stages = [
        StringIndexer(inputCol=label_col, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip"),
        SQLTransformer(statement=f"SELECT *, regexp_extract_all(lower(coalesce({text_col}, '')), '[a-z][a-z0-9+#.-]*', 0) AS _tok FROM __THIS__"),
        StopWordsRemover(inputCol="_tok", outputCol="_one"),
        NGram(n=2, inputCol="_one", outputCol="_two"),
        SQLTransformer(statement="SELECT *, concat(_one, _two) AS _grams FROM __THIS__"),
        CountVectorizer(inputCol="_grams", outputCol="_tf", minDF=min_df, vocabSize=vocabulary),
        SublinearTf(inputCol="_tf", outputCol="_log"),
        IDF(inputCol="_log", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_x"),
        OneVsRest(classifier=LinearSVC(maxIter=50, regParam=0.01), labelCol="_label", featuresCol="_x", predictionCol="_pred", weightCol="_balance"),
    ]
    return Pipeline(stages=stages).fit(known.join(weights, label_col))


def predict_trained(model: PipelineModel, docs: DataFrame, doc: str, text_col: str = "text") -> DataFrame:
    """doc, role, score, rank, margin, n_labels: the softmax of the margins of every label."""
    labels = model.stages[0].labels
    shares = softmax(vector_to_array("rawPrediction"))
    got = PipelineModel(stages=model.stages[1:]).transform(docs.select(doc, text_col)).select(doc, F.explode(F.arrays_zip(F.array(*map(F.lit, labels)).alias("role"), shares.alias("score"))).alias("z")).select(doc, "z.role", "z.score")
    w = W.partitionBy(doc).orderBy(F.round(F.col("score"), 9).desc(), "role")
    return got.select(doc, "role", "score", F.row_number().over(w).alias("rank"), (F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0))).alias("margin"), F.lit(len(labels)).alias("n_labels"))


def predict_either(trained: DataFrame, by_profile: DataFrame, doc: str, role: str = "role") -> DataFrame:
    """doc, role, confidence, confident, alternatives, summary, backend: the trained prediction where it says something (FLOOR times the uniform share or more), else the profiles'.

    Both come ranked (predict_trained, predict). A trained prediction is confident with a margin of a fifth of the uniform share.
    """
    even = trained.groupBy(doc).agg((1.0 / F.max("n_labels")).alias("_u"), F.max("score").alias("_s")).filter(F.col("_s") >= F.col("_u") * TRAINED_FLOOR)
    a = top_with_alternatives(trained.join(even.select(doc), doc, "left_semi"), doc, role).join(even.select(doc, "_u"), doc)
    a = a.withColumn("confident", F.col("margin") >= F.col("_u") * TRAINED_MARGIN).drop("_u").withColumn("backend", F.lit("trained"))
    a = a.withColumn("summary", summary(F.col("role"), F.col("confident"), F.try_element_at("alternatives", F.lit(1))["role"]))
    b = top_with_alternatives(by_profile.join(even.select(doc), doc, "left_anti"), doc, role).withColumn("backend", F.lit("profile"))
    return a.unionByName(b)


def save_classifier(spark: SparkSession, model: PipelineModel, path: str, score: float, force: bool = False) -> None:
    """Writes the model and its held-out score; a stored model with a better score is replaced only by force."""
    try:
        stored = spark.read.parquet(f"{path}/score").first()["score"]
    except AnalysisException:
        stored = None
    if stored is not None and score < stored and not force:
        raise ValueError(f"the stored model scores {stored}, more than {score}")
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(float(score),)], "score double").write.mode("overwrite").parquet(f"{path}/score")


def load_classifier(spark: SparkSession, path: str) -> PipelineModel | None:
    """The stored model; None if there is none, so that callers go by profiles."""
    try:
        spark.read.parquet(f"{path}/score")
    except AnalysisException:
        return None
    return PipelineModel.load(f"{path}/model")


def leave_one_out(labelled: DataFrame, doc: str, role: str, feature: str) -> DataFrame:
    """doc, role, predicted, correct: each item predicted from profiles without it. Relational: its own counts are taken off, no refits.

    A role whose only item is the one left out can't be predicted, so that fold is wrong.
    """
    flat = labelled.filter(F.col(feature).isNotNull()).select(doc, role, feature).distinct()
    n = labelled.groupBy(role).agg(F.count_distinct(doc).alias("n"))
    k = flat.groupBy(role, feature).agg(F.count("*").alias("k"))
    total = k.groupBy(role).agg(F.sum("k").alias("t"))
    mine = flat.groupBy(doc).agg(F.count("*").alias("m"))
    own = flat.select(doc, F.col(role).alias("_own")).distinct()
    got = flat.select(doc, feature).join(k, feature).join(own, doc).withColumn("_c", F.col("k") - (F.col(role) == F.col("_own")).cast("int"))
    got = got.groupBy(doc, "_own", role).agg(F.sum("_c").alias("c")).join(total, role).join(n, role).join(mine, doc)
    left = F.col("t") - F.when(F.col(role) == F.col("_own"), F.col("m")).otherwise(0)
    got = got.filter((F.col("n") > 1) | (F.col(role) != F.col("_own"))).withColumn("s", F.coalesce(F.try_divide(F.col("c"), left), F.lit(0.0)))
    best = got.withColumn("_i", F.row_number().over(W.partitionBy(doc).orderBy(F.round(F.col("s"), 9).desc(), role))).filter("_i = 1").select(doc, F.col(role).alias("predicted"))
    all_ = labelled.select(doc, role).distinct()
    return all_.join(best, doc, "left").withColumn("correct", F.coalesce(F.col("predicted") == F.col(role), F.lit(False)))
