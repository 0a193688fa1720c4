"""Term statistics, BM25, sparse and dense similarity, retrieve-then-rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T

K1, B = 1.5, 0.75


def term_frequency(docs: DataFrame, id_col: str, text_col: str = "text", content: bool = True) -> DataFrame:
    """id, term, tf."""
    toks = T.content_tokens(text_col) if content else T.tokens(text_col)
    return docs.select(id_col, F.explode(toks).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """term, df."""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, text_col: str = "text", content: bool = True) -> DataFrame:
    """One row: n_docs, avgdl; both 1 at least."""
    size = F.size(T.content_tokens(text_col) if content else T.tokens(text_col))
    return docs.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_docs"), F.greatest(F.coalesce(F.avg(size), F.lit(1.0)), F.lit(1.0)).alias("avgdl"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25(docs: DataFrame, doc_id: str, queries: DataFrame, query_id: str, text_col: str = "text", candidates: Column | None = None, content: bool = True) -> DataFrame:
    """query_id, doc_id, bm25 (positive scores only).

    Statistics come from all of docs; `candidates` filters the ranked side alone, so a filter never moves idf. Terms that no query has are
    dropped before the frequencies are aggregated (a semi join), so the shuffle carries query terms only; lengths come with the document row.
    """
    toks = T.content_tokens(text_col) if content else T.tokens(text_col)
    qtf = term_frequency(queries, query_id, text_col, content).withColumnRenamed("tf", "qtf")
    wanted = qtf.select("term").distinct()
    base = docs.select(doc_id, toks.alias("_t"), (candidates if candidates is not None else F.lit(True)).alias("_ok"))
    stats = base.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_docs"), F.greatest(F.coalesce(F.avg(F.size("_t")), F.lit(1.0)), F.lit(1.0)).alias("avgdl"))
    tf = base.select(doc_id, "_ok", F.size("_t").alias("dl"), F.explode("_t").alias("term")).join(wanted, "term", "left_semi").groupBy(doc_id, "term", "dl", "_ok").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    part = tf.filter("_ok").join(df, "term").join(qtf, "term").crossJoin(F.broadcast(stats))  # stats is one row
    weight = F.col("qtf") * idf(F.col("n_docs"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return part.groupBy(query_id, doc_id).agg(F.sum(weight).alias("bm25")).filter("bm25 > 0")


def top_k(scored: DataFrame, by: str, k: int, *order: Column | str) -> DataFrame:
    """The first k rows of each `by`, with their rank. Spark prunes each task to k rows a group before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def sublinear(tf: Column) -> Column:
    return 1 + F.log(tf)


def lexical_cosine(a: DataFrame, a_id: str, b: DataFrame, b_id: str, text_col: str = "text", pairs: DataFrame | None = None) -> DataFrame:
    """a_id, b_id, lexical: cosine of 1 + ln(tf) with the two-text idf: 1 for a shared term, ln(1.5) + 1 for any other.

    Only pairs that share a term are returned (all others are 0). A norm follows from the sums over all and over shared terms. With pairs (a_id, b_id) only
    those are compared: their terms meet by pair and term, so no term that many texts share is a key of its own.
    """
    lone = F.log(F.lit(1.5)) + 1
    ta = term_frequency(a, a_id, text_col).select(a_id, "term", sublinear(F.col("tf")).alias("wa"))
    tb = term_frequency(b, b_id, text_col).select(b_id, "term", sublinear(F.col("tf")).alias("wb"))
    na = ta.groupBy(a_id).agg(F.sum(F.col("wa") ** 2).alias("na"))
    nb = tb.groupBy(b_id).agg(F.sum(F.col("wb") ** 2).alias("nb"))
    met = ta.join(tb, "term") if pairs is None else pairs.select(a_id, b_id).distinct().join(ta, a_id).join(tb, [b_id, "term"])
    both = met.groupBy(a_id, b_id).agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"), F.sum(F.col("wa") ** 2).alias("sa"), F.sum(F.col("wb") ** 2).alias("sb"))
    full = both.join(na, a_id).join(nb, b_id)
    norm = lambda n, s: F.sqrt(F.col(s) + lone * lone * (F.col(n) - F.col(s)))
    return full.select(a_id, b_id, T.clamp(F.col("dot") / (norm("na", "sa") * norm("nb", "sb"))).alias("lexical"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit_cosine(a: Column, b: Column) -> Column:
    """Cosine of unit vectors within 0 and 1; vectors of different lengths raise an error."""
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(T.clamp(dot(a, b)))


def cosine(a: Column, b: Column) -> Column:
    norm = lambda v: F.sqrt(dot(v, v))
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


#: Rows and queries whose cosines a task holds at a time (32 MB).
ROWS_AT_ONCE, QUERIES_AT_ONCE = 4096, 1024
#: Cosines are handed on down to this much below the k-th best, so that those that tie after rounding to six places are all there.
MARGIN = 2e-6


def _by_length(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (places, matrix) of the vectors without nulls."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    n = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    value, null = flat.to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(np.maximum(n, 0))])[:-1]
    out = {}
    for d in np.unique(n[n > 0]):
        at = np.flatnonzero(n == d)
        cell = start[at][:, None] + np.arange(d)
        whole = ~null[cell].any(axis=1)
        out[int(d)] = (at[whole], value[cell[whole]])
    return out


def _cosines(queries: DataFrame, query_id: str, query_vec: str, rows: DataFrame, row_id: str, row_vec: str, k: int, schema: str, pick) -> DataFrame:
    """What pick(cosines, other, floor) takes (query places, row places) of the cosines of every query with every row, by blocks of matrix products.

    queries are a stated set (the caller bounds it): their vectors go to every task. Rows stay where they are.
    """
    got = queries.filter(F.col(query_id).isNotNull()).select(query_id, F.col(query_vec).cast("array<double>").alias("_v")).toArrow().combine_chunks()
    batch = got.to_batches()[0] if got.num_rows else None
    sent = queries.sparkSession.sparkContext.broadcast((batch.column(0).to_numpy(zero_copy_only=False), _by_length(batch.column(1))) if batch is not None else (np.zeros(0), {}))
    q_type = got.schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sides = sent.value
        floor = np.full(len(ids), -np.inf)  # the task's k-th best so far
        with np.errstate(all="ignore"):
            for b in batches:
                for at in range(0, b.num_rows, ROWS_AT_ONCE):
                    part = b.slice(at, ROWS_AT_ONCE)
                    own, vectors = part.column(0).to_numpy(zero_copy_only=False), _by_length(part.column(1))
                    for lo in range(0, len(ids), QUERIES_AT_ONCE):
                        hi = min(lo + QUERIES_AT_ONCE, len(ids))
                        cos = np.zeros((hi - lo, part.num_rows))  # 0 with null and zero vectors and those of another length
                        for d, (place, r) in vectors.items():
                            if d not in sides:
                                continue
                            here, q = sides[d]
                            some = (here >= lo) & (here < hi)
                            over = np.sqrt((q[some] ** 2).sum(axis=1))[:, None] * np.sqrt((r**2).sum(axis=1))
                            cos[np.ix_(here[some] - lo, place)] = np.where(over == 0, 0.0, q[some] @ r.T / over)
                        i, j = pick(cos, ids[lo:hi, None] != own[None, :], floor[lo:hi], k)
                        yield pa.record_batch([pa.array(ids[lo:hi][i], q_type), part.column(0).take(pa.array(j)), pa.array(cos[i, j])], names=["query_id", "row_id", "cosine"])

    return rows.filter(F.col(row_id).isNotNull()).select(row_id, F.col(row_vec).cast("array<double>").alias("_v")).mapInArrow(run, schema)


def _pick_top(cos: np.ndarray, other: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best of each row and those within MARGIN of them; NaN ranks first, as in Spark. Raises floor."""
    key = np.where(other, np.where(np.isnan(cos), np.inf, cos), -np.inf)
    if key.shape[1] >= k:
        np.maximum(floor, np.partition(key, key.shape[1] - k, axis=1)[:, key.shape[1] - k], out=floor)
    return np.nonzero(other & (key >= floor[:, None] - MARGIN))


def nearest(queries: DataFrame, query_id: str, query_vec: str, rows: DataFrame, row_id: str, row_vec: str, k: int) -> DataFrame:
    """query_id, row_id, cosine: the rows that may be among a query's k nearest by cosine rounded to six places, ties included, other than itself (same id);
    top_k() settles which are. Everything is compared."""
    types = queries.schema[query_id].dataType.simpleString(), rows.schema[row_id].dataType.simpleString()
    return _cosines(queries, query_id, query_vec, rows, row_id, row_vec, k, f"query_id {types[0]}, row_id {types[1]}, cosine double", _pick_top)


def max_pool_mean(pairs: DataFrame, target: str, piece: str, sim: str = "cosine") -> DataFrame:
    """target, pooled: the best similarity for each piece of the target, averaged and clamped."""
    best = pairs.groupBy(target, piece).agg(F.max(sim).alias("_m"))
    return best.groupBy(target).agg(T.clamp(F.avg("_m")).alias("pooled"))


def rerank(pool: DataFrame, query: str, sem: str = "semantic", retrieval: str = "bm25", w_sem: float = 0.6, w_ret: float = 0.4) -> DataFrame:
    """pool with score: 0 to 100 of w_sem * semantic + w_ret * bm25 / the pool's best bm25 (0 if that is 0)."""
    top = F.max(retrieval).over(W.partitionBy(query))
    return pool.withColumn("score", T.pct(w_sem * F.col(sem) + w_ret * F.coalesce(F.try_divide(F.col(retrieval), top), F.lit(0.0))))


def recommend(resumes: DataFrame, jobs: DataFrame, embed, limit: int = 10, pool: int = 200, location: str | None = None, category: str | None = None, max_experience: float | None = None) -> DataFrame:
    """resume_id, job_id, score, bm25, semantic, rank. BM25 picks `pool` postings of those that pass the filters, cosine and BM25 blend, the integer score ranks.

    resumes: resume_id, text, skills array; jobs: job_id, title, description, requirements, location, category, experience_years, ord. embed: text Column -> vector
    Column. An empty location or category filters nothing; max_experience 0 does. Where no posting has a positive BM25, the first `pool` allowed ones by ord stand in, with 0.
    """
    if not 1 <= limit <= 50:
        raise ValueError("limit must be 1 to 50")
    ok = F.lit(True)
    if location:
        ok = ok & (F.lower("location") == location.lower())
    if category:
        ok = ok & (F.lower("category") == category.lower())
    if max_experience is not None:
        ok = ok & (F.col("experience_years") <= max_experience)
    text = jobs.withColumn("text", F.concat_ws("\n", "title", "title", "description", "requirements"))
    boosted = resumes.withColumn("text", F.concat_ws("\n", F.array_join(F.flatten(F.array_repeat(F.coalesce("skills", F.array().cast("array<string>")), 3)), " "), "text"))
    got = bm25(text, "job_id", boosted, "resume_id", candidates=ok).withColumn("bm25", F.round("bm25", 9))  # equal texts tie, whatever the order of summing
    first = top_k(got.filter("bm25 > 0"), "resume_id", pool, F.col("bm25").desc(), "job_id").drop("rank")
    some = text.filter(ok).orderBy("ord").limit(pool).agg(F.collect_list("job_id").alias("_j"))  # one row of `pool` ids at most
    bare = resumes.select("resume_id").join(first.select("resume_id").distinct(), "resume_id", "left_anti")
    stand_in = bare.crossJoin(F.broadcast(some)).select("resume_id", F.explode("_j").alias("job_id"), F.lit(0.0).alias("bm25"))
    first = first.select("resume_id", "job_id", "bm25").unionByName(stand_in)
    pooled = text.join(first.select("job_id").distinct(), "job_id", "left_semi")  # only postings of a pool are embedded
    vec = first.join(resumes.select("resume_id", embed(F.col("text")).alias("_rv")), "resume_id").join(pooled.select("job_id", "ord", embed(F.col("text")).alias("_jv")), "job_id")
    scored = rerank(vec.withColumn("semantic", unit_cosine(F.col("_rv"), F.col("_jv"))), "resume_id")
    return top_k(scored, "resume_id", limit, F.col("score").desc(), F.col("bm25").desc(), "ord").select("resume_id", "job_id", "score", "bm25", "semantic", "rank")
