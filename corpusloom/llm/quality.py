"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded_batches
from .tokens import CODES_LOWER, chunks, mix, prefix, span, words

#: Bounds of the samples on which the classifier is fitted (rows of the smallest hash of doc_id).
MAX_POSITIVE = 12_000
MAX_UNLABELLED = 24_000
#: Features of a text's form, and buckets into which its lower-cased words and pairs of neighbouring words are hashed.
FORM, LEXICAL = 22, 64
N_FEATURES = FORM + LEXICAL
#: Weight decay of the lexical features.
DECAY = 0.1
_CLASS = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 space, 5 newline, 6 . or , 7 ! or ?, 8 symbols, 9 bars and brackets, 10 other ASCII, 0 high bytes
_CLASS[:128] = 10
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[32, 9, 13]], _CLASS[10] = 4, 5
_CLASS[[46, 44]], _CLASS[[33, 63]] = 6, 7
_CLASS[[ord(c) for c in "#$%&*^~@="]] = 8
_CLASS[[ord(c) for c in "|<>[]{}\\_/"]] = 9
_CLASS[128:] = 0


def features(column: pa.Array) -> np.ndarray:
    """One row of N_FEATURES per text, from all of its bytes: its form (shares of kinds of characters, lengths, repetition), and which words and word pairs it uses, by bucket.

    Shares are square roots, so small ones count; an empty text has zeros.
    """
    out = [np.zeros((0, N_FEATURES), np.float32)]
    for c in chunks(column):
        out.append(_chunk(c))
    return np.concatenate(out)


def _chunk(c) -> np.ndarray:
    n, buf = c.n, c.buf
    kind = _CLASS[buf]
    doc = np.repeat(np.arange(n), np.diff(c.offs))
    by = np.bincount(doc * 11 + kind, minlength=n * 11).reshape(n, 11).astype(np.float64)
    total = np.maximum(by.sum(1), 1)
    start, end, bound, h = words(c, CODES_LOWER)
    nw = np.diff(bound)
    wdoc = np.repeat(np.arange(n), nw)
    many = np.maximum(nw, 1)
    length = end - start
    per = lambda x: np.bincount(wdoc, x, minlength=n)
    mean_len = per(length) / many
    var_len = np.maximum(per(length.astype(float) ** 2) / many - mean_len**2, 0)
    caps = np.concatenate([[0], np.cumsum(kind == 2)])
    low = np.concatenate([[0], np.cumsum(kind == 1)])
    shout = (low[end] - low[start] == 0) & (caps[end] - caps[start] > 0) & (length > 1)
    odd_end = np.isin(kind[end - 1], (7, 8, 9)) if len(end) else np.zeros(0, bool)
    single = length == 1
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])
    order = np.lexsort((h, wdoc))
    first = np.ones(len(h), bool)
    if len(h):
        a, b = h[order], wdoc[order]
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    distinct = np.bincount(wdoc[order][first], minlength=n) if len(h) else np.zeros(n)
    # lines: a document's last line has no newline
    nl = np.flatnonzero(kind == 5)
    ls = np.unique(np.concatenate([c.offs[:-1][np.diff(c.offs) > 0], nl + 1]))
    ls = ls[ls < len(buf)]
    le = np.append(ls[1:], len(buf))[: len(ls)]
    ldoc = doc[ls] if len(ls) else np.zeros(0, np.int64)
    lh = span(prefix(buf.astype(np.uint64) + np.uint64(1)), ls, le) if len(ls) else np.zeros(0, np.uint64)
    lorder = np.lexsort((lh, ldoc))
    lfirst = np.ones(len(ls), bool)
    if len(ls):
        a, b = lh[lorder], ldoc[lorder]
        lfirst[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    lines = np.maximum(np.bincount(ldoc, minlength=n), 1)
    ldistinct = np.bincount(ldoc[lorder][lfirst], minlength=n) if len(ls) else np.zeros(n)
    share = lambda x, d: np.sqrt(np.clip(x / d, 0, 1))
    cols = [
        np.log1p(by.sum(1)) / 10,
        *(share(by[:, k], total) for k in (0, 2, 3, 4, 5, 6, 7, 8, 9, 10)),
        np.minimum(mean_len, 40) / 10,
        np.minimum(np.sqrt(var_len), 40) / 10,
        share(per(shout), many),
        share(per(odd_end), many),
        share(per(single), many),
        share(per(same), many),
        np.where(nw > 0, 1 - distinct / many, 0),
        np.where(nw > 0, distinct / many**0.9, 0) / 2,
        np.where(lines > 1, 1 - ldistinct / lines, 0),
        np.log1p(nw) / 10,
        (nw > 0).astype(float),
    ]
    used = mix(h)
    beside = np.flatnonzero(wdoc[1:] == wdoc[:-1]) if len(h) else np.zeros(0, np.int64)
    pairs = mix(h[beside] * np.uint64(3) + h[beside + 1])
    place = np.concatenate([wdoc * LEXICAL + (used % np.uint64(LEXICAL)).astype(np.int64), wdoc[beside] * LEXICAL + (pairs % np.uint64(LEXICAL)).astype(np.int64)])
    sign = 1.0 - 2.0 * (np.concatenate([used, pairs]) >> np.uint64(63)).astype(np.float64)  # collisions of two words cancel rather than add up
    lex = np.bincount(place, sign, minlength=n * LEXICAL).reshape(n, LEXICAL) / many[:, None]
    lex = np.sign(lex) * np.sqrt(np.abs(lex))
    return np.concatenate([np.stack(cols, 1), lex], 1).astype(np.float32)


class Model:
    """One hidden layer over standardised features; plain arrays, a few kilobytes whatever the corpus."""

    def __init__(self, mean, scale, w1, b1, w2, b2, shift=0.0):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.shift = mean, scale, w1, b1, w2, b2, shift

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2 + self.shift

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, rounds: int = 400, hidden: int = 12, seed: int = 7) -> Model:
    """Minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) of the logistic loss by Adam, in full batches.

    Where the negative part falls below 0, the step goes up that part's gradient instead (the non-negative correction).
    """
    rng = np.random.default_rng(seed)
    d = unl.shape[1]
    mean, scale = unl.mean(0), unl.std(0) + 1e-3
    m = Model(mean, scale, rng.normal(0, 0.4, (d, hidden)), np.zeros(hidden), rng.normal(0, 0.4, hidden), 0.0)
    decay = np.where(np.arange(d) < FORM, 1e-4, DECAY)[:, None]  # what single words say has to pay for itself
    m.w1[FORM:] = 0
    z = np.clip((np.concatenate([pos, unl]) - mean) / scale, -8, 8).astype(np.float32)
    n, k = len(pos), len(unl)
    params = [m.w1, m.b1, m.w2, np.zeros(1)]
    mom, vel = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        hid = np.tanh(z @ params[0].astype(np.float32) + params[1].astype(np.float32)).astype(np.float64)
        s = hid @ params[2] + params[3][0]
        sig = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        down = np.logaddexp(0, s)  # loss of calling it negative
        negative = down[n:].mean() - prior * down[:n].mean()
        g = np.zeros(n + k)
        if negative >= 0:
            g[:n] = prior * (sig[:n] - 1) / n - prior * sig[:n] / n
            g[n:] = sig[n:] / k
        else:
            g[:n] = prior * sig[:n] / n
            g[n:] = -sig[n:] / k
        back = np.outer(g, params[2]) * (1 - hid**2)
        grads = [(z.T @ back.astype(np.float32)).astype(np.float64) + decay * params[0], back.sum(0), hid.T @ g + 1e-4 * params[2], np.array([g.sum()])]
        for p, gr, a, v in zip(params, grads, mom, vel, strict=True):
            a += 0.1 * (gr - a)
            v += 0.001 * (gr * gr - v)
            p -= 0.02 * (a / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    m.w1, m.b1, m.w2, m.b2 = params[0], params[1], params[2], float(params[3][0])
    return m


def class_prior(pos_score: np.ndarray, unl_score: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of upper tails, P_u(s >= t) / P_p(s >= t).

    Any region holds prior * P_p of the unlabelled mass at least, so every ratio bounds the prior from above, and the
    bound is tight where the region holds no negatives. Ratios are averaged over runs of ten thresholds before the least is
    taken, so that no single lucky threshold decides. Scores must come from a model that was not fitted on the same rows.
    """
    at = np.quantile(pos_score, np.linspace(0.0, 0.7, 36))
    ratio = np.array([(unl_score >= t).mean() / max((pos_score >= t).mean(), 1e-9) for t in at])
    run = np.convolve(ratio, np.ones(10) / 10, "valid")
    return float(np.clip(run.min(), 0.01, 0.99))


def cross_fitted_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Mean of class_prior() over two halves, each scored by a model of the other, less one standard error.

    The first pass takes 0.5 for the prior it doesn't know; the second fits with 0.95 of the first's bound, near the truth and on its safe side, where
    the model keeps negatives out of the upper region, so that the bound gets tight.
    """
    if min(len(pos), len(unl)) < 2:
        return class_prior(np.ones(1), np.ones(1))
    prior = 0.5
    for _ in range(2):
        got = []
        for k in (0, 1):
            m = fit_nnpu(pos[1 - k :: 2], unl[1 - k :: 2], prior, rounds=250)
            got.append(class_prior(m.score(pos[k::2]), m.score(unl[k::2])))
        bound = float(np.mean(got))
        prior = 0.95 * bound
    return float(np.clip(bound - np.sqrt(bound * (1 - bound) / len(unl)), 0.01, 0.99))


def sample(docs: DataFrame, labels: DataFrame, folds: int, held: int) -> DataFrame:
    """_id (doc_id as string), _p: 1 for the positives to fit on, 0 for the unlabelled; MAX_POSITIVE + MAX_UNLABELLED rows at most, none twice."""
    fold = F.crc32(F.col("_id").cast("binary")) % folds
    ids = lambda d: d.select(F.col("doc_id").cast("string").alias("_id")).filter(F.col("_id").isNotNull()).filter(fold != held).distinct()
    p = ids(labels.filter("quality = 1")).orderBy(F.xxhash64("_id"), "_id").limit(MAX_POSITIVE)
    u = ids(docs).orderBy(F.xxhash64(F.concat(F.lit("u"), F.col("_id"))), "_id").limit(MAX_UNLABELLED)
    return p.withColumn("_p", F.lit(1)).unionByName(u.withColumn("_p", F.lit(0)))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> Model | None:
    """Fits on documents outside the held-out fold: trusted positives (quality = 1) against unlabelled text (all documents, labels unread).

    Samples hold at most MAX_POSITIVE and MAX_UNLABELLED ids, those of the smallest hash; an id on several rows counts once, with the row of the least features. None
    without positives or without documents. Labels without doc_id and documents without one teach nothing; texts that are null read as empty.
    """
    bounded_batches(docs.sparkSession)
    ids = sample(docs, labels, folds, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text")).astype(np.float16)
            yield pa.record_batch([b.column("_id"), b.column("_p"), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "p", "x"])

    read = docs.select(F.col("doc_id").cast("string").alias("_id"), F.col("text").cast("string").alias("text"))
    rows = read.join(F.broadcast(ids), "_id").mapInArrow(run, "id string, p int, x binary")
    got = rows.groupBy("id", "p").agg(F.min("x").alias("x")).toPandas()  # a row for each id and kind
    if not len(got) or not (got.p == 1).any():
        return None
    x = np.frombuffer(b"".join(got.x), np.float16).reshape(len(got), N_FEATURES).astype(np.float32)
    order = np.lexsort((*x.T, got.p))  # the same order whatever the partitions, so that reruns agree
    x, y = x[order].astype(np.float64), got.p.to_numpy()[order]
    pos, unl = x[y == 1], x[y == 0]
    if not len(unl):
        return None
    return fit_nnpu(pos, unl, cross_fitted_prior(pos, unl))


def score(docs: DataFrame, model: Model | None, keep: bool = False) -> DataFrame:
    """doc_id, score, predicted (with keep: all columns of docs, then _score and _predicted).

    Every whole text is scored, null as an empty one; a repeated row gives its row again, equal texts have equal scores, an empty table gives no rows. Without keep,
    columns other than doc_id and text are not read. Without a model (no labelled positives) each score is 0.5 and
    predicted 1, so nothing is rejected unlearnt.
    """

    def values(b: pa.RecordBatch) -> list[pa.Array]:
        s = model.score(features(b.column("text"))) if model else np.full(b.num_rows, 0.5)
        return [pa.array(s.astype(np.float64)), pa.array((s >= 0.5).astype(np.int32))]

    if keep:
        from pyspark.sql.types import DoubleType, IntegerType, StructType

        schema = StructType([*docs.schema.fields]).add("_score", DoubleType()).add("_predicted", IntegerType())

        def run(batches):
            for b in batches:
                yield pa.record_batch([*b.columns, *values(b)], names=[*b.schema.names, "_score", "_predicted"])

        return docs.mapInArrow(run, schema)

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), *values(b)], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
