"""Approximate nearest neighbours by learned partitions: a balanced partition of a neighbour graph, and a small classifier that routes to it."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import materialise, skew_join

#: Rows on which a router is fitted (those of the smallest hash), the most partitions that one deals to, and rows for each partition.
SAMPLE, PARTS, PART_ROWS = 4096, 32, 250
#: Recall that the number of probes is set for, on sample rows held out of the classifier's training.
GOAL = 0.95
CAND_CELL, QUERY_CELL = 20_000, 1_000


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>): rows whose vector is neither null, empty nor zero and has only finite components."""
    v = F.col("embedding").cast("array<double>")
    df = vectors.filter("vec_id is not null and embedding is not null").select("vec_id", v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(~F.coalesce(bad, F.lit(False))).filter(F.exists("v", lambda x: x != 0.0))


def knn(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest other rows, by brute force in blocks."""
    n = len(x)
    k = min(k, n - 1)
    sq = (x * x).sum(1)
    out = np.empty((n, k), np.int64)
    for lo in range(0, n, 512):
        d = sq[None, :] - 2 * x[lo : lo + 512] @ x.T
        d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
        out[lo : lo + 512] = np.argpartition(d, k - 1, 1)[:, :k]
    return out


def partition(x: np.ndarray, near: np.ndarray, parts: int, slack: float = 0.08, sweeps: int = 12, seed: int = 3) -> np.ndarray:
    """Balanced partition of the neighbour graph: halving along main directions, then moves that cut fewer edges and keep every part within slack of n/parts."""
    n = len(x)
    side = np.zeros(n, np.int64)

    def halve(rows: np.ndarray, first: int, count: int) -> None:
        if count == 1:
            side[rows] = first
            return
        left = count // 2
        y = x[rows] - x[rows].mean(0)
        axis = np.linalg.svd(y, full_matrices=False)[2][0] if len(rows) > 1 else np.zeros(x.shape[1])
        order = np.argsort(y @ axis, kind="stable")
        cut = len(rows) * left // count
        halve(rows[order[:cut]], first, left)
        halve(rows[order[cut:]], first + left, count - left)

    halve(np.arange(n), 0, parts)
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(near):
        for j in row:
            back[j].append(i)
    around = [np.concatenate([near[i], np.array(back[i], np.int64)]) for i in range(n)]
    size = np.bincount(side, minlength=parts)
    most, least = int(np.ceil(n / parts * (1 + slack))), int(n / parts * (1 - slack))
    rng = np.random.default_rng(seed)
    for _ in range(sweeps):
        moved = 0
        for i in rng.permutation(n):
            have = np.bincount(side[around[i]], minlength=parts)
            have = np.where((size < most) | (np.arange(parts) == side[i]), have, -1)
            to = int(have.argmax())
            if to != side[i] and have[to] > have[side[i]] and size[side[i]] > least:
                size[side[i]] -= 1
                size[to] += 1
                side[i] = to
                moved += 1
        if not moved:
            break
    return side


class Router:
    """Softmax classifier over one hidden layer from vectors to partitions; a few tens of kilobytes."""

    def __init__(self, dim: int, parts: int):
        self.dim, self.parts = dim, parts
        self.net: list[np.ndarray] = []
        self.mean, self.scale = np.zeros(dim), 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not self.net:
            return np.zeros((len(x), 1))
        w1, b1, w2, b2 = self.net
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def fit(self, x: np.ndarray, goal: np.ndarray, rounds: int = 250, hidden: int = 96, seed: int = 5) -> Router:
        """Full-batch Adam, in single precision: the weights only choose leaves, no distance comes from them."""
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), float(x.std() + 1e-9)
        z, goal = ((x - self.mean) / self.scale).astype(np.float32), goal.astype(np.float32)
        p = [rng.normal(0, 1 / np.sqrt(self.dim), (self.dim, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, self.parts)), np.zeros(self.parts)]
        p = [a.astype(np.float32) for a in p]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for t in range(1, rounds + 1):
            hid = np.tanh(z @ p[0] + p[1])
            s = hid @ p[2] + p[3]
            s = np.exp(s - s.max(1, keepdims=True))
            s /= s.sum(1, keepdims=True)
            g = (s - goal) / len(x)
            back = g @ p[2].T * (1 - hid**2)
            for a, gr, mm, vv in zip(p, (z.T @ back + 1e-4 * p[0], back.sum(0), hid.T @ g + 1e-4 * p[2], g.sum(0)), m, v, strict=True):
                mm += 0.1 * (gr - mm)
                vv += 0.01 * (gr * gr - vv)
                a -= 0.01 * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.99**t)) + 1e-9)
        self.net = p
        return self


def train(x: np.ndarray, parts: int, known: int) -> Router:
    """A router to `parts` balanced partitions of the neighbour graph of x; it learns from all rows but every known-th (0: from all)."""
    router = Router(x.shape[1], parts)
    if parts == 1:
        return router
    near = knn(x, 16)
    side = partition(x, near, parts)
    own = np.zeros((len(x), parts))
    np.add.at(own, (np.repeat(np.arange(len(x)), near.shape[1]), side[near.ravel()]), 1.0 / max(near.shape[1], 1))
    own = 0.5 * own + 0.5 * np.eye(parts)[side]
    use = np.arange(len(x)) % known > 0 if known else np.ones(len(x), bool)
    return router.fit(x[use], own[use])


def rerank(x: np.ndarray, ids: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of y, ids and distances of the k rows of x nearest to each row of y (all, if fewer), ties to the smaller id.

    Squared distances by one matrix product, whose rounding errors `slack` bounds, leave out what can't be among them; the exact measure decides on the rest.
    """
    n = min(k, len(x))
    if not n or not len(y):
        return np.zeros(0, np.int64), ids[:0], np.zeros(0)
    out = []
    with np.errstate(over="ignore", invalid="ignore"):
        sq, own = (x * x).sum(1), (y * y).sum(1)
        for lo in range(0, len(y), 256):
            q = y[lo : lo + 256]
            rough = sq[None, :] - 2 * (q @ x.T) + own[lo : lo + 256, None]
            slack = 4e-15 * (x.shape[1] + 8) * (sq.max() + own[lo : lo + 256, None]) + 1e-300
            row, col = np.nonzero(~(rough > np.partition(rough, n - 1, 1)[:, n - 1 : n] + slack))  # what overflows stays
            d = np.concatenate([np.sqrt(((x[col[i : i + 65536]] - q[row[i : i + 65536]]) ** 2).sum(1)) for i in range(0, len(row), 65536)])
            order = np.lexsort((ids[col], d, row))
            row, col, d = row[order], col[order], d[order]
            first = np.searchsorted(row, np.arange(len(q)))
            use = np.arange(len(row)) - first[row] < n
            out.append((row[use] + lo, ids[col[use]], d[use]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


class Index:
    """A router to branches and one for each branch to its leaves: at most PARTS * PARTS leaves, a few megabytes whatever the table's size."""

    def __init__(self, dim: int, root: Router, below: list[Router], probes: int = 1):
        self.dim, self.root, self.below, self.probes = dim, root, below, probes
        self.first = np.concatenate([[0], np.cumsum([r.parts for r in below])]).astype(np.int64)
        self.leaves = int(self.first[-1])

    def place(self, x: np.ndarray) -> np.ndarray:
        """Each row's leaf: the likeliest one of its likeliest branch."""
        branch = self.root.logits(x).argmax(1)
        out = self.first[branch].copy()
        for b in np.unique(branch):
            mine = branch == b
            out[mine] += self.below[b].logits(x[mine]).argmax(1)
        return out

    def likely(self, x: np.ndarray) -> np.ndarray:
        """log probability of each leaf."""

        def log_softmax(z):
            z = z - z.max(1, keepdims=True)
            return z - np.log(np.exp(z).sum(1, keepdims=True))

        root = log_softmax(self.root.logits(x))
        return np.concatenate([root[:, [b]] + log_softmax(r.logits(x)) for b, r in enumerate(self.below)], 1)


def fit(vectors: DataFrame, k: int = 10) -> Index:
    """The index of distinct vectors (vec_id, v), each router fitted on SAMPLE of them at most: there are a partition for each PART_ROWS vectors, in two levels of PARTS at most.

    probes is the least number of leaves that hold GOAL of the nearest k of sample rows which no root router has learnt from. Their neighbours within the sample lie
    further off than those in the table, so this errs on the side of more probes.
    """
    n = vectors.count()
    got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()
    dims = got.v.map(len)
    dim = int(dims.mode().iloc[0]) if len(dims) else 0
    x = np.stack(got.v[dims == dim].to_list()).astype(np.float64) if dim else np.zeros((0, 0))
    leaves = max(1, n // PART_ROWS)
    root = train(x, min(PARTS, leaves), 5) if len(x) > k + 1 else Router(dim, 1)
    below = [Router(dim, 1)] * root.parts
    if leaves > PARTS:
        sent = vectors.sparkSession.sparkContext.broadcast(root)

        def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = b.column("v")
                y = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), dim)
                yield pa.record_batch([pa.array(sent.value.logits(y).argmax(1).astype(np.int32)), v, b.column("h")], names=["branch", "v", "h"])

        rows = vectors.filter(F.size("v") == dim).select("v", F.xxhash64("vec_id").alias("h"))
        rows = materialise(rows.mapInArrow(branch, "branch int, v array<double>, h long"))
        size = {r.branch: r.n for r in rows.groupBy("branch").agg(F.count("*").alias("n")).collect()}  # at most PARTS rows
        some = rows.withColumn("i", F.row_number().over(W.partitionBy("branch").orderBy("h"))).filter(F.col("i") <= SAMPLE).select("branch", "v")

        def learn(d: pd.DataFrame) -> pd.DataFrame:
            b = int(d.branch.iloc[0])
            y = np.stack(d.v.to_list())
            parts = int(min(PARTS, max(1, size[b] // PART_ROWS), max(1, len(y) // (2 * k + 2))))
            return pd.DataFrame({"branch": [b], "router": [pickle.dumps(train(y, parts, 0))]})

        for r in some.groupBy("branch").applyInPandas(learn, "branch int, router binary").collect():  # at most PARTS rows
            below[r.branch] = pickle.loads(bytes(r.router))
    index = Index(dim, root, below)
    if index.leaves > 1:
        held = np.arange(len(x)) % 5 == 0
        score = index.likely(x[held])
        rank = np.empty_like(score, dtype=np.int64)
        np.put_along_axis(rank, np.argsort(-score, 1, kind="stable"), np.arange(index.leaves)[None, :].repeat(len(score), 0), 1)
        at = np.take_along_axis(rank, index.place(x)[knn(x, k)[held]], 1)
        index.probes = next(p for p in range(1, index.leaves + 1) if (at < p).mean() >= GOAL or p == index.leaves)
    return index


def search(vectors: DataFrame, query: str = "vec_id % 100 = 0", k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest valid rows of each valid row that `query` selects, its own excepted, by Euclidean distance
    in double precision, ties to the smaller vec_id.

    Every row is indexed, equal vectors as one: of theirs the k + 1 smallest vec_ids are all that any result can need. The classifiers place a vector
    in its likeliest leaf. A query goes to its `probes` likeliest leaves, and to more while those hold fewer than k + 1 vectors, and is reranked
    exactly there; queries of one vector are searched once. Leaves grow in number with the table (up to PARTS * PARTS), so a query's cost
    doesn't. A leaf's vectors are dealt out to cells of about CAND_CELL vectors and QUERY_CELL queries.

    Null, zero or non-finite vectors, vectors of another length than most of the sample, and rows without vec_id take no part. Rows that share a vec_id
    are one, with the least of their vectors. No rows, no result. Other columns are not read.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = materialise(valid(vectors))
    if not rows.groupBy("vec_id").count().filter("count > 1").isEmpty():
        rows = materialise(rows.groupBy("vec_id").agg(F.min("v").alias("v")))
    distinct = materialise(rows.groupBy("v").agg(F.min("vec_id").alias("vec_id")))
    index = fit(distinct, k)
    sent = spark.sparkContext.broadcast(index)
    fits = F.size("v") == index.dim
    few = rows.filter(fits).withColumn("_i", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).filter(F.col("_i") <= k + 1).drop("_i")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), sent.value.dim)
            yield pa.record_batch([b.column("vec_id"), v, pa.array(sent.value.place(x).astype(np.int32))], names=["vec_id", "v", "part"])

    placed = materialise(few.mapInArrow(place, f"vec_id {kind}, v array<double>, part int"))
    counts = {r.part: r.n for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # at most PARTS * PARTS rows
    size = np.array([counts.get(i, 0) for i in range(index.leaves)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("q")
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), sent.value.dim)
            order = np.argsort(-sent.value.likely(x), 1, kind="stable")
            have = np.cumsum(size[order], 1)
            use = (np.arange(len(size))[None, :] < sent.value.probes) | (np.concatenate([np.zeros((len(x), 1)), have[:, :-1]], 1) < k + 1)
            row, col = np.nonzero(use)
            yield pa.record_batch([b.column("qid").take(pa.array(row)), v.take(pa.array(row)), pa.array(order[row, col].astype(np.int32))], names=["qid", "q", "part"])

    asking = materialise(rows.filter(fits).filter(query))
    wanted = materialise(asking.groupBy("v").agg(F.min("vec_id").alias("qid"), F.count("*").alias("n")))
    routed = materialise(wanted.select("qid", F.col("v").alias("q")).mapInArrow(route, f"qid {kind}, q array<double>, part int"))
    asked = {r.part: r.n for r in routed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # at most PARTS * PARTS rows
    cuts = [(i, max(1, -(-counts.get(i, 0) // CAND_CELL)), max(1, -(-asked.get(i, 0) // QUERY_CELL))) for i in range(index.leaves)]
    cells = F.broadcast(spark.createDataFrame(cuts, "part int, _na int, _nb int"))
    cands = placed.join(cells, "part").select("vec_id", "v", "part", F.pmod(F.xxhash64("vec_id"), "_na").cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("b"))
    routed = routed.join(cells, "part").select("qid", "q", "part", F.explode(F.sequence(F.lit(0), F.col("_na") - 1)).alias("a"), F.pmod(F.xxhash64("qid"), "_nb").cast("int").alias("b"))

    def nearest(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return pd.DataFrame({"qid": [], "vec_id": [], "score": []})
        row, near, d = rerank(np.stack(c.v.to_list()), c.vec_id.to_numpy(), np.stack(q.q.to_list()), k + 1)
        return pd.DataFrame({"qid": q.qid.to_numpy()[row], "vec_id": near, "score": d})

    local = cands.groupBy("part", "a", "b").cogroup(routed.groupBy("part", "a", "b")).applyInPandas(nearest, f"qid {kind}, vec_id {kind}, score double")
    best = local.withColumn("_i", F.row_number().over(W.partitionBy("qid").orderBy("score", "vec_id"))).filter(F.col("_i") <= k + 1)
    near = best.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    near = materialise(near.join(wanted.select("qid", "n"), "qid"))
    asking = materialise(skew_join(asking, wanted, ["v"], "n", asking.count()).select(F.col("vec_id").alias("query_id"), "qid"))
    out = skew_join(asking, near, ["qid"], "n", asking.count())
    out = out.select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("rank", "r"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "r.vec_id", "r.score")
