"""Language-model scoring by a probabilistic suffix tree over the bytes of words, and an add-one word model beside it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import bit_filter, drop, in_filter, materialise, release
from .tokens import CODES_LOWER, Chunk, chunks, mix, words

#: Longest context in bytes; a context must hold this share of all symbols, so a depth has at most 1/MIN_SHARE contexts.
DEPTH = 5
MIN_SHARE = 5e-5
#: Nats a symbol by which a context's distribution must differ from its suffix's, and the weight of the suffix in smoothing.
DIVERGENCE, PRIOR = 0.002, 4.0
#: Words of known counts that every task holds (24 bytes each); the counts of all others come by a join.
HEAD = 1 << 18
#: One-word contexts: a word is one if it occurs SUPPORT times and its next words diverge from the empty context by WORD_DIVERGENCE nats a token.
#: A next word is retained in it if it occurs twice there and its log-likelihood gain over the empty context, count * ln(ratio), is EVIDENCE nats; DISCOUNT is taken
#: off its count for all others. The PAIRS most frequent ones of held words are held by every task, all others come by a join behind a filter of FILTER bits,
#: and so do the contexts that are not held.
SUPPORT, WORD_DIVERGENCE, EVIDENCE, DISCOUNT = 64, 0.01, 20.0, 0.5
PAIRS, FILTER = 1 << 18, 1 << 25
#: Distinct pairs that a task gathers before it hands them on.
GATHER = 1 << 22
SPACE = 32  # occurs in no word: it closes them
SIGN = np.uint64(1 << 63)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def distinct_words(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of each distinct word's first place, its hash, the words' numbers among them, and the document boundaries."""
    start, end, bound, h = words(c, CODES_LOWER)
    uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
    return start[first], end[first], uniq, inv, bound


def _pack(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words as one array, each after a space and before one: the array, the place of each predicted symbol, and its word.

    The space before a word is its context only; the one after it is predicted.
    """
    n = end - start
    offs = np.concatenate([[0], np.cumsum(n + 2)])
    out = np.full(offs[-1], SPACE, np.uint8)
    word = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    out[offs[:-1][word] + 1 + at] = _LOWER[buf[start[word] + at]]
    owner = np.repeat(np.arange(len(n)), n + 1)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1) + offs[:-1][owner] + 1
    return out, place, owner


def _context(text: np.ndarray, place: np.ndarray, d: int, since: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of the d bytes before each place, and whether they reach no further back than the space before the word."""
    ok = since >= d
    key = np.zeros(len(place), np.uint64)
    for i in range(1, d + 1):
        key |= text[np.maximum(place - i, 0)].astype(np.uint64) << np.uint64(8 * (i - 1))
    return key, ok


class Tree:
    """Retained contexts by depth (sorted keys and state numbers), and log10 of the smoothed next-symbol probabilities by state."""

    def __init__(self, keys: list[np.ndarray], states: list[np.ndarray], log10: np.ndarray):
        self.keys, self.states, self.log10 = keys, states, log10

    def word_scores(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """log10 probability of each word and the space after it, from the longest retained suffix before each symbol."""
        if not len(start):
            return np.zeros(0)
        text, place, owner = _pack(buf, start, end)
        since = np.arange(len(owner)) - np.repeat(np.cumsum(end - start + 1) - (end - start + 1), end - start + 1) + 1
        state = np.zeros(len(place), np.int64)
        for d in range(1, DEPTH + 1):
            keys = self.keys[d]
            if not len(keys):
                continue
            key, ok = _context(text, place, d, since)
            at = np.searchsorted(keys, key)
            at[at == len(keys)] = 0
            hit = ok & (keys[at] == key)
            state[hit] = self.states[d][at[hit]]
        return np.bincount(owner, self.log10[state, text[place]], minlength=len(start)).astype(np.float64)


def train(vocab: DataFrame) -> Tree:
    """The tree from the distinct words of vocab. Depths grow in turn: a context is counted if its suffix is frequent enough.

    Each word counts once, however frequent: the tree spells words that the word level doesn't hold, and those resemble the rare ones.

    A context stays if it holds MIN_SHARE of the symbols and its distribution diverges from its longest retained suffix's by
    DIVERGENCE nats a symbol at least. Distributions are smoothed towards the suffix's with PRIOR symbols of weight, the root's towards uniform.
    """
    spark = vocab.sparkSession
    tables: list[dict[int, np.ndarray]] = [{} for _ in range(DEPTH + 1)]
    eligible: list[np.ndarray | None] = [None] * (DEPTH + 1)
    for depths in ((0, 1, 2), *((d,) for d in range(3, DEPTH + 1))):
        allowed = eligible[depths[0] - 1] if depths[0] else None
        if depths[0] and not len(allowed):
            break
        sent = spark.sparkContext.broadcast(allowed)

        def count(batches: Iterator[pa.RecordBatch], depths=depths, sent=sent) -> Iterator[pa.RecordBatch]:
            allowed = sent.value
            keep: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for b in batches:
                for c in chunks(b.column("word"), 1 << 20):
                    start, end = c.offs[:-1], c.offs[1:]
                    text, place, owner = _pack(c.buf, start, end)
                    since = np.arange(len(owner)) - np.repeat(np.cumsum(end - start + 1) - (end - start + 1), end - start + 1) + 1
                    for d in depths:
                        key, ok = _context(text, place, d, since)
                        if d > 2:  # the suffix: all but the oldest byte
                            tail = key & np.uint64((1 << (8 * (d - 1))) - 1)
                            at = np.searchsorted(allowed, tail)
                            at[at == len(allowed)] = 0
                            ok &= allowed[at] == tail
                        k = (key[ok] << np.uint64(8)) | text[place[ok]].astype(np.uint64)
                        u, inv = np.unique(k, return_inverse=True)
                        v = np.bincount(inv, minlength=len(u)).astype(np.float64)
                        if d in keep:
                            u2, v2 = keep[d]
                            both = np.concatenate([u, u2])
                            u, inv = np.unique(both, return_inverse=True)
                            v = np.bincount(inv, np.concatenate([v, v2]))
                        keep[d] = (u, v)
            for d, (u, v) in keep.items():
                yield pa.record_batch([pa.array(np.full(len(u), d, np.int32)), pa.array(u.view(np.int64)), pa.array(v.astype(np.int64))], names=["d", "k", "n"])

        pairs = vocab.mapInArrow(count, "d int, k long, n long").groupBy("d", "k").agg(F.sum("n").alias("n"))
        ctx = F.shiftrightunsigned("k", 8)
        pairs = materialise(pairs.withColumn("ctx", ctx))
        if depths[0] == 0:
            total = pairs.filter("d = 0").agg(F.sum("n")).first()[0] or 0
            floor = max(1.0, MIN_SHARE * total)
        frequent = pairs.groupBy(F.col("d").alias("_d"), F.col("ctx").alias("_c")).agg(F.sum("n").alias("_n")).filter((F.col("_n") >= floor) | (F.col("_d") == 0))
        got = pairs.join(frequent, (F.col("d") == F.col("_d")) & (F.col("ctx") == F.col("_c"))).select("d", "k", "n").toPandas()  # at most 256 rows for each of 1/MIN_SHARE contexts
        drop(pairs)
        for d in depths:
            part = got[got.d == d]
            key, n = part.k.to_numpy(np.uint64), part.n.to_numpy(np.float64)
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            c = key >> np.uint64(8)
            u, first = np.unique(c, return_index=True)
            for x, lo, hi in zip(u, first, np.append(first[1:], len(c))[: len(u)], strict=True):
                row = np.zeros(256)
                row[(key[lo:hi] & np.uint64(255)).astype(np.int64)] = n[lo:hi]
                tables[d][int(x)] = row
            eligible[d] = u
    root = tables[0].get(0, np.zeros(256))
    probs = [(root + 0.5) / (root.sum() + 128)]
    keys: list[np.ndarray] = [np.zeros(0, np.uint64)] * (DEPTH + 1)
    states: list[np.ndarray] = [np.zeros(0, np.int64)] * (DEPTH + 1)
    held: list[dict[int, int]] = [{0: 0}] + [{} for _ in range(DEPTH)]
    for d in range(1, DEPTH + 1):
        for key in sorted(tables[d]):
            row = tables[d][key]
            below = next(held[e][key & ((1 << (8 * e)) - 1)] for e in range(d - 1, -1, -1) if (key & ((1 << (8 * e)) - 1)) in held[e])
            p = (row + PRIOR * probs[below]) / (row.sum() + PRIOR)
            seen = row > 0
            q = row[seen] / row.sum()
            if (q * np.log(q / probs[below][seen])).sum() >= DIVERGENCE or d == 1:
                held[d][key] = len(probs)
                probs.append(p)
        keys[d] = np.array(sorted(held[d]), np.uint64)
        states[d] = np.array([held[d][int(k)] for k in keys[d]], np.int64)
    return Tree(keys, states, np.log10(np.stack(probs)).astype(np.float32))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all whole texts of docs; A-Z lower-cased."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column("text"), 4 << 20):
                start, end, _, inv, _ = distinct_words(c)
                if not len(start):
                    continue
                n = np.bincount(inv, minlength=len(start))
                low = _LOWER[c.buf]
                size = end - start
                offs = np.concatenate([[0], np.cumsum(size)])
                word = np.repeat(np.arange(len(size)), size)
                data = low[start[word] + np.arange(len(word)) - offs[:-1][word]]
                col = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
                for lo in range(0, len(size), 200_000):
                    yield pa.record_batch([col[lo : lo + 200_000], pa.array(n[lo : lo + 200_000].astype(np.int64))], names=["word", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class WordTree:
    """Word level of the tree: the most frequent words, and the next-word distributions of the retained one-word contexts.

    The longest retained suffix before a token is its previous word (or the text's start) if that context was kept, else the empty context, whose
    distribution is (c + mu * P_bytes) / (N + mu): smoothed towards the byte tree, which can spell any word.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, lp: np.ndarray, n_docs: int, end_lp: float):
        self.keys, self.lp = keys, np.concatenate([lp, [0.0, end_lp]]).astype(np.float32)
        self.start, self.end = len(keys), len(keys) + 1
        self.n = np.concatenate([n, [n_docs, 0]])
        self.pair, self.pair_lp = np.zeros(0, np.int64), np.zeros(0, np.float32)
        self.back = np.zeros(len(keys) + 2, np.float32)  # log10 of the weight that a context leaves to the empty one
        self.left, self.kept = np.ones(len(keys) + 2), np.zeros(len(keys) + 2, bool)
        self.more: np.ndarray | None = None  # filter of the retained pairs that are not held
        self.far: np.ndarray | None = None  # filter of the contexts that are not held

    def index(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the words, -1 for those that are not held."""
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == h, at, -1)

    def codes(self, h: np.ndarray) -> np.ndarray:
        """The words' numbers, and negative ones, made of their hashes, for those that are not held."""
        at = self.index(h)
        return np.where(at >= 0, at, (h | SIGN).view(np.int64))

    def steps(self, word: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes (previous, current) and document for each token, ends included."""
        n = np.diff(bound)
        offs = np.concatenate([[0], np.cumsum(n + 2)])
        seq = np.full(offs[-1], self.start, np.int64)
        doc = np.repeat(np.arange(len(n)), n + 2)
        at = np.arange(len(word)) + np.repeat(2 * np.arange(len(n)) + 1, n)
        seq[at] = word
        seq[offs[1:] - 1] = self.end
        cur = np.ones(len(seq), bool)
        cur[offs[:-1]] = False
        place = np.flatnonzero(cur)
        return seq[place - 1], seq[place], doc[place]

    def gain(self, prev: np.ndarray, cur: np.ndarray, n: np.ndarray) -> np.ndarray:
        """gain() of pairs of held words that occur n times."""
        return gain(n, self.n[prev], self.lp[cur].astype(np.float64))

    def retain(self, prev: np.ndarray, total_gain: np.ndarray, held: np.ndarray, kinds: np.ndarray) -> None:
        """The contexts: their words, the gain of all of their pairs, and the count and number of their retained pairs."""
        self.kept = np.zeros(len(self.n), bool)
        self.left = np.ones(len(self.n))
        total = np.maximum(self.n[prev].astype(np.float64), 1)
        ok = total_gain / total >= WORD_DIVERGENCE
        self.kept[prev[ok]] = True
        self.left[prev[ok]] = np.maximum((total - held + DISCOUNT * kinds)[ok] / total[ok], 1e-12)
        self.back = np.log10(self.left).astype(np.float32)

    def scores(self, prev: np.ndarray, cur: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each token given its longest retained suffix, plain being that of the empty context.

        Then what is not held: the tokens whose pair may be retained and these pairs' keys. What a context that is not held leaves to the empty one is left out.
        """
        near, at = prev >= 0, np.maximum(prev, 0)
        out = plain + np.where(near, self.back[at], 0.0)
        may = near & self.kept[at]
        if self.far is not None:
            far = np.flatnonzero(~near)
            may[far[in_filter(self.far, prev[far].view(np.uint64))]] = True
        both = np.flatnonzero(may)
        key = pair_key(prev[both], cur[both])
        hit = np.zeros(len(both), bool)
        if len(self.pair) and len(both):
            at = np.searchsorted(self.pair, key)
            at[at == len(self.pair)] = 0
            hit = self.pair[at] == key
            out[both[hit]] = self.pair_lp[at[hit]]
        if self.more is None:
            return out, both[:0], key[:0]
        left = np.flatnonzero(~hit)
        left = left[in_filter(self.more, key[left].view(np.uint64))]
        return out, both[left], key[left]


def gain(n: np.ndarray, n_prev: np.ndarray, lp: np.ndarray) -> np.ndarray:
    """Log-likelihood gain in nats of pairs that occur n times after words that occur n_prev times, lp being log10 of the next word's share in the empty context."""
    return n * (np.log(n / n_prev) - lp * np.log(10.0))


def pair_key(prev: np.ndarray, cur: np.ndarray) -> np.ndarray:
    """One number for each pair of codes: (previous << 32 | current) if both words are held, a negative one, made of a hash of 63 bits, if not."""
    key = prev << 32 | cur
    far = np.flatnonzero((prev < 0) | (cur < 0))
    key[far] = (mix(prev[far].view(np.uint64) ^ mix(cur[far].view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) | SIGN).view(np.int64)
    return key


def _pairs(train_on: DataFrame, tree: WordTree, counts: DataFrame, least: int) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """Fills tree with its one-word contexts that are held and the most frequent of their pairs.

    counts: h, n and lp of every word; those with n >= least are held. Returns the other pairs of held words (k, over: what they add to the score of backing off),
    those of words that are not held (w: the code of such a word, the later one of two; k, over) and the other contexts (a: their code, back: log10 of the weight
    they leave to the empty one); None where there are none.
    """
    spark = train_on.sparkSession
    sent = spark.sparkContext.broadcast(tree)
    others = counts.filter(F.col("n") < least).select(F.expr("h | shiftleft(1L, 63)").alias("code"), "n", "lp") if least > 1 else None
    # a pair that occurs twice has words that do; the filters let some others through, which the joins drop
    again_ = spark.sparkContext.broadcast(bit_filter(others.filter("n > 1").select("code"), FILTER) if others is not None else None)
    contexts = others.filter(F.col("n") >= SUPPORT) if least > SUPPORT else None
    often_ = spark.sparkContext.broadcast(bit_filter(contexts.select("code"), FILTER) if contexts is not None else None)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """a, b, n: a pair's codes, or its key and 0 if both words are held, which takes less room in the shuffle."""
        t = sent.value
        often = t.n >= SUPPORT
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            k = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in held)])
            n = np.concatenate([np.zeros(0, np.int32), *(x for _, x in held)])
            held.clear()
            order = np.argsort(k)
            k, n = k[order], n[order]
            del order
            at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
            return k[at], np.zeros(len(at), np.int64), np.add.reduceat(n, at) if len(at) else n

        def rows(a, b, n):
            for lo in range(0, len(a), 200_000):
                yield pa.record_batch([pa.array(a[lo : lo + 200_000]), pa.array(b[lo : lo + 200_000]), pa.array(n[lo : lo + 200_000].astype(np.int32))], names=["a", "b", "n"])

        def passing(code, ok, bits):
            """ok, and for codes of words that are not held whether they are in bits."""
            far = np.flatnonzero(code < 0)
            ok[far] = in_filter(bits, code[far].view(np.uint64)) if bits is not None else False
            return ok

        for b in batches:
            for c in chunks(b.column("text"), 4 << 20):
                _, _, bound, h = words(c, CODES_LOWER)
                prev, cur, _ = t.steps(t.codes(h), bound)
                ok = passing(prev, often[np.maximum(prev, 0)], often_.value) & passing(cur, np.ones(len(cur), bool), again_.value)
                prev, cur = prev[ok], cur[ok]
                near = (prev >= 0) & (cur >= 0)
                k, n = np.unique(prev[near] << 32 | cur[near], return_counts=True)
                held.append((k, n.astype(np.int32)))
                if not near.all():
                    prev, cur = prev[~near], cur[~near]
                    _, first, n = np.unique(pair_key(prev, cur), return_index=True, return_counts=True)
                    yield from rows(prev[first], cur[first], n)
                if sum(len(k) for k, _ in held) > GATHER:
                    yield from rows(*merged())
        yield from rows(*merged())

    got = train_on.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "a long, b long, n int").groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 1")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of held words; the others wait for their words' counts."""
        t = sent.value
        for b in batches:
            prev, cur, n = (b.column(x).to_numpy() for x in ("a", "b", "n"))
            far = (prev < 0) | (cur < 0)
            prev, cur = np.where(far, prev, prev >> 32), np.where(far, cur, prev & 0xFFFFFFFF)
            g = t.gain(np.where(far, 0, prev), np.where(far, 0, cur), n)
            yield pa.record_batch([pa.array(prev), pa.array(cur), b.column("n"), pa.array(g, mask=far), pa.array(g >= EVIDENCE, mask=far)], names=["a", "b", "n", "gain", "ok"])

    got = materialise(got.mapInArrow(judged, "a long, b long, n long, gain double, ok boolean"))
    release(spark)
    near = got.filter("a >= 0 and b >= 0")
    by = near.select("a", "n", "gain", "ok")
    far = None
    if others is not None:
        none = F.lit(None).cast("double")
        far = got.filter("b < 0").select("a", "b", "n").join(others.filter("n > 1").select(F.col("code").alias("b"), F.col("lp").alias("lp_b")), "b").select("a", "b", "n", "lp_b", none.alias("n_a"))
        if contexts is not None:
            far = far.unionByName(got.filter("a < 0 and b >= 0").select("a", "b", "n", none.alias("lp_b"), none.alias("n_a")))
            after = far.filter("a < 0").drop("n_a").join(contexts.select(F.col("code").alias("a"), F.col("n").cast("double").alias("n_a")), "a")
            far = far.filter("a >= 0").unionByName(after)

        def judged_far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = sent.value
            for b in batches:
                prev, cur, n, lp, n_prev = (b.column(x).to_numpy(zero_copy_only=False) for x in ("a", "b", "n", "lp_b", "n_a"))
                n_prev = np.where(prev >= 0, t.n[np.maximum(prev, 0)], n_prev.astype(np.float64))
                lp = np.where(cur >= 0, t.lp[np.maximum(cur, 0)], lp.astype(np.float64))
                g = gain(n, n_prev, lp)
                yield pa.record_batch([*(b.column(x) for x in ("a", "b", "n")), *(pa.array(x) for x in (n_prev, lp, g, g >= EVIDENCE))], names=["a", "b", "n", "n_prev", "lp", "gain", "ok"])

        far = materialise(far.mapInArrow(judged_far, "a long, b long, n long, n_prev double, lp double, gain double, ok boolean"))
        by = by.unionByName(far.filter("a >= 0").select("a", "n", "gain", "ok"))
    sums = [F.sum("gain").alias("gain"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("held"), F.sum(F.col("ok").cast("int")).alias("kinds")]
    by = by.groupBy("a").agg(*sums).toPandas()  # at most HEAD rows
    tree.retain(*(by[x].to_numpy(t) for x, t in (("a", np.int64), ("gain", np.float64), ("held", np.float64), ("kinds", np.float64))))
    again = spark.sparkContext.broadcast((tree.kept, tree.left, tree.n, tree.lp))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, left, n_word, lp = again.value
        for b in batches:
            prev, cur, n = (b.column(x).to_numpy() for x in ("a", "b", "n"))
            ok = kept[prev]
            prev, cur, n = prev[ok], cur[ok], n[ok]
            plain = lp[cur].astype(np.float64)
            pair = np.log10((n - DISCOUNT) / n_word[prev] + left[prev] * 10.0**plain)
            yield pa.record_batch([pa.array(x) for x in (prev << 32 | cur, n, pair, pair - plain - np.log10(left[prev]))], names=["k", "n", "lp", "over"])

    pairs = materialise(near.filter("ok").select("a", "b", "n").mapInArrow(weighed, "k long, n long, lp double, over double"))
    floor = _head_floor(pairs, PAIRS)
    held = pairs.filter(F.col("n") >= floor).select("k", "lp").toPandas()  # at most PAIRS rows
    order = np.argsort(held.k.to_numpy(np.int64))
    tree.pair, tree.pair_lp = held.k.to_numpy(np.int64)[order], held.lp.to_numpy(np.float64)[order].astype(np.float32)
    rest = pairs.filter(F.col("n") < floor).select("k", "over") if floor > 1 else None
    drop(got)
    kept_far = more = None
    if others is not None:
        some = far.filter("ok").select("a", "b", "n", "n_prev", "lp")
        ready = some.filter("a >= 0").withColumn("left", F.lit(None).cast("double"))
        if contexts is not None:
            own = far.filter("a < 0").groupBy("a").agg(F.max("n_prev").alias("total"), *sums).filter(F.col("gain") / F.col("total") >= WORD_DIVERGENCE)
            left = F.greatest((F.col("total") - F.col("held") + F.lit(DISCOUNT) * F.col("kinds")) / F.col("total"), F.lit(1e-12))
            kept_far = materialise(own.select("a", left.alias("left")).withColumn("back", F.log10("left")))
            tree.far = bit_filter(kept_far.select("a"), FILTER)
            ready = ready.unionByName(some.filter("a < 0").join(kept_far.select("a", "left"), "a"))

        def weighed_far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, left, _, _ = again.value
            for b in batches:
                prev, cur, n, n_prev, lp, own = (b.column(x).to_numpy(zero_copy_only=False) for x in ("a", "b", "n", "n_prev", "lp", "left"))
                near = prev >= 0
                weight = np.where(near, left[np.maximum(prev, 0)], own.astype(np.float64))
                over = np.log10((n - DISCOUNT) / n_prev + weight * 10.0**lp) - lp - np.log10(weight)
                ok = ~near | kept[np.maximum(prev, 0)]
                yield pa.record_batch([pa.array(np.where(cur < 0, cur, prev)[ok]), pa.array(pair_key(prev, cur)[ok]), pa.array(over[ok])], names=["w", "k", "over"])

        more = materialise(ready.mapInArrow(weighed_far, "w long, k long, over double"))
        drop(far)
    open_ = [x.select("k") for x in (rest, more) if x is not None]
    if open_:
        tree.more = bit_filter(reduce(DataFrame.unionByName, open_), FILTER)
    return rest, more, kept_far.select("a", "back") if kept_far is not None else None


def score(docs: DataFrame, train_on: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of docs, learnt from the rows of train_on.

    Tokens are the words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end. base_score sums log10((c + 1) / (N + V + 1)) over them; score sums the
    tree's log10 probabilities (WordTree over Tree). Whole texts are read; null reads as empty: its end only. Repeated rows each get a row; other columns
    are not read. With nothing to learn from, N and V are 0 and the byte tree is uniform.

    Counts gather all of train_on. The HEAD most frequent words and the PAIRS most frequent retained pairs of theirs go to every task; occurrences of all other
    words meet theirs in a join, together with their pairs and contexts, and other pairs of held words in another, so both scores are the same as if everything were held. Words and these pairs are told apart by 64 and 63 bits of hash.
    """
    spark = docs.sparkSession
    vocab = materialise(word_counts(train_on))
    n_docs = train_on.count()
    stats = vocab.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    total, distinct = (stats.n or 0) + n_docs, stats.v + (n_docs > 0)
    tree = train(vocab)
    sent_tree = spark.sparkContext.broadcast(tree)
    least = _head_floor(vocab, HEAD)
    mu = max(1.0, distinct / max(1.0, float(np.log(max(total, 1) / max(distinct, 1)))))
    log_new, log_all = float(np.log10(mu)), float(np.log10(total + mu))
    plain = lambda n, b: np.log10(n + mu * 10.0**b) - log_all

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent_tree.value
        for b in batches:
            n = b.column("n").to_numpy()
            for c in chunks(b.column("word"), 1 << 20):
                many = n[c.lo : c.lo + c.n]
                byte_lp = tree.word_scores(c.buf, c.offs[:-1], c.offs[1:])
                lp = plain(many, byte_lp)
                yield pa.record_batch([pa.array(words_hash(c).view(np.int64)), pa.array(many), pa.array(lp), pa.array(lp - (log_new + byte_lp - log_all))], names=["h", "n", "lp", "over"])

    counts = materialise(vocab.mapInArrow(scored, "h long, n long, lp double, over double"))
    drop(vocab)
    release(spark)
    head = counts.filter(F.col("n") >= least).select("h", "n", "lp").toPandas()  # at most HEAD rows
    order = np.argsort(head.h.to_numpy(np.int64).view(np.uint64), kind="stable")
    words_held = WordTree(head.h.to_numpy(np.int64).view(np.uint64)[order], head.n.to_numpy(np.int64)[order], head.lp.to_numpy(np.float64)[order], n_docs, float(np.log10(max(n_docs, 1)) - log_all))
    rest, far, contexts = _pairs(train_on, words_held, counts, least) if total else (None, None, None)
    sent = spark.sparkContext.broadcast(words_held)
    contexts_there = contexts is not None
    asks = ["h", "p", "q"] if contexts_there else ["h", "p"]  # a word, its pair with the word before it, that with the held word after it
    end_base = float(np.log10(n_docs + 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree = sent.value, sent_tree.value
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for c in chunks(b.column("text"), 4 << 20):
                start, end, uniq, inv, bound = distinct_words(c)
                at = held.index(uniq)
                new = at < 0
                lp = held.lp[at].astype(np.float64)
                lp[new] = log_new + tree.word_scores(c.buf, start[new], end[new]) - log_all
                base = np.where(new, 0.0, np.log10(held.n[at] + 1.0)) if len(uniq) else np.zeros(0)
                n = np.diff(bound)
                prev, cur, doc = held.steps(np.where(new, (uniq | SIGN).view(np.int64), at)[inv], bound)
                alone = np.full(len(cur), held.lp[held.end])
                alone[cur != held.end] = lp[inv]
                each, open_, open_key = held.scores(prev, cur, alone)
                got = np.bincount(doc, each, minlength=c.n).astype(np.float64)
                # a pair of held words is asked for by itself, any other one with the word that is not held: the later one of two
                own = open_key >= 0
                open_cut = np.searchsorted(doc[open_[own]], np.arange(c.n + 1)).astype(np.int32)
                ask, ask_key = np.zeros(len(cur), bool), np.zeros(len(cur), np.int64)
                ask[open_[~own]], ask_key[open_[~own]] = True, open_key[~own]
                wdoc = np.repeat(np.arange(c.n), n)
                rare = np.flatnonzero(new[inv])
                cut = np.searchsorted(wdoc[rare], np.arange(c.n + 1)).astype(np.int32)
                place = np.flatnonzero(cur < 0)  # of the same words among the tokens; an end or a word follows each
                cols = [pa.array(uniq[inv[rare]].view(np.int64)), pa.array(ask_key[place], mask=~ask[place])]
                if contexts_there:
                    cols.append(pa.array(ask_key[place + 1], mask=~(ask[place + 1] & (cur[place + 1] >= 0))))
                yield pa.record_batch([
                    b.column("doc_id").slice(c.lo, c.n),
                    pa.array(row + np.arange(c.n)),
                    pa.array(n.astype(np.int64) + 1),
                    pa.array(np.bincount(wdoc, ~new[inv], minlength=c.n).astype(np.int64)),
                    pa.array(np.bincount(wdoc, base[inv], minlength=c.n).astype(np.float64)),
                    pa.array(got),
                    pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays(cols, names=asks)),
                    pa.ListArray.from_arrays(pa.array(open_cut), pa.array(open_key[own])),
                ], names=["doc_id", "row", "n_tokens", "known", "base", "score", "rare", "pairs"])
                row += c.n

    kind = docs.schema["doc_id"].dataType.simpleString()
    rare = ", ".join(f"{x}: bigint" for x in asks)
    first = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, row long, n_tokens long, known long, base double, score double, rare array<struct<{rare}>>, pairs array<long>")
    first = materialise(first)
    asked = first.select("row", F.explode("rare").alias("r")).select("row", *(f"r.{x}" for x in asks)).withColumn("_code", F.expr("h | shiftleft(1L, 63)"))
    low = counts.filter(F.col("n") < least).select(F.expr("h | shiftleft(1L, 63)").alias("code"), F.col("h").alias("_h"), "n", "over")
    met = F.lit(0.0)
    if far is not None:
        # a word that is not held brings its retained pairs along: half as many as its occurrences at most
        lists = far.groupBy("w").agg(F.collect_list(F.struct("k", "over")).alias("met"))
        low = low.join(lists.select("w", F.col("met.k").alias("keys"), F.col("met.over").alias("overs")), F.col("code") == F.col("w"), "left")
        met = reduce(lambda x, y: x + y, (F.coalesce(F.get("overs", (F.array_position("keys", F.col(x)) - 1).cast("int")), F.lit(0.0)) for x in asks[1:]))
    if contexts is not None:
        # every word is the one before another token, so its weight as a context counts once for each occurrence
        low = low.join(contexts, F.col("code") == F.col("a"), "left").withColumn("over", F.col("over") + F.coalesce("back", F.lit(0.0)))
    known = asked.join(low, (F.col("_code") == F.col("code")) & F.expr("(h ^ _h) = 0")).groupBy(F.col("row").alias("_row"))
    known = known.agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("gain"), F.sum("over").alias("over"), F.sum(met).alias("met"))
    out = first.drop("rare", "pairs").join(known, F.col("row") == F.col("_row"), "left").withColumn("pair_over", F.coalesce("met", F.lit(0.0)))
    if rest is not None:
        near = first.select("row", F.explode("pairs").alias("k")).join(rest, "k").groupBy(F.col("row").alias("_r")).agg(F.sum("over").alias("_over"))
        out = out.join(near, F.col("row") == F.col("_r"), "left").withColumn("pair_over", F.col("pair_over") + F.coalesce("_over", F.lit(0.0)))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(int(n_docs > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0)) + F.lit(end_base) - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"),
        (F.col("score") + F.coalesce("over", F.lit(0.0)) + F.col("pair_over")).alias("score"),
    )


def words_hash(c: Chunk) -> np.ndarray:
    """Hashes of values that each are one word."""
    from .tokens import prefix, span

    return span(prefix(CODES_LOWER[c.buf]), c.offs[:-1], c.offs[1:])


def _head_floor(counts: DataFrame, most: int) -> int:
    """The least count n for which at most `most` rows have that count or more."""
    if counts.count() <= most:
        return 1
    by = counts.groupBy("n").agg(F.count("*").alias("rows"))  # a row for each different count
    run = F.sum("rows").over(W.orderBy(F.col("n").desc()).rowsBetween(W.unboundedPreceding, 0))
    r = by.withColumn("run", run).filter(F.col("run") <= most).agg(F.min("n")).first()[0]
    return int(r) if r is not None else 1 << 62
