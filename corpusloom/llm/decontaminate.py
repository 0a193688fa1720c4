"""Benchmark decontamination: q-gram lemma filter over overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded_batches, shielded
from .tokens import Chunk, chunks, prefix, span

Q = 12
ERROR_RATE = 0.05
#: Normalised bytes of benchmark text sent to the tasks at once; a larger benchmark goes in several blocks.
BLOCK_BYTES = 4 << 20
_KEEP = np.zeros(256, bool)
_KEEP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def normalise(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of already lower-cased texts without spaces and ASCII punctuation, and their n+1 boundaries."""
    keep = _KEEP[c.buf]
    run = np.concatenate([[0], np.cumsum(keep)])
    return c.buf[keep], run[c.offs]


def _normal(texts: list[str]) -> list[np.ndarray]:
    """The items' normalised bytes, lower-cased the way the documents are."""
    out = []
    for c in chunks(pc.utf8_lower(pa.array(texts, pa.string()))):
        b, offs = normalise(c)
        out += [b[offs[i] : offs[i + 1]] for i in range(c.n)]
    return out


def budget(m: int, q: int = Q, rate: float = ERROR_RATE) -> int:
    """Edits allowed in an item of m symbols: rate * m, but few enough that the lemma's bound stays 1 at least."""
    return max(0, min(int(rate * m), (m - q) // q))


class Index:
    """Sorted q-gram hashes of the items with their places, and a bitmap in front; items shorter than q by the hash of all they have."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = ERROR_RATE):
        self.q = q
        self.ids, self.text = [], []
        self.short: dict[int, tuple[np.ndarray, np.ndarray, list]] = {}
        less: dict[int, list[tuple[np.uint64, object, bytes]]] = {}
        for (i, _), b in zip(items, _normal([t for _, t in items]), strict=True):
            if len(b) >= q:
                self.ids.append(i)
                self.text.append(b)
            elif len(b):
                h = span(prefix(b.astype(np.uint64) + np.uint64(1)), np.array([0]), np.array([len(b)]))[0]
                less.setdefault(len(b), []).append((h, i, b.tobytes()))
        for m, rows in less.items():
            rows.sort(key=lambda r: r[0])
            self.short[m] = (np.array([r[0] for r in rows], np.uint64), np.array([r[2] for r in rows], object), [r[1] for r in rows])
        self.m = np.array([len(t) for t in self.text], np.int64)
        self.e = np.array([budget(int(m), q, rate) for m in self.m], np.int64)
        self.need = self.m - q + 1 - q * self.e
        grams, where, item = [], [], []
        for k, t in enumerate(self.text):
            at = np.arange(len(t) - q + 1)
            grams.append(span(prefix(t.astype(np.uint64) + np.uint64(1)), at, at + q))
            where.append(at)
            item.append(np.full(len(at), k))
        g = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(g, kind="stable")
        self.gram = g[order]
        self.where = np.concatenate(where)[order] if grams else np.zeros(0, np.int64)
        self.item = np.concatenate(item)[order] if grams else np.zeros(0, np.int64)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.gram & np.uint64((1 << 22) - 1)).astype(np.int64)] = True


#: Pairs of a text's q-gram and an item's place that are counted at once.
HITS = 1 << 21


def find(c: Chunk, ix: Index) -> list[tuple[int, object, int, int, int]]:
    """(document, item_id, start, end, edits) for each item that lies in a text within its edit budget, in normalised offsets.

    Of several places of one item in a document, the one of the fewest edits, then the first.
    """
    buf, offs = normalise(c)
    out = []
    if ix.short:
        pre = prefix(buf.astype(np.uint64) + np.uint64(1))
        for m, (have, raw, ids) in sorted(ix.short.items()):
            at = np.arange(len(buf) - m + 1)
            at = at[at + m <= offs[np.searchsorted(offs, at, "right")]] if len(at) else at
            h = span(pre, at, at + m)
            seen = set()
            for p in at[np.isin(h, have)].tolist():
                d, gram = int(np.searchsorted(offs, p, "right")) - 1, buf[p : p + m].tobytes()
                if (d, gram) not in seen:
                    seen.add((d, gram))
                    out += [(d, ids[k], p - int(offs[d]), p - int(offs[d]) + m, 0) for k in np.flatnonzero(raw == gram)]
    return out + [(d, ix.ids[k], a, z, e) for d, k, a, z, e in _find_long(buf, offs, ix)]


def _find_long(buf: np.ndarray, offs: np.ndarray, ix: Index) -> list[tuple[int, int, int, int, int]]:
    """find() for the items of q symbols or more, by their number in the index."""
    q = ix.q
    if len(buf) < q or not len(ix.gram):
        return []
    n = len(buf) - q + 1
    pre = prefix(buf.astype(np.uint64) + np.uint64(1))
    pos = np.arange(n)
    h = span(pre, pos, pos + q)
    hit = np.flatnonzero(ix.bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
    lo = np.searchsorted(ix.gram, h[hit], "left")
    count = np.searchsorted(ix.gram, h[hit], "right") - lo
    hit, lo, count = hit[count > 0], lo[count > 0], count[count > 0]
    if not len(hit):
        return []
    doc = np.searchsorted(offs, hit, "right") - 1
    inside = hit + q <= offs[doc + 1]
    hit, lo, count, doc = hit[inside], lo[inside], count[inside], doc[inside]
    # documents in turns, so that grams common to many items never spread out over more than about HITS pairs, or one document's, at once
    ends = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc))
    total = np.cumsum(count)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    lo_row = 0
    while lo_row < len(doc):
        base = total[lo_row - 1] if lo_row else 0
        k = int(np.searchsorted(total[ends - 1], base + HITS, "right"))
        hi_row = int(ends[max(k - 1, int(np.searchsorted(ends, lo_row, "right")))])
        sl = slice(lo_row, hi_row)
        _count_bands(buf, offs, ix, hit[sl], lo[sl], count[sl], doc[sl], best)
        lo_row = hi_row
    return [(d, k, a - int(offs[d]), z - int(offs[d]), e) for (d, k), (a, z, e) in sorted(best.items())]


def _count_bands(buf, offs, ix: Index, hit, lo, count, doc, best) -> None:
    """Spreads out hits (place in buf; first place in the index and number of places; document), counts them in bands and puts alignments into best."""
    rep = np.repeat(np.arange(len(hit)), count)
    at = np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count) + lo[rep]
    item, j, doc, p = ix.item[at], ix.where[at], doc[rep], hit[rep]
    diag = p - j + int(ix.m.max())  # not negative
    stride = ix.e[item] + 1
    band = diag // stride
    # each diagonal lies in two bands of two strides; a match of e edits stays within e+1 diagonals, so in one of them
    rows = np.concatenate([np.stack([doc, item, band, j]), np.stack([doc, item, band - 1, j])], 1)
    rows = rows[:, np.lexsort(rows[::-1])]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
    rows = rows[:, new]  # a q-gram of the item counts once in a band
    edge = np.ones(rows.shape[1], bool)
    edge[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(0)
    starts = np.flatnonzero(edge)
    size = np.diff(np.append(starts, rows.shape[1]))
    kept = size >= ix.need[rows[1, starts]]
    for s in starts[kept]:
        d, k, b = (int(x) for x in rows[:3, s])
        e, m = int(ix.e[k]), int(ix.m[k])
        first = b * (e + 1) - int(ix.m.max())  # the band's first diagonal
        lo_, hi_ = max(int(offs[d]), first - e), min(int(offs[d + 1]), first + 2 * (e + 1) + m + e)
        got = align(ix.text[k], buf[lo_:hi_], first - lo_, 2 * (e + 1), e)
        if got and ((d, k) not in best or (got[2], got[0] + lo_) < (best[d, k][2], best[d, k][0])):
            best[d, k] = (got[0] + lo_, got[1] + lo_, got[2])


def align(item: np.ndarray, text: np.ndarray, diagonal: int, width: int, most: int) -> tuple[int, int, int] | None:
    """Start, end and edits of the whole item's best alignment in text on paths that begin on the diagonals [diagonal, diagonal + width), or None above most edits."""
    at = text.tobytes().find(item.tobytes())
    if at >= 0:
        return at, at + len(item), 0
    if not most:
        return None
    first, n = diagonal - most, width + 2 * most
    k = np.arange(n)
    inf = 1 << 20
    col = first + k  # place in text before row i's symbol: col + i
    cost = np.where((col >= 0) & (col <= len(text)), 0, inf)
    begin = col.copy()
    for i, ch in enumerate(item):
        at = col + i
        ok = (at >= 0) & (at < len(text))
        diff = np.where(ok, (text[np.clip(at, 0, len(text) - 1)] != ch).astype(np.int64), inf)
        sub = cost + diff
        gap = np.append(cost[1:], inf) + 1  # the item's symbol is missing in the text
        new = np.minimum(sub, gap)
        origin = np.where(sub <= gap, begin, np.append(begin[1:], 0))
        shifted = new - k
        low = np.minimum.accumulate(shifted)  # text symbols put in
        src = np.maximum.accumulate(np.where(shifted == low, k, 0))
        cost, begin = np.minimum(low + k, inf), origin[src]
        if cost.min() > most:
            return None
    j = int(cost.argmin())
    return (int(begin[j]), int(col[j] + len(item)), int(cost[j])) if cost[j] <= most else None


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of about limit bytes, by item_id; at most one block is on the driver at a time."""
    bounded_batches(benchmark.sparkSession)
    got: list[tuple[int, str]] = []
    size = 0
    rows = benchmark.filter("item_id is not null and text is not null").select("item_id", F.col("text").cast("string").alias("text")).distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        if got and size + len(r.text) > limit:
            yield got
            got, size = [], 0
        got.append((r.item_id, r.text))
        size += len(r.text)
    if got:
        yield got


def matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, item_id, start, end, edits: every document that holds a whole benchmark item within its edit budget.

    Texts are lower-cased and lose spaces and ASCII punctuation; start and end count the bytes left. By the q-gram lemma a region
    within e edits of an item of m symbols shares m - q + 1 - q*e of its q-grams, on diagonals at most e apart; shared q-grams are
    counted in bands of 2(e+1) diagonals that overlap by half, and bands that reach the bound are aligned. Whole texts are
    searched. Items shorter than q symbols have no q-gram: they are found where all their bytes stand, without edits. Null or empty texts match nothing; items
    that are null or have no letter or digit match nothing; of rows that share an item_id each is an item; a repeated document
    row gives its rows again; an empty benchmark gives no rows. doc_id and item_id may have any type. Columns of docs other than doc_id and text are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    kind, item_kind = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = StructType([StructField("doc_id", kind), StructField("item_id", item_kind), StructField("start", LongType()), StructField("end", LongType()), StructField("edits", IntegerType())])
    item_arrow = to_arrow_type(item_kind)
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = None
    for block in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(Index(block, q, rate))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ix = sent.value
            for b in batches:
                ids = b.column("doc_id").to_pylist()
                got = [(ids[c.lo + d], i, s, e, x) for c in chunks(pc.utf8_lower(b.column("text"))) for d, i, s, e, x in find(c, ix)]
                yield pa.record_batch([pa.array([g[i] for g in got], t) for i, t in enumerate((b.schema.field("doc_id").type, item_arrow, pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "item_id", "start", "end", "edits"])

        part = read.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item, all columns kept.

    The flag is set in the one pass over the texts, so no text is shuffled. Null or empty texts stay; extra columns may have any name.
    """
    return shielded(docs, lambda d: _clean(d, benchmark))


def _clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    from pyspark.sql.types import BooleanType, StructType

    for block in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(Index(block))
        schema = StructType([*docs.schema.fields]).add("_leak", BooleanType())

        def run(batches, sent=sent):
            ix = sent.value
            for b in batches:
                bad = np.zeros(b.num_rows, bool)
                for c in chunks(pc.utf8_lower(b.column("text"))):
                    for d, *_ in find(c, ix):
                        bad[c.lo + d] = True
                yield pa.record_batch([*b.columns, pa.array(bad)], names=[*b.schema.names, "_leak"])

        docs = docs.mapInArrow(run, schema).filter("not _leak").drop("_leak")
    return docs
