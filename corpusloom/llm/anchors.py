"""Shared by the two substring operators: runs of windows around a common anchor, which anchors repeat, and the way back to the texts.

A window is `size` consecutive symbols (words, or bytes). Its anchor is the leftmost of its k-grams with the least order hash, so equal windows
have equal anchors at equal places. Consecutive windows of one anchor form a run; a run's content is everything that its windows cover. Only runs
whose anchor occurs in other runs can hold repeated windows; a text has about 2 / (size - k + 2) runs a symbol. Contents are told apart by a 128-bit
BLAKE2 digest of their bytes (w0, w1), texts by doc_id and a 64-bit hash of doc_id and text (doc, key).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, materialise, release, sifted, skew_join
from .tokens import SPACE, Chunk, chunks, mix, prefix, span, words


@dataclass(frozen=True)
class Kind:
    unit: str  # word or byte
    size: int
    k: int

    def symbols(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Prefix sums over the symbols, the documents' boundaries in symbols, the bytes with one space after each word, and each symbol's place there."""
        if self.unit == "byte":
            return prefix(c.buf.astype(np.uint64) + np.uint64(1)), c.offs, c.buf, np.arange(len(c.buf) + 1)
        start, end, bound, h = words(c)
        size = end - start
        at = np.concatenate([[0], np.cumsum(size + 1)])
        raw = np.full(int(at[-1]), 32, np.uint8)
        word = np.repeat(np.arange(len(size)), size)
        raw[np.arange(len(word)) + word] = c.buf[~SPACE[c.buf]]
        return prefix(h), bound, raw, at


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, doc (0 for a null doc_id), key."""
    text = F.col("text").cast("string")
    doc = F.col("doc_id").cast("long")
    return docs.select("doc_id", text.alias("text"), F.coalesce(doc, F.lit(0)).alias("doc"), F.xxhash64(F.coalesce(doc.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).alias("key"))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def runs(pre: np.ndarray, bound: np.ndarray, size: int, k: int) -> dict[str, np.ndarray]:
    """Runs of all documents of a chunk; pre: prefix sums of its symbols, bound: the documents' n+1 boundaries in symbols.

    doc, at (first window, in the chunk), start (the same in the document), n (windows), anchor (hash of the k-gram), left (symbols from start to the anchor).
    """
    total = int(bound[-1])
    empty = {x: np.zeros(0, np.int64) for x in ("doc", "at", "start", "n", "anchor", "left")}
    if total < size:
        return empty
    at = np.arange(total - k + 1)
    gram = span(pre, at, at + k)
    order = (mix(gram ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    low = sliding_min(order, size - k + 1)  # of the window that starts here
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    n_doc = np.diff(bound)
    windows = np.maximum(n_doc - size + 1, 0)
    doc = np.repeat(np.arange(len(n_doc)), windows)
    if not len(doc):
        return empty
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + bound[:-1][doc]
    anchor = place[pos]
    new = np.ones(len(doc), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(doc)))
    start, anchor, doc = pos[first], anchor[first], doc[first]
    return {"doc": doc, "at": start, "start": start - bound[:-1][doc], "n": n, "anchor": gram[anchor].view(np.int64), "left": anchor - start}


def digests(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two int64 a row: BLAKE2 of raw[start:end]."""
    view = memoryview(np.ascontiguousarray(raw))
    out = b"".join([blake2b(view[a:z], digest_size=16).digest() for a, z in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def _run_rows(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, ids = b.column("key").to_numpy(), b.column("doc").to_numpy()
            for c in chunks(b.column("text")):
                pre, bound, raw, at = kind.symbols(c)
                r = runs(pre, bound, kind.size, kind.k)
                doc = r["doc"] + c.lo
                w = digests(raw, at[r["at"]], at[r["at"] + r["n"] + kind.size - 1])
                cols = [key[doc], ids[doc], r["start"].astype(np.int32), r["n"].astype(np.int32), r["left"].astype(np.int32), r["anchor"], w[:, 0], w[:, 1]]
                yield pa.record_batch([pa.array(x) for x in cols], names=["key", "doc", "start", "n", "left", "anchor", "w0", "w1"])

    return run


def meeting(source: DataFrame, kind: Kind, across_docs: bool) -> tuple[DataFrame, DataFrame]:
    """met: the runs (key, doc, start, w0, w1) of anchors that several runs have (of several documents); contents: one row for each distinct content of them.

    A content has its anchor, n and left, its first occurrence by (doc, key, start) as lead_*, the largest doc as last, its number of occurrences c, and the number of contents of its anchor m.
    """
    all_runs = materialise(source.mapInArrow(_run_rows(kind), "key long, doc long, start int, n int, left int, anchor long, w0 long, w1 long"))
    again = all_runs.groupBy("anchor").agg(F.count("*").alias("c"), F.min("doc").alias("d0"), F.max("doc").alias("d1"))
    again = materialise(again.filter("d0 < d1" if across_docs else "c > 1").select("anchor", "c"))
    met = materialise(skew_join(all_runs, again, ["anchor"], "c", all_runs.count()).drop("c"))
    drop(all_runs, again)
    release(source.sparkSession)
    first = F.min(F.struct("doc", "key", "start", "anchor", "n", "left")).alias("r")
    contents = met.groupBy("w0", "w1").agg(first, F.max("doc").alias("last"), F.count("*").alias("c"))
    r = [F.col(f"r.{x}").alias(f"lead_{x}") for x in ("doc", "key", "start")]
    contents = materialise(contents.select("w0", "w1", "r.anchor", "r.n", "r.left", *r, "last", "c"))
    many = materialise(contents.groupBy("anchor").agg(F.count("*").alias("m")))
    out = materialise(skew_join(contents, many, ["anchor"], "m", contents.count()))
    drop(contents, many)
    return met, out


def fetch(texts: DataFrame, wanted: DataFrame, fields: list[str], run, schema: str) -> DataFrame:
    """mapInArrow(run) over (text, want): each text that `wanted` names by (doc, key) once, with the structs `fields` of its rows. One text's rows meet in one task."""
    want = wanted.groupBy(F.col("doc").alias("_d"), F.col("key").alias("_k")).agg(F.collect_list(F.struct(*fields)).alias("want"))
    some = sifted(texts, wanted.select("doc", "key"), ["doc", "key"]).filter("_maybe").drop("_maybe")
    one = some.join(want, (F.col("doc") == F.col("_d")) & (F.col("key") == F.col("_k"))).dropDuplicates(["doc", "key"]).select("text", "want")
    return one.mapInArrow(run, schema)


def wants(b: pa.RecordBatch, kind: Kind) -> Iterator[tuple]:
    """For each chunk of a batch of fetch(): symbols(), the wanted structs' fields as arrays, and the document of each in the chunk."""
    want = b.column("want")
    offs = want.offsets.to_numpy()
    flat = want.flatten()
    f = {flat.type.field(i).name: flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)}
    base = int(offs[0])
    for c in chunks(b.column("text")):
        sl = slice(int(offs[c.lo]) - base, int(offs[c.lo + c.n]) - base)
        yield *kind.symbols(c), {x: y[sl] for x, y in f.items()}, np.repeat(np.arange(c.n), np.diff(offs[c.lo : c.lo + c.n + 1]))


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open spans; spans that touch join."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(start)) - 1]


def _cut(kind: Kind):
    from hashlib import sha256

    def holds(raw: bytes, at, x: dict) -> bool:
        return x["sha"] is None or sha256(raw[int(at[x["start"]]) : int(at[x["end"]])]).digest() == x["sha"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("spans").to_pylist()
            cols: list[list] = [[] for _ in range(5)]
            for c in chunks(b.column("text")):
                _, bound, buf, places = kind.symbols(c)
                for i in range(c.n):
                    lo, hi = int(bound[i]), int(bound[i + 1])
                    at = places[lo : hi + 1] - places[lo]
                    raw = buf[places[lo] : places[hi]].tobytes()
                    spans = [x for x in lists[c.lo + i] or () if holds(raw, at, x)]
                    a, z = merge_spans(np.array([x["start"] for x in spans], np.int64), np.array([x["end"] for x in spans], np.int64))
                    parts, here = [], 0
                    for p, q in zip(a.tolist(), z.tolist(), strict=True):
                        parts.append(raw[here : at[p]])
                        here = at[q]
                    kept = b"".join([*parts, raw[here:]])
                    row = (hi - lo, int((z - a).sum()), len(a), [{"start": int(p), "end": int(q)} for p, q in zip(a, z, strict=True)], kept[:-1] if kind.unit == "word" and kept else kept)
                    for col, v in zip(cols, row, strict=True):
                        col.append(v)
            kinds = [pa.int64()] * 3 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            yield pa.record_batch([b.column("doc_id"), *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], names=["doc_id", "n", "n_removed", "n_spans", "spans", "kept"])

    return run


def cut(docs: DataFrame, kind: Kind, found: DataFrame) -> DataFrame:
    """doc_id, n, n_removed, n_spans, spans (start, end in symbols), kept (bytes) for every row of docs.

    found has rows (doc, key, start, end, sha): spans to remove, in symbols; one whose sha is not that of the bytes there is left.
    """
    lists = found.groupBy(F.col("doc").alias("_d"), F.col("key").alias("_k")).agg(F.collect_list(F.struct("start", "end", "sha")).alias("spans"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"
    texts = sifted(keyed(docs), found.select("doc", "key"), ["doc", "key"])
    both = texts.filter("_maybe").join(lists, (F.col("doc") == F.col("_d")) & (F.col("key") == F.col("_k")), "left").select("doc_id", "text", "spans")
    clear = texts.filter("not _maybe").select("doc_id", "text", F.lit(None).cast(both.schema["spans"].dataType).alias("spans"))
    return clear.mapInArrow(_cut(kind), schema).unionByName(both.mapInArrow(_cut(kind), schema))
