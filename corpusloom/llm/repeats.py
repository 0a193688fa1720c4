"""Removal of repeated substrings: of words by De Bruijn compaction (graph.py), of bytes by column-wise construction (columns.py).

Both start alike, so that no occurrence of a window is shuffled alone (anchors.py): one pass cuts every text into runs of windows around a common anchor,
and only runs whose anchor repeats go on. Copies of a run collapse into one content before anything is fetched, and each content's symbols are read
once, at one source coordinate, however many copies it has. Verdicts on contents go back to all occurrences by joins that broadcast hot contents.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columns
from .anchors import Kind, cut, digests, fetch, keyed, meeting, wants
from .scratch import drop, materialise, release, skew_join
from .tokens import span

#: Distinct contents of one anchor that meet in a block; those of larger ones meet window by window.
LIMIT = 20_000
#: Bytes of content that a block of anchors gathers before it is worked on.
BLOCK_BYTES = 1 << 20


# words: the De Bruijn graph


def _edges(kind: Kind):
    """The edges of each wanted content, in order: an edge is a window of `size` words and joins the nodes of its first and its last size - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pre, bound, _, _, f, doc in wants(b, kind):
                n = f["n"].astype(np.int64)
                owner = np.repeat(np.arange(len(n)), n)
                off = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                at = bound[doc][owner] + f["start"][owner] + off
                edge = span(pre, at, at + kind.size).view(np.int64)
                first, final = off == 0, off == n[owner] - 1
                before, after = np.roll(edge, 1), np.roll(edge, -1)
                before[first] = after[final] = 0  # the path goes on under another anchor, or ends
                cols = [*(f[x][owner] for x in ("w0", "w1", "anchor")), off.astype(np.int32), edge, before, after, *(f[x][owner] for x in ("doc", "key")), (f["start"][owner] + off).astype(np.int32), f["last"][owner]]
                yield pa.record_batch([pa.array(x) for x in cols], names=[x.split()[0] for x in _EDGE.split(", ")])

    return run


_EDGE = "w0 long, w1 long, anchor long, off int, edge long, before long, after long, doc long, key long, pos int, last long"


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of rows (content, off, lead, branch) that arrive sorted by content and off: nonbranching paths of edges whose first places are one path too."""
    for b in batches:
        f = {x: b.column(x).to_numpy(zero_copy_only=False) for x in b.schema.names}
        if not b.num_rows:
            continue
        new = np.ones(b.num_rows, bool)
        same = ~f["joins"][1:] & ~f["forks"][:-1]
        for x in ("w0", "w1", "lead_doc", "lead_key"):
            same &= f[x][1:] == f[x][:-1]
        for x in ("off", "lead_pos"):
            same &= f[x][1:] == f[x][:-1] + 1
        new[1:] = ~same
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, b.num_rows)).astype(np.int32)
        cols = [b.column(x).take(pa.array(at)) for x in ("w0", "w1", "off")] + [pa.array(n)] + [b.column(x).take(pa.array(at)) for x in ("lead_doc", "lead_key", "lead_pos", "c")]
        yield pa.record_batch(cols, names=["w0", "w1", "off", "len", "lead_doc", "lead_key", "lead_pos", "c"])


def compact(texts: DataFrame, contents: DataFrame, kind: Kind) -> DataFrame:
    """w0, w1, off, len, lead_doc, lead_key, lead_pos, c: the repeated paths of each content: len edges from off on, first seen at (lead_doc, lead_key, lead_pos).

    An anchor's only content is a path without branches. Where an anchor has several, their edges are counted by the anchor and the edge: an edge repeats
    if its least document is below its last one, its left node joins paths if different edges come before it, and its right node forks if different
    ones follow. Joins carry this back to the contents, whose edges merge to paths up to the next node that joins or forks.
    """
    wanted = contents.filter("m > 1").select("w0", "w1", "anchor", F.col("lead_doc").alias("doc"), F.col("lead_key").alias("key"), F.col("lead_start").alias("start"), "n", "last")
    edges = materialise(fetch(texts, wanted, ["w0", "w1", "anchor", "doc", "key", "start", "n", "last"], _edges(kind), _EDGE))
    by = edges.groupBy("anchor", "edge").agg(
        F.min(F.struct("doc", "key", "pos")).alias("lead"), F.max("last").alias("last"), F.count("*").alias("k"),
        (F.min("before") != F.max("before")).alias("joins"), (F.min("after") != F.max("after")).alias("forks"),
    )
    graph = materialise(by.filter("lead.doc < last").select("anchor", "edge", F.col("lead.doc").alias("lead_doc"), F.col("lead.key").alias("lead_key"), F.col("lead.pos").alias("lead_pos"), "k", "joins", "forks"))
    back = skew_join(edges.select("w0", "w1", "off", "anchor", "edge"), graph, ["anchor", "edge"], "k", edges.count())
    counted = contents.filter("m > 1").select("w0", "w1", "c")
    rows = back.drop("anchor", "edge", "k").join(counted, ["w0", "w1"]).sortWithinPartitions("w0", "w1", "off")
    paths = rows.mapInArrow(_paths, "w0 long, w1 long, off int, len int, lead_doc long, lead_key long, lead_pos int, c long")
    single = contents.filter("m = 1 and lead_doc < last").select("w0", "w1", F.lit(0).alias("off"), F.col("n").alias("len"), "lead_doc", "lead_key", F.col("lead_start").alias("lead_pos"), "c")
    out = materialise(single.unionByName(paths))
    drop(edges, graph)
    return out


def _long_spans(size: int):
    """Paths that arrive sorted by text, first text, line (first place less place) and start, merged where they touch: (doc, key, start, end, lead_doc, lead_key, lead_start) in words.

    A span cut in two by the end of a batch is two spans, each verified for itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            f = {x: b.column(x).to_numpy() for x in b.schema.names}
            new = np.zeros(b.num_rows, bool)
            new[0] = True
            for x in ("doc", "key", "lead_doc", "lead_key", "line"):
                new[1:] |= f[x][1:] != f[x][:-1]
            # the furthest end so far on the same line: lines are set apart by more than any length
            end = (f["start"] + f["len"]).astype(np.int64)
            far = np.maximum.accumulate(end + np.cumsum(new) * (1 << 33)) - np.cumsum(new) * (1 << 33)
            new[1:] |= f["start"][1:] > far[:-1]
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(new)) - 1
            start = f["start"][at]
            cols = [f["doc"][at], f["key"][at], start, (far[last] + size - 1).astype(np.int32), f["lead_doc"][at], f["lead_key"][at], (start + f["line"][at]).astype(np.int32)]
            yield pa.record_batch([pa.array(x) for x in cols], names=["doc", "key", "start", "end", "lead_doc", "lead_key", "lead_start"])

    return run


def _sha(kind: Kind):
    """SHA-256 of the wanted spans' words, each followed by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, bound, raw, at, f, doc in wants(b, kind):
                lo, hi = at[bound[doc] + f["lead_start"]], at[bound[doc] + f["lead_start"] + f["len"]]
                sha = [sha256(raw[x:y].tobytes()).digest() for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                yield pa.record_batch([*(pa.array(f[x]) for x in ("doc", "key", "lead_start", "len", "k")), pa.array(sha, pa.binary())], names=["lead_doc", "lead_key", "lead_start", "len", "k", "sha"])

    return run


def verified(texts: DataFrame, spans: DataFrame, kind: Kind) -> DataFrame:
    """doc, key, start, end, sha: each span with the SHA-256 of the words at its first place, against which cut() holds the span's own words."""
    spans = spans.withColumn("len", F.col("end") - F.col("start"))
    on = ["lead_doc", "lead_key", "lead_start", "len"]
    asked = materialise(spans.groupBy(*on).agg(F.count("*").alias("k")))
    wanted = asked.select(F.col("lead_doc").alias("doc"), F.col("lead_key").alias("key"), "lead_start", "len", "k")
    sha = materialise(fetch(texts, wanted, ["doc", "key", "lead_start", "len", "k"], _sha(kind), "lead_doc long, lead_key long, lead_start int, len int, k long, sha binary"))
    return skew_join(spans, sha, on, "k", spans.count()).select("doc", "key", "start", "end", "sha")


def remove_words(docs: DataFrame, size: int = 50, k: int = 12) -> DataFrame:
    """Removes each word covered by a window of `size` words whose sequence also starts in a document of a smaller doc_id.

    Words are [^\\x20\\x09-\\x0D]+, unchanged; kept has the words left, joined by one space. Windows are judged on the input. They are the edges of a De Bruijn
    graph, partitioned by anchors, whose repeated nonbranching paths are compacted by joins, merged to long spans and verified at their source
    coordinates: a span is removed if the SHA-256 of its words is that of the words at its first place.

    Null or empty text: no words, nothing removed. Null doc_id: neither removes nor loses words. Rows of one doc_id don't remove each other's words,
    repeated rows have equal results. Empty table: no rows. Other columns are not read.
    """
    kind = Kind("word", size, k)
    texts = keyed(docs.filter("doc_id is not null")).drop("doc_id")
    met, contents = meeting(texts, kind, across_docs=True)
    paths = compact(texts, contents, kind)
    found = skew_join(met, paths, ["w0", "w1"], "c", met.count()).filter("doc > lead_doc")
    found = found.withColumn("start", F.col("start") + F.col("off")).select("doc", "key", "start", "len", "lead_doc", "lead_key", (F.col("lead_pos") - F.col("start")).alias("line"))
    found = found.repartition("doc", "key").sortWithinPartitions("doc", "key", "lead_doc", "lead_key", "line", "start")
    spans = materialise(found.mapInArrow(_long_spans(size), "doc long, key long, start int, end int, lead_doc long, lead_key long, lead_start int"))
    drop(met, contents, paths)
    release(docs.sparkSession)
    return cut(docs, kind, materialise(verified(texts, spans, kind)))


# bytes: column-wise construction


def _contents(kind: Kind):
    """The bytes of each wanted content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, bound, raw, at, f, doc in wants(b, kind):
                lo = at[bound[doc] + f["start"]]
                out = [raw[x : x + n + kind.size - 1].tobytes() for x, n in zip(lo.tolist(), f["n"].tolist(), strict=True)]
                yield pa.record_batch([*(pa.array(f[x]) for x in ("anchor", "w0", "w1", "n", "left", "c", "m")), pa.array(out, pa.binary())], names=["anchor", "w0", "w1", "n", "left", "c", "m", "content"])

    return run


_HEADER = np.dtype([("w0", "i8"), ("w1", "i8"), ("first", "i4"), ("n", "i4"), ("c", "i8")])


def _write_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column files of blocks of whole anchors, whose rows arrive sorted by anchor."""
    part, number = TaskContext.get().partitionId(), 0

    def out(rows):
        left = np.array([r[4] for r in rows], np.int64)
        head = np.zeros(len(rows), _HEADER)
        head["w0"], head["w1"], head["n"], head["c"] = ([r[i] for r in rows] for i in (1, 2, 3, 5))
        head["first"] = left.max() - left
        group = np.unique(np.array([r[0] for r in rows]), return_inverse=True)[1]
        yield from columns.write(f"{part}-{number}", head.tobytes(), [r[6] for r in rows], left, group)

    rows, held = [], 0
    for b in batches:
        for r in zip(*(b.column(x).to_pylist() for x in ("anchor", "w0", "w1", "n", "left", "c", "content")), strict=True):
            if rows and held >= BLOCK_BYTES and r[0] != rows[-1][0]:
                yield from out(rows)
                rows, held, number = [], 0, number + 1
            rows.append(r)
            held += len(r[6])
    if rows:
        yield from out(rows)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """w0, w1, off, len, c of the repeated windows of contents that occur once, from rows (block, col, hit) sorted by block and column."""

    def out(head, hits):
        cols: list[list] = [[] for _ in range(5)]
        if hits:
            seen = np.zeros((len(head), max(hits) + 1), bool)
            for j, bits in hits.items():
                got = np.unpackbits(np.frombuffer(bits, np.uint8))[: len(head)].view(bool)
                seen[: len(got), j] = got
            for h, row in zip(head.tolist(), seen, strict=True):
                w0, w1, first, n, c = h
                if c > 1:
                    continue  # all of it repeats
                edge = np.flatnonzero(np.diff(np.concatenate([[0], row[first : first + n].astype(np.int8), [0]])))
                for a, z in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
                    for col, v in zip(cols, (w0, w1, a, z - a, c), strict=True):
                        col.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        return pa.record_batch([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["w0", "w1", "off", "len", "c"])

    block, head, hits = None, None, {}
    for b in batches:
        for x, j, hit in zip(*(b.column(n).to_pylist() for n in ("block", "col", "hit")), strict=True):
            if x != block:
                if block is not None:
                    yield out(head, hits)
                block, head, hits = x, np.frombuffer(hit, _HEADER), {}
            else:
                hits[j] = hit
    if block is not None:
        yield out(head, hits)


def _windows(kind: Kind):
    """Every window of contents over the limit, by a 128-bit digest of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w0, w1, n, c, content in zip(*(b.column(x).to_pylist() for x in ("w0", "w1", "n", "c", "content")), strict=True):
                at = np.arange(n)
                d = digests(np.frombuffer(content, np.uint8), at, at + kind.size)
                same = [pa.array(np.full(n, x)) for x in (w0, w1, c)]
                yield pa.record_batch([*same, pa.array(at.astype(np.int32)), pa.array(d[:, 0]), pa.array(d[:, 1])], names=["w0", "w1", "c", "off", "d0", "d1"])

    return run


def repeated_bytes(texts: DataFrame, contents: DataFrame, kind: Kind, limit: int = LIMIT) -> DataFrame:
    """w0, w1, off, len, c: the stretches of windows of each content that occur elsewhere too. All windows of a content that occurs twice do."""
    whole = contents.filter("c > 1").select("w0", "w1", F.lit(0).alias("off"), F.col("n").alias("len"), "c")
    fields = ["anchor", "w0", "w1", "start", "n", "left", "c", "m"]
    wanted = contents.filter("m > 1").select("anchor", "w0", "w1", F.col("lead_doc").alias("doc"), F.col("lead_key").alias("key"), F.col("lead_start").alias("start"), "n", "left", "c", "m")
    kept = materialise(fetch(texts, wanted, fields, _contents(kind), "anchor long, w0 long, w1 long, n int, left int, c long, m long, content binary"))
    release(texts.sparkSession)
    files = materialise(kept.filter(F.col("m") <= limit).repartition("anchor").sortWithinPartitions("anchor", "w0", "w1").mapInArrow(_write_blocks, columns.FILES))
    hits = files.select("block", "col", "docs", "lcp").mapInArrow(columns.verdicts(kind.size), "block string, col int, hit binary")
    out = whole.unionByName(hits.repartition("block").sortWithinPartitions("block", "col").mapInArrow(_stretches, "w0 long, w1 long, off int, len int, c long"))
    hot = kept.filter(F.col("m") > limit)
    if not hot.isEmpty():
        window = materialise(hot.mapInArrow(_windows(kind), "w0 long, w1 long, c long, off int, d0 long, d1 long"))
        by = window.groupBy("d0", "d1").agg(F.sum("c").alias("total"), F.count("*").alias("k"))
        by = materialise(by.filter("total > 1").select("d0", "d1", "k"))
        out = out.unionByName(skew_join(window.filter("c = 1"), by, ["d0", "d1"], "k", window.count()).select("w0", "w1", "off", F.lit(1).alias("len"), "c"))
    out = materialise(out)
    drop(kept, files)
    return out


def remove_bytes(docs: DataFrame, size: int = 400, k: int = 32, limit: int = LIMIT) -> DataFrame:
    """Removes each UTF-8 byte covered by a string of `size` bytes that also starts anywhere else in the table, overlapping itself included.

    kept has the bytes left, which may not be valid UTF-8. Strings are judged on the input and never cross rows. Contents of one anchor are compared
    by the column-wise construction, byte by byte; those of an anchor with over `limit` distinct contents by a 128-bit digest of each window.

    Null or empty text: no bytes, nothing removed. A repeated row is another place, so both lose all of a text of `size` bytes or more. Null doc_id: as any
    other. Empty table: no rows. Other columns are not read.
    """
    kind = Kind("byte", size, k)
    texts = keyed(docs).drop("doc_id")
    met, contents = meeting(texts, kind, across_docs=False)
    verdict = repeated_bytes(texts, contents, kind, limit)
    found = skew_join(met, verdict, ["w0", "w1"], "c", met.count())
    start = F.col("start") + F.col("off")
    spans = materialise(found.select("doc", "key", start.alias("start"), (start + F.col("len") + size - 1).alias("end"), F.lit(None).cast("binary").alias("sha")))
    drop(met, contents, verdict)
    release(docs.sparkSession)
    return cut(docs, kind, spans)
