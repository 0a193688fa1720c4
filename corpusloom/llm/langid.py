"""Language ID by language-bitmask n-gram filters: bit-sliced Bloom filters that return all languages holding an n-gram."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Chunk, chunks, mix

#: Cells of the bit-sliced filter (each has one bit per language) and probes per n-gram.
CELLS = 1 << 20
PROBES = 3
_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


def ngrams(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the 3- and 4-byte grams of lower-cased text (anything but letters reads as a space), and n+1 boundaries by document.

    Each text has a space before and after it; 3-grams leave the top byte of the key 0. Grams of two or more spaces in a row are left out.
    """
    n = c.n
    size = np.diff(c.offs)
    offs = np.concatenate([[0], np.cumsum(size + 2)])
    buf = np.full(offs[-1] + 4, 32, np.uint8)
    if len(c.buf):
        at = np.arange(len(c.buf)) + np.repeat(2 * np.arange(n) + 1, size)
        buf[at] = _CLEAN[c.buf]
    b = buf.astype(np.uint32)
    three = b[:-2] | (b[1:-1] << 8) | (b[2:] << 16)
    four = three[:-1] | (b[3:] << 24)
    space = buf == 32
    gap = space[:-1] & space[1:]
    pos = np.arange(offs[-1])
    end = np.repeat(offs[1:], size + 2)
    ok3 = (pos + 3 <= end) & ~gap[pos] & ~gap[pos + 1]
    ok4 = ok3 & (pos + 4 <= end) & ~gap[pos + 2]
    keys = np.empty((len(pos), 2), np.uint32)
    keys[:, 0], keys[:, 1] = three[: len(pos)], four[: len(pos)]
    ok = np.stack([ok3, ok4], 1)
    count = np.concatenate([[0], np.cumsum(ok.sum(1))])
    return keys[ok], count[offs]


def learn(docs: DataFrame, min_rate: float = 2e-6, least_share: float = 0.05) -> tuple[list[str], np.ndarray]:
    """Languages in code point order and the filter, from all rows of docs (text, lang) with a lang.

    An n-gram counts as one of a language if its rate there is min_rate at least and least_share of its highest rate in any
    language (with 0 and 0, every n-gram of the language's texts does). The filter has CELLS cells of one 64-bit word per 64 languages; its slices are filled
    in the tasks, and CELLS / 8 bytes a language reach the driver. Repeated rows count each time; null texts and rows without a lang teach nothing; a lang
    without texts is learnt with no n-gram; an empty table gives no languages. Other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            lang = b.column("lang").to_pylist()
            for c in chunks(pc.utf8_lower(b.column("text")), 2 << 20):
                keys, bound = ngrams(c)
                of = lang[c.lo : c.lo + c.n]
                for name in sorted(set(of)):
                    mine = np.repeat(np.array([x == name for x in of]), np.diff(bound))
                    k, v = np.unique(keys[mine], return_counts=True)
                    if name in held:
                        k2, v2 = held[name]
                        allk = np.concatenate([k, k2])
                        k, inv = np.unique(allk, return_inverse=True)
                        v = np.bincount(inv, np.concatenate([v, v2])).astype(np.int64)
                    held[name] = (k, v)
        for name, (k, v) in held.items():
            yield pa.record_batch([pa.array([name] * len(k), pa.string()), pa.array(k.astype(np.int64)), pa.array(v.astype(np.int64))], names=["lang", "key", "n"])

    seen = docs.filter("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = seen.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    from .scratch import materialise

    counts = materialise(counts)
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row per language
    known = {r.lang for r in seen.select("lang").distinct().collect()}
    langs = sorted(known)
    cells = np.zeros((CELLS, max(1, -(-len(langs) // 64))), np.uint64)
    if not totals:
        return langs, cells
    rate = F.col("n") / F.element_at(F.create_map(*[x for k, v in totals.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("lang"))
    rated = counts.withColumn("r", rate).filter(F.col("r") >= min_rate)
    # each language keeps at most 1/min_rate n-grams, since their rates add up to 1
    top = rated.groupBy("key").agg(F.max("r").alias("top"))
    kept = rated.join(top, "key").filter(F.col("r") >= least_share * F.col("top")).select("lang", "key")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(_cells(b.column("key").to_numpy().view(np.uint64))) + 1  # buckets count from 1
            row = pa.array(np.tile(np.arange(b.num_rows), PROBES))
            yield pa.record_batch([b.column("lang").take(row), pa.array(at)], names=["lang", "at"])

    bits = kept.mapInArrow(places, "lang string, at long").groupBy("lang", F.bitmap_bucket_number("at").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    number = {name: i for i, name in enumerate(langs)}
    for r in bits.toLocalIterator():  # CELLS / 8 bytes a language, which is the filter itself
        i, slice_ = number[r.lang], np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
        at = (r.page - 1) * len(slice_)
        cells[at : at + len(slice_), i // 64] |= slice_[: CELLS - at].astype(np.uint64) << np.uint64(i % 64)
    return langs, cells


def _cells(keys: np.ndarray) -> list[np.ndarray]:
    h = mix(keys.astype(np.uint64) + np.uint64(0x51ED27))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) % np.uint64(CELLS)).astype(np.int64) for i in range(PROBES)]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text).

    The filter answers each n-gram with a bitmask of languages; the count of a language's bits over the whole text, corrected for its filter's
    false positive rate f as (share - f) / (1 - f), decides, ties to the first language in code point order. score is the winner's part
    of it and the runner-up's together. Texts that are null or have no letter, and all texts if nothing was learnt: `und`, score 0. Whole texts are read, however long; a
    repeated row gives its row again; an empty table gives no rows; other columns are not read.
    """
    langs, cells = model
    fill = np.array([float(((cells[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(langs))])
    fp = np.minimum(fill**PROBES, 0.999)
    sent = docs.sparkSession.sparkContext.broadcast((langs, cells, fp))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, cells, fp = sent.value
        for b in batches:
            pred: list[str] = []
            score: list[float] = []
            text = b.column("text")
            for c in chunks(pc.utf8_lower(text), 1 << 20):
                keys, bound = ngrams(c)
                n = np.maximum(np.diff(bound), 1)
                share = np.zeros((c.n, len(langs)))
                at = _cells(keys)
                for w in range(cells.shape[1]):
                    mask = cells[at[0], w] & cells[at[1], w] & cells[at[2], w]
                    for i in range(w * 64, min(len(langs), w * 64 + 64)):
                        run_ = np.concatenate([[0], np.cumsum((mask >> np.uint64(i % 64)) & np.uint64(1), dtype=np.int64)])
                        share[:, i] = (run_[bound[1:]] - run_[bound[:-1]]) / n
                fixed = np.clip((share - fp) / (1 - fp), 0, 1)
                ascii_letters = np.concatenate([[0], np.cumsum((c.buf >= 97) & (c.buf <= 122))])
                lettered = ascii_letters[c.offs[1:]] > ascii_letters[c.offs[:-1]]
                for i in range(c.n):
                    if not langs or not (lettered[i] or any(map(str.isalpha, c.text(i).decode("utf-8", "replace")))):
                        pred.append("und")
                        score.append(0.0)
                        continue
                    best = int(fixed[i].argmax())
                    rest = np.delete(fixed[i], best)
                    top, second = fixed[i, best], rest.max() if len(rest) else 0.0
                    pred.append(langs[best])
                    score.append(float(top / (top + second)) if top > 0 else 0.0)
            yield pa.record_batch([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
