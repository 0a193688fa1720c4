"""Personal data: fixed patterns, and terms that disclose the protected values around them (information-theoretic sanitisation)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .scratch import bit_filter, in_filter, materialise, shielded, skew_join
from .tokens import Chunk, chunks, words

# fixed values: the kinds in their order and their patterns
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"

#: A term has to name the entity with this probability at least, to have more than IC(entity) / ALPHA of pointwise mutual information with it, and chance has to
#: explain as many meetings with a probability of at most 2 ** -EVIDENCE over the number of documents.
CERTAINTY, ALPHA, EVIDENCE = 0.5, 1.5, 10.0
#: Pairs up to this many (16 bytes each, as two sorted arrays) are sent to every task; above it, they reach their documents by joins.
MAX_SENT = 1_000_000
_FILTER = 1 << 23


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) in code points, by start, then kind. Matches that fail their test are dropped and not tried again."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def value_of(text: str, kind: int, start: int, end: int) -> int:
    """Identity of a protected value: its kind with its text, for cards and phones its digits."""
    v = text[start:end]
    return _hash(f"{KINDS[kind]}:" + (re.sub(r"[^0-9]", "", v) if kind > 1 else v.lower()))


def _kind(k: int) -> int:
    return _hash(f"any {KINDS[k]}")


def entities(text: str, spans: list[tuple[int, int, int]]) -> set[int]:
    """What a text's spans reveal: their values, and their kinds."""
    return {value_of(text, k, s, e) for s, k, e in spans} | {_kind(k) for _, k, _ in spans}


def _hashes(text: str) -> np.ndarray:
    """Hashes of the words in their order, as tokens.words() gives them."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return words(Chunk(b, np.array([0, len(b)]), 0))[3].view(np.int64)


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Distinct hashes of the words of the whole text that overlap no span."""
    parts, at = [], 0
    for s, _, e in spans:
        while s > at and not text[s - 1] in SPACES:
            s -= 1
        while e < len(text) and not text[e] in SPACES:
            e += 1
        parts.append(text[at : max(at, s)])
        at = max(at, e)
    return np.unique(_hashes(" ".join([*parts, text[at:]])))


def disclosing(docs: DataFrame) -> DataFrame:
    """value long, term long (hashes): the terms that disclose a protected entity, which is a value or a kind of values.

    They meet in a text if it holds both, anywhere. n(entity, term) and n(entity) count distinct texts, n(term) and N all documents (copies count there, so a
    copied text cannot make its words look telling). PMI = log2(N n(entity, term) / (n(entity) n(term))), IC = log2(N / n(entity)),
    q = n(entity, term) / n(term), p = n(entity) / N. A term discloses the entity if PMI > IC / ALPHA, q >= CERTAINTY, and the meetings are no chance: n(term)
    KL(q | p) >= log2(N) + EVIDENCE bits. One meeting never is evidence enough, two are from some ten thousand documents on.
    """
    read = docs.filter("text is not null").select(F.col("text").cast("string").alias("text"))

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            doc, what, terms = [], [], []
            for t in b.column("text").to_pylist():
                spans = base_spans(t)
                if spans:
                    doc.append(_hash(t)), what.append(list(entities(t, spans))), terms.append(terms_of(t, spans))
            yield pa.record_batch([pa.array(doc, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (what, terms))], names=["doc", "entities", "terms"])

    held = materialise(read.mapInArrow(holding, "doc long, entities array<long>, terms array<long>").dropDuplicates(["doc"]))
    own = held.select(F.explode("entities").alias("value")).groupBy("value").agg(F.count("*").alias("n_value")).filter("n_value > 1")
    own = materialise(own)  # one text is no evidence
    met = materialise(held.select("doc", F.explode("entities").alias("value")))
    met = skew_join(met, own, ["value"], "n_value", met.count())
    met = met.select(F.col("doc").alias("_d"), "value")
    of = met.groupBy("_d").agg(F.collect_list("value").alias("values"))
    pairs = held.join(of, F.col("doc") == F.col("_d")).select("values", F.explode("terms").alias("term")).select("term", F.explode("values").alias("value"))
    candidates = materialise(pairs.groupBy("value", "term").agg(F.count("*").alias("n")).filter("n > 1"))
    terms = candidates.select("term").distinct()

    # which terms to count: a filter of _FILTER bits (1 MB) whatever their number; false positives go in the join
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(terms, _FILTER))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column("text")):
                _, _, bound, h = words(c)
                doc = np.repeat(np.arange(c.n), np.diff(bound))
                hit = in_filter(sent.value, h)
                h, doc = h[hit], doc[hit]
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                t, n = np.unique(h[new], return_counts=True)
                yield pa.record_batch([pa.array(t.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    freq = read.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    total = float(max(read.count(), 1))
    df = candidates.join(freq.withColumnRenamed("term", "_t"), F.col("term") == F.col("_t")).join(own.withColumnRenamed("value", "_v"), F.col("value") == F.col("_v"))
    q, p = F.least(F.col("n") / F.col("n_term"), F.lit(1.0)), F.least(F.col("n_value") / total, F.lit(1.0))
    pmi, ic = F.log2(q / p), -F.log2(p)
    missed = F.col("n_term") - F.col("n")
    bits_ = F.col("n") * pmi + F.when((missed > 0) & (p < 1) & (q < 1), missed * F.log2((1 - q) / (1 - p))).otherwise(0.0)
    keep = (pmi > ic / ALPHA) & (q >= CERTAINTY) & (bits_ >= float(np.log2(total)) + EVIDENCE)
    return materialise(df.filter(keep).select("value", "term").distinct())


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """Fewer rows at a time as Python strings."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def _spans_of(text: str, wanted) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans and the spans of disclosing terms; wanted(entities) -> sorted terms."""
    spans = base_spans(text)
    if not spans:
        return spans, []
    terms = wanted(entities(text, spans))
    if not len(terms):
        return spans, []
    hit = np.flatnonzero(np.isin(_hashes(text), terms)).tolist()
    if not hit:
        return spans, []
    places = [m.span() for m in WORD.finditer(text)]
    return spans, [places[i] for i in hit if not any(places[i][0] < e and s < places[i][1] for s, _, e in spans)]


def _with_pairs(docs: DataFrame, pairs: DataFrame):
    """docs with a column _pairs (terms; null unless the pairs go by join), and the pairs to send, as arrays sorted by entity and term (None then)."""
    n = pairs.count()
    if n <= MAX_SENT:
        got = pairs.sort("value", "term").toPandas()  # at most MAX_SENT rows
        return docs.withColumn("_pairs", F.lit(None).cast("array<bigint>")), (got.value.to_numpy(np.int64), got.term.to_numpy(np.int64))
    keyed = docs.withColumn("_row", F.concat_ws(":", F.xxhash64("text"), F.xxhash64(F.lit(1), "text")))

    def values(batches):
        for b in batches:
            row, val = [], []
            for i, t in zip(b.column("_row").to_pylist(), b.column("text").to_pylist(), strict=True):
                for v in entities(t or "", base_spans(t or "")):
                    row.append(i), val.append(v)
            yield pa.record_batch([pa.array(row, pa.string()), pa.array(val, pa.int64())], names=["_row", "value"])

    own = keyed.select("_row", F.col("text").cast("string").alias("text")).mapInArrow(values, "_row string, value long").distinct()
    got = own.join(pairs, "value").groupBy(F.col("_row").alias("_r")).agg(F.collect_set("term").alias("_pairs"))
    return keyed.join(got, F.col("_row") == F.col("_r"), "left").drop("_row", "_r"), None


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term for every row of docs (doc_id, text).

    spans lists kind:start:end in code points, end exclusive, by start, then kind (email, ip, card, phone, term), comma-joined; base_sha256
    hashes the list without terms. Every whole text is read; null reads as empty and has no spans. A repeated row gives its row again, and counts once
    where terms are learnt. Empty table: no rows. Other columns are not read, whatever their names.
    """
    pairs = disclosing(docs)
    ready, held = _with_pairs(docs.select("doc_id", F.col("text").cast("string").alias("text")), pairs)
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in _slices(batches):
            cols: list[list] = [[] for _ in range(7)]
            for t, own in zip(b.column("text").to_pylist(), b.column("_pairs").to_pylist(), strict=True):
                spans, terms = _spans_of(t or "", _wanted(known, own))
                for k in range(4):
                    cols[k].append(sum(1 for x in spans if x[1] == k))
                base = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
                cols[4].append(hashlib.sha256(base.encode()).hexdigest())
                both = sorted([*spans, *((s, 4, e) for s, e in terms)])
                cols[5].append(",".join(f"{(*KINDS, 'term')[k]}:{s}:{e}" for s, k, e in both))
                cols[6].append(len(terms))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.record_batch([b.column("doc_id"), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long"
    return ready.mapInArrow(run, schema)


def _wanted(known, own):
    if known is None:
        return lambda what: np.array(own or [], np.int64)
    value, term = known

    def look(what) -> np.ndarray:
        lo, hi = np.searchsorted(value, sorted(what), "left"), np.searchsorted(value, sorted(what), "right")
        return np.concatenate([np.zeros(0, np.int64), *(term[a:z] for a, z in zip(lo, hi, strict=True) if z > a)])

    return look


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with all columns; in text, every span is generalised to its kind in angle brackets (<email>, <ip>, <card>, <phone>, <term>).

    Overlapping spans become one, named after the first. Null stays null. n_chars, if there is such a column, follows the new text.
    Extra columns may have any name.
    """
    return shielded(docs, _sanitise)


def _sanitise(docs: DataFrame) -> DataFrame:
    pairs = disclosing(docs)
    ready, held = _with_pairs(docs, pairs)
    sent = docs.sparkSession.sparkContext.broadcast(held)
    schema = StructType([f if f.name != "text" else f.__class__("text", StringType(), f.nullable) for f in docs.schema.fields])
    counted = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in _slices(batches):
            out = []
            for t, own in zip(b.column("text").to_pylist(), b.column("_pairs").to_pylist(), strict=True):
                if t is None:
                    out.append(None)
                    continue
                spans, terms = _spans_of(t, _wanted(known, own))
                parts, at = [], 0
                for s, k, e in sorted([*spans, *((s, 4, e) for s, e in terms)]):
                    if s >= at:
                        parts += [t[at:s], f"<{(*KINDS, 'term')[k]}>"]
                    at = max(at, e)
                out.append("".join([*parts, t[at:]]) if parts else t)
            cols = []
            for f in b.schema:
                if f.name == "_pairs":
                    continue
                if f.name == "text":
                    cols.append(pa.array(out, pa.string()))
                elif f.name == "n_chars" and counted and pa.types.is_integer(f.type):
                    cols.append(pa.array([n if t is None else len(t) for t, n in zip(out, b.column("n_chars").to_pylist(), strict=True)], f.type))
                else:
                    cols.append(b.column(f.name))
            yield pa.record_batch(cols, names=[f.name for f in b.schema if f.name != "_pairs"])

    return ready.mapInArrow(run, schema)
