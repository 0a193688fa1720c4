"""Near-duplicate classes: ProbMinHash signatures, banding, exact verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Kind, digests
from .components import components
from .scratch import drop, materialise, release, shielded, sifted, skew_join
from .tokens import chunks, mix, shingles, span, prefix, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
M = BANDS * ROWS
#: A document: its doc_id and two hashes of its text.
DOC = ["doc_id", "k0", "k1"]
#: Documents of a candidate group that are compared within one task, and those of a larger group that all its blocks share.
BLOCK, PIVOTS = 1024, 64
#: Slots of the table that counts the shingles of large groups, to put rare ones first.
SLOTS = 1 << 20


def weighted(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) in that order, with weights 1 + ln(count)."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    return h[at], doc[at], 1 + np.log(count)


def probminhash(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """n x m signature: each register holds the element that arrives there first.

    Element d of weight w sends a Poisson process of rate w, seeded by d alone; every arrival goes to a random register. Two
    documents agree in a register with their probability Jaccard similarity. Arrivals are drawn round by round for all documents;
    an element stops when its time passes the latest first arrival among its document's registers, since nothing can change any more.
    """
    best = np.full(n * m, np.inf)
    who = np.zeros(n * m, np.uint64)
    live, owner = h, doc
    time = np.zeros(len(h))
    rate = weight
    rounds = 0
    while len(live):
        rounds += 1
        r = mix(live + np.uint64((rounds * 0x9E3779B97F4A7C15) % 2**64))
        u = ((r >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52
        reg = owner * m + (mix(r ^ np.uint64(0xA5A5A5A5DEADBEEF)) % np.uint64(m)).astype(np.int64)
        time = time - np.log(u) / rate
        better = time < best[reg]
        at, when, el = reg[better], time[better], live[better]
        np.minimum.at(best, at, when)
        won = best[at] == when
        who[at[won]] = el[won]
        top = best.reshape(n, m).max(1)
        go = time < top[owner]
        live, owner, time, rate = live[go], owner[go], time[go], rate[go]
    return who.reshape(n, m)


def _bands(sig: np.ndarray) -> np.ndarray:
    n = len(sig)
    bands = span(prefix(sig.ravel()), np.arange(0, n * M, ROWS), np.arange(ROWS, n * M + 1, ROWS)).reshape(n, BANDS)
    return mix(bands + np.arange(BANDS, dtype=np.uint64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    as_words = Kind("word", SHINGLE, SHINGLE)
    for b in batches:
        for c in chunks(b.column("text")):
            _, _, bound, w = words(c)
            h, doc = shingles(w, bound, SHINGLE)
            _, _, raw, at = as_words.symbols(c)
            same = digests(raw, at[bound[:-1]], at[bound[1:]])
            h, doc, weight = weighted(h, doc)
            full = np.diff(bound) > 0
            heavy = np.zeros(c.n, bool)
            heavy[doc[weight > 1]] = True
            own = heavy[doc]
            bands = np.concatenate([
                _bands(probminhash(h, doc, np.ones(len(h)), c.n))[full],
                _bands(probminhash(h[own], (np.cumsum(heavy) - 1)[doc[own]], weight[own], int(heavy.sum()))),
            ])
            order = np.argsort(np.concatenate([np.flatnonzero(full), np.flatnonzero(heavy)]), kind="stable")
            flat = pa.array(bands[order].ravel().view(np.int64))
            offs = np.concatenate([[0], np.cumsum(BANDS * (full.astype(np.int64) + heavy))]).astype(np.int32)
            yield pa.record_batch([
                *(b.column(x).slice(c.lo, c.n) for x in DOC),
                *(pa.array(same[:, i], mask=~full) for i in (0, 1)),
                pa.ListArray.from_arrays(pa.array(offs), flat),
            ], names=[*DOC, "s0", "s1", "bands"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in chunks(b.column("text")):
            _, _, bound, w = words(c)
            h, doc = shingles(w, bound, SHINGLE)
            h, doc, _ = weighted(h, doc)
            cut = np.searchsorted(doc, np.arange(c.n + 1))
            sets = [h[cut[i] : cut[i + 1]].tobytes() for i in range(c.n)]
            names = [x for x in b.schema.names if x != "text"]
            yield pa.record_batch([*(b.column(x).slice(c.lo, c.n) for x in names), pa.array(sets, pa.binary())], names=[*names, "sh"])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct hashes; two empty ones: 0."""
    if not len(a) or not len(b) or min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def link(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the graph of pairs with similarity SIMILARITY at least; pairs already joined are not compared.

    Likely partners come first: each set is tried against the members of the largest groups so far, so a group of near copies costs
    about one comparison a member.
    """
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    groups: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        mine = [i]
        joined = i
        for g in sorted(groups, key=lambda g: -len(groups[g])):
            for j in groups[g]:
                if jaccard(s, sets[j]) >= SIMILARITY:
                    edges.append((j, i))
                    mine += groups.pop(g)
                    joined = min(joined, g)
                    break
        groups[joined] = sorted(mine)
    return edges


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges within each (root, block) of rows that arrive sorted by it. A block holds at most about BLOCK + PIVOTS documents."""
    key, ids, sets = None, [], []

    def flush():
        pairs = link(sets) if len(ids) > 1 else []
        return [(ids[a], ids[b]) for a, b in pairs]

    for batch in (b.slice(lo, 250) for b in batches for lo in range(0, b.num_rows, 250)):
        out = []
        for root, block, rep, sh in zip(*(batch.column(x).to_pylist() for x in ("root", "block", "rep", "sh")), strict=True):
            if (root, block) != key:
                out += flush()
                key, ids, sets = (root, block), [], []
            ids.append(rep)
            sets.append(np.frombuffer(sh, np.uint64))
        yield pa.record_batch([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
    out = flush()
    yield pa.record_batch([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _slot(h: np.ndarray) -> np.ndarray:
    return (mix(h) % np.uint64(SLOTS)).astype(np.int64)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(SLOTS, np.int64)
    for b in batches:
        for c in chunks(b.column("text")):
            _, _, bound, w = words(c)
            h, doc = shingles(w, bound, SHINGLE)
            n += np.bincount(_slot(weighted(h, doc)[0]), minlength=SLOTS)
    at = np.flatnonzero(n)
    for lo in range(0, len(at), 100_000):
        yield pa.record_batch([pa.array(x[lo : lo + 100_000]) for x in (at // 4096, at % 4096, n[at])], names=["page", "slot", "n"])


def _verify_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges among the listed pairs of each (root, block) of rows that arrive sorted by it; pairs already joined are not compared."""
    key, rows = None, {}

    def flush():
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        edges = []
        for a, (cls, sh, partners) in rows.items():
            for b in partners:
                x, y = find(cls), find(rows[b][0])
                if x != y and jaccard(sh, rows[b][1]) >= SIMILARITY:
                    edges.append((a, b))
                    parent[max(x, y)] = min(x, y)
        return edges

    for batch in (b.slice(lo, 250) for b in batches for lo in range(0, b.num_rows, 250)):
        out = []
        for root, block, rep, cls, partners, sh in zip(*(batch.column(x).to_pylist() for x in ("root", "block", "rep", "cls", "partners", "sh")), strict=True):
            if (root, block) != key:
                out += flush()
                key, rows = (root, block), {}
            rows[rep] = (cls, np.frombuffer(sh, np.uint64), partners or ())
        yield pa.record_batch([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
    out = flush()
    yield pa.record_batch([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


#: Rows of one token and class that are held back until another class is seen.
HELD = 1 << 20


def _of_several_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and class those whose token has several classes; where one class has over HELD rows, they pass unseen, which costs but changes nothing."""
    held: list[pa.RecordBatch] = []
    open_token, passing = None, False

    def first(b):
        return b.column("token")[0].as_py(), b.column("cls")[0].as_py()

    for b in (b for b in batches if b.num_rows):
        token, cls = b.column("token").to_numpy(), b.column("cls").to_numpy()
        at = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token))
        keep = np.zeros(len(token), bool)
        for k, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            if k == 0 and token[0] == open_token:
                several = passing or cls[hi - 1] != first(held[0])[1]
                if several:
                    yield from held
                    held = []
            else:
                held, passing = [], False
                several = cls[lo] != cls[hi - 1]
            if several:
                keep[lo:hi] = True
            if hi == len(token):
                open_token, passing = token[-1], several
                if not several:
                    held.append(b.slice(lo, hi - lo))
                    if sum(x.num_rows for x in held) > HELD:
                        yield from held
                        held, passing = [], True
        if keep.any():
            yield b.filter(pa.array(keep))


def _across(large: DataFrame, text: DataFrame, found: DataFrame) -> DataFrame | None:
    """Edges (a, b) that join the classes (node, root) found so far in large groups (root, rep, n); None if there are none apart.

    An exact prefix-filter join: shingles are put in one order, rare ones first, and texts of similarity SIMILARITY share one of the first
    |x| - ceil(SIMILARITY |x|) + 1 at least. Any order is exact; counts by slot only keep common passages out of the prefixes. Lists of one
    class need no work. Longer lists meet in pairs of blocks, and so do the shingle sets of the pairs found.
    """
    own = large.join(found.select(F.col("node").alias("_n"), F.col("root").alias("_c")), F.col("rep") == F.col("_n"), "left").select("root", "rep", "n", F.coalesce("_c", "rep").alias("cls"))
    apart = own.groupBy(F.col("root").alias("_r")).agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo < hi").select("_r")
    own = materialise(own.join(apart, F.col("root") == F.col("_r"), "left_semi"))
    if own.isEmpty():
        return None
    text = text.join(own, "rep").select("root", "cls", "rep", "text")
    counts = text.mapInArrow(_slots, "page long, slot long, n long").groupBy("page", "slot").agg(F.sum("n").alias("n"))
    often = np.zeros(SLOTS, np.int64)
    for r in counts.groupBy("page").agg(F.collect_list("slot").alias("slot"), F.collect_list("n").alias("n")).coalesce(8).toLocalIterator():  # a job for each part
        often[r.page * 4096 + np.array(r.slot)] = r.n
    sent = text.sparkSession.sparkContext.broadcast(often)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sent.value
        for b in batches:
            root = b.column("root").to_numpy().view(np.uint64)
            for c in chunks(b.column("text")):
                _, _, bound, w = words(c)
                h, doc = shingles(w, bound, SHINGLE)
                h, doc, _ = weighted(h, doc)
                order = np.lexsort((h, often[_slot(h)], doc))
                h = h[order]
                size = np.bincount(doc, minlength=c.n)
                at = np.arange(len(h)) - (np.cumsum(size) - size)[doc]
                first = at <= size[doc] - np.ceil(SIMILARITY * size[doc] - 1e-9)
                h, doc, at = h[first], doc[first], at[first]
                token = mix(h ^ mix(root[c.lo + doc]))  # a token is one of a group's
                row = pa.array(c.lo + doc)
                yield pa.record_batch([pa.array(token.view(np.int64)), b.column("cls").take(row), b.column("rep").take(row), pa.array(size[doc].astype(np.int32)), pa.array((size[doc] - at).astype(np.int32))], names=["token", "cls", "rep", "size", "rest"])

    row = "token long, cls long, rep long, size int, rest int"
    lists = materialise(text.mapInArrow(prefixes, row).repartition("token").sortWithinPartitions("token", "cls").mapInArrow(_of_several_classes, row))
    often_ = materialise(lists.groupBy("token").agg(F.count("*").alias("_k")))
    n_blocks = F.ceil(F.col("_k") / F.lit(BLOCK)).cast("int")
    lists = materialise(skew_join(lists, often_, ["token"], "_k", lists.count()).select("cls", "rep", "token", "size", "rest", (n_blocks - 1).alias("last"), F.pmod(F.xxhash64("rep", F.lit(3)), n_blocks).cast("int").alias("block")))
    left = lists.select("token", F.col("block").alias("i"), F.explode(F.sequence("block", "last")).alias("j"), F.col("rep").alias("a"), F.col("cls").alias("cls_a"), F.col("size").alias("size_a"), F.col("rest").alias("rest_a"))
    right = lists.select("token", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("rep").alias("b"), F.col("cls").alias("cls_b"), F.col("size").alias("size_b"), F.col("rest").alias("rest_b"))
    s = F.lit(SIMILARITY)
    alike = (F.least("size_a", "size_b") >= s * F.greatest("size_a", "size_b") - 1e-6) & (F.least("rest_a", "rest_b") * (1 + s) >= s * (F.col("size_a") + F.col("size_b")) - 1e-6)
    met = left.join(right, ["token", "i", "j"]).filter((F.col("cls_a") != F.col("cls_b")) & ((F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))) & alike)
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # two blocks meet in a task: half the size each
    parts = own.select("root", "rep", F.pmod(F.xxhash64("rep", F.lit(5)), F.ceil(2 * F.col("n") / F.lit(BLOCK))).cast("long").alias("part"))
    pairs = pairs.join(parts.select("root", F.col("rep").alias("a"), F.col("part").alias("p")), "a").join(parts.select(F.col("rep").alias("b"), F.col("part").alias("q")), "b")
    block = (F.least("p", "q") * F.lit(1 << 31) + F.greatest("p", "q")).alias("block")
    pairs = materialise(pairs.groupBy("root", block, "a").agg(F.collect_list("b").alias("partners")))
    rows = pairs.select("root", "block", F.col("a").alias("rep"), "partners").unionByName(pairs.select("root", "block", F.explode("partners").alias("rep"), F.lit(None).cast("array<long>").alias("partners")))
    rows = rows.groupBy("root", "block", "rep").agg(F.max("partners").alias("partners")).join(own.select("rep", "cls"), "rep")
    sets = text.select("rep", "text").mapInArrow(_shingle_sets, "rep long, sh binary")
    ready = rows.join(sets, "rep").select("root", "block", "rep", "cls", "partners", "sh").repartition("root", "block").sortWithinPartitions("root", "block", "rep")
    return materialise(ready.mapInArrow(_verify_pairs, "a long, b long"))


def _documents(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k0"), F.xxhash64(F.lit(1), text).alias("k1"), text.alias("text"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_class, kept for every document: class_id is the least doc_id of its near-duplicate class.

    Documents are alike if their sets of five-word shingles have a Jaccard similarity of 0.8 or more; classes are the connected
    components of that relation over the candidates. Words are [^\\x20\\x09-\\x0D]+, unchanged. Candidates share all four registers of one of 20
    bands of a ProbMinHash signature over shingles of equal weight: pairs at 0.8 meet with probability 0.99997. Texts that repeat shingles have a
    second signature, weighted 1 + ln(count), whose bands add candidates.

    Texts of the same words (by a 128-bit digest) are one node from the start. A bucket links its nodes to its least one only; the links' components
    are the candidate groups, within which exact similarities decide, on whole shingle sets. A group of over BLOCK documents
    is dealt out twice to blocks that share PIVOTS documents of the least hash, which joins most of its copies cheaply; an exact prefix-filter join
    then finds every other pair of its texts. No group meets in one task, and keys of many rows (large groups of copies, common buckets) are joined by broadcast.

    A document is a doc_id with a text: repeated rows (equal in both) are one document and give one row; rows that share a doc_id but not the text
    are documents of their own, each with the row of its class. Exactly one document of a class is kept, the least by doc_id, then by hashes of
    the text. Null, empty or blank texts are classes of their own. Texts of 1 to 4 words have one shingle. Null doc_id: no row. Empty table: no rows.
    Other columns are not read.
    """
    return classified(docs).select("doc_id", "class_id", "n_class", "kept")


def classified(docs: DataFrame) -> DataFrame:
    """The rows of classes() with the hashes k0, k1 of each document's text."""
    docs = _documents(docs.filter("doc_id is not null"))
    sig = materialise(docs.mapInArrow(_signatures, "doc_id long, k0 long, k1 long, s0 long, s1 long, bands array<long>"))
    reps = sig.filter("s0 is not null").groupBy("s0", "s1").agg(F.min(F.struct(*DOC)).alias("lead"), F.min_by("bands", "doc_id").alias("bands"), F.count("*").alias("c"))
    reps = materialise(reps.select("s0", "s1", F.monotonically_increasing_id().alias("rep"), *(F.col(f"lead.{x}").alias(x) for x in DOC), "bands", "c"))
    member = skew_join(sig.select(*DOC, "s0", "s1"), reps.select("s0", "s1", "rep", "c"), ["s0", "s1"], "c", sig.count(), how="left")
    member = materialise(member.select(*DOC, "rep").distinct())
    drop(sig)
    band = reps.select("rep", F.explode(F.array_distinct("bands")).alias("band"))
    bucket = materialise(band.groupBy("band").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).filter("n > 1"))
    band = materialise(sifted(band, bucket, ["band"]).filter("_maybe").drop("_maybe"))  # most bands have one text
    star = skew_join(band, bucket, ["band"], "n", band.count()).filter("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b"))
    group = materialise(components(star))
    drop(band, bucket)
    size = materialise(group.groupBy("root").agg(F.count("*").alias("n")))
    sized = materialise(skew_join(group, size, ["root"], "n", group.count()).select("root", F.col("node").alias("rep"), "n"))
    # rows (root, block, rep): small groups whole, large ones twice over blocks, their pivots in every block
    n_blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    small = sized.filter(F.col("n") <= BLOCK).select("root", F.lit(0).alias("block"), "rep")
    large = sized.filter(F.col("n") > BLOCK)
    dealt = large.select("root", F.explode(F.array(F.pmod(F.xxhash64("rep"), n_blocks).cast("int"), (n_blocks + F.pmod(F.xxhash64("rep", F.lit(1)), n_blocks)).cast("int"))).alias("block"), "rep")
    pivots = large.withColumn("_i", F.row_number().over(_by_hash())).filter(F.col("_i") <= PIVOTS).select("root", F.explode(F.sequence(F.lit(0), 2 * n_blocks - 1)).alias("block"), "rep")
    blocks = small.unionByName(dealt).unionByName(pivots).groupBy("rep").agg(F.collect_set(F.struct("root", "block")).alias("blocks"))
    # texts come with their blocks: they are shuffled once, and so are the sets made of them (DOC and rep are one to one, so the join's partitions serve the dropping too)
    wanted = materialise(reps.select(*DOC, "rep").join(blocks, "rep"))
    drop(reps)
    release(docs.sparkSession)
    text = sifted(docs, wanted, DOC).filter("_maybe").drop("_maybe").join(wanted, DOC).dropDuplicates(DOC)
    text = materialise(text.select("rep", "blocks", "text"))
    sets = text.mapInArrow(_shingle_sets, "rep long, blocks array<struct<root: long, block: int>>, sh binary")
    ready = sets.select(F.explode("blocks").alias("_b"), "rep", "sh").select("_b.root", "_b.block", "rep", "sh").repartition("root", "block").sortWithinPartitions("root", "block", "rep")
    edges = materialise(ready.mapInArrow(_verify, "a long, b long"))
    root = materialise(components(edges))
    more = _across(large, text.select("rep", "text"), root)
    if more is not None:  # the classes found stand for their edges
        root = components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    root = root.withColumnRenamed("node", "rep")
    per = member.filter("rep is not null").groupBy("rep").agg(F.count("*").alias("n_rep"), F.min(F.struct(*DOC)).alias("lead"))
    per = materialise(per.join(root, "rep", "left").select("rep", "n_rep", "lead", F.coalesce("root", "rep").alias("root")))
    whole = materialise(per.groupBy("root").agg(F.min("lead").alias("first"), F.sum("n_rep").alias("n_class"), F.count("*").alias("_m")))
    per = materialise(skew_join(per, whole, ["root"], "_m", per.count()).select("rep", "n_rep", "first", "n_class"))
    out = skew_join(member, per, ["rep"], "n_rep", member.count(), how="left")
    return out.select(*DOC, F.coalesce("first.doc_id", "doc_id").alias("class_id"), F.coalesce("n_class", F.lit(1)).alias("n_class"), F.coalesce(F.col("first") == F.struct(*DOC), F.lit(True)).alias("kept"))


def _by_hash():
    from pyspark.sql import Window

    return Window.partitionBy("root").orderBy(F.xxhash64("rep", F.lit(7)), "rep")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate class (see classes()): one of the rows of its kept document; all columns. Rows without doc_id stay."""
    gone = classified(docs).filter("not kept").select(*DOC)
    again = _documents(docs.filter("doc_id is not null")).groupBy(*DOC).agg(F.count("*").alias("_c")).filter("_c > 1").select(*DOC)
    marked = gone.withColumn("_once", F.lit(False)).unionByName(again.join(gone, DOC, "left_anti").withColumn("_once", F.lit(True)))
    marked = materialise(marked.select(*(F.col(x).alias(f"_{x}") for x in DOC), "_once"))
    text = F.col("text").cast("string")

    def run(d: DataFrame) -> DataFrame:
        names = d.columns
        d = d.select("*", F.col("doc_id").cast("long").alias("_doc_id"), F.xxhash64(text).alias("_k0"), F.xxhash64(F.lit(1), text).alias("_k1"))
        on = ["_doc_id", "_k0", "_k1"]
        d = sifted(d, marked, on)
        out = d.filter("not _maybe").select(*names).unionByName(d.filter("_maybe").join(marked, on, "left_anti").select(*names))
        once = marked.filter("_once")
        if once.isEmpty():
            return out
        return out.unionByName(d.filter("_maybe").join(once, on).dropDuplicates(on).select(*names))

    return shielded(docs, run)
