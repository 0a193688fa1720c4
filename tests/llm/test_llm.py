"""Brute-force and edge-case tests of the training-data operators on small tables."""

import collections
import hashlib
import math
import random
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import anchors, ann, columns, decontaminate, langid, mixing, neardup, pii, quality, repeats, scratch, suffixtree, tokens
from corpusloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _w string, key string, row string"
WORDS = [a + b + c for a in ("th", "on", "er", "ba") for b in ("an", "ti", "ou") for c in ("d", "st", "ly", "")]


def make(spark, rows):
    """documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", "y", "z") for i, t, lang, src in rows], DOCS)


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def edge_rows():
    rng = random.Random(11)
    base = prose(rng, 120)
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, None, None, None), (4, "", "fr", "b"), (5, " \t\n", "fr", "b"), (6, base + " tail", "en", None), (7, prose(rng, 6000), "fr", "a"), (8, "one", "en", "c"), (8, "one", "en", "c"), (9, "Zażółć gęślą \U0001f600 jaźń", "pl", "c"), (10, "ha " * 900, "en", "a"), (None, base, "en", "a")]
    return rows + [(20 + i, prose(rng, rng.randrange(1, 90)), "en" if i % 2 else "fr", "abc"[i % 3]) for i in range(40)]


# words and hashes


def test_words_and_hashes():
    texts = ["a bb  a\n", None, "", "\x0b\x1ca", "éa bb"]
    c = next(tokens.chunks(pa.array(texts)))
    start, end, bound, h = tokens.words(c)
    assert [c.buf[a:b].tobytes() for a, b in zip(start, end)] == [w for t in texts for w in (t or "").encode().split()]
    assert list(np.diff(bound)) == [3, 0, 0, 1, 2] and h[0] == h[2] and h[1] == h[5] and len(set(h.tolist())) == 4
    got, doc = tokens.shingles(h, bound, 2)
    assert doc.tolist() == [0, 0, 3, 4] and len(set(got.tolist())) == 4
    parts = [x.lo for x in tokens.chunks(pa.array(["x" * 30] * 5), 60)]
    assert parts == [0, 2, 4]


# op1


def test_mixing_fixes_the_words_of_each_source(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(0, 60)), "en", None if i % 31 == 0 else "hot" if i % 3 else f"s{i % 4}") for i in range(900)]
    got = mixing.mix(make(spark, rows)).collect()
    again = mixing.mix(make(spark, rows).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    size = {i: len(t.split()) for i, t, *_ in rows}
    assert all(r.size == size[r.doc_id] and r.taken in (0, r.size, 2 * r.size) for r in got)
    by = collections.defaultdict(list)
    for (i, _, _, s), r in zip(rows, sorted(got, key=lambda r: r.doc_id)):
        by[s].append(r)
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 60 and rs[0].target <= 2 * rs[0].source_size + 1e-6
    assert abs(sum(rs[0].target for rs in by.values()) - 1.5 * sum(size.values())) < 1


def test_mixing_unequal_weights_and_edges(spark, edge_rows):
    d = make(spark, edge_rows)
    got = mixing.mix(d).collect()
    assert len(got) == len(edge_rows) and all(r.taken == 0 for r in got if r.size == 0)
    heavy = mixing.mix(d, weight=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0), share=0.5).collect()
    assert all(r.copies <= 2 for r in heavy)
    assert mixing.mix(d.limit(0)).count() == 0


# op2


def edit_leak(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        i = rng.randrange(len(t))
        t[i] = "q"
    return "".join(t)


def test_decontamination_against_semi_global_alignment(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, 40)) for i in range(4)] + [(8, None), (9, "tiny")]
    norm = lambda s: re.sub(r"[^a-z0-9]", "", (s or "").lower())
    rows = []
    for i in range(24):
        leak = edit_leak(rng, items[i % 4][1], (0, 2, 5, 40)[i // 6])
        rows.append((i, prose(rng, 30) + ". " + leak.upper() + "! " + prose(rng, 30), "en", "a"))
    rows += [(50, None, "en", "a"), (51, "", "en", "a"), (52, items[0][1] + items[0][1], "en", "a")]

    def best(p, t):
        prev = [0] * (len(t) + 1)
        for i, ch in enumerate(p):
            cur = [i + 1]
            for j, x in enumerate(t):
                cur.append(min(prev[j] + (x != ch), prev[j + 1] + 1, cur[j] + 1))
            prev = cur
        return min(prev)

    rows.append((53, "so Ti, ny! it is", "en", "a"))
    want = {(i, k): best(norm(p), norm(t)) for i, t, *_ in rows for k, p in items if p}
    want = {x: e for x, e in want.items() if e <= decontaminate.budget(len(norm(dict(items)[x[1]])))}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.matches(make(spark, rows), bench).collect()}
    assert got == want and len(want) > 12
    kept = decontaminate.clean(make(spark, rows), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in rows} - {i for i, _ in want} and kept.columns == make(spark, rows).columns
    assert decontaminate.matches(make(spark, rows), bench.limit(0)).count() == 0 and decontaminate.matches(make(spark, rows).limit(0), bench).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    bench = spark.createDataFrame([(i, prose(rng, 30)) for i in range(6)], "item_id long, text string")
    assert len(list(decontaminate.blocks(bench, 300))) >= 3
    d = make(spark, [(i, prose(rng, 20) + " " + r.text + " " + prose(rng, 20), "en", "a") for i, r in enumerate(bench.orderBy("item_id").collect())])
    whole = sorted(map(tuple, decontaminate.matches(d, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (300,))
    assert sorted(map(tuple, decontaminate.matches(d, bench).collect())) == whole and {r[:2] for r in whole} >= {(i, i) for i in range(6)}


def test_decontamination_of_capitals_common_grams_and_other_ids(spark, monkeypatch):
    rng = random.Random(6)
    head = "Please answer the question below in full sentences: "
    items = [(i, head + prose(rng, 12)) for i in range(40)] + [(90, "ΤΙΣ ΟΔΟΣ ΕΙΝΑΙ ΑΥΤΗ ΠΟΥ ΒΛΕΠΕΙΣ ΕΔΩ"), (91, "İstanbul'da güzel bir gün geçirdik"), (92, "W=mc^2 yes?")]
    rows = [(i, head + prose(rng, 20) + " " + t + " " + prose(rng, 5), "en", "a") for i, t in items]
    bench = spark.createDataFrame(items, "item_id short, text string")
    d = make(spark, rows).withColumn("doc_id", F.col("doc_id").cast("decimal(9,0)"))
    got = sorted((int(r.doc_id), r.item_id, r.edits) for r in decontaminate.matches(d, bench).collect())
    assert got == sorted((i, i, 0) for i, _ in items)
    monkeypatch.setattr(decontaminate, "HITS", 50)
    from pyarrow import compute as pc

    ix = decontaminate.Index(items)
    c = next(tokens.chunks(pc.utf8_lower(pa.array([t for _, t, *_ in rows]))))
    assert sorted((rows[d][0], i, e) for d, i, _, _, e in decontaminate.find(c, ix)) == got


# op3


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(1, 2**63, n, dtype=np.uint64) for n in (400, 50, 50))
    h = np.concatenate([shared, a, shared, b])
    doc = np.repeat([0, 1], 450)
    sig = neardup.probminhash(h, doc, np.ones(900), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.04  # 400 of 500
    heavy = np.ones(900)
    heavy[400:450] = 9.0
    assert (neardup.probminhash(h, doc, heavy, 2, 2000)[0] == sig[1]).mean() < 0.7


def brute_classes(rows):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_rows(rng, bases=12, copies=7):
    rows, i = [], 0
    for _ in range(bases):
        base = prose(rng, 120).split()
        for c in range(copies):
            t = list(base)
            for _ in range(c % 4):
                t[rng.randrange(len(t))] = "changed" + str(rng.random())
            rows.append((i, " ".join(t), "en", "a"))
            i += 1
    return rows


def test_neardup_equals_brute_force(spark, monkeypatch):
    rows = near_rows(random.Random(9)) + [(900, None, "en", "a"), (901, "", "en", "a"), (902, "two words", "en", "a"), (903, "two words", "en", "a"), (904, "two  words", "en", "a")]
    want = brute_classes(rows)
    got = neardup.classes(make(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert all(r.n_class == sum(v == want[r.doc_id] for v in want.values()) and r.kept == (r.doc_id == r.class_id) for r in got)
    monkeypatch.setattr(neardup, "BLOCK", 3)  # groups above the block size go by blocks and pivots
    assert {r.doc_id: r.class_id for r in neardup.classes(make(spark, rows)).collect()} == want


def test_neardup_links_every_pair_of_large_groups(spark, monkeypatch):
    rng = random.Random(31)
    common = prose(rng, 90).split()  # a boilerplate that chains all texts into a few groups of candidates
    rows = []
    for i in range(150):
        t = common + [f"own{i}x{j}" for j in range(60)]
        rows.append((2 * i, " ".join(t), "en", "a"))
        rows.append((2 * i + 1, " ".join([*t[:-3], "other", "words", f"end{i}"]), "en", "a"))
    monkeypatch.setattr(neardup, "BLOCK", 6)
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    want = brute_classes(rows)
    assert len(set(want.values())) == 150
    assert {r.doc_id: r.class_id for r in neardup.classes(make(spark, rows)).collect()} == want


def test_neardup_links_chains_across_small_blocks(spark, monkeypatch):
    rng = random.Random(77)
    rows, i = [], 0
    for _ in range(4):
        t = prose(rng, 150, [w + str(n) for w in WORDS for n in range(40)]).split()
        for step in range(14):
            rows.append((i, " ".join(t), "en", "a"))
            t[step * 10] = f"new{i}"
            i += 1
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    want = brute_classes(rows)
    assert len(set(want.values())) == 4
    assert {r.doc_id: r.class_id for r in neardup.classes(make(spark, rows)).collect()} == want


def test_neardup_tells_rows_of_one_doc_id_apart(spark):
    rng = random.Random(78)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a, "en", "x"), (5, a, "en", "x"), (5, b, "en", "x"), (5, b, "en", "x"), (7, a + " more", "en", "x"), (None, a, "en", "x"), (9, None, "en", "x"), (9, None, "en", "x"), (9, "", "en", "x")]
    got = sorted(tuple(r) for r in neardup.classes(make(spark, rows)).collect())
    assert got == [(1, 1, 3, True), (5, 1, 3, False), (5, 5, 1, True), (7, 1, 3, False), (9, 9, 1, True), (9, 9, 1, True)]
    kept = sorted(((r.doc_id, r.text) for r in neardup.keep_one(make(spark, rows)).collect()), key=str)
    assert kept == sorted([(1, a), (5, b), (None, a), (9, None), (9, "")], key=str)
    same = make(spark, [(3, a, "en", "x")] * 3)
    assert neardup.keep_one(same).count() == 1


def test_neardup_with_hot_keys(spark, monkeypatch):
    rows = near_rows(random.Random(10)) + [(1000 + i, "the very same words in all of these", "en", "a") for i in range(60)]
    monkeypatch.setattr(scratch, "HOT", 50)
    assert {r.doc_id: r.class_id for r in neardup.classes(make(spark, rows)).collect()} == brute_classes(rows)


def test_neardup_candidates_meet_whatever_repeats():
    texts = []
    for i in range(40):
        shared = " ".join(f"s{i}x{j}" for j in range(204))
        texts += [f"{shared} " + " ".join(" ".join(f"{side}{i}x{j}" for j in range(20)) for _ in range(50)) for side in "ab"]  # set Jaccard 200 of 248
    batch = pa.record_batch([pa.array(range(80), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    batch = batch.append_column("k0", batch["doc_id"]).append_column("k1", batch["doc_id"])
    bands = [set(x) for b in neardup._signatures(iter([batch])) for x in b.column("bands").to_pylist()]
    assert all(bands[i] & bands[i + 1] for i in range(0, 80, 2))
    assert not bands[0] & bands[2]


def test_neardup_edges(spark, edge_rows):
    d = make(spark, edge_rows)
    got = neardup.classes(d).collect()
    assert len(got) == len(edge_rows) - 2 and sum(r.doc_id == 8 for r in got) == 1  # a repeated row counts once, one without doc_id not at all
    kept = neardup.keep_one(d)
    assert kept.columns == d.columns and kept.filter("doc_id is null").count() == 1 and kept.filter("doc_id in (2, 6)").count() == 0
    assert neardup.classes(d.limit(0)).count() == 0


def test_components_deal_small_rounds_out_to_few_tasks(spark, monkeypatch):
    """Two chains whose rounds would have a task and a file for each of the session's partitions; no round follows once the edges are stars."""
    written = []
    module = sys.modules["corpusloom.llm.components"]
    monkeypatch.setattr(module, "materialise", lambda d: written.append(scratch.materialise(d)) or written[-1])
    monkeypatch.setattr(module, "drop", lambda *tables: None)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chain = spark.createDataFrame([(i, i + 2) for i in range(60)], "a long, b long")
        assert {r.node: r.root for r in components(chain).collect()} == {i: i % 2 for i in range(62)}
        assert len(written) > 4 and all(len(x.inputFiles()) <= 5 for x in written[1:])
        written.clear()
        star = spark.createDataFrame([(5, i) for i in range(6, 30)], "a long, b long")
        assert {r.node: r.root for r in components(star).collect()} == dict.fromkeys(range(5, 30), 5)
        assert len(written) == 1
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 330)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}


# op4 and op8


def brute_words(rows, size):
    w = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    lead = {}
    for i, t in w:
        if i is not None:
            for j in range(len(t) - size + 1):
                k = tuple(t[j : j + size])
                lead[k] = min(lead.get(k, i), i)
    out = []
    for i, t in w:
        gone = [False] * len(t)
        for j in range(len(t) - size + 1):
            if i is not None and lead[tuple(t[j : j + size])] < i:
                gone[j : j + size] = [True] * size
        out.append((i, len(t), sum(gone), b" ".join(x for x, g in zip(t, gone) if not g)))
    return out


def brute_bytes(rows, size):
    t = [(i, (t or "").encode()) for i, t, *_ in rows]
    n = collections.Counter(x[j : j + size] for _, x in t for j in range(len(x) - size + 1))
    out = []
    for i, x in t:
        gone = [False] * len(x)
        for j in range(len(x) - size + 1):
            if n[x[j : j + size]] > 1:
                gone[j : j + size] = [True] * size
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(x), sum(gone), runs, bytes(b for b, g in zip(x, gone) if not g)))
    return out


@pytest.fixture(scope="module")
def repeat_rows(edge_rows):
    rng = random.Random(21)
    shared = [prose(rng, n) for n in (14, 30, 80)]
    rows = [r for r in edge_rows if r[0] != 7]
    for i in range(60):
        parts = [prose(rng, rng.randrange(0, 25))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(shared), prose(rng, rng.randrange(0, 9))]
        rows.append((100 + i, " ".join(parts), "en", "a"))
    return rows


def test_word_repeats_equal_brute_force(spark, repeat_rows):
    got = repeats.remove_words(make(spark, repeat_rows), size=10, k=4).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    assert sorted(((r.doc_id, r.n, r.n_removed, bytes(r.kept)) for r in got), key=key) == sorted(brute_words(repeat_rows, 10), key=key)


def test_word_repeats_at_full_size_equal_brute_force(spark):
    rng = random.Random(41)
    long = prose(rng, 400).split()
    rows = [(0, " ".join(long), "en", "a")]
    for i in range(1, 30):
        a = rng.randrange(0, 330)
        rows.append((i, " ".join([*prose(rng, 20).split(), *long[a : a + rng.choice((49, 50, 51, 70))], *prose(rng, 20).split()]), "en", "a"))
    rows.append((30, "  ".join(long), "en", "a"))
    got = repeats.remove_words(make(spark, rows))
    assert sorted((r.doc_id, r.n, r.n_removed, bytes(r.kept)) for r in got.collect()) == sorted(brute_words(rows, 50))
    assert got.filter("doc_id = 30 and n_removed = n and n_spans = 1").count() == 1


def test_word_repeats_verify_the_source(spark, monkeypatch):
    rows = [(1, "a b c d e f g h", "en", "a"), (2, "a b c d e f g h", "en", "a")]
    assert repeats.remove_words(make(spark, rows), size=4, k=2).filter("n_removed = 8").count() == 1
    real = repeats.verified
    monkeypatch.setattr(repeats, "verified", lambda *a: real(*a).withColumn("sha", F.lit(b"not that of the words")))
    assert repeats.remove_words(make(spark, rows), size=4, k=2).filter("n_removed > 0").count() == 0


def test_word_repeats_with_hot_keys(spark, repeat_rows, monkeypatch):
    monkeypatch.setattr(scratch, "HOT", 100)  # keys with more than a hundredth of the rows go by broadcast
    got = repeats.remove_words(make(spark, repeat_rows), size=10, k=4).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    assert sorted(((r.doc_id, r.n, r.n_removed, bytes(r.kept)) for r in got), key=key) == sorted(brute_words(repeat_rows, 10), key=key)


def test_sifted(spark, monkeypatch):
    rows = spark.range(2000).withColumn("b", F.when(F.col("id") % 7 > 0, F.col("id") % 5))
    wanted = rows.filter("id % 40 = 3")
    got = {r.id: r._maybe for r in scratch.sifted(rows, wanted, ["id", "b"]).collect()}
    assert len(got) == 2000 and all(got[i] for i in range(3, 2000, 40)) and sum(got.values()) < 60
    monkeypatch.setattr(scratch, "SIFT", 64)
    got = {r.id: r._maybe for r in scratch.sifted(rows, wanted, ["id", "b"]).collect()}
    assert all(got[i] for i in range(3, 2000, 40))
    assert not any(r._maybe for r in scratch.sifted(rows, wanted.limit(0), ["id"]).collect())


def test_skew_join(spark):
    left = spark.createDataFrame([(None if i % 9 == 0 else 1 if i % 2 else i, i) for i in range(300)], "k long, x long")
    right = left.filter("k is not null").groupBy("k").agg(F.count("*").alias("n")).filter("k % 3 <> 2")
    rows = lambda d: sorted(d.select("k", "x", "n").collect(), key=str)
    for how in ("inner", "left"):
        assert rows(scratch.skew_join(left, right, ["k"], "n", 300, how)) == rows(left.join(right, "k", how))
    assert right.filter(F.col("n") * scratch.HOT > 300).count() > 1


@pytest.mark.parametrize("limit", [1000, 2])
def test_byte_repeats_equal_brute_force(spark, repeat_rows, limit):
    got = repeats.remove_bytes(make(spark, repeat_rows), size=40, k=8, limit=limit).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    assert sorted(((r.doc_id, r.n, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=key) == sorted(brute_bytes(repeat_rows, 40), key=key)


def test_repeats_of_empty_table(spark, repeat_rows):
    assert repeats.remove_words(make(spark, repeat_rows).limit(0)).count() == 0 and repeats.remove_bytes(make(spark, repeat_rows).limit(0)).count() == 0


def test_columns_give_order_and_prefixes():
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab") for _ in range(12)) for _ in range(9)]
    sym = np.array([[ord(c) for c in t] for t in texts], np.uint16)
    group = np.array([0, 0, 0, 0, 0, 1, 1, 1, 1])
    for j, order, lcp, bwt in columns.rounds(sym, group):
        want = sorted(range(9), key=lambda i: (group[i], texts[i][j:]))
        assert [(group[i], texts[i][j:]) for i in order] == [(group[i], texts[i][j:]) for i in want]
        for x in range(1, 9):
            a, b = order[x - 1], order[x]
            n = 0
            while group[a] == group[b] and j + n < 12 and texts[a][j + n] == texts[b][j + n]:
                n += 1
            assert lcp[x] == n
        assert j == 0 or [chr(c) for c in bwt] == [texts[i][j - 1] for i in order]


def test_column_files_mark_equal_strings():
    rng = random.Random(16)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(14, 20))) for _ in range(30)]
    left = np.array([rng.randrange(0, 4) for _ in texts])
    lo = left.max()
    for j, order, lcp, bwt in columns.column_files(texts, left, np.zeros(30, np.int64)):
        bits = np.unpackbits(np.frombuffer(columns.repeats_of(order, lcp, 6), np.uint8))
        at = [j - lo + a for a in left]
        mine = {i: t[x : x + 6] for i, (t, x) in enumerate(zip(texts, at)) if x >= 0 and len(t[x : x + 6]) == 6}
        want = {i for i, v in mine.items() if list(mine.values()).count(v) > 1}
        assert {i for i in range(30) if i < len(bits) and bits[i]} == want
        assert [int(b) - 1 for b in np.frombuffer(bwt, np.uint16)] == [texts[i][j - lo + left[i] - 1] if j - lo + left[i] else -1 for i in np.frombuffer(order, np.int32)]


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 60)
    for w in (1, 2, 3, 7, 16, 60):
        assert anchors.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(60 - w + 1)]


# op5


def test_language_id(spark):
    rng = random.Random(8)
    vocab = {"en": ["the", "thing", "whole", "with"], "de": ["der", "nicht", "schön", "über"], "es": ["que", "niño", "ción", "para"]}
    rows = [(i, prose(rng, 30, vocab[lang]), lang, "a") for i, lang in enumerate(["en", "de", "es"] * 20)]
    model = langid.learn(make(spark, rows))
    assert model[0] == ["de", "en", "es"]
    test = rows[:9] + [(90, None, "en", "a"), (91, "12 !?", "en", "a"), (92, "", None, "a"), (93, "Ω", "en", "a")]
    got = {r.doc_id: r for r in langid.predict(make(spark, test), model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows[:9]) and [got[i].lang_pred for i in (90, 91, 92)] == ["und"] * 3
    assert got[93].lang_pred in model[0] and all(0 <= r.score <= 1 for r in got.values())
    none = langid.learn(make(spark, rows).limit(0))
    assert none[0] == [] and {r.lang_pred for r in langid.predict(make(spark, test), none).collect()} == {"und"}
    assert langid.predict(make(spark, test).limit(0), model).count() == 0


def test_language_id_equals_brute_force(spark):
    rng = random.Random(88)
    vocab = {"en": ["the", "thing", "whole", "with", "über"], "de": ["der", "nicht", "schön", "über"], "es": ["que", "niño", "ción", "para"]}
    rows = [(i, prose(rng, rng.randrange(1, 30), vocab[lang]).upper() + " 7!", lang, "a") for i, lang in enumerate(["en", "de", "es"] * 12)]
    rows += [rows[0], (200, None, "en", "a"), (201, prose(rng, 60_000, vocab["de"]), None, "a"), (202, "ab", "fr", "a")]
    d = make(spark, rows).withColumn("lang_pred", F.lit(1)).withColumn("key_", F.lit(2))

    def grams(t):
        out = []
        low = "".join(c.lower() for c in t).encode()
        b = b" " + bytes(x if 97 <= x <= 122 or x >= 128 else 32 for x in low) + b" "
        for i in range(len(b) - 2):
            if b"  " in b[i : i + 3]:
                continue
            out.append(b[i : i + 3])
            if i + 4 <= len(b) and b"  " not in b[i : i + 4]:
                out.append(b[i : i + 4])
        return out

    model = langid.learn(d, 0, 0)
    assert model[0] == ["de", "en", "es", "fr"]
    has = {x: {g for _, t, lang, _ in rows if lang == x and t for g in grams(t)} for x in model[0]}
    key = lambda g: int.from_bytes(g, "little")
    every = sorted(set().union(*has.values()), key=key)
    at = langid._cells(np.array([key(g) for g in every], np.uint64))
    mask = model[1][at[0], 0] & model[1][at[1], 0] & model[1][at[2], 0]
    wrong = 0
    for g, m in zip(every, mask.tolist()):
        for i, x in enumerate(model[0]):
            assert not (g in has[x]) or m >> i & 1  # all languages that hold a gram are returned
            wrong += (g not in has[x]) and m >> i & 1
    assert wrong <= 2
    for r, (i, t, *_) in zip(langid.predict(d.coalesce(1), model).collect(), rows):
        g = grams(t or "")
        if not any(map(str.isalpha, t or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        share = sorted(((sum(x in has[k] for x in g) / max(len(g), 1), k) for k in model[0]), key=lambda p: (-p[0], p[1]))
        assert r.lang_pred == share[0][1] and abs(r.score - share[0][0] / (share[0][0] + share[1][0])) < 1e-3


# op6


def brute_base(t):
    luhn = lambda d: sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(re.sub(r"\D", "", m[0])) <= 19 and luhn(re.sub(r"\D", "", m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out)


PII = ["mail a.b@x-y.co.uk now", "ip 1.2.3.4 and 300.1.1.1 and 1.2.3.4.5", "card 4111 1111 1111 1111 or 4111111111111112", "call +1 (212) 555-0100, +1", "\U0001f600 é a@b.c", "", None, "9" * 4000, "0000.0001.255.00255"]


def test_pii_base_spans(spark):
    for t in PII:
        assert pii.base_spans(t or "") == brute_base(t or ""), t
    got = {r.doc_id: r for r in pii.find(make(spark, [(i, t, "en", "a") for i, t in enumerate(PII)])).collect()}
    for i, t in enumerate(PII):
        spans = brute_base(t or "")
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and (got[i].n_email, got[i].n_phone) == (sum(k == 1 - 1 for _, k, _ in spans), sum(k == 3 for _, k, _ in spans))
    assert pii.find(make(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_pii_terms_that_disclose(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "MAX_SENT", most)
    rng = random.Random(4)
    rows = [(i, prose(rng, 20) + " Quillfeather writes bob@corp.example daily " + prose(rng, 20), "en", "a") for i in range(6)]
    rows += [(50 + i, prose(rng, 40), "en", "a") for i in range(40)] + [(99, None, "en", "a")]
    d = make(spark, rows)
    got = {r.doc_id: r for r in pii.find(d).collect()}
    assert all("term:" in got[i].spans and got[i].n_email == 1 for i in range(6)) and all(got[50 + i].spans == "" for i in range(40))
    out = {r.doc_id: r for r in pii.sanitise(d).collect()}
    assert "Quillfeather" not in out[0].text and "<email>" in out[0].text and out[0].n_chars == len(out[0].text) and out[50].text == rows[6][1] and out[99].text is None
    assert pii.sanitise(d).columns == d.columns


def test_pii_terms_equal_brute_force(spark):
    rng = random.Random(24)
    mails = [f"u{i}@corp{i}.example" for i in range(5)]
    rows = []
    for i in range(160):
        m = rng.choice(mails) if i % 4 == 0 else None
        t = prose(rng, rng.randrange(1, 40))
        if m:
            t += f" {m} " + (f"Name{m[1]} " if rng.random() < 0.8 else "") + prose(rng, 10) + (" +1 (212) 555-0100" if rng.random() < 0.3 else "") + " mailing"
        rows.append((i, t, "en", "a"))
    rows += [(900 + i, *rows[i][1:]) for i in range(0, 40)] + [(950, "Name1 " * 4, "en", "a"), rows[0], (960, None, "en", "a"), (961, "x" * 100_000 + " " + mails[0], "en", "a")]
    texts = [t for _, t, *_ in rows if t is not None]
    n_term = collections.Counter(w for t in texts for w in set(t.split()))
    n_entity, both = collections.Counter(), collections.Counter()
    for t in set(texts):
        spans = brute_base(t)
        ents = {(k, t[s:e]) for s, k, e in spans} | {k for _, k, _ in spans}
        free = {m[0] for m in re.finditer(r"[^ ]+", t) if not any(m.start() < e and s < m.end() for s, _, e in spans)}
        n_entity.update(ents)
        both.update((x, w) for x in ents for w in free)
    total = len(texts)
    want = collections.defaultdict(set)
    for (x, w), n in both.items():
        q, p = min(n / n_term[w], 1), n_entity[x] / total
        bits = n * math.log2(q / p) + ((n_term[w] - n) * math.log2((1 - q) / (1 - p)) if q < 1 else 0)
        if n > 1 and math.log2(q / p) > -math.log2(p) / pii.ALPHA and q >= pii.CERTAINTY and bits >= math.log2(total) + pii.EVIDENCE:
            want[x].add(w)
    assert {0} <= set(want) and any(isinstance(x, tuple) for x in want) and "mailing" in want[0]
    for r, (i, t, *_) in zip(pii.find(make(spark, rows).withColumn("value", F.lit(1)).withColumn("_pairs", F.lit(2)).coalesce(1)).collect(), rows):
        spans = brute_base(t or "")
        terms = set().union(*(want[(k, t[s:e])] | want[k] for s, k, e in spans)) if spans else set()
        free = [m for m in re.finditer(r"[^ ]+", t or "") if not any(m.start() < e and s < m.end() for s, _, e in spans)]
        assert r.doc_id == i and r.n_term == sum(m[0] in terms for m in free), (r, terms)


# op7


def test_suffix_tree_scores(spark, edge_rows):
    rng = random.Random(14)
    rows = [(1000 + i, prose(rng, 60), "en", "a") for i in range(120)] + [r for r in edge_rows if r[0] is not None] + [(5000, "A B zzqx", "en", "a")]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tok = lambda t: (t or "").encode().translate(low).split()
    c, ends = collections.Counter(), 0
    for i, t, *_ in rows:
        if not held(i):
            c.update(tok(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    d = make(spark, rows)
    train = d.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    got = suffixtree.score(d, train).collect()
    assert len(got) == len(rows)
    want = collections.defaultdict(list)
    for i, t, *_ in rows:
        w = tok(t)
        want[i].append((len(w) + 1, sum(c[x] > 0 for x in w) + 1, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))))
    for r in got:
        a, b, s = want[r.doc_id][0]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (a, b, n) and abs(r.base_score - s) < 1e-6 * max(1, abs(s)) and r.score < 0


def test_suffix_tree_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixtree, "SUPPORT", 4)
    monkeypatch.setattr(suffixtree, "EVIDENCE", 3.0)
    rng = random.Random(15)
    d = make(spark, [(i, " ".join(w + " " + (w[::-1] if rng.random() < 0.7 else rng.choice(WORDS)) for w in rng.choices(WORDS, k=rng.randrange(0, 40))), "en", "a") for i in range(80)] + [(90, None, "en", "a"), (91, "never seen Words", "en", "a"), (91, "never seen Words", "en", "a")])
    train = d.filter("doc_id < 70").withColumn("n", F.lit(1))
    whole = {r.doc_id: r.score for r in suffixtree.score(d, train).collect()}
    monkeypatch.setattr(suffixtree, "PAIRS", 5)  # nearly all pairs come by the join
    assert all(abs(r.score - whole[r.doc_id]) < 1e-4 * max(1, abs(whole[r.doc_id])) for r in suffixtree.score(d, train).collect())
    texts = [(r.doc_id, (r.text or "").lower().split()) for r in d.collect()]
    seq = [["^", *w, "$"] for i, w in texts if i < 70]
    n = collections.Counter(x for s in seq for x in s)
    pair = collections.Counter(p for s in seq for p in zip(s, s[1:]))
    tokens_ = sum(n.values()) - n["^"]
    vocab = len(n) - 1
    mu = max(1.0, vocab / max(1.0, math.log(tokens_ / vocab)))
    tree = suffixtree.train(spark.createDataFrame([(bytearray(w.encode()), c) for w, c in n.items() if w not in "^$"], "word binary, n long"))

    def plain(w):
        if w == "$":
            return n["$"] / (tokens_ + mu)
        b = np.frombuffer(w.encode(), np.uint8)
        return (n[w] + mu * 10 ** float(tree.word_scores(b, np.array([0]), np.array([len(b)]))[0])) / (tokens_ + mu)

    pairs = {p: c for p, c in pair.items() if c > 1 and n[p[0]] >= 4}
    gain = {p: c * math.log(c / n[p[0]] / plain(p[1])) for p, c in pairs.items()}
    ctx = {p[0] for p in pairs if sum(g for q, g in gain.items() if q[0] == p[0]) / n[p[0]] >= suffixtree.WORD_DIVERGENCE}
    kept = {p: c for p, c in pairs.items() if p[0] in ctx and gain[p] >= 3.0}
    left = {x: (n[x] - sum(c for p, c in kept.items() if p[0] == x) + 0.5 * sum(p[0] == x for p in kept)) / n[x] for x in ctx}
    for i, w in texts:
        s = ["^", *w, "$"]
        want = sum(math.log10(((kept[p] - 0.5) / n[p[0]] if p in kept else 0) + left.get(p[0], 1) * plain(p[1])) for p in zip(s, s[1:]))
        assert abs(want - whole[i]) < 1e-4 * max(1, abs(want)), i
    assert len(kept) > 20
    assert suffixtree.score(d.limit(0), train).count() == 0


@pytest.mark.parametrize("most", [12, 3, 0])
def test_suffix_tree_scores_are_the_same_whatever_is_held(spark, monkeypatch, most):
    """Words that are not held are contexts and next words like the others; with none held, every pair comes by the joins."""
    monkeypatch.setattr(suffixtree, "SUPPORT", 4)
    monkeypatch.setattr(suffixtree, "EVIDENCE", 3.0)
    rng = random.Random(16)
    d = make(spark, [(i, " ".join(w + " " + (w[::-1] if rng.random() < 0.7 else rng.choice(WORDS)) for w in rng.choices(WORDS, k=rng.randrange(0, 40))), "en", "a") for i in range(80)] + [(90, None, "en", "a"), (91, "never seen Words", "en", "a"), (91, "never seen Words", "en", "a")])
    train = d.filter("doc_id < 70")
    whole = sorted(tuple(r) for r in suffixtree.score(d, train).collect())
    monkeypatch.setattr(suffixtree, "HEAD", most)
    got = sorted(tuple(r) for r in suffixtree.score(d, train).collect())
    assert [r[:4] for r in got] == [r[:4] for r in whole]
    assert all(abs(a[5] - b[5]) < 1e-4 * max(1, abs(b[5])) for a, b in zip(got, whole, strict=True))


def test_suffix_tree_asks_for_each_word_that_is_not_held_once(spark, monkeypatch):
    """Its pairs and its weight as a context come with it: no row for each of its pairs is made besides."""
    for name, v in (("SUPPORT", 4), ("EVIDENCE", 3.0), ("HEAD", 3)):
        monkeypatch.setattr(suffixtree, name, v)
    rng = random.Random(11)
    d = make(spark, [(i, prose(rng, 60, WORDS[:12]), "en", "a") for i in range(60)])
    out = suffixtree.score(d, d.filter("doc_id % 5 != 0"))
    out.collect()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1


def test_suffix_tree_without_training(spark):
    d = make(spark, [(1, "a b", "en", "a"), (2, None, "en", "a")])
    got = {r.doc_id: r for r in suffixtree.score(d, d.limit(0)).collect()}
    assert got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].base_score == 0 and got[1].score < got[2].score


def test_word_and_byte_models_are_distributions(spark):
    vocab = spark.createDataFrame([(bytearray(b"ab"), 3), (bytearray(b"ba"), 2), (bytearray(b"abab"), 1)], "word binary, n long")
    tree = suffixtree.train(vocab)
    assert np.allclose((10.0 ** tree.log10).sum(1), 1, atol=1e-3)


# op9


@pytest.mark.parametrize("n", [30, 800, 12_000])
def test_ann(spark, n):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(12, 16))
    x = (centre[rng.integers(0, 12, n)] + 0.6 * rng.normal(size=(n, 16))).astype(np.float32)
    x[n // 2 : n // 2 + n // 3] = x[n // 2]  # one vector over a third of the rows
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(x)] + [(0, x[0].tolist(), "x", 1), (0, (x[0] + 9).tolist(), "x", 1)] + [(100_000, None, "x", 1), (200_000, [0.0] * 16, "x", 1), (300_000, [float("nan")] * 16, "x", 1), (400_000, [None] * 16, "x", 1), (500_000, [1.0], "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, part int")
    got = collections.defaultdict(list)
    index = ann.fit(df.filter("vec_id < 100000").dropDuplicates(["vec_id"]).select("vec_id", F.col("embedding").cast("array<double>").alias("v")))
    assert (index.leaves, index.root.parts) == (1, 1) if n == 30 else index.leaves >= n // 500 > 0 and index.probes < index.leaves
    for r in ann.search(df, "vec_id % 10 = 0").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    y = x.astype(np.float64)
    hit = total = 0
    for q in range(0, n, 10):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        near = np.lexsort((np.arange(n), d))[:10]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and all(abs(s - d[v]) < 1e-9 for _, v, s in mine) and [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        hit += len({v for _, v, _ in mine} & set(near.tolist()))
        total += 10
    assert hit / total >= (1.0 if n == 30 else 0.9), hit / total
    assert set(got) == set(range(0, n, 10))


def test_ann_rerank_is_exact():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(700, 8)), rng.integers(0, 2, (300, 8)).astype(float), 1e8 + rng.normal(size=(50, 8)), rng.normal(size=(20, 8)) * 1e-170])
    y, ids = np.concatenate([x[::3], np.zeros((1, 8))]), rng.permutation(len(x)) * 3
    for a, b in ((x, y), (np.concatenate([x, np.full((3, 8), 1e200)]), y), (x[:4], y)):
        names = np.concatenate([ids, [-1, -2, -3]])[: len(a)]
        row, near, d = ann.rerank(a, names, b, 11)
        for i in range(len(b)):
            with np.errstate(over="ignore"):
                own = np.sqrt(((a - b[i]) ** 2).sum(1))
            want = np.lexsort((names, own))[:11]
            assert near[row == i].tolist() == names[want].tolist() and d[row == i].tolist() == own[want].tolist()
    assert [len(z) for z in ann.rerank(x[:0], ids[:0], y, 11)] == [0, 0, 0]


def test_ann_router_learns_in_single_precision():
    x = np.random.default_rng(2).normal(size=(400, 8))
    r = ann.train(x, 4, 0)
    assert all(a.dtype == np.float32 for a in r.net) and (r.logits(x).argmax(1) == ann.partition(x, ann.knn(x, 16), 4)).mean() > 0.9


def test_ann_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.search(df).collect()] == [(0, 1, 1)]
    assert ann.search(df.filter("vec_id = 0")).count() == 0 and ann.search(df.limit(0)).count() == 0


def test_partition_is_balanced():
    x = np.random.default_rng(3).normal(size=(600, 8))
    side = ann.partition(x, ann.knn(x, 8), 6)
    assert np.bincount(side, minlength=6).max() <= 110 and np.bincount(side, minlength=6).min() >= 90


# op10


def quality_rows(rng, n=300):
    rows, labels = [], []
    for i in range(n):
        junk = i % 5 == 0
        t = prose(rng, 60)
        rows.append((i, t.upper().replace(" ", "!! ") if junk else t.capitalize() + ".", "en", "a"))
        if i % 2 == 0:
            labels.append((i, int(not junk), 0))
    return rows, labels


def test_quality_learns_from_positives_and_unlabelled(spark):
    rows, labels = quality_rows(random.Random(17))
    d, lab = make(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(d, lab)
    got = {r.doc_id: r for r in quality.score(d, model).collect()}
    right = sum(got[i].predicted == int(i % 5 != 0) for i in range(300))
    assert right >= 290 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    other = spark.createDataFrame([(i, q if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - q, x) for i, q, x in labels], "doc_id long, quality int, toxic int")
    same = {r.doc_id: r.score for r in quality.score(d, quality.fit(d, other)).collect()}
    assert all(abs(same[i] - got[i].score) < 1e-12 for i in same)  # held-out labels don't matter
    kept = quality.score(d, model, keep=True)
    assert kept.columns == [*d.columns, "_score", "_predicted"]


def test_quality_edges(spark, edge_rows):
    d = make(spark, edge_rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(d, none) is None and {r.score for r in quality.score(d, None).collect()} == {0.5}
    rows, labels = quality_rows(random.Random(18), 60)
    model = quality.fit(make(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = quality.score(d, model).collect()
    assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 for r in got) and quality.score(d.limit(0), model).count() == 0


def test_quality_samples_ids_once(spark):
    rows, labels = quality_rows(random.Random(19), 60)
    many = make(spark, rows + [(2, f"row {i} of one id", "en", "a") for i in range(300)]).withColumn("_p", F.lit(7)).withColumn("_id", F.lit("x"))
    lab = spark.createDataFrame(labels * 2, "doc_id long, quality int, toxic int")
    ids = quality.sample(many, lab, 3, 1)
    assert ids.count() == ids.distinct().count() <= 120
    got = quality.score(many, quality.fit(many, lab), keep=True)
    assert got.count() == 360 and quality.score(many, quality.fit(many, lab)).count() == 360


def test_quality_risk_is_that_of_the_formula():
    rng = np.random.default_rng(3)
    pos, unl = rng.normal(1, 1, (300, 4)), rng.normal(0, 1, (500, 4))
    m = quality.fit_nnpu(pos, unl, 0.4)
    loss = lambda x, y: np.logaddexp(0, -y * m.logit(x)).mean()
    risk = 0.4 * loss(pos, 1) + max(0.0, loss(unl, -1) - 0.4 * loss(pos, -1))
    base = min(0.4 * np.logaddexp(0, -s) + max(0.0, np.logaddexp(0, s) - 0.4 * np.logaddexp(0, s)) for s in np.linspace(-5, 5, 101))
    assert risk < base  # below what any constant score has


def test_lexical_features_tell_words_apart():
    a, b, c, e = quality.features(pa.array(["one two three", "One TWO three", "one two other", ""]))
    assert (a[quality.FORM :] == b[quality.FORM :]).all() and not (a[quality.FORM :] == c[quality.FORM :]).all() and not e.any()


def test_class_prior():
    rng = np.random.default_rng(2)
    pos = rng.normal(1, 0.3, 4000)
    unl = np.concatenate([rng.normal(1, 0.3, 2800), rng.normal(-1, 0.3, 1200)])
    assert abs(quality.class_prior(pos, unl) - 0.7) < 0.06


def test_mixing_keeps_columns_and_decides_each_row(spark):
    rng = random.Random(51)
    rows = [(i // 2, prose(rng, 30), "en", "abc"[i % 3]) for i in range(300)]  # two rows of one id, of one size
    d = make(spark, rows).withColumn("_g", F.lit(1)).withColumn("taken", F.lit("old")).withColumn("c1", F.lit("mine"))
    slim, full = mixing.mix(d), mixing.mix(d, keep=True)
    assert full.columns == [c for c in d.columns if c != "taken"] + ["size", "source_size", "target", "copies", "taken"]
    assert sorted((r.doc_id, r.taken) for r in slim.collect()) == sorted((r.doc_id, r.taken) for r in full.collect())
    assert sorted((r.text, r.taken) for r in full.collect()) == sorted((r.text, r.taken) for r in mixing.mix(d.repartition(5), keep=True).collect())
    assert full.filter("c1 <> 'mine' or _g <> 1").count() == 0


def test_mixing_with_many_sources(spark, monkeypatch):
    rng = random.Random(52)
    d = make(spark, [(i, prose(rng, rng.randrange(1, 30)), "en", None if i % 50 == 0 else "hot" if i % 3 else f"s{i}") for i in range(600)])
    want = sorted((r.doc_id, r.taken) for r in mixing.mix(d).collect())
    monkeypatch.setattr(mixing, "MAX_SENT", 1)  # as if they were too many to send
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(d).collect()) == want
