"""The pipeline's stages on a small table, held against plain Python where their decisions are fixed."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: rng.choice(["tha", "ther", "onin"]) + rng.choice(["st", "ly", "ion", "er"]) + rng.choice(["a", "e", ""])
    text = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    docs = [(i, text(80), "en", "ab"[i % 2], 0) for i in range(300)]
    docs += [(1000 + i, text(80).upper().replace(" ", "!! "), "en", "a", 0) for i in range(150)]
    docs += [(400, docs[0][1], "en", "a", 0), (401, docs[1][1].replace(".", " more."), "en", "a", 0)]
    item = text(40)
    docs += [(410, text(40) + " " + item + " " + text(40), "en", "b", 0), (411, text(40) + " write to x.y@example.com " + text(40), "en", "b", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(300)] + [(1000 + i, 0, 0) for i in range(150)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    at = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf)
        if name != "source_mixing":
            assert out.columns == at.columns
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id for r in at.select("doc_id").collect()})
    good, single, clean, private, mixed = seen
    assert sum(i >= 1000 for i in good) <= 3 and len(good) >= 290
    assert {400, 401} & single == set() and {0, 1} <= single | (set(range(204)) - good)
    assert 410 not in clean and private == clean and mixed <= clean
    rows = {r.doc_id: r for r in at.collect()}
    if 411 in rows:
        assert "x.y@example.com" not in rows[411].text and "<email>" in rows[411].text
    assert all(r.taken == r.copies * r["size"] and r.copies in (1, 2) for r in rows.values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == mixed


def test_stages_bear_nulls_and_clashing_names(spark, tmp_path):
    """Extra columns named like those that the stages use inside, nulls in every column, an empty and a long text, repeated rows."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["thasta", "therly", "oninion", "ster"]) + str(rng.randrange(30)) for _ in range(n))
    names = ["size", "Target", "_gone", "_leak", "_pairs", "_row", "_r", "_score", "_predicted", "_id", "extra0", "dotted.name"]
    rows = [(i, text(60), "en", "ab"[i % 2], 9) for i in range(20)] + [(None, None, None, None, None), (30, "", "en", None, 0), (31, text(5000), None, "a", 1), (1, "again", "en", "b", 5), (1, "again", "en", "b", 5)]
    docs = spark.createDataFrame([(*r, *(f"{n}-{r[0]}" for n in names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, text(30)), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for n, table in enumerate((docs, docs.limit(0))):
        at = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, str(tmp_path))
            if name != "source_mixing":
                assert out.columns == docs.columns
                assert all(r["_gone"] == f"_gone-{r.doc_id}" and r["extra0"] == f"extra0-{r.doc_id}" for r in out.collect())
                out.write.parquet(str(tmp_path / f"{n}-{name}"))
                at = spark.read.parquet(str(tmp_path / f"{n}-{name}"))
        assert {"size", "target", "copies", "taken", "_id", "_row"} <= set(out.columns) and "Target" not in out.columns
        got = out.collect()
        assert all(r["_id"] == f"_id-{r.doc_id}" for r in got)
        assert all(r.taken == r.copies * r["size"] for r in got)  # a text without words may be taken, with no words
        assert all(r["size"] == len((r.text or "").split()) for r in got), [(r.doc_id, r["size"], len((r.text or "").split())) for r in got]
