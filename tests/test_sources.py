import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus, phrases, roles
from corpusloom.plans.analysis import Lexicons, analyse
from corpusloom.sources import files, postings
from corpusloom.streaming import ingest

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def make_files(d):
    (d / "a.txt").write_bytes("caf\xe9 notes ".encode("cp1252") + b"x" * 700)
    (d / "b.md").write_text("“hi”")
    (d / "c.pdf").write_bytes(b"\x89PNG\r\n\x1a\nxxxx")
    (d / "d.pdf").write_bytes(b"junk" * 10 + b"%PDF-1.7 ...")
    (d / "e.exe").write_bytes(b"MZ")
    with zipfile.ZipFile(d / "g.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body><w:p><w:r><w:t>Para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    (d / "h.docx").write_bytes(b"not a zip")


def test_extract(spark, tmp_path):
    make_files(tmp_path)
    raw = files.read_binary(spark, str(tmp_path))
    pdf = spark.createDataFrame([(next(r.path for r in raw.collect() if r.path.endswith("d.pdf")), "tiny", "y" * 300, 2)], "path string, primary string, fallback string, n_pages int")
    got = {r.path[-5:]: r for r in files.extract(raw, pdf).collect()}
    assert got["a.txt"].text.startswith("café notes") and got["a.txt"].error is None and got["/b.md"].text == '"hi"'
    assert got["c.pdf"].error == "not_a_pdf" and got["e.exe"].error == "unsupported_type"
    assert got["d.pdf"].text == "y" * 300 and got["d.pdf"].has_text_layer and got["d.pdf"].n_pages == 2
    assert got[".docx"[:5]] is not None
    docx = {r.path[-6:]: r for r in files.extract(raw).collect()}
    assert docx["g.docx"].text == "Para\nCell" and docx["g.docx"].has_tables and docx["h.docx"].error.startswith("corrupt") and docx["/d.pdf"].error == "no_pdf_reader"
    checks = spark.createDataFrame([("f.txt", bytearray(), 0), ("g.txt", bytearray(b"x"), 6 << 20)], "path string, content binary, length long")
    assert [r.e for r in checks.select(files.upload_error(checks).alias("e")).collect()] == ["empty_file", "file_too_large"]
    named = raw.filter(F.col("path").endswith("c.pdf")).select(files.pdf_problem(F.col("content")).alias("p")).first().p
    assert "PNG" in named


def test_postings_json(spark, tmp_path):
    jobs = [{"id": "a", "title": "T", "description": "D", "requirements": "one", "experience_years": "x"}, 5, {"id": "a", "title": "again", "description": "D"}, {"title": "U", "description": "E", "requirements": ["p", "q"], "experience_years": 2}, {"title": "", "description": "F"}]
    (tmp_path / "j.json").write_text(json.dumps({"version": 1, "jobs": jobs}))
    got = postings.read_json(spark, str(tmp_path / "j.json")).orderBy("ord").collect()
    assert [(r.id, r.requirements, r.experience_years) for r in got] == [("a", ["one"], 0.0), ("job-00003", ["p", "q"], 2.0)]
    (tmp_path / "k.json").write_text(json.dumps(jobs[:1]))
    assert postings.read_json(spark, str(tmp_path / "k.json")).count() == 1


def test_csv_lines_and_rejects(spark, tmp_path):
    (tmp_path / "p.csv").write_text('﻿title,description\n"Data\nEngineer","' + "d" * 50 + '"\n,"x"\n"Engineer","short, ""really"""\n')
    raw = postings.read_csv(spark, str(tmp_path / "p.csv"))
    assert [(r.csv_line, r.title) for r in raw.orderBy("csv_line").collect()] == [(2, "Data\nEngineer"), (4, ""), (5, "Engineer")]
    conv = corpus.convert(raw, spark.createDataFrame([("data engineer", "Data Engineer")], "phrase string, family string"))
    assert [r.title for r in corpus.accepted(conv).collect()] == ["Data Engineer"]
    postings.write_rejects(corpus.rejected(conv), str(tmp_path / "out"))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        postings.write_rejects(corpus.rejected(conv), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_several_files_keep_all_rows(spark, tmp_path):
    for f in "ab":
        (tmp_path / f"{f}.json").write_text(json.dumps([{"title": f"T{f}{i}", "description": "D"} for i in range(3)] + [{"id": "job-00001", "title": "own id", "description": "D"}, 7]))
    got = postings.read_json(spark, str(tmp_path / "*.json")).collect()
    assert len(got) == len({r.id for r in got}) == 7 and {r.title for r in got} >= {f"T{f}{i}" for f in "ab" for i in range(3)}
    assert sorted(r.reason for r in postings.json_rejects(spark, str(tmp_path / "*.json")).collect()) == ["not an object", "not an object", "repeated id"]
    d = tmp_path / "csv"
    d.mkdir()
    (d / "a.csv").write_text("title,description\n" + "".join(f"Data Engineer {i},{'d' * 50}\n" for i in range(3)))
    (d / "b.csv").write_text("description,title,city\n" + "".join(f"{'e' * 50},Data Engineer {i},Ulm\n" for i in range(3)) + f"{'e' * 50},Cook,Ulm\n")
    raw = postings.read_csv(spark, str(d))
    assert raw.count() == 7 and postings.read_csv(spark, str(d), limit=2).count() == 4
    conv = corpus.convert(raw, spark.createDataFrame([("data engineer", "Data Engineer")], "phrase string, family string"))
    ok = corpus.accepted(conv).orderBy("csv_file", "csv_line").collect()
    assert [r.id for r in ok] == [f"job-{i:05d}" for i in range(1, 7)] and [r.location for r in ok] == [""] * 3 + ["Ulm"] * 3
    out = corpus.rejected(conv).collect()
    assert [(r.csv_file[-5:], r.csv_line, r.title) for r in out] == [("b.csv", 5, "Cook")]


def test_ids_are_numbered_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(corpus, "RANGE", 3)
    raw = spark.createDataFrame([(i, "Data Engineer", "d" * 50) for i in range(2, 22)], "csv_line long, title string, description string")
    conv = corpus.convert(raw, spark.createDataFrame([("data engineer", "Data Engineer")], "phrase string, family string"))
    assert [(r.csv_line, r.id) for r in conv.orderBy("csv_line").collect()] == [(i, f"job-{i - 1:05d}") for i in range(2, 22)]


def test_long_family_phrases(spark):
    phrase = "senior lead of the very large data platform team"
    rows = spark.createDataFrame([(1, f"The {phrase}!"), (2, "Data platform")], "id int, title string")
    got = corpus.title_family(rows, "id", "title", spark.createDataFrame([(phrase, "Long"), ("data platform", "Short")], "phrase string, family string"))
    assert {r.id: r.family for r in got.collect()} == {1: "Long", 2: "Short"}


def test_recommend_without_a_hit(spark):
    from corpusloom.functions import python_udfs as P
    from corpusloom.functions import text as T
    from corpusloom.operators import ir

    jobs = spark.createDataFrame([(f"j{i}", "baker", "bread and rolls", "oven", "Ulm", "food", 0.0, i) for i in range(5)], "job_id string, title string, description string, requirements string, location string, category string, experience_years double, ord int")
    people = spark.createDataFrame([(1, "quantum optics", []), (2, "bread", [])], "resume_id int, text string, skills array<string>")
    got = ir.recommend(people, jobs, lambda c: P.hash_embedding(T.content_tokens(c)), limit=3, pool=4).orderBy("resume_id", "rank").collect()
    assert [(r.resume_id, r.job_id) for r in got] == [(1, "j0"), (1, "j1"), (1, "j2"), (2, "j0"), (2, "j1"), (2, "j2")]
    assert all(r.bm25 == 0 for r in got[:3]) and all(r.bm25 > 0 for r in got[3:])


def test_streaming_intake(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.txt").write_text("same")
    (src / "2.txt").write_text("same")
    (src / "3.txt").write_text("other")
    s = ingest.dedupe(ingest.file_stream(spark, str(src)))
    ingest.start(s, lambda b: b.select("path", "file_hash"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_analysis_plan(spark):
    onto = phrases.ontology(spark.createDataFrame([("Python", "lang", []), ("SQL", "db", [])], "name string, category string, aliases array<string>"))
    lab = spark.createDataFrame([("dev", 1, "Python"), ("dba", 2, "SQL")], "role string, item int, name string")
    lex = Lexicons(spark.createDataFrame([("SKILLS", "skills"), ("EXPERIENCE", "experience")], "canonical string, variant string"), onto, roles.profiles(lab, "role", "item", "name"), ["built"])
    text = "Jane Doe\njane@example.com\nEXPERIENCE\n* Built Python tools for 30 users in one busy team over years\nJan 2022 - Dec 2022\nSKILLS\nPython, Pythn"
    r = analyse(spark.createDataFrame([(1, text), (2, "nothing here")], "id int, text string"), "id", lex).orderBy("id").collect()
    assert r[0].role == "dev" and r[0].skills == ["Python"] and r[0].experience_months == 12 and r[0].score > r[1].score and r[1].role is None


def test_word_lists_keep_words_only(spark, tmp_path):
    (tmp_path / "verbs.txt").write_text("# a comment\nLed\n\nbuilt\nled\n")
    assert sorted(r.word for r in postings.read_words(spark, str(tmp_path / "verbs.txt")).collect()) == ["built", "led"]
    assert postings.read_words(spark, str(tmp_path / "none.txt")).count() == 0


def test_corpus_sink_keeps_notes_and_refuses_losses(spark, tmp_path):
    import pytest

    path = str(tmp_path / "corpus")
    rows = lambda *r: spark.createDataFrame(r, "id string, title string, category string")
    dry = postings.write_corpus(spark, rows(("a", "x", "One"), ("b", "y", "Two")), path, "a file", dry_run=True)
    assert dry["postings"] == 2 and not dry["written"] and not (tmp_path / "corpus").exists()
    postings.write_corpus(spark, rows(("a", "x", "One"), ("b", "y", "Two")), path, "a file")
    spark.createDataFrame([("1.0.0", "s", ["mine"])], "version string, source string, notes array<string>").write.mode("overwrite").json(f"{path}/envelope")
    with pytest.raises(FileExistsError):
        postings.write_corpus(spark, rows(("c", "z", "One")), path, "again")
    with pytest.raises(ValueError, match="Two"):
        postings.write_corpus(spark, rows(("c", "z", "One")), path, "again", mode="overwrite", dry_run=True)
    done = postings.write_corpus(spark, rows(("a", "other", "One"), ("c", "z", "One")), path, "again", mode="append")
    assert done["postings"] == 1 and done["notes"] == ["mine"]
    assert {(r.id, r.title) for r in spark.read.json(f"{path}/jobs").collect()} == {("a", "x"), ("b", "y"), ("c", "z")}
    postings.write_corpus(spark, rows(("c", "z", "One")), path, "again", mode="overwrite", force=True)
    assert spark.read.json(f"{path}/jobs").count() == 1 and spark.read.json(f"{path}/envelope").first()["notes"] == ["mine"]


def test_settings_are_checked(spark):
    import pytest

    from corpusloom import settings

    assert settings.read(spark).max_upload_mb == 5
    spark.conf.set("spark.corpusloom.max_upload_mb", "30")
    with pytest.raises(ValueError):
        settings.read(spark)
    spark.conf.set("spark.corpusloom.max_upload_mb", "7")
    spark.conf.set("spark.corpusloom.weight.fit", "0.5")
    with pytest.raises(ValueError):
        settings.read(spark)
    spark.conf.unset("spark.corpusloom.weight.fit")
    assert settings.read(spark).max_upload_mb == 7
    spark.conf.unset("spark.corpusloom.max_upload_mb")
