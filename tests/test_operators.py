import datetime
import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import python_udfs as P
from corpusloom.functions import text as T
from corpusloom.operators import corpus, evaluate, facts, ir, layout, lines, matching, phrases, roles, scorecard, store


def test_bm25_equals_its_formula_and_filters_leave_idf_alone(spark):
    docs = [(1, "red apple pie"), (2, "green apple apple"), (3, "blue sky")]
    d = spark.createDataFrame(docs, "id int, text string")
    q = spark.createDataFrame([(9, "apple sky apple")], "q int, text string")
    got = {r.id: r.bm25 for r in ir.bm25(d, "id", q, "q").collect()}
    toks = {i: t.split() for i, t in docs}
    avg = sum(map(len, toks.values())) / 3
    idf = lambda w: math.log(1 + (3 - sum(w in t for t in toks.values()) + 0.5) / (sum(w in t for t in toks.values()) + 0.5))
    for i, t in toks.items():
        want = sum(n * idf(w) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w, n in Counter("apple sky apple".split()).items())
        assert abs(got[i] - want) < 1e-9
    some = {r.id: r.bm25 for r in ir.bm25(d, "id", q, "q", candidates=F.col("id") == 2).collect()}
    assert list(some) == [2] and abs(some[2] - got[2]) < 1e-12


def test_lexical_cosine_of_equal_texts_is_one(spark):
    a = spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma")], "a int, text string")
    b = spark.createDataFrame([(7, "alpha beta beta"), (8, "beta delta")], "b int, text string")
    got = {(r.a, r.b): r.lexical for r in ir.lexical_cosine(a, "a", b, "b").collect()}
    assert abs(got[1, 7] - 1) < 1e-9 and 0 < got[1, 8] < 1 and (2, 7) not in got


def test_recommend_ranks_and_filters(spark):
    jobs = spark.createDataFrame(
        [(i, f"j{i}", t, d, ["sql"], "Chennai" if i % 2 else "Pune", "Data", float(i), i) for i, (t, d) in enumerate([("Data engineer", "spark sql pipelines"), ("Designer", "figma colour type"), ("Analyst", "sql dashboards")])],
        "n int, job_id string, title string, description string, requirements array<string>, location string, category string, experience_years double, ord int",
    )
    res = spark.createDataFrame([(1, "wrote spark sql pipelines", ["sql"])], "resume_id int, text string, skills array<string>")
    emb = lambda c: P.hash_embedding(T.content_tokens(c))
    got = ir.recommend(res, jobs, emb, limit=2).orderBy("rank").collect()
    assert [r.job_id for r in got][0] == "j0" and got[0].score >= got[1].score
    assert {r.job_id for r in ir.recommend(res, jobs, emb, max_experience=0).collect()} == {"j0"}
    with pytest.raises(ValueError):
        ir.recommend(res, jobs, emb, limit=51)


HEAD = [("EXPERIENCE", "work history"), ("SKILLS", "technical skills"), ("EDUCATION", "academics")]


def reference_marks(kinds):
    """The line-by-line state machine over l(exicon), s(haped), p(lain)."""
    out, seen, dropped, before = [], False, False, False
    for i, k in enumerate(kinds):
        name = k == "l" or (k == "s" and seen)
        if not name:
            dropped = before = False
            out.append(False)
            continue
        if k == "s":
            nxt = i + 1 >= len(kinds) or kinds[i + 1] == "l" or (kinds[i + 1] == "s" and seen)
            if before or dropped or nxt:
                dropped, before = True, False
                out.append(False)
                continue
        dropped, before = False, True
        seen = seen or k == "l"
        out.append(True)
    return out


def test_segmentation_equals_the_state_machine(spark):
    rng = random.Random(4)
    line = {"l": "Work History", "s": "Open Source Work", "p": "wrote some lines of text."}
    cases = [[rng.choice("lsp") for _ in range(rng.randrange(1, 9))] for _ in range(150)]
    docs = spark.createDataFrame([(i, "\n".join(line[k] for k in c)) for i, c in enumerate(cases)], "id int, text string")
    got = lines.mark_headings(lines.line_spans(docs, "id"), "id", spark.createDataFrame(HEAD, "canonical string, variant string")).collect()
    marks = {(r.id, r.line_no): r.name is not None for r in got}
    for i, c in enumerate(cases):
        assert [marks[i, j] for j in range(len(c))] == reference_marks(c), c


def test_sections_offsets_slice_the_text(spark):
    text = "Jane Doe\n\nWork History:\n  built it  \n\nmore\nSKILLS\n"
    docs = spark.createDataFrame([(1, text), (2, "no headings"), (3, None)], "id int, text string")
    got = {(r.id, r.ord): r for r in lines.sections(docs, "id", spark.createDataFrame(HEAD, "canonical string, variant string")).collect()}
    exp = got[1, 1]
    assert exp.name == "EXPERIENCE" and exp.body == "built it\nmore" and text[exp.start : exp.end] == "built it  \n\nmore"
    assert got[1, 0].body == "Jane Doe" and got[1, 2].body == "" and got[2, 1].name == "BODY" and got[3, 1].body == ""


def test_highlight_pieces_join_to_the_text(spark):
    docs = spark.createDataFrame([(1, "knows sql and go"), (2, "none")], "id int, text string")
    sp = spark.createDataFrame([(1, 6, 9, "SQL"), (1, 7, 12, "bad"), (1, 14, 16, "Go")], "id int, start int, end int, label string")
    got = lines.highlight(docs, "id", sp).orderBy("id", "at").collect()
    assert [(r.piece, r.label) for r in got if r.id == 1] == [("knows ", None), ("sql", "SQL"), (" and ", None), ("go", "Go")]
    assert [r.piece for r in got if r.id == 2] == ["none"]


def test_interval_merge_cases(spark):
    rows = [(1, 1, 3), (1, 3, 5), (1, 7, 9), (2, 1, 10), (2, 2, 3), (3, 5, 5), (3, 6, 4), (4, 1, 2), (4, 1, 2)]
    got = facts.merge_intervals(spark.createDataFrame(rows, "id int, start int, end int"), "id").collect()
    assert sorted((r.id, r.start, r.end) for r in got) == [(1, 1, 5), (1, 7, 9), (2, 1, 10), (4, 1, 2)]


def test_facts(spark):
    text = "Ravi K. Menon\nravi.menon@example.com | +91 98765 43210 | github.com/ravi\nEDUCATION\nB.E Computer Science, Anna University\nCGPA: 8.7/10, 91% in class\nJun 2022 - Aug 2022 then 2023 to present\nplease be kind"
    r = facts.entities(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), "id").orderBy("id").collect()
    a = r[0]
    assert (a.name, a.email, a.github, a.cgpa, a.percentage) == ("Ravi K. Menon", "ravi.menon@example.com", "github.com/ravi", 8.7, 91.0)
    assert a.degrees == ["B.E"] and a.has_full_contact and a.institutions == ["B.E Computer Science, Anna University"] and a.degree_level == 3
    d = [(x.start_year, x.start_month, x.end_year, x.end_month, x.is_current) for x in a.date_ranges]
    assert d == [(2022, 6, 2022, 8, False), (2023, None, None, None, True)]
    m = facts.experience_months(spark.createDataFrame(r[:1], facts.entities(spark.createDataFrame([(1, text)], "id int, text string"), "id").schema), "id", "date_ranges", F.lit(datetime.date(2023, 6, 1))).first()
    assert m.experience_months == 3 + 6
    assert r[1].email is None and r[1].degrees == []


@pytest.mark.parametrize("jd, years", [("2-4 years of work", 2.0), ("3+ years. We are 20 years in business", 3.0), ("at least 5 yrs", 5.0), ("since 2010", None), ("3\nyears needed", 3.0), ("", None)])
def test_required_years(spark, jd, years):
    assert spark.createDataFrame([(jd,)], "t string").select(facts.required_years(F.col("t")).alias("y")).first().y == years


def test_degree_guard(spark):
    got = spark.createDataFrame([("It would be great. Contact me.",)], "t string").select(facts.required_degree_level(F.col("t")).alias("a"), facts.required_degree_level(F.col("t"), guard=True).alias("b"), facts.degrees(F.col("t")).alias("c")).first()
    assert got.a == 4 and got.b == 0 and got.c == []


ONTO = [("Machine Learning", "ai", ["ml"]), ("Learning", "x", []), ("Python", "lang", []), ("Go", "lang", ["golang"]), ("C", "lang", []), ("SQL", "db", []), ("Kubernetes", "ops", [])]


def onto(spark):
    return phrases.ontology(spark.createDataFrame(ONTO, "name string, category string, aliases array<string>"))


def test_phrases_longest_first_with_offsets(spark):
    text = "Deep Machine, Learning. And Python... learning"
    hits = phrases.find(spark.createDataFrame([(1, text)], "id int, text string"), "id", onto(spark)).orderBy("start").collect()
    assert [h.name for h in hits] == ["Machine Learning", "Python", "Learning"] and all(text[h.start : h.end] == h.surface for h in hits)


@pytest.mark.parametrize("text, names", [
    ("Go to the portal", []), ("We go fast", []), ("used Go daily", ["Go"]), ("Python, Go, SQL", ["Go", "Python", "SQL"]), ("Python and Go", ["Go", "Python"]), ("a C grade", []), ("Python, C", ["C", "Python"]), ("Python and. C rules", ["Python"]),
])
def test_ambiguous_names_need_evidence(spark, text, names):
    got = phrases.find(spark.createDataFrame([(1, text)], "id int, text string"), "id", onto(spark)).collect()
    assert sorted(h.name for h in got) == names


def test_fuzzy_tokens_in_spans_only(spark):
    text = "Kubernets outside\nKubernets, Pythn, kubernetes"
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    sp = spark.createDataFrame([(1, 18, len(text))], "id int, start int, end int")
    got = [h for h in phrases.find(docs, "id", onto(spark).filter("key <> 'kubernetes' or true"), fuzzy_spans=sp).collect() if h.method == "fuzzy"]
    assert [h.surface for h in got] == ["Pythn"]  # the other name is known from an exact hit


def test_shared_key_raises(spark):
    bad = spark.createDataFrame([("A", "x", ["same"]), ("B", "x", ["same"])], "name string, category string, aliases array<string>")
    with pytest.raises(Exception, match="share the key"):
        phrases.ontology(bad).collect()


def test_resolve_equals_a_scan(spark):
    rng = random.Random(1)
    cases = [[(rng.randrange(8), rng.randrange(1, 4)) for _ in range(rng.randrange(1, 9))] for _ in range(60)]
    rows = [(i, p, w, "k", f"{p}-{w}", "c", p, p + w, "s") for i, c in enumerate(cases) for p, w in set(c)]
    df = spark.createDataFrame(rows, "id int, pos int, width int, key string, name string, category string, start bigint, end bigint, surface string")
    got = {i: [] for i in range(len(cases))}
    for r in phrases.resolve(df, "id").collect():
        got[r.id].append(r.name)
    for i, c in enumerate(cases):
        free, want = 0, []
        for p, w in sorted(set(c), key=lambda x: (x[0], -x[1])):
            if p >= free:
                want.append(f"{p}-{w}")
                free = p + w
        assert sorted(got[i]) == sorted(want)


def test_match_prefers_the_related_posting(spark):
    docs = spark.createDataFrame([(1, "Built Python services with SQL storage and machine learning models in production.", 24, 3)], "doc_id int, text string, experience_months int, degree_level int")
    jds = spark.createDataFrame([(1, "We need Python and SQL, 2+ years. Python services in production."), (2, "Paint walls, mix colours, 9+ years, be careful with brushes.")], "jd_id int, text string")
    pairs = docs.select("doc_id").crossJoin(jds.select("jd_id"))
    o = onto(spark)
    wanted = matching.wanted_weights(phrases.find(jds, "jd_id", o), "jd_id")
    got = {r.jd_id: r for r in matching.match(docs, "doc_id", jds, "jd_id", pairs, phrases.find(docs, "doc_id", o), wanted, lambda c: P.hash_embedding(T.content_tokens(c))).collect()}
    assert got[1].score > got[2].score and got[1].matched == ["Python", "SQL"] and got[1].skill == 1.0 and got[2].skill == 0.5
    assert got[1].extra == ["Machine Learning"] and any("no known skills" in n for n in got[2].notes)
    with pytest.raises(ValueError):
        matching.check_weights({"semantic": 1.0, "skill": 1.0, "lexical": 0.0, "fit": 0.0})


def test_roles(spark):
    rows = [("dev", 1, "python"), ("dev", 1, "sql"), ("dev", 2, "python"), ("ops", 3, "linux"), ("ops", 3, "sql"), ("ops", 4, None)]
    lab = spark.createDataFrame(rows, "role string, item int, feature string")
    prof = roles.profiles(lab, "role", "item", "feature")
    assert {(r.role, r.feature): r.weight for r in prof.collect()} == {("dev", "python"): 1.0, ("dev", "sql"): 0.5, ("ops", "linux"): 0.5, ("ops", "sql"): 0.5}
    top = roles.top_with_alternatives(roles.predict(spark.createDataFrame([(1, "python"), (1, "sql")], "doc int, feature string"), "doc", prof, "role", "feature"), "doc", "role").first()
    assert top.role == "dev" and top.confidence == 1.0 and top.alternatives[0].role == "ops" and top.confident
    loo = {r.item: r.correct for r in roles.leave_one_out(lab, "item", "role", "feature").collect()}
    assert loo == {1: True, 2: True, 3: False, 4: False}
    s = spark.range(1).select(roles.softmax(F.array(F.lit(1.0), F.lit(1.0))).alias("s")).first().s
    assert s == [0.5, 0.5]


STRONG = "Jane Doe\n* Built 3 services used by 400 users across two teams last spring season\n* Reduced latency by 40% with careful caching of hot rows and query plans\nJun 2022 - Aug 2023"
WEAK = "I am a hardworking team player. My work is responsible for me. " + "x " * 20


def test_scorecard(spark):
    none = []
    rows = [(1, STRONG, "a@b.co", "1", "l", ["EDUCATION", "SKILLS", "PROJECTS"], [f"s{i}" for i in range(9)], [f"s{i}" for i in range(9)]), (2, WEAK, None, None, None, none, none, none), (3, " ", None, None, None, none, none, none)]
    df = spark.createDataFrame(rows, "id int, text string, email string, phone string, link string, sections array<string>, skills array<string>, role_keywords array<string>")
    r = scorecard.rules(df, "id", ["built", "reduced"])
    got = {(x.id, x.rule): x.earned for x in r.collect()}
    assert len(got) == 30 and got[1, "contact"] == 10 and got[1, "action_verbs"] == 10 and got[1, "quantified"] == 15 and got[1, "keywords"] == 15 and got[1, "dates"] == 5
    assert got[2, "keywords"] == 0 and got[2, "tone"] == 0 and got[2, "dates"] == 2.5
    rep = {x.id: x for x in scorecard.report(r, "id").collect()}
    assert rep[1].score > rep[2].score and rep[3].score == 0 and len(rep[2].top_fixes) == 3 and rep[1].band == "excellent"
    d = spark.createDataFrame([("Jun 2023, 07/2022, 2021 and CGPA 8.7/10",)], "t string").select(scorecard.date_forms(F.col("t")).alias("d")).first().d
    assert tuple(d) == (1, 1, 1)


def block(i, page, x0, y0, x1, y1, text):
    return (i, page, float(x0), float(y0), float(x1), float(y1), text)


def test_layout(spark):
    two = [block(1, 0, 40, y, 150, y + 10, "left text here %d" % y) for y in (10, 30, 50)] + [block(1, 0, 200, y + 1, 400, y + 11, "right text there %d" % y) for y in (10, 30, 50)]
    dates = [block(2, 0, 40, y, 300, y + 10, "a long line of ordinary words %d" % y) for y in range(0, 80, 10)] + [block(2, 0, 400, y, 440, y + 10, "2024") for y in (0, 30)]
    three = [block(3, 0, 200 * k, y, 200 * k + 100, y + 10, "column text %d" % k) for k in range(3) for y in (0, 20, 40)]
    stacked = [block(4, 0, 0, y, 100, y + 10, "top words") for y in (0, 10)] + [block(4, 0, 200, y, 300, y + 10, "bottom words") for y in (100, 110)]
    df = spark.createDataFrame(two + dates + three + stacked, "id int, page int, x0 double, y0 double, x1 double, y1 double, text string")
    cols = layout.columns(df, "id")
    assert {r.id: r.columns_per_page for r in layout.columns_per_page(cols, "id").collect()} == {1: [2], 2: [1], 3: [3], 4: [1]}
    text = {r.id: r.text for r in layout.reading_text(cols, "id").collect()}
    assert text[1].index("left text here 50") < text[1].index("right text there 10") and "here 0 2024" not in text[1]
    assert "words 0 2024" in text[2]


FAM = [("data engineer", "Data Engineer"), ("engineer", "Software Engineer"), ("data analyst", "Data Analyst"), ("ml engineer", "ML"), ("ai engineer", "AI")]


def test_import_reasons_and_ids(spark):
    long = "d" * 50
    rows = [(2, "j1", "Data Engineer II", long, "3 years", None), (3, "", " ", long, "", None), (4, "", "Engineer", "short", "", None), (5, "", "Metadata Analyst", long, "", None), (6, "", "ML Engineer / AI Engineer", long, "", None),
            (7, "", "Data Analyst", long, "ages", None), (8, "j1", "Engineer", long, "Mid-Senior level", None), (9, "", "Engineer", long, "", "Full-Time"), (10, "job-00004", "Engineer", long, "senior", "")]
    raw = spark.createDataFrame(rows, "csv_line int, job_id string, title string, job_description string, formatted_experience_level string, formatted_work_type string")
    conv = corpus.convert(raw, spark.createDataFrame(FAM, "phrase string, family string"))
    got = {r.csv_line: r for r in conv.collect()}
    want = {2: None, 3: "blank title", 4: "description too short", 5: "unknown category", 6: "ambiguous category", 7: "unparseable experience", 8: "duplicate id", 9: None, 10: None}
    assert {k: v.reject_reason for k, v in got.items()} == want
    assert got[9].id == "job-00005" and got[9].employment_type == "Full-time" and got[2].category == "Data Engineer" and got[10].experience_years == 5.0
    assert {r.reject_reason: r.n for r in corpus.reject_summary(conv).collect()}["blank title"] == 1 and corpus.rejected(conv).columns[:2] == ["csv_line", "reject_reason"]
    with pytest.raises(ValueError):
        corpus.resolve_columns(["title"])
    with pytest.raises(ValueError):
        corpus.resolve_columns(["title", "description"], {"title": "nope"})


def test_corpus_helpers(spark):
    got = spark.createDataFrame([("a thing; * b thing\n- c thing|x",)], "t string").select(corpus.requirements(F.col("t")).alias("r")).first().r
    assert got == ["a thing", "b thing", "c thing"]
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 2)], "id int, s string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", 5), (4, "q", 1)], "id int, s string, n int")
    assert {r.id: r.problem for r in corpus.reconcile(a, b, "id").collect()} == {2: "differs: n", 3: "not read back", 4: "not written"}
    bad = spark.createDataFrame([("Go", "lang", ["golang"]), ("Go", "odd", []), ("Rest", "lang", ["rest api a b c d"]), ("..", "lang", ["go"])], "name string, category string, aliases array<string>")
    kinds = {(r.kind, r.severity) for r in corpus.ontology_violations(bad, ["lang"], spark.createDataFrame([("rest",)], "word string"), ["go"]).collect()}
    assert kinds == {("repeated name", "error"), ("unknown category", "error"), ("empty key", "error"), ("wide key", "error"), ("shared key", "error"), ("unguarded word", "error"), ("no aliases", "warning")}
    assert {r.kind for r in corpus.verb_violations(spark.createDataFrame([("led",), ("Led",), ("running",)], "verb string")).collect()} == {"repeated verb", "not lower case", "gerund"}
    assert corpus.heading_violations(spark.createDataFrame([("A", "Work"), ("B", "work!")], "canonical string, variant string")).count() == 1
    pages = spark.createDataFrame([("A", "# Top\n[[B#Part|x]] [[B#Nope]] `[[C]]` [[D]] [[#Top]]"), ("B", "## Part")], "page string, text string")
    assert {(r.target, r.problem) for r in corpus.broken_links(pages).collect()} == {("D", "no such page"), ("B", "no such heading")}


def test_store(spark):
    old = spark.createDataFrame([("h1", 1)], "file_hash string, created_at int")
    new = spark.createDataFrame([("h1", 2), ("h2", 4), ("h2", 3)], "file_hash string, created_at int")
    assert [tuple(r) for r in store.insert_if_absent(old, new).collect()] == [("h2", 3)]
    empty = spark.createDataFrame([], "score int")
    assert tuple(store.totals(empty, "score").first()) == (0, 0.0, 0)
    p, c = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(7, 1), (8, 2)], "m int, resume_id int")
    left = store.cascade_delete(p, "id", c, "resume_id", p.filter("id = 1"))
    assert [r.id for r in left[0].collect()] == [2] and [r.m for r in left[1].collect()] == [8]
    with pytest.raises(ValueError):
        store.newest(old, "created_at", "file_hash", 0)


def test_evaluation(spark):
    rows = [("perfect", True, 0.9), ("perfect", False, 0.1), ("inverted", True, 0.1), ("inverted", False, 0.9), ("tied", True, 0.5), ("tied", False, 0.5), ("single", True, 0.4)]
    df = spark.createDataFrame(rows, "query string, relevant boolean, s double")
    assert {r.query: r.accuracy for r in evaluate.pair_wins(df, "s").collect()} == {"perfect": 1.0, "inverted": 0.0, "tied": 0.5}
    assert tuple(evaluate.pairwise_accuracy(df, "s").first()) == (0.5, 3)
    rng = random.Random(2)
    many = [(q, rng.random() < 0.4, rng.randrange(5) / 5) for q in range(5) for _ in range(30)]
    got = {r.query: r.accuracy for r in evaluate.pair_wins(spark.createDataFrame(many, "query int, relevant boolean, s double"), "s").collect()}
    for q in range(5):
        a = [s for k, r, s in many if k == q and r]
        b = [s for k, r, s in many if k == q and not r]
        assert abs(got[q] - sum((x > y) + 0.5 * (x == y) for x, y in itertools.product(a, b)) / (len(a) * len(b))) < 1e-12
    grid = evaluate.weight_grid(spark, ["a", "b", "c", "d"], 0.25)
    assert grid.count() == 35 and grid.distinct().count() == 35
    with pytest.raises(ValueError):
        evaluate.weight_grid(spark, ["a", "b"], 0.3)
    w = evaluate.pair_wins(df, "s")
    assert evaluate.bootstrap(spark, w, w).first().win_rate == 0.0
    lab = spark.createDataFrame([("q", ["a", "zz"], ["b"])], "query string, relevant array<string>, irrelevant array<string>")
    assert [r.id for r in evaluate.unknown_labels(lab, spark.createDataFrame([("a",), ("b",)], "id string"), "id").collect()] == ["zz"]
    assert evaluate.corpus_pairs(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, c string"), "id", "c").count() == 6


def test_label_files_refuse_unknown_ids_and_know_a_closed_world(spark, tmp_path):
    import json

    from corpusloom.operators import evaluate

    corpus = spark.createDataFrame([(c,) for c in "abcd"], "id string")
    good = {"queries": [{"name": "q", "relevant": ["a"], "irrelevant": ["b"]}, {"resume": "in/some.pdf", "relevant": ["c"]}]}
    (tmp_path / "l.json").write_text(json.dumps(good))
    rows = {tuple(r) for r in evaluate.read_labels(spark, str(tmp_path / "l.json"), corpus, "id").collect()}
    assert rows == {("q", "a", True), ("q", "b", False), ("some.pdf", "c", True)}
    assert evaluate.read_labels(spark, str(tmp_path / "l.json"), corpus, "id", closed_world=True).count() == 8
    (tmp_path / "l.json").write_text(json.dumps([{"name": "q", "relevant": ["zz"]}]))
    with pytest.raises(ValueError, match="zz"):
        evaluate.read_labels(spark, str(tmp_path / "l.json"), corpus, "id")


def test_tuning_names_ties_and_dropped_queries(spark):
    from corpusloom.operators import evaluate

    rows = [("q1", True, 0.9, 0.1), ("q1", False, 0.1, 0.2), ("q2", True, 0.8, 0.3), ("q2", False, 0.2, 0.9), ("q3", True, 0.5, 0.5)]
    scored = spark.createDataFrame(rows, "query string, relevant boolean, a double, b double")
    got = evaluate.tune(spark, scored, ["a", "b"], {"a": 0.0, "b": 1.0}, 0.25, rounds=50)
    assert got.best_accuracy == 1.0 and got.current_accuracy == 0.0 and got.win_rate == 1.0
    assert got.tied["a"] == (0.75, 1.0) and got.best == {"a": 0.75, "b": 0.25}  # at one half the second query ties
    assert [r["query"] for r in got.dropped.collect()] == ["q3"]
    with pytest.raises(ValueError):
        evaluate.tune(spark, scored.filter("query = 'q3'"), ["a", "b"], {"a": 0.0, "b": 1.0}, 0.25)


def test_trained_or_profile_prediction_and_its_stored_model(spark, tmp_path):
    from pyspark.sql import functions as F

    from corpusloom.operators import roles

    rows = [(i, "bread oven flour baker" if i % 3 else "engine piston wrench garage", "cook" if i % 3 else "mechanic") for i in range(12)]
    train = spark.createDataFrame(rows, "doc int, text string, label string")
    model = roles.train_classifier(train)
    new = spark.createDataFrame([(1, "an oven and flour"), (2, "piston, wrench"), (3, "nothing known here"), (4, None)], "doc int, text string")
    ranked = roles.predict_trained(model, new, "doc")
    shares = {r["doc"]: r["s"] for r in ranked.groupBy("doc").agg(F.sum("score").alias("s")).collect()}
    assert all(abs(s - 1) < 1e-9 for s in shares.values()) and len(shares) == 4
    prof = spark.createDataFrame([("cook", "oven", 1.0), ("pilot", "plane", 1.0)], "role string, name string, weight double")
    by_profile = roles.predict(spark.createDataFrame([(3, "plane"), (1, "plane")], "doc int, name string"), "doc", prof, "role", "name")
    got = {r["doc"]: (r["role"], r["backend"]) for r in roles.predict_either(ranked, by_profile, "doc").collect()}
    assert got[1] == ("cook", "trained") and got[2] == ("mechanic", "trained")
    path = str(tmp_path / "model")
    assert roles.load_classifier(spark, path) is None
    roles.save_classifier(spark, model, path, 0.9)
    with pytest.raises(ValueError):
        roles.save_classifier(spark, model, path, 0.5)
    roles.save_classifier(spark, model, path, 0.5, force=True)
    again = roles.predict_trained(roles.load_classifier(spark, path), new, "doc")
    key = lambda df: sorted((r["doc"], r["role"], round(r["score"], 9)) for r in df.collect())
    assert key(again) == key(ranked)


def test_matches_are_stored_with_their_payload(spark):
    from corpusloom.operators import store

    m = spark.createDataFrame([(1, "Baker", 77, None)], "resume int, title string, score int, note string")
    row = store.matches_to_store(m, "resume", "title", "score").first()
    assert len(row["id"]) == 32 and row["score"] == 77 and row["payload"] == '{"resume":1,"title":"Baker","score":77,"note":null}'
    bad = spark.createDataFrame([(1, "no json")], "id int, payload string")
    assert store.read_payload(bad, "a int").first()["a"] is None
