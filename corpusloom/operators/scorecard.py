"""Ten-rule readiness scorecard: a registry of Column builders over one row a document."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T

VERB_TARGET, QUANTIFIED_TARGET, KEYWORD_TARGET = 0.70, 0.50, 8
LEAST_WORDS, MOST_WORDS = 10, 25
# fixed values: weak phrases, pronouns, quantities and date forms
CLICHES = (
    "hardworking", "hard working", "team player", "responsible for", "duties included", "go-getter", "think outside the box", "self motivated", "self-motivated",
    "detail oriented", "detail-oriented", "results driven", "results-driven", "dynamic professional", "passionate about", "good communication skills", "quick learner",
)
FIRST_PERSON = r"(?i)\b(?:i(?![./])|me|my|mine|myself)\b"
QUANTIFIED = (
    r"(?i)\d+\s*%|\b(?:rs\.?|inr|usd|eur|\$|₹|€)\s*[\d,]+|\b\d+\s*(?:x|times|users?|records?|rows?|requests?|queries|hours?|days?|weeks?|months?|ms|seconds?|students?"
    r"|teams?|members?|endpoints?|tests?)\b|\b(?!(?:19|20)\d{2}\b)[\d,]{2,}\b"
)
MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t)?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
MONTH_YEAR = rf"(?i)\b{MONTH}\.?\s+(?:19|20)\d{{2}}\b"
NUMERIC = r"(?<![\d./-])(?:0?[1-9]|1[0-2])[/-](?:19|20)\d{2}\b"
YEAR_ONLY = r"(?<![/\d-])(?:19|20)\d{2}(?![/\d-])"


def date_forms(text: Column) -> Column:
    """Struct of counts month_year, numeric, year_only; a character counts once, earlier forms first: each form's matches are blanked before the next."""
    text = F.coalesce(text, F.lit(""))
    rest = F.regexp_replace(text, MONTH_YEAR, "¤")
    last = F.regexp_replace(rest, NUMERIC, "¤")
    return F.struct(F.regexp_count(text, F.lit(MONTH_YEAR)).alias("month_year"), F.regexp_count(rest, F.lit(NUMERIC)).alias("numeric"), F.regexp_count(last, F.lit(YEAR_ONLY)).alias("year_only"))


def cliches(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*(F.when(low.contains(p), F.lit(p)) for p in CLICHES)))


def pronouns(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(FIRST_PERSON))


def ratio(items: Column, test: Callable[[Column], Column]) -> Column:
    """Share of the items that pass; 0 without items."""
    return F.coalesce(F.try_divide(F.size(F.filter(items, test)), F.size(items)), F.lit(0.0))


@dataclass(frozen=True)
class Rule:
    id: str
    points: int
    earned: Column
    detail: Column
    fix: Column


def _c(name: str) -> Column:
    return F.col(name)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, each computed once a row: a generator stands between them and what uses them, so the optimizer doesn't copy them into every use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def _measured(docs: DataFrame, verbs: Column) -> DataFrame:
    """docs with what the rules count in a text and its bullets."""
    text = _c("text")
    docs = _once(docs, _b=T.bullets("text"), _d=date_forms(text), _n_cliches=F.size(cliches(text)), _n_pron=pronouns(text))
    count = lambda test: F.size(F.filter("_b", test))
    return _once(
        docs, _n=F.size("_b"), _n_verb=count(lambda b: F.array_contains(verbs, T.first_word(b))), _n_quant=count(lambda b: b.rlike(QUANTIFIED)),
        _n_length=count(lambda b: T.word_count(b).between(LEAST_WORDS, MOST_WORDS)), _month_year=_c("_d.month_year"), _numeric=_c("_d.numeric"), _year_only=_c("_d.year_only"),
    ).drop("_b", "_d")


def _rules() -> list[Rule]:
    """Inputs: email, phone, link, sections (names with a body), n_pages, columns_per_page (null: no layout), has_tables, has_text_layer, n_chars, skills, role_keywords, and what _measured() counts."""
    none = F.lit("")
    contact = _c("email").isNotNull().cast("int") + _c("phone").isNotNull().cast("int") + _c("link").isNotNull().cast("int")
    has = lambda *names: F.arrays_overlap(_c("sections"), F.array(*map(F.lit, names)))
    found = has("EDUCATION").cast("int") + has("SKILLS").cast("int") + has("EXPERIENCE", "PROJECTS").cast("int")
    multi = F.size(F.filter(_c("columns_per_page"), lambda n: n > 1))
    layout = F.when(_c("columns_per_page").isNull(), F.when(_c("has_tables"), 5.0).otherwise(15.0)).otherwise(15.0 * (1 - multi / F.greatest(F.size("columns_per_page"), F.lit(1))))
    readable = F.when(~_c("has_text_layer"), 0.0).when(_c("n_chars") < 600, 2.5).otherwise(5.0)
    verb, quant, lengths = (F.coalesce(F.try_divide(_c(c), _c("_n")), F.lit(0.0)) for c in ("_n_verb", "_n_quant", "_n_length"))
    overlap = F.size(F.array_intersect(_c("skills"), _c("role_keywords")))
    kw = F.when((F.size("role_keywords") == 0) & (F.size("skills") == 0), 0.0).when(F.size("role_keywords") == 0, 15.0).otherwise(15 * T.clamp(overlap / KEYWORD_TARGET))
    pages = F.when(_c("n_pages") <= 2, 5.0).when(_c("n_pages") == 3, 2.5).otherwise(0.0)
    n_cliches, n_pron = _c("_n_cliches"), _c("_n_pron")
    penalty = n_cliches + F.least(n_pron, F.lit(3))
    d = {k: _c(f"_{k}") for k in ("month_year", "numeric", "year_only")}
    total = d["month_year"] + d["numeric"] + d["year_only"]
    kinds = (d["month_year"] > 0).cast("int") + (d["numeric"] > 0).cast("int") + (d["year_only"] > 0).cast("int")
    dominant = F.coalesce(F.try_divide(F.greatest(d["month_year"], d["numeric"], d["year_only"]), total), F.lit(0.0))
    dates = F.when(kinds == 0, 2.5).when(kinds == 1, 5.0).otherwise(5.0 * T.clamp((dominant - 0.5) / 0.5))
    n = _c("_n")
    return [
        Rule("contact", 10, 10 * contact / 3, F.format_string("%d of 3 contact details", contact), F.when(contact < 3, "Add the missing contact details at the top.").otherwise(none)),
        Rule("sections", 10, 10 * found / 3, F.format_string("%d of 3 expected sections", found), F.when(found < 3, "Add a titled section for what is missing.").otherwise(none)),
        Rule("layout", 15, layout, F.when(_c("columns_per_page").isNull(), F.when(_c("has_tables"), "tables").otherwise("no tables")).otherwise(F.format_string("%d pages with columns side by side", multi)), F.when(layout < 13, "Use one column of plain paragraphs.").otherwise(none)),
        Rule("readable", 5, readable, F.format_string("%d characters", _c("n_chars").cast("long")), F.when(readable < 5, "Export the file as text, not as an image.").otherwise(none)),
        Rule("action_verbs", 10, 10 * T.clamp(verb / VERB_TARGET), F.format_string("%d bullets", n), F.when(10 * T.clamp(verb / VERB_TARGET) < 8.5, "Begin bullets with a verb.").otherwise(none)),
        Rule("quantified", 15, 15 * T.clamp(quant / QUANTIFIED_TARGET), F.format_string("%d bullets", n), F.when(15 * T.clamp(quant / QUANTIFIED_TARGET) < 12.75, "Add figures.").otherwise(none)),
        Rule("keywords", 15, kw, F.format_string("%d skills, %d of the role", F.size("skills"), overlap), F.when(kw < 12.75, F.concat(F.lit("Name those you have: "), F.array_join(F.slice(F.array_sort(F.array_except("role_keywords", "skills")), 1, 5), ", "))).otherwise(none)),
        Rule("length", 10, pages + F.when(n > 0, 5.0 * T.clamp(lengths / 0.6)).otherwise(0.0), F.format_string("%d pages", _c("n_pages").cast("int")), F.when(pages + 5.0 * T.clamp(lengths / 0.6) < 9.25, "Keep to two pages and bullets of 10 to 25 words.").otherwise(none)),
        Rule("tone", 5, F.greatest(F.lit(0.0), 5.0 - penalty), F.format_string("%d set phrases, %d pronouns", n_cliches, n_pron), F.when(penalty > 0, "Drop set phrases and first-person pronouns.").otherwise(none)),
        Rule("dates", 5, dates, F.format_string("%d date forms", kinds), F.when(dates < 5, "Use one date form throughout.").otherwise(none)),
    ]


def _prepared(docs: DataFrame) -> DataFrame:
    """Fills in inputs that a plain text lacks."""
    have = set(docs.columns)
    empty = F.array().cast("array<string>")
    given = {
        "email": F.lit(None).cast("string"), "phone": F.lit(None).cast("string"), "link": F.lit(None).cast("string"), "sections": empty, "skills": empty, "role_keywords": empty,
        "n_pages": F.greatest(F.lit(1), F.floor(F.length("text") / 3000)), "columns_per_page": F.lit(None).cast("array<int>"), "has_tables": F.lit(False), "has_text_layer": F.lit(True), "n_chars": F.length("text"),
    }
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    for k, v in given.items():
        docs = docs.withColumn(k, F.coalesce(F.col(k), v) if k in have and k != "columns_per_page" else F.col(k) if k in have else v)
    return docs


def rules(docs: DataFrame, id_col: str, verbs: list[str]) -> DataFrame:
    """id, ord, rule, points, earned (2 decimals), status, detail, fix: ten rows a document. Without a text layer or text every rule earns 0."""
    verb_list = F.array(*map(F.lit, verbs)) if verbs else F.array().cast("array<string>")
    docs = _measured(_prepared(docs), verb_list)
    dead = ~F.col("has_text_layer") | ~F.col("text").rlike(r"\S")
    rows = []
    for i, r in enumerate(_rules()):
        earned = F.when(dead, 0.0).otherwise(F.bround(r.earned, 2))
        rows.append(F.struct(F.lit(i).alias("ord"), F.lit(r.id).alias("rule"), F.lit(r.points).alias("points"), earned.cast("double").alias("earned"), T.grade(earned, F.lit(r.points)).alias("status"), F.when(dead, F.lit("no readable text")).otherwise(r.detail).alias("detail"), r.fix.alias("fix")))
    return docs.select(id_col, F.inline(F.array(*rows)))


def report(rule_rows: DataFrame, id_col: str) -> DataFrame:
    """id, score, band, n_pass, n_fail, top_fixes (three, by points lost, then rule order)."""
    lost = F.struct((F.col("earned") - F.col("points")).alias("l"), "ord", "fix")
    fixes = F.array_sort(F.collect_list(F.when((F.col("fix") != "") & (F.col("earned") < F.col("points")), lost)))
    got = rule_rows.groupBy(id_col).agg(F.bround(F.round(F.sum("earned"), 2), 0).cast("int").alias("score"), F.count_if(F.col("status") == "pass").alias("n_pass"), F.count_if(F.col("status") == "fail").alias("n_fail"), F.slice(F.transform(fixes, lambda x: x["fix"]), 1, 3).alias("top_fixes"))
    return got.withColumn("band", T.band(F.col("score")))


def by_points_lost(rule_rows: DataFrame, id_col: str) -> DataFrame:
    """Rule rows with their place by points lost."""
    return rule_rows.withColumn("place", F.row_number().over(W.partitionBy(id_col).orderBy((F.col("points") - F.col("earned")).desc(), "ord")))
