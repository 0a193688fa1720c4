"""Corpus import: columns by alias, category by title, validation with a reject side output, reconciliation, reports; lexicon checks; links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# fixed values: employment types, seniority levels in years, limits
EMPLOYMENT = {
    "full time": "Full-time", "fulltime": "Full-time", "part time": "Part-time", "parttime": "Part-time", "contract": "Contract", "contractor": "Contract",
    "freelance": "Contract", "temporary": "Temporary", "temp": "Temporary", "internship": "Internship", "intern": "Internship", "volunteer": "Volunteer", "other": "Other",
}
LEVELS = {
    "internship": 0.0, "intern": 0.0, "entry level": 0.0, "entry": 0.0, "graduate": 0.0, "fresher": 0.0, "trainee": 0.0, "junior": 0.0, "associate": 1.0, "mid senior level": 3.0,
    "mid senior": 3.0, "mid level": 3.0, "mid": 3.0, "senior": 5.0, "lead": 7.0, "staff": 7.0, "principal": 7.0, "manager": 7.0, "director": 10.0, "executive": 10.0,
}
MIN_DESCRIPTION, MAX_YEARS = 40, 50
ALIASES = {
    "id": ("id", "job_id", "posting_id"), "title": ("title", "job_title", "position"), "company": ("company", "company_name", "employer"), "location": ("location", "job_location", "city"),
    "category": ("category", "role", "role_family"), "employment_type": ("employment_type", "formatted_work_type", "work_type"), "experience": ("experience_years", "experience", "formatted_experience_level"),
    "description": ("description", "job_description", "details"), "requirements": ("requirements", "skills_desc", "qualifications"), "url": ("url", "job_posting_url", "link"),
}


def resolve_columns(columns: list[str], override: dict[str, str] | None = None) -> dict[str, str]:
    """field -> column. An override wins and must name a column; aliases are tried in order on folded names; title and description must be found."""
    folded = {}
    for c in columns:
        folded.setdefault(T.fold_header(c), c)
    out = {}
    for field, names in ALIASES.items():
        if override and field in override:
            if override[field] not in columns:
                raise ValueError(f"no column {override[field]!r} for {field}")
            out[field] = override[field]
        else:
            hit = next((folded[n] for n in names if n in folded), None)
            if hit:
                out[field] = hit
    missing = [f for f in ("title", "description") if f not in out]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    return out


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def padded(c: Column) -> Column:
    """Lower case with punctuation as spaces and a space at both ends, so that containment lands on words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9+#.]+", " ")), F.lit(" "))


def experience(c: Column) -> Column:
    """Struct (years, source): the first number (up to 50), else the longest level phrase; blank is 0 and missing; anything else is null and unparseable."""
    low = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9. ]+", " "), r"\s+", " "))
    number = F.regexp_extract(low, r"\d+(?:\.\d+)?", 0).try_cast("double")
    level = F.lit(None).cast("double")
    for phrase in sorted(LEVELS, key=lambda p: (len(p), p)):  # the last test wins, so longer phrases come last
        level = F.when(low.contains(phrase), F.lit(LEVELS[phrase])).otherwise(level)
    blank = F.trim(F.coalesce(c, F.lit(""))) == ""
    years = F.when(blank, 0.0).when(number.isNotNull(), F.when(number <= MAX_YEARS, number)).otherwise(level)
    source = F.when(blank, "missing").when(years.isNull(), "unparseable").when(number.isNotNull(), "number").otherwise("level")
    return F.struct(years.alias("years"), source.alias("source"))


def requirements(c: Column) -> Column:
    """Lines of a cell, without leading marks, of three characters or more."""
    parts = F.split(F.coalesce(c, F.lit("")), r"[\n\r;|•·]+")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^[\s\-*•·–—.\d)]+", ""))), lambda p: F.length(p) > 2)


def employment(c: Column) -> Column:
    """One label for the spellings of an employment type; others stay, collapsed."""
    key = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z]+", " "))
    table = F.create_map(*[x for k, v in EMPLOYMENT.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, key), collapse(c))


def title_family(rows: DataFrame, row_id: str, title: str, families: DataFrame) -> DataFrame:
    """row_id, family, n_best: the longest family phrase (columns phrase, family) within the title, on word boundaries; none: `unknown`, two of one length: `ambiguous`.

    Titles are cut into word n-grams up to the longest phrase and equi-join the phrases: no row meets every phrase.
    """
    ph = families.select(F.trim(padded(F.col("phrase"))).alias("_p"), "family").filter("_p <> ''").distinct()
    words = F.split(F.trim(padded(F.col(title))), " ")
    most = ph.agg(F.max(F.size(F.split("_p", " ")))).first()[0] or 1  # words of the longest phrase
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda w: F.transform(F.filter(F.sequence(F.lit(1), F.size("_w")), lambda i: i + w - 1 <= F.size("_w")), lambda i: F.array_join(F.slice("_w", i, w), " "))))
    got = rows.select(row_id, words.alias("_w")).select(row_id, F.explode(F.array_distinct(grams)).alias("_p")).join(ph, "_p")
    best = got.withColumn("_k", F.dense_rank().over(W.partitionBy(row_id).orderBy(F.length("_p").desc()))).filter("_k = 1")
    best = best.groupBy(row_id).agg(F.count_distinct("family").alias("n_best"), F.min("family").alias("_f"))
    return rows.select(row_id).join(best, row_id, "left").select(row_id, F.when(F.col("n_best").isNull(), "unknown").when(F.col("n_best") > 1, "ambiguous").otherwise(F.col("_f")).alias("family"), F.coalesce("n_best", F.lit(0)).alias("n_best"))


#: Lines of a file that are numbered in one task.
RANGE = 100_000


def convert(raw: DataFrame, families: DataFrame, override: dict[str, str] | None = None, line_col: str = "csv_line", file_col: str = "csv_file") -> DataFrame:
    """raw (all strings, with line_col and, if it comes from several files, file_col) with the posting's fields and reject_reason (null if accepted).

    The first failing test names the reason: blank title, short description, category, experience, repeated id. Ids are made for rows without one after the highest
    in use, in the order of files and lines, which count across files: rows are numbered within ranges of lines, and the ranges' counts are summed up, so
    no task sees all of them.
    """
    place = [c for c in (file_col, line_col) if c in raw.columns]
    at = resolve_columns([c for c in raw.columns if c not in place], override)
    get = lambda f: F.col(at[f]) if f in at else F.lit(None).cast("string")
    df = raw.select(
        F.struct(*place).alias("_line"), F.struct(*place[:-1], F.floor(F.col(line_col) / RANGE).alias("_r")).alias("_range"), F.struct(*[F.col(c) for c in raw.columns if c not in place]).alias("_raw"), collapse(get("id")).alias("_id"), collapse(get("title")).alias("title"), collapse(get("company")).alias("company"),
        collapse(get("location")).alias("location"), collapse(get("category")).alias("_cat"), employment(get("employment_type")).alias("employment_type"), experience(get("experience")).alias("_x"),
        T.strip(F.coalesce(get("description"), F.lit(""))).alias("description"), requirements(get("requirements")).alias("requirements"), F.nullif(collapse(get("url")), F.lit("")).alias("url"),
    )
    fam = title_family(df, "_line", "title", families).select("_line", "family")
    known = families.select("family", F.lower("family").alias("_lc")).distinct().groupBy("_lc").agg(F.min("family").alias("_same"))
    df = df.join(fam, "_line").join(known, F.lower("_cat") == F.col("_lc"), "left")
    df = df.withColumn("category", F.when(F.col("_cat") != "", F.coalesce("_same", "_cat")).otherwise(F.col("family")))
    reason = (
        F.when(F.col("title") == "", "blank title").when(F.length("description") < MIN_DESCRIPTION, "description too short")
        .when(F.col("category") == "unknown", "unknown category").when(F.col("category") == "ambiguous", "ambiguous category").when(F.col("_x.years").isNull(), "unparseable experience")
    )
    df = df.withColumn("_r", reason)
    w = W.partitionBy("_id", F.col("_r").isNull()).orderBy("_line")
    df = df.withColumn("_r", F.coalesce("_r", F.when((F.col("_id") != "") & (F.row_number().over(w) > 1), "duplicate id")))
    top = df.filter("_r is null").agg(F.coalesce(F.max(F.regexp_extract("_id", r"^job-(\d+)$", 1).try_cast("long")), F.lit(0)).alias("_top"))
    need = df.filter("_r is null and _id = ''").select("_line", "_range")
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = need.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", before).drop("_n")  # a row for RANGE lines
    need = need.withColumn("_i", F.row_number().over(W.partitionBy("_range").orderBy("_line"))).join(ranges, "_range")
    df = df.join(need.select("_line", (F.col("_before") + F.col("_i")).alias("_k")), "_line", "left").crossJoin(F.broadcast(top))  # one row
    df = df.withColumn("id", F.when(F.col("_id") != "", F.col("_id")).when(F.col("_k").isNotNull(), F.format_string("job-%05d", (F.col("_top") + F.col("_k")).cast("long"))))
    return df.select(*(F.col(f"_line.{c}").alias(c) for c in place), "id", "title", "company", "location", "category", "employment_type", F.col("_x.years").alias("experience_years"), F.col("_x.source").alias("experience_source"), "description", "requirements", "url", F.col("_r").alias("reject_reason"), F.col("_raw").alias("raw"))


def accepted(converted: DataFrame) -> DataFrame:
    return converted.filter("reject_reason is null").drop("reject_reason", "raw")


def rejected(converted: DataFrame, line_col: str = "csv_line") -> DataFrame:
    """File (if there are several), line, reason and the original columns."""
    place = [c for c in ("csv_file", line_col) if c in converted.columns]
    return converted.filter("reject_reason is not null").select(*place, "reject_reason", "raw.*")


def reject_summary(converted: DataFrame, line_col: str = "csv_line", examples: int = 3) -> DataFrame:
    """reject_reason, n, examples: the first lines of each reason."""
    r = converted.filter("reject_reason is not null").withColumn("_i", F.row_number().over(W.partitionBy("reject_reason").orderBy(line_col)))
    return r.groupBy("reject_reason").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_i") <= examples, F.col(line_col)))).alias("examples"))


def append(existing: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """Union in which existing ids win."""
    both = existing.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_i", F.row_number().over(W.partitionBy(id_col).orderBy("_s"))).filter("_i = 1").drop("_s", "_i")


def family_report(new: DataFrame, old: DataFrame, key: str = "category") -> DataFrame:
    """category, n_new, n_old, state: thin (under 2), new, lost or kept."""
    a = new.groupBy(key).agg(F.count("*").alias("n_new"))
    b = old.groupBy(key).agg(F.count("*").alias("n_old"))
    both = a.join(b, key, "full").fillna(0, ["n_new", "n_old"])
    return both.withColumn("state", F.when(F.col("n_new") == 0, "lost").when(F.col("n_old") == 0, "new").when(F.col("n_new") < 2, "thin").otherwise("kept"))


def reconcile(written: DataFrame, read: DataFrame, id_col: str) -> DataFrame:
    """id, problem: rows missing on either side, and columns whose values differ (nulls equal)."""
    cols = [c for c in written.columns if c != id_col]
    a = written.select(F.col(id_col).alias("_a"), *(F.col(c).alias(f"_a_{c}") for c in cols))
    b = read.select(F.col(id_col).alias("_b"), *(F.col(c).alias(f"_b_{c}") for c in cols))
    j = a.join(b, F.col("_a") == F.col("_b"), "full")
    diff = F.array_compact(F.array(*(F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in cols)))
    problem = F.when(F.col("_b").isNull(), "not read back").when(F.col("_a").isNull(), "not written").when(F.size(diff) > 0, F.concat(F.lit("differs: "), F.array_join(diff, ", ")))
    return j.select(F.coalesce("_a", "_b").alias(id_col), problem.alias("problem")).filter("problem is not null")


def class_profile(rows: DataFrame, key: str) -> DataFrame:
    """One row: classes, least, most, median (the upper middle), singles."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    sizes = n.groupBy("n").agg(F.count("*").alias("c"))  # a row for each different size, not for each class
    run = F.sum("c").over(W.orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    sizes = sizes.withColumn("_to", run).withColumn("_all", F.sum("c").over(W.partitionBy()))
    middle = F.min(F.when(F.col("_to") > F.floor(F.col("_all") / 2), F.col("n")))
    return sizes.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("classes"), F.min("n").alias("least"), F.max("n").alias("most"), middle.alias("median"), F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("c"))), F.lit(0)).alias("singles"))


def facets(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).filter(F.col(column).isNotNull() & (F.col(column) != "")).distinct().orderBy(column)


def ontology_violations(entries: DataFrame, categories: list[str], words: DataFrame, guarded: list[str]) -> DataFrame:
    """kind, item, severity for a phrase dictionary (name, category, aliases): repeated name, unknown category, empty or over-wide key, one key of two names, an
    ordinary word (relation of one column `word`) without a guard; no aliases is a warning."""
    flat = entries.select("name", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("phrase")).withColumn("key", T.phrase_key("phrase"))
    rows = [
        entries.groupBy("name").count().filter("count > 1").select(F.lit("repeated name").alias("kind"), F.col("name").alias("item")),
        entries.filter(~F.col("category").isin(*categories)).select(F.lit("unknown category"), "name"),
        flat.filter("key = ''").select(F.lit("empty key"), "phrase"),
        flat.filter(F.size(F.split("key", " ")) > 5).select(F.lit("wide key"), "phrase"),
        flat.filter("key <> ''").groupBy("key").agg(F.count_distinct("name").alias("n")).filter("n > 1").select(F.lit("shared key"), "key"),
        flat.join(words.select(F.col("word").alias("key")), "key", "left_semi").filter(~F.col("key").isin(*guarded)).select(F.lit("unguarded word"), "key").distinct(),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    warn = entries.filter(F.size(F.coalesce("aliases", F.array().cast("array<string>"))) == 0).select(F.lit("no aliases").alias("kind"), F.col("name").alias("item"), F.lit("warning").alias("severity"))
    return out.withColumn("severity", F.lit("error")).unionByName(warn)


def verb_violations(verbs: DataFrame) -> DataFrame:
    """kind, item for a verb list: repeated, not lower case, a gerund."""
    a = verbs.groupBy(F.lower("verb").alias("item")).count().filter("count > 1").select(F.lit("repeated verb").alias("kind"), "item")
    return a.union(verbs.filter(F.col("verb") != F.lower("verb")).select(F.lit("not lower case"), "verb")).union(verbs.filter(F.col("verb").rlike("ing$")).select(F.lit("gerund"), "verb"))


def heading_violations(headings: DataFrame) -> DataFrame:
    """kind, item: variants that two canonical names own."""
    return headings.select("canonical", T.normalise("variant").alias("item")).groupBy("item").agg(F.count_distinct("canonical").alias("n")).filter("n > 1").select(F.lit("heading owned twice").alias("kind"), "item")


def wiki_links(pages: DataFrame, page: str = "page", text: str = "text") -> DataFrame:
    """page, target, anchor of every [[target#anchor|label]] outside code."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?s)```.*?```", " "), r"`[^`\n]*`", " ")
    links = pages.select(page, F.explode(F.regexp_extract_all(plain, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))).alias("_l"))
    body = F.split_part("_l", F.lit("|"), F.lit(1))
    return links.select(page, T.strip(F.split_part(body, F.lit("#"), F.lit(1))).alias("target"), F.nullif(T.strip(F.split_part(body, F.lit("#"), F.lit(2))), F.lit("")).alias("anchor"))


def broken_links(pages: DataFrame, page: str = "page", text: str = "text") -> DataFrame:
    """page, target, anchor, problem: links to no page, to no heading of theirs, or broken over lines."""
    links = wiki_links(pages, page, text)
    wrapped = links.filter(F.col("target").contains("\n")).withColumn("problem", F.lit("wrapped"))
    links = links.filter(~F.col("target").contains("\n"))
    names = pages.select(F.col(page).alias("_p"))
    heads = pages.select(F.col(page).alias("_p"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?m)^#+\s+(.+?)\s*$"), F.lit(1))).alias("_h"))
    dest = F.when(F.col("target") == "", F.col(page)).otherwise(F.col("target"))
    links = links.withColumn("_d", dest)
    lost = links.join(names, F.col("_d") == F.col("_p"), "left_anti").withColumn("problem", F.lit("no such page"))
    live = links.filter("anchor is not null").join(names, F.col("_d") == F.col("_p"), "left_semi")
    head = live.join(heads, (F.col("_d") == F.col("_p")) & (F.lower("anchor") == F.lower("_h")), "left_anti").withColumn("problem", F.lit("no such heading"))
    return lost.unionByName(head).drop("_d").unionByName(wrapped)


def experience_sources(converted: DataFrame) -> DataFrame:
    """source, n: where the years of the accepted postings come from (number, level, missing)."""
    return accepted(converted).groupBy(F.col("experience_source").alias("source")).agg(F.count("*").alias("n"))
