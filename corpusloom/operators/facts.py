"""Facts by pattern: contacts, marks, degrees, date ranges, merged experience, required years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# fixed values: contact, mark and date patterns
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?<!\d)(?:(?:\+?91[\s\-]?)|0)?[6-9]\d{4}[ \-]?\d{5}(?!\d)|(?<!\d)\+\d{1,3}[\s\-]?\d{6,12}(?!\d)"
LINKEDIN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/[A-Za-z0-9\-_%]+"
GITHUB = r"(?i)(?:https?://)?(?:www\.)?github\.com/[A-Za-z0-9\-_]+"
PORTFOLIO = r"https?://[A-Za-z0-9.\-]+\.[A-Za-z]{2,}(?:/[^\s,;]*)?"
CGPA = r"(?i)(?:cgpa|gpa|c\.g\.p\.a)[\s:]*([0-9]{1,2}(?:\.[0-9]{1,2})?)|([0-9]{1,2}(?:\.[0-9]{1,2})?)\s*/\s*10\s*(?:cgpa|gpa)?"
PERCENT = r"\b([0-9]{1,2}(?:\.[0-9]{1,2})?)\s*%"
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec|january|february|march|april|june|july|august|september|october|november|december"
DATE_SIDE = rf"(?:(?:{MONTHS})[\s.,/-]*|(?<!\d)(?:0?[1-9]|1[0-2])[/-])?(?:19|20)\d{{2}}"
DATE_RANGE = rf"(?i)({DATE_SIDE})\s*(?:-|to|until|till|through)\s*((?:present|current|now|ongoing|till date)|(?:{DATE_SIDE}))"
# fixed values: degrees, patterns and levels
DEGREES = (
    ("Ph.D", r"\b(?:ph\.?\s?d|doctorate|doctoral)\b", 5),
    ("M.Tech", r"\b(?:m\.?\s?tech|master of technology)\b", 4),
    ("M.E", r"\b(?:m\.?\s?e\.?|master of engineering)\b", 4),
    ("MBA", r"\b(?:m\.?\s?b\.?\s?a|master of business administration)\b", 4),
    ("M.Sc", r"\b(?:m\.?\s?sc|msc|master of science)\b", 4),
    ("M.C.A", r"\b(?:m\.?\s?c\.?\s?a|master of computer application)\b", 4),
    ("M.Com", r"\b(?:m\.?\s?com|master of commerce)\b", 4),
    ("B.Tech", r"\b(?:b\.?\s?tech|bachelor of technology)\b", 3),
    ("B.E", r"\b(?:b\.?\s?e\.?|bachelor of engineering)\b", 3),
    ("B.Sc", r"\b(?:b\.?\s?sc|bsc|bachelor of science)\b", 3),
    ("B.C.A", r"\b(?:b\.?\s?c\.?\s?a|bachelor of computer application)\b", 3),
    ("B.Com", r"\b(?:b\.?\s?com|bachelor of commerce)\b", 3),
    ("B.A", r"\b(?:b\.?\s?a\.?|bachelor of arts)\b", 3),
    ("Diploma", r"\bdiploma\b", 2),
    ("HSC", r"\b(?:hsc|12th|xii|higher secondary|intermediate)\b", 2),
    ("SSLC", r"\b(?:sslc|10th|x th|secondary school)\b", 1),
)
INSTITUTION = r"(?i)\b(?:university|college|institute|school|academy|polytechnic|iit|nit|iiit|vit|srm)\b"
NOT_A_NAME = r"(?i)\b(?:resume|curriculum vitae|c\.?v\.?|profile|contact|address|phone|email|mobile|objective|summary)\b"
NOT_REQUIRED = r"(?i)\b(?:in business|founded|established|incorporated|history|heritage|anniversary|track record|years ago|combined|between us|as a company|since \d{4})\b"
YEARS = (r"(\d+)\s*\+?\s*(?:-|to)\s*\d+\s*(?:years?|yrs?)", r"(\d+)\s*\+\s*(?:years?|yrs?)", r"(?:minimum|min|at least)\s*(\d+)\s*(?:years?|yrs?)", r"(\d+)\s*(?:years?|yrs?)")
JD_DEGREES = (
    (r"(?i)\b(?:ph\.?\s?d|doctoral|doctorate)\b", 5),
    (r"(?i)\b(?:master'?s?|post[- ]?graduate|postgraduate)\s+(?:degree|qualification|in\b)", 4),
    (r"(?i)\b(?:bachelor'?s?|under[- ]?graduate|undergraduate)\s+(?:degree|qualification|in\b)", 3),
    (r"(?i)\bdegree\s+in\s+\w", 3),
)


def first(text: Column, pattern: str) -> Column:
    return F.nullif(T.strip(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 0)), F.lit(""))


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def portfolio(text: Column) -> Column:
    """The first link to neither of the two profile hosts."""
    return F.try_element_at(F.filter(every(text, PORTFOLIO), lambda u: ~F.lower(u).contains("linkedin.com") & ~F.lower(u).contains("github.com")), F.lit(1))


def cgpa(text: Column) -> Column:
    a, b = every(text, CGPA, 1), every(text, CGPA, 2)
    values = F.zip_with(a, b, lambda x, y: F.when(x != "", x).otherwise(y).try_cast("double"))
    return F.try_element_at(F.filter(values, lambda v: (v > 0) & (v <= 10)), F.lit(1))


def percentage(text: Column) -> Column:
    return F.array_max(F.filter(F.transform(every(text, PERCENT, 1), lambda v: v.try_cast("double")), lambda v: (v >= 35) & (v <= 100)))


def degrees(text: Column) -> Column:
    """Degrees by falling level, then in the order of DEGREES. A bare two-letter abbreviation counts only in capitals."""
    text = F.coalesce(text, F.lit(""))

    def found(pattern: str) -> Column:
        return F.exists(every(text, "(?i)" + pattern), lambda m: ~m.rlike(r"^[A-Za-z]{2}$") | m.rlike(r"^[A-Z]{2}$"))

    hits = F.array(*(F.when(found(p), F.struct(F.lit(-level).alias("l"), F.lit(i).alias("i"), F.lit(name).alias("name"))) for i, (name, p, level) in enumerate(DEGREES)))
    return F.transform(F.array_sort(F.array_compact(hits)), lambda s: s["name"])


def degree_level(names: Column) -> Column:
    level = F.create_map(*[x for n, _, v in DEGREES for x in (F.lit(n), F.lit(v))])
    return F.coalesce(F.array_max(F.transform(names, lambda n: F.element_at(level, n))), F.lit(0))


def required_degree_level(jd: Column, guard: bool = False) -> Column:
    """Highest level that a posting names. Without guard, "be" and "me" count as degrees, as in the system this follows."""
    jd = F.coalesce(jd, F.lit(""))
    if guard:
        own = degree_level(degrees(jd))
    else:
        own = F.greatest(F.lit(0), *(F.when(jd.rlike("(?i)" + p), v).otherwise(0) for _, p, v in DEGREES))
    return F.greatest(own, *(F.when(jd.rlike(p), v).otherwise(0) for p, v in JD_DEGREES))


def institutions(text: Column) -> Column:
    hits = F.filter(T.lines(text), lambda x: x.rlike(INSTITUTION) & (F.length(x) <= 120))
    return F.slice(F.array_distinct(F.transform(hits, lambda x: F.btrim(x, F.lit(" .,;-")))), 1, 5)


def person_name(header: Column, email: Column) -> Column:
    """The first of six lines that reads as a name; else the e-mail's local part in title case."""
    head = F.slice(T.lines(header), 1, 6)

    def ok(line: Column) -> Column:
        words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
        last = F.try_element_at(words, F.lit(-1))
        single = F.try_element_at(words, F.lit(1))
        return (
            ~line.rlike(NOT_A_NAME) & ~line.rlike(EMAIL) & ~line.rlike(PHONE) & F.size(words).between(1, 5)
            & F.forall(words, lambda w: w.rlike(r"^[\p{L}\p{M}.'’-]+$"))
            & (~last.endswith(".") | last.rlike(r"^\p{L}\.$"))
            & ((F.size(words) > 1) | single.rlike(r"^\p{Lu}"))
        )

    guess = F.initcap(F.trim(F.regexp_replace(F.split_part(email, F.lit("@"), F.lit(1)), r"[._\-0-9]+", " ")))
    return F.coalesce(F.try_element_at(F.filter(head, ok), F.lit(1)), F.nullif(guess, F.lit("")))


def date_ranges(text: Column) -> Column:
    """Array of (raw, start_year, start_month, end_year, end_month, is_current); ranges that end before they start are dropped."""
    raw, a, b = every(text, DATE_RANGE, 0), every(text, DATE_RANGE, 1), every(text, DATE_RANGE, 2)
    names = "jan feb mar apr may jun jul aug sep oct nov dec".split()

    def month(x: Column) -> Column:
        word = F.substring(F.lower(F.regexp_extract(x, rf"(?i)({MONTHS})", 1)), 1, 3)
        by_name = F.nullif(F.array_position(F.array(*map(F.lit, names)), word), F.lit(0))
        return F.coalesce(by_name, F.regexp_extract(T.strip(x), r"^(0?[1-9]|1[0-2])[/-]", 1).try_cast("int")).cast("int")

    def year(x: Column) -> Column:
        return F.regexp_extract(x, r"((?:19|20)\d{2})", 1).try_cast("int")

    def one(m: Column) -> Column:
        s, e = m["a"], m["b"]
        now = e.rlike("(?i)present|current|now|ongoing|till date")
        return F.struct(
            T.strip(m["raw"]).alias("raw"), year(s).alias("start_year"), month(s).alias("start_month"),
            F.when(~now, year(e)).alias("end_year"), F.when(~now, month(e)).alias("end_month"), now.alias("is_current"),
        )

    # zipped: a lambda that refers to the arrays would search the whole text again for each match
    all_ = F.transform(F.arrays_zip(raw.alias("raw"), a.alias("a"), b.alias("b")), one)
    return F.filter(all_, lambda r: r["is_current"] | (r["end_year"] >= r["start_year"]))


def month_span(r: Column, as_of: Column) -> tuple[Column, Column]:
    """Half-open [start, end) in months; an unknown end month is December, for an open end that of as_of."""
    start = r["start_year"] * 12 + F.coalesce(r["start_month"], F.lit(1))
    end = F.coalesce(r["end_year"], F.year(as_of)) * 12 + F.coalesce(r["end_month"], F.when(r["is_current"], F.month(as_of)).otherwise(12)) + 1
    return start, end


def merge_intervals(df: DataFrame, by: str, start: str = "start", end: str = "end") -> DataFrame:
    """by, island, start, end: union of half-open intervals; those that touch are one, those that end before they start are dropped."""
    w = W.partitionBy(by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    df = df.filter(F.col(end) > F.col(start)).withColumn("_b", before)
    df = df.withColumn("island", F.sum(F.when(F.col("_b").isNull() | (F.col(start) > F.col("_b")), 1).otherwise(0)).over(w))
    return df.groupBy(by, "island").agg(F.min(start).alias(start), F.max(end).alias(end))


def experience_months(docs: DataFrame, id_col: str, ranges_col: str, as_of: Column | None = None) -> DataFrame:
    """id, experience_months: length of the merged ranges."""
    as_of = as_of if as_of is not None else F.current_date()
    flat = docs.select(id_col, F.explode(ranges_col).alias("r"))
    s, e = month_span(F.col("r"), as_of)
    merged = merge_intervals(flat.select(id_col, s.alias("start"), e.alias("end")), id_col)
    total = merged.groupBy(id_col).agg(F.sum(F.col("end") - F.col("start")).alias("experience_months"))
    return docs.select(id_col).join(total, id_col, "left").select(id_col, F.coalesce("experience_months", F.lit(0)).cast("long").alias("experience_months"))


def required_years(jd: Column) -> Column:
    """Least number of years up to 40 that a posting asks for, outside sentences about the company itself. Null if none.

    A match may run over a line break, so blanks inside matches are joined before the text is cut into sentences.
    """
    low = F.lower(F.coalesce(jd, F.lit("")))
    joined = F.regexp_replace(low, r"(\d\s*\+?|minimum|min|at least|-|to)\s*\n\s*(?=\d|\+|-|to\b|years?|yrs?)", "$1 ")
    sentences = F.filter(F.split(joined, r"[.!?\n]"), lambda s: ~s.rlike(NOT_REQUIRED))
    values = F.flatten(F.transform(sentences, lambda s: F.concat(*(F.regexp_extract_all(s, F.lit(p), F.lit(1)) for p in YEARS))))
    return F.array_min(F.filter(F.transform(values, lambda v: v.try_cast("double")), lambda v: (v > 0) & (v <= 40)))


def fit_score(have_months: Column, have_level: Column, jd: Column, default_years: float = 1.0) -> Column:
    """Mean of the experience ratio and the degree part: 1 if met, 0.6 one level below, 0.3 else."""
    expected = F.coalesce(required_years(jd), F.lit(default_years))
    years = F.bround(have_months / 12.0, 1)
    exp = F.when(expected <= 0, 1.0).otherwise(T.clamp(years / expected))
    wanted = required_degree_level(jd)
    deg = F.when((wanted == 0) | (have_level >= wanted), 1.0).when(have_level == 0, 0.3).when(wanted - have_level == 1, 0.6).otherwise(0.3)
    return T.clamp((exp + deg) / 2)


def entities(docs: DataFrame, id_col: str, text_col: str = "text", header_col: str | None = None, academic_col: str | None = None) -> DataFrame:
    """id and all facts of a text; header and academic parts default to its first eight lines and the whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    head = F.nullif(F.col(header_col), F.lit("")) if header_col else F.lit(None).cast("string")
    head = F.coalesce(head, F.array_join(F.slice(T.lines(text), 1, 8), "\n"))
    study = F.coalesce(F.nullif(F.col(academic_col), F.lit("")), text) if academic_col else text
    df = docs.select(id_col, text.alias("_t"), head.alias("_h"), study.alias("_a"))
    t, h, a = F.col("_t"), F.col("_h"), F.col("_a")
    df = df.withColumn("email", F.coalesce(first(h, EMAIL), first(t, EMAIL)))
    df = df.select(
        id_col, person_name(h, F.col("email")).alias("name"), "email", F.coalesce(first(h, PHONE), first(t, PHONE)).alias("phone"),
        first(t, LINKEDIN).alias("linkedin"), first(t, GITHUB).alias("github"), portfolio(t).alias("portfolio"),
        cgpa(a).alias("cgpa"), percentage(a).alias("percentage"), degrees(a).alias("degrees"), institutions(a).alias("institutions"), date_ranges(t).alias("date_ranges"),
    )
    link = F.coalesce("linkedin", "github", "portfolio").isNotNull()
    return df.withColumn("degree_level", degree_level(F.col("degrees"))).withColumn("has_full_contact", F.col("email").isNotNull() & F.col("phone").isNotNull() & link)
