"""Lines with offsets, heading segmentation, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T

from .store import cut, lexicon

MAX_WORDS = 6


def line_spans(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, line_no (from 0, blank lines not counted), line (stripped), start, end: offsets in code points of the text."""
    raw = docs.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("_p", "_raw"))
    by_pos = W.partitionBy(id_col).orderBy("_p")
    raw = raw.withColumn("_at", F.coalesce(F.sum(F.length("_raw") + 1).over(by_pos.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    raw = raw.withColumn("line", T.strip("_raw")).filter("line <> ''")
    lead = F.length("_raw") - F.length(F.regexp_replace("_raw", r"^[\s\x1c-\x1f]+", ""))
    raw = raw.withColumn("start", (F.col("_at") + lead).cast("long"))
    return raw.select(id_col, (F.row_number().over(by_pos) - 1).alias("line_no"), "line", "start", (F.col("start") + F.length("line")).alias("end"))


def looks_like_heading(line: Column) -> Column:
    """Short, without sentence marks, contacts or label and value, few digits, and all capitals or title case of two words or more."""
    s = T.strip(F.rtrim(T.strip(line), F.lit(":")))
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    letters = F.regexp_replace(s, r"\P{L}", "")
    digits = F.length(F.regexp_replace(s, r"\P{Nd}", ""))
    connectors = F.array(*map(F.lit, ("of", "and", "the", "in", "for", "to", "on")))
    title = F.forall(words, lambda w: w.rlike(r"^[\p{Lu}\p{Lt}]") | F.array_contains(connectors, F.lower(w)))
    return (
        (s != "") & (F.length(s) <= 60) & ~s.rlike(r"[.!?;](\s|$)") & ~s.rlike(r"@|https?://|\+\d|\d{6,}") & ~s.rlike(r":\s*\S")
        & F.size(words).between(1, MAX_WORDS) & (letters != "") & (digits / F.greatest(F.length(s), F.lit(1)) <= 0.25)
        & (letters.rlike(r"^\p{Lu}+$") | ((F.size(words) >= 2) & title))
    )


def lexicon_keys(headings: DataFrame) -> DataFrame:
    """key, canonical from (canonical, variant) rows; a canonical name is a key of its own."""
    own = headings.select(T.normalise("canonical").alias("key"), "canonical")
    return headings.select(T.normalise("variant").alias("key"), "canonical").unionByName(own).filter("key <> ''").distinct()


def mark_headings(lines: DataFrame, id_col: str, headings: DataFrame) -> DataFrame:
    """lines with name (canonical, OTHER:<text>, or null).

    A line of the lexicon is a heading. Any other heading-shaped line is one if a lexicon heading stands before it and neither the line before
    nor the one after it is heading-shaped (nor is it the last); this closed form equals the line-by-line state machine.
    """
    keys = lexicon(lexicon_keys(headings))
    marked = lines.withColumn("_key", T.normalise(F.rtrim(F.col("line"), F.lit(":")))).join(keys, F.col("_key") == F.col("key"), "left")
    w = W.partitionBy(id_col).orderBy("line_no")
    known = F.col("canonical").isNotNull()
    shaped = known | (looks_like_heading(F.col("line")) & (F.col("_key") != ""))
    marked = marked.withColumn("_known", known).withColumn("_shape", shaped)
    seen = F.coalesce(F.max(F.col("_known").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 1
    before = F.coalesce(F.lag("_shape").over(w), F.lit(False))
    after = F.coalesce(F.lead("_shape").over(w), F.lit(True))
    other = F.concat(F.lit("OTHER:"), T.strip(F.rtrim(T.strip("line"), F.lit(":"))))
    name = F.when(F.col("_known"), F.col("canonical")).when(F.col("_shape") & seen & ~before & ~after, other)
    return marked.withColumn("name", name).drop("_key", "key", "canonical", "_known", "_shape")


def sections(docs: DataFrame, id_col: str, headings: DataFrame, text_col: str = "text") -> DataFrame:
    """id, ord, name, heading, body, start_line, end_line, start, end. ord 0 (name null) is the preamble, if there is one.

    A text without headings is one section BODY of the whole text, its preamble too.
    """
    lines = mark_headings(line_spans(docs, id_col, text_col), id_col, headings)
    w = W.partitionBy(id_col).orderBy("line_no")
    lines = lines.withColumn("ord", F.sum(F.col("name").isNotNull().cast("int")).over(w))
    body = F.array_sort(F.collect_list(F.when(F.col("name").isNull(), F.struct("line_no", "line"))))
    inside = F.col("name").isNull()
    got = lines.groupBy(id_col, "ord").agg(
        F.max("name").alias("name"), F.max(F.when(~inside, F.col("line"))).alias("heading"),
        T.strip(F.array_join(F.transform(body, lambda x: x["line"]), "\n")).alias("body"),
        F.min("line_no").alias("start_line"), (F.max("line_no") + 1).alias("end_line"),
        F.coalesce(F.min(F.when(inside, F.col("start"))), F.max("end")).alias("start"), F.max("end").alias("end"),
    )
    got = cut(got)
    some = got.filter("ord > 0").select(id_col).distinct()
    none = docs.join(some, id_col, "left_anti").select(
        id_col, F.lit(1).cast("long").alias("ord"), F.lit("BODY").alias("name"), F.lit("").alias("heading"), F.coalesce(F.col(text_col), F.lit("")).alias("body"),
        F.lit(0).alias("start_line"), F.size(T.lines(text_col)).alias("end_line"), F.lit(0).cast("long").alias("start"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("end"),
    )
    return got.join(some, id_col, "left_semi").unionByName(none)


def display_name(name: Column) -> Column:
    return F.regexp_replace(name, "^OTHER:", "")


def highlight(docs: DataFrame, id_col: str, spans: DataFrame, text_col: str = "text") -> DataFrame:
    """id, at, piece, label: the text cut at the spans (id, start, end, label), plain pieces with a null label. Spans that are empty, overlap an earlier
    one or leave the text are skipped."""
    size = F.length(text_col)
    ok = spans.select(id_col, F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "label").join(docs.select(id_col, text_col), id_col)
    ok = ok.filter((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= size))
    kept = F.aggregate(  # one text's spans in order; each has the end of the one kept before it
        F.array_sort(F.collect_list(F.struct("start", "end", "label"))),
        F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<start:int,end:int,label:string,before:int>>").alias("out")),
        lambda s, c: F.when(
            c["start"] >= s["free"],
            F.struct(c["end"].alias("free"), F.concat(s["out"], F.array(F.struct(c["start"].alias("start"), c["end"].alias("end"), c["label"].alias("label"), s["free"].alias("before")))).alias("out")),
        ).otherwise(s),
        lambda s: s["out"],
    )
    ok = ok.groupBy(id_col, text_col).agg(kept.alias("k")).select(id_col, text_col, F.inline("k")).withColumnRenamed("before", "_before")
    cut = lambda a, z: F.substring(F.col(text_col), a + 1, z - a)
    inside = ok.select(id_col, F.col("start").alias("at"), cut(F.col("start"), F.col("end")).alias("piece"), "label")
    gaps = ok.select(id_col, F.col("_before").alias("at"), cut(F.col("_before"), F.col("start")).alias("piece"), F.lit(None).cast("string").alias("label"))
    last = ok.groupBy(id_col).agg(F.max("end").alias("at")).join(docs.select(id_col, text_col), id_col, "right").withColumn("at", F.coalesce("at", F.lit(0)))
    tail = last.select(id_col, "at", cut(F.col("at"), size).alias("piece"), F.lit(None).cast("string").alias("label"))
    return inside.unionByName(gaps).unionByName(tail).filter("piece <> ''")
