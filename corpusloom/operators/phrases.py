"""Dictionary phrase matching: n-gram equi-join, ambiguity test, leftmost-longest resolution, fuzzy tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.python_udfs import indel_ratio

from .store import cut, lexicon

MAX_TOKENS = 5
FUZZY_THRESHOLD, FUZZY_MIN = 88.0, 5
# fixed values: names that are English words too, conjunctions, and the characters that delimit lists and end sentences
AMBIGUOUS = ("go", "swift", "rust", "dart", "scala", "apache", "spark", "excel", "cv", "react", "ruby")
CONJUNCTIONS = ("and", "or", "&", "+", "with")
DELIMITER = r"[,;:|/()\[\]{}•*\n\t]"
SENTENCE_END = r"[.!?\n\r]"


def ontology(entries: DataFrame) -> DataFrame:
    """key, n_tokens, name, category from (name, category, aliases array); a key of two names raises an error."""
    flat = entries.select("name", "category", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("phrase"))
    keys = flat.withColumn("key", T.phrase_key("phrase")).filter("key <> ''").groupBy("key").agg(F.count_distinct("name").alias("_n"), F.min("name").alias("name"), F.min("category").alias("category"))
    safe = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("two names share the key "), F.col("key"))).cast("string")).otherwise(F.col("name"))
    return keys.select("key", F.size(F.split("key", " ")).alias("n_tokens"), safe.alias("name"), "category").filter(F.col("n_tokens") <= MAX_TOKENS)


def token_spans(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, pos, token, norm (lower case, no dots at the end), start, end in code points, gap (text since the token before)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    toks = F.regexp_extract_all(text, F.lit(T.KEY_TOKEN), F.lit(0))
    gaps = F.split(text, T.KEY_TOKEN)
    zipped = F.posexplode(F.arrays_zip(toks.alias("token"), F.slice(gaps, 1, F.size(toks)).alias("gap")))
    flat = docs.select(id_col, zipped.alias("pos", "z")).select(id_col, "pos", "z.token", "z.gap")
    w = W.partitionBy(id_col).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    flat = flat.withColumn("end", F.sum(F.length("gap") + F.length("token")).over(w).cast("long"))
    return flat.select(id_col, "pos", "token", F.rtrim(F.lower("token"), F.lit(".")).alias("norm"), (F.col("end") - F.length("token")).alias("start"), "end", "gap")


#: Tokens whose lengths are summed up once for all hits behind them.
STEP = 64


def candidates(docs: DataFrame, id_col: str, onto: DataFrame, text_col: str = "text", widths: int = MAX_TOKENS) -> DataFrame:
    """id, pos, width, key, name, category, start, end, surface: every n-gram of the text that is a key. A token of dots alone breaks n-grams.

    A token meets the keys that begin with it, with the tokens after it at hand, so only dictionary hits leave a text; their offsets are then
    counted in the text's own arrays, which are computed once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    toks = F.regexp_extract_all(text, F.lit(T.KEY_TOKEN), F.lit(0))
    base = docs.select(id_col, F.inline(F.array(F.struct(F.transform(toks, lambda t: F.rtrim(F.lower(t), F.lit("."))).alias("_n")))))
    rows = base.select(id_col, F.explode(F.transform("_n", lambda t, p: F.struct(p.alias("pos"), t.alias("_first"), F.slice("_n", p + 2, widths - 1).alias("_next")))).alias("r")).select(id_col, "r.*")
    keys = onto.filter(F.col("n_tokens") <= widths).select("key", "name", "category", F.split("key", " ").alias("_k")).filter("key <> ''")
    keys = lexicon(keys.select("key", "name", "category", F.size("_k").alias("width"), F.element_at("_k", 1).alias("_first"), F.slice("_k", 2, widths).alias("_rest")))
    hit = rows.filter("_first <> ''").join(keys, "_first").filter(F.slice("_next", 1, F.size("_rest")) == F.col("_rest")).select(id_col, "pos", "width", "key", "name", "category")
    by = hit.groupBy(id_col).agg(F.collect_list(F.struct("pos", "width", "key", "name", "category")).alias("_h"))
    met = docs.select(id_col, text.alias("_x")).join(by, id_col)
    met = met.select("*", F.inline(F.array(F.struct(F.regexp_extract_all("_x", F.lit(T.KEY_TOKEN), F.lit(0)).alias("_t"), F.split("_x", T.KEY_TOKEN).alias("_g")))))
    met = met.select("*", F.inline(F.array(F.struct(F.transform("_g", F.length).alias("_lg"), F.zip_with("_g", "_t", lambda g, t: F.length(g) + F.coalesce(F.length(t), F.lit(0))).alias("_w"))))).drop("_g")
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    sums = F.transform(F.sequence(F.lit(0), F.floor(F.size("_w") / STEP).cast("int")), lambda i: total(F.slice("_w", i * STEP + 1, STEP)))
    met = met.select("*", F.inline(F.array(F.struct(sums.alias("_s")))))
    met = met.select("*", F.inline(F.array(F.struct(F.aggregate("_s", F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x))).alias("_before"))))).drop("_s")
    step = lambda p: F.floor(p / STEP).cast("int")
    # where token p starts: whole steps of tokens, the rest of them one by one, the gap before it
    place = lambda p: F.get("_before", step(p)) + total(F.slice("_w", step(p) * STEP + 1, p % STEP)) + F.get("_lg", p)
    rows = F.transform("_h", lambda h: F.struct(
        *(h[c].alias(c) for c in ("pos", "width", "key", "name", "category")), place(h["pos"]).cast("long").alias("start"),
        (place(h["pos"] + h["width"] - 1) + F.length(F.rtrim(F.lower(F.get("_t", h["pos"] + h["width"] - 1)), F.lit(".")))).cast("long").alias("end"),
    ))
    return met.select(id_col, "_x", F.inline(rows)).withColumn("surface", F.substring(F.col("_x"), F.col("start") + 1, F.col("end") - F.col("start"))).drop("_x")


def credible(cands: DataFrame, docs: DataFrame, id_col: str, onto: DataFrame, text_col: str = "text") -> DataFrame:
    """Drops candidates of ambiguous keys (one character, or listed) without evidence: delimiters on both sides; or the canonical spelling next to an
    unambiguous key, one conjunction between them allowed, in the same sentence; or the canonical spelling within a sentence (longer keys only)."""
    amb = (F.length("key") == 1) | F.col("key").isin(*AMBIGUOUS)
    sure, doubt = cands.filter(~amb), cands.filter(amb)
    plain = onto.filter((F.length("key") > 1) & ~F.col("key").isin(*AMBIGUOUS) & (F.col("n_tokens") == 1)).select(F.col("key").alias("norm"), F.lit(True).alias("_skill"))
    spans = token_spans(docs.join(doubt.select(id_col).distinct(), id_col, "left_semi"), id_col, text_col).join(plain, "norm", "left")
    w = W.partitionBy(id_col).orderBy("pos")
    skill, conj = F.coalesce("_skill", F.lit(False)), F.col("norm").isin(*CONJUNCTIONS)
    dots = F.substring(F.col("token"), F.length("norm") + 1, F.length("token"))
    spans = spans.withColumn("_s", skill).withColumn("_c", conj).withColumn("_stop", F.concat(F.coalesce(F.lag(dots).over(w), F.lit("")), F.col("gap")).rlike(SENTENCE_END))
    spans = spans.withColumn("_left", F.when(F.col("_s"), True).when(F.col("_c"), ~F.col("_stop") & F.coalesce(F.lag("_s").over(w), F.lit(False))).otherwise(False))
    spans = spans.withColumn("_right", F.when(F.col("_s"), True).when(F.col("_c"), ~F.coalesce(F.lead("_stop").over(w), F.lit(True)) & F.coalesce(F.lead("_s").over(w), F.lit(False))).otherwise(False))
    at = spans.select(id_col, F.col("pos").alias("_p"), "_left", "_right", "_stop")
    before = at.select(id_col, (F.col("_p") + 1).alias("pos"), F.col("_left").alias("_lb"))
    own = at.select(id_col, F.col("_p").alias("pos"), F.col("_stop").alias("_so"))
    after = at.select(id_col, F.col("_p").alias("_q"), F.col("_right").alias("_ra"), F.col("_stop").alias("_sa"))
    d = doubt.withColumn("_q", F.col("pos") + F.col("width")).join(before, [id_col, "pos"], "left").join(own, [id_col, "pos"], "left").join(after, [id_col, "_q"], "left")
    d = d.join(docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_x")), id_col)
    pre, post = F.substring(F.col("_x"), F.lit(1), F.col("start").cast("int")), F.substring(F.col("_x"), (F.col("end") + 1).cast("int"), F.lit(12))
    tail = F.substring(pre, F.greatest(F.length(pre) - 11, F.lit(1)), F.lit(12))
    listed = (F.regexp_extract(tail, r"(\S)\s*$", 1).rlike(DELIMITER) | ~tail.rlike(r"\S")) & (F.regexp_extract(post, r"^\s*(\S)", 1).rlike(DELIMITER) | ~post.rlike(r"\S"))
    near = (F.coalesce("_lb", F.lit(False)) & ~F.coalesce("_so", F.lit(True))) | (F.coalesce("_ra", F.lit(False)) & ~F.coalesce("_sa", F.lit(True)))
    starts = ~pre.rlike(r"[^ \t]") | F.regexp_extract(pre, r"([^ \t])[ \t]*$", 1).rlike(SENTENCE_END) | pre.rlike(r"[\n\r][ \t]*$")
    keep = listed | ((F.col("surface") == F.col("name")) & (near | ((F.length("key") > 1) & ~starts)))
    return sure.unionByName(d.filter(keep).select(*sure.columns))


def resolve(cands: DataFrame, id_col: str) -> DataFrame:
    """Leftmost, then longest candidates that don't overlap: a fold over one text's candidates by (pos, -width)."""
    row = F.struct("pos", (-F.col("width")).alias("neg"), "key", "name", "category", "start", "end", "surface")
    kept = F.aggregate(
        F.array_sort(F.collect_list(row)),
        F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<pos:int,neg:int,key:string,name:string,category:string,start:bigint,end:bigint,surface:string>>").alias("out")),
        lambda s, c: F.when(c["pos"] >= s["free"], F.struct((c["pos"] - c["neg"]).alias("free"), F.concat(s["out"], F.array(c)).alias("out"))).otherwise(s),
        lambda s: s["out"],
    )
    return cands.groupBy(id_col).agg(kept.alias("h")).select(id_col, F.explode("h").alias("h")).select(id_col, "h.name", "h.category", "h.start", "h.end", "h.surface", F.lit("exact").alias("method"))


def fuzzy(docs: DataFrame, id_col: str, onto: DataFrame, exact: DataFrame, spans: DataFrame, text_col: str = "text") -> DataFrame:
    """Misspelt single tokens of FUZZY_MIN characters or more within the given spans (id, start, end), at FUZZY_THRESHOLD or more.

    Pairs are formed between distinct tokens and keys that share a character pair and whose lengths allow the score, not between all.
    """
    toks = token_spans(docs, id_col, text_col).filter(F.length("token") >= FUZZY_MIN)
    s = spans.select(id_col, F.col("start").alias("_s"), F.col("end").alias("_e"))
    toks = toks.join(s, id_col).filter("start >= _s and end <= _e").drop("_s", "_e").join(onto.select(F.col("key").alias("norm")), "norm", "left_anti")
    e = exact.select(id_col, F.col("start").alias("_s"), F.col("end").alias("_e"))
    toks = toks.join(e, (toks[id_col] == e[id_col]) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")), "left_anti")
    toks = cut(toks)
    pairs_of = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))
    keys = onto.filter((F.col("n_tokens") == 1) & (F.length("key") >= FUZZY_MIN)).select("key", "name", "category").withColumn("g", F.explode(pairs_of(F.col("key"))))
    words = toks.select("norm").distinct().withColumn("g", F.explode(pairs_of(F.col("norm"))))
    near = words.join(keys, "g").filter(200.0 * F.least(F.length("norm"), F.length("key")) / (F.length("norm") + F.length("key")) >= FUZZY_THRESHOLD)
    near = near.select("norm", "key", "name", "category").distinct().withColumn("score", indel_ratio("norm", "key")).filter(F.col("score") >= FUZZY_THRESHOLD)
    best = near.withColumn("_i", F.row_number().over(W.partitionBy("norm").orderBy(F.col("score").desc(), "key"))).filter("_i = 1")
    best = best.filter((F.length("key") > 1) & ~F.col("key").isin(*AMBIGUOUS))
    hit = toks.join(best.select("norm", "name", "category"), "norm").join(exact.select(id_col, "name").distinct(), [id_col, "name"], "left_anti")
    hit = hit.withColumn("_i", F.row_number().over(W.partitionBy(id_col, "name").orderBy("start"))).filter("_i = 1")
    return hit.select(id_col, "name", "category", "start", "end", F.col("token").alias("surface"), F.lit("fuzzy").alias("method"))


def find(docs: DataFrame, id_col: str, onto: DataFrame, text_col: str = "text", fuzzy_spans: DataFrame | None = None) -> DataFrame:
    """id, name, category, start, end, surface, method."""
    exact = resolve(credible(cut(candidates(docs, id_col, onto, text_col)), docs, id_col, onto, text_col), id_col)
    if fuzzy_spans is None:
        return exact
    exact = cut(exact)
    return exact.unionByName(fuzzy(docs, id_col, onto, exact, fuzzy_spans, text_col))


def by_category(hits: DataFrame, id_col: str) -> DataFrame:
    """id, category, names: distinct names in the order of their first appearance."""
    first = hits.groupBy(id_col, "category", "name").agg(F.min("start").alias("at"))
    return first.groupBy(id_col, "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("names"))
