"""Registered queries over the driver's tables, each with an independent SQL form where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import python_udfs as P
from corpusloom.functions import text as T
from corpusloom.operators import corpus, evaluate, facts, ir, lines, matching, phrases, roles, scorecard, store

VERBS = ["led", "built", "made", "wrote", "ran", "was", "the", "in", "die", "la", "el"]
HEADINGS = [("NOTICE", "All rights reserved."), ("NOTICE", "The and attion to thanedble the, anea. Eriner thanea."), ("OPENING", "Anquean çouê."), ("OPENING", "Ietzte."), ("OPENING", "And ornd.")]
PHRASES = [("of the", "en", ["in the"]), ("the", "en", ["that the"]), ("in", "en", []), ("de la", "fr", ["en la"]), ("la", "fr", ["le"]), ("die", "de", ["der die", "mit der die"]), ("que", "es", ["de que"]), ("go", "en", ["is"])]
FAMILIES = [("ring", "Jewel"), ("small ring", "Small jewel"), ("widget", "Device"), ("gear", "Device"), ("hot gear", "Hot"), ("bolt", "Fixing"), ("red bolt", "Red fixing"), ("blue", "Blue"), ("gear", "Machine")]


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q6(c: str):
    return F.round(c, 6).alias(c)


QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


STOP = "(" + ",".join(f"'{w}'" for w in T.STOPWORDS) + ")"
TOK = r"regexp_extract_all(lower(coalesce(text,'')), '[a-z][a-z0-9+#.\-]*')"
CTOK = f"list_filter({TOK}, lambda x: length(x) > 1 AND x NOT IN {STOP})"
BM25 = f"""
tok AS (SELECT doc_id, lang, {CTOK} AS ts FROM documents), dl AS (SELECT doc_id, lang, len(ts) AS dl FROM tok),
st AS (SELECT count(*) AS n, greatest(avg(dl), 1) AS avgdl FROM dl), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tok) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), qtf AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({CTOK}) AS term FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT item_id, tf.doc_id, dl.lang, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS bm25
  FROM qtf JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY 1, 2, 3)"""


def _bm25(spark, sf_dir, candidates=None):
    return ir.bm25(t(spark, sf_dir, "documents"), "doc_id", t(spark, sf_dir, "benchmark"), "item_id", candidates=candidates).withColumn("bm25", F.round("bm25", 6))


@query(f"WITH {BM25}, r AS (SELECT item_id, doc_id, round(bm25, 6) AS bm25 FROM sc), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, doc_id) AS rank FROM r) SELECT item_id, doc_id, bm25, rank FROM k WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return ir.top_k(_bm25(spark, sf_dir), "item_id", 10, F.col("bm25").desc(), "doc_id")


@query(f"WITH {BM25}, r AS (SELECT item_id, doc_id, round(bm25, 6) AS bm25 FROM sc WHERE lang = 'fr'), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, doc_id) AS rank FROM r) SELECT item_id, doc_id, bm25, rank FROM k WHERE rank <= 10")
def bm25_filtered_global_idf(spark, sf_dir):
    return ir.top_k(_bm25(spark, sf_dir, F.col("lang") == "fr"), "item_id", 10, F.col("bm25").desc(), "doc_id")


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({CTOK}) AS term FROM documents) GROUP BY 1, 2")
def term_frequency(spark, sf_dir):
    return ir.term_frequency(t(spark, sf_dir, "documents"), "doc_id")


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({CTOK}) AS term FROM documents) GROUP BY 1")
def document_frequency(spark, sf_dir):
    return ir.document_frequency(ir.term_frequency(t(spark, sf_dir, "documents"), "doc_id"))


@query(f"SELECT greatest(count(*), 1) AS n_docs, round(greatest(avg(len({CTOK})), 1), 6) AS avgdl FROM documents")
def corpus_stats(spark, sf_dir):
    return ir.corpus_stats(t(spark, sf_dir, "documents")).select("n_docs", q6("avgdl"))


@query(f"SELECT item_id, term, round(1 + ln(count(*)), 6) AS w FROM (SELECT item_id, unnest({CTOK}) AS term FROM benchmark) GROUP BY 1, 2")
def sublinear_tf(spark, sf_dir):
    return ir.term_frequency(t(spark, sf_dir, "benchmark"), "item_id").select("item_id", "term", F.round(ir.sublinear(F.col("tf")), 6).alias("w"))


@query(f"""WITH a AS (SELECT doc_id, term, 1 + ln(count(*)) AS w FROM (SELECT doc_id, unnest({CTOK}) AS term FROM documents) GROUP BY 1, 2),
b AS (SELECT item_id, term, 1 + ln(count(*)) AS w FROM (SELECT item_id, unnest({CTOK}) AS term FROM benchmark) GROUP BY 1, 2),
p AS (SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (term)),
l AS (SELECT p.doc_id, p.item_id, a.term, a.w AS wa FROM p JOIN a USING (doc_id)), r AS (SELECT p.doc_id, p.item_id, b.term, b.w AS wb FROM p JOIN b USING (item_id)),
f AS (SELECT doc_id, item_id, term, wa, wb, ln(3.0::DOUBLE / (1 + (wa IS NOT NULL)::INT + (wb IS NOT NULL)::INT)) + 1 AS idf FROM l FULL JOIN r USING (doc_id, item_id, term))
SELECT doc_id, item_id, round(least(greatest(sum(coalesce(wa * idf * wb * idf, 0)) / (sqrt(sum(coalesce(wa * idf, 0) ** 2)) * sqrt(sum(coalesce(wb * idf, 0) ** 2))), 0), 1), 6) AS lexical FROM f GROUP BY 1, 2""")
def lexical_cosine_pairs(spark, sf_dir):
    return ir.lexical_cosine(t(spark, sf_dir, "documents"), "doc_id", t(spark, sf_dir, "benchmark"), "item_id").select("doc_id", "item_id", q6("lexical"))


COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


def _vectors(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("q_label"))
    return e, q


@query(f"""WITH s AS (SELECT b.vec_id AS query_id, a.vec_id, round({COS}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s) SELECT * FROM k WHERE rank <= 10""")
def vector_cosine_topk(spark, sf_dir):
    e, q = _vectors(spark, sf_dir)
    s = ir.nearest(q, "query_id", "q", e, "vec_id", "embedding", 10).select("query_id", F.col("row_id").alias("vec_id"), q6("cosine"))
    return ir.top_k(s, "query_id", 10, F.col("cosine").desc(), "vec_id")


@query(f"""WITH s AS (SELECT b.label AS target, b.vec_id AS piece, max({COS}) AS m FROM embeddings a JOIN embeddings b ON b.vec_id % 20 = 0 AND a.vec_id <> b.vec_id GROUP BY 1, 2)
SELECT target, round(least(greatest(avg(m), 0), 1), 6) AS pooled FROM s GROUP BY 1""")
def max_pool_by_label(spark, sf_dir):
    e, q = _vectors(spark, sf_dir)
    s = ir.nearest(q, "query_id", "q", e, "vec_id", "embedding", 1).join(q.select("query_id", F.col("q_label").alias("target")), "query_id")
    return ir.max_pool_mean(s, "target", "query_id").select("target", q6("pooled"))


@query(f"""WITH {BM25}, r AS (SELECT item_id, doc_id, round(bm25, 6) AS bm25 FROM sc), p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, doc_id) AS rk FROM r),
v AS (SELECT item_id, doc_id, bm25, round(least(greatest({COS}, 0), 1), 6) AS semantic FROM p JOIN embeddings a ON a.vec_id = doc_id JOIN embeddings b ON b.vec_id = item_id WHERE rk <= 200),
s AS (SELECT *, CAST(round_even(least(greatest(round(0.6::DOUBLE * semantic + 0.4::DOUBLE * coalesce(bm25 / max(bm25) OVER (PARTITION BY item_id), 0), 6), 0), 1) * 100, 0) AS INT) AS score FROM v),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, bm25 DESC, doc_id) AS rank FROM s) SELECT item_id, doc_id, bm25, semantic, score, rank FROM k WHERE rank <= 10""")
def blended_rerank(spark, sf_dir):
    pool = ir.top_k(_bm25(spark, sf_dir), "item_id", 200, F.col("bm25").desc(), "doc_id").drop("rank")
    e = t(spark, sf_dir, "embeddings")
    v = pool.join(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("a")), "doc_id").join(e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("b")), "item_id")
    v = v.withColumn("semantic", F.round(T.clamp(ir.cosine(F.col("a"), F.col("b"))), 6)).drop("a", "b")
    return ir.top_k(ir.rerank(v, "item_id"), "item_id", 10, F.col("score").desc(), F.col("bm25").desc(), "doc_id")


LINES = r"""
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
pos AS (SELECT *, coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs FROM raw),
ln AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS line_no, regexp_replace(l, '^\s+|\s+$', '', 'g') AS line, ofs + length(l) - length(regexp_replace(l, '^\s+', '')) AS start
  FROM pos WHERE regexp_replace(l, '^\s+|\s+$', '', 'g') <> '')"""


@query(f"WITH {LINES} SELECT doc_id, line_no, line, CAST(start AS BIGINT) AS start, CAST(start + length(line) AS BIGINT) AS \"end\" FROM ln")
def line_spans(spark, sf_dir):
    return lines.line_spans(t(spark, sf_dir, "documents"), "doc_id")


BULLET = r"'^\s*(?:[*\-•●▪·o>]|\d+[.)])\s+'"
BULLETS = rf"""ls AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents),
bl AS (SELECT doc_id, CASE WHEN len(list_filter(ls, lambda x: regexp_matches(x, {BULLET}))) > 0
  THEN list_filter(list_transform(list_filter(ls, lambda x: regexp_matches(x, {BULLET})), lambda x: regexp_replace(regexp_replace(x, {BULLET}, ''), '^\s+|\s+$', '', 'g')), lambda x: x <> '')
  ELSE list_filter(ls, lambda x: length(x) >= 40) END AS b FROM ls)"""


@query(rf"""WITH {BULLETS} SELECT doc_id, len(b) AS n_bullets, coalesce(list_sum(list_transform(b, lambda x: len(regexp_extract_all(x, '\S+')))), 0)::BIGINT AS n_words,
len(list_filter(b, lambda x: trim(regexp_extract(lower(x), '^[a-z][a-z0-9+#.\-]*'), '.') IN ('led','built','made','wrote','ran','was','the','in','die','la','el'))) AS n_verbs FROM bl""")
def bullet_stats(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", T.bullets("text").alias("b"))
    words = F.aggregate(F.transform("b", T.word_count), F.lit(0).cast("long"), lambda s, x: s + x)
    return d.select("doc_id", F.size("b").alias("n_bullets"), words.alias("n_words"), F.size(F.filter("b", lambda x: T.first_word(x).isin(VERBS))).alias("n_verbs"))


def _headings(spark):
    return spark.createDataFrame(HEADINGS, "canonical string, variant string")


NORM = "trim(regexp_replace(lower({}), '[^a-z0-9+#.]+', ' ', 'g'))"
SEG = rf"""{LINES}, hv AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in HEADINGS)}) v(canonical, variant)),
hk AS (SELECT DISTINCT {NORM.format("variant")} AS key, canonical FROM hv UNION SELECT DISTINCT {NORM.format("canonical")}, canonical FROM hv),
s0 AS (SELECT *, {NORM.format("rtrim(line, ':')")} AS k, regexp_replace(rtrim(line, ':'), '^\s+|\s+$', '', 'g') AS s FROM ln),
s1 AS (SELECT s0.*, canonical, list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '') AS ws, regexp_replace(s, '\PL', '', 'g') AS lt, length(regexp_replace(s, '\P{{Nd}}', '', 'g')) AS nd FROM s0 LEFT JOIN hk ON key = k),
s2 AS (SELECT *, canonical IS NOT NULL AS known, canonical IS NOT NULL OR (k <> '' AND s <> '' AND length(s) <= 60 AND NOT regexp_matches(s, '[.!?;](\s|$)') AND NOT regexp_matches(s, '@|https?://|\+\d|\d{{6,}}') AND NOT regexp_matches(s, ':\s*\S')
  AND len(ws) BETWEEN 1 AND 6 AND lt <> '' AND nd <= 0.25 * length(s) AND (regexp_matches(lt, '^\p{{Lu}}+$') OR (len(ws) >= 2 AND len(list_filter(ws, lambda w: NOT (regexp_matches(w, '^[\p{{Lu}}\p{{Lt}}]') OR lower(w) IN ('of','and','the','in','for','to','on')))) = 0))) AS shape FROM s1),
s3 AS (SELECT *, coalesce(max(known::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS seen, coalesce(lag(shape) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS bef,
  coalesce(lead(shape) OVER (PARTITION BY doc_id ORDER BY line_no), true) AS aft FROM s2),
s4 AS (SELECT *, CASE WHEN known THEN canonical WHEN shape AND seen AND NOT bef AND NOT aft THEN 'OTHER:' || s END AS name FROM s3)"""


@query(f"WITH {SEG} SELECT doc_id, line_no, name FROM s4 WHERE name IS NOT NULL")
def heading_segments(spark, sf_dir):
    return lines.mark_headings(lines.line_spans(t(spark, sf_dir, "documents"), "doc_id"), "doc_id", _headings(spark)).filter("name is not null").select("doc_id", "line_no", "name")


@query(rf"""WITH {SEG}, o AS (SELECT *, sum((name IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS ord FROM s4),
g AS (SELECT doc_id, ord, max(name) AS name, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (name IS NULL), ''), '^\s+|\s+$', '', 'g') AS body, min(line_no) AS start_line FROM o GROUP BY 1, 2),
h AS (SELECT DISTINCT doc_id FROM g WHERE ord > 0)
SELECT doc_id, CAST(ord AS BIGINT) AS ord, name, length(body) AS n_body, md5(body) AS body_md5 FROM g WHERE doc_id IN (SELECT doc_id FROM h)
UNION ALL SELECT doc_id, 1, 'BODY', length(text), md5(text) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h)""")
def sections(spark, sf_dir):
    return lines.sections(t(spark, sf_dir, "documents"), "doc_id", _headings(spark)).select("doc_id", F.col("ord").cast("long").alias("ord"), "name", F.length("body").alias("n_body"), F.md5("body").alias("body_md5"))


@query(rf"""WITH c AS (SELECT doc_id, text, list_transform(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x, ' ' || chr(9) || '-*•>')), lambda x: length(x) >= 25), lambda x: substr(x, 1, 480)) AS c FROM documents)
SELECT doc_id, CASE WHEN len(c) > 0 THEN len(c) WHEN regexp_matches(text, '\S') THEN 1 ELSE 0 END AS n_chunks, CASE WHEN len(c) > 0 THEN list_sum(list_transform(c, lambda x: length(x)))::BIGINT ELSE least(length(regexp_replace(text, '^\s+|\s+$', '', 'g')), 480)::BIGINT END AS n_chars FROM c""")
def chunk_counts(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", T.chunks("text").alias("c"))
    return d.select("doc_id", F.size("c").alias("n_chunks"), F.aggregate(F.transform("c", F.length), F.lit(0).cast("long"), lambda s, x: s + x).alias("n_chars"))


@query(f"SELECT doc_id, regexp_extract(text, '{facts.EMAIL}') AS email FROM documents WHERE regexp_matches(text, '{facts.EMAIL}')")
def email_extract(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", facts.first(F.col("text"), facts.EMAIL).alias("email")).filter("email is not null")


@query(r"SELECT page_id, len(l) AS n_links, l[1] AS first_link FROM (SELECT page_id, regexp_extract_all(html, 'https?://[A-Za-z0-9.\-]+\.[A-Za-z]{2,}(?:/[^\s,;]*)?') AS l FROM pages)")
def url_extract(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", facts.every(F.col("html"), facts.PORTFOLIO).alias("l")).select("page_id", F.size("l").alias("n_links"), F.try_element_at("l", F.lit(1)).alias("first_link"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '(?:19|20)\d{2}')) AS n_years, coalesce(list_max(list_transform(regexp_extract_all(text, '(?:19|20)\d{2}'), lambda x: x::INT)), 0) AS last_year FROM documents")
def year_mentions(spark, sf_dir):
    y = facts.every(F.col("text"), r"(?:19|20)\d{2}")
    return t(spark, sf_dir, "documents").select("doc_id", F.size(y).alias("n_years"), F.coalesce(F.array_max(F.transform(y, lambda x: x.cast("int"))), F.lit(0)).alias("last_year"))


CLICHE_SQL = " + ".join(f"contains(lower(text), '{p}')::INT" for p in scorecard.CLICHES)


@query(rf"SELECT conv_id, turn, CAST({CLICHE_SQL} AS INT) AS n_cliches, len(regexp_extract_all(text, '(?i)\b(?:me|my|mine|myself|i)\b')) - len(regexp_extract_all(text, '(?i)\bi[./]')) AS n_pronouns FROM conversations")
def tone_count(spark, sf_dir):
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(scorecard.cliches(F.col("text"))).alias("n_cliches"), scorecard.pronouns(F.col("text")).alias("n_pronouns"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\d+\s*%')) AS n_percent, len(regexp_extract_all(text, '\d+')) AS n_numbers FROM documents""")
def quantity_counts(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\d+\s*%")).alias("n_percent"), F.regexp_count("text", F.lit(r"\d+")).alias("n_numbers"))


def _onto(spark):
    return phrases.ontology(spark.createDataFrame(PHRASES, "name string, category string, aliases array<string>"))


_KEYS = sorted({(k, n, c) for n, c, a in PHRASES for k in (n, *a)})


@query(rf"""WITH k AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{n}', '{c}')" for k, n, c in _KEYS)}) v(key, name, category)),
tk AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9+#.]+'), lambda x: rtrim(lower(x), '.')) AS ts FROM documents),
g AS (SELECT doc_id, w AS width, p AS pos, array_to_string(ts[p + 1:p + w], ' ') AS key, len(list_filter(ts[p + 1:p + w], lambda x: x = '')) AS bad FROM tk, (SELECT unnest([1, 2, 3]) AS w), LATERAL (SELECT unnest(range(0, len(ts) - w + 1)) AS p))
SELECT name, width, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM g JOIN k USING (key) WHERE bad = 0 GROUP BY 1, 2""")
def ngram_dictionary_hits(spark, sf_dir):
    hits = phrases.candidates(t(spark, sf_dir, "documents"), "doc_id", _onto(spark), widths=3)
    return hits.groupBy("name", "width").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query()
def longest_match_hits(spark, sf_dir):
    return phrases.find(t(spark, sf_dir, "documents"), "doc_id", _onto(spark))


@query()
def skills_by_category(spark, sf_dir):
    return phrases.by_category(phrases.find(t(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn")), "id", _onto(spark)), "id")


@query()
def fuzzy_tokens(spark, sf_dir):
    docs = t(spark, sf_dir, "benchmark")
    onto = phrases.ontology(docs.select(F.explode(F.array_distinct(F.filter(T.tokens("text"), lambda x: F.length(x) >= 8))).alias("name")).distinct().filter(~F.col("name").rlike(r"\.$|-")).select("name", F.lit("word").alias("category"), F.array().cast("array<string>").alias("aliases")))
    some = t(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    none = some.sparkSession.createDataFrame([], "id string, name string, category string, start long, end long, surface string, method string")
    return phrases.fuzzy(some, "id", onto, none, some.select("id", F.lit(0).alias("start"), F.length("text").alias("end")))


WANTED = """w AS (SELECT l_orderkey, p_brand AS name, 1 + ln(count(*)) AS w, min(l_linenumber) AS fst FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
wt AS (SELECT l_orderkey, name, fst, w / max(w) OVER (PARTITION BY l_orderkey) AS weight FROM w), own AS (SELECT DISTINCT l_suppkey, p_brand AS name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 49),
pr AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
cov AS (SELECT pr.l_orderkey, pr.l_suppkey, wt.name, wt.fst, wt.weight, own.name IS NOT NULL AS matched FROM pr JOIN wt USING (l_orderkey) LEFT JOIN own ON own.l_suppkey = pr.l_suppkey AND own.name = wt.name)"""


def _coverage(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).withColumn("name", F.col("p_brand"))
    want = matching.wanted_weights(li, "l_orderkey", "name", "l_linenumber")
    return matching.coverage(want, "l_orderkey", li.filter("l_quantity > 49"), "l_suppkey", t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct())


@query(f"WITH {WANTED} SELECT l_orderkey, l_suppkey, round(least(greatest(sum(CASE WHEN matched THEN weight ELSE 0 END) / sum(weight), 0), 1), 6) AS skill FROM cov GROUP BY 1, 2")
def weighted_recall(spark, sf_dir):
    return matching.weighted_recall(_coverage(spark, sf_dir), "l_orderkey", "l_suppkey").select("l_orderkey", "l_suppkey", q6("skill"))


@query(f"""WITH {WANTED}, s AS (SELECT *, weight / max(weight) OVER (PARTITION BY l_orderkey, l_suppkey) AS r FROM cov)
SELECT l_orderkey, l_suppkey, name, round(weight, 6) AS weight, CASE WHEN r >= 0.75 THEN 'critical' WHEN r >= 0.4 THEN 'important' ELSE 'nice_to_have' END AS severity FROM s WHERE NOT matched""")
def severity_gaps(spark, sf_dir):
    return _coverage(spark, sf_dir).filter("not matched").select("l_orderkey", "l_suppkey", "name", q6("weight"), "severity")


@query("""WITH a AS (SELECT l_orderkey, list_sort(list(DISTINCT p_brand)) AS b FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
n AS (SELECT x.l_orderkey, x.b AS x, y.b AS y FROM a x JOIN a y ON y.l_orderkey = x.l_orderkey + 1)
SELECT l_orderkey, array_to_string(list_sort(list_intersect(x, y)), ',') AS shared, array_to_string(list_sort(list_filter(x, lambda e: NOT list_contains(y, e))), ',') AS missing, array_to_string(list_sort(list_filter(y, lambda e: NOT list_contains(x, e))), ',') AS extra FROM n""")
def set_overlap(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    a = li.groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("x"))
    n = a.join(a.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("x").alias("y")), "l_orderkey")
    s = lambda c: F.array_join(F.array_sort(c), ",")
    return n.select("l_orderkey", s(F.array_intersect("x", "y")).alias("shared"), s(F.array_except("x", "y")).alias("missing"), s(F.array_except("y", "x")).alias("extra"))


PROF = """b AS (SELECT o_orderpriority AS role, o_orderkey AS item, p_brand AS feature FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
n AS (SELECT role, count(DISTINCT item) AS n FROM b GROUP BY 1), pf AS (SELECT role, feature, count(DISTINCT item)::DOUBLE / max(n) AS weight FROM b JOIN n USING (role) GROUP BY 1, 2)"""


def _profiles(spark, sf_dir):
    o = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    b = o.select(F.col("o_orderpriority").alias("role"), F.col("o_orderkey").alias("item"), F.col("p_brand").alias("feature"))
    return b, roles.profiles(b, "role", "item", "feature")


@query(f"WITH {PROF} SELECT role, feature, round(weight, 6) AS weight FROM pf")
def profile_by_group(spark, sf_dir):
    return _profiles(spark, sf_dir)[1].select("role", "feature", q6("weight"))


@query(f"""WITH {PROF}, sp AS (SELECT feature, count(DISTINCT role) AS sp FROM pf GROUP BY 1), k AS (SELECT role, feature, weight * ln(1 + (SELECT count(DISTINCT role) FROM pf)::DOUBLE / sp) AS score FROM pf JOIN sp USING (feature)),
r AS (SELECT role, feature, round(score, 6) AS score, row_number() OVER (PARTITION BY role ORDER BY round(score, 9) DESC, feature) AS rank FROM k) SELECT * FROM r WHERE rank <= 10""")
def role_keywords(spark, sf_dir):
    return roles.keywords(_profiles(spark, sf_dir)[1], "role", "feature", 10).select("role", "feature", q6("score"), "rank")


@query(f"""WITH {PROF}, h AS (SELECT DISTINCT l_orderkey AS doc, p_brand AS feature FROM lineitem JOIN part ON p_partkey = l_partkey), tt AS (SELECT role, sum(weight) AS t FROM pf GROUP BY 1),
s AS (SELECT doc, role, sum(weight) / max(t) AS score FROM h JOIN pf USING (feature) JOIN tt USING (role) GROUP BY 1, 2),
r AS (SELECT doc, role, score, row_number() OVER (PARTITION BY doc ORDER BY round(score, 9) DESC, role) AS rank FROM s)
SELECT doc, role, round(score, 6) AS score, rank, round(score - coalesce(lead(score) OVER (PARTITION BY doc ORDER BY rank), 0), 6) AS margin FROM r""")
def top_role(spark, sf_dir):
    h = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("doc"), F.col("p_brand").alias("feature"))
    return roles.predict(h, "doc", _profiles(spark, sf_dir)[1], "role", "feature").select("doc", "role", q6("score"), "rank", q6("margin"))


@query(f"""WITH {PROF}, f AS (SELECT DISTINCT item, role, feature FROM b), k AS (SELECT role, feature, count(*) AS k FROM f GROUP BY 1, 2), sz AS (SELECT item, count(*) AS m FROM f GROUP BY 1),
tt AS (SELECT role, sum(k) AS t FROM k GROUP BY 1), g AS (SELECT f.item, f.role AS own, k.role, sum(k.k - (k.role = f.role)::INT) AS c FROM f JOIN k USING (feature) GROUP BY 1, 2, 3),
s AS (SELECT item, own, role, round(coalesce(c::DOUBLE / nullif(t - CASE WHEN role = own THEN m ELSE 0 END, 0), 0), 9) AS s FROM g JOIN tt USING (role) JOIN sz USING (item) JOIN n USING (role) WHERE role <> own OR n.n > 1),
p AS (SELECT item, role AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY s DESC, role) AS i FROM s) WHERE i = 1)
SELECT i.item, i.role, p.predicted, coalesce(p.predicted = i.role, false) AS correct FROM (SELECT DISTINCT item, role FROM b) i LEFT JOIN p USING (item)""")
def leave_one_out_roles(spark, sf_dir):
    return roles.leave_one_out(_profiles(spark, sf_dir)[0], "item", "role", "feature")


@query("""WITH i AS (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS s, CAST(floor(epoch(ts) / 3600) AS BIGINT) + CAST(floor(value / 10) AS BIGINT) AS e FROM events),
m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM i WHERE e > s),
g AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, min(s) AS start, max(e) AS "end" FROM g GROUP BY user_id, island""")
def interval_merge(spark, sf_dir):
    h = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600e6).cast("long")
    i = t(spark, sf_dir, "events").select("user_id", h.alias("start"), (h + F.floor(F.col("value") / 10).cast("long")).alias("end"))
    return facts.merge_intervals(i, "user_id").select("user_id", "start", "end")


@query("SELECT count(*) AS n, round(coalesce(avg(n_chars), 0), 1) AS mean, coalesce(max(n_chars), 0) AS best FROM documents")
def cohort_stats(spark, sf_dir):
    return store.totals(t(spark, sf_dir, "documents"), "n_chars")


@query("SELECT source, count(*) AS n, round(avg(n_chars), 1) AS mean FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, source LIMIT 10")
def by_group_top10(spark, sf_dir):
    return store.by_group(t(spark, sf_dir, "documents"), "source", "n_chars")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest_first_topn(spark, sf_dir):
    return store.newest(t(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", 50).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS file_hash FROM documents GROUP BY 2")
def hash_dedupe(spark, sf_dir):
    return store.dedupe(store.with_hash(t(spark, sf_dir, "documents"), "text"), "file_hash", "doc_id").select("doc_id", "file_hash")


@query("WITH e AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 2 = 0) SELECT min(doc_id) AS doc_id, sha256(text) AS file_hash FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT h FROM e) GROUP BY 2")
def insert_if_absent(spark, sf_dir):
    d = store.with_hash(t(spark, sf_dir, "documents"), "text")
    return store.insert_if_absent(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), "file_hash", "doc_id").select("doc_id", "file_hash")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT')")
def left_anti_orphans(spark, sf_dir):
    kept = t(spark, sf_dir, "orders").filter("o_orderpriority <> '1-URGENT'")
    return store.orphans(t(spark, sf_dir, "lineitem"), "l_orderkey", kept, "o_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F'")
def cascade_delete(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    keep = store.cascade_delete(o, "o_orderkey", t(spark, sf_dir, "lineitem"), "l_orderkey", o.filter("o_orderstatus = 'F'"))
    return keep[1].select("l_orderkey", "l_linenumber")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ordinal FROM orders")
def oldest_first_ordinals(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumn("_at", F.struct("o_orderdate", "o_orderkey"))
    return store.ordinals(o, "_at", "o_custkey").select("o_custkey", "o_orderkey", "ordinal")


@query(f"""WITH f AS (SELECT DISTINCT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in FAMILIES)}) v(phrase, family)),
h AS (SELECT p_partkey, family, dense_rank() OVER (PARTITION BY p_partkey ORDER BY length(phrase) DESC) AS k FROM part JOIN f ON contains(' ' || lower(p_name) || ' ', ' ' || phrase || ' ')),
b AS (SELECT p_partkey, count(DISTINCT family) AS n_best, min(family) AS fam FROM h WHERE k = 1 GROUP BY 1)
SELECT part.p_partkey, CASE WHEN n_best IS NULL THEN 'unknown' WHEN n_best > 1 THEN 'ambiguous' ELSE fam END AS family, coalesce(n_best, 0) AS n_best FROM part LEFT JOIN b USING (p_partkey)""")
def title_family(spark, sf_dir):
    return corpus.title_family(t(spark, sf_dir, "part"), "p_partkey", "p_name", spark.createDataFrame(FAMILIES, "phrase string, family string"))


_LEVEL_SQL = " ".join(f"WHEN contains(low, '{p}') THEN {v}" for p, v in sorted(corpus.LEVELS.items(), key=lambda x: (-len(x[0]), x[0])))


@query(rf"""WITH v AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN event_type WHEN 2 THEN value::VARCHAR || ' years' WHEN 3 THEN 'Senior ' || event_type WHEN 4 THEN 'Mid-Senior level' ELSE 'Intern / ' || event_type END AS c FROM events),
l AS (SELECT event_id, c, trim(regexp_replace(regexp_replace(lower(c), '[^a-z0-9. ]+', ' ', 'g'), '\s+', ' ', 'g')) AS low FROM v),
n AS (SELECT *, try_cast(nullif(regexp_extract(low, '\d+(?:\.\d+)?'), '') AS DOUBLE) AS num FROM l),
y AS (SELECT *, CASE WHEN trim(c) = '' THEN 0.0::DOUBLE WHEN num IS NOT NULL THEN CASE WHEN num <= 50 THEN num END ELSE CASE {_LEVEL_SQL} END END AS years FROM n)
SELECT event_id, CAST(years AS DOUBLE) AS years, CASE WHEN trim(c) = '' THEN 'missing' WHEN years IS NULL THEN 'unparseable' WHEN num IS NOT NULL THEN 'number' ELSE 'level' END AS source FROM y""")
def experience_parse(spark, sf_dir):
    k = F.col("event_id") % 6
    c = F.when(k == 0, "").when(k == 1, F.col("event_type")).when(k == 2, F.concat(F.col("value").cast("string"), F.lit(" years"))).when(k == 3, F.concat(F.lit("Senior "), "event_type")).when(k == 4, "Mid-Senior level").otherwise(F.concat(F.lit("Intern / "), "event_type"))
    return t(spark, sf_dir, "events").select("event_id", corpus.experience(c).alias("x")).select("event_id", "x.years", "x.source")


_EMP_SQL = " ".join(f"WHEN k = '{a}' THEN '{b}'" for a, b in corpus.EMPLOYMENT.items())


@query(rf"""WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Full-Time' WHEN 1 THEN ' contractor ' WHEN 2 THEN event_type ELSE 'Part  time' END AS c FROM events), n AS (SELECT *, trim(regexp_replace(lower(c), '[^a-z]+', ' ', 'g')) AS k FROM v)
SELECT event_id, CASE {_EMP_SQL} ELSE trim(regexp_replace(c, '\s+', ' ', 'g')) END AS label FROM n""")
def employment_fold(spark, sf_dir):
    k = F.col("event_id") % 4
    c = F.when(k == 0, "Full-Time").when(k == 1, " contractor ").when(k == 2, F.col("event_type")).otherwise("Part  time")
    return t(spark, sf_dir, "events").select("event_id", corpus.employment(c).alias("label"))


JUDGED = r"""j AS (SELECT lang AS query, doc_id, quality = 1 AS relevant, least(n_chars / 20000.0::DOUBLE, 1) AS s1, len(regexp_extract_all(text, '[!?#$%&*|]'))::DOUBLE / greatest(n_chars, 1) AS s2, (doc_id % 97) / 97.0::DOUBLE AS s3 FROM documents JOIN labels USING (doc_id))"""


def _judged(spark, sf_dir):
    d = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id")
    odd = F.regexp_count("text", F.lit(r"[!?#$%&*|]")).cast("double") / F.greatest("n_chars", F.lit(1))
    return d.select(F.col("lang").alias("query"), "doc_id", (F.col("quality") == 1).alias("relevant"), F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("s1"), odd.alias("s2"), ((F.col("doc_id") % 97) / 97.0).alias("s3"))


def _acc(s: str) -> str:
    return f"(SELECT a.query, avg(CASE WHEN a.{s} > b.{s} THEN 1.0 WHEN a.{s} = b.{s} THEN 0.5 ELSE 0 END) AS acc FROM j a JOIN j b ON a.query = b.query AND a.relevant AND NOT b.relevant GROUP BY 1)"


@query(f"WITH {JUDGED} SELECT round(avg(acc), 6) AS accuracy, count(*) AS n_queries FROM {_acc('s2')}")
def pairwise_accuracy(spark, sf_dir):
    return evaluate.pairwise_accuracy(_judged(spark, sf_dir), "s2").select(q6("accuracy"), "n_queries")


@query(f"WITH {JUDGED} " + " UNION ALL ".join(f"SELECT '{s}' AS signal, round((SELECT avg(acc) FROM {_acc(s)}), 6) AS accuracy, round(avg(d), 6) AS spread FROM (SELECT max({s}) - min({s}) AS d FROM j GROUP BY query)" for s in ("s1", "s2", "s3")))
def signal_spread(spark, sf_dir):
    return evaluate.diagnostics(_judged(spark, sf_dir), ["s1", "s2", "s3"]).select("signal", q6("accuracy"), q6("spread"))


@query(f"""WITH {JUDGED}, g AS (SELECT a / 20.0::DOUBLE AS w_s1, b / 20.0::DOUBLE AS w_s2, (20 - a - b) / 20.0::DOUBLE AS w_s3 FROM (SELECT unnest(range(0, 21)) AS a), (SELECT unnest(range(0, 21)) AS b) WHERE a + b <= 20),
x AS (SELECT w_s1, w_s2, w_s3, query, relevant, round(w_s1 * s1 + w_s2 * s2 + w_s3 * s3, 9) AS t FROM j, g),
c AS (SELECT a.w_s1, a.w_s2, a.w_s3, a.query, avg(CASE WHEN a.t > b.t THEN 1.0 WHEN a.t = b.t THEN 0.5 ELSE 0 END) AS acc FROM x a JOIN x b ON a.query = b.query AND a.w_s1 = b.w_s1 AND a.w_s2 = b.w_s2 AND a.relevant AND NOT b.relevant GROUP BY 1, 2, 3, 4),
m AS (SELECT w_s1, w_s2, w_s3, round(avg(acc), 6) AS accuracy FROM c GROUP BY 1, 2, 3) SELECT w_s1, w_s2, w_s3, accuracy, rank() OVER (ORDER BY accuracy DESC) AS rank FROM m""")
def weight_grid_sweep(spark, sf_dir):
    from pyspark.sql import Window as W

    got = evaluate.sweep(_judged(spark, sf_dir), ["s1", "s2", "s3"], evaluate.weight_grid(spark, ["s1", "s2", "s3"], 0.05)).select("w_s1", "w_s2", "w_s3", q6("accuracy"))
    return got.withColumn("rank", F.rank().over(W.orderBy(F.col("accuracy").desc())))


@query(f"""WITH {JUDGED}, d AS (SELECT row_number() OVER (ORDER BY a.query) - 1 AS i, round(a.acc - b.acc, 12) AS d FROM {_acc('s1')} a JOIN {_acc('s2')} b USING (query)),
r AS (SELECT x AS round, k, ('0x' || substr(md5('0-' || x || '-' || k), 1, 8))::BIGINT % (SELECT count(*) FROM d) AS i FROM (SELECT unnest(range(0, 1000)) AS x), LATERAL (SELECT unnest(range(1, (SELECT count(*) FROM d) + 1)) AS k)),
w AS (SELECT round, round(sum(d), 9) > 0 AS won FROM r JOIN d USING (i) GROUP BY 1) SELECT count(*) FILTER (won) / 1000.0::DOUBLE AS win_rate, (SELECT count(*) FROM d) AS n_queries FROM w""")
def bootstrap_win_rate(spark, sf_dir):
    j = _judged(spark, sf_dir)
    return evaluate.bootstrap(spark, evaluate.pair_wins(j, "s1"), evaluate.pair_wins(j, "s2"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def props_json(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT DISTINCT p_brand FROM part ORDER BY 1")
def facet_values(spark, sf_dir):
    return corpus.facets(t(spark, sf_dir, "part"), "p_brand")


@query("WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), l AS (SELECT list_sort(list(n)) AS s FROM n) SELECT count(*) AS classes, min(n) AS least, max(n) AS most, max((SELECT s[len(s) // 2 + 1] FROM l)) AS median, count(*) FILTER (n = 1) AS singles FROM n")
def class_profile(spark, sf_dir):
    return corpus.class_profile(t(spark, sf_dir, "documents"), "source")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE 'new' END AS origin FROM documents")
def append_existing_wins(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id")
    return corpus.append(d.filter("doc_id % 3 = 0").withColumn("origin", F.lit("old")), d.withColumn("origin", F.lit("new")), "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'not read back' ELSE 'differs: n_chars' END AS problem FROM documents WHERE doc_id % 50 = 0 OR doc_id % 41 = 0")
def reconcile(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return corpus.reconcile(d, d.filter("doc_id % 50 <> 0").withColumn("n_chars", F.when(F.col("doc_id") % 41 == 0, -1).otherwise(F.col("n_chars"))), "doc_id")


@query("""WITH a AS (SELECT lang AS category, count(*) AS n FROM documents WHERE doc_id % 2 = 0 AND lang <> 'de' GROUP BY 1), b AS (SELECT lang AS category, count(*) AS n FROM documents WHERE doc_id % 2 = 1 AND lang <> 'fr' GROUP BY 1)
SELECT category, coalesce(a.n, 0) AS n_new, coalesce(b.n, 0) AS n_old, CASE WHEN a.n IS NULL THEN 'lost' WHEN b.n IS NULL THEN 'new' WHEN a.n < 2 THEN 'thin' ELSE 'kept' END AS state FROM a FULL JOIN b USING (category)""")
def family_report(spark, sf_dir):
    d = t(spark, sf_dir, "documents").withColumn("category", F.col("lang"))
    return corpus.family_report(d.filter("doc_id % 2 = 0 and lang <> 'de'"), d.filter("doc_id % 2 = 1 and lang <> 'fr'"))


def _postings(spark, sf_dir):
    """Postings made of parts and documents: titles from part names, descriptions from texts, some rows broken."""
    p, d = t(spark, sf_dir, "part"), t(spark, sf_dir, "documents").select("doc_id", "text")
    j = p.join(d, F.col("p_partkey") == F.col("doc_id"))
    return j.select(
        (F.col("p_partkey") + 2).alias("csv_line"), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("p"), (F.col("p_partkey") % 100).cast("string"))).otherwise("").alias("job_id"),
        F.when(F.col("p_partkey") % 11 == 0, " ").otherwise(F.col("p_name")).alias("title"), F.col("p_brand").alias("company_name"), F.col("text").alias("description"),
        F.when(F.col("p_partkey") % 13 == 0, "many moons").when(F.col("p_partkey") % 2 == 0, "Senior").otherwise("3 years").alias("experience"),
    )


def _import(spark, sf_dir):
    return corpus.convert(_postings(spark, sf_dir), spark.createDataFrame(FAMILIES, "phrase string, family string"))


IMPORT = f"""f AS (SELECT DISTINCT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in FAMILIES)}) v(phrase, family)),
h AS (SELECT p_partkey, family, dense_rank() OVER (PARTITION BY p_partkey ORDER BY length(phrase) DESC) AS k FROM part JOIN f ON contains(' ' || lower(p_name) || ' ', ' ' || phrase || ' ')),
b AS (SELECT p_partkey, count(DISTINCT family) AS nb FROM h WHERE k = 1 GROUP BY 1),
r AS (SELECT p_partkey + 2 AS csv_line, CASE WHEN p_partkey % 5 = 0 THEN 'p' || (p_partkey % 100) ELSE '' END AS id, CASE WHEN p_partkey % 11 = 0 THEN 'blank title' WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 40 THEN 'description too short'
  WHEN nb IS NULL THEN 'unknown category' WHEN nb > 1 THEN 'ambiguous category' WHEN p_partkey % 13 = 0 THEN 'unparseable experience' END AS r0 FROM part JOIN documents ON doc_id = p_partkey LEFT JOIN b USING (p_partkey)),
c AS (SELECT *, coalesce(r0, CASE WHEN id <> '' AND row_number() OVER (PARTITION BY id, r0 IS NULL ORDER BY csv_line) > 1 THEN 'duplicate id' END) AS reject_reason FROM r)"""


@query(f"WITH {IMPORT}, n AS (SELECT *, row_number() OVER (PARTITION BY id = '' AND reject_reason IS NULL ORDER BY csv_line) AS k FROM c) SELECT csv_line, CASE WHEN id <> '' THEN id WHEN reject_reason IS NULL THEN 'job-' || lpad(k::VARCHAR, 5, '0') END AS id, reject_reason FROM n")
def import_postings(spark, sf_dir):
    return _import(spark, sf_dir).select("csv_line", "id", "reject_reason")


@query(f"WITH {IMPORT} SELECT reject_reason, count(*) AS n, array_to_string((list(csv_line ORDER BY csv_line))[1:3], ',') AS examples FROM c WHERE reject_reason IS NOT NULL GROUP BY 1")
def reject_summary(spark, sf_dir):
    return corpus.reject_summary(_import(spark, sf_dir)).withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


@query()
def scorecard_rules(spark, sf_dir):
    return scorecard.rules(t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", VERBS)


@query(rf"""WITH {BULLETS}, x AS (SELECT doc_id, text, b, len(b) AS n, len(list_filter(b, lambda x: trim(regexp_extract(lower(x), '^[a-z][a-z0-9+#.\-]*'), '.') IN ('led','built','made','wrote','ran','was','the','in','die','la','el'))) AS nv,
  len(list_filter(b, lambda x: len(regexp_extract_all(x, '\S+')) BETWEEN 10 AND 25)) AS nl, greatest(1, length(text) // 3000) AS pages FROM bl JOIN documents USING (doc_id)),
e AS (SELECT doc_id, CASE WHEN length(text) < 600 THEN 2.5 ELSE 5 END::DOUBLE AS readable, CASE WHEN n = 0 THEN 0 ELSE 10 * least(nv::DOUBLE / n / 0.7::DOUBLE, 1) END AS action_verbs,
  CASE WHEN pages <= 2 THEN 5 WHEN pages = 3 THEN 2.5 ELSE 0 END::DOUBLE + CASE WHEN n = 0 THEN 0 ELSE 5 * least(nl::DOUBLE / n / 0.6::DOUBLE, 1) END AS length FROM x)
SELECT doc_id, rule, round(round_even(earned, 2), 1) AS earned FROM (UNPIVOT e ON readable, action_verbs, length INTO NAME rule VALUE earned)""")
def scorecard_measured(spark, sf_dir):
    got = scorecard_rules(spark, sf_dir).filter(F.col("rule").isin("readable", "action_verbs", "length"))
    return got.select("doc_id", "rule", F.round("earned", 1).alias("earned"))


@query()
def scorecard_top_fixes(spark, sf_dir):
    return scorecard.report(scorecard_rules(spark, sf_dir), "doc_id")


@query()
def hash_embedding(spark, sf_dir):
    return t(spark, sf_dir, "benchmark").select("item_id", P.hash_embedding(T.content_tokens("text")).alias("embedding"))


@query()
def nfkc_clean(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", T.clean(P.nfkc("text")).alias("clean"))


@query()
def match_pairs(spark, sf_dir):
    onto = _onto(spark)
    docs = t(spark, sf_dir, "documents").select("doc_id", "text")
    jds = t(spark, sf_dir, "benchmark").select("item_id", "text")
    pairs = store.cut(bm25_topk(spark, sf_dir).select("doc_id", "item_id"))
    docs = store.cut(docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"))  # facts, phrases and vectors of the documents of a pair only
    ent = store.cut(facts.entities(docs, "doc_id").select("doc_id", "degree_level", "date_ranges"))
    full = store.cut(docs.join(ent, "doc_id").join(facts.experience_months(ent, "doc_id", "date_ranges", F.lit("2025-01-01").cast("date")), "doc_id"))
    has = store.cut(phrases.find(docs, "doc_id", onto).select("doc_id", "name"))
    wanted = store.cut(matching.wanted_weights(phrases.find(jds, "item_id", onto), "item_id"))
    return matching.match(full, "doc_id", jds, "item_id", pairs, has, wanted, lambda c: P.hash_embedding(T.content_tokens(c)))


@query()
def document_facts(spark, sf_dir):
    return facts.entities(t(spark, sf_dir, "documents"), "doc_id").drop("date_ranges")


@query("SELECT conv_id, turn, regexp_replace(trim(regexp_replace(lower(text), '[^a-z0-9+#.]+', ' ', 'g')), '\\s+', ' ', 'g') AS norm FROM conversations")
def normalised_text(spark, sf_dir):
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalise("text").alias("norm"))


@query(r"SELECT conv_id, turn FROM conversations WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 40")
def long_enough(spark, sf_dir):
    return t(spark, sf_dir, "conversations").filter(F.length(T.strip("text")) >= 40).select("conv_id", "turn")


@query("SELECT p_partkey, concat_ws(chr(10), p_name, p_name, p_type, p_brand) AS search_text FROM part")
def searchable_text(spark, sf_dir):
    from corpusloom.sources.postings import searchable

    return t(spark, sf_dir, "part").select("p_partkey", searchable("p_name", "p_type", "p_brand").alias("search_text"))


@query("""WITH e AS (SELECT user_id, event_id, exp(value / 100 - max(value / 100) OVER (PARTITION BY user_id)) AS x FROM events)
SELECT user_id, round(max(x) / sum(x), 6) AS top_share, count(*) AS n FROM e GROUP BY 1""")
def softmax_shares(spark, sf_dir):
    v = t(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.col("value") / 100)).alias("v"))
    s = roles.softmax(F.col("v"))
    return v.select("user_id", F.round(F.array_max(s), 6).alias("top_share"), F.size("v").cast("long").alias("n"))


@query("SELECT a / 10.0::DOUBLE AS w_a, b / 10.0::DOUBLE AS w_b, (10 - a - b) / 10.0::DOUBLE AS w_c FROM (SELECT unnest(range(0, 11)) AS a), (SELECT unnest(range(0, 11)) AS b) WHERE a + b <= 10")
def weight_grid(spark, sf_dir):
    return evaluate.weight_grid(spark, ["a", "b", "c"], 0.1)


@query(f"""WITH {WANTED}, s AS (SELECT *, weight / max(weight) OVER (PARTITION BY l_orderkey, l_suppkey) AS r FROM cov), g AS (SELECT l_orderkey, l_suppkey, CASE WHEN r >= 0.75 THEN 'critical' WHEN r >= 0.4 THEN 'important' ELSE 'nice_to_have' END AS severity FROM s WHERE NOT matched)
SELECT severity, count(*) AS n, CASE severity WHEN 'critical' THEN 1 WHEN 'important' THEN 2 ELSE 3 END AS place FROM g GROUP BY 1""")
def gaps_by_severity(spark, sf_dir):
    g = _coverage(spark, sf_dir).filter("not matched").groupBy("severity").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.when(F.col("severity") == "critical", 1).when(F.col("severity") == "important", 2).otherwise(3))


@query("""WITH s AS (SELECT doc_id, text, instr(text, ' ') AS p FROM documents WHERE instr(text, ' ') > 0 AND length(text) >= instr(text, ' ') + 4)
SELECT doc_id, 0 AS at, substr(text, 1, p) AS piece, NULL AS label FROM s UNION ALL SELECT doc_id, p, substr(text, p + 1, 4), 'mark' FROM s
UNION ALL SELECT doc_id, p + 4, substr(text, p + 5), NULL FROM s WHERE length(text) > p + 4 UNION ALL SELECT doc_id, 0, text, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s) AND text <> ''""")
def highlight_pieces(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    p = F.instr("text", " ")
    spans = d.filter(p > 0).select("doc_id", p.alias("start"), (p + 4).alias("end"), F.lit("mark").alias("label"))
    return lines.highlight(d, "doc_id", spans)


def _blocks(spark, sf_dir):
    """Boxes on pages, made of order lines: a document for each supplier, seven pages each."""
    li = t(spark, sf_dir, "lineitem")
    x0, y0 = (F.col("l_partkey") % 40) * 40.0, (F.col("l_orderkey") % 60) * 12.0
    return li.select(F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity")).alias("x1"), (y0 + 10).alias("y1"), F.col("l_returnflag").alias("text"))


@query("""WITH b AS (SELECT l_suppkey AS doc, l_linenumber AS page, (l_partkey % 40) * 40.0::DOUBLE AS x0, (l_partkey % 40) * 40.0::DOUBLE + l_quantity AS x1 FROM lineitem),
r AS (SELECT *, max(x1) OVER (PARTITION BY doc, page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM b) SELECT doc, page, (x0 + m) / 2 AS x, x0 - m AS width FROM r WHERE x0 - m >= 15""")
def page_gutters(spark, sf_dir):
    from corpusloom.operators import layout

    return layout.gutters(_blocks(spark, sf_dir), ["doc", "page"])


@query()
def layout_columns(spark, sf_dir):
    from corpusloom.operators import layout

    return layout.columns_per_page(layout.columns(_blocks(spark, sf_dir), "doc"), "doc")
