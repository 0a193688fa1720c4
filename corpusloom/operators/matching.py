"""Matching documents against requirement texts: weighted recall, ranked gaps, four-part score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T

from . import facts, ir

CRITICAL, IMPORTANT = 0.75, 0.40
SHOWN = 8  # missing skills of a recommendation
WEIGHTS = {"semantic": 0.35, "skill": 0.35, "lexical": 0.15, "fit": 0.15}


def check_weights(w: dict[str, float]) -> dict[str, float]:
    if set(w) != set(WEIGHTS) or abs(sum(w.values()) - 1) > 1e-6 or min(w.values()) < 0:
        raise ValueError(f"weights must be {sorted(WEIGHTS)}, not negative, and add up to 1")
    return w


def wanted_weights(hits: DataFrame, id_col: str, name: str = "name", position: str = "start") -> DataFrame:
    """id, name, weight (1 + ln of its occurrences, over the text's largest), at (first place)."""
    raw = hits.groupBy(id_col, name).agg((1 + F.log(F.count("*"))).alias("_w"), F.min(position).alias("at"))
    return raw.withColumn("weight", F.col("_w") / F.max("_w").over(W.partitionBy(id_col))).drop("_w")


def severity(ratio: Column) -> Column:
    return F.when(ratio >= CRITICAL, "critical").when(ratio >= IMPORTANT, "important").otherwise("nice_to_have")


def coverage(wanted: DataFrame, want_id: str, has: DataFrame, has_id: str, pairs: DataFrame, name: str = "name") -> DataFrame:
    """want_id, has_id, name, weight, matched, severity (of the missing ones), for the stated pairs."""
    w = wanted.join(pairs, want_id)
    own = has.select(has_id, name).distinct().withColumn("_m", F.lit(True))
    got = w.join(own, [has_id, name], "left").withColumn("matched", F.coalesce("_m", F.lit(False))).drop("_m")
    peak = F.max("weight").over(W.partitionBy(want_id, has_id))
    return got.withColumn("severity", F.when(~F.col("matched"), severity(F.col("weight") / peak)))


def weighted_recall(cov: DataFrame, want_id: str, has_id: str) -> DataFrame:
    """want_id, has_id, skill: matched weight over all weight."""
    return cov.groupBy(want_id, has_id).agg(T.clamp(F.sum(F.when(F.col("matched"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("skill"))


def gaps(cov: DataFrame, want_id: str, has_id: str, most: int | None = None) -> DataFrame:
    """want_id, has_id, missing: array of (name, weight, severity) by weight, then first place; the first `most` of them, if given (SHOWN for a list of recommendations)."""
    miss = cov.filter(~F.col("matched"))
    item = F.struct((-F.col("weight")).alias("o"), "at", "name", F.round("weight", 3).alias("weight"), "severity")
    ordered = F.array_sort(F.collect_list(item))
    ordered = ordered if most is None else F.slice(ordered, 1, most)
    return miss.groupBy(want_id, has_id).agg(F.transform(ordered, lambda x: F.struct(x["name"].alias("name"), x["weight"].alias("weight"), x["severity"].alias("severity"))).alias("missing"))


def semantic(docs: DataFrame, id_col: str, jds: DataFrame, jd_id: str, pairs: DataFrame, embed, text_col: str = "text") -> DataFrame:
    """jd_id, id, semantic: per piece of the posting the best cosine to a piece of the document, averaged."""
    a = docs.select(id_col, F.posexplode(T.chunks(text_col)).alias("_i", "_x")).select(id_col, embed(F.col("_x")).alias("_a"))
    b = jds.select(jd_id, F.posexplode(T.chunks(text_col)).alias("piece", "_x")).select(jd_id, "piece", embed(F.col("_x")).alias("_b"))
    best = pairs.join(b, jd_id).join(a, id_col).groupBy(jd_id, id_col, "piece").agg(F.max(ir.unit_cosine(F.col("_a"), F.col("_b"))).alias("_m"))
    return best.groupBy(jd_id, id_col).agg(T.clamp(F.avg("_m")).alias("semantic"))


def match(docs: DataFrame, id_col: str, jds: DataFrame, jd_id: str, pairs: DataFrame, has: DataFrame, wanted: DataFrame, embed, weights: dict[str, float] | None = None) -> DataFrame:
    """jd_id, id, score, verdict, semantic, skill, lexical, fit, matched, missing, extra, notes for the stated pairs.

    docs: id, text, experience_months, degree_level; has: id, name; wanted: jd_id, name, weight, at. A posting without known skills has skill 0.5.
    """
    w = check_weights(weights or WEIGHTS)
    cov = coverage(wanted, jd_id, has, id_col, pairs)
    sem = semantic(docs, id_col, jds, jd_id, pairs, embed)
    lex = ir.lexical_cosine(docs.join(pairs.select(id_col).distinct(), id_col, "left_semi"), id_col, jds, jd_id, pairs=pairs)
    both = pairs.join(docs.select(id_col, "experience_months", "degree_level"), id_col).join(jds.select(jd_id, F.col("text").alias("_jd")), jd_id)
    both = both.withColumn("fit", facts.fit_score(F.col("experience_months"), F.col("degree_level"), F.col("_jd")))
    years = facts.required_years(F.col("_jd"))
    have = F.bround(F.col("experience_months") / 12.0, 1)
    both = both.withColumn("_n1", F.when(years > have, F.format_string("asks for %s years, shows %s", years.cast("string"), have.cast("string"))))
    both = both.withColumn("_n2", F.when((facts.required_degree_level(F.col("_jd")) > 0) & (F.col("degree_level") == 0), F.lit("no degree detected")))
    key = [jd_id, id_col]
    named = cov.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("matched"), F.struct((-F.col("weight")).alias("o"), "at", "name")))), lambda x: x["name"]).alias("matched"))
    extra = pairs.join(has.select(id_col, "name").distinct(), id_col).join(wanted.select(jd_id, "name"), [jd_id, "name"], "left_anti").groupBy(*key).agg(F.array_sort(F.collect_list("name")).alias("extra"))
    out = both
    for part in (sem, weighted_recall(cov, jd_id, id_col), lex, gaps(cov, jd_id, id_col), named, extra):
        out = out.join(part, key, "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("_known", F.col("skill").isNotNull()).fillna({"semantic": 0.0, "lexical": 0.0, "skill": 0.5})
    total = sum((F.lit(v) * F.col(k) for k, v in w.items()), F.lit(0.0))
    out = out.withColumn("score", T.pct(total)).withColumn("verdict", T.verdict(F.col("score")))
    return out.select(
        *key, "score", "verdict", *(F.round(k, 4).alias(k) for k in WEIGHTS), F.coalesce("matched", none).alias("matched"), "missing", F.coalesce("extra", none).alias("extra"),
        F.array_compact(F.array("_n1", "_n2", F.when(~F.col("_known"), F.lit("no known skills in the posting, skill overlap is neutral")))).alias("notes"),
    )


def why(names: Column) -> Column:
    """Names the first three matching skills and counts the rest."""
    more = F.size(names) - 3
    tail = F.when(more > 0, F.format_string(" and %d more", more)).otherwise("")
    return F.when(F.size(names) > 0, F.concat(F.lit("Matches your "), F.array_join(F.slice(names, 1, 3), ", "), tail, F.lit("."))).otherwise("Similar to the overall shape of your experience.")
