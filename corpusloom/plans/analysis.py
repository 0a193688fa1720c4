"""Analysis of documents end to end: sections, facts, phrases, role, scorecard. Steps that several others use are computed once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import facts, lines, phrases, roles, scorecard
from corpusloom.operators.store import cut


@dataclass(frozen=True)
class Lexicons:
    """Relations that the plan looks things up in: headings (canonical, variant), ontology (key, n_tokens, name, category), profiles (role, name, weight), verbs."""

    headings: DataFrame
    ontology: DataFrame
    profiles: DataFrame
    verbs: list[str]


def section_text(names: list[str]) -> Column:
    """An aggregate of a text's sections: the bodies of those named, in order; null if there are none."""
    bodies = F.array_sort(F.collect_list(F.when(F.col("name").isin(*names) & (F.col("body") != ""), F.struct("ord", "body"))))
    return F.when(F.size(bodies) > 0, F.array_join(F.transform(bodies, lambda x: x["body"]), "\n"))


def analyse(docs: DataFrame, id_col: str, lex: Lexicons, as_of: Column | None = None) -> DataFrame:
    """One row a document: facts, sections, skills, role with confidence and alternatives, score, band, top_fixes.

    docs: id, text and, if known, columns_per_page, has_tables, has_text_layer, n_pages.
    """
    docs = cut(docs.repartition(id_col))  # by id, so that a compact table fills all tasks and no later step by id moves texts
    sec = cut(lines.sections(docs, id_col, lex.headings).select(id_col, "ord", "name", "body", "start", "end"))
    names = F.collect_set(F.when(F.col("body") != "", F.col("name")))
    parts = sec.groupBy(id_col).agg(
        F.when(F.size(names) > 0, names).alias("sections"), F.max(F.when(F.col("ord") == 0, F.col("body"))).alias("_head"),
        section_text(["EDUCATION"]).alias("_study"), section_text(["EXPERIENCE", "PROJECTS"]).alias("_work"),
    )
    df = cut(docs.join(parts, id_col, "left"))
    ent = facts.entities(df, id_col, "text", "_head", "_study")
    dated = df.select(id_col, facts.date_ranges(F.coalesce("_work", "text")).alias("_r"))
    months = facts.experience_months(dated, id_col, "_r", as_of)
    hits = cut(phrases.find(docs, id_col, lex.ontology, fuzzy_spans=sec.filter("name = 'SKILLS'").select(id_col, "start", "end")))
    skills = phrases.by_category(hits, id_col).groupBy(id_col).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("skills"))
    role = roles.top_with_alternatives(roles.predict(hits.select(id_col, "name"), id_col, lex.profiles, "role", "name"), id_col, "role")
    kw = roles.keywords(lex.profiles, "role", "name").groupBy("role").agg(F.collect_set("name").alias("role_keywords"))
    full = df.drop("_head", "_study", "_work").join(ent, id_col).join(months, id_col).join(skills, id_col, "left").join(role, id_col, "left").join(kw, "role", "left")
    full = cut(full.withColumn("link", F.coalesce("linkedin", "github", "portfolio")))
    rows = scorecard.rules(full, id_col, lex.verbs)
    card = scorecard.report(rows, id_col)
    return full.drop("text", "link", "role_keywords").join(card, id_col)
