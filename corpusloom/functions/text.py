"""Column builders for text: cleaning, tokens, lines, bullets, chunks and small formatters. No Python runs here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[a-z][a-z0-9+#.\-]*"
KEY_TOKEN = r"[A-Za-z0-9+#.]+"
SENTENCE_END = r"(?<=[.!?])\s+|\n+"
BULLET = r"^\s*(?:[*\-•●▪·o>]|\d+[.)])\s+"

# fixed values: the words that content tokens leave out
STOPWORDS = tuple("""
a an and are as at be been being by for from had has have he her his i if in
into is it its of on or our ours she that the their them there they this to
was we were what when where which while who will with you your
""".split())

# fixed values: typographic characters and their plain forms
TYPOGRAPHY = (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("•", "*"), ("●", "*"), ("▪", "*"), ("·", "*"), ("→", "->"), (" ", " "), ("ﬁ", "fi"), ("ﬂ", "fl"))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Removes whitespace of every kind from both ends; Spark's trim() takes spaces only."""
    return F.regexp_replace(col(c), r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def clean(c: Column | str) -> Column:
    """Plain typography, LF line ends, single blanks, at most one empty line in a row. Apply python_udfs.nfkc() first for compatibility forms."""
    out = F.coalesce(col(c), F.lit(""))
    for bad, good in TYPOGRAPHY:
        out = F.replace(out, F.lit(bad), F.lit(good))
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t\r\f\x0B]+", " ")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def normalise(c: Column | str) -> Column:
    """Lower case; anything outside [a-z0-9+#.] separates words, which end up single-spaced."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"[^a-z0-9+#.]+", " "))


def tokens(c: Column | str) -> Column:
    """Word tokens of the lower-cased text. Dots and hyphens at a token's end stay; numbers alone are no tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(TOKEN), F.lit(0))


def content_tokens(c: Column | str, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    return F.filter(tokens(c), lambda t: (F.length(t) > 1) & ~t.isin(*stopwords))  # a hash set, not a scan of the list for each token


def phrase_key(c: Column | str) -> Column:
    """Dictionary key: tokens of letters, digits, +, # and dots, lower-cased, dots at their ends dropped, joined by a space."""
    parts = F.transform(F.regexp_extract_all(col(c), F.lit(KEY_TOKEN), F.lit(0)), lambda t: F.rtrim(F.lower(t), F.lit(".")))
    return F.array_join(F.filter(parts, lambda t: t != ""), " ")


def lines(c: Column | str) -> Column:
    """Non-blank lines, stripped."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), "\n"), strip), lambda x: x != "")


def is_bullet(c: Column | str) -> Column:
    return col(c).rlike(BULLET)


def strip_bullet(c: Column | str) -> Column:
    return strip(F.regexp_replace(col(c), BULLET, ""))


def bullets(c: Column | str) -> Column:
    """Marked lines without their marks; if there are none, the lines of 40 characters or more."""
    all_lines = lines(c)
    marked = F.filter(F.transform(F.filter(all_lines, is_bullet), strip_bullet), lambda x: x != "")
    return F.when(F.exists(all_lines, is_bullet), marked).otherwise(F.filter(all_lines, lambda x: F.length(x) >= 40))


def first_word(c: Column | str) -> Column:
    """The leading token after the bullet mark, without dots at its ends; empty if the line doesn't start with a letter."""
    return F.btrim(F.regexp_extract(F.lower(strip_bullet(c)), r"^[a-z][a-z0-9+#.\-]*", 0), F.lit("."))


def chunks(c: Column | str, least: int = 25, most: int = 480) -> Column:
    """Sentences and lines of `least` characters or more, cut at `most`; the whole text if none is long enough."""
    text = strip(F.coalesce(col(c), F.lit("")))
    parts = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), SENTENCE_END), lambda x: F.btrim(x, F.lit(" \t-*•>"))), lambda x: F.length(x) >= least)
    cut = F.transform(parts, lambda x: F.substring(x, 1, most))
    return F.when(text == "", F.array().cast("array<string>")).when(F.size(cut) == 0, F.array(F.substring(text, 1, most))).otherwise(cut)


def word_count(c: Column | str) -> Column:
    """Words between whitespace of any kind."""
    return F.size(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"\S+"), F.lit(0)))


def plural(n: Column, noun: str, many: str | None = None) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, F.lit(noun)).otherwise(F.lit(many or noun + "s")))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def pct(c: Column) -> Column:
    """0 to 100, halves to even."""
    return F.bround(clamp(c) * 100, 0).cast("int")


def verdict(score: Column) -> Column:
    return F.when(score >= 75, "strong").when(score >= 55, "promising").when(score >= 35, "stretch").otherwise("weak")


def band(score: Column) -> Column:
    return F.when(score >= 85, "excellent").when(score >= 70, "good").when(score >= 50, "needs_work").otherwise("poor")


def grade(earned: Column, points: Column) -> Column:
    ratio = F.when(points > 0, earned / points).otherwise(1.0)
    return F.when(ratio >= 0.85, "pass").when(ratio >= 0.45, "warn").otherwise("fail")


def fold_header(name: str) -> str:
    """Column name for alias lookup: lower case, other characters become one underscore."""
    import re

    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def traffic(score: Column) -> Column:
    """Traffic light of a score of 0 to 100."""
    return F.when(score >= 75, "good").when(score >= 50, "warn").otherwise("bad")


def months_label(months: Column) -> Column:
    """Years and months in words."""
    years, rest = F.floor(months / 12), months % 12
    words = F.concat_ws(" ", F.when(years > 0, plural(years, "year")), F.when(rest > 0, plural(rest, "month")))
    return F.when(months <= 0, "None recorded").otherwise(words)


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio (1 to 21) of two colours given as #rrggbb, by relative luminance."""

    def luminance(c: Column) -> Column:
        parts = [F.conv(F.substring(c, i, 2), 16, 10).cast("double") / 255.0 for i in (2, 4, 6)]
        linear = [F.when(p <= 0.03928, p / 12.92).otherwise(F.pow((p + 0.055) / 1.055, 2.4)) for p in parts]
        return 0.2126 * linear[0] + 0.7152 * linear[1] + 0.0722 * linear[2]

    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)
