"""Mixing sources to target weights by Pareto order sampling (native: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import materialise, skew_join

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096


def words(text: str) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_copies: float = 2.0) -> DataFrame:
    """Per source: source, source_size, target.

    Sources in code point order (null last) weigh `weights`, repeating, and share share * total size. No target
    is above max_copies times its source's size; the excess is reshared by weight. With sources by rising
    cap/weight, the level of source j is (budget left by those before it) / (weights from it on); the levels rise
    while sources hit their caps and fall afterwards, so the water level is their maximum.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("_k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_k") % len(weights) + 1).cast("int")))
    per = per.withColumn("_cap", max_copies * F.col("source_size"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy(F.col("_cap") / F.col("_w"), "_k").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("_t", F.sum("source_size").over(everything)).withColumn("_ws", F.sum("_w").over(everything))
    level = (F.lit(share) * F.col("_t") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.col("_ws") - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    per = per.withColumn("_level", level).withColumn("_top", F.max("_level").over(everything))
    return per.select("source", "source_size", F.round(F.least(F.col("_w") * F.col("_top"), F.col("_cap")), 6).alias("target"))


#: Per-source tables of up to this many rows (about 100 bytes each) go to every task whole; of larger ones only the rows of hot sources do.
MAX_SENT = 100_000


def mix(docs: DataFrame, weight: Column | None = None, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_copies: int = 2, seed: str = "mix", keep: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, source, text): doc_id, source, size, source_size, target, copies, taken; with keep, all columns of docs and the last five.

    Expected copies of a document are target * g / sum(g * size) of its source, at most max_copies; g is `weight` (1 if
    not given, then expected copies differ between sources only). Whole copies are certain. For the fraction p left, the
    document's rank is its random odds u/(1-u) over its inclusion odds p/(1-p) (Pareto sampling); documents are taken in rank
    order up to the words that remain of the target, to the nearest document. u comes from md5(seed:doc_id), so reruns agree.

    The cut needs no sort of a source: ranks fall into 4096 bins, the bin where the running sum crosses the target is
    split into 4096 again, and only what shares its sub-bin is sorted. Per-source tables (target, cut) have a row a source and are written once; rows meet
    them by broadcast, so a source may hold all rows and no text is shuffled. Sources are numbered in one task, a row each.

    Null or empty text: size 0, never more than a row with taken 0. Null source: a source of its own, last. Null doc_id: hashed
    as an empty id. Repeated rows: each is a document and each row is decided once; rows that share a doc_id and a size rank by a hash of the text
    (with keep), rows alike in every way as ties, any one of which may be the one at the cut. Empty table: no rows. Columns of docs named like
    those added give way to them, others may have any name.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("size", "source_size", "target", "copies", "taken")))
    slim = materialise(_rows(docs.select("doc_id", F.col("source").cast("string").alias("source"), *([] if weight is None else [weight.alias("w")]), words("text").alias("n")), ["doc_id", "source"], F.col("n"), None if weight is None else F.col("w"), seed))
    total = slim.count()
    goal = targets(slim.select(F.col("c1").alias("source"), F.col("_size").alias("size")), weights, share, float(max_copies))
    mass = slim.groupBy("_key").agg(F.sum(F.col("_g") * F.col("_size")).alias("_mass"), F.count("*").alias("_rows"))
    goal = materialise(goal.withColumn("_key", _key("source")).drop("source").join(mass, "_key"))
    small = goal.count() <= MAX_SENT

    def meet(rows: DataFrame, table: DataFrame) -> DataFrame:
        """rows with the columns of their source's row in table, and with _whole, _p, _q, _bin and _sub."""
        d = rows.join(F.broadcast(table), "_key") if small else skew_join(rows, table, ["_key"], "_rows", total)
        expected = F.coalesce(F.least(F.lit(float(max_copies)), F.try_divide(F.col("target") * F.col("_g"), F.col("_mass"))), F.lit(0.0))
        d = d.withColumn("_e", expected).withColumn("_whole", F.floor("_e")).withColumn("_p", F.col("_e") - F.col("_whole"))
        odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
        d = d.withColumn("_q", F.when(F.col("_p") > 0, odds))
        d = d.withColumn("_fine", F.when(F.col("_p") > 0, F.least(F.floor(F.col("_q") / (1 + F.col("_q")) * (BINS * BINS)), F.lit(BINS * BINS - 1))))
        return d.withColumn("_bin", F.floor(F.col("_fine") / BINS)).withColumn("_sub", F.col("_fine") % BINS)

    df = meet(slim, goal)
    rest = df.groupBy("_key").agg((F.max("target") - F.sum(F.col("_whole") * F.col("_size"))).alias("_rest"))
    cut1 = materialise(_crossing(df.filter("_p > 0").groupBy("_key", "_bin").agg(F.sum("_size").alias("_n")), rest, "_bin"))
    goal = materialise(goal.join(cut1.select("_key", F.col("_bin").alias("_cut1"), "_rest"), "_key", "left"))
    fine = meet(slim, goal).filter("_p > 0 and _bin = _cut1").groupBy("_key", "_sub").agg(F.sum("_size").alias("_n"))
    cut2 = _crossing(fine, goal.select("_key", "_rest"), "_sub").select("_key", F.col("_sub").alias("_cut2"), F.col("_rest").alias("_rest2"))
    plan = materialise(goal.drop("_rest").join(cut2, "_key", "left"))

    rows, names = (slim, ["doc_id", "source"]) if not keep else (_rows(docs, docs.columns, words("text"), weight, seed), docs.columns)
    df = meet(rows, plan)
    at = F.coalesce((F.col("_bin") == F.col("_cut1")) & (F.col("_sub") == F.col("_cut2")), F.lit(False))
    below = F.coalesce((F.col("_p") > 0) & (F.col("_cut1").isNull() | (F.col("_bin") < F.col("_cut1")) | ((F.col("_bin") == F.col("_cut1")) & (F.col("_cut2").isNull() | (F.col("_sub") < F.col("_cut2"))))), F.lit(False))
    clear = df.filter(~at).withColumn("_more", below.cast("int"))
    run = F.sum("_size").over(W.partitionBy("_key").orderBy("_q", "_id", "_size", "_tie").rowsBetween(W.unboundedPreceding, 0))
    close = df.filter(at).withColumn("_more", (run - F.col("_size") / 2 <= F.col("_rest2")).cast("int"))
    copies = F.col("_whole").cast("long") + F.col("_more")
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    added = [F.col("_size").alias("size"), F.col("source_size"), F.col("target"), copies.cast("int").alias("copies"), (F.col("_size") * copies).alias("taken")]
    return clear.unionByName(close).select(*own, *added)


def _key(source: str) -> Column:
    """A source's name as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _rows(docs: DataFrame, columns: list[str], size: Column, weight: Column | None, seed: str) -> DataFrame:
    """columns as c0, c1 and so on, so that none clashes, and what a row is decided by."""
    hexes = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13)
    return docs.select(
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)),
        F.col("doc_id").alias("_id"),
        _key("source").alias("_key"),
        size.alias("_size"),
        (weight if weight is not None else F.lit(1.0)).cast("double").alias("_g"),
        ((F.conv(hexes, 16, 10).cast("double") + 0.5) / float(2**52)).alias("_u"),
        (F.xxhash64("text") if "text" in columns else F.lit(0).cast("long")).alias("_tie"),
    )


def _crossing(bins: DataFrame, rest: DataFrame, key: str) -> DataFrame:
    """Per source the first bin whose running sum reaches what is wanted, and what is still wanted before it. A source has BINS rows at most."""
    w = W.partitionBy("_key").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    got = bins.withColumn("_run", F.sum("_n").over(w)).join(rest, "_key").filter("_run >= _rest")
    first = got.groupBy("_key").agg(F.min(F.struct(key, (F.col("_rest") - (F.col("_run") - F.col("_n"))).alias("_rest"))).alias("_f"))
    return first.select("_key", f"_f.{key}", "_f._rest")
