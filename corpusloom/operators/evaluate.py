"""Ranking evaluation: pairwise accuracy, signal diagnostics, weight sweep, paired bootstrap, label files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corpus_pairs(rows: DataFrame, id_col: str, label: str) -> DataFrame:
    """query, candidate, relevant for all pairs of different rows of a judged set (quadratic by definition: judged sets are small)."""
    a, b = rows.select(F.col(id_col).alias("query"), F.col(label).alias("_l")), rows.select(F.col(id_col).alias("candidate"), F.col(label).alias("_m"))
    return a.join(b, F.col("query") != F.col("candidate")).select("query", "candidate", F.col("_l").eqNullSafe(F.col("_m")).alias("relevant"))


def pair_wins(scored: DataFrame, score: str | Column, query: str = "query") -> DataFrame:
    """query, accuracy: the share of its (relevant, irrelevant) pairs in which the relevant one scores higher, ties as one half. Queries of one kind are left out.

    Counted by rank, not by pairing: of n scores the relevant ones' mean ranks give the wins in one sort of the query.
    """
    from pyspark.sql import Window as W

    col = F.col(score) if isinstance(score, str) else score
    by = W.partitionBy(query).orderBy("_s")
    df = scored.select(query, "relevant", col.alias("_s"))
    df = df.withColumn("_rank", F.rank().over(by)).withColumn("_same", F.count("*").over(W.partitionBy(query, "_s")))
    g = df.groupBy(query).agg(F.count_if(F.col("relevant")).alias("p"), F.count_if(~F.col("relevant")).alias("q"), F.sum(F.when(F.col("relevant"), F.col("_rank") + (F.col("_same") - 1) / 2.0)).alias("r"))
    return g.filter("p > 0 and q > 0").select(query, ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * F.col("q"))).alias("accuracy"))


def pairwise_accuracy(scored: DataFrame, score: str | Column, query: str = "query") -> DataFrame:
    """One row: accuracy, the mean over queries; n_queries."""
    return pair_wins(scored, score, query).agg(F.avg("accuracy").alias("accuracy"), F.count("*").alias("n_queries"))


def diagnostics(scored: DataFrame, signals: list[str], query: str = "query") -> DataFrame:
    """signal, accuracy alone, mean spread (max - min) within queries."""
    out = None
    for s in signals:
        spread = scored.groupBy(query).agg((F.max(s) - F.min(s)).alias("_d")).agg(F.avg("_d").alias("spread"))
        one = pairwise_accuracy(scored, s, query).crossJoin(spread).select(F.lit(s).alias("signal"), "accuracy", "spread")
        out = one if out is None else out.unionByName(one)
    return out


def weight_grid(spark, signals: list[str], step: float) -> DataFrame:
    """All weights that are multiples of step and add up to 1 (step must divide 1)."""
    n = round(1 / step)
    if abs(n * step - 1) > 1e-9:
        raise ValueError("step must divide 1")
    df = spark.range(1).select(F.lit(n).alias("_left"))
    for s in signals[:-1]:
        df = df.withColumn(f"_{s}", F.explode(F.sequence(F.lit(0), F.col("_left")))).withColumn("_left", F.col("_left") - F.col(f"_{s}"))
    return df.select(*((F.col(f"_{s}") / n).alias(f"w_{s}") for s in signals[:-1]), (F.col("_left") / n).alias(f"w_{signals[-1]}"))


def sweep(scored: DataFrame, signals: list[str], grid: DataFrame, query: str = "query") -> DataFrame:
    """weights, accuracy, rank (ties share it). The signals are computed once; every weighting is a dot product over them."""
    from pyspark.sql import Window as W

    names = [f"w_{s}" for s in signals]
    key = grid.withColumn("_g", F.format_string("|".join(["%.6f"] * len(names)), *names))
    total = sum((F.col(w) * F.col(s) for w, s in zip(names, signals, strict=True)), F.lit(0.0))
    # every judged row with every weighting is what a sweep is; the grid is bounded by its step
    rows = scored.crossJoin(F.broadcast(key)).withColumn("_t", F.round(total, 9)).withColumn("_q", F.struct("_g", query))
    acc = pair_wins(rows, "_t", "_q").groupBy(F.col("_q._g").alias("_g")).agg(F.avg("accuracy").alias("accuracy"))
    out = key.join(acc, "_g").withColumn("accuracy", F.round("accuracy", 9))
    return out.select(*names, "accuracy", F.rank().over(W.orderBy(F.col("accuracy").desc())).alias("rank"))


def bootstrap(spark, a: DataFrame, b: DataFrame, query: str = "query", rounds: int = 1000, seed: int = 0) -> DataFrame:
    """One row: win_rate, the share of seeded resamples of the queries in which a's mean accuracy beats b's; n_queries. Per-query accuracies come from pair_wins().

    The queries are numbered by name; draw i of a round takes the query that the MD5 of seed, round and draw picks, so that any engine repeats it. Rounds are
    dealt out over the tasks and meet the numbered differences by a join.
    """
    from pyspark.sql import Window as W

    both = a.select(query, F.col("accuracy").alias("x")).join(b.select(query, F.col("accuracy").alias("y")), query)
    diff = both.select((F.row_number().over(W.orderBy(query)) - 1).alias("_i"), F.round(F.col("x") - F.col("y"), 12).alias("d"))  # one number for each judged query
    n = diff.agg(F.count("*").alias("n_queries"))
    draws = spark.range(rounds).crossJoin(F.broadcast(n)).filter("n_queries > 0").select("id", "n_queries", F.explode(F.sequence(F.lit(1).cast("long"), "n_queries")).alias("k"))
    text = F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string"), F.col("k").cast("string"))
    pick = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.col("n_queries")
    won = draws.select("id", pick.alias("_i")).join(diff, "_i").groupBy("id").agg((F.round(F.sum("d"), 9) > 0).alias("won"))
    return won.agg(F.count_if(F.col("won")).alias("_w")).crossJoin(n).select((F.col("_w") / rounds).alias("win_rate"), "n_queries")


def unknown_labels(labels: DataFrame, corpus: DataFrame, id_col: str) -> DataFrame:
    """query, id, kind of labels (query, relevant array, irrelevant array) that name no row of the corpus."""
    flat = labels.select("query", F.explode("relevant").alias(id_col), F.lit("relevant").alias("kind")).unionByName(labels.select("query", F.explode("irrelevant").alias(id_col), F.lit("irrelevant").alias("kind")))
    return flat.join(corpus.select(id_col), id_col, "left_anti")


def read_labels(spark, path: str, corpus: DataFrame, id_col: str, closed_world: bool = False) -> DataFrame:
    """query, candidate, relevant from files of judgements: {queries: [{name, resume, relevant: [ids], irrelevant: [ids]}]} or the bare list.

    A query is named by `name`, else by its resume's file name. An id that the corpus lacks raises ValueError. With closed_world every row of the corpus that a query
    doesn't name as relevant counts as irrelevant; without it, what nobody judged takes no part.
    """
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$.queries", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    get = lambda f, t="string": F.try_variant_get("j", f"$.{f}", t)
    none = F.array().cast("array<string>")
    ids = lambda f: F.coalesce(get(f, "array<string>"), none)
    name = F.coalesce(F.nullif(get("name"), F.lit("")), F.regexp_extract(get("resume"), r"([^/\\]*)$", 1))
    labels = raw.select(F.explode(listed).alias("j")).select(name.alias("query"), ids("relevant").alias("relevant"), ids("irrelevant").alias("irrelevant"))
    lost = [f"{r['query']}: {r[id_col]}" for r in unknown_labels(labels, corpus, id_col).limit(20).collect()]
    if lost:
        raise ValueError(f"labels name ids that the corpus lacks: {', '.join(sorted(lost))}")
    yes = labels.select("query", F.explode("relevant").alias("candidate"), F.lit(True).alias("relevant")).distinct()
    if closed_world:  # a stated, hand-made set of queries against all rows
        all_ = labels.select("query").distinct().crossJoin(corpus.select(F.col(id_col).cast("string").alias("candidate")))
        no = all_.join(yes, ["query", "candidate"], "left_anti").withColumn("relevant", F.lit(False))
    else:
        no = labels.select("query", F.explode("irrelevant").alias("candidate"), F.lit(False).alias("relevant")).distinct()
    return yes.unionByName(no)


@dataclass(frozen=True)
class Tuning:
    """What a sweep found. ranking: weights, accuracy, rank; diagnostics: signal, accuracy, spread; dropped: queries without a pair; tied: least and most of each weight among the best."""

    ranking: DataFrame
    diagnostics: DataFrame
    dropped: DataFrame
    best: dict[str, float]
    best_accuracy: float
    current_accuracy: float
    tied: dict[str, tuple[float, float]]
    win_rate: float | None


def tune(spark, scored: DataFrame, signals: list[str], current: dict[str, float], step: float = 0.05, query: str = "query", rounds: int = 1000) -> Tuning:
    """Sweeps all weightings of the signals over judged rows (query, relevant, a column for each signal) and compares the best with the current one. Changes nothing.

    Among ties the first by weights stands for the best, and `tied` gives their ranges. win_rate is None unless the best beats the current weighting.
    Without a query that has both kinds of rows there is nothing to compare: ValueError.
    """
    kinds = scored.groupBy(query).agg(F.count_if(F.col("relevant")).alias("p"), F.count_if(~F.col("relevant")).alias("q"))
    dropped = kinds.filter("p = 0 or q = 0").select(query)
    if kinds.filter("p > 0 and q > 0").isEmpty():
        raise ValueError("no query has both a relevant and an irrelevant row")
    ranking = sweep(scored, signals, weight_grid(spark, signals, step), query)
    names = [f"w_{s}" for s in signals]
    top = ranking.filter("rank = 1")
    ends = top.agg(F.max("accuracy").alias("a"), F.min(F.struct(*names)).alias("w"), *(F.min(n).alias(f"lo_{n}") for n in names), *(F.max(n).alias(f"hi_{n}") for n in names)).first()
    best = {s: ends["w"][f"w_{s}"] for s in signals}
    total = lambda w: F.round(sum((F.lit(float(w[s])) * F.col(s) for s in signals), F.lit(0.0)), 9)
    mine = pair_wins(scored, total(best), query)
    theirs = pair_wins(scored, total(current), query)
    now = theirs.agg(F.round(F.avg("accuracy"), 9).alias("a")).first()["a"]
    win = bootstrap(spark, mine, theirs, query, rounds).first()["win_rate"] if ends["a"] > now else None
    return Tuning(ranking, diagnostics(scored, signals, query), dropped, best, ends["a"], now, {s: (ends[f"lo_w_{s}"], ends[f"hi_w_{s}"]) for s in signals}, win)
