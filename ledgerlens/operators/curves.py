"""Curves of a score (y, score) as tables of points. A score is counted by distinct value first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.stats import bin_of, bin_of_few
from ledgerlens.operators.binning import inner_quantiles
from ledgerlens.operators.evaluate import value_counts
from ledgerlens.operators.ranks import running
from ledgerlens.session import written


def _counts(df: DataFrame, score: str | Column, label: str) -> DataFrame:
    y, score = F.col(label) > 0, F.col(score) if isinstance(score, str) else score
    return written(df.where(score.isNotNull()).groupBy(score.cast("double").alias("score")).agg(F.count(F.when(y, 1)).alias("pos"), F.count(F.when(~y, 1)).alias("neg")), "scores")


def _rounded(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a, b), 6)


def threshold_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """At each distinct score, taken as threshold from high to low: tpr, fpr, precision, f1, accuracy and their distance."""
    run = running(_counts(df, score, label), [], ["score"], ["pos", "neg"])
    p, n = F.col("all_pos"), F.col("all_neg")
    tp, fp = p - F.col("cum_pos") + F.col("pos"), n - F.col("cum_neg") + F.col("neg")
    run = run.select("score", tp.alias("tp"), fp.alias("fp"), p.alias("p"), n.alias("n"))
    tpr, fpr, r = F.try_divide("tp", "p"), F.try_divide("fp", "n"), lambda x: F.round(x, 6)
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "p", "n"))
    return run.select("score", "tp", "fp", r(tpr).alias("tpr"), r(fpr).alias("fpr"), _rounded(tp, tp + fp).alias("precision"), _rounded(2 * tp, tp + fp + p).alias("f1"), _rounded(tp + n - fp, p + n).alias("accuracy"), r(tpr - fpr).alias("distance"))


def oriented_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """Threshold points of a score turned so that the half with more events is the high one; ``turned`` tells whether it was.

    The lower half are the first n // 2 rows in order of the score; where the
    cut falls among equal scores, their events count by their share.
    """
    counts = _counts(df, score, label).withColumn("n", F.col("pos") + F.col("neg"))
    run = running(counts, [], ["score"], ["pos", "n"])
    half = F.floor(F.col("all_n") / 2)
    inside = F.greatest(F.lit(0), F.least(F.col("n"), half - (F.col("cum_n") - F.col("n"))))
    turned = run.agg((F.sum(F.col("pos") * inside / F.col("n")) > F.max("all_pos") / 2).alias("turned")).scalar()
    points = threshold_points(df.select(F.when(turned, -F.col(score)).otherwise(F.col(score)).cast("double").alias("score"), F.col(label).alias("y")), "score", "y")
    return points.withColumn("turned", turned).withColumn("score", F.when(F.col("turned"), 0.0 - F.col("score")).otherwise(F.col("score")))


def band_cuts(df: DataFrame, score: str, label: str, bins: int = 10) -> list[float]:
    """Inner edges of quantile bands, for :func:`score_bands` on other rows."""
    found = inner_quantiles(_counts(df, score, label), [], bins, "score", F.col("pos") + F.col("neg")).first()
    return list(found["edges"]) if found else []


def _bands(df: DataFrame, score: Column | str, label: str, bins: int, cuts: list[float] | None = None) -> DataFrame:
    """(band, n, bad) of quantile bands, whose edges are one row, or of bands between given cuts."""
    counts = _counts(df, score, label)
    if cuts is not None:
        met = counts.withColumn("edges", F.array(*(F.lit(float(c)) for c in sorted(cuts))).cast("array<double>"))
    else:
        met = counts.join(F.broadcast(inner_quantiles(counts, [], bins, "score", F.col("pos") + F.col("neg"))))
    return met.groupBy(bin_of_few("score", "edges", len(cuts) if cuts is not None else bins - 1).alias("band")).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("bad"))


def score_bands(df: DataFrame, score: str, label: str, bins: int = 10, cuts: list[float] | None = None) -> DataFrame:
    """Bands from low to high, of quantiles or between given ``cuts``: size, event rate, and running rates of events, recall and pass."""
    g = _bands(df, F.col(score), label, bins, cuts)
    # Windows over at most ``bins`` rows.
    w, whole = Window.orderBy("band"), Window.partitionBy()
    good, r = F.col("n") - F.col("bad"), _rounded
    return g.select((F.col("band") + 1).alias("band"), "n", r(F.col("bad"), F.col("n")).alias("rate"), r(F.sum("bad").over(w), F.sum("n").over(w)).alias("acc_rate"), r(F.sum(good).over(w), F.sum(good).over(whole)).alias("acc_recall_good"), r(F.sum("bad").over(w), F.sum("bad").over(whole)).alias("acc_recall_bad"), r(F.sum("n").over(w), F.sum("n").over(whole)).alias("acc_pass"))


def lift(df: DataFrame, score: str, label: str, bands: int = 50) -> DataFrame:
    """Bands from the highest score down: running event rate over the overall rate."""
    g = _bands(df, -F.col(score), label, bands)
    w, whole = Window.orderBy("band"), Window.partitionBy()
    return g.select((F.col("band") + 1).alias("band"), "n", "bad", F.round(F.sum("bad").over(w) / F.sum("n").over(w) / (F.sum("bad").over(whole) / F.sum("n").over(whole)), 6).alias("lift"))


def first_rows(df: DataFrame, score: str, label: str, order: list[str], shares: DataFrame) -> DataFrame:
    """(pct, k, bad): events among the first k = int(pct n / 100) rows by ascending score, then ``order``, for each pct of ``shares``.

    Sums per distinct score give the score at which each k falls; only rows of
    those scores are put in order. ``order`` makes the order total and begins
    with a numeric, date or time column.
    """
    y = (F.col(label) > 0).cast("long")
    counts = written(df.groupBy(F.col(score).cast("double").alias("_s")).agg(F.count("*").alias("n"), F.sum(y).alias("bad")), "scores")
    known = running(counts, [], ["_s"], ["n", "bad"])
    total = df.agg(F.count("*").alias("_total")).scalar()
    grid = shares.select("pct", F.floor(F.col("pct") * total / 100).cast("long").alias("k")).where("k > 0")
    # At most as many rows as the grid has points.
    at = known.join(F.broadcast(grid), (F.col("k") > F.col("cum_n") - F.col("n")) & (F.col("k") <= F.col("cum_n"))).select("pct", "k", "_s", (F.col("k") - F.col("cum_n") + F.col("n")).alias("_rest"), (F.col("cum_bad") - F.col("bad")).alias("_before"))
    tied = df.select(F.col(score).cast("double").alias("_s"), *order, y.alias("bad"), F.lit(1).cast("long").alias("n")).join(F.broadcast(at.select("_s").distinct()), "_s", "left_semi")
    tied = running(tied, ["_s"], order, ["n", "bad"]).select("_s", F.col("cum_n").alias("_rest"), F.col("cum_bad").alias("_within"))
    found = tied.join(F.broadcast(at), ["_s", "_rest"]).select("pct", "k", (F.col("_before") + F.col("_within")).alias("bad"))
    return found.union(shares.select("pct", F.lit(0).cast("long"), F.lit(0).cast("long")).join(found.select("pct"), "pct", "left_anti"))


def pass_grid(df: DataFrame, score: str, label: str, order: list[str], bins: int = 100, cost_model: float = 1, rule_pass: float = 0.95, gain: float = 305, loss: float = 2000, cost_sell: float = 20, cost_rule: float = 1) -> DataFrame:
    """Pass rates p of 0 to 100 %: event rate of the first int(p n) rows by ascending score, and the profit (fixed values)."""
    at = first_rows(df, score, label, order, df.sparkSession.range(0, 101, max(1, 100 // bins)).select(F.col("id").alias("pct")))
    p, r = F.col("pct") / 100, F.coalesce(F.try_divide("bad", "k"), F.lit(0.0))
    profit = rule_pass * (gain * (1 - r) * p - loss * p * r - cost_model) - cost_sell - cost_rule
    return at.select("pct", F.col("k").alias("passed"), F.round(r, 6).alias("bad_rate"), F.round(profit, 3).alias("profit"))


def bad_rate_at(df: DataFrame, score: str, label: str, order: list[str], shares: list[float]) -> DataFrame:
    """(pass_rate, passed, bad_rate) at given pass rates between 0 and 1."""
    grid = df.sparkSession.createDataFrame([(100.0 * s,) for s in shares], "pct double")
    return first_rows(df, score, label, order, grid).select(F.round(F.col("pct") / 100, 6).alias("pass_rate"), F.col("k").alias("passed"), F.round(F.coalesce(F.try_divide("bad", "k"), F.lit(0.0)), 6).alias("bad_rate"))


def feature_curve(df: DataFrame, features: list[str], label: str, most: int = 20, bins: int = 10) -> DataFrame:
    """(feature, place, n, rate): mean label and rows by quantile bin, or by value for features of at most ``most`` values."""
    counts = value_counts(df, features, label)
    kinds = counts.groupBy("feature").agg((F.count("*") > most).alias("many"))
    edges = inner_quantiles(counts, ["feature"], bins, n=F.col("pos") + F.col("neg"))
    met = counts.join(F.broadcast(kinds), "feature").join(F.broadcast(edges), "feature")
    place = F.when(F.col("many"), bin_of(F.col("value"), F.col("edges")).cast("double")).otherwise(F.col("value"))
    return met.groupBy("feature", place.alias("place")).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.round(F.sum("pos") / F.sum(F.col("pos") + F.col("neg")), 6).alias("rate"))
