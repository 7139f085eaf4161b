"""Labels by bins of a feature: running IV, counts, means, shares; entropy. Bins fitted on some rows serve all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import range_text
from ledgerlens.functions.stats import bin_of
from ledgerlens.operators.binning import inner_quantiles
from ledgerlens.operators.evaluate import ks_auc, value_counts
from ledgerlens.operators.profile import long_form
from ledgerlens.operators.ranks import running, value_table
from ledgerlens.session import written


def iv_or_zero(pos: Column, neg: Column, pos_all: Column, neg_all: Column) -> tuple[Column, Column]:
    """(woe, iv) of a bin; both 0 where it lacks a class."""
    one_class = (pos == 0) | (neg == 0)
    woe = F.when(one_class, 0.0).otherwise(F.ln((pos / pos_all) / (neg / neg_all)))
    return woe, F.when(one_class, 0.0).otherwise((pos / pos_all - neg / neg_all) * F.ln((pos / pos_all) / (neg / neg_all)))


def running_iv(df: DataFrame, features: list[str], labels: list[str], bins: int = 10) -> DataFrame:
    """(label, feature, bin, range, n, share, woe, iv, iv_running): quantile bins, IV added up from the lowest bin.

    Rows without the label don't count for it; nulls of a feature are a bin of their own, -1.
    """
    parts = []
    for label in labels:
        rows = long_form(df.where(F.col(label).isNotNull()), features, "double", [label])
        edges = inner_quantiles(value_table(rows, ["feature"]), ["feature"], bins)
        g = rows.join(F.broadcast(edges), "feature", "left").withColumn("bin", F.coalesce(bin_of(F.col("value"), F.col("edges")), F.lit(-1)))
        g = g.groupBy("feature", "bin").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"), F.count_if(F.col(label) > 0).alias("pos"))
        parts.append(g.select(F.lit(label).alias("label"), "feature", "bin", "low", "high", "n", "pos", (F.col("n") - F.col("pos")).alias("neg")))
    g = reduce(DataFrame.union, parts)
    # Windows over the bins of a feature.
    whole, w = Window.partitionBy("label", "feature"), Window.partitionBy("label", "feature").orderBy("bin")
    woe, iv = iv_or_zero(F.col("pos"), F.col("neg"), F.sum("pos").over(whole), F.sum("neg").over(whole))
    out = g.select("label", "feature", "bin", range_text(F.col("low"), F.col("high")).alias("range"), "n", F.round(F.col("n") / F.sum("n").over(whole), 6).alias("share"), woe.alias("woe"), iv.alias("iv"))
    return out.select("label", "feature", "bin", "range", "n", "share", F.round("woe", 6).alias("woe"), F.round("iv", 6).alias("iv"), F.round(F.sum("iv").over(w), 6).alias("iv_running"))


def iv_summary(found: DataFrame) -> DataFrame:
    """(label, feature, iv): the last running value of each."""
    return found.groupBy("label", "feature").agg(F.max_by("iv_running", "bin").alias("iv"))


def auc_matrix(df: DataFrame, features: list[str], labels: list[str]) -> DataFrame:
    """(label, feature, auc) of all pairs."""
    return reduce(DataFrame.union, (ks_auc(value_counts(df, features, y), ["feature"]).select(F.lit(y).alias("label"), "feature", "auc") for y in labels))


def area_by_steps(points: DataFrame, fpr: str = "fpr", tpr: str = "tpr") -> DataFrame:
    """One row, auc: the sum of tpr times the step in fpr, in order of fpr; ties aren't evened out.

    A step is the distance from the point before, so only the ends of the
    parts in which points are added up meet in one place.
    """
    steps = points.groupBy(F.col(fpr).cast("double").alias("x")).agg(F.max(F.col(tpr).cast("double")).alias("y"), F.count("*").alias("n"))
    ordered = running(steps, [], ["x"], ["n"])
    # The point before is that whose count ends where this one begins.
    before = ordered.select((F.col("cum_n")).alias("begin"), F.col("x").alias("x0"))
    met = ordered.withColumn("begin", F.col("cum_n") - F.col("n")).join(before, "begin", "left")
    return met.agg(F.round(F.sum(F.col("y") * (F.col("x") - F.coalesce("x0", F.lit(0.0)))), 6).alias("auc"))


def count_bins(df: DataFrame, columns: list[str], whole_numbers: set[str], bins: int = 50) -> DataFrame:
    """(feature, bin, low, high, n, share): equal-width bins, closed on the left and the last on both sides.

    Edges of columns of whole numbers are rounded up. Empty bins are left out.
    """
    rows = long_form(df, columns, "double").where("value is not null")
    ends = rows.groupBy("feature").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    at = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.col("a") + i * (F.col("b") - F.col("a")) / bins)
    up = F.col("feature").isin(*(whole_numbers or {""}))
    ends = ends.select("feature", F.when(up, F.transform(at, lambda e: F.ceil(e).cast("double"))).otherwise(at).alias("edges"))
    inner = F.slice("edges", 2, bins - 1)
    number = F.size(F.filter(inner, lambda e: e <= F.col("value")))
    g = rows.join(F.broadcast(ends), "feature").groupBy("feature", number.alias("bin")).agg(F.count("*").alias("n"), F.first("edges").alias("e"))
    w = Window.partitionBy("feature")
    return g.select("feature", F.col("bin").cast("long").alias("bin"), F.round(F.get("e", F.col("bin")), 6).alias("low"), F.round(F.get("e", F.col("bin") + 1), 6).alias("high"), "n", F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"))


def fitted_edges(df: DataFrame, feature: str, special: str, bins: int = 10) -> DataFrame:
    """One row, edges: quantile bins of the feature over rows that have the special label."""
    return inner_quantiles(value_table(df.where(F.col(special).isNotNull()).select(F.col(feature).cast("double").alias("value")), []), [], bins)


def labels_by_bin(df: DataFrame, feature: str, labels: list[str], special: str, bins: int = 10) -> DataFrame:
    """(label, bin, range, n, share, positives, positive_share, mean) with bins fitted where ``special`` is known.

    ``n`` counts rows that have the label, ``share`` among all that have it;
    ``positive_share`` is the bin's share of all positives. A value that no
    row with the special label had falls into the nearest bin.
    """
    rows = df.join(F.broadcast(fitted_edges(df, feature, special, bins))).select(F.col(feature).cast("double").alias("value"), *(F.col(y).cast("double").alias(y) for y in labels), "edges")
    rows = rows.where("value is not null").withColumn("bin", bin_of(F.col("value"), F.col("edges"))).unpivot(["bin", "value"], labels, "label", "y").where("y is not null")
    g = rows.groupBy("label", "bin").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"), F.count_if(F.col("y") > 0).alias("positives"), F.avg("y").alias("mean"))
    w = Window.partitionBy("label")
    return g.select("label", "bin", range_text(F.col("low"), F.col("high")).alias("range"), "n", F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"), "positives", F.round(F.try_divide("positives", F.sum("positives").over(w)), 6).alias("positive_share"), F.round("mean", 6).alias("mean"))


def reused_splits(df: DataFrame, features: list[str], labels: list[str], special: str, bins: int = 10) -> DataFrame:
    """(label, feature, bin, n, positives): the values that rows with ``special`` give to quantile bins, applied to rows of every label.

    A bin is a list of values, so a value that no row with the special label
    holds is in none: its rows are counted with a null bin, as unseen. Nulls
    of a feature are bin -1 if such a row has one, else unseen. Rows without a
    label don't count for it; bins that a label has no rows of are left out,
    so an empty table gives none. Each value meets its bin once, after its rows
    are counted.
    """
    rows = long_form(df, features, "double", list(dict.fromkeys([special, *labels])))
    of_label = [(y, F.count(F.col(y)).alias(f"n_{i}"), F.count_if(F.col(y) > 0).alias(f"pos_{i}")) for i, y in enumerate(labels)]
    # Read for the edges and for the bins.
    counts = written(rows.groupBy("feature", "value").agg(F.count(F.col(special)).alias("fitted"), *(c for _, n, pos in of_label for c in (n, pos))), "split-values")
    edges = inner_quantiles(counts.where("value is not null and fitted > 0"), ["feature"], bins, n="fitted")
    at = F.when(F.col("fitted") > 0, F.coalesce(bin_of(F.col("value"), F.col("edges")), F.lit(-1).cast("long")))
    g = counts.join(edges, "feature", "left").groupBy("feature", at.alias("bin")).agg(*(F.sum(f"{c}_{i}").alias(f"{c}_{i}") for i in range(len(labels)) for c in ("n", "pos")))
    each = F.array(*(F.struct(F.lit(y).alias("label"), F.col(f"n_{i}").alias("n"), F.col(f"pos_{i}").alias("positives")) for i, y in enumerate(labels)))
    return g.select("feature", "bin", F.inline(each)).where("n > 0").select("label", "feature", "bin", "n", "positives")


def kinds_by_bin(df: DataFrame, feature: str, kind: str, bins: int = 10) -> DataFrame:
    """(bin, kind, n, share, running_share): how a kind fills each bin, and all bins up to it."""
    v = df.select(F.col(feature).cast("double").alias("value"), F.col(kind).alias("kind")).where("value is not null and kind is not null")
    edges = inner_quantiles(value_table(v, []), [], bins)
    g = v.join(F.broadcast(edges)).groupBy(bin_of(F.col("value"), F.col("edges")).alias("bin"), "kind").agg(F.count("*").alias("n"))
    # A row for each bin and kind: kinds that a bin lacks count 0, so that running sums go on.
    frame = g.select("bin").distinct().join(F.broadcast(g.select("kind").distinct())).join(g, ["bin", "kind"], "left").fillna(0, ["n"])
    in_bin, so_far = Window.partitionBy("bin"), Window.partitionBy("kind").orderBy("bin")
    frame = frame.withColumn("all", F.sum("n").over(in_bin))
    return frame.select("bin", "kind", "n", F.round(F.try_divide("n", "all"), 6).alias("share"), F.round(F.try_divide(F.sum("n").over(so_far), F.sum("all").over(so_far)), 6).alias("running_share"))


def entropy(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, n, classes, entropy): Shannon entropy of the label in nats."""
    g = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"))
    # sum of -p ln p = ln N - sum of n ln n / N
    return g.groupBy(*keys).agg(F.sum("n").alias("n_all"), F.count("*").alias("classes"), F.sum(F.col("n") * F.ln("n")).alias("t")).select(*keys, F.col("n_all").alias("n"), "classes", F.round(F.ln("n_all") - F.col("t") / F.col("n_all"), 6).alias("entropy"))
