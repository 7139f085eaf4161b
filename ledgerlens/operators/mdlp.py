"""Supervised cuts of many features at once: Gini trees and minimum description length.

A level of all trees is one job: counts of values are summed up within nodes,
and the best cut of each node comes to the driver. What is collected is one
row a node, never data.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from ledgerlens.functions.stats import bin_of
from ledgerlens.operators.evaluate import ks_auc, value_counts
from ledgerlens.operators.profile import long_form
from ledgerlens.operators.ranks import quantiles, running, value_table
from ledgerlens.operators.split import stratified_folds
from ledgerlens.session import written

Key = tuple


def _cut_table(df: DataFrame, keys: list[str], cuts: dict[Key, list[float]]) -> DataFrame:
    schema = df.select(*keys).schema.add("_cuts", ArrayType(DoubleType()))
    return F.broadcast(df.sparkSession.createDataFrame([(*k, v) for k, v in cuts.items()], schema))


def grow(counts: DataFrame, keys: list[str], classes: list[str], score: Callable[[list[Column], Column], Column], accept: Callable[[Row], bool], most_levels: int, least: Callable[[int], float] = lambda n: 1) -> dict[Key, list[float]]:
    """Cut points of each key of a table (keys, value, classes...: counts), grown level by level.

    ``score`` is a node's impurity times its rows, from its class counts; the
    cut that lowers it most is taken, at the middle between two values, the
    lower one among equals. ``accept`` judges a node's best cut by its row:
    n, n1, and class counts as lists c and c1. Both sides keep ``least(N)``
    rows, N those of the key.
    """
    # Gone over once a level.
    counts = written(counts.select(*keys, F.col("value").cast("double").alias("value"), *classes), "tree-counts")
    size = reduce(add, (F.col(c) for c in classes))
    totals = {tuple(r[:-1]): r[-1] for r in counts.groupBy(*keys).agg(F.sum(size)).collect()}
    floor = {k: float(least(n)) for k, n in totals.items()}
    cuts: dict[Key, list[float]] = {k: [] for k in totals}
    open_nodes: dict[Key, list[int]] = {k: [0] for k in totals}
    for _ in range(most_levels):
        live = {k: v for k, v in open_nodes.items() if v}
        if not live:
            break
        schema = counts.select(*keys).schema.add("_cuts", ArrayType(DoubleType())).add("_open", ArrayType(LongType())).add("_least", DoubleType())
        here = F.broadcast(counts.sparkSession.createDataFrame([(*k, cuts[k], v, floor[k]) for k, v in live.items()], schema))
        met = counts.join(here, keys) if keys else counts.join(here)
        node = met.withColumn("node", bin_of(F.col("value"), F.col("_cuts"))).where(F.array_contains("_open", F.col("node"))).select(*keys, "node", "value", "_least", *classes)
        run = running(node, [*keys, "node"], ["value"], classes)
        whole, left = [F.col(f"all_{c}") for c in classes], [F.col(f"cum_{c}") for c in classes]
        right = [a - b for a, b in zip(whole, left, strict=True)]
        n, n1, n2 = reduce(add, whole), reduce(add, left), reduce(add, right)
        fall = score(whole, n) - score(left, n1) - score(right, n2)
        fit = run.where((n1 >= F.col("_least")) & (n2 >= F.col("_least")) & (n2 > 0)).select(*keys, "node", "value", n.alias("n"), n1.alias("n1"), F.array(*whole).alias("c"), F.array(*left).alias("c1"), F.round(fall, 9).alias("fall"))
        best = fit.groupBy(*keys, "node").agg(F.max_by(F.struct("value", "n", "n1", "c", "c1", "fall"), F.struct("fall", -F.col("value"))).alias("b")).select(*keys, "node", "b.*")
        # The middle between the value and the next one of its node.
        after = node.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("node").alias("_node"), F.col("value").alias("_after"))
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], (F.col("node") == F.col("_node")) & (F.col("_after") > F.col("value")))
        chosen = after.join(F.broadcast(best), on).groupBy(*keys, "node", "value", "n", "n1", "c", "c1", "fall").agg(F.min("_after").alias("after")).collect()
        open_nodes = {}
        for row in chosen:
            if row["fall"] > 1e-9 and accept(row):
                key = tuple(row[k] for k in keys)
                cuts[key] = sorted({*cuts[key], (row["value"] + row["after"]) / 2})
                open_nodes.setdefault(key, []).append((row["value"] + row["after"]) / 2)
        open_nodes = {k: sorted({cuts[k].index(c) + d for c in new for d in (0, 1)}) for k, new in open_nodes.items()}
    return cuts


def _gini(c: list[Column], n: Column) -> Column:
    return F.when(n > 0, n - reduce(add, (x * x for x in c)) / n).otherwise(0.0)


def _entropy(c: list[Column], n: Column) -> Column:
    """Entropy in nats, times rows."""
    term = lambda x: F.when(x > 0, x * F.ln(x.cast("double"))).otherwise(0.0)
    return term(n) - reduce(add, (term(x) for x in c))


def gini_cuts(counts: DataFrame, keys: list[str], max_depth: int = 5, least_share: float = 0.05) -> dict[Key, list[float]]:
    """Cut points of a one-feature Gini tree for each key of (keys, value, pos, neg)."""
    return grow(counts, keys, ["pos", "neg"], _gini, lambda row: True, max_depth, lambda n: math.ceil(least_share * n))


def _plain_entropy(c: list[int]) -> float:
    n = sum(c)
    return -sum(x / n * math.log(x / n) for x in c if x)


def worth_its_length(row: Row) -> bool:
    """Fayyad and Irani's criterion: a cut's gain pays for describing it."""
    whole, left = list(row["c"]), list(row["c1"])
    right = [a - b for a, b in zip(whole, left, strict=True)]
    n, k, k1, k2 = sum(whole), *(sum(x > 0 for x in c) for c in (whole, left, right))
    e, e1, e2 = (_plain_entropy(c) for c in (whole, left, right))
    gain = e - sum(left) / n * e1 - sum(right) / n * e2
    delta = math.log(3**k - 2) - (k * e - k1 * e1 - k2 * e2)
    return gain >= (math.log(n - 1) + delta) / n


def mdlp_cuts(df: DataFrame, features: list[str], label: str, most_levels: int = 30) -> DataFrame:
    """(feature, cut): entropy-minimising cuts that the description length accepts, for a label of few values."""
    rows = long_form(df, features, "double", [label]).where(F.col("value").isNotNull() & F.col(label).isNotNull())
    kinds = [r[0] for r in rows.select(label).distinct().orderBy(label).collect()]
    if not kinds:
        return df.sparkSession.createDataFrame([], "feature string, cut double")
    names = [f"c{i}" for i in range(len(kinds))]
    counts = rows.groupBy("feature", "value").agg(*(F.count_if(F.col(label) == v).alias(c) for c, v in zip(names, kinds, strict=True)))
    cuts = grow(counts, ["feature"], names, _entropy, worth_its_length, most_levels)
    return df.sparkSession.createDataFrame([(k[0], c) for k, v in cuts.items() for c in v], "feature string, cut double")


def discretized(value: Column, cuts: Column) -> Column:
    """1 + the number of cuts below the value; null for null."""
    return bin_of(value, cuts) + 1


def fifths(df: DataFrame, columns: list[str], bins: int = 5) -> DataFrame:
    """(feature, value, bin): percentile bins from 1, closed on the left, the last on both sides; one row a distinct value with n rows."""
    counts = value_table(long_form(df, columns, "double").where("value is not null"), ["feature"])
    edges = quantiles(counts, ["feature"], [i / bins for i in range(1, bins)]).select("feature", "q")
    return counts.join(F.broadcast(edges), "feature").select("feature", "value", "n", (F.size(F.filter("q", lambda e: e <= F.col("value"))) + 1).cast("long").alias("bin"))


def continuous_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with a value that isn't whole, from one aggregate."""
    row = df.agg(*(F.bool_or(F.col(c).cast("double") != F.floor(F.col(c).cast("double"))).alias(c) for c in columns)).first()
    return [c for c in columns if row[c]]


def tree_auc(df: DataFrame, features: list[str], label: str, ident: list[str], folds: int = 5, max_depth: int = 5, least_share: float = 0.05) -> DataFrame:
    """(feature, raw, tree, auc): AUC of a feature, of out-of-fold scores by one-feature trees, and the greater of both.

    Folds are stratified in hash order. The trees of all features and folds
    grow together, a job a level; leaves score by their training event rate.
    """
    dealt = stratified_folds(df.where(F.col(label).isNotNull()).select(*ident, label, *features), label, ident, folds)
    counts = value_counts(dealt, features, label, ["fold"])
    others = counts.join(F.broadcast(df.sparkSession.range(folds).select(F.col("id").alias("out"))), F.col("fold") != F.col("out"))
    training = others.groupBy("feature", "out", "value").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cuts = _cut_table(training, ["feature", "out"], gini_cuts(training, ["feature", "out"], max_depth, least_share))
    leaf = lambda rows: rows.join(cuts, ["feature", "out"]).withColumn("leaf", bin_of(F.col("value"), F.col("_cuts"))).drop("_cuts")
    rates = leaf(training).groupBy("feature", "out", "leaf").agg((F.sum("pos") / F.sum(F.col("pos") + F.col("neg"))).alias("rate"))
    scored = leaf(counts.withColumnRenamed("fold", "out")).join(F.broadcast(rates), ["feature", "out", "leaf"])
    scored = scored.groupBy("feature", F.col("rate").alias("value")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    whole = counts.groupBy("feature", "value").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    raw = ks_auc(whole, ["feature"]).select("feature", F.col("auc").alias("raw"))
    tree = ks_auc(scored, ["feature"]).select("feature", F.col("auc").alias("tree"))
    return raw.join(tree, "feature", "left").select("feature", "raw", "tree", F.greatest("raw", "tree").alias("auc"))
