"""Bin edges and bin assignment. Edges are inner edges; bins are right-closed and numbered from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.stats import bin_of
from ledgerlens.operators.ranks import quantiles, running, value_table
from ledgerlens.session import written


def equal_width(x: Column, bins: int = 10) -> Column:
    """Aggregate: inner edges of equal-width bins."""
    return F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.min(x) + i * (F.max(x) - F.min(x)) / bins)


def inner_quantiles(counts: DataFrame, keys: list[str], bins: int = 10, value: str = "value", n: str | Column = "n", most: int | None = None) -> DataFrame:
    """(keys, edges): exact interpolated quantiles without repeats, but the first and the last, of a table with one row a value."""
    q = F.array_distinct("q")
    return quantiles(counts, keys, [i / bins for i in range(bins + 1)], value, n, once=True, most=most).select(*keys, F.slice(q, 2, F.greatest(F.size(q) - 2, F.lit(0))).alias("edges"))


def edges_of(long: DataFrame, keys: list[str], method: str = "qcut", bins: int = 10) -> DataFrame:
    """(keys, edges) of a long table (keys, value)."""
    v = F.col("value")
    if method == "cut":
        ends = long.groupBy(*keys).agg(F.min(v).alias("a"), F.max(v).alias("b"))
        return ends.select(*keys, F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.col("a") + i * (F.col("b") - F.col("a")) / bins).alias("edges"))
    if method == "qcut":
        return inner_quantiles(value_table(long, keys), keys, bins)
    raise ValueError(f"unknown method {method!r}")


def assign(long: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """The long table with its bin; edges are one small row per key."""
    return long.join(F.broadcast(edges), keys).withColumn("bin", bin_of(F.col("value"), F.col("edges"))).drop("edges")


#: Sizes of groups that are tried at once.
TRIED = 40


def _bounds(run: DataFrame, leasts: list[int], most: int | None = None) -> dict[int, list[int]]:
    """For each least size, the running counts at which its groups end, at most ``most + 1`` of them; ``run`` is (value, n, cum__n).

    A group ends at the first value whose running count reaches the last end
    and the least size. One job looks up the next end for all sizes, so there
    are as many jobs as the longest list is long, and no row holds the values.
    """
    ends: dict[int, list[int]] = {x: [] for x in leasts}
    going = list(leasts)
    while going:
        after = [(ends[x][-1] if ends[x] else 0) + x for x in going]
        row = run.agg(F.max("cum__n").alias("all"), *(F.min(F.when(F.col("cum__n") >= a, F.col("cum__n"))).alias(f"e{i}") for i, a in enumerate(after))).first()
        following = []
        for i, x in enumerate(going):
            reached = row[f"e{i}"] if row[f"e{i}"] is not None else row["all"]
            if reached is not None and reached != (ends[x][-1] if ends[x] else 0):
                ends[x].append(reached)
                if reached < row["all"] and (most is None or len(ends[x]) <= most):
                    following.append(x)
        going = following
    return ends


def _groups(run: DataFrame, ends: list[int]) -> DataFrame:
    """(grp, low, high, n) of running counts, cut at ``ends``."""
    at = bin_of(F.col("cum__n"), F.array(*(F.lit(e) for e in ends)).cast("array<bigint>"))
    return run.groupBy(at.alias("grp")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").cast("long").alias("n"))


def _run(counts: DataFrame) -> DataFrame:
    rows = written(counts.where(F.col("value").isNotNull()).select(F.col("value").cast("double").alias("value"), F.col("n").cast("long").alias("n")), "split-values")
    return written(running(rows, [], ["value"], ["n"]).select("value", "n", F.col("cum_n").alias("cum__n")), "split-runs")


def greedy_groups(counts: DataFrame, least: int) -> DataFrame:
    """(grp, low, high, n): values in order, merged until a group has ``least`` rows. ``counts`` is (value, n).

    As many jobs as there are groups, so ``least`` shouldn't be small.
    """
    run = _run(counts)
    return _groups(run, _bounds(run, [least])[least])


def optimal_groups(counts: DataFrame, bins: int = 10) -> DataFrame:
    """(grp, low, high, n): the finest split of :func:`greedy_groups` into at most ``bins`` groups. ``counts`` is (value, n).

    With no more distinct values than ``bins``, or ``bins`` of -1, a group has
    as many rows as the rarest value. Else ceil(n/b) rows, b going up from
    ``bins`` until more groups appear; the first step up asks for one row
    more, as in the reference. Groups never become fewer as b grows, so TRIED
    sizes at a time narrow the last b down, with ``bins`` jobs each. Nulls and
    NaN are a first group, which counts among the groups but not in n.
    """
    counts = written(counts.select(F.when(~F.isnan("value"), F.col("value")).alias("value"), "n"), "split-counts")
    known = F.col("value").isNotNull()
    about = counts.agg(F.count("value").alias("kinds"), F.sum(F.when(known, F.col("n"))).alias("n"), F.min(F.when(known, F.col("n"))).alias("rarest"), F.sum(F.when(~known, F.col("n"))).alias("nulls")).first()
    run = _run(counts)
    first = 1 if about["nulls"] else 0
    size = lambda b: -(-about["n"] // b)

    def few(leasts: list[int]) -> list[bool]:
        ends = _bounds(run, sorted(set(leasts)), bins)
        return [len(ends[x]) + first <= bins for x in leasts]

    if about["kinds"] <= bins or bins == -1:
        least = about["rarest"] or 1
    else:
        # The last b of few groups lies in low..high, which are known.
        low, high, least = bins + 1, about["n"] + 1, size(bins)
        near = list(range(bins + 2, min(high, bins + 2 + TRIED)))
        fine = few([size(bins + 1) + 1, *map(size, near)])
        if fine[0]:
            least = size(bins + 1) + 1
            for b, f in zip(near, fine[1:], strict=True):
                if not f:
                    high = b
                    break
                low = b
            while high - low > 1:
                tried = sorted({low + max(1, round((high - low) * i / (TRIED + 1))) for i in range(1, TRIED + 1)} - {high})
                for b, f in zip(tried, few(list(map(size, tried))), strict=True):
                    if not f:
                        high = b
                        break
                    low = b
            if low > bins + 1:
                least = size(low)
    groups = _groups(run, _bounds(run, [least])[least]).withColumn("grp", F.col("grp") + first)
    if not first:
        return groups
    none = F.lit(None).cast("double")
    return counts.where(~known).agg(F.sum("n").alias("n")).select(F.lit(0).cast("long").alias("grp"), none.alias("low"), none.alias("high"), "n").union(groups)
