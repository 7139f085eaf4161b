"""Tables of one feature against a binary label, with nulls as bin 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.ranks import row_quantiles

#: The bin of missing values.
NULL_BIN = 0


def _parts(groups: DataFrame) -> tuple[DataFrame, Column, Column]:
    """The groups with all events ``b`` and non-events ``g``, and the shares of both in a group."""
    w = Window.partitionBy()  # over a table of few groups
    t = groups.select("*", F.sum("bad").over(w).alias("b"), F.sum(F.col("n") - F.col("bad")).over(w).alias("g"), F.sum("n").over(w).alias("total"))
    return t, F.col("bad") / F.col("b"), (F.col("n") - F.col("bad")) / F.col("g")


def discrete_table(df: DataFrame, feature: str, label: str) -> DataFrame:
    """(value, n, bad, idx, share, rate, woe, iv) of each value; nulls are a value of their own, rows without a label don't count.

    ``idx`` is 100 times the rate of events over the overall rate. A value
    without events or non-events has no woe.
    """
    rows = df.where(F.col(label).isNotNull())
    g = rows.groupBy(F.col(feature).alias("value")).agg(F.sum((F.col(label) > 0).cast("double")).alias("bad"), F.count("*").alias("n"))
    t, bad, good = _parts(g)
    woe = F.when((bad > 0) & (good > 0), F.ln(bad / good))
    r = lambda c, d: F.round(c, d)
    return t.select("value", "n", F.col("bad").cast("long").alias("bad"), F.bround(100 * F.col("bad") / F.col("n") / (F.col("b") / F.col("total")), 0).alias("idx"), r(100.0 * F.col("n") / F.col("total"), 3).alias("share"), r(100 * F.col("bad") / F.col("n"), 3).alias("rate"), r(woe, 6).alias("woe"), r((bad - good) * woe, 6).alias("iv"))


def continuous_table(df: DataFrame, feature: str, label: str, bins: int = 10, tail: float = 0.01) -> DataFrame:
    """(bin, n, bad, mean, woe, iv): bin 0 holds nulls, 1 and ``bins + 2`` the tails, the others equal widths between.

    Tails are the values up to and from the exact quantiles ``tail`` and
    1 - ``tail``; counts in the woe are smoothed by one. Where the quantiles
    are one value, every known value is in bin 1.
    """
    x = df.where(F.col(label).isNotNull()).select(F.col(feature).cast("double").alias("x"), (F.col(label) > 0).cast("int").alias("y"))
    q = row_quantiles(x, [], [tail, 1 - tail], "x").select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    at = F.when(F.col("x").isNull(), NULL_BIN).when(F.col("x") <= F.col("lo"), 1).when(F.col("x") >= F.col("hi"), bins + 2).otherwise(F.ceil((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)) + 1).cast("long")
    # One row of two ends; none where there are no values.
    g = x.join(F.broadcast(q), F.lit(True), "left").groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("bad"), F.avg("x").alias("m"))
    t, bad, good = _parts(g)
    woe = F.ln((F.col("g") / F.col("b")) * (F.col("bad") + 1) / (F.col("n") - F.col("bad") + 1))
    return t.select("bin", "n", "bad", F.round("m", 4).alias("mean"), F.round(woe, 6).alias("woe"), F.round((bad - good) * woe, 6).alias("iv"))
