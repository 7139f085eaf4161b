"""Running totals, exact quantiles and row numbers of large groups, without a task that sees a whole group.

A group's order is cut at about evenly spaced values, the parts are summed up,
and the small table of those sums gives each part what comes before it. So a
window sees one part of one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import written

#: Groups of more rows are cut into parts of about that many. MOST_PARTS of them cover ten billion rows; beyond that parts grow.
LARGE, MOST_PARTS = 1_000_000, 10_000
#: Groups whose edges are broadcast, and rows of groups that are gathered.
FEW = 20_000


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of the largest group, and groups: two numbers, from counts that are added up before they are shuffled."""
    found = df.groupBy(*keys).count().agg(F.max("count"), F.count("*")).first()
    return found[0] or 0, found[1]


def most_rows(df: DataFrame, keys: list[str]) -> int:
    return group_sizes(df, keys)[0]


def small(df: DataFrame, groups: int) -> DataFrame:
    """A table of one short row for each group, broadcast if they are few."""
    return F.broadcast(df) if groups <= FEW else df


def in_parts(df: DataFrame, keys: list[str], by: str, most: int, large: int) -> DataFrame:
    """``_group``, the keys as one (nulls are alike), and ``_part``, which grows with ``by`` (numeric, date or time) in a group of more than ``large`` rows; else 0.

    ``most`` is the number of rows of the largest group. Only rows of large
    groups are sketched. The cuts sent out are bounded by rows / ``large``.
    """
    df = df.withColumn("_group", F.struct(*keys) if keys else F.lit(0))
    parts = min(MOST_PARTS, -(-most // large))
    many = df.groupBy("_group").agg(F.count("*").alias("_n")).where(F.col("_n") > large)
    cuts = df.join(F.broadcast(many.select("_group")), "_group", "left_semi").groupBy("_group").agg(F.count("*").alias("_n"), F.percentile_approx(by, [i / parts for i in range(1, parts)], 20 * parts).alias("_cuts"))
    wanted = F.least(F.lit(parts), F.ceil(F.col("_n") / large)).cast("int")
    cuts = cuts.select("_group", F.transform(F.sequence(F.lit(1), wanted - 1), lambda i: F.get("_cuts", F.floor(i * parts / wanted).cast("int") - 1)).alias("_cuts"))
    number = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(by))), F.lit(0))
    return df.join(F.broadcast(cuts), "_group", "left").withColumn("_part", F.when(F.col("_cuts").isNull(), 0).otherwise(number)).drop("_cuts")


def running(df: DataFrame, keys: list[str], order: list[str], sums: list[str], large: int | None = None, most: int | None = None) -> DataFrame:
    """The rows with ``cum_x`` and ``all_x`` for each x of ``sums``: its sum up to the row (rows that tie included), and in the group.

    ``order`` begins with a numeric, date or time column; null keys are a
    group. Groups of at most ``large`` rows have a window each. ``most`` is the
    number of rows of the largest group, counted here if it isn't given; in a
    larger one the window and the join with what comes before a part share one
    partitioning.
    """
    large = LARGE if large is None else large
    most = most_rows(df, keys) if most is None else most
    if most <= large:
        whole = Window.partitionBy(*keys)
        return df.withColumns({f"cum_{x}": F.sum(x).over(whole.orderBy(*order)) for x in sums} | {f"all_{x}": F.sum(x).over(whole) for x in sums})
    cut = in_parts(df, keys, order[0], most, large)
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_group")
    # One row for each part of a group.
    totals = cut.groupBy("_group", "_part").agg(*(F.sum(x).alias(x) for x in sums))
    totals = totals.select("_group", "_part", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"_before_{x}") for x in sums), *(F.sum(x).over(whole).alias(f"all_{x}") for x in sums))
    w = Window.partitionBy("_group", "_part").orderBy(*order)
    met = cut.withColumns({f"cum_{x}": F.sum(x).over(w) for x in sums}).join(totals, ["_group", "_part"])
    return met.withColumns({f"cum_{x}": F.col(f"cum_{x}") + F.col(f"_before_{x}") for x in sums}).drop("_group", "_part", *(f"_before_{x}" for x in sums))


def quantiles(counts: DataFrame, keys: list[str], shares: list[float], value: str = "value", n: str | Column = "n", large: int | None = None, once: bool = False, most: int | None = None) -> DataFrame:
    """(keys, q, total): exact interpolated quantiles, as an array, of a table of values and how often each occurs.

    Nulls don't count; a group of nulls only is missing. Rows of a value are
    added up first, unless each has one row only (``once``). ``most`` is as in
    :func:`running`.
    """
    n = F.col(n) if isinstance(n, str) else n
    rows = counts.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), n.cast("long").alias("_n")).where("_n > 0")
    run = running(rows if once else rows.groupBy(*keys, "_v").agg(F.sum("_n").alias("_n")), keys, ["_v"], ["_n"], large, most)
    # As texts, which are parsed at once: a column for each operator takes longer to build than to run. The value of a rank is the least that more rows than it lie at or below.
    place = lambda p, total: f"(({total} - 1) * {float(p)!r}D)"
    at = lambda to, p: F.expr(f"min(CASE WHEN cum__n > {to}({place(p, 'all__n')}) THEN _v END)")
    found = run.groupBy(*keys).agg(F.max("all__n").alias("total"), *(at(to, p).alias(f"_{to}{i}") for i, p in enumerate(shares) for to in ("floor", "ceil")))
    parts = [(f"_floor{i}", f"_ceil{i}", place(p, "total")) for i, p in enumerate(shares)]
    between = ", ".join(f"CASE WHEN {a} = {b} THEN {a} ELSE (ceil({x}) - {x}) * {a} + ({x} - floor({x})) * {b} END" for a, b, x in parts)
    return found.select(*keys, F.expr(f"array({between})").alias("q"), "total")


def row_quantiles(rows: DataFrame, keys: list[str], shares: list[float], value: str = "value") -> DataFrame:
    """:func:`quantiles` of rows rather than counts, with values cast to double.

    Groups of at most FEW rows are gathered by value in one pass; larger ones
    go by a written table of values.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("value"))
    if most_rows(rows, keys) > FEW:
        return quantiles(value_table(rows, keys), keys, shares, once=True)
    return rows.groupBy(*keys).agg(F.percentile("value", [float(p) for p in shares]).alias("q"), F.count("*").alias("total"))


def value_table(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, value, n): how often each value occurs; written once, as what reads it does so several times."""
    return written(long.groupBy(*keys, value).agg(F.count("*").alias("n")), "values")


def numbered(df: DataFrame, order: list[Column | str], out: str = "number") -> DataFrame:
    """Row numbers from 0 in a total order of any types: sorted ranges are written once, and counted."""
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = written(sorted_rows, "numbered")
    part, own = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    # One row for each range.
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    return rows.withColumn("_part", part).withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(out, F.col("_own") + F.col("_before")).drop("_id", "_part", "_own", "_before")
