"""Descriptive statistics and column pruning, one pass over an unpivoted table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ranks import quantiles, value_table
from ledgerlens.session import written


def long_form(df: DataFrame, columns: list[str], kind: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, feature, value): the columns below each other, cast to one type."""
    keys = keys or []
    return df.select(*keys, *(F.col(c).cast(kind).alias(c) for c in columns)).unpivot(keys, columns, "feature", "value")


def describe_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls, non-nulls, distinct values and the share of the most common non-null value of each column.

    A column of nulls only has them as its most common value.
    """
    counts = long_form(df, columns, "string").groupBy("feature", "value").agg(F.count("*").alias("n"))
    known = F.col("value").isNotNull()
    out = counts.groupBy("feature").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("null_num"),
        F.count(F.when(known, 1)).alias("diff_values_num"),
        F.coalesce(F.max(F.when(known, F.col("n"))), F.sum("n")).alias("most_value_num"),
    )
    return out.select("feature", "null_num", (F.col("total") - F.col("null_num")).alias("notnull_num"), F.round(1 - F.col("null_num") / F.col("total"), 6).alias("notnull_ratio"), "diff_values_num", "most_value_num", F.round(F.col("most_value_num") / F.col("total"), 6).alias("same_ratio"))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of non-nulls per column, and that over the share of rows with any; first row is the data set."""
    any_known = F.coalesce(*(F.col(c).cast("string") for c in columns)).isNotNull().cast("int")
    total = df.agg(F.avg(any_known).alias("dataset"), *(F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in columns))
    rows = total.unpivot(["dataset"], columns, "feature", "cover")
    whole = total.select(F.lit("dataset").alias("feature"), F.round("dataset", 6).alias("coverage"), F.lit(None).cast("double").alias("saturation"))
    return whole.union(rows.select("feature", F.round("cover", 6), F.round(F.try_divide("cover", "dataset"), 6)))


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, standard deviation, least, quartiles and greatest of numeric columns, and the shares missing and of the commonest value."""
    v, long = F.col("value"), long_form(df, columns, "double")
    rows = long.groupBy("feature").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.avg(v.isNull().cast("int")).alias("missing"))
    values = value_table(long, ["feature"])
    rows = rows.join(quantiles(values, ["feature"], [0.25, 0.5, 0.75], once=True), "feature", "left")
    rows = rows.join(values.groupBy("feature").agg(F.max(F.when(v.isNotNull(), F.col("n"))).alias("most"), F.sum("n").alias("rows")), "feature")
    r = lambda c: F.round(c, 6)
    return rows.select("feature", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "least", r(F.col("q")[0]).alias("q25"), r(F.col("q")[1]).alias("q50"), r(F.col("q")[2]).alias("q75"), "greatest", r("missing").alias("missing"), r(F.col("most") / F.col("rows")).alias("same"))


def kinds(df: DataFrame, columns: list[str], most: int = 20) -> DataFrame:
    """Continuous above ``most`` distinct non-null values, else discrete."""
    counts = df.agg(*(F.count_distinct(c).alias(c) for c in columns)).unpivot([], columns, "feature", "n_distinct")
    return counts.withColumn("kind", F.when(F.col("n_distinct") > most, "continuous").otherwise("discrete"))


def prune_list(df: DataFrame, columns: list[str], nan_cut: float = 0.8, same_cut: float = 0.8, cate_cut: float = 0.9, numeric: set[str] | None = None) -> DataFrame:
    """Why columns should go: missing, same, or (non-numeric) almost as many values as rows."""
    d = describe_columns(df, columns)
    total = F.col("null_num") + F.col("notnull_num")
    is_text = ~F.col("feature").isin(*(numeric or {""}))
    reason = F.when(F.col("null_num") / total > nan_cut, "missing").when(F.col("same_ratio") > same_cut, "same").when(is_text & (F.col("diff_values_num") / total > cate_cut), "distinct")
    return d.select("feature", reason.alias("reason")).where("reason is not null")


#: Ratios of equal columns, and their fingerprints, differ by no more than this.
CLOSE = 1e-9


def _same_up_to_ratio(a: str, b: str) -> Column:
    """Aggregate: whether two columns have nulls and zeros in the same rows and one ratio elsewhere."""
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    ratio = F.try_divide(y.cast("double"), x.cast("double"))
    zeros = F.bool_and((F.coalesce(x, F.lit(0)) == 0) == (F.coalesce(y, F.lit(0)) == 0))
    return F.bool_and(x.isNull() == y.isNull()) & zeros & F.coalesce(F.max(ratio) - F.min(ratio) <= CLOSE, F.lit(True))


def duplicate_groups(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """For each numeric column the first one that it equals up to a constant ratio, itself if there is none.

    A column's fingerprint is made of order-free sums over its rows: of hashes
    of the rows where it is null and where it is zero, and of its values with
    signs that a row's hash draws, over the first value that isn't zero. Only
    columns whose fingerprints agree are compared, each with the first of its
    kind; so the work is linear in columns, but where fingerprints agree by
    chance. The rows are written once, as their numbers must not change.
    """
    rows = written(df.select(F.monotonically_increasing_id().alias("_row"), *(F.col(f"`{c}`").cast("double").alias(c) for c in columns)), "columns")
    long = rows.unpivot(["_row"], [F.col(f"`{c}`") for c in columns], "feature", "value")
    v, mark = F.col("value"), F.xxhash64("_row")
    sign = lambda bit: F.when(F.shiftrightunsigned(mark, bit).bitwiseAND(F.lit(1)) == 0, v).otherwise(-v)
    count = lambda where: F.sum(F.when(where, F.shiftrightunsigned(mark, 24)))
    prints = long.groupBy("feature").agg(count(v.isNull()).alias("nulls"), count(v == 0).alias("zeros"), F.min(F.when(v != 0, F.struct("_row", v))).alias("first"), F.sum(F.abs(v)).alias("size"), *(F.sum(sign(bit)).alias(f"s{bit}") for bit in (3, 17))).collect()  # one row for each column
    place = {c: i for i, c in enumerate(columns)}

    def scaled(r) -> tuple[float, ...]:
        first = r["first"]["value"] if r["first"] else 1.0
        return (r["size"] or 0.0) / abs(first), (r["s3"] or 0.0) / first, (r["s17"] or 0.0) / first

    exact: dict[tuple, list] = {}
    for r in sorted(prints, key=lambda r: place[r["feature"]]):
        exact.setdefault((r["nulls"], r["zeros"], r["first"]["_row"] if r["first"] else None), []).append((r["feature"], scaled(r)))
    found, waiting = {c: c for c in columns}, []
    for members in exact.values():
        # In order of size, so that only neighbours can agree; a kind is named by its first column.
        members.sort(key=lambda m: abs(m[1][0]))
        kind: list = []
        for name, mark in [*members, (None, None)]:
            if kind and (name is None or abs(abs(mark[0]) - abs(kind[-1][1][0])) > 1e-6 * max(1.0, abs(mark[0]))):
                waiting += _agreeing(kind, place)
                kind = []
            kind.append((name, mark))
    for lo in range(0, len(waiting), 200):
        part = waiting[lo : lo + 200]
        row = rows.agg(*(_same_up_to_ratio(a, b).alias(f"p{i}") for i, (a, b) in enumerate(part))).first()
        found |= {b: a for i, (a, b) in enumerate(part) if row[f"p{i}"]}
    return found


def _agreeing(kind: list, place: dict[str, int]) -> list[tuple[str, str]]:
    """(first, other) of columns of about the same size whose signed sums agree too."""
    heads: list[tuple[str, tuple]] = []
    out = []
    for name, mark in sorted(kind, key=lambda m: place[m[0]]):
        near = next((h for h, m in heads if all(abs(x - y) <= 1e-6 * max(1.0, abs(mark[0])) for x, y in zip(m, mark, strict=True))), None)
        if near is None:
            heads.append((name, mark))
        else:
            out.append((near, name))
    return out


def duplicate_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Whether two numeric columns are equal up to a constant ratio, for each pair of them. For wide frames see :func:`duplicate_groups`."""
    first = duplicate_groups(df, columns)
    pairs = [(a, b, first[a] == first[b]) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return df.sparkSession.createDataFrame(pairs, "left_column string, right_column string, duplicate boolean")


def target_by_segment(df: DataFrame, label: str, segment: str) -> DataFrame:
    """Mean label per segment and over all."""
    return df.rollup(segment).agg(F.grouping(segment).alias("g"), F.avg(label).alias("rate"), F.count("*").alias("n")).select(F.when(F.col("g") == 1, "All").otherwise(F.col(segment)).alias("segment"), F.round("rate", 6).alias("rate"), "n")


def histogram(df: DataFrame, columns: list[str], buckets: int = 10) -> DataFrame:
    """Equal-width histograms, the last bucket closed; a constant c spans c-0.5 to c+0.5. Empty buckets are listed."""
    v = long_form(df, columns, "double").where("value is not null and not isnan(value)")
    ends = v.groupBy("feature").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    ends = ends.select("feature", F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / buckets
    at = F.least(F.lit(buckets - 1), F.floor((F.col("value") - F.col("lo")) / width)).cast("long")
    counts = v.join(F.broadcast(ends), "feature").groupBy("feature", at.alias("bucket")).agg(F.count("*").alias("n"))
    frame = ends.select("feature", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"), F.round(F.col("lo"), 6).alias("lo0"), F.round(width, 6).alias("width"))
    return frame.join(counts, ["feature", "bucket"], "left").select("feature", "bucket", "lo0", "width", F.coalesce("n", F.lit(0)).alias("n"))


def quantile_buckets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Ten buckets between exact deciles."""
    q = quantiles(value_table(long_form(df, columns, "double"), ["feature"]), ["feature"], [i / 10 for i in range(11)], once=True).withColumnRenamed("total", "n")
    return q.select("feature", "q", "n", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).select("feature", F.col("i").cast("long").alias("bucket"), F.round(F.get("q", F.col("i")), 6).alias("low"), F.round(F.get("q", F.col("i") + 1), 6).alias("high"), (F.col("n") / 10).alias("sample_count"))


def rank_histogram(df: DataFrame, columns: list[str], top: int | None = None) -> DataFrame:
    """Values of text columns by (count, value) descending, ranks from 0."""
    from pyspark.sql import Window

    counts = long_form(df, columns, "string").where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), F.desc("value"))).cast("long") - 1)
    return ranked if top is None else ranked.where(F.col("rank") < top)
