"""Profiles of data sets: what each feature holds, as one row of common, numeric or text statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, DayTimeIntervalType, DoubleType, FloatType, TimestampNTZType, TimestampType

from ledgerlens.functions.scalars import epoch_nanoseconds, is_finite, is_infinite, kind_of
from ledgerlens.operators.ranks import quantiles

#: Buckets of both histograms (fixed value).
BUCKETS = 10


def as_number(column: Column, kind) -> Column:
    """A column as numbers: times as nanoseconds of the epoch, lengths of time as nanoseconds."""
    if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
        return epoch_nanoseconds(column).cast("double")
    if isinstance(kind, DayTimeIntervalType):
        return F.extract(F.lit("DAY"), column) * 86_400e9 + F.extract(F.lit("HOUR"), column) * 3_600e9 + F.extract(F.lit("MINUTE"), column) * 60e9 + F.extract(F.lit("SECOND"), column).cast("double") * 1e9
    return column.cast("double")


def kinds_of(df: DataFrame, features: list[str] | None = None) -> dict[str, str]:
    """Each feature's kind: INT, FLOAT or STRING; that of its elements for an array."""
    return {f.name: kind_of(f.dataType.elementType if isinstance(f.dataType, ArrayType) else f.dataType) for f in df.schema if features is None or f.name in features}


def flattened(df: DataFrame, names: list[str], text: bool) -> DataFrame:
    """(feature, size, value): the values of columns below each other, with how many a row has; size 0 for a missing one.

    Nulls, and NaN among several values, are missing; an array gives a row for each element.
    """
    parts = []
    for name in names:
        kind = df.schema[name].dataType
        listed = isinstance(kind, ArrayType)
        element = kind.elementType if listed else kind
        cast = (lambda x: x.cast("string")) if text else (lambda x, k=element: as_number(x, k))
        values = F.transform(F.coalesce(F.col(name), F.array().cast(kind)), cast) if listed else F.array(cast(F.col(name)))
        values = F.array_compact(values)
        values = F.filter(values, lambda x: ~F.isnan(x)) if listed and not text else values
        parts.append(df.select(F.lit(name).alias("feature"), F.size(values).alias("size"), F.explode_outer(values).alias("value"), F.monotonically_increasing_id().alias("row")) if listed else df.select(F.lit(name).alias("feature"), F.size(values).alias("size"), F.get(values, F.lit(0)).alias("value"), F.lit(0).cast("long").alias("row")))
    return reduce(DataFrame.union, parts)


def _counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, num_non_missing, num_missing, min_num_values, max_num_values, avg_num_values, tot_num_values)."""
    size = {n: F.coalesce(F.size(F.array_compact(F.col(n))), F.lit(0)) if isinstance(df.schema[n].dataType, ArrayType) else F.col(n).isNotNull().cast("int") for n in names}
    rows = df.select(*(s.alias(n) for n, s in size.items())).unpivot([], names, "feature", "size")
    some = F.when(F.col("size") > 0, F.col("size"))
    return rows.groupBy("feature").agg(F.count(some).alias("num_non_missing"), F.count_if(F.col("size") == 0).alias("num_missing"), F.min(some).cast("long").alias("min_num_values"), F.max(some).cast("long").alias("max_num_values"), F.round(F.avg(some), 6).alias("avg_num_values"), F.coalesce(F.sum(some), F.lit(0)).alias("tot_num_values"))


def numeric_profile(df: DataFrame, names: list[str], nan_is_missing: bool = False) -> DataFrame:
    """Common counts, and mean, std (of all), zeros, least, median, greatest, NaN and infinities of numeric features, with both histograms.

    Statistics leave NaN out, as missing values or as values of their own;
    buckets are of equal width over finite values, or from 0 to 1 without any,
    and infinities are counted in the first and the last.
    """
    if nan_is_missing:
        df = df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names if isinstance(df.schema[n].dataType, (DoubleType, FloatType))})
    v, rows = F.col("value"), flattened(df, names, False).where("value is not null")
    fine, known = F.when(is_finite(v), v), F.when(~F.isnan(v), v)
    stats = rows.groupBy("feature").agg(F.round(F.avg(known), 6).alias("mean"), F.round(F.stddev_pop(known), 6).alias("std_dev"), F.count_if(v == 0).alias("num_zeros"), F.min(known).alias("min"), F.max(known).alias("max"), F.count_if(F.isnan(v)).alias("num_nan"), F.count_if(is_infinite(v, 1)).alias("num_posinf"), F.count_if(is_infinite(v, -1)).alias("num_neginf"), F.min(fine).alias("_a"), F.max(fine).alias("_b"))
    same = F.col("_a") == F.col("_b")
    endless = F.col("num_posinf") + F.col("num_neginf") > 0
    low = F.when(same, F.col("_a") - 0.5).when(F.col("_a").isNull() & endless, 0.0).otherwise(F.col("_a"))
    high = F.when(same, F.col("_b") + 0.5).when(F.col("_b").isNull() & endless, 1.0).otherwise(F.col("_b"))
    ends = stats.select("feature", low.alias("_lo"), high.alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / BUCKETS
    at = F.when(is_infinite(v, -1), 0).when(is_infinite(v, 1), BUCKETS - 1).otherwise(F.least(F.lit(BUCKETS - 1), F.floor((v - F.col("_lo")) / width))).cast("int")
    filled = rows.where(~F.isnan("value")).join(F.broadcast(ends), "feature").groupBy("feature", at.alias("at")).agg(F.count("*").alias("n")).groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("_m"))
    bucket = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0)).cast("long"))
    finite = rows.where(is_finite(v)).groupBy("feature", "value").agg(F.count("*").alias("n"))
    q = quantiles(finite, ["feature"], [i / 10 for i in range(11)]).select("feature", F.transform("q", lambda x: F.round(x, 6)).alias("quantiles"), F.round(F.get("q", F.lit(5)), 6).alias("median"))
    out = _counts(df, names).join(stats.drop("_a", "_b"), "feature", "left").join(ends, "feature", "left").join(filled, "feature", "left").join(q, "feature", "left")
    return out.select("feature", F.lit("numeric").alias("kind"), *_COMMON, "mean", "std_dev", F.coalesce("num_zeros", F.lit(0)).alias("num_zeros"), "min", "median", "max", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("num_nan", "num_posinf", "num_neginf")), F.round("_lo", 6).alias("low"), F.round("_hi", 6).alias("high"), F.when(F.col("_lo").isNotNull(), bucket).alias("histogram"), "quantiles")


_COMMON = ["num_non_missing", "num_missing", "min_num_values", "max_num_values", "avg_num_values", "tot_num_values"]


def text_profile(df: DataFrame, names: list[str], levels: int | None = None) -> DataFrame:
    """Common counts, and distinct values, average length, the two commonest values and the rank histogram of text features.

    Ranks go by count, then value, both downwards; with ``levels`` only the first ranks are kept.
    """
    counts = flattened(df, names, True).where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))
    whole = counts.groupBy("feature").agg(F.count("*").alias("unique"), F.round(F.sum(F.length("value") * F.col("n")) / F.sum("n"), 6).alias("avg_length"))
    # The whole rank histogram is a table of its own (rank_histogram).
    top = _first_ranks(counts, max(2, levels or 2))
    out = _counts(df, names).join(whole, "feature", "left").join(top, "feature", "left")
    name = lambda k: F.get("_top", F.lit(k))["value"]
    return out.select("feature", F.lit("text").alias("kind"), *_COMMON, F.coalesce("unique", F.lit(0)).alias("unique"), "avg_length", name(0).alias("top1"), name(1).alias("top2"), F.coalesce(F.get("_top", F.lit(0))["n"], F.lit(0)).alias("top1_count"))


def _first_ranks(counts: DataFrame, levels: int) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("feature").orderBy(F.desc("n"), F.desc("value"))
    # Spark keeps only the first ranks of each task before it shuffles (WindowGroupLimit).
    ranked = counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= levels)
    return ranked.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "n", "value"))), lambda x: F.struct(x["n"].alias("n"), x["value"].alias("value"))).alias("_top"))


def datasets_profile(datasets: dict[str, DataFrame], features: list[str] | None = None) -> dict[str, DataFrame]:
    """The numeric and the text profile of several data sets, with a column ``dataset``.

    Features are those of the list, or of all data sets in order of first
    sight; a feature has the kind of the first data set that has it, and one
    that a data set lacks is missing in all its rows.
    """
    kinds: dict[str, str] = {}
    for df in datasets.values():
        for name, kind in kinds_of(df, features).items():
            kinds.setdefault(name, kind)
    types = {f.name: f.dataType for df in reversed(list(datasets.values())) for f in df.schema}
    out = {}
    for which, profile in (("numeric", numeric_profile), ("text", text_profile)):
        names = [n for n, k in kinds.items() if (k == "STRING") == (which == "text")]
        if names:
            each = []
            for dataset, df in datasets.items():
                full = df.select(*(F.col(n).cast(types[n]).alias(n) if n in df.columns else F.lit(None).cast(types[n]).alias(n) for n in names))
                each.append(profile(full, names).select(F.lit(dataset).alias("dataset"), "*"))
            out[which] = reduce(DataFrame.union, each)
    return out
