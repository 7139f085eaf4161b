"""Encoders: fit makes a small table, transform is a broadcast left join or a projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.stats import bin_of, md5_bucket, woe
from ledgerlens.operators.binning import inner_quantiles
from ledgerlens.operators.ranks import numbered, quantiles, value_table

UNKNOWN = "<unknown>"


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): rank from 0 among the distinct values and the unknown sentinel, which unseen values take."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).union(df.sparkSession.range(1).select(F.lit(UNKNOWN).alias("value"))).distinct()
    return numbered(values, ["value"], "code")


def label_encode(df: DataFrame, column: str, codes: DataFrame, out: str = "code") -> DataFrame:
    found = codes.select(F.col("value").alias(column), F.col("code").alias("_c"))
    sentinel = F.broadcast(codes.where(F.col("value") == UNKNOWN).select(F.col("code").alias("_u")))
    return df.join(found, column, "left").join(sentinel).withColumn(out, F.coalesce("_c", "_u")).drop("_c", "_u")


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One 0/1 column per fitted value; unseen values and nulls are all 0."""
    return df.select("*", *(F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{i}") for i, v in enumerate(values)))


def count_encode(df: DataFrame, column: str, fitted: DataFrame, smoothing: int = 1, log: bool = True, out: str = "encoded") -> DataFrame:
    """Count in the fitted table plus smoothing, 1 if unseen; then its logarithm."""
    counts = fitted.groupBy(column).agg((F.count("*") + smoothing).alias("_n"))
    value = F.coalesce("_n", F.lit(1))
    return df.join(counts, column, "left").withColumn(out, F.ln(value) if log else value.cast("double")).drop("_n")


def target_means(df: DataFrame, column: str, label: str, smoothing: float = 0.1, digits: int = 6) -> DataFrame:
    """(value, encoded): mean label drawn to the overall mean by a share ``smoothing`` of the value's rows."""
    y = F.col(label).cast("double")
    groups = df.groupBy(F.col(column).alias("value")).agg(F.sum(y).alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy()
    mean = F.sum("s").over(w) / F.sum("n").over(w)
    return groups.select("value", "n", F.round((F.col("s") + smoothing * F.col("n") * mean) / (F.col("n") * (1 + smoothing)), digits).alias("encoded"))


def woe_encode(df: DataFrame, column: str, label: str, bins: int = 10, out: str = "woe") -> DataFrame:
    """Each value's weight of evidence of its quantile bin; null stays null."""
    counts = value_table(df.select(F.col(column).cast("double").alias("value")), [])
    edges = F.broadcast(inner_quantiles(counts, [], bins).withColumnRenamed("edges", "_e"))
    binned = df.join(edges).withColumn("_bin", bin_of(F.col(column), F.col("_e"))).drop("_e")
    y = F.col(label) > 0
    g = binned.groupBy("_bin").agg(F.count_if(y).alias("p"), F.count_if(~y).alias("q")).where("_bin is not null")
    w = Window.partitionBy()
    g = g.select("_bin", woe(F.col("p"), F.col("q"), F.sum("p").over(w), F.sum("q").over(w)).alias(out))
    return binned.join(F.broadcast(g), "_bin", "left").drop("_bin")


def ffm_continuous(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column drawn into its 5 % and 95 % quantiles and scaled to 0..1, null as 0, and its token `i:i:value`."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "feature", "value")
    q = quantiles(value_table(long, ["feature"]), ["feature"], [0.05, 0.95]).groupBy().agg(*(F.max(F.when(F.col("feature") == c, F.col("q"))).alias(f"_{c}") for c in columns))
    scaled = [F.coalesce(F.try_divide(F.least(F.greatest(F.col(c).cast("double"), F.col(f"_{c}")[0]), F.col(f"_{c}")[1]) - F.col(f"_{c}")[0], F.col(f"_{c}")[1] - F.col(f"_{c}")[0]), F.lit(0.0)) for c in columns]
    out = df.join(F.broadcast(q)).select(*df.columns, *(F.round(s, 6).alias(f"{c}_scaled") for c, s in zip(columns, scaled, strict=True)))
    return out.withColumns({f"{c}_token": F.concat_ws(":", F.lit(i), F.lit(i), F.format_string("%.6f", f"{c}_scaled")) for i, c in enumerate(columns)})


def ffm_vocabulary(df: DataFrame, column: str, cutoff: int = 1, offset: int = 0) -> DataFrame:
    """(value, idx): values of at least ``cutoff`` rows by frequency, then value; `<unk>` is the first."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where(F.col("n") >= cutoff)
    ranked = numbered(counts, [F.desc("n"), F.col("value")], "idx").select("value", (F.col("idx") + 1 + offset).alias("idx"))
    return ranked.union(df.sparkSession.range(1).select(F.lit("<unk>"), F.lit(offset).cast("long")))


def ffm_hashed(df: DataFrame, columns: list[str], buckets: int = 1_000_000) -> DataFrame:
    """Token `field:hash:1` of each categorical value."""
    return df.select("*", *(F.concat_ws(":", F.lit(i), md5_bucket(F.concat(F.lit(f"{c}-"), F.col(c)), buckets), F.lit(1)).alias(f"{c}_token") for i, c in enumerate(columns)))
