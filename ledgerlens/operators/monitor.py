"""Drift of deployed scores: PSI by day and KS of features by day against a benchmark."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, udtf
from pyspark.sql.pandas.functions import ArrowUDFType

from ledgerlens.functions.stats import bin_of_few
from ledgerlens.operators.ranks import row_quantiles, running, small
from ledgerlens.session import ship, written

#: Added to each actual count, and bound of a bin's log ratio (fixed values).
SMOOTH, LIMIT = 1e-4, 10.0


def psi_edges(benchmark: DataFrame, hue: str, score: str, bins: int = 10) -> DataFrame:
    """(hue, edges): 0, then the benchmark's quantiles but the last, without repeats. Scores below 0 are refused."""
    edges = row_quantiles(benchmark, [hue], [i / bins for i in range(bins)], score).withColumn("least", F.col("q")[0])
    return edges.select(hue, F.when(F.col("least") >= 0, F.array_distinct(F.concat(F.array(F.lit(0.0)), "q"))).otherwise(F.raise_error(F.lit("scores must not be negative"))).alias("edges"))


def psi_by_time(df: DataFrame, hue: str, score: str, is_benchmark: str, time: str, passed: str, bins: int = 10) -> DataFrame:
    """(hue, time, psi, volume, passed, pass_ratio) of rows that aren't the benchmark.

    Bins are right-closed with the lowest closed, expected counts are as they
    are, actual ones smoothed; every day gets every bin.
    """
    # One row for each hue, and counts of its bins and days: both are read several times.
    edges = written(psi_edges(df.where(F.col(is_benchmark) & F.col(score).isNotNull()), hue, score, bins), "psi-edges")
    rows = df.join(small(edges, edges.count()), hue).where(F.col(score) >= 0)
    at = F.greatest(bin_of_few(f"`{score}`", "edges", bins + 1), F.lit(1)).alias("bin")
    rows = rows.select(hue, time, is_benchmark, passed, at, F.size("edges").alias("k"))
    counts = written(rows.groupBy(hue, F.when(F.col(is_benchmark), None).otherwise(F.col(time)).alias("day"), is_benchmark, "bin").agg(F.count("*").alias("n")), "psi-counts")
    expected = counts.where(is_benchmark).select(hue, "bin", F.col("n").alias("e"))
    expected = edges.select(hue, F.explode(F.sequence(F.lit(1).cast("long"), F.size("edges").cast("long"))).alias("bin")).join(expected, [hue, "bin"], "left").fillna(0, ["e"])
    actual = counts.where(~F.col(is_benchmark)).select(hue, "day", "bin", "n")
    frame = actual.select(hue, "day").distinct().join(expected, hue).join(actual, [hue, "day", "bin"], "left")
    n = F.coalesce("n", F.lit(0)) + SMOOTH
    w = Window.partitionBy(hue, "day")
    a, e = n / F.sum(n).over(w), F.col("e") / F.sum("e").over(w)
    ratio = F.when(e == 0, LIMIT).otherwise(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.ln(a / F.when(e == 0, 1).otherwise(e)))))
    psi = frame.select(hue, "day", ((a - e) * ratio).alias("part")).groupBy(hue, "day").agg(F.round(F.sum("part"), 6).alias("psi"))
    volume = df.where(~F.col(is_benchmark)).groupBy(hue, F.col(time).alias("day")).agg(F.count("*").alias("volume"), F.sum(F.col(passed).cast("long")).alias("passed"))
    return psi.join(volume, [hue, "day"]).select(hue, "day", "psi", "volume", "passed", F.round(F.col("passed") / F.col("volume"), 6).alias("pass_ratio"))


def ks_by_time(df: DataFrame, hue: str, value: str, is_benchmark: str, time: str) -> DataFrame:
    """(hue, day, ks, volume): greatest distance of each day's distribution from the benchmark's.

    The benchmark's distribution is worked out once at every value that occurs
    and looked up by the days. Between two values of a day its distribution
    stands still, so the distance is greatest at a value or just below one.
    """
    known = df.where(F.col(value).isNotNull()).groupBy(F.col(hue).alias("hue"), F.col(value).alias("v"), F.col(is_benchmark).alias("b"), F.when(~F.col(is_benchmark), F.col(time)).alias("day")).agg(F.count("*").alias("n"))
    known = written(known, "daily-values")
    bench = running(known.groupBy("hue", "v").agg(F.coalesce(F.sum(F.when(F.col("b"), F.col("n"))), F.lit(0)).alias("n")), ["hue"], ["v"], ["n"])
    bench = bench.select("hue", "v", F.try_divide("cum_n", "all_n").alias("at"), F.try_divide(F.col("cum_n") - F.col("n"), F.col("all_n")).alias("below"))
    days = running(known.where(~F.col("b")).select("hue", "day", "v", "n"), ["hue", "day"], ["v"], ["n"])
    met = days.join(bench, ["hue", "v"])
    gap = F.greatest(F.abs(F.col("cum_n") / F.col("all_n") - F.col("at")), F.abs((F.col("cum_n") - F.col("n")) / F.col("all_n") - F.col("below")))
    return met.groupBy("hue", "day").agg(F.round(F.max(gap), 6).alias("ks"), F.sum("n").alias("volume")).withColumnRenamed("hue", hue)


def json_number(text: str, path: str):
    """A number in a JSON text; null for anything else."""
    return F.nullif(F.get_json_object(text, path), F.lit("")).try_cast("double")


def parse_features(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, feature, value): the fields of a JSON object below each other; what isn't a number is null."""
    fields = F.from_json(column, "map<string,string>")
    return df.select(*keys, F.explode(fields).alias("feature", "text")).select(*keys, "feature", F.nullif("text", F.lit("")).try_cast("double").alias("value"))


#: Objects become tuples of pairs, which keep repeated fields; integers of any length become doubles, -0 too is 0.
_DECODER = json.JSONDecoder(object_pairs_hook=tuple, parse_int=lambda digits: float(digits) + 0.0)


def _double(value: object) -> float | None:
    try:
        # Texts as bytes, so that only digits and blanks of ASCII count.
        return None if isinstance(value, bool) else float(value.encode() if isinstance(value, str) else value)
    except (TypeError, ValueError):
        return None


def numbers_of(text: str) -> Iterator[tuple[str, float | None]]:
    """The default parser: the fields of a JSON object; what isn't a number is null, what isn't an object has none.

    A repeated field comes as often as it stands there, with its first value; what is beyond doubles is infinite.
    """
    try:
        fields = _DECODER.decode(text)
    except ValueError:
        return
    first: dict[str, float | None] = {}
    for name, value in fields if isinstance(fields, tuple) else ():
        yield name, first.setdefault(name, _double(value))


def parse_with(df: DataFrame, column: str, keys: list[str], parser: Callable[[str], Iterable[tuple[str, float | None]]] = numbers_of, nulls: bool = False) -> DataFrame:
    """(keys, feature, value): what a parser makes of each row's text, by a table function in a lateral join.

    The parser runs in the tasks, on a batch of rows at a time; a null text is parsed only with ``nulls``.
    """
    ship(df.sparkSession)

    class Parse:
        def eval(self, text: str) -> Iterator[tuple[str, float | None]]:
            if nulls or text is not None:
                yield from ((str(f), None if v is None else float(v)) for f, v in parser(text))

    parse = udtf(Parse, returnType="_feature string, _value double", useArrow=True)
    rows = df.select(*keys, F.col(column).alias("_text"))
    return rows.lateralJoin(parse(F.col("_text").outer())).select(*keys, F.col("_feature").alias("feature"), F.col("_value").alias("value"))


#: Named statistics: a function from a column to an aggregate, or one that takes the whole values of a group.
Statistics = dict[str, "Callable[[Column], Column] | Gathered"]


@dataclass(frozen=True)
class Gathered:
    """A statistic of all non-null values of a group as a float64 array, by a grouped Arrow function; each group must fit a task."""

    work: Callable[[np.ndarray], float | None]


def trimmed_mean(share: float = 0.1) -> Gathered:
    """Mean without the floor(n share) least and greatest values; null without values."""

    def mean(x: np.ndarray) -> float | None:
        k = int(len(x) * share)
        return float(np.sort(x)[k : len(x) - k].mean()) if len(x) - 2 * k > 0 else None

    return Gathered(mean)


def aggregated(rows: DataFrame, keys: list[str], value: str, statistics: Statistics, where: Column | None = None, prefix: str = "") -> DataFrame:
    """(keys, statistics by name) of a column: column builders in one aggregate, gathered ones in one more, joined by the keys."""
    x = F.col(value) if where is None else F.when(where, F.col(value))
    plain = {n: s for n, s in statistics.items() if not isinstance(s, Gathered)}
    gathered = {n: s for n, s in statistics.items() if isinstance(s, Gathered)}
    parts = []
    if plain:
        parts.append(rows.groupBy(*keys).agg(*(s(x).alias(f"{prefix}{n}") for n, s in plain.items())))
    if gathered:
        ship(rows.sparkSession)
        made = []
        for n, s in gathered.items():

            def whole(v: pa.Array, work=s.work) -> float:
                return work(v.drop_null().cast(pa.float64()).to_numpy(zero_copy_only=False))

            whole.__annotations__ = {"v": pa.Array, "return": float}
            made.append(arrow_udf(whole, "double", ArrowUDFType.GROUPED_AGG)("_x").alias(f"{prefix}{n}"))
        parts.append(rows.withColumn("_x", x.cast("double")).groupBy(*keys).agg(*made))
    if len(parts) < 2:
        return parts[0]
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return parts[0].alias("l").join(parts[1].alias("r"), reduce(and_, same)).select("l.*", *(f"r.{prefix}{n}" for n in gathered))


def feature_stats_by_time(long: DataFrame, hue: str, is_benchmark: str, time: str, statistics: Statistics | None = None) -> DataFrame:
    """(hue, feature, day, ks, volume, and median, std and mean of the day and of the benchmark) of a table (hue, feature, value, ...).

    Volume counts missing values too. A feature that the benchmark lacks has no
    ks. ``statistics`` are further ones, as in :func:`aggregated`.
    """
    keyed = long.select(F.struct(hue, "feature").alias("k"), F.col("value"), F.col(is_benchmark).alias("b"), F.col(time).alias("day"))
    ks = ks_by_time(keyed, "k", "value", "b", "day").select("k", "day", F.round("ks", 3).alias("ks"))

    def figures(rows: DataFrame, keys: list[str], prefix: str) -> DataFrame:
        middle = row_quantiles(rows, keys, [0.5]).select(*keys, F.round(F.col("q")[0], 6).alias(f"{prefix}_median"))
        out = rows.groupBy(*keys).agg(F.count("*").alias(f"{prefix}_volume"), F.round(F.stddev_samp("value"), 6).alias(f"{prefix}_std"), F.round(F.avg("value"), 6).alias(f"{prefix}_mean")).join(middle, keys, "left")
        return out.join(aggregated(rows, keys, "value", statistics, prefix=f"{prefix}_"), keys, "left") if statistics else out

    days = figures(keyed.where("not b"), ["k", "day"], "day")
    bench = figures(keyed.where("b"), ["k"], "bench").drop("bench_volume")
    out = days.join(ks, ["k", "day"], "left").join(bench, "k", "left")
    return out.select(F.col("k")[hue].alias(hue), F.col("k")["feature"].alias("feature"), "day", "ks", F.col("day_volume").alias("volume"), *(f"{p}_{s}" for p in ("day", "bench") for s in ("median", "std", "mean", *(statistics or {}))))


def sketches_by_time(df: DataFrame, keys: list[str], value: str, ident: str | None = None) -> DataFrame:
    """(keys, n, kinds, ranks): mergeable sketches of each group, of distinct values of ``ident`` (``value`` if not given) and of the order of ``value``."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col(ident or value).cast("string"), 12).alias("kinds"), F.kll_sketch_agg_double(F.col(value).cast("double"), 400).alias("ranks"))


def merged_sketches(sketches: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """(keys, n, distinct, quantiles): sketches of any groups merged, never their rows; quantiles are within 1 % of ranks."""
    one = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("kinds").alias("kinds"), F.kll_merge_agg_double("ranks").alias("ranks"))
    return one.select(*keys, "n", F.hll_sketch_estimate("kinds").alias("distinct"), F.array(*(F.kll_sketch_get_quantile_double("ranks", F.lit(float(p))) for p in shares)).alias("quantiles"))


def monitor(df: DataFrame, hue: str, score: str, features: str, is_benchmark: str, time: str, passed: str, parser: Callable | None = None, statistics: Statistics | None = None) -> dict[str, DataFrame]:
    """The drift of a deployed model: psi of its score, and figures of the features in a column, both by day; JSON or what ``parser`` reads, with further ``statistics``."""
    keys = [hue, is_benchmark, time]
    return {"psi": psi_by_time(df, hue, score, is_benchmark, time, passed), "features": feature_stats_by_time(parse_with(df, features, keys, parser) if parser else parse_features(df, features, keys), hue, is_benchmark, time, statistics)}
