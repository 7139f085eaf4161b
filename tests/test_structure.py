"""Profiles against exact expectations."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql.types import BooleanType, DayTimeIntervalType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType, TimestampType

from ledgerlens.functions.scalars import kind_of
from ledgerlens.operators import structure
from ledgerlens.operators.profile import rank_histogram


def one(df, names, text=False, **how):
    return (structure.text_profile if text else structure.numeric_profile)(df, names, **how).first().asDict()


def test_numbers_and_texts(spark):
    df = spark.createDataFrame([(1, "hi"), (2, "hello"), (3, "hi")], "i int, s string")
    assert structure.kinds_of(df) == {"i": "INT", "s": "STRING"}
    row = one(df, ["i"])
    assert (row["num_non_missing"], row["min"], row["max"], row["quantiles"]) == (3, 1, 3, [1.0, 1.2, 1.4, 1.6, 1.8, 2.0, 2.2, 2.4, 2.6, 2.8, 3.0])
    assert one(df, ["s"], text=True)["unique"] == 2
    assert structure.numeric_profile(df.where("false"), ["i"]).count() == 0


def test_missing_values(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, None), (float("nan"), "c"), (3.0, "d")], "x double, s string")
    assert one(df, ["x"], nan_is_missing=True)["num_missing"] == 2 and one(df, ["x"])["num_missing"] == 1
    assert one(df, ["s"], text=True)["num_missing"] == 1


def test_times_and_lengths_of_time(spark):
    df = spark.createDataFrame([(dt.datetime(2005, 2, 25), dt.datetime(2009, 1, 1) - dt.datetime(2008, 1, 1)), (dt.datetime(2006, 2, 25), dt.timedelta(0))], "t timestamp_ntz, d interval day to second")
    rows = {r.feature: r for r in structure.numeric_profile(df, ["t", "d"]).collect()}
    assert (rows["t"].min, rows["t"].max) == (1109289600000000000, 1140825600000000000) and rows["d"].max == 31622400000000000


def test_kinds_of_types():
    assert [kind_of(t) for t in (IntegerType(), BooleanType(), TimestampType(), DayTimeIntervalType(), FloatType(), DoubleType(), StringType(), StructType([StructField("a", StringType())]))] == ["INT"] * 4 + ["FLOAT"] * 2 + ["STRING"] * 2


def test_fifty_numbers(spark):
    row = one(spark.createDataFrame([(float(i),) for i in range(50)] + [(None,)], "x double"), ["x"])
    assert (row["num_non_missing"] + row["num_missing"], row["mean"], row["median"], row["num_zeros"], row["num_missing"]) == (51, 24.5, 24.5, 1, 1)
    assert abs(row["std_dev"] - 14.430869689) < 1e-6 and (row["low"], row["high"], row["histogram"]) == (0, 49, [5] * 10)
    q = one(spark.createDataFrame([(float(i),) for i in range(50)] + [(100.0,)] * 50, "x double"), ["x"])["quantiles"]
    assert q[:2] == [0.0, 9.9] and q[-2:] == [100.0, 100.0]


def test_infinities_and_nan(spark):
    odd = [(float("inf"),), (float("-inf"),), (float("nan"),)]
    row = one(spark.createDataFrame([(float(i),) for i in range(50)] + odd, "x double"), ["x"])
    assert math.isnan(row["mean"]) and (row["num_zeros"], row["num_nan"], row["num_posinf"], row["num_neginf"], row["num_non_missing"]) == (1, 1, 1, 1, 53)
    assert row["histogram"] == [6, *[5] * 8, 6] and (row["low"], row["high"]) == (0, 49)
    only = one(spark.createDataFrame(odd[:2], "x double"), ["x"])
    assert only["histogram"] == [1, *[0] * 8, 1] and (only["low"], only["high"]) == (0, 1) and only["quantiles"] is None


def test_strings(spark):
    df = spark.createDataFrame([("hello",)] * 2 + [("hi",)] * 3 + [("hey",)], "s string")
    row = one(df, ["s"], text=True)
    assert (row["unique"], row["top1"], row["top1_count"], row["top2"]) == (3, "hi", 3, "hello") and abs(row["avg_length"] - 19 / 6) < 1e-6
    assert [r.value for r in rank_histogram(df, ["s"]).orderBy("rank").collect()] == ["hi", "hello", "hey"]
    capped = spark.createDataFrame([(s,) for s in ["hi", "good", "hi", "hi", "a", "a"]], "s string")
    assert [(r.value, r.n) for r in rank_histogram(capped, ["s"], 2).orderBy("rank").collect()] == [("hi", 3), ("a", 2)]
    row = one(capped, ["s"], text=True, levels=2)
    assert (row["unique"], row["avg_length"], row["top1"], row["top2"]) == (3, 2.0, "hi", "a")


def test_lists_of_varying_length(spark):
    rows = [([],)] + [([float(k)] * n,) for k, n in enumerate([1, 2, 3, 4])] + [(None,)]
    row = one(spark.createDataFrame(rows, "v array<double>"), ["v"])
    assert (row["num_missing"], row["num_non_missing"], row["min_num_values"], row["max_num_values"], row["tot_num_values"], row["avg_num_values"]) == (2, 4, 1, 4, 10, 2.5)


def test_several_data_sets(spark):
    a = spark.createDataFrame([("one", 0), ("one", 0)], "s string, i int")
    b = spark.createDataFrame([("two", 1)], "s string, i int")
    rows = {(r.dataset, r.feature): r for r in structure.datasets_profile({"a": a, "b": b})["numeric"].collect()}
    assert (rows["a", "i"].max, rows["b", "i"].max) == (0, 1)
    assert set(structure.datasets_profile({"a": a}, ["i"])) == {"numeric"}
    lacking = structure.datasets_profile({"a": a, "c": a.drop("i")})["numeric"].where("dataset = 'c'").first()
    assert (lacking.num_missing, lacking.num_non_missing, lacking.mean) == (2, 0, None)


def test_rows_over_many_files(spark, tmp_path):
    from ledgerlens.sources import files

    paths = [f"{tmp_path}/{k}" for k in range(3)]
    for p in paths:
        spark.range(50).write.parquet(p)
    assert [files.first_rows(spark, paths[:n], m).count() for n, m in ((1, 1), (1, 1000), (2, 1000), (3, 75))] == [1, 50, 100, 75]
    with pytest.raises(ValueError, match="unknown method"):
        from ledgerlens.operators import binning

        binning.edges_of(spark.createDataFrame([("a", 1.0)], "feature string, value double"), ["feature"], "other")
