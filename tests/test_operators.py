"""Edge cases: nulls, ties, empty tables, round trips."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ledgerlens.functions.stats import md5_bucket
from ledgerlens.operators import binning, evaluate, mdlp, monitor, profile, rules
from ledgerlens.sources import files


def test_right_closed_bins_and_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", None)], "feature string, value double")
    edges = spark.createDataFrame([("a", [2.0])], "feature string, edges array<double>")
    assert sorted(str(r.bin) for r in binning.assign(df, edges, ["feature"]).collect()) == ["0", "0", "1", "None"]


def test_tree_edges_separate_classes(spark):
    counts = spark.createDataFrame([(float(i), 10 if i > 5 else 0, 0 if i > 5 else 10) for i in range(10)], "value double, pos long, neg long")
    assert mdlp.gini_cuts(counts, []) == {(): [5.5]}


def test_greedy_groups(spark):
    counts = spark.createDataFrame([(1.0, 3), (2.0, 3), (3.0, 10), (4.0, 1)], "value double, n long")
    assert [(r.low, r.high, r.n) for r in binning.greedy_groups(counts, 5).orderBy("grp").collect()] == [(1.0, 2.0, 6), (3.0, 3.0, 10), (4.0, 4.0, 1)]


def test_optimal_groups_against_a_search_of_every_size(spark):
    def fold(ns, least):
        out, n = [], 0
        for x in ns:
            n += x
            if n >= least:
                out, n = [*out, n], 0
        return [*out, n] if n else out

    def search(ns, nulls, bins):
        first, size = [nulls] if nulls else [], lambda b: -(-sum(ns) // b)
        if len(ns) <= bins:
            return first + fold(ns, min(ns))
        best, b, least = first + fold(ns, size(bins)), bins + 1, size(bins + 1) + 1
        while len(got := first + fold(ns, least)) <= bins:
            best, b = got, b + 1
            least = size(b)
        return best

    for ns, nulls, bins in [([900, 5, 5, 5, 5, 5, 5, 5, 5, 60], 0, 4), ([3, 1, 2], 0, 5), ([7, 2, 9, 4, 1, 8, 3, 6], 5, 3), ([10] * 8, 0, 4)]:
        rows = [(float(i), n) for i, n in enumerate(ns)] + ([(None, nulls - 1), (float("nan"), 1)] if nulls else [])
        got = binning.optimal_groups(spark.createDataFrame(rows, "value double, n long"), bins).orderBy("grp").collect()
        assert [r.n for r in got] == search(ns, nulls, bins) and [r.grp for r in got] == list(range(len(got)))
        assert bool(nulls) == (got[0].low is None)


def test_auc_of_ties_is_half(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0)], "x double, y int")
    row = evaluate.ks_auc(evaluate.value_counts(df, ["x"], "y"), ["feature"]).first()
    assert (row.ks, row.auc) == (0.0, 0.5)


def test_one_class_gives_null_auc(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "x double, y int")
    assert evaluate.ks_auc(evaluate.value_counts(df, ["x"], "y"), ["feature"]).first().auc is None


def test_all_null_column_is_its_own_mode(spark):
    df = spark.createDataFrame([(None,), (None,)], "x string")
    row = profile.describe_columns(df, ["x"]).first()
    assert (row.null_num, row.notnull_num, row.most_value_num, row.diff_values_num) == (2, 0, 2, 0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, y int")
    assert evaluate.evaluate(df, ["x"], "y").count() == 0


def test_md5_bucket(spark):
    df = spark.createDataFrame([("a",), ("b",), ("",)], "s string")
    for r in df.select("s", md5_bucket(F.col("s")).alias("b")).collect():
        assert r.b == int(hashlib.md5(r.s.encode()).hexdigest(), 16) % 999_999 + 1


def test_rules_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    assert [r[0] for r in df.select(rules.covers([[("b", "!=", 3)]])).collect()] == [True, False]
    assert [r[0] for r in df.select(rules.covers([])).collect()] == [False, False]


def test_delimited_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 1, 1.5), (None, None, None), ("", 2, 0.1)], "s string, i int, x double")
    files.write_delimited(df, str(tmp_path / "t"))
    back = files.read_delimited(spark, str(tmp_path / "t"), df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, files.clean_text(df).collect()))


def test_json_number(spark):
    df = spark.createDataFrame([('{"k": "1.5"}',), ('{"k": ""}',), ("no",), (None,)], "s string")
    assert [r[0] for r in df.select(monitor.json_number("s", "$.k")).collect()] == [1.5, None, None, None]
