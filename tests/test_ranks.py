"""Cut groups against whole ones."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import ranks
from ledgerlens.plans.registry import QUERIES, SQL
from tests.test_oracle import SF, TABLES, rows


@pytest.fixture()
def cut(monkeypatch):
    monkeypatch.setattr(ranks, "LARGE", 7)


def test_running_totals_with_ties_and_null_keys(spark, cut):
    rng = np.random.default_rng(1)
    data = [(None if k == 2 else f"k{k}", int(v), int(n)) for k in range(3) for v, n in zip(rng.integers(0, 40, 200), rng.integers(0, 5, 200), strict=True)] + [("one", 1, 1)]
    df = spark.createDataFrame(data, "k string, v long, n long")
    got = sorted((str(r.k), r.v, r.n, r.cum_n, r.all_n) for r in ranks.running(df, ["k"], ["v"], ["n"]).collect())
    want = sorted((str(k), v, n, sum(c for a, b, c in data if a == k and b <= v), sum(c for a, _, c in data if a == k)) for k, v, n in data)
    assert got == want
    assert ranks.running(df.where("false"), ["k"], ["v"], ["n"]).count() == 0


def test_quantiles_against_numpy(spark, cut):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=501), "b": rng.integers(0, 3, 100).astype(float), "c": np.array([5.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("d", None), ("a", None)], "k string, value double")
    shares = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    got = {r.k: r.q for r in ranks.quantiles(ranks.value_table(df, ["k"]), ["k"], shares).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        assert np.allclose(got[k], np.quantile(vs, shares), atol=1e-12)


def test_numbers_are_those_of_the_sorted_rows(spark):
    words = [f"w{n}" for n in np.random.default_rng(3).integers(0, 10_000, 3000)]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "w string, i long")
    got = [(r.w, r.i) for r in ranks.numbered(df, [F.desc("w"), F.col("i")]).orderBy("number").collect()]
    assert got == sorted(zip(words, range(3000), strict=True), key=lambda x: ([-ord(c) for c in x[0]] + [1], x[1]))
    assert sorted(r.number for r in ranks.numbered(df, ["w", "i"]).collect()) == list(range(3000))


@pytest.mark.parametrize("name", ["woe_qcut", "ks_auc_matrix", "roc_pr_ks_points", "score_bands", "profit_curve", "oot_split", "stratified_folds", "feature_ks_by_day", "psi_by_day", "describe"])
def test_queries_with_cut_groups(spark, cut, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.sql(SQL[name]).df())
