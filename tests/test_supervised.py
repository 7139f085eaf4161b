"""Supervised cuts, rules, transformers and models against plain versions."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import curves, encode, evaluate, history, labels, mdlp, models, rules, split, transform


def entropy(y):
    p = np.bincount(y) / len(y)
    return -sum(v * math.log(v) for v in p if v)


def plain_mdlp(x, y):
    """Recursive cuts by entropy with the description length criterion, over all positions."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    best = None
    for i in range(1, len(x)):
        if x[i] != x[i - 1]:
            e = (i * entropy(y[:i]) + (len(x) - i) * entropy(y[i:])) / len(x)
            if best is None or e < best[0] - 1e-12:
                best = (e, i)
    if best is None:
        return []
    e, i = best
    k, k1, k2 = (len(set(v.tolist())) for v in (y, y[:i], y[i:]))
    delta = math.log(3**k - 2) - (k * entropy(y) - k1 * entropy(y[:i]) - k2 * entropy(y[i:]))
    if entropy(y) - e < (math.log(len(x) - 1) + delta) / len(x):
        return []
    return plain_mdlp(x[:i], y[:i]) + [(x[i - 1] + x[i]) / 2] + plain_mdlp(x[i:], y[i:])


def test_mdlp_against_a_recursive_search(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 60, 400).astype(float)
    y = np.where(x < 15, 0, np.where(x < 40, 1, 2))
    y = np.where(rng.random(400) < 0.1, rng.integers(0, 3, 400), y)
    noise = rng.normal(size=400)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, noise, y, strict=True)], "x double, noise double, y int")
    got = mdlp.mdlp_cuts(df, ["x", "noise"], "y").collect()
    assert sorted(r.cut for r in got if r.feature == "x") == plain_mdlp(x, y) and len(plain_mdlp(x, y)) == 2
    assert sorted(r.cut for r in got if r.feature == "noise") == plain_mdlp(noise, y)
    assert mdlp.mdlp_cuts(df.where("false"), ["x"], "y").count() == 0
    cuts = F.array(F.lit(1.0), F.lit(2.0))
    assert [r[0] for r in spark.createDataFrame([(0.5,), (1.0,), (1.5,), (9.0,), (None,)], "v double").select(mdlp.discretized(F.col("v"), cuts)).collect()] == [1, 1, 2, 3, None]


def plain_tree(x, y, depth, least):
    """Leaf rates by a Gini tree; a function of x."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    gini = lambda v: len(v) - (v.sum() ** 2 + (len(v) - v.sum()) ** 2) / len(v) if len(v) else 0.0
    best = (1e-9, None)
    if depth:
        for i in range(1, len(x)):
            if x[i] != x[i - 1] and i >= least and len(x) - i >= least:
                fall = round(gini(y) - gini(y[:i]) - gini(y[i:]), 9)
                if fall > best[0]:
                    best = (fall, i)
    if best[1] is None:
        return lambda v: y.mean()
    cut = (x[best[1] - 1] + x[best[1]]) / 2
    left, right = plain_tree(x[: best[1]], y[: best[1]], depth - 1, least), plain_tree(x[best[1] :], y[best[1] :], depth - 1, least)
    return lambda v: left(v) if v <= cut else right(v)


def auc(score, y):
    pos, neg = score[y == 1], score[y == 0]
    a = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    return max(a, 1 - a)


def test_tree_auc_against_plain_trees(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 30, 300).astype(float)
    y = ((np.abs(x - 15) < 6) ^ (rng.random(300) < 0.15)).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x double, y int")
    fold = {r.id: r.fold for r in split.stratified_folds(df, "y", ["id"], 5).collect()}
    fold = np.array([fold[i] for i in range(300)])
    score = np.zeros(300)
    for k in range(5):
        tree = plain_tree(x[fold != k], y[fold != k], 3, math.ceil(0.05 * (fold != k).sum()))
        score[fold == k] = [tree(v) for v in x[fold == k]]
    row = mdlp.tree_auc(df, ["x"], "y", ["id"], max_depth=3).first()
    assert abs(row.raw - auc(x, y)) < 1e-5 and abs(row.tree - auc(score, y)) < 1e-5 and row.auc == max(row.raw, row.tree) and row.tree > 0.7


def test_rules_find_what_the_classes_hang_on(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(a), "ab"[int(b)], float(c)) for i, (a, b, c) in enumerate(zip(rng.integers(0, 50, 3000), rng.integers(0, 2, 3000), rng.normal(size=3000), strict=True))]
    df = spark.createDataFrame(rows, "id long, a double, s string, noise double").withColumn("y", F.when((F.col("a") >= 40) & (F.col("s") == "a"), 2).when(F.col("a") <= 4, 1).otherwise(0))
    learned = rules.Ripper(least=50).fit(df, "y", ["a", "s", "noise"], ["id"])
    assert learned.default == 0 and [c for c, _ in learned.rules] == [1, 2] or [c for c, _ in learned.rules] == [2, 1]
    right = learned.predict(df).agg(F.avg((F.col("y") == F.col("predicted")).cast("int"))).first()[0]
    assert right > 0.97
    assert rules.Ripper().fit(df.where("y = 0"), "y", ["a"], ["id"]).predict(df).select("predicted").distinct().collect()[0][0] == 0


def test_rules_over_ordered_categories(spark):
    order = ["low", "mid", "high"]
    rows = [(i, [*order, "odd", None][i % 5], i % 7) for i in range(350)]
    df = spark.createDataFrame(rows, "id long, s string, x long")
    found = rules.conditions(df, ["s", "x"], q=2, ordered={"s": [*order, "never"]})
    assert [(c, op, v.value) for c, op, v in found["s"]] == [("s", op, v) for v in order for op in (">=", "<=")]
    assert found["x"] == [("x", op, float(v)) for v in (0, 3, 6) for op in (">=", "<=")]
    hit = lambda rule: {r.s for r in df.where(rules.covers([rule])).select("s").distinct().collect()}
    level = {v.value: v for _, _, v in found["s"]}
    assert hit([("s", ">=", level["mid"])]) == {"mid", "high"} and hit([("s", "<=", level["mid"])]) == {"low", "mid"}
    two = df.where("s in ('low', 'high')")
    assert {c[1] for c in rules.conditions(two, ["s"], ordered={"s": order})["s"]} == {"=="}
    marked = df.withColumn("y", F.coalesce(F.col("s").isin("mid", "high"), F.lit(False)).cast("int"))
    learned = rules.Ripper(least=20, ordered={"s": order}).fit(marked, "y", ["s", "x"], ["id"])
    assert learned.predict(marked).where("y <> predicted").count() == 0 and learned.rules[0][1] == [[("s", ">=", rules.Level("mid", tuple(order)))]]


def test_description_lengths():
    assert rules.rule_length(2, 10) == int(0.5 * (1 + 2 * math.log2(5) + 8 * math.log2(1 / 0.8)))
    assert rules.set_length([], 10, 5, 5, 0, 0) == pytest.approx(math.log2(math.comb(10, 5)))
    assert rules.foil_gain(10, 10, 5, 0, 1) == pytest.approx(math.log10(5) * 0.5) and rules.foil_gain(10, 10, 5, 0, 6) == -10000.0


def test_target_encoder_with_seeded_noise(spark):
    df = spark.createDataFrame(list(zip("abcbcc", [1, 0, 1, 1, 0, 1], strict=True)), "x string, y int")
    rows = transform.encoder("category", "target").fit(df, ["x"], "y").transform(df.withColumn("was", F.col("x"))).collect()
    got = {r.was: r.x for r in rows}
    assert abs(got["a"] - 1.03627629) < 1e-7 and abs(got["c"] - 0.58939665) < 1e-7 and abs(got["b"] - 0.55091546) < 1e-7


def test_encoders_of_unseen_values_and_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("b", 1), (None, 0)], "x string, y int")
    new = spark.createDataFrame([("a",), ("v",), (None,)], "x string")
    made = {m: [r[0] for r in transform.encoder("category", m, **how).fit(df, ["x"], "y").transform(new).collect()] for m, how in (("label", {}), ("count", {"log": False}), ("target", {"noise": 0}), ("woe", {}))}
    assert made["label"][0] == 1 and made["label"][1] == 0 and made["count"][:2] == [2.0, 1.0] and made["target"][1] == 0.5 and made["woe"][1] == 0.0
    hot = transform.encoder("category", "onehot").fit(df, ["x"]).transform(new).collect()
    assert [tuple(r) for r in hot] == [(1, 0), (0, 0), (0, 0)]
    with pytest.raises(ValueError, match="unknown category encoder"):
        transform.encoder("category", "other")
    with pytest.raises(ValueError, match="not two"):
        transform.encoder("category", "woe").fit(df.withColumn("y", F.lit(1)), ["x"], "y")
    with pytest.raises(ValueError, match="more than 1 values"):
        transform.encoder("category", "onehot", most=1).fit(df, ["x"])


def test_preprocess_thresholds(spark):
    df = spark.createDataFrame([(i, None if i < 15 else i, 1, i % 2) for i in range(20)] * 2, "id int, few int, same int, half int")
    assert transform.Preprocess(0.5, 0.1).fit(df).gone == ["few", "same"] and transform.Preprocess(5, 2).fit(df).gone == ["same"]
    assert transform.Preprocess(0.5, 0.1, True).fit(df).transform(df).count() == 20


def test_field_aware_rows(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (0, "b", 10.0), (1, "a", None), (0, None, 5.0)], "y int, c string, x double")
    made = transform.FieldAwareEncoder(cutoff=2).fit(df, ["x"], ["c"])
    assert [r.line for r in made.transform(df, "y").collect()] == ["1 0:0:0.000000 1:2:1", "0 0:0:1.000000 1:1:1", "1 0:0:0.000000 1:2:1", "0 0:0:0.500000 1:1:1"]


def test_history_with_smoothing(spark):
    import datetime as dt

    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    rows = [("k", day(0), day(10), day(5), 1), ("k", day(20), day(40), day(45), 2), ("k", day(60), day(70), day(60), 3)]
    df = spark.createDataFrame(rows, "key string, created date, finish date, expect date, id int")
    ranked = history.ranked_history(df, "key", "created", "finish", "expect", "id")
    assert [(r.id, r.place, r.overdue_days, r.gap_days) for r in ranked.orderBy("place").collect()] == [(3, 1, 10, -10), (2, 2, -5, 20), (1, 3, 5, 10)]
    made = history.HistoryFeatures("key", spans=[2, None]).fit(ranked)
    assert made.learned == {"overdue_days": 5.0, "gap_days": 10.0}
    out = {r.key: r for r in made.transform(ranked, spark.createDataFrame([("k",), ("new",)], "key string")).collect()}
    assert (out["k"].overdue_days_2_len, out["k"].overdue_days_2_median, out["k"].overdue_days_2_latest, out["k"].overdue_days_all_len, out["k"].overdue_days_all_share_positive) == (3, 5.0, 10.0, 4, 0.75)
    assert (out["new"].gap_days_all_len, out["new"].gap_days_2_latest, out["new"].created_weekday_0) == (1, 10.0, None)
    valid = history.valid_history(df.withColumn("applied", F.lit(day(50))), "applied", "finish")
    assert sorted(r.id for r in valid.collect()) == [1, 2]
    assert history.valid_history(df.withColumn("finish", F.lit("1000-01-01").cast("date")).withColumn("applied", F.lit(day(50))), "applied", "finish").count() == 0


def test_time_spans_refuse_neither():
    with pytest.raises(ValueError, match="margins or a hue"):
        history.TimeSpanFeatures("k", "t", margins=False).fit(None)


def test_splits(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 4 == 0).cast("int")).withColumn("t", F.col("id") % 100)
    train, test = split.split(df, "oot", "id", "t", 0.2)
    assert (train.count(), test.count(), "t" in test.columns) == (800, 200, False)
    assert split.split(df, "random", "id", share=0.2)[1].count() == 200
    with pytest.raises(ValueError, match="unknown method"):
        split.split(df, "other", "id")
    marked, seed = split.balanced_split(df, "y", ["id"])
    rates = {r.is_test: r.m for r in marked.groupBy("is_test").agg(F.round(F.avg("y"), 3).alias("m")).collect()}
    assert abs(rates[True] - rates[False]) <= 0.001 + 1e-9 and 0 <= seed < 100


def test_label_tables(spark):
    df = spark.createDataFrame([(float(i), i % 3, i % 2 if i < 20 else None) for i in range(30)] + [(None, 1, 1)], "x double, y int, late int")
    rows = labels.running_iv(df, ["x"], ["y"]).orderBy("bin").collect()
    assert rows[0].bin == -1 and rows[0].range is None and sum(r.n for r in rows) == 31 and abs(rows[-1].iv_running - sum(r.iv for r in rows)) < 1e-4
    assert labels.iv_summary(labels.running_iv(df, ["x"], ["y"])).first().iv == rows[-1].iv_running
    by = labels.labels_by_bin(df, "x", ["y", "late"], "late", 4).collect()
    assert sum(r.n for r in by if r.label == "late") == 20 and sum(r.n for r in by if r.label == "y") == 30
    points = spark.createDataFrame([(0.0, 0.5), (0.5, 0.8), (1.0, 1.0)], "fpr double, tpr double")
    assert labels.area_by_steps(points).first().auc == 0.9


def test_oriented_sweep_turns_a_score(spark):
    df = spark.createDataFrame([(float(i), int(i < 5)) for i in range(10)], "s double, y int")
    assert all(r.turned for r in curves.oriented_points(df, "s", "y").collect())
    assert curves.oriented_points(df, "s", "y").agg(F.max("distance")).first()[0] == 1.0
    assert not curves.oriented_points(df.withColumn("s", -F.col("s")), "s", "y").first().turned


def test_chi2_p_values(spark):
    from ledgerlens.functions.scalars import chi2_p

    stats = [0.0, 1e-6, 0.5, 3.841459, 10.0, 40.0, 79.9, 100.0]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in stats], "s double").select(chi2_p(F.col("s"))).collect()]
    assert np.allclose(got, [math.erfc(math.sqrt(s / 2)) for s in stats], atol=1e-12)


def test_service_from_json(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(a), "ab"[i % 2], int(a + rng.normal() > 0), i) for i, a in enumerate(rng.normal(size=400))]
    df = spark.createDataFrame(rows, "id long, a double, c string, y int, t int")
    config = json.loads('{"label": "y", "ident": ["id"], "features": ["a", "c"], "time": "t", "method": "oot", "test_share": 0.25, "transform": {"few": 3}, "model": {"kind": "lr"}, "folds": 2}')
    service = models.TrainService(config)
    made = service.fit(df)
    figures = {r.part: r.auc for r in made["figures"].collect()}
    assert figures["train"] > 0.8 and figures["test"] > 0.75 and made["folds"].count() == 4 and made["summary"].count() == 4
    assert service.predict(df).count() == 400
    with pytest.raises(ValueError, match="fit comes first"):
        models.TrainService(config).predict(df)
    with pytest.raises(ValueError, match="two folds"):
        models.train_and_test(df, ["a"], "y", ["id"], folds=1)


def test_balanced_and_early_stopping_models(spark):
    df = spark.createDataFrame([(i, float(i % 50), int(i % 50 > 44)) for i in range(500)], "id long, a double, y int")
    plain, balanced = (models.fitted(df, ["a"], "y", "lr", balance=b) for b in (False, True))
    mean = lambda m: models.scored(m, df).agg(F.avg("score")).first()[0]
    assert mean(balanced) > mean(plain)
    stopped = models.fitted(df.where("id % 5 > 0"), ["a"], "y", "gbt", df.where("id % 5 = 0"), maxIter=30, maxDepth=2, seed=1)
    assert stopped.stages[-1].getNumTrees < 30
    chunked, n = models.imbalance_chunks(df, "y", ["id"])
    sizes = {r.chunk: r["count"] for r in chunked.groupBy("chunk").count().collect()}
    assert n == 9 and sizes.pop(None) == 50 and max(sizes.values()) - min(sizes.values()) <= 1


def test_evaluation_of_one_class_and_counts(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (None, 1)], "x double, y int")
    found = encode.count_encode(df.select("x"), "x", df.select("x"), log=False).collect()
    assert sorted(r.encoded for r in found) == [1.0, 2.0, 2.0]
    assert evaluate.chi2_rules(df.select((F.col("x") > 5).cast("int").alias("r"), "y"), ["r"], "y", exact=True).first().chi2 is None
