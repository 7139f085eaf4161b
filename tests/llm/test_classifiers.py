"""The trained operators against plain versions of their methods, and on odd inputs."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import common, kernels, language, quality, toxicity
from ledgerlens.session import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF, "labels")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeated rows, a long text, a null id and extra columns with clashing names."""
    texts = [None, "", "!!! ...", "One two", "Ünï çode ñ 日本語 🙂", "same", "same", "x " * 20_000]
    rows = [(i, t, "en", 1.0, "a", True) for i, t in enumerate(texts)] + [(None, "no id", None, None, None, None), (3, "One two", "en", 2.0, "b", False)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, label string, held_out boolean")


def crc(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m


def grams(text, sizes):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return {low[i : i + n] for n in sizes for i in range(len(low) - n + 1)}


def test_samples_are_bounded_and_whatever_the_order(spark):
    rows = [(i % 50, f"text {i}") for i in range(500)] + [(7, "again")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(50)] + [(4, 1, None), (None, 1, None), (5, None, None)], "doc_id long, quality int, toxic int")
    a = common.labelled_sample(docs, labels, "quality", 5, 0, 1000)
    b = common.labelled_sample(docs.repartition(7), labels.repartition(3), "quality", 5, 0, 1000)
    assert a.equals(b) and len(a) == sum(crc(i, 5) != 0 for i in range(50)) and a["label"].to_pylist().count(1) == sum(crc(i, 5) != 0 for i in range(50) if i % 2 or i == 4)
    assert common.labelled_sample(docs, labels, "toxic", 5, 0, 1000).num_rows == 0
    many = spark.range(20_000).selectExpr("id as doc_id", "id % 2 as quality")
    assert 300 < common.labelled_sample(many.selectExpr("doc_id", "'t' as text"), many, "quality", 5, 0, 400).num_rows < 500


def test_a_rare_language_is_learned(spark):
    rows = [(i, f"the and of {i}", "aa") for i in range(3000)] + [(10_000 + i, f"ñu çå {i}", "zz") for i in range(8)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=100)
    assert model.languages == ["aa", "zz"]


def test_kernel_against_plain_sets():
    texts = ["the cat sat", "der hund war da", "the dog", "el perro", ""]
    found = [ids for _, ids in language._presence(*kernels.utf8(pa.array(texts)))]
    for i, a in enumerate(texts):
        assert abs(len(found[i]) - len(grams(a, language.SIZES))) <= 1
        for j, b in enumerate(texts):
            assert abs(len(np.intersect1d(found[i], found[j])) - len(grams(a, language.SIZES) & grams(b, language.SIZES))) <= 1


def test_language_scores_are_those_of_ridge_regression():
    """With every text a landmark, the folded matrix gives what kernel ridge regression in the dual does with the whole kernel."""
    rng = np.random.default_rng(3)
    texts = [np.sort(rng.choice(4000, 60, replace=False)).astype(np.int32) + (0 if i % 2 else 500) for i in range(30)]
    names = ["a" if i % 2 else "b" for i in range(30)]
    model = language.train(texts, names)
    k = np.array([[len(np.intersect1d(x, y)) / 60 for y in texts] for x in texts])
    y = np.array([1.0 if n == "a" else -1.0 for n in names])
    dual = k @ np.linalg.solve(k + language.RIDGE * np.eye(30), y)
    got = np.array([model.folded[t].sum(axis=0)[0] / np.sqrt(60) for t in texts])
    assert np.abs(got - dual).max() < 1e-3


def test_languages_of_held_out_rows(spark, docs):
    rows = language.predict(docs, language.fit(docs)).join(docs.select("doc_id", "lang").distinct(), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95


def test_wanted_languages(odd):
    model = language.train([np.array([1, 2, 3]), np.array([7, 8])], ["aa", "bb"])
    kept = lambda **how: sorted(str(r.doc_id) for r in language.keep_known(odd, model, **how).collect())
    assert kept() == sorted(["3", "3", "4", "5", "6", "7", "None"]) and kept(wanted=[]) == [] and kept(least=1.1) == []
    assert language.keep_known(odd, language.Model()).count() == 7 and language.keep_known(odd.where("false"), model).count() == 0


def test_ratios_and_significance_against_plain_counts():
    texts = ["you idiot", "idiot here", "nice day", "a nice place", "idiot nice", "day"]
    y = np.array([1, 1, 0, 0, 1, 0])
    features = list(toxicity._features(pa.chunked_array([texts])))
    c1, c0 = toxicity.document_counts(features, y)
    ratio, strong = toxicity.log_count_ratios(c1, c0, 3, 3, least=2, prior=1.0), toxicity.significance(c1, c0, 3, 3)
    bags = [grams(t, toxicity.SIZES) for t in texts]
    seen = Counter()
    for gram in {"idiot", "nice", "day"}:
        ids = next(toxicity._features(pa.chunked_array([[gram]])))
        a, b = sum(gram in bag for bag, v in zip(bags, y, strict=True) if v), sum(gram in bag for bag, v in zip(bags, y, strict=True) if not v)
        share = (a + b) / 6
        want = np.log((a + share) / 4) - np.log((b + share) / 4)
        whole = [i for i in ids if (c1[i], c0[i]) == (a, b)]
        seen[gram] = len(whole)
        g = 2 * sum(o * np.log(o / e) for o, e in ((a, 3 * share), (b, 3 * share), (3 - a, 3 * (1 - share)), (3 - b, 3 * (1 - share))) if o)
        assert all(abs(ratio[i] - (want if a + b >= 2 else 0)) < 1e-5 and abs(strong[i] - g) < 1e-9 for i in whole)
    assert all(seen.values())


def test_logistic_regression_finds_the_minimum():
    """The gradient of the stated loss is nearly zero where training ends."""
    rng = np.random.default_rng(0)
    features = [np.unique(rng.integers(0, 12, 5)).astype(np.int32) for _ in range(200)]
    y = np.array([int(3 in f) if rng.random() < 0.9 else 0 for f in features])
    scale = np.zeros(1 << toxicity.BITS, np.float32)
    scale[:12] = rng.normal(0, 1, 12)
    weight, bias = toxicity.logistic(features, scale, y, rounds=3000, rate=0.02, decay=1e-2)
    w = np.divide(weight[:12], scale[:12])
    x = np.array([[scale[i] if i in f else 0.0 for i in range(12)] for f in features])
    cost = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    error = cost * (1 / (1 + np.exp(-(x @ w + bias))) - y)
    assert np.abs(x.T @ error + 1e-2 * w).max() < 2e-3 and abs(error.sum()) < 2e-3


def held_out_recall(op, model, docs, labels, label, m, r):
    rows = op.score(docs, model).join(labels.groupBy("doc_id").agg({label: "max"}).toDF("doc_id", "y"), "doc_id").where("held_out and y is not null").collect()
    assert all(crc(row.doc_id, m) == r for row in rows)
    return np.mean([x.predicted for x in rows if x.y == 1]), np.mean([x.predicted for x in rows if x.y == 0])


def test_toxicity_of_held_out_rows(docs, labels):
    found, alarms = held_out_recall(toxicity, toxicity.fit(docs, labels), docs, labels, "toxic", 3, 1)
    assert found > 0.75 and alarms < 0.06


def test_quality_of_held_out_rows(docs, labels):
    found, alarms = held_out_recall(quality, quality.fit(docs, labels), docs, labels, "quality", 5, 0)
    assert found > 0.9 and alarms < 0.5


def test_folded_scores_are_those_of_the_network(spark):
    """The folded table gives what the mean of the vectors and the softmax give."""
    texts = ["good fine words here", "bad awful junk", "good words", "junk junk bad", ""]
    y = np.array([1, 0, 1, 0, 1])
    kept = {}
    model = quality.train(pa.chunked_array([texts]), y, keep=kept)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for i, text in enumerate(texts):
        parts = [ids[a[0] : b[0]] for _, _, kinds in quality._parts(*kernels.utf8(pa.array([text]))) for ids, a, b in kinds]
        ids = np.concatenate([*parts, np.empty(0, np.int32)]).astype(int)
        mean = kept["vectors"][ids].mean(axis=0) if len(ids) else np.zeros(quality.DIMENSIONS)
        z = kept["out"] @ mean + kept["bias"]
        assert abs(got[i] - np.exp(z[1]) / np.exp(z).sum()) < 1e-4
    assert got[0] > got[1]


@pytest.mark.parametrize("op", [quality, toxicity])
def test_scores_of_odd_inputs(spark, odd, op):
    model = op.train(pa.chunked_array([["good fine words"] * 20 + ["bad awful junk"] * 20]), np.array([1] * 20 + [0] * 20))
    rows = op.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.score, r.predicted))
    assert len(by[3]) == 1 and by[5] == by[6] and by[0] == by[1] and None in by
    assert op.score(odd.where("false"), model).count() == 0
    nothing = op.train(pa.chunked_array([[]], pa.string()), np.array([], int))
    assert {r.score for r in op.score(odd, nothing).collect()} == {0.5}
    assert op.fit(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int")).bias == 0.0
