"""Records, plug-ins, sketches, the field-aware machine, chosen rounds, wide frames, streams and splits against plain versions."""

from __future__ import annotations

import json
import subprocess
import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ledgerlens.operators import binning, ffm, labels, models, monitor, profile, ranks, transform
from ledgerlens.plans.registry import QUERIES, SQL
from ledgerlens.sources import records
from ledgerlens.streaming import monitor as streaming

# --- models ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["lr", "fm"])
def test_models_score_after_an_observation(spark, kind):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, float(x), int(x + rng.normal() > 0)) for i, x in enumerate(rng.normal(size=300))], "id long, x double, y int")
    seen = Observation()
    df.observe(seen, F.count("*").alias("n")).collect()
    assert seen.get["n"] == 300
    model = models.fitted(df, ["x"], "y", kind, maxIter=5)
    assert models.figures(models.scored(model, df), "y", part="all").first()["auc"] > 0.7


def test_gradient_of_the_field_aware_machine():
    rng = np.random.default_rng(1)
    machine = ffm.Machine(0.3, rng.normal(size=20), rng.normal(size=(20, 3, 2)))
    fields, indices, values = np.array([[0, 1, 2], [0, 1, 1]]), np.array([[1, 5, 9], [1, 1, 7]]), np.array([[1.0, 0.5, 2.0], [1.0, 0.0, -1.5]])
    y = np.array([1.0, 0.0])
    loss = lambda m: ffm._log_loss(y, m.margins(fields, indices, values))
    slope = 1 / (1 + np.exp(-machine.margins(fields, indices, values))) - y
    used, linear, latent = machine.gradient(fields, indices, values, slope)
    for i, u in enumerate(used):
        for kind, at, got in [("linear", (u,), linear[i])] + [("latent", (u, f, k), latent[i, f, k]) for f in range(3) for k in range(2)]:
            moved = []
            for d in (1e-6, -1e-6):
                m = ffm.Machine(machine.bias, machine.linear.copy(), machine.latent.copy())
                getattr(m, kind)[at] += d
                moved.append(loss(m))
            assert abs((moved[0] - moved[1]) / 2e-6 - got) < 1e-5


def test_field_aware_machine_learns_what_a_sum_of_weights_cannot(spark):
    rng = np.random.default_rng(2)
    rows = [(f"{int((a + b) % 2)} 0:{a}:1 1:{10 + b}:1 2:{20 + c}:{v:.3f}",) for a, b, c, v in zip(*(rng.integers(0, 4, 3000) for _ in range(3)), rng.random(3000), strict=True)]
    df = spark.createDataFrame(rows, "line string").repartition(4)
    parts = [df.where(F.pmod(F.xxhash64("line", F.lit(s)), F.lit(5)).isin(k)) for s, k in ((1, [0, 1, 2]), (1, [3]), (1, [4]))]
    machine, curve = ffm.ffm_fit(parts[0], parts[1], buckets=64, epochs=40)
    assert min(v for _, v in curve) < 0.2 < curve[0][1] and np.isclose(min(v for _, v in curve), curve[[v for _, v in curve].index(min(v for _, v in curve))][1])
    scored = ffm.ffm_scores(machine, parts[2]).withColumn("y", F.split("line", " ")[0].cast("int"))
    assert models.figures(scored, "y", part="test").first()["auc"] > 0.97
    odd = spark.createDataFrame([("1 7:3:1",), ("",), (None,), ("x y z",), ("0:1:1",)], "line string")
    assert ffm.ffm_scores(machine, odd).where("score between 0 and 1").count() == 5
    with pytest.raises(ValueError, match="validation"):
        ffm.ffm_fit(parts[0], parts[1].where("false"), buckets=64, epochs=1)


def test_chosen_rounds_are_the_mean_of_the_least_losses(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, float(x), float(z), int(x * z + rng.normal() > 0.8)) for i, (x, z) in enumerate(rng.normal(size=(400, 2)))], "id long, x double, z double, y int")
    curve, chosen, model, made = models.boosted_rounds(df, ["x", "z"], "y", ["id"], folds=3, rounds=8, maxDepth=3, seed=1)
    losses = {}
    for r in curve.collect():
        losses.setdefault(r["fold"], {})[r["round"]] = r["loss"]
    best = [min(f, key=lambda k: (f[k], k)) for f in losses.values()]
    assert all(len(f) == 8 for f in losses.values()) and chosen == max(1, round(sum(best) / 3)) and model.stages[-1].getNumTrees == chosen
    assert {(r["part"], r["rounds"]) for r in made.where("part = 'refit'").collect()} == {("refit", chosen)}


def test_several_classes_are_predicted_once(spark):
    rng = np.random.default_rng(4)
    kinds = ["a"] * 240 + ["b"] * 60 + ["c"] * 60
    df = spark.createDataFrame([(i, float({"a": 0, "b": 4, "c": -4}[k] + rng.normal()), k) for i, k in enumerate(kinds)] + [(1000, 4.0, None)], "id long, x double, k string")
    found, classes = models.class_scores(df, ["x"], "k", ["id"], folds=3)
    rows = found.collect()
    assert classes == ["a", "b", "c"] and len(rows) == 361 == len({r.id for r in rows})
    assert all(abs(sum(r.scores) - 1) < 1e-6 and r.predicted == classes[r.scores.index(max(r.scores))] for r in rows)
    assert sum(r.k == r.predicted for r in rows) > 330 and next(r.predicted for r in rows if r.id == 1000) == "b"
    with pytest.raises(ValueError, match="classes"):
        models.class_scores(df.where("k = 'a'"), ["x"], "k", ["id"])


# --- records ---------------------------------------------------------------------------------------------------------


def test_records_come_back_whole(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb", 1.5, True), (None, None, None, None), (3, "ü🙂", -2.0, False), (3, "ü🙂", -2.0, False)], "i long, s string, d double, b boolean")
    path = f"file://{tmp_path}/r"
    records.write_framed(df.repartition(2), path)
    assert sorted(map(str, records.read_framed(spark, path, df.schema).collect())) == sorted(map(str, df.collect()))
    records.write_framed(df, path, "append")
    assert records.read_framed(spark, path, "i long, extra string").where("extra is null").count() == 8
    records.write_framed(df.where("i = 1"), path)
    assert records.read_framed(spark, path, df.schema).count() == 1


@pytest.mark.parametrize(("files", "most", "want"), [(1, 1, 1), (1, 1000, 50), (2, 1000, 100), (10, 75, 75)])
def test_reader_limits(spark, tmp_path, files, most, want):
    for f in range(files):
        (tmp_path / f"{f}.records").write_bytes(b"".join(records.framed(json.dumps({"i": i}).encode()) for i in range(50)))
    assert records.read_framed(spark, f"file://{tmp_path}", "i long", most).count() == want


def test_damaged_and_changing_records_are_refused(spark, tmp_path):
    good = records.framed(b'{"i": 1}')
    for name, data in {"cut": good[:-2], "length": b"\x01" + good[1:], "body": good[:14] + b"x" + good[15:], "type": good + records.framed(b'{"i": "one"}')}.items():
        path = tmp_path / name
        path.write_bytes(data)
        with pytest.raises(Exception, match="checksum|cut off|but a record has"):
            records.read_framed(spark, f"file://{path}", "i long").collect()


# --- plug-ins and sketches ---------------------------------------------------------------------------------------------


def test_parsers_and_statistics_of_ones_own(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x", "c": true}', "g"), (2, None, "g"), (3, "[1]", "h"), (4, "{", "h"), (5, '{"a": "2.5"}', None)], "feature long, value string, g string")
    got = monitor.parse_with(df.withColumnRenamed("feature", "id"), "value", ["id"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "a", 1.0), (1, "b", None), (1, "c", None), (5, "a", 2.5)], key=str)
    x = spark.createDataFrame([(k, float(v)) for k, n in (("p", 25), ("q", 1), (None, 3)) for v in range(n)] + [("z", None)], "k string, v double")
    found = {r.k: r for r in monitor.aggregated(x, ["k"], "v", {"most": F.max, "mid": monitor.trimmed_mean(0.2)}).collect()}
    assert (found["p"].most, found["p"].mid) == (24.0, 12.0) and found["q"].mid == 0.0 and found[None].mid == 1.0 and found["z"].mid is None and found["z"].most is None


@pytest.mark.parametrize("name", ["base", "extended", "frames", "further", "registry"])
def test_plans_are_imported_in_any_order(name):
    """A task that unpickles a query's function imports its module first."""
    work = f"import ledgerlens.plans.{name}; from ledgerlens.plans.base import QUERIES; assert {{'woe_qcut', 'json_features', 'custom_features', 'monitor_whole'}} <= set(QUERIES)"
    subprocess.run([sys.executable, "-c", work], cwd=Path(__file__).parents[1], check=True, timeout=120)


def test_custom_features_of_odd_texts(spark, tmp_path):
    texts = [None, "null", "3", "[1]", "{}", '{"a": 1, "a": 2, "b": "x", "b": 3}', '{"a": true, "b": null, "c": {"d": 1}, "e": [1]}', '{"n_fields": 7}', '{"a": 1e400, "b": -0, "c": "-0", "d": -0.0, "e": NaN}']
    texts += [json.dumps({"a": "9" * 5000}), '{"a": ' + "9" * 400 + ', "b": -' + "9" * 5000 + "}", '{"a": 9007199254740993, "b": "9007199254740993", "c": 123456789012345678901234567890}']
    texts += [json.dumps({"a b": t}, ensure_ascii=False) for t in ("", " 2.5 ", "\t7\n", "1_000", "1__0", "nan", "-inf", "\u0661", "\u00a08", "0x10", "1.", ".5", "+5", "5d", "1e3", "\x1c5")]
    spark.createDataFrame(list(enumerate(texts)), "event_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got, want = QUERIES["custom_features"](spark, str(tmp_path)).collect(), con.sql(SQL["custom_features"]).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_merged_sketches_are_near(spark):
    df = spark.range(200_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 50_000).cast("double").alias("v"))
    row = monitor.merged_sketches(monitor.sketches_by_time(df, ["day"], "v"), [], [0.05, 0.5, 0.99]).first()
    assert row.n == 200_000 and abs(row.distinct - 50_000) < 2500 and np.abs(np.array(row["quantiles"]) / 50_000 - [0.05, 0.5, 0.99]).max() < 0.01


# --- wide frames, splits, draws, streams ---------------------------------------------------------------------------------


def test_two_thousand_columns(spark):
    base = [((F.xxhash64("id", F.lit(i)) % 1000) / 7).alias(f"c{i}") for i in range(500)]
    df = spark.range(60).select(*base)
    wide = df.select("*", *((F.col(f"c{i}") * (3 + i)).alias(f"d{i}") for i in range(500)), *(F.when(F.col(f"c{i}") > -100, F.col(f"c{i}")).alias(f"e{i}") for i in range(500)), *((-F.col(f"c{i}") / 9).alias(f"f{i}") for i in range(500)))
    found = profile.duplicate_groups(wide, wide.columns)
    nulls = {f"e{i}" for i in range(500)}
    assert all(found[f"{p}{i}"] == f"c{i}" for p in "cdf" for i in range(500))
    assert sum(found[e] == e for e in nulls) > 400


def plain_groups(pairs, least):
    out, low, held = [], None, 0
    for v, n in sorted(pairs):
        low, held = v if low is None else low, held + n
        if held >= least:
            out.append((low, v, held))
            low, held = None, 0
    return out + ([(low, v, held)] if held else [])


@pytest.mark.parametrize("seed", range(4))
def test_optimal_groups_against_trying_each_size(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(float(v), int(n)) for v, n in enumerate(rng.pareto(0.8, 60) * 10 + 1)]
    df = spark.createDataFrame([*pairs, *([(None, 4)] if seed % 2 else [])], "value double, n long")
    first, bins, total = seed % 2, 6, sum(n for _, n in pairs)
    least = -(-total // bins)
    for b in range(bins + 1, total + 2):
        tried = -(-total // b) + (1 if b == bins + 1 else 0)
        if len(plain_groups(pairs, tried)) + first > bins:
            break
        least = tried
    got = sorted((r.grp - first, r.low, r.high, r.n) for r in binning.optimal_groups(df, bins).collect() if r.low is not None)
    assert [g[1:] for g in got] == plain_groups(pairs, least) and [g[0] for g in got] == list(range(len(got)))
    assert [(r.low, r.high, r.n) for r in binning.greedy_groups(df, 30).orderBy("grp").collect()] == plain_groups(pairs, 30)


def test_noise_is_that_of_the_sequence(spark):
    df = spark.createDataFrame(list(zip("abcbcc", [1, 0, 1, 1, 0, 1], strict=True)), "x string, y int")
    codes = {r["value"]: r["code"] for r in transform.TargetEncoder().table(df, "x", "y")[0].collect()}
    assert np.allclose([codes[c] for c in "acb"], [1.03627629, 0.58939665, 0.55091546], atol=2e-8)


def test_noise_of_a_million_values(spark, monkeypatch):
    rows = spark.range(1_000_000).select(F.col("id").cast("string").alias("value"), F.lit(0.0).alias("encoded"), F.col("id").alias("place"))
    made = rows.repartitionByRange(7, "place").sortWithinPartitions("place").mapInArrow(lambda b: transform._with_noise(b, 0.05, 10), "value string, code double")
    got = made.orderBy(F.col("value").cast("long")).toPandas()["code"].to_numpy()
    assert np.array_equal(got, np.random.RandomState(10).normal(0, 0.05, 1_000_000))


def test_state_of_the_stream_ends(spark, tmp_path):
    days = lambda *ds: [(f"2024-01-{d:02d} 12:00:00", "a", 5.0) for d in ds]
    for i, rows in enumerate([days(1, 1, 2), days(10, 11), days(11, 12), days(1, 20)]):
        spark.createDataFrame(rows, "ts string, hue string, score double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
        time.sleep(1.1 if i < 3 else 0)
    edges = spark.createDataFrame([("a", [0.0, 1.0, 10.0])], "hue string, edges array<double>")
    progress = []
    got = {str(r.start)[:10]: r.n for r in streaming.drained(spark, str(tmp_path / "s"), edges, "hue", "score", "ts", files=1, progress=progress).collect()}
    # The last batch's row of the first day is days behind the watermark and dropped.
    assert got == {"2024-01-01": 2, "2024-01-02": 1, "2024-01-10": 1, "2024-01-11": 2, "2024-01-12": 1, "2024-01-20": 1}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress if p["stateOperators"])
    assert dropped == 1 and held[-1] < max(held)


def test_parts_grow_with_the_rows(spark):
    df = spark.range(3000).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    parts = ranks.in_parts(df, ["k"], "v", 3000, 50).groupBy("_part").count().collect()
    assert len(parts) >= 50 and max(r["count"] for r in parts) <= 150
    assert ranks.row_quantiles(df, ["k"], [0.5], "v").first()["q"] == [1499.5]


def test_reused_splits_count_unseen_values(spark):
    """Values that no row with the special label holds, nulls too, have no bin; a null that one holds is bin -1."""
    rows = [(float(i % 8), 1.0 if i % 8 < 4 else None, i % 2, None if i % 8 < 4 else 1) for i in range(80)] + [(None, None, 1, 1), (None, None, None, None)]
    df = spark.createDataFrame(rows, "x double, z double, y int, w int").withColumn("special", F.when(F.col("x") < 4, F.col("y")))
    got = {(r.label, r.feature, r.bin): (r.n, r.positives) for r in labels.reused_splits(df, ["x", "z"], ["y", "w", "special"], "special", 4).collect()}
    assert got["y", "x", None] == (41, 21) and got["w", "x", None] == (41, 41) and ("special", "x", None) not in got
    assert [got["y", "x", i] for i in range(4)] == [(10, 0), (10, 10), (10, 0), (10, 10)]
    # Of z only the value 1 was seen with the special label, in one bin; its nulls were not.
    assert got["y", "z", 0] == (40, 20) and got["y", "z", None] == (41, 21)
    nulls = df.withColumn("special", F.coalesce("special", F.lit(0)))
    assert {r.bin for r in labels.reused_splits(nulls, ["z"], ["y"], "special").collect()} == {-1, 0}
    assert labels.reused_splits(df.where("false"), ["x"], ["y"], "special").count() == 0
