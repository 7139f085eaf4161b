"""Plans and thresholds at sizes that no test table has."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, common, decontaminate, language, near_dups, token_counts, tool_calls


def test_chances_at_ten_billion_rows():
    n = 10**10
    share = common.below(n, 750) / common.DRAWS
    assert abs(share * n - 750) < 1e-6 and common.below(n * 10**4, 750) > 0
    assert common.below(750, 750) == common.below(0, 5) == common.DRAWS


def test_samples_of_kinds(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 100, "rare").otherwise("often").alias("kind"))
    got = {r.kind: r["count"] for r in common.sample_of(df, 500, kind="kind").groupBy("kind").count().collect()}
    assert got["rare"] == 100 and 400 < got["often"] < 600
    assert 400 < common.sample_of(df, 500).count() < 600 and common.sample_of(df.limit(0), 5).count() == 0


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "abc def " * 3 + chr(97 + i % 6), f"l{min(i % 8, 5)}") for i in range(400)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert len(model.languages) == 3 and "l5" in model.languages
    assert {r.lang_pred for r in language.predict(docs, model).collect()} <= set(model.languages)


def test_scans_of_many_blocks_meet_many_tasks(spark):
    assert token_counts.scan_tasks(15 << 30, 8) == 240 and token_counts.scan_tasks(0, 8) == 32
    blocks = spark.range(7500).select(F.lit("file:///x").alias("path"), F.col("id").alias("block"))
    parts = blocks.repartition(token_counts.scan_tasks(7500 << 21, 8), "path", "block").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 16 and max(r["count"] for r in parts) < 150


@pytest.mark.parametrize("runs", [2, 10])
def test_long_blanks_take_linear_time(runs):
    text, plain = ("a" + " " * 99_999) * runs, bpe.encoder()
    plain.encode("warm")
    began = time.perf_counter()
    ids = plain.encode(text)
    assert time.perf_counter() - began < 2
    from tokenizers import Tokenizer

    assert ids.tolist() == Tokenizer.from_file(bpe.default_path()).encode(text, add_special_tokens=False).ids


def test_only_strays_of_a_bucket_are_repeated(spark):
    named = spark.range(20_001).select(F.lit(1).alias("band"), F.lit(5).cast("long").alias("hash"), F.col("id").alias("node"), F.lit(300).cast("long").alias("shingles"), F.when(F.col("id") == 20_000, 7).otherwise(0).cast("long").alias("label"))
    named = named.union(named.where("node < 50").withColumn("band", F.lit(2)))
    rows = near_dups._dealt(named).where("band = 1")
    blocks = -(-20_000 // near_dups.BLOCK)
    assert rows.where("label = 0").count() == 20_000 and rows.where("label = 7").count() == blocks + 1
    groups = rows.groupBy("i", "j").agg(F.count("*").alias("n"), F.count_if(F.expr("label = 7")).alias("strays")).collect()
    assert all(g.strays == 1 for g in groups) and max(g.n for g in groups) < 2 * near_dups.BLOCK
    assert near_dups._dealt(named).where("band = 2").count() == 0


def test_every_pair_of_different_labels_meets_once(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    named = spark.range(60).select(F.lit(1).alias("band"), F.lit(5).cast("long").alias("hash"), F.col("id").alias("node"), F.lit(1).cast("long").alias("shingles"), (F.col("id") % 7 % 4).alias("label"))
    met = []
    for _, g in near_dups._dealt(named).toPandas().groupby(["i", "j"]):
        across = g.i.iloc[0] != g.j.iloc[0]
        pairs = [(a, b) for a in g.itertuples() for b in g.itertuples() if (a.side == 0 and b.side == 1 if across else a.node < b.node)]
        met += [tuple(sorted((a.node, b.node))) for a, b in pairs if a.label != b.label]
    assert sorted(met) == sorted((a, b) for a in range(60) for b in range(a + 1, 60) if a % 7 % 4 != b % 7 % 4)


def test_windows_beyond_the_broadcast(spark, monkeypatch):
    """The bitmap lets every hit pass and few others; both ways give the same rows on the given tables."""
    windows = spark.range(5_000).select(F.xxhash64("id").alias("hash"))
    n_bits = 1 << 18
    bits = decontaminate.hash_bits(windows, n_bits)
    assert bits.count() == n_bits // decontaminate.ROW_BITS and {r.n for r in bits.select(F.size("bits").alias("n")).collect()} == {decontaminate.ROW_BITS // 64}
    passed = lambda first, last: decontaminate.may_hit(spark.range(first, last).select(F.xxhash64("id").alias("hash")), bits, n_bits, F.lit(False)).count()
    assert passed(0, 5_000) == 5_000
    assert passed(5_000, 105_000) < 100_000 * 5_000 / n_bits * 1.2
    docs, bench = (common.table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "benchmark"))
    figures = lambda: sorted(map(str, decontaminate.scan(docs, bench).select("doc_id", "n_words", "n_hit", "items_sha256").collect()))
    want = figures()
    assert any("n_hit=0" not in r for r in want)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert figures() == want


def test_layers_of_many_waits(spark, monkeypatch):
    """Layers 8 wide and 200 deep are halved in each round, not settled one by one."""
    wide, deep, rounds = 8, 200, []
    write = tool_calls.measured
    monkeypatch.setattr(tool_calls, "measured", lambda df, name, **figures: rounds.append(name) or write(df, name, **figures))
    rows = spark.range(wide * deep).select(F.col("id").cast("string").alias("call_id"), F.transform(F.sequence(F.lit(1), F.lit(wide)), lambda k: ((F.floor(F.col("id") / wide) - 1) * wide + k - 1).cast("string")).alias("after"))
    assert {int(r.call_id): r.level for r in tool_calls.levels(rows).collect()} == {i: i // wide for i in range(wide * deep)}
    assert len(rounds) <= 11
