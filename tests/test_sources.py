"""Files and tables: uploads, cached copies, libSVM, records, reports, streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import monitor
from ledgerlens.plans.frames import events
from ledgerlens.sources import files
from ledgerlens.streaming.monitor import binned_counts

SF = "/root/testdata/sf0.001"


def test_upload_with_question_marks_and_blanks(spark, tmp_path):
    (tmp_path / "u.csv").write_text("a, b ,c\n1 , x ,?\n?,  y,2.5\n")
    df = files.read_upload(spark, str(tmp_path / "u.csv"))
    assert df.columns == ["a", "b", "c"] and [tuple(r) for r in df.collect()] == [(1, "x", None), (None, "y", 2.5)]


def test_uploads_of_other_types_or_sizes_are_refused(spark, tmp_path):
    for name in ("u.txt", "csv"):
        (tmp_path / name).write_text("a\n1\n")
        with pytest.raises(ValueError, match="must end in csv"):
            files.read_upload(spark, str(tmp_path / name))
    (tmp_path / "u.csv").write_text("a\n1\n")
    assert files.read_upload(spark, str(tmp_path / "u.csv"), most=4).count() == 1
    with pytest.raises(ValueError, match="has 4 bytes, 3 are allowed"):
        files.read_upload(spark, str(tmp_path / "u.csv"), most=3)
    with pytest.raises(FileNotFoundError):
        files.read_upload(spark, str(tmp_path / "none.csv"))


def test_table_from_files(spark, tmp_path):
    where = str(tmp_path / "t")
    for name, text in {"a.csv": "i,x\n1,1.50\n2,\n", "b.csv": "k,other\n3,z\n", "c.csv": "i\n1\n", "d.csv": "i\tx\n7\té\n"}.items():
        (tmp_path / name).write_text(text, encoding="latin-1")
    read = lambda name, **how: sorted(map(tuple, files.table_from_file(spark, "From_File", str(tmp_path / name), location=where, **how).collect()))
    assert read("a.csv", overwrite=True) == [(1, "1.50"), (2, None)]
    assert read("b.csv") == [(1, "1.50"), (2, None), (3, "z")]
    assert dict(spark.table("from_file").dtypes) == {"i": "bigint", "x": "string"}
    with pytest.raises(ValueError, match="has 2 columns, .* has 1"):
        read("c.csv")
    assert (7, "é") in read("d.csv", separator="\t", encoding="ISO-8859-1")
    spark.sql("DROP TABLE from_file")


def test_settings_by_name(spark, tmp_path):
    (tmp_path / "chains.json").write_text(json.dumps({"one": {"label": "y"}, "two": {}}, indent=2))
    assert files.settings_of(spark, str(tmp_path / "chains.json"), "one") == {"label": "y"}
    with pytest.raises(KeyError):
        files.settings_of(spark, str(tmp_path / "chains.json"), "three")


def test_numbers_in_text_columns(spark):
    df = spark.createDataFrame([("1", "1", "x"), ("2.5", None, "2"), (None, "-3", None)], "a string, b string, c string")
    assert dict(files.numeric_where_possible(df).dtypes) == {"a": "double", "b": "double", "c": "string"}


def test_cached_copy_is_made_once(spark, tmp_path):
    source, copy = str(tmp_path / "t"), str(tmp_path / "copy")
    first = spark.createDataFrame([(1, "a")], "i int, s string")
    files.write_delimited(first, source)
    assert files.cached_copy(spark, source, first.schema, copy).count() == 1
    files.write_delimited(first.union(first), source)
    assert files.cached_copy(spark, source, first.schema, copy).count() == 1
    assert files.cached_copy(spark, source, first.schema, copy, overwrite=True).count() == 2
    files.write_delimited(first, source, mode="append")
    assert files.read_delimited(spark, source, first.schema).count() == 3


def test_tables_of_the_catalogue(spark):
    spark.range(3).selectExpr("id", "cast(id as double) x", "id > 1 b", "'s' s").createOrReplaceTempView("some_rows")
    made = files.create_table(spark, "made_rows", "SELECT * FROM some_rows")
    assert made.count() == 3 and files.table_columns(spark, "MADE_rows") == ["id", "x", "b", "s"]
    assert files.create_table(spark, "made_rows", "SELECT * FROM some_rows WHERE id = 0").count() == 1
    assert files.hive_schema(made) == "`id` bigint, `x` double, `b` boolean, `s` string"
    spark.sql("DROP TABLE made_rows")


def test_libsvm_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, 3.0, 4.0), (0, 0.0, None), (1, None, 2.0)], "y int, a double, b double").select(files.libsvm_line(F.col("y"), [F.col("a"), F.col("b")]).alias("line"))
    assert [r.line for r in df.collect()] == ["1 1:3.0 2:4.0", "0", "1 2:2.0"]
    files.write_lines(df, "line", str(tmp_path / "l"))
    rows = {tuple(r.indices): (r.label, r["values"]) for r in files.read_libsvm(spark, str(tmp_path / "l")).collect()}
    assert rows == {(1, 2): (1.0, [3 / 25, 4 / 25]), (): (0.0, []), (2,): (1.0, [0.5])}
    assert {tuple(r["values"]) for r in files.read_libsvm(spark, str(tmp_path / "l"), scaled=False).collect()} == {(3.0, 4.0), (), (2.0,)}


def test_records_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    files.write_records(df, str(tmp_path / "r"))
    found = sorted(line for f in (tmp_path / "r").glob("part-*.json") for line in f.read_text().splitlines())
    assert [json.loads(x) for x in found] == [{"i": 1, "s": "a"}, {"i": 2}]
    for n in (2, 1):
        files.write_report(df.limit(n), str(tmp_path), "report")
    assert spark.read.parquet(f"{tmp_path}/report").count() == 1


def test_drift_counts_as_a_stream(spark, tmp_path):
    rows = events(spark, SF).select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"), "bench")
    edges = monitor.psi_edges(rows.where("bench"), "event_type", "value")
    rows.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = binned_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), edges, "event_type", "value", "ts")
    query = stream.writeStream.format("memory").queryName("drift").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("drift").agg(F.sum("n"), F.count("*")).first()
    assert got[0] == rows.count() and got[1] == binned_counts(rows, edges, "event_type", "value", "ts").count()


def test_json_fields(spark):
    df = spark.createDataFrame([(1, '{"a": 1.5, "b": "x", "c": "", "d": null}'), (2, "no"), (3, None)], "id int, s string")
    assert sorted((r.id, r.feature, r.value) for r in monitor.parse_features(df, "s", ["id"]).where("value is not null").collect()) == [(1, "a", 1.5)]
    long = monitor.parse_features(df, "s", ["id"])
    assert long.count() == 4


def test_negative_scores_are_refused(spark):
    df = spark.createDataFrame([("a", -1.0)], "h string, s double")
    with pytest.raises(Exception, match="must not be negative"):
        monitor.psi_edges(df, "h", "s").collect()
