"""Base frames of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import table

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with y (returned) and a discount that is null where it is 0."""
    return table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int")).withColumn("discount_or_null", F.nullif(F.col("l_discount"), F.lit(0.0)))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with day, benchmark flag (before 11 January 2024) and pass flag."""
    e = table(spark, sf_dir, "events")
    return e.select("*", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz")).alias("bench"), ((F.col("event_type") == "purchase") | (F.col("value") > 50)).cast("int").alias("passed"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: customer, created, finish (last shipment), expected (30 days later)."""
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").cast("date").alias("finish"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("created"))
    return orders.join(shipped, "o_orderkey").withColumn("expected", F.date_add("created", 30))
