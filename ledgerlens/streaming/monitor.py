"""PSI counts as a stream: fixed benchmark edges, windows of a day, late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.stats import bin_of
from ledgerlens.session import scratch


def binned_counts(stream: DataFrame, edges: DataFrame, hue: str, score: str, ts: str, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """(window, hue, bin, n); ``edges`` is the small table of psi_edges."""
    rows = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).join(F.broadcast(edges), hue)
    at = F.greatest(bin_of(F.col(score), F.col("edges")), F.lit(1)).alias("bin")
    return rows.groupBy(F.window("_ts", width).alias("window"), hue, at).agg(F.count("*").alias("n"))


def drained(spark: SparkSession, source: str, edges: DataFrame, hue: str, score: str, ts: str, late: str = "1 day", width: str = "1 day", files: int | None = None, progress: list | None = None) -> DataFrame:
    """The counts of all files that a folder of parquet holds now, as the stream leaves them in the shared folder.

    Each batch writes the counts that it changed below its own number, so a
    repeated batch overwrites itself, and the last batch of a count holds. The
    state of a window ends once the watermark, ``late`` behind the newest row
    of the batches before, has passed it; rows that come a batch later are dropped.
    ``files`` are read a batch; ``progress`` takes the batches' figures.
    """
    out, state = scratch(spark, "drift"), scratch(spark, "drift-state")
    reader = spark.readStream.schema(spark.read.parquet(source).schema)
    counts = binned_counts((reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source), edges, hue, score, ts, late, width)
    counts = counts.select(F.col("window.start").alias("start"), hue, "bin", "n")
    query = counts.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")).trigger(availableNow=True).start()
    query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in counts.schema)}, batch long").parquet(out)
    return rows.groupBy("start", hue, "bin").agg(F.max_by("n", "batch").alias("n"))
