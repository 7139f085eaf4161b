"""What the operators share: where they put files, and how they draw a bounded training sample."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.session import ship, table

__all__ = ["arrow_job", "checkpoint_dir", "crc_of_id", "discard", "labelled_sample", "looked_up", "measured", "sample_of", "shared_dir", "table", "written"]


def arrow_job(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow, with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(work, schema)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share."""
    top = checkpoint_dir(spark)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one on a local master only, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='ledgerlens-')}"
        spark.sparkContext.setCheckpointDir(top)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(top)
    return top


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read again: later steps don't repeat the work."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, dict]:
    """``written``, and aggregates over the rows that the same job works out."""
    seen = Observation()
    found = written(df.observe(seen, *(c.alias(k) for k, c in figures.items())), name)
    return found, seen.get


#: Keys that hold at least one row in so many are looked up in a broadcast table.
OFTEN = 1000


def looked_up(rows: DataFrame, facts: DataFrame, on: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """The rows with the facts of their key; ``facts`` has a key once, with how many of ``total`` rows hold it.

    Keys of at least one row in OFTEN, of which there are OFTEN at most, come
    from a broadcast table; so no task gets all rows of a common key. Rows are
    read twice, so they should be a written table. Keys aren't null.
    """
    often = F.broadcast(facts.where(F.col(weight) * OFTEN >= total))
    rest = rows.join(often.select(*on), on, "left_anti")
    return rows.join(often, on).unionByName(rest.join(facts.where(F.col(weight) * OFTEN < total).hint("merge"), on, how))


def discard(df: DataFrame) -> None:
    """Deletes the folders of a table that ``written`` made and nothing reads any more."""
    spark = df.sparkSession
    top, path_of = checkpoint_dir(spark).rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        where = path_of(folder)
        if where.toUri().getPath().startswith(path_of(top).toUri().getPath() + "/"):
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of an id's decimal digits; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def held_out(modulus: int, remainder: int, column: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id modulo ``modulus``; false for a null id."""
    return F.coalesce(F.pmod(crc_of_id(column), F.lit(modulus)) == remainder, F.lit(False))


#: Values of a sampling hash, and most kinds that a sample tells apart.
DRAWS, KINDS = 1 << 62, 1000


def below(n: int, most: int) -> int:
    """The threshold below which a hash of DRAWS values falls for about ``most`` of n rows; exact whatever n."""
    return DRAWS if n <= most else DRAWS * most // n


def sample_of(df: DataFrame, most: int, by: str = "doc_id", kind: str | None = None) -> DataFrame:
    """About ``most`` rows, or ``most`` of each ``kind``, chosen by a hash of ``by`` alone; all rows if there are fewer.

    ``by`` must not repeat (within a kind), else what is chosen has no bound.
    Of more than KINDS kinds, the commonest are sampled, by the first value of those that tie.
    """
    draw = F.xxhash64(F.col(by), F.lit(17)).bitwiseAND(F.lit(DRAWS - 1))
    if not kind:
        return df.where(draw < below(df.count(), most))
    least = F.lit(0).cast("long")
    for value, n in df.groupBy(kind).count().orderBy(F.desc("count"), kind).limit(KINDS).collect():
        least = F.when(F.col(kind).eqNullSafe(F.lit(value)), below(n, most)).otherwise(least)
    return df.where(draw < least)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: int) -> pa.Table:
    """(text, label) of about ``most`` labelled ids for training, half of each class, none of them held out.

    Ids are chosen by their hash alone, whatever their texts, so the number of
    texts that reach the driver is bounded. An id with several labels takes
    the highest, an id with several texts that of the least hash; null labels
    and texts don't count.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(modulus, remainder))
    per_id = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = sample_of(per_id.where("label in (0, 1)"), most // 2, kind="label")
    # At most about `most` ids and labels are broadcast.
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"))).alias("t"))
    return rows.orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id").select("t.text", "label").toArrow()
