"""Tables and files: delimited text the way Hive writes it, cached copies, uploads, libSVM and libFFM rows, records and reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, FractionalType, IntegralType, StringType, StructType


def clean_text(df: DataFrame, separator: str = "\x01") -> DataFrame:
    """Line ends and separators in text columns become blanks."""
    return df.withColumns({f.name: F.regexp_replace(f.name, f"[\n{separator}]", " ") for f in df.schema if isinstance(f.dataType, StringType)})


def write_delimited(df: DataFrame, path: str, separator: str = "\x01", mode: str = "overwrite") -> None:
    clean_text(df, separator).write.mode(mode).option("sep", separator).option("nullValue", "\\N").csv(path)


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, separator: str = "\x01") -> DataFrame:
    return spark.read.schema(schema).option("sep", separator).option("nullValue", "\\N").csv(path)


#: Bytes of the greatest upload, and the ends of its name: fixed values.
UPLOAD_BYTES, UPLOAD_TYPES = 16 * 1024 * 1024, ("csv",)


def _checked_file(spark: SparkSession, path: str, types: tuple[str, ...] = UPLOAD_TYPES, most: int | None = None) -> str:
    """The path, if something is there, its name ends in one of the types, and it holds at most so many bytes."""
    if "." not in path or path.rstrip("/").rsplit(".", 1)[1] not in types:
        raise ValueError(f"{path}: the name must end in {' or '.join(types)}")
    if not _there(spark, path):
        raise FileNotFoundError(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    if most is not None and size > most:
        raise ValueError(f"{path} has {size} bytes, {most} are allowed")
    return path


def read_upload(spark: SparkSession, path: str, most: int | None = UPLOAD_BYTES) -> DataFrame:
    """A CSV with header, `?` for null and blanks around fields; other types, and files of more than ``most`` bytes, are refused."""
    path = _checked_file(spark, path, most=most)
    return spark.read.option("header", True).option("inferSchema", True).option("nullValue", "?").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def numeric_where_possible(df: DataFrame) -> DataFrame:
    """Casts a text column to double if that fails for none of its values."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    if not texts:
        return df
    bad = df.agg(*(F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in texts)).first()
    return df.withColumns({c: F.col(c).cast("double") for c in texts if not bad[c]})


def table_columns(spark: SparkSession, name: str) -> list[str]:
    """The columns of a table of the catalogue; its name may be in any case."""
    return spark.table(name.lower()).columns


def hive_type(kind: DataType) -> str:
    """bigint, double, boolean or string."""
    for types, name in ((IntegralType, "bigint"), (FractionalType, "double"), (BooleanType, "boolean")):
        if isinstance(kind, types):
            return name
    return "string"


def hive_schema(df: DataFrame) -> str:
    """Columns and types of a frame for a CREATE TABLE."""
    return ", ".join(f"`{f.name}` {hive_type(f.dataType)}" for f in df.schema)


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def cached_copy(spark: SparkSession, source: str, schema: StructType | str, copy: str, overwrite: bool = False, separator: str = "\x01") -> DataFrame:
    """A delimited table as parquet at ``copy``, read from there if it has been made before."""
    if overwrite or not _there(spark, f"{copy}/_SUCCESS"):
        read_delimited(spark, source, schema, separator).write.mode("overwrite").parquet(copy)
    return spark.read.parquet(copy)


def create_table(spark: SparkSession, name: str, query: str) -> DataFrame:
    """Makes a table anew from a query, and reads it."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} USING parquet AS {query}")
    return spark.table(name)


def table_from_file(spark: SparkSession, name: str, path: str, separator: str = ",", overwrite: bool = False, encoding: str = "UTF-8", location: str | None = None) -> DataFrame:
    """Adds the rows of a CSV with header to a table, by place, and reads the table.

    The table is made if it isn't there, below ``location`` if one is given;
    ``overwrite`` drops an earlier one. Whole numbers are bigint, all other
    columns are the file's texts; a file of other columns than the table has
    is refused.
    """
    reader = spark.read.option("header", True).option("sep", separator).option("encoding", encoding)
    guessed = reader.option("inferSchema", True).csv(_checked_file(spark, path)).schema
    schema = ", ".join(f"`{f.name}` {'bigint' if isinstance(f.dataType, IntegralType) else 'string'}" for f in guessed)
    name = name.lower()
    if overwrite:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    place = " LOCATION '{}'".format(location.replace("'", "\\'")) if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet{place}")
    if len(spark.table(name).columns) != len(guessed):
        raise ValueError(f"{name} has {len(spark.table(name).columns)} columns, {path} has {len(guessed)}")
    reader.option("inferSchema", False).schema(schema).csv(path).write.insertInto(name)
    return spark.table(name)


def settings_of(spark: SparkSession, path: str, name: str) -> dict:
    """The entry of that name in a JSON file of settings, such as one for ``models.TrainService``."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])[name]


def first_rows(spark: SparkSession, paths: list[str], most: int = 10_000) -> DataFrame:
    """At most so many rows over all files."""
    return spark.read.parquet(*paths).limit(most)


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as JSON objects, one a line."""
    df.write.mode(mode).json(path)


def write_report(df: DataFrame, path: str, name: str) -> None:
    """A table of figures below ``path``, under its name, replacing an earlier one."""
    df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One text column as text without header: libSVM or libFFM rows."""
    df.select(column).write.mode("overwrite").text(path)


def read_libsvm(spark: SparkSession, path: str, scaled: bool = True) -> DataFrame:
    """(label, indices, values) of `y i:v ...` lines; values are divided by their sum of squares if ``scaled``."""
    parts = F.split(F.trim("value"), " +")
    tokens = F.transform(F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda t: t.contains(":")), lambda t: F.split(t, ":"))
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, F.lit(0)).cast("double").alias("label"), F.transform(tokens, lambda t: t[0].cast("long")).alias("indices"), F.transform(tokens, lambda t: t[1].cast("double")).alias("values"))
    if not scaled:
        return rows
    norm = F.aggregate("values", F.lit(0.0), lambda s, v: s + v * v)
    return rows.withColumn("_norm", norm).withColumn("values", F.transform("values", lambda v: F.when(F.col("_norm") == 0, v).otherwise(v / F.col("_norm")))).drop("_norm")


def libsvm_line(label: Column, values: list[Column]) -> Column:
    """`y 1:v 2:v ...` without zeros and nulls."""
    parts = [F.when(v.isNotNull() & (v != 0), F.concat(F.lit(f"{i}:"), v.cast("string"))) for i, v in enumerate(values, 1)]
    return F.concat_ws(" ", label.cast("string"), *parts)
