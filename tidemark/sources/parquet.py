"""Folders of Parquet files as views of a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The schema of the engine's own table.
EVENTS_SCHEMA = T.StructType([T.StructField("user_id", T.LongType(), False), T.StructField("data", T.StringType())])


def read_folder(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Only `*.parquet`; an empty folder gives no rows, as the schema is given and not inferred."""
    return spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)


def view_name(name: str) -> str:
    """A name as one that Spark takes whatever its characters."""
    return "`" + name.replace("`", "``") + "`"


def parquet_view(spark: SparkSession, path: str, schema: T.StructType, name: str) -> DataFrame:
    df = read_folder(spark, path, schema)
    df.createOrReplaceTempView(view_name(name))
    return df


def has_parquet(spark: SparkSession, path: str) -> bool:
    """Looks through Spark's file system, so that remote folders work."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(folder) and any(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(folder))


def with_nano_time(spark: SparkSession, path: str, schema: T.StructType, column: str) -> DataFrame:
    """Files whose timestamps are in nanoseconds: read as integers and cut to microseconds."""
    raw = T.StructType([T.StructField(f.name, T.LongType()) if f.name == column else f for f in schema])
    own = spark.newSession()  # the setting holds for a session, and other reads must not see it
    own.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    df = read_folder(own, path, raw)
    return df.withColumn(column, F.expr(f"cast(timestamp_micros({column} div 1000) as timestamp_ntz)"))


def write_folder(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Sink: any of Spark's formats (parquet, csv, json, orc)."""
    writer = df.write.format(fmt).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
