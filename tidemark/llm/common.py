"""Helpers that the operators of this folder share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where none is set, a local session gets a folder of its own; a cluster is refused, as
    its executors don't share local folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Whether Spark deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that Spark hands to a worker at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write `df` once as Parquet into the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs only the tasks of the current
    step, and keeps column pruning for what reads it next. The shuffles of the write go
    with it, as nothing reads them again; else they stay on disk until the driver happens
    to collect its garbage.

    `batch`: no worker is handed more rows at once, as executor and worker each hold a batch outside the heap.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    before = {CLEANUP: spark.conf.get(CLEANUP, "false"), BATCH: spark.conf.get(BATCH)}
    spark.conf.set(CLEANUP, "true")
    if batch and not 0 < int(before[BATCH]) <= batch:
        spark.conf.set(BATCH, str(batch))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame | None) -> None:
    """Delete materialized tables that nothing will read any more."""
    for df in tables:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()} if df is not None else ():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """The shuffle width that the cluster is set to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*cols: Column) -> Column:
    """128-bit key of a row's content; nulls differ from empty strings."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in cols]
    return F.md5(F.concat_ws("\x1f", *parts))


def before(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Add `name`: the sum of `value` over the rows of the same group that stand before a row.

    No task holds a whole group: each is dealt over buckets by a hash of the ordering columns; sums run within
    (group, bucket), and a bucket's offset is the sum of the group's earlier buckets, which needs one small row for each
    group and bucket. Repeated rows, which have one hash, are counted before they are dealt and written out at the end. The
    order is by bucket, then by the ordering columns; repeated rows stand in any order.
    """
    n, names = partitions(df.sparkSession), df.columns
    counted = df.withColumn("__tm_v", value.cast("long")).groupBy(*names, "__tm_v").agg(F.count(F.lit(1)).alias("__tm_n"))
    dealt = counted.withColumn("__tm_b", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    weight = F.col("__tm_v") * F.col("__tm_n")
    keys = [F.col(g).alias(f"__tm_g{i}") for i, g in enumerate(group)]
    named = [f"__tm_g{i}" for i in range(len(group))]
    sums = dealt.groupBy(*keys, F.col("__tm_b").alias("__tm_o")).agg(F.sum(weight).alias("__tm_t"))
    earlier = W.partitionBy(*(named or [F.lit(0)])).orderBy("__tm_o").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("__tm_s", F.coalesce(F.sum("__tm_t").over(earlier), F.lit(0))).drop("__tm_t")
    local = W.partitionBy(*group, "__tm_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    on = [F.col("__tm_b") == F.col("__tm_o"), *[F.col(g).eqNullSafe(F.col(k)) for g, k in zip(group, named, strict=True)]]
    out = dealt.withColumn("__tm_l", F.coalesce(F.sum(weight).over(local), F.lit(0))).join(offsets, on, "inner")
    placed = out.select(*names, "__tm_v", "__tm_n", (F.col("__tm_l") + F.col("__tm_s")).alias("__tm_a"))
    return repeated(placed, "__tm_n", "__tm_i").select(*names, (F.col("__tm_a") + F.col("__tm_i") * F.col("__tm_v")).alias(name))


#: Copies of one row that a generator makes at once.
COPIES = 10_000


def repeated(df: DataFrame, count: str, index: str) -> DataFrame:
    """Each row as often as its `count` says, with a number from 0 as `index`."""
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / COPIES)))
    many = df.withColumn("__tm_p", parts)
    start = F.col("__tm_p") * COPIES
    return many.withColumn(index, F.explode(F.sequence(start, F.least(F.col(count), start + COPIES) - 1))).drop("__tm_p")


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Add `name`: a gapless number from 0 within each group; repeated rows get different numbers."""
    return before(df, group, order, F.lit(1), name)
