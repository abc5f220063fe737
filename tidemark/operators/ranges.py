"""Windows over few names, dealt by ranges of the ordering column.

A window partitioned by a name alone has as many tasks as there are names. Here each name's rows are dealt over ranges, and a
range is given what its frames need of earlier ones: the rows just before it for trailing frames, one value for running ones.
Rows with equal order are in one range, and nulls, which come first, are in the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

#: Ranges of one name at most; they are a decision tree in the plan, so that their number is bounded.
RANGES = 256


def dealt(df: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """`df` with `__range`, an int: ranges of the ordering column of about as many rows each."""
    n = ranges or min(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or ()))
    kind = df.schema[order].dataType

    def tree(low: int, high: int) -> Column:
        """The range among those of the numbers low to high; range i starts at cut i - 1."""
        if low == high:
            return F.lit(low)
        middle = (low + high + 1) // 2
        return F.when(F.col(order) < F.lit(cuts[middle - 1]).cast(kind), tree(low, middle - 1)).otherwise(tree(middle, high))

    return df.withColumn("__range", F.when(F.col(order).isNull(), 0).otherwise(tree(0, len(cuts))))


def trailing(df: DataFrame, name: str, order: str, rows: int, columns: Callable[[WindowSpec], dict[str, Column]], ranges: int | None = None) -> DataFrame:
    """`df` with the columns that `columns` makes of an ordered window; they may look back at most `rows` rows.

    The last rows of every range, at most `rows` for each name and range, are numbered by name; a range takes the `rows` before its own.
    """
    parts = dealt(df, order, ranges)
    over = W.partitionBy(name, "__range")
    if rows > 0:
        ends = parts.withColumn("__k", F.row_number().over(over.orderBy(F.col(order).desc()))).where(F.col("__k") <= rows)
        placed = W.partitionBy(name).orderBy("__range", F.col("__k").desc())
        ends = ends.withColumn("__i", F.row_number().over(placed))
        starts = ends.groupBy(F.col(name).alias("__name"), F.col("__range").alias("__to")).agg(F.min("__i").alias("__s"))
        starts = starts.where("__s > 1").select("__name", "__to", F.explode(F.sequence(F.greatest(F.lit(1), F.col("__s") - rows), F.col("__s") - 1)).alias("__at"))
        halo = ends.join(starts, F.col(name).eqNullSafe(F.col("__name")) & (F.col("__i") == F.col("__at")), "inner")
        halo = halo.select(*df.columns, F.col("__to").alias("__range"), F.lit(False).alias("__own"))
        parts = parts.withColumn("__own", F.lit(True)).unionByName(halo)
    else:
        parts = parts.withColumn("__own", F.lit(True))
    made = parts
    for column, value in columns(over.orderBy(order)).items():
        made = made.withColumn(column, value)
    return made.where("__own").drop("__own", "__range")


def running_max(df: DataFrame, name: str, order: str, value: str, out: str, ranges: int | None = None) -> DataFrame:
    """`df` with `out`: the greatest `value` of the same name up to each row. One row a name and range goes to all its rows."""
    parts = dealt(df, order, ranges)
    tops = parts.groupBy(F.col(name).alias("__name"), F.col("__range").alias("__r")).agg(F.max(value).alias("__t"))
    earlier = W.partitionBy("__name").orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select("__name", "__r", F.max("__t").over(earlier).alias("__top"))
    own = F.max(value).over(W.partitionBy(name, "__range").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    made = parts.withColumn("__own", own).join(tops, F.col(name).eqNullSafe(F.col("__name")) & (F.col("__range") == F.col("__r")), "inner")
    return made.withColumn(out, F.greatest("__top", "__own")).select(*df.columns, out)
