"""A Spark data source over a Python database driver (here sqlite3), with filters pushed but checked again by Spark.

`spark.dataSource.register(SqliteSource)`, then `spark.read.format("tidemark_sqlite").schema(...).options(path=..., table=...)`.
The file must be one that every executor can open.

With `pushdown` a relation is good for one query: Spark 4.1 keeps the filters that a query pushed with the relation and lets a later
query without any use them. `read_table` makes a new relation each time.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from .pushdown import scan_sql, translate

_AFFINITY = {"integer": T.LongType(), "real": T.DoubleType(), "text": T.StringType(), "blob": T.BinaryType(), "boolean": T.BooleanType()}


class SqliteSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_sqlite"

    def schema(self) -> T.StructType:
        with sqlite3.connect(self.options["path"]) as con:
            columns = con.execute("SELECT name, type, \"notnull\" FROM pragma_table_info(?)", (self.options["table"],)).fetchall()
        return T.StructType([T.StructField(n, _AFFINITY[k.lower()], not strict) for n, k, strict in columns if k.lower() in _AFFINITY])

    def reader(self, schema: T.StructType) -> D.DataSourceReader:
        return _Reader(self.options, schema)


class _Reader(D.DataSourceReader):
    """Options: pushdown (default false), partitions and partition_column (an integer column) for parallel reads."""

    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema, self.conjuncts = dict(options), schema, []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if self.options.get("pushdown", "false").lower() == "true" and (sql := translate(f, self.schema)):
                self.conjuncts.append(sql)
            yield f  # Spark checks every filter again

    def partitions(self) -> list[D.InputPartition]:
        return [D.InputPartition(i) for i in range(int(self.options.get("partitions", "1")))]

    def read(self, partition: D.InputPartition) -> Iterator[tuple]:
        n = int(self.options.get("partitions", "1"))
        own = list(self.conjuncts)
        if n > 1:
            column = '"' + self.options["partition_column"].replace('"', '""') + '"'
            own.append(f"COALESCE(ABS({column}) % {n}, 0) = {int(partition.value)}")
        sql = scan_sql(None, self.options["table"], self.schema.names, own)
        flags = [i for i, f in enumerate(self.schema) if isinstance(f.dataType, T.BooleanType)]
        with sqlite3.connect(self.options["path"]) as con:
            for row in con.execute(sql):
                if flags:
                    row = tuple(bool(v) if i in flags and v is not None else v for i, v in enumerate(row))
                yield row


def read_table(spark: SparkSession, path: str, table: str, **options: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format(SqliteSource.name()).options(path=path, table=table, **options).load()
