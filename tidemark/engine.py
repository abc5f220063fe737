"""One session in which folders of Parquet and the tables of a database are queried together."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cache import ResultCache, cacheable
from .config import Config
from .errors import NotReadOnlyError, ResultTooLargeError, UnsupportedTypeError
from .functions import shims
from .sources.jdbc import Database, from_uri, register
from .sources.parquet import EVENTS_SCHEMA, parquet_view, view_name

_SHOW_TABLES = re.compile(r"\s*show\s+tables\s*;?\s*$", re.IGNORECASE)

_CHANGES = re.compile(r"Command|Insert|Overwrite|Append|Create|Drop|Alter|Delete|Update|Merge|Truncate|Replace|Rename|Set[A-Z]|Add|Load|Cache|Refresh|Repair|Analyze|Recover|Comment|Write|Call|Execute|Declare")
_SHOWS = re.compile(r"(Show|Describe|Explain)")


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


# The types that results may have at the edge.
RESULT_TYPES = (T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.StringType, T.TimestampNTZType, T.DateType)


class Engine:
    def __init__(self, spark: SparkSession, cache: ResultCache | None = None, allow_write: bool = False):
        self.spark, self.cache, self.allow_write = spark, ResultCache() if cache is None else cache, allow_write
        self.tables: dict[str, T.StructType | None] = {}
        shims.register(spark)

    @classmethod
    def configured(cls, spark: SparkSession, settings: Config) -> Engine:
        """With the sources and limits that the settings name."""
        engine = cls(spark, ResultCache(settings.cache_max_entries, settings.cache_ttl_seconds))
        engine.add_parquet("lake", settings.parquet_path)
        engine.add_database(from_uri(settings.postgres_uri.reveal()), settings.postgres_schemas)
        engine.publish_schema()
        return engine

    def add_parquet(self, name: str, path: str, schema: T.StructType = EVENTS_SCHEMA) -> None:
        parquet_view(self.spark, path, schema, name)
        self.tables[name] = schema

    def add_view(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(view_name(name))
        self.tables[name] = df.schema

    def add_database(self, database: Database, schemas: Sequence[str] = ("public",)) -> list[str]:
        found = register(self.spark, database, schemas, reserved=tuple(self.tables))
        self.tables |= {name: T.StructType(list(t.fields)) for name, t in found.items()}
        return list(found)

    def show_tables(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in sorted(self.tables)], "table_name string")

    def publish_schema(self) -> None:
        """`information_schema.tables`, which Spark lacks, as a table of the names registered so far."""
        self.spark.sql("CREATE DATABASE IF NOT EXISTS information_schema")
        self.show_tables().write.mode("overwrite").saveAsTable("information_schema.tables")

    def query(self, sql: str) -> DataFrame:
        """Lazily; only statements that read, unless writing is allowed."""
        if _SHOW_TABLES.match(sql):
            return self.show_tables()
        text = sql.strip().rstrip(";")
        if not self.allow_write and not self.reads(text):
            raise NotReadOnlyError("only statements that read are allowed")
        return self.spark.sql(text)

    def reads(self, sql: str) -> bool:
        """By the statement's parsed plan, which is not run: no command, insertion or other change anywhere in it, unless it is one that
        shows or describes. Text that doesn't parse reads nothing."""
        try:
            plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        except Exception:  # a parser's error, which running the statement would raise too
            return True
        todo = [plan]
        while todo:
            node = todo.pop()
            name = node.getClass().getName().rsplit(".", 1)[-1]
            if _CHANGES.search(name) and not _SHOWS.match(name):
                return False
            if name.startswith("Explain"):
                todo.append(node.logicalPlan())
            children = [*_items(node.children()), *(c for c in _items(node.innerChildren()) if hasattr(c, "innerChildren"))]
            todo += children
        return True

    def fetch(self, sql: str, limit: int | None = None) -> pa.Table:
        """The result, from the cache if it is there; results with types that have no place at the edge are refused, and so are those of
        more rows than `limit` (as many as the cache takes for an entry, unless given), of which no more than one too many is read."""
        if cacheable(sql) and (found := self.cache.get(sql)) is not None:
            return found
        generation = self.cache.generation
        df = self.query(sql)
        most = self.cache.max_rows if limit is None else limit
        for f in df.schema:
            if not isinstance(f.dataType, RESULT_TYPES):
                raise UnsupportedTypeError(f"column {f.name}: {f.dataType.simpleString()} can't be sent")
        table = df.limit(most + 1).toArrow()
        if table.num_rows > most:
            raise ResultTooLargeError(f"the result has over {most} rows; read it with query() or batches()")
        if cacheable(sql):
            self.cache.set(sql, table, generation)
        return table

    def batches(self, sql: str) -> Iterator[Row]:
        """The rows of a result of any size, a partition at a time on the driver."""
        return self.query(sql).toLocalIterator()

    def health(self, database: Database) -> bool:
        return database.query(self.spark, "SELECT 1 AS ok" if database.dialect == "postgresql" else "SELECT 1 AS OK FROM SYSIBM.SYSDUMMY1").select(F.lit(True)).first()[0]
