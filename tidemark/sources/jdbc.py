"""Relational tables through Spark's JDBC reader.

Each table is registered as a subquery that lists its columns, so that columns of other types never travel and, on PostgreSQL,
text is compared in the `C` collation: Spark pushes comparisons of text to the source and doesn't check them again, and
byte order is the one order in which both sides agree. Reads are lazy, one connection a partition.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .introspection import ColumnRecord, TableSchema, by_priority, group_columns, registration_names
from .parquet import view_name

log = logging.getLogger(__name__)

#: Second names that some tables are registered by.
ALIASES: Mapping[str, str] = {"my_pg_table": "pg_table"}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@dataclass(frozen=True)
class Partitioning:
    """Read a table in parallel over ranges of a numeric or time column."""

    column: str
    lower: str
    upper: str
    partitions: int


@dataclass(frozen=True)
class Database:
    """`dialect` is postgresql or derby."""

    url: str
    dialect: str = "postgresql"
    options: Mapping[str, str] = field(default_factory=dict)
    pushdown: bool = True

    def read(self, spark: SparkSession, table: str, partitioning: Partitioning | None = None) -> DataFrame:
        """`table`: a name or a subquery with an alias."""
        reader = spark.read.format("jdbc").options(**self.options).option("url", self.url).option("dbtable", table)
        reader = reader.option("pushDownPredicate", str(self.pushdown).lower()).option("preferTimestampNTZ", "true")
        if partitioning:
            p = partitioning
            reader = reader.options(partitionColumn=p.column, lowerBound=p.lower, upperBound=p.upper, numPartitions=str(p.partitions))
        return reader.load()

    def query(self, spark: SparkSession, sql: str) -> DataFrame:
        """The result of a statement that the database runs, as in a connection check."""
        return self.read(spark, f"({sql}) q")

    def records(self, spark: SparkSession, schemas: Sequence[str]) -> list[ColumnRecord]:
        names = ", ".join(map(literal, schemas))
        rows = self.query(spark, COLUMNS[self.dialect].format(names=names)).collect()  # a row for each column of the catalog
        cells = sorted(tuple(r) for r in rows)
        return [ColumnRecord(s, t, c, str(d).lower(), str(u).lower(), str(n).upper() in ("YES", "TRUE")) for s, t, _, c, d, u, n in cells]


_PAIR = re.compile(r"\s*([A-Za-z_]+)\s*=\s*(?:'((?:[^'\\]|\\.)*)'|(\S*))")


def from_uri(uri: str) -> Database:
    """A JDBC address from a postgres:// one or from key=value pairs, whose values may stand in single quotes. User, password and
    all further parameters (sslmode, application_name, ...) travel as options, so none is lost."""
    if uri.startswith(("postgres://", "postgresql://")):
        u = urlsplit(uri)
        parts = dict(parse_qsl(u.query, keep_blank_values=True))
        parts |= {"host": u.hostname or "localhost", "port": str(u.port or 5432), "dbname": u.path.lstrip("/"), "user": unquote(u.username or ""), "password": unquote(u.password or "")}
    else:
        parts = {k: re.sub(r"\\(.)", r"\1", q) if q else v for k, q, v in _PAIR.findall(uri)}
    place = {k: parts.pop(k, "") for k in ("host", "port", "dbname")}
    options = {k: v for k, v in parts.items() if v}
    return Database(f"jdbc:postgresql://{place['host'] or 'localhost'}:{place['port'] or '5432'}/{place['dbname']}", options=options)


# Base tables only, so views are left out.
COLUMNS = {
    "postgresql": (
        "SELECT c.table_schema, c.table_name, c.ordinal_position, c.column_name, c.data_type, c.udt_name, c.is_nullable "
        "FROM information_schema.columns c JOIN information_schema.tables t "
        "ON t.table_schema = c.table_schema AND t.table_name = c.table_name "
        "WHERE t.table_type = 'BASE TABLE' AND c.table_schema IN ({names})"
    ),
    "derby": (
        "SELECT s.SCHEMANAME, t.TABLENAME, c.COLUMNNUMBER, c.COLUMNNAME, CAST(c.COLUMNDATATYPE AS VARCHAR(64)) AS DATA_TYPE, '' AS UDT_NAME, "
        "CASE WHEN CAST(c.COLUMNDATATYPE AS VARCHAR(64)) LIKE '%NOT NULL%' THEN 'NO' ELSE 'YES' END AS IS_NULLABLE "
        "FROM SYS.SYSCOLUMNS c JOIN SYS.SYSTABLES t ON c.REFERENCEID = t.TABLEID JOIN SYS.SYSSCHEMAS s ON t.SCHEMAID = s.SCHEMAID "
        "WHERE t.TABLETYPE = 'T' AND s.SCHEMANAME IN ({names})"
    ),
}

# Derby's names for types that the other dialect calls otherwise.
DERBY = {"double": "double precision", "char": "character", "varchar": "character varying", "long varchar": "text", "clob": "text"}


def _plain(record: ColumnRecord) -> ColumnRecord:
    base = record.data_type.removesuffix(" not null").split("(")[0].strip()
    return ColumnRecord(record.schema, record.table, record.column, DERBY.get(base, base), record.udt_name, record.nullable)


def introspect(spark: SparkSession, database: Database, schemas: Sequence[str]) -> list[TableSchema]:
    records = database.records(spark, schemas)
    if database.dialect == "derby":
        records = list(map(_plain, records))
    return by_priority(group_columns(records), schemas)


def relation(table: TableSchema, dialect: str) -> str:
    """The subquery that stands for a table."""

    def column(f: T.StructField) -> str:
        source = quoted(f.metadata.get("source", f.name))
        collated = f'{source} COLLATE "C"' if dialect == "postgresql" and isinstance(f.dataType, T.StringType) else source
        return collated if collated == quoted(f.name) else f"{collated} AS {quoted(f.name)}"

    return f"(SELECT {', '.join(map(column, table.fields))} FROM {quoted(table.schema)}.{quoted(table.name)}) t"


def register(
    spark: SparkSession, database: Database, schemas: Sequence[str], reserved: Sequence[str] = (), aliases: Mapping[str, str] = ALIASES, partitioning: Mapping[str, Partitioning] | None = None
) -> dict[str, TableSchema]:
    """A view for each table; no table at all is no error. An alias is a second view over a second read."""
    tables = introspect(spark, database, schemas)
    if not tables:
        log.warning("no tables in the schemas %s", ", ".join(schemas))
    out: dict[str, TableSchema] = {}
    for name, table in registration_names(tables, reserved):
        database.read(spark, relation(table, database.dialect), (partitioning or {}).get(name)).createOrReplaceTempView(view_name(name))
        out[name] = table
    for name, alias in aliases.items():
        found = next((t for n, t in out.items() if n.lower() == name), None)
        if found and alias not in out and alias not in reserved:
            database.read(spark, relation(found, database.dialect)).createOrReplaceTempView(view_name(alias))
            out[alias] = found
    return out


def rows_fetched(df: DataFrame) -> int:
    """Runs the query and returns how many rows its leaf scans read from their sources, by Spark's own metrics."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if hasattr(node, "plan") and node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        children = node.children()
        if children.size() == 0:
            metric = node.metrics().get("numOutputRows")
            total += metric.get().value() if metric.isDefined() else 0
        todo += [children.apply(i) for i in range(children.size())]
    return total
