"""What a relational database holds: tables, columns, their types here, and names to register them by."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import types as T

log = logging.getLogger(__name__)

# The database's names of types that are read, and Spark's types for them.
TYPES = {
    "smallint": T.ShortType(),
    "int2": T.ShortType(),
    "integer": T.IntegerType(),
    "int4": T.IntegerType(),
    "bigint": T.LongType(),
    "int8": T.LongType(),
    "real": T.FloatType(),
    "float4": T.FloatType(),
    "double precision": T.DoubleType(),
    "float8": T.DoubleType(),
    "boolean": T.BooleanType(),
    "bool": T.BooleanType(),
    "text": T.StringType(),
    "character varying": T.StringType(),
    "varchar": T.StringType(),
    "character": T.StringType(),
    "bpchar": T.StringType(),
    "bytea": T.BinaryType(),
    "timestamp without time zone": T.TimestampNTZType(),
    "timestamp": T.TimestampNTZType(),
    "date": T.DateType(),
}


@dataclass(frozen=True)
class ColumnRecord:
    schema: str
    table: str
    column: str
    data_type: str
    udt_name: str = ""
    nullable: bool = True


@dataclass(frozen=True)
class TableSchema:
    schema: str
    name: str
    fields: tuple[T.StructField, ...]


def spark_type(data_type: str, udt_name: str = "") -> T.DataType | None:
    """Either name decides, in any case; None for a type that isn't read."""
    return TYPES.get(data_type.lower()) or TYPES.get(udt_name.lower())


def group_columns(records: Iterable[ColumnRecord]) -> list[TableSchema]:
    """Tables in the records' order. Columns of types that aren't read are left out with a warning, and so are tables without
    any other. Columns whose names differ by case alone get a number, as names are compared without case."""
    tables: dict[tuple[str, str], list[T.StructField]] = {}
    for r in records:
        fields = tables.setdefault((r.schema, r.table), [])
        kind = spark_type(r.data_type, r.udt_name)
        if kind is None:
            log.warning("%s.%s.%s: type %s is not read; the column is left out", r.schema, r.table, r.column, r.data_type)
            continue
        taken = {f.name.lower() for f in fields}
        name = unused(r.column, taken, "_")
        if name != r.column:
            log.warning("%s.%s.%s: another column differs by case alone; it is called %s", r.schema, r.table, r.column, name)
        fields.append(T.StructField(name, kind, r.nullable, {"source": r.column}))
    for (schema, table), fields in tables.items():
        if not fields:
            log.warning("%s.%s has no column that can be read and is left out", schema, table)
    return [TableSchema(s, t, tuple(f)) for (s, t), f in tables.items() if f]


def unused(name: str, taken: set[str], joint: str) -> str:
    """The name, or the first `name<joint><number>` that isn't taken; case doesn't count."""
    out, n = name, 2
    while out.lower() in taken:
        out, n = f"{name}{joint}{n}", n + 1
    return out


def by_priority(tables: Iterable[TableSchema], schemas: Sequence[str]) -> list[TableSchema]:
    """Schemas in the order listed, others last; then by table name."""
    rank = {s: i for i, s in reversed(list(enumerate(schemas)))}
    return sorted(tables, key=lambda t: (rank.get(t.schema, len(rank)), t.name))


def registration_names(tables: Sequence[TableSchema], reserved: Iterable[str] = ()) -> list[tuple[str, TableSchema]]:
    """The first table of a name keeps it; later ones, and those with a reserved name, are `schema__table`."""
    taken = {r.lower() for r in reserved}
    out = []
    for t in tables:
        name = t.name
        if name.lower() in taken:
            name = unused(f"{t.schema}__{t.name}", taken, "_")
            log.warning("%s.%s: the name is taken; it is called %s", t.schema, t.name, name)
        taken.add(name.lower())
        out.append((name, t))
    return out
