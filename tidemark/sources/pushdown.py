"""Filters as SQL text for a source that may return too many rows but never too few.

Whatever is translated is checked again above the scan, so a translation must only be implied by the filter. Text is never
ordered at the source, whose collation may differ from byte order; what can't be written safely isn't translated.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import datasource as D
from pyspark.sql import types as T

from .jdbc import literal as text_literal
from .jdbc import quoted

_COMPARE = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}
_ORDERED = (D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual)


def literal(value: object) -> str | None:
    """bool, int, finite float or text without NUL; None for all else, null included."""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return (str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)) if math.isfinite(value) else None
    if isinstance(value, str):
        return None if "\x00" in value else text_literal(value)
    return None


def _column(path: Sequence[str], schema: T.StructType) -> str | None:
    return quoted(path[0]) if len(path) == 1 and path[0] in schema.names else None


def translate(f: D.Filter, schema: T.StructType) -> str | None:
    """SQL for a filter, or None."""
    if isinstance(f, D.Not):
        if isinstance(f.child, D.EqualTo):
            column, value = _column(f.child.attribute, schema), literal(f.child.value)
            return f"{column} <> {value}" if column and value else None
        inner = translate(f.child, schema) if isinstance(f.child, (D.In, D.IsNull, D.IsNotNull)) else None
        return f"NOT ({inner})" if inner else None
    column = _column(getattr(f, "attribute", ()), schema)
    if column is None:
        return None
    if isinstance(f, D.IsNull):
        return f"{column} IS NULL"
    if isinstance(f, D.IsNotNull):
        return f"{column} IS NOT NULL"
    if isinstance(f, D.In):
        values = [literal(v) for v in f.value]
        return f"{column} IN ({', '.join(values)})" if values and all(values) else None
    if type(f) in _COMPARE:
        if isinstance(f, _ORDERED) and (isinstance(f.value, (str, bool)) or isinstance(schema[f.attribute[0]].dataType, T.StringType)):
            return None
        value = literal(f.value)
        return f"{column} {_COMPARE[type(f)]} {value}" if value else None
    return None


def scan_sql(schema_name: str | None, table: str, columns: Sequence[str], conjuncts: Sequence[str] = (), limit: int | None = None) -> str:
    """The statement of a scan; without columns, one that counts its rows."""
    relation = quoted(table) if schema_name is None else f"{quoted(schema_name)}.{quoted(table)}"
    tail = (f" WHERE {' AND '.join(f'({c})' for c in conjuncts)}" if conjuncts else "") + (f" LIMIT {limit}" if limit is not None else "")
    if not columns:
        return f"SELECT COUNT(*) FROM (SELECT 1 FROM {relation}{tail}) AS t"
    return f"SELECT {', '.join(map(quoted, columns))} FROM {relation}{tail}"


def pushed_limit(limit: int | None, translated: int, total: int) -> int | None:
    """A limit may go to the source only if every filter did."""
    return limit if translated == total else None
