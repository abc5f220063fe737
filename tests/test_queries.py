"""Every registered query against its SQL twin, as the driver compares them: columns by name, rows in any order."""

import math

import duckdb
import pytest

from tidemark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.001"


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    return repr(x + 0.0) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, duck, sf, name):
    got = catalog.QUERIES[name](spark, sf)
    sql = catalog.ORACLES[name].rstrip()
    columns = sorted(got.columns)
    assert columns == sorted(duck.sql(sql).columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = sorted(tuple(map(cell, r)) for r in duck.sql(f"SELECT {quoted} FROM ({sql}) q").fetchall())
    assert sorted(tuple(map(cell, r)) for r in got.select(*columns).collect()) == want


def test_every_query_has_a_twin_and_the_entry_runs(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_outer_joins_take_the_whole_tables(spark, duck, sf, how):
    """Against the tables themselves, without the twin."""
    customers = {k for (k,) in duck.sql("SELECT c_custkey FROM customer").fetchall()} | {-1}
    orders = [*duck.sql("SELECT o_orderkey, o_custkey FROM orders").fetchall(), (-1, -2), (-2, None)]
    want = [(c, o) for o, c in orders if c in customers]
    if how != "right":
        want += [(c, None) for c in customers - {c for _, c in orders}] + [(None, None)]
    if how != "left":
        want += [(None, o) for o, c in orders if c not in customers]
    got = [tuple(r) for r in catalog.QUERIES[f"j4_{how}_join"](spark, sf).select("c_custkey", "o_orderkey").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["m5_rolling_volatility", "m6_max_drawdown", "m7_metrics_suite"])
def test_metrics_with_values_up_to_zero(spark, tmp_path, name):
    """Zeros, a negative value and a null among the prices, also as the first of a type."""
    values = {"a": [2.0, 3.0, 0.0, 5.0, *[1.0 + i % 7 for i in range(40)]], "b": [0.0, 0.0, 4.0, 3.0], "c": [-0.0, -2.0, -1.0, 3.0, None, 5.0], "d": [7.0] * 30 + [0.0], "e": [0.0]}
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01' + INTERVAL {i} MINUTE, '{t}', {'NULL' if v is None else v}::DOUBLE)" for t, vs in values.items() for i, v in enumerate(vs))
    con = duckdb.connect()
    con.sql(f"CREATE TABLE events AS SELECT * FROM (VALUES {rows}) e(event_id, ts, event_type, value)")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    quoted = ", ".join(f'"{c}"' for c in got.columns)
    want = sorted(tuple(map(cell, r)) for r in con.sql(f"SELECT {quoted} FROM ({catalog.ORACLES[name]}) q").fetchall())
    assert sorted(tuple(map(cell, r)) for r in got.collect()) == want
