import logging
import os
import random
import sqlite3
import threading
from datetime import datetime

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import config
from tidemark.cache import ResultCache, cacheable, canonical
from tidemark.engine import Engine
from tidemark.errors import ConfigError, NotReadOnlyError, ResultTooLargeError, UnsupportedTypeError
from tidemark.functions import shims
from tidemark.operators import metrics
from tidemark.sources import introspection as I
from tidemark.sources import jdbc, pushdown
from tidemark.sources.dbapi import read_table
from tidemark.streaming import changes

#: Text made of what quoting has to get right: every two of these pieces, one after the other.
PIECES = ["'", '"', "\\", "%", "_", "\n", "ß", "--", ";", " or ", "z"]
HOSTILE = sorted({a + b for a in PIECES for b in PIECES})
_PICK = random.Random(20)
#: sku, shelf, weight, frozen, remark of the shop that the sources hold.
STOCK = [(sku, _PICK.choice(["A1", "B2", "o'clock", "ü"]), _PICK.randrange(400) / 8, _PICK.random() < 0.3, _PICK.choice([None, "torn", "late; wet", "ok"])) for sku in _PICK.sample(range(5000), 320)]


def lit(x):
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


@pytest.fixture(scope="session")
def derby(spark):
    url = "jdbc:derby:memory:tidemark"
    driver = spark._jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver()
    run = driver.connect(url + ";create=true", spark._jvm.java.util.Properties()).createStatement().execute
    for statement in (
        'CREATE SCHEMA "shop"', 'CREATE SCHEMA "depot"',
        'CREATE TABLE "shop"."my_pg_table" ("sku" BIGINT NOT NULL, "origin" VARCHAR(40))',
        'CREATE TABLE "shop"."stock" ("sku" BIGINT NOT NULL, "shelf" VARCHAR(20), "weight" DOUBLE, "frozen" BOOLEAN, "remark" VARCHAR(20), "label" XML)',
        'CREATE TABLE "depot"."stock" ("ramp" SMALLINT NOT NULL, "since" DATE)', "INSERT INTO \"depot\".\"stock\" VALUES (3, '2019-05-06')",
        'CREATE TABLE "shop"."drawings" ("plan" XML)',
    ):
        run(statement)
    run(f'INSERT INTO "shop"."my_pg_table" VALUES ({STOCK[0][0]}, \'Oslo\'), ({STOCK[1][0]}, NULL), (-1, \'Quito\')')
    run('INSERT INTO "shop"."stock" ("sku", "shelf", "weight", "frozen", "remark") VALUES ' + ", ".join(f"({', '.join(map(lit, row))})" for row in STOCK))
    return url


def test_flagship_join(spark, derby, tmp_path):
    spark.createDataFrame([(STOCK[0][0], "sold"), (STOCK[2][0], "kept")], "user_id long, data string").write.parquet(str(tmp_path / "t"))
    (tmp_path / "t" / "other.json").write_text("[]")
    engine = Engine(spark)
    engine.add_parquet("log'ged", str(tmp_path / "t"))
    names = engine.add_database(jdbc.Database(derby, "derby"), ["shop", "depot"])
    assert names == ["my_pg_table", "stock", "depot__stock", "pg_table"]
    sql = "SELECT l.data, p.origin, s.weight FROM `log'ged` l JOIN my_pg_table p ON l.user_id = p.sku JOIN stock s ON s.sku = p.sku"
    assert [tuple(r) for r in engine.query(sql).collect()] == [("sold", "Oslo", STOCK[0][2])]
    assert [tuple(r) for r in engine.query(f"SELECT origin FROM pg_table WHERE sku = {STOCK[1][0]}").collect()] == [(None,)]
    assert engine.query("SELECT * FROM stock").columns == ["sku", "shelf", "weight", "frozen", "remark"]
    assert [r[0] for r in engine.query("show tables").collect()] == sorted([*names, "log'ged"])
    engine.publish_schema()
    assert sorted(r[0] for r in engine.query("SELECT table_name FROM information_schema.tables").collect()) == sorted([*names, "log'ged"])
    assert engine.health(jdbc.Database(derby, "derby"))


def test_an_empty_folder_has_no_rows(spark, tmp_path):
    engine = Engine(spark)
    engine.add_parquet("none", str(tmp_path))
    assert engine.query("SELECT * FROM none").count() == 0


def predicates():
    """(SQL, the same in Python over a row) of comparisons of every column with values from the rows and beside them, and their compounds."""
    names, pick = ("sku", "shelf", "weight", "frozen", "remark"), random.Random(21)
    compare = {"=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, ">=": lambda x, y: x >= y}
    out = []
    for i, name in enumerate(names):
        for sign in compare if name in ("sku", "weight", "shelf") else ("=", "<>"):
            v = pick.choice([r[i] for r in STOCK if r[i] is not None])
            out.append((f"{name} {sign} {lit(v)}", lambda r, i=i, v=v, f=compare[sign]: r[i] is not None and f(r[i], v)))
        some = [r[i] for r in pick.sample(STOCK, 3) if r[i] is not None]
        if some:
            out.append((f"{name} IN ({', '.join(map(lit, some))})", lambda r, i=i, some=some: r[i] in some))
        out.append((f"{name} IS NULL", lambda r, i=i: r[i] is None))
    for (a, f), (b, g) in [pick.sample(out, 2) for _ in range(6)]:
        out += [(f"({a}) AND ({b})", lambda r, f=f, g=g: f(r) and g(r)), (f"({a}) OR ({b})", lambda r, f=f, g=g: f(r) or g(r))]
    return [*out, ("sku * 2 - 1 > weight", lambda r: r[0] * 2 - 1 > r[2]), ("remark LIKE '%t%'", lambda r: r[4] is not None and "t" in r[4])]


@pytest.fixture(scope="session")
def sqlite(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "shop.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE stock (sku INTEGER NOT NULL, shelf TEXT, weight REAL, frozen BOOLEAN, remark TEXT)")
        con.executemany("INSERT INTO stock VALUES (?, ?, ?, ?, ?)", STOCK)
        con.execute("CREATE TABLE hostile (id INTEGER NOT NULL, s TEXT)")
        con.executemany("INSERT INTO hostile VALUES (?, ?)", list(enumerate(HOSTILE)))
    return path


_RELATION = '(SELECT "sku", "shelf", "weight", "frozen", "remark" FROM "shop"."stock") t'


def test_pushdown_never_changes_answers(spark, derby, sqlite):
    local = lambda **o: read_table(spark, sqlite, "stock", **o)
    frames = [jdbc.Database(derby, "derby", pushdown=on).read(spark, _RELATION) for on in (True, False)]
    for where, holds in predicates():
        want = sorted(str(r) for r in STOCK if holds(r))
        for df in (*frames, local(pushdown="true"), local(pushdown="true", partitions="3", partition_column="sku")):
            assert sorted(str(tuple(r)) for r in df.where(where).collect()) == want, where
    assert [r.sku for r in frames[0].orderBy("sku").limit(3).collect()] == sorted(r[0] for r in STOCK)[:3]
    assert local(pushdown="true").count() == len(STOCK)


def test_rows_fetched(spark, derby):
    few = sorted(r[0] for r in STOCK)[-7]
    assert jdbc.rows_fetched(jdbc.Database(derby, "derby").read(spark, _RELATION).where(f"sku > {few}")) == 6
    assert jdbc.rows_fetched(jdbc.Database(derby, "derby", pushdown=False).read(spark, _RELATION).where(f"sku > {few}")) == len(STOCK)


def test_hostile_text_is_only_text(spark, sqlite):
    for i in range(0, len(HOSTILE), 9):
        df = read_table(spark, sqlite, "hostile", pushdown="true")
        assert [r.id for r in df.where(F.col("s") == HOSTILE[i]).collect()] == [i]


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("s", T.StringType()), T.StructField("b", T.BooleanType()), T.StructField('we"ird', T.DoubleType())])


def test_translation():
    t = lambda f: pushdown.translate(f, SCHEMA)
    assert t(D.EqualTo(("id",), 5)) == '"id" = 5'
    assert t(D.GreaterThan(("id",), 5)) == '"id" > 5'
    assert t(D.LessThanOrEqual(('we"ird',), 6.0)) == '"we""ird" <= 6'
    assert t(D.Not(D.EqualTo(("s",), "it's"))) == "\"s\" <> 'it''s'"
    assert t(D.In(("id",), (1, 2))) == '"id" IN (1, 2)'
    assert t(D.Not(D.In(("id",), (1, 2)))) == 'NOT ("id" IN (1, 2))'
    assert t(D.IsNull(("b",))) == '"b" IS NULL' and t(D.IsNotNull(("b",))) == '"b" IS NOT NULL'
    assert t(D.EqualTo(("b",), True)) == '"b" = TRUE'
    for f in (
        D.GreaterThan(("s",), "a"), D.EqualTo(("none",), 1), D.EqualTo(("id",), None), D.EqualTo(("s",), "a\x00"), D.EqualTo(('we"ird',), float("nan")),
        D.EqualTo(('we"ird',), float("inf")), D.In(("id",), ()), D.In(("s",), ("a", None)), D.EqualTo(("id", "x"), 1), D.StringStartsWith(("s",), "a"), D.Not(D.GreaterThan(("id",), 1)),
    ):
        assert t(f) is None, f


@given(st.text(alphabet=st.characters(blacklist_characters="\x00", blacklist_categories=("Cs",))))
def test_text_literals_read_back(s):
    assert sqlite3.connect(":memory:").execute(f"SELECT {pushdown.literal(s)}").fetchone()[0] == s


def test_scans():
    assert pushdown.scan_sql("s", 't"x', ["a", "b"], ['"a" = 1', '"b" IS NULL'], 3) == 'SELECT "a", "b" FROM "s"."t""x" WHERE ("a" = 1) AND ("b" IS NULL) LIMIT 3'
    assert pushdown.scan_sql("s", "t", [], limit=4) == 'SELECT COUNT(*) FROM (SELECT 1 FROM "s"."t" LIMIT 4) AS t'
    assert pushdown.pushed_limit(5, 2, 2) == 5 and pushdown.pushed_limit(5, 1, 2) is None and pushdown.pushed_limit(None, 0, 0) is None


def test_catalog(caplog):
    R = I.ColumnRecord
    records = [R("a", "t", "id", "BIGINT", nullable=False), R("a", "t", "u", "uuid"), R("a", "t", "ID", "text"), R("a", "j", "x", "jsonb"), R("b", "t", "n", "USER-DEFINED", "int4"), R("c", "a__t", "n", "date")]
    with caplog.at_level(logging.WARNING):
        tables = I.group_columns(records)
    assert [(t.schema, t.name, [f.name for f in t.fields]) for t in tables] == [("a", "t", ["id", "ID_2"]), ("b", "t", ["n"]), ("c", "a__t", ["n"])]
    assert "uuid" in caplog.text and "a.j" in caplog.text
    assert [t.schema for t in I.by_priority(tables, ["b", "a"])] == ["b", "a", "c"]
    assert [n for n, _ in I.registration_names(I.by_priority(tables, ["c", "b", "a"]))] == ["a__t", "t", "a__t_2"]
    assert [n for n, _ in I.registration_names(tables[:1], reserved=["T"])] == ["a__t"]
    sql = jdbc.relation(tables[0], "postgresql")
    assert sql == '(SELECT "id", "ID" COLLATE "C" AS "ID_2" FROM "a"."t") t'
    assert I.spark_type("numeric") is None and I.spark_type("ARRAY", "_int4") is None and isinstance(I.spark_type("Character Varying"), T.StringType)


def test_canonical_statements():
    same = [("SELECT  a,b FROM t", "select a , b from t ;"), ("select 1", " SELECT\n\t1 ; "), ("SELECT 'a  b'", "select 'a  b'"), ("select it('it''s  x')", "SELECT it( 'it''s  x' )")]
    assert all(canonical(a) == canonical(b) for a, b in same)
    other = [("select 1", "select 2"), ("select 'a b'", "select 'a  b'"), ("select 'A'", "select 'a'"), ('select "a  b"', 'select "a b"'), ("select A", "select a")]
    assert all(canonical(a) != canonical(b) for a, b in other)
    assert cacheable(" select 1") and cacheable("WITH x AS (SELECT 1) SELECT * FROM x")
    assert not any(map(cacheable, ("insert into t values (1)", "-- x\nselect 1", "(select 1)", "")))


def test_cache_limits():
    now = [0.0]
    cache = ResultCache(2, 10, clock=lambda: now[0])
    t = pa.table({"x": [1]})
    assert cache.get("select 1") is None
    cache.set("select 1", t)
    cache.set("select 2", t)
    assert cache.get("SELECT 1;") is t
    cache.set("select 3", t)
    assert cache.get("select 2") is None and cache.get("select 1") is t
    now[0] = 10.0
    assert cache.get("select 3") is t
    now[0] = 10.1
    assert cache.get("select 3") is None
    s = cache.stats()
    assert (s.hits, s.misses, s.evictions_lru, s.evictions_ttl, s.entries) == (3, 3, 1, 1, 1)
    before = cache.generation
    cache.clear()
    assert not cache.set("select 4", t, before) and len(cache) == 0
    assert not ResultCache(max_rows=1).set("select 1", pa.table({"x": [1, 2]}))
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            ResultCache(*bad)
    threads = [threading.Thread(target=lambda i=i: [cache.set(f"select {i}{k}", t) for k in range(50)]) for i in range(8)]
    [x.start() for x in threads] and [x.join() for x in threads]
    assert len(cache) == 2


def test_changes_make_results_fresh(spark, tmp_path):
    engine = Engine(spark)
    spark.range(3).createOrReplaceTempView("fresh")
    sql = "SELECT count(*) AS n FROM fresh"
    assert engine.fetch(sql).to_pylist() == [{"n": 3}]
    spark.range(8).createOrReplaceTempView("fresh")
    assert engine.fetch(sql).to_pylist() == [{"n": 3}]
    listener = changes.ChangeListener(str(tmp_path))
    (tmp_path / "notes.txt").write_text("x")
    assert listener.sync(engine.cache) == 0
    (tmp_path / "e.json").write_text("{}")
    assert listener.sync(engine.cache) == 1 and listener.sync(engine.cache) == 0
    assert engine.fetch(sql).to_pylist() == [{"n": 8}]
    assert changes.ChangeListener(str(tmp_path / "none")).sync(engine.cache) == 0
    stop = listener.poll(engine.cache, 0.05)
    generation = engine.cache.generation
    (tmp_path / "f.json").write_text("{}")
    for _ in range(100):
        if engine.cache.generation > generation:
            break
        threading.Event().wait(0.05)
    stop.set()
    assert engine.cache.generation > generation


def test_change_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "e.json").write_text("{}")
    cache = ResultCache()
    for expected in (1, 1, 2):
        if expected == 2:
            (folder / "g.json").write_text("{}")
        changes.change_stream(spark, str(folder), cache, str(tmp_path / "c"), available_now=True).awaitTermination(60)
        assert cache.generation == expected


def test_windows_over_a_stream(spark, sf, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    os.symlink(f"{sf}/events.parquet", source / "events.parquet")
    stream = spark.readStream.schema(changes.EVENTS).parquet(str(source))
    out = changes.windowed_counts(stream, "1 day", "1 day").writeStream.format("memory").queryName("windows").outputMode("update").trigger(availableNow=True)
    out.option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(120)
    batch = changes.windowed_counts(spark.read.parquet(f"{sf}/events.parquet"), "1 day")
    row = lambda r: (r.window_start, r.event_type, r.n)
    assert sorted(map(row, spark.table("windows").collect())) == sorted(map(row, batch.collect()))


def test_engine_refuses(spark, tmp_path):
    engine = Engine(spark)
    spark.sql(f"CREATE TABLE kept_out (x BIGINT) USING parquet LOCATION 'file://{tmp_path}/kept_out'")
    for sql in (
        "DROP VIEW x", "FROM range(3) INSERT INTO kept_out SELECT id", "WITH a AS (SELECT 1L AS x) INSERT INTO kept_out SELECT x FROM a", "INSERT OVERWRITE kept_out SELECT 1L",
        "CREATE TABLE t2 USING parquet AS SELECT 1", "SET spark.sql.ansi.enabled = false", "EXPLAIN INSERT INTO kept_out SELECT 1L", "TRUNCATE TABLE kept_out", "USE default", "CACHE TABLE kept_out",
    ):
        with pytest.raises(NotReadOnlyError):
            engine.query(sql)
    assert spark.table("kept_out").count() == 0
    for sql in ("SELECT 1;", "WITH a AS (SELECT 1) SELECT * FROM a", "VALUES (1), (2)", "SHOW DATABASES", "DESCRIBE TABLE kept_out", "EXPLAIN SELECT 1", "FROM range(3)", "(SELECT 1) UNION (SELECT 2)", "TABLE kept_out"):
        engine.query(sql).collect()
    Engine(spark, allow_write=True).query("INSERT INTO kept_out SELECT 5L")
    assert spark.table("kept_out").count() == 1
    spark.sql("DROP TABLE kept_out")
    with pytest.raises(UnsupportedTypeError):
        engine.fetch("SELECT array(1) AS a")
    assert len(engine.cache) == 0


def test_large_results_are_not_collected(spark):
    engine = Engine(spark, ResultCache(max_rows=10))
    with pytest.raises(ResultTooLargeError):
        engine.fetch("SELECT id FROM range(11)")
    assert engine.fetch("SELECT id FROM range(10)").num_rows == 10 and len(engine.cache) == 1
    assert engine.fetch("SELECT id FROM range(12)", limit=20).num_rows == 12 and len(engine.cache) == 1
    assert sum(1 for _ in engine.batches("SELECT id FROM range(1000)")) == 1000


def test_shims(spark):
    assert set(shims.register(spark)) == set(shims.SCALARS)
    row = spark.sql("SELECT strpos('abc', 'c'), starts_with('abc', 'a'), to_hex(255), sha256('a') = sha2('a', 256), array_to_string(array('a', 'b'), '-'), digest('a', 'md5') = md5('a'), gcd(84, 36), lcm(4, 6)").first()
    assert tuple(row) == (3, True, "ff", True, "a-b", True, 12, 12)


BASE = {"TIDEMARK_PARQUET_PATH": "/p", "TIDEMARK_CDC_PATH": "/c", "TIDEMARK_POSTGRES_URI": "postgres://u:p@h/d"}


def test_config(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    c = config.load(env=BASE)
    assert (c.cache_max_entries, c.cache_ttl_seconds, c.cdc_poll_seconds, c.postgres_schemas) == (1024, 300, 10, ("public",))
    assert "u:p" not in repr(c) and "u:p" not in f"{c.postgres_uri}" and c.postgres_uri.reveal() == BASE["TIDEMARK_POSTGRES_URI"]
    (tmp_path / "tidemark.toml").write_text('parquet_path = "/file"\ncache_ttl_seconds = 5\npostgres_schemas = ["a", "b"]\n')
    c = config.load(env=BASE | {"DATABASE_URL": "host=h dbname=d"})
    assert (c.parquet_path, c.cache_ttl_seconds, c.postgres_schemas, c.postgres_uri.reveal()) == ("/p", 5, ("a", "b"), "host=h dbname=d")
    (tmp_path / "bad.toml").write_text("nonsense = 1\n")
    for env in (
        {}, BASE | {"TIDEMARK_PARQUET_PATH": " "}, BASE | {"TIDEMARK_POSTGRES_URI": "mysql://x"}, BASE | {"TIDEMARK_CACHE_MAX_ENTRIES": "0"}, BASE | {"TIDEMARK_CDC_POLL_SECONDS": "x"},
        BASE | {"TIDEMARK_POSTGRES_SCHEMAS": "a,,b"}, BASE | {"TIDEMARK_CONFIG": str(tmp_path / "none.toml")}, BASE | {"TIDEMARK_CONFIG": str(tmp_path / "bad.toml")},
    ):
        with pytest.raises(ConfigError):
            config.load(env=env)


def test_metrics_by_hand(spark):
    pick = random.Random(22)
    rows = [(datetime(2020, 2, 28 + h // 24, h % 24) if h < 48 else datetime(2020, 3, 1, h - 48), a, *[float(pick.randrange(50, 90))] * 4, float(pick.randrange(1, 9))) for a in "XY" for h in range(20, 60)]
    df = spark.createDataFrame(rows, metrics.CANDLES)
    df.createOrReplaceTempView("crypto_ohlcv")
    last, worth, volume, means, falls = {}, {}, {}, {}, {}
    for ts, a, _, _, _, c, v in rows:  # by loops
        closes = means.setdefault(a, [])
        closes.append(c)
        last[a] = c
        worth[a, ts.date()] = worth.get((a, ts.date()), 0) + c * v
        volume[a, ts.date()] = volume.get((a, ts.date()), 0) + v
        falls[a] = min(falls.get(a, 0), c / max(closes) - 1)
    assert {r.asset: r.close for r in metrics.latest_close(df).collect()} == last
    assert {(r.asset, r.day.date()): r.volume for r in metrics.daily_volume(df).collect()} == volume
    assert {(r.asset, r.day.date()): r.vwap for r in metrics.daily_vwap(df).collect()} == pytest.approx({k: worth[k] / volume[k] for k in worth})
    assert {r.asset: r.max_drawdown for r in metrics.max_drawdown(df).collect()} == pytest.approx(falls)
    for n in (0, 1, 5):
        want = [sum(x[max(0, i - max(n, 1) + 1) : i + 1]) / len(x[max(0, i - max(n, 1) + 1) : i + 1]) for a in "XY" for x in [means[a]] for i in range(len(x))]
        assert [r[f"sma_{n}"] for r in metrics.sma(df, n).collect()] == pytest.approx(want)
    assert metrics.rolling_volatility(df, 2).first().volatility_2 is None
    for name, sql in metrics.metrics_suite():
        assert [tuple(r) for r in spark.sql(sql).collect()] == [tuple(r) for r in metrics.DATAFRAME_SUITE[name](df).collect()], name
    zero = spark.createDataFrame([(rows[0][0], "Z", 1.0, 1.0, 1.0, 0.0, 0.0)], metrics.CANDLES)
    assert metrics.daily_vwap(zero).first().vwap is None


def test_sample_suite(spark, tmp_path):
    out = metrics.run_suite(spark, str(tmp_path / "candles"), 168)
    counts = {k: v.count() for k, v in out.items()}
    assert counts == {"latest_close": 3, "daily_volume": 24, "daily_vwap": 24, "sma_24": 504, "volatility_24": 504, "max_drawdown": 3}
    assert len(metrics.sample_candles(48)) == 144
    first = metrics.sample_candles(1)[0]
    assert first[0] == datetime(2023, 11, 14, 22, 13, 20) and first[2] == 40000.0
    names = spark.createDataFrame([("BTC", "Bitcoin"), ("ETH", "Ethereum"), ("SOL", "Solana")], "asset string, name string")
    joined = metrics.volume_by_name(spark.table("crypto_ohlcv"), names).collect()
    assert [r.name for r in joined] == ["Bitcoin", "Ethereum", "Solana"] and all(r.total_volume > 0 for r in joined)


def test_addresses(tmp_path, monkeypatch, capsys):
    from tidemark.__main__ import main

    d = jdbc.from_uri("postgres://me:p%40ss@db:6000/sales")
    assert d.url == "jdbc:postgresql://db:6000/sales" and d.options == {"user": "me", "password": "p@ss"}
    d = jdbc.from_uri(r"host=h dbname=d user=u password='a b\'c' sslmode=require")
    assert d.url == "jdbc:postgresql://h:5432/d" and d.options == {"user": "u", "password": "a b'c", "sslmode": "require"}
    assert jdbc.from_uri("postgres://h/d?sslmode=verify-full&application_name=x%20y").options == {"sslmode": "verify-full", "application_name": "x y"}
    monkeypatch.chdir(tmp_path)
    for k in config._KEYS:
        monkeypatch.delenv(config.PREFIX + k.upper(), raising=False)
    monkeypatch.delenv("DATABASE_URL", raising=False)
    assert main(["query", "SELECT 1"]) == 2 and "configuration" in capsys.readouterr().err
    assert main([]) == 2
