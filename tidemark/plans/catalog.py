"""The registered queries over the reference's operators, each with its SQL twin.

Money and quantities are rounded where sums of doubles depend on their order; the digits leave no ties. Integer kinds are cast so
that both sides have one type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.operators.metrics import Columns
from tidemark.operators.ranges import running_max, trailing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: `events` stands in for candles: its type for the asset, its value for the price.
EVENT = Columns(ts="ts", asset="event_type", close="value", volume="value")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str, *tables: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a function of the tables' DataFrames under a name, with the SQL that says the same."""

    def add(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(*(table(spark, sf_dir, t) for t in tables))
        ORACLES[name] = sql
        return build

    return add


def sql_query(name: str, spark_sql: str, oracle: str | None = None, *tables: str) -> None:
    """Register SQL text over views of the tables; `oracle` where the two dialects differ."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in tables:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(spark_sql)

    QUERIES[name] = run
    ORACLES[name] = oracle or spark_sql


# Metrics.
@query("m1_latest_close", "SELECT event_type, max(ts) AS ts, arg_max(value, ts) AS value FROM events GROUP BY event_type", "events")
def _(events):
    return metrics.latest_close(events, EVENT)


@query("m2_daily_volume", "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, round(sum(value), 4) AS volume FROM events GROUP BY ALL", "events")
def _(events):
    return metrics.daily_volume(events, EVENT).withColumn("volume", F.round("volume", 4))


@query(
    "m3_daily_vwap",
    "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, round(sum(value * value) / sum(value), 6) AS vwap FROM events GROUP BY ALL",
    "events",
)
def _(events):
    return metrics.daily_vwap(events, EVENT).withColumn("vwap", F.round("vwap", 6))


@query(
    "m4_sma",
    "SELECT event_type, ts, value, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS sma_24 FROM events",
    "events",
)
def _(events):
    return metrics.sma(events, 24, EVENT).withColumn("sma_24", F.round("sma_24", 6))


@query(
    "m5_rolling_volatility",
    """WITH r AS (SELECT event_type, ts, ln(value / lag(value) OVER (PARTITION BY event_type ORDER BY ts)) AS c FROM events)
    SELECT event_type, ts, round(stddev_samp(c) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS volatility_24 FROM r""",
    "events",
)
def _(events):
    return metrics.rolling_volatility(events, 24, EVENT).withColumn("volatility_24", F.round("volatility_24", 6))


@query(
    "m6_max_drawdown",
    """WITH p AS (SELECT event_type, value / max(value) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS d FROM events)
    SELECT event_type, min(d) AS max_drawdown FROM p GROUP BY event_type""",
    "events",
)
def _(events):
    return metrics.max_drawdown(events, EVENT)


def _suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every SQL builder of the suite gives over `events` as candles: metric, asset, time and value."""
    candles = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("asset"), F.col("value").alias("close"), F.col("value").alias("volume"))
    candles.createOrReplaceTempView("m7_candles")
    parts = []
    for name, sql in metrics.metrics_suite(24, "m7_candles"):
        df = spark.sql(sql)
        at = next((c for c in ("ts", "day") if c in df.columns), None)
        parts.append(df.select(F.lit(name).alias("metric"), "asset", (F.col(at) if at else F.lit(None)).cast("timestamp_ntz").alias("at"), F.round(df.columns[-1], 6).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUERIES["m7_metrics_suite"] = _suite
ORACLES["m7_metrics_suite"] = """
WITH e AS (SELECT event_type AS asset, ts, value AS c, date_trunc('day', ts)::TIMESTAMP AS day FROM events),
r AS (SELECT asset, ts, c, ln(c / lag(c) OVER w) AS x, c / max(c) OVER w - 1 AS d FROM e WINDOW w AS (PARTITION BY asset ORDER BY ts))
SELECT 'latest_close' AS metric, asset, max(ts) AS "at", round(arg_max(c, ts), 6) AS value FROM e GROUP BY asset
UNION ALL SELECT 'daily_volume', asset, day, round(sum(c), 6) FROM e GROUP BY asset, day
UNION ALL SELECT 'daily_vwap', asset, day, round(sum(c * c) / sum(c), 6) FROM e GROUP BY asset, day
UNION ALL SELECT 'sma_24', asset, ts, round(avg(c) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) FROM e
UNION ALL SELECT 'volatility_24', asset, ts, round(stddev_samp(x) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) FROM r
UNION ALL SELECT 'max_drawdown', asset, NULL, round(min(d), 6) FROM r GROUP BY asset"""


@query(
    "m8_volume_by_name",
    "SELECT n_name AS name, round(sum(c_acctbal), 2) AS total_volume FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "customer", "nation",
)
def _(customer, nation):
    names = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"))
    by = Columns(asset="c_nationkey", volume="c_acctbal")
    return metrics.volume_by_name(customer, names, by).withColumn("total_volume", F.round("total_volume", 2))


# Scans, projections and predicates.
@query("p1_projection", "SELECT n_name, n_nationkey FROM nation", "nation")
def _(nation):
    return nation.select("n_name", "n_nationkey")


@query("p2_star", "SELECT * FROM supplier", "supplier")
def _(supplier):
    return supplier.select("*")


@query("p3_alias", "SELECT n.n_name AS nation_name, n.n_regionkey + 1 AS next_region FROM nation n", "nation")
def _(nation):
    return nation.alias("n").select(F.col("n.n_name").alias("nation_name"), (F.col("n.n_regionkey") + 1).alias("next_region"))


sql_query("p4_literal", "SELECT 1 AS test_col, 'x' AS s")
sql_query("p5_derived_table", "SELECT r, cnt FROM (SELECT n_regionkey AS r, count(*) AS cnt FROM nation GROUP BY n_regionkey) t WHERE cnt > 1", None, "nation")
sql_query(
    "p6_cte",
    "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT o_custkey, round(total, 2) AS total FROM big WHERE total > (SELECT avg(total) FROM big)",
    None,
    "orders",
)
for _name, _where in {
    "p7_compare": "o_totalprice > 250000 AND o_orderkey <= 5000 AND o_orderkey <> 7 AND o_custkey >= 10 AND o_custkey < 900",
    "p8_flipped": "42 = o_custkey OR 100 > o_orderkey",
    "p9_null_tests": "o_orderpriority IS NOT NULL AND NOT (o_orderstatus IS NULL)",
    "p10_in_lists": "o_orderstatus IN ('F', 'O') AND o_custkey NOT IN (1, 2, 3)",
    "p11_and": "o_orderstatus = 'F' AND o_custkey > 700 AND o_totalprice < 100000",
    "p12_or": "o_orderkey < 20 OR o_totalprice > 400000",
    "p13_like": "o_orderpriority LIKE '%URGENT' OR o_orderpriority LIKE '5%'",
    "p14_between": "o_totalprice BETWEEN 1000 AND 20000",
    "p15_arithmetic": "o_orderkey + 1 = 43 OR o_custkey * 2 - o_orderkey = 5",
    "p16_columns": "o_orderkey < o_custkey",
    "p17_text_order": "o_orderpriority > '3' AND o_orderstatus < 'P'",
    "p18_quotes": "o_orderpriority <> 'it''s' AND o_orderstatus = 'O'",
    "p19_bool_and_float": "(o_totalprice >= 150000.5) = TRUE",
}.items():
    sql_query(_name, f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE {_where}", None, "orders")
sql_query(
    "p20_conditionals",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
    coalesce(nullif(o_orderstatus, 'P'), 'none') AS status, o_custkey IS DISTINCT FROM 42 AS other, CAST(o_totalprice AS BIGINT) >= 0 AS positive
    FROM orders WHERE NOT (o_totalprice > 250000)""",
    None,
    "orders",
)
sql_query(
    "p20_subqueries",
    """SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)
    AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer)""",
    None,
    "customer", "orders", "nation",
)
sql_query("p20_regex", "SELECT p_partkey, p_name FROM part WHERE p_name RLIKE '^[a-m].*'", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-m].*')", "part")


# Joins.
@query("j1_federated_join", "SELECT o_orderkey, c_custkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey = 42", "orders", "customer")
def _(orders, customer):
    """The filter reaches both scans, as the join's equality carries it over."""
    return orders.join(customer, orders.o_custkey == customer.c_custkey, "inner").where(F.col("c_custkey") == 42).select("o_orderkey", "c_custkey", "c_name", "o_totalprice")


@query(
    "j2_join_group",
    "SELECT c_mktsegment, o_orderstatus, round(sum(o_totalprice), 1) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "orders", "customer",
)
def _(orders, customer):
    joined = orders.join(customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment", "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 1).alias("total"), F.count(F.lit(1)).alias("n"))


_VALUES = "(VALUES (1, 'a'), (2, 'b'), (CAST(NULL AS INT), 'c')) AS {0}(k, v)"
sql_query("j3_null_keys", f"SELECT l.v AS lv, r.v AS rv FROM (SELECT * FROM {_VALUES.format('x')}) l JOIN (SELECT * FROM {_VALUES.format('y')}) r ON l.k = r.k")
# The whole tables, and keys that the other side lacks.
_CUSTOMERS = "(SELECT c_custkey FROM customer UNION ALL SELECT k FROM (VALUES (CAST(-1 AS BIGINT)), (CAST(NULL AS BIGINT))) AS x(k))"
_ORDERS = "(SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT k, v FROM (VALUES (CAST(-1 AS BIGINT), CAST(-2 AS BIGINT)), (CAST(-2 AS BIGINT), CAST(NULL AS BIGINT))) AS y(k, v))"
for _name, _how in {"left": "LEFT", "right": "RIGHT", "full": "FULL OUTER"}.items():
    sql_query(
        f"j4_{_name}_join",
        f"SELECT c.c_custkey, o.o_orderkey FROM {_CUSTOMERS} c {_how} JOIN {_ORDERS} o ON c.c_custkey = o.o_custkey",
        None,
        "customer", "orders",
    )
_SEMI = "SELECT c_custkey, c_name FROM customer c WHERE {0} EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)"


@query("j4_semi_join", _SEMI.format(""), "customer", "orders")
def _(customer, orders):
    return customer.join(orders.where("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("j4_anti_join", _SEMI.format("NOT"), "customer", "orders")
def _(customer, orders):
    return customer.join(orders.where("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


sql_query("j4_cross_join", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", None, "region", "nation")
sql_query("j4_natural_join", "SELECT k, v, w FROM (SELECT n_regionkey AS k, n_name AS v FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name AS w FROM region) b", None, "nation", "region")
sql_query("j4_using_join", "SELECT k, v, w FROM (SELECT n_regionkey AS k, n_name AS v FROM nation) a JOIN (SELECT r_regionkey AS k, r_name AS w FROM region) b USING (k)", None, "nation", "region")
sql_query("j4_theta_join", "SELECT a.n_name AS a, b.r_name AS b FROM nation a JOIN region b ON a.n_nationkey < b.r_regionkey * 3", None, "nation", "region")
sql_query(
    "j4_lateral_join",
    "SELECT r_name, t.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) t",
    None,
    "region", "nation",
)


@query(
    "j5_three_way_join",
    """SELECT r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "lineitem", "supplier", "nation", "region",
)
def _(lineitem, supplier, nation, region):
    """Lines are added up by supplier before any join, so the large side moves one row a supplier."""
    by = lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    places = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    joined = by.join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("r_name").agg(F.sum("n").alias("n"), F.round(F.sum("revenue"), 1).alias("revenue"))


# Aggregates.
@query("a1_sum", "SELECT l_returnflag, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag", "lineitem")
def _(lineitem):
    return lineitem.groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("q"))


@query("a2_count", "SELECT count(*) AS n FROM orders WHERE o_orderkey > 995", "orders")
def _(orders):
    return orders.where("o_orderkey > 995").agg(F.count(F.lit(1)).alias("n"))


@query("a3_min_expression", "SELECT l_linestatus, min(l_extendedprice * (1 - l_discount)) AS least FROM lineitem GROUP BY l_linestatus", "lineitem")
def _(lineitem):
    return lineitem.groupBy("l_linestatus").agg(F.min(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("least"))


@query("a4_ratio_of_sums", "SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS vwap FROM lineitem GROUP BY l_suppkey", "lineitem")
def _(lineitem):
    return lineitem.groupBy("l_suppkey").agg(F.round(F.try_divide(F.sum(F.col("l_extendedprice") * F.col("l_quantity")), F.sum("l_quantity")), 4).alias("vwap"))


@query(
    "a5_statistics",
    "SELECT event_type, round(avg(value), 6) AS mean, max(value) AS most, round(stddev_samp(value), 6) AS spread FROM events GROUP BY event_type",
    "events",
)
def _(events):
    return events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"), F.round(F.stddev_samp("value"), 6).alias("spread"))


@query("a6_group_by_expression", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n FROM orders GROUP BY ALL", "orders")
def _(orders):
    return orders.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.count(F.lit(1)).alias("n"))


sql_query(
    "a7_distinct_filter_having",
    """SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, round(sum(DISTINCT o_totalprice), 1) AS total
    FROM orders GROUP BY o_orderpriority HAVING count(*) > 10""",
    None,
    "orders",
)
_CUBES = {"cube": "CUBE (l_returnflag, l_linestatus)", "rollup": "ROLLUP (l_returnflag, l_linestatus)", "grouping_sets": "GROUPING SETS ((l_returnflag), (l_linestatus), ())"}
for _name, _by in _CUBES.items():
    sql_query(
        f"a8_{_name}",
        f"SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS g, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY {_by}",
        None,
        "lineitem",
    )
sql_query(
    "a9_moments",
    """SELECT event_type, round(var_pop(value), 4) AS vp, round(var_samp(value), 4) AS vs, round(stddev_pop(value), 6) AS sp, round(covar_pop(value, user_id), 3) AS cp,
    round(covar_samp(value, user_id), 3) AS cs, round(corr(value, user_id), 8) AS r, round(regr_slope(value, user_id), 8) AS slope, round(regr_intercept(value, user_id), 5) AS intercept
    FROM events GROUP BY event_type""",
    None,
    "events",
)
sql_query(
    "a9_bits_and_bools",
    """SELECT n_regionkey, bit_and(n_nationkey) AS ba, bit_or(n_nationkey) AS bo, bit_xor(n_nationkey) AS bx, bool_and(n_nationkey > 3) AS every_one, bool_or(n_nationkey > 20) AS some_one
    FROM nation GROUP BY n_regionkey""",
    None,
    "nation",
)
sql_query(
    "a9_order_statistics",
    "SELECT event_type, round(median(value), 6) AS med, round(percentile(value, 0.9), 6) AS p90, max_by(event_id, ts) AS newest, min_by(event_id, ts) AS oldest FROM events GROUP BY event_type",
    "SELECT event_type, round(median(value), 6) AS med, round(quantile_cont(value, 0.9), 6) AS p90, arg_max(event_id, ts) AS newest, arg_min(event_id, ts) AS oldest FROM events GROUP BY event_type",
    "events",
)
sql_query(
    "a9_collected",
    "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names, array_join(array_sort(array_agg(n_nationkey)), '-') AS nodes FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, string_agg(n_nationkey::VARCHAR, '-' ORDER BY n_nationkey) AS nodes FROM nation GROUP BY n_regionkey",
    "nation",
)


# Windows.
@query(
    "w1_row_number",
    "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1",
    "events",
)
def _(events):
    newest = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("r")
    return events.groupBy("event_type").agg(newest).select("event_type", "r.event_id", "r.value")


_OVER = "OVER (PARTITION BY event_type ORDER BY ts"


def _looking_back(name: str, sql: str, rows: int, value: Callable) -> None:
    """A trailing window over `events`: its SQL, how many rows it looks back, and the column it makes of an ordered window."""

    @query(name, f"SELECT event_id, {sql} AS x FROM events", "events")
    def _(events):
        rows_of = events.select("event_id", "event_type", "ts", "value")
        return trailing(rows_of, "event_type", "ts", rows, lambda w: {"x": value(w)}).select("event_id", "x")


_looking_back("w2_trailing_mean", f"round(avg(value) {_OVER} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6)", 6, lambda w: F.round(F.avg("value").over(w.rowsBetween(-6, 0)), 6))
_looking_back("w3_lag", f"lag(value) {_OVER})", 1, lambda w: F.lag("value").over(w))
_looking_back("w4_trailing_deviation", f"round(stddev_samp(value) {_OVER} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 5)", 9, lambda w: F.round(F.stddev_samp("value").over(w.rowsBetween(-9, 0)), 5))


@query("w5_running_max", f"SELECT event_id, max(value) {_OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM events", "events")
def _(events):
    return running_max(events.select("event_id", "event_type", "ts", "value"), "event_type", "ts", "value", "x").select("event_id", "x")


for _name, _expr in {
    "w6_window_of_none": f"round(avg(value) {_OVER} ROWS BETWEEN 0 PRECEDING AND CURRENT ROW), 6)",
    "w7_rank": f"CAST(rank() {_OVER}) AS BIGINT)",
    "w7_dense_rank": "CAST(dense_rank() OVER (PARTITION BY event_type ORDER BY floor(value)) AS BIGINT)",
    "w7_percent_rank": f"round(percent_rank() {_OVER}), 8)",
    "w7_cume_dist": f"round(cume_dist() {_OVER}), 8)",
    "w7_ntile": f"CAST(ntile(4) {_OVER}) AS BIGINT)",
    "w7_lead": f"lead(value, 2) {_OVER})",
    "w7_first_value": f"first_value(value) {_OVER})",
    "w7_last_value": f"last_value(value) {_OVER} ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)",
    "w7_nth_value": f"nth_value(value, 2) {_OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "w7_range_frame": "count(*) OVER (PARTITION BY event_type ORDER BY CAST(floor(value) AS BIGINT) RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)",
}.items():
    sql_query(_name, f"SELECT event_id, {_expr} AS x FROM events", None, "events")
sql_query("w7_named_window", "SELECT event_id, CAST(row_number() OVER w AS BIGINT) AS n, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)", None, "events")


# Order, limits and set operations.
_RANKED = "SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS n FROM ({0}) t"


sql_query("o1_order_by", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey", None, "orders")
sql_query("o2_order_desc", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey", None, "orders")
sql_query("o3_limit", "SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders LIMIT 10) t", None, "orders")
sql_query("o4_limit_above_filter", "SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders WHERE o_orderkey + 1 > 100 LIMIT 7) t", None, "orders")
sql_query("o5_top_k", _RANKED.format("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3"), None, "orders")
sql_query("o6_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", None, "orders")
_SETS = {
    "union": "SELECT n_nationkey AS k FROM nation UNION SELECT c_nationkey FROM customer",
    "union_all": "SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "distinct": "SELECT DISTINCT p_brand, p_size FROM part",
}
for _name, _sql in _SETS.items():
    sql_query(f"o7_{_name}", _sql, None, "nation", "customer", "supplier", "part")
sql_query("o7_values", "SELECT * FROM (VALUES (1, 'a'), (2, NULL)) AS t(x, y)")
sql_query(
    "o7_distinct_on",
    "SELECT o_custkey, max_by(struct(o_orderkey, o_totalprice), struct(o_totalprice, o_orderkey)).o_orderkey AS o_orderkey FROM orders GROUP BY o_custkey",
    "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey DESC",
    "orders",
)


# Scalar functions.
sql_query(
    "f_math",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, abs(l_discount - 0.05) AS a, CAST(ceil(l_extendedprice) AS BIGINT) AS c, CAST(floor(l_extendedprice) AS BIGINT) AS f,
    round(sqrt(l_extendedprice), 6) AS s, round(ln(l_extendedprice), 8) AS l, round(exp(l_discount), 8) AS e, round(power(l_quantity, 2), 2) AS p, CAST(sign(l_tax - 0.04) AS DOUBLE) AS g,
    round(sin(l_quantity), 8) AS sn, greatest(l_discount, l_tax) AS gr, least(l_discount, l_tax) AS le FROM lineitem""",
    None,
    "lineitem",
)
sql_query(
    "f_strings",
    """SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, CAST(length(p_name) AS BIGINT) AS n, substring(p_name, 2, 4) AS s, replace(p_type, ' ', '_') AS r,
    concat(p_brand, '/', p_type) AS c, trim(concat('  ', p_brand, ' ')) AS t, lpad(p_brand, 12, '*') AS lp, reverse(p_name) AS rv, split_part(p_name, ' ', 1) AS first_word,
    left(p_name, 3) AS lf, right(p_name, 3) AS rt, repeat('ab', 2) AS rp, translate(p_brand, 'B', 'b') AS tr, md5(p_name) AS h FROM part""",
    None,
    "part",
)
sql_query(
    "f_string_names",
    "SELECT p_partkey, CAST(instr(p_name, 'e') AS BIGINT) AS at, startswith(p_name, 'a') AS a, endswith(p_name, 'e') AS z, sha2(p_name, 256) AS h, lower(hex(p_partkey)) AS x, initcap(p_type) AS i FROM part",
    "SELECT p_partkey, strpos(p_name, 'e') AS at, starts_with(p_name, 'a') AS a, ends_with(p_name, 'e') AS z, sha256(p_name) AS h, lower(to_hex(p_partkey)) AS x, array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS i FROM part",
    "part",
)
sql_query(
    "f_dates",
    """SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(extract(month FROM o_orderdate) AS BIGINT) AS m, CAST(date_part('day', o_orderdate) AS BIGINT) AS d,
    CAST(o_orderdate AS DATE) AS dt, CAST(date_trunc('month', o_orderdate) AS timestamp_ntz) AS mo, CAST(o_orderdate + INTERVAL 3 DAYS AS DATE) AS later FROM orders WHERE o_orderdate >= TIMESTAMP_NTZ '1995-01-01 00:00:00'""",
    """SELECT o_orderkey, extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m, date_part('day', o_orderdate) AS d,
    CAST(o_orderdate AS DATE) AS dt, date_trunc('month', o_orderdate)::TIMESTAMP AS mo, CAST(o_orderdate + INTERVAL 3 DAYS AS DATE) AS later FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00'""",
    "orders",
)
sql_query(
    "f_regex",
    "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '-') AS r, regexp_extract(p_type, '([A-Z]+)', 1) AS e, CAST(regexp_count(p_name, '[aeiou]') AS BIGINT) AS n, regexp_like(p_name, 'e.*e') AS k FROM part",
    "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '-', 'g') AS r, regexp_extract(p_type, '([A-Z]+)', 1) AS e, len(regexp_extract_all(p_name, '[aeiou]')) AS n, regexp_matches(p_name, 'e.*e') AS k FROM part",
    "part",
)
sql_query(
    "f_arrays",
    """SELECT p_partkey, CAST(size(w) AS BIGINT) AS n, element_at(w, 1) AS first_word, array_contains(w, 'blue') AS blue, array_join(array_sort(array_distinct(w)), '|') AS sorted,
    array_join(slice(w, 1, 2), ' ') AS two FROM (SELECT p_partkey, split(p_name, ' ') AS w FROM part) t""",
    """SELECT p_partkey, len(w) AS n, w[1] AS first_word, list_contains(w, 'blue') AS blue, array_to_string(list_sort(list_distinct(w)), '|') AS sorted,
    array_to_string(w[1:2], ' ') AS two FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) t""",
    "part",
)
sql_query(
    "f_unnest",
    "SELECT word, count(*) AS n FROM (SELECT explode(split(p_name, ' ')) AS word FROM part) t GROUP BY word",
    "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) t GROUP BY word",
    "part",
)
sql_query(
    "f_json",
    "SELECT event_id, get_json_object(props, '$.k') AS k, props IS NOT NULL AS there FROM events",
    "SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NOT NULL AS there FROM events",
    "events",
)


sql_query(
    "a9_regressions",
    """SELECT event_type, CAST(regr_count(value, user_id) AS BIGINT) AS n, round(regr_avgx(value, user_id), 5) AS ax, round(regr_avgy(value, user_id), 5) AS ay,
    round(regr_sxx(value, user_id), 2) AS sxx, round(regr_syy(value, user_id), 2) AS syy, round(regr_sxy(value, user_id), 2) AS sxy, round(regr_r2(value, user_id), 8) AS r2
    FROM events GROUP BY event_type""",
    None,
    "events",
)
sql_query(
    "a9_first_last",
    "SELECT event_type, min_by(value, ts) AS first_value, max_by(value, ts) AS last_value FROM events GROUP BY event_type",
    "SELECT event_type, first(value ORDER BY ts) AS first_value, last(value ORDER BY ts) AS last_value FROM events GROUP BY event_type",
    "events",
)
sql_query(
    "f_trigonometry",
    """SELECT l_orderkey, l_linenumber, l_quantity, round(cos(l_quantity), 8) AS c, round(tan(l_discount), 8) AS t, round(asin(l_discount), 8) AS a_s, round(acos(l_tax), 8) AS a_c,
    round(atan(l_quantity), 8) AS a_t, round(atan2(l_tax, l_quantity), 8) AS a2, round(cot(l_quantity), 6) AS ct, round(degrees(l_discount), 6) AS dg, round(radians(l_quantity), 8) AS ra,
    round(cbrt(l_quantity), 8) AS cb, round(log10(l_quantity), 8) AS l10, round(log2(l_quantity), 8) AS l2, round(pi(), 8) AS p, round(sinh(l_tax), 8) AS sh, round(cosh(l_tax), 8) AS ch, round(tanh(l_tax), 8) AS th FROM lineitem""",
    None,
    "lineitem",
)
sql_query(
    "f_string_forms",
    """SELECT p_partkey, overlay(p_name PLACING 'XY' FROM 2 FOR 3) AS o, CAST(levenshtein(p_name, p_type) AS BIGINT) AS d, CAST(ascii(p_name) AS BIGINT) AS a, char(65 + p_size) AS ch, btrim(concat('xx', p_brand, 'x'), 'x') AS bt,
    rpad(p_brand, 12, '.') AS rp, ltrim(concat('  ', p_brand)) AS lt, rtrim(concat(p_brand, '  ')) AS rt, base64(encode(p_name, 'UTF-8')) AS b64, CAST(bit_length(p_name) AS BIGINT) AS bl, CAST(octet_length(p_name) AS BIGINT) AS ol, concat_ws('-', p_brand, NULL, p_type) AS cw FROM part""",
    """SELECT p_partkey, left(p_name, 1) || 'XY' || substr(p_name, 5) AS o, levenshtein(p_name, p_type) AS d, ascii(p_name)::BIGINT AS a, chr(65 + p_size) AS ch, trim(concat('xx', p_brand, 'x'), 'x') AS bt,
    rpad(p_brand, 12, '.') AS rp, ltrim(concat('  ', p_brand)) AS lt, rtrim(concat(p_brand, '  ')) AS rt, base64(encode(p_name)) AS b64, bit_length(p_name)::BIGINT AS bl, strlen(p_name)::BIGINT AS ol, concat_ws('-', p_brand, NULL, p_type) AS cw FROM part""",
    "part",
)
sql_query(
    "f_date_forms",
    """SELECT o_orderkey, make_date(year(o_orderdate), 2, 1) AS md, CAST(unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) AS u, date_format(o_orderdate, 'yyyy/MM/dd HH:mm') AS f,
    to_date('2021-03-04', 'yyyy-MM-dd') AS td, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(dayofyear(o_orderdate) AS BIGINT) AS doy, last_day(o_orderdate) AS ld, CAST(datediff(DATE '2000-01-01', o_orderdate) AS BIGINT) AS dd,
    CAST(timestamp_seconds(CAST(floor(unix_seconds(CAST(o_orderdate AS TIMESTAMP)) / 604800) AS BIGINT) * 604800) AS timestamp_ntz) AS bin FROM orders""",
    """SELECT o_orderkey, make_date(year(o_orderdate), 2, 1) AS md, epoch(o_orderdate)::BIGINT AS u, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS f,
    DATE '2021-03-04' AS td, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS doy, last_day(o_orderdate) AS ld, date_diff('day', o_orderdate::DATE, DATE '2000-01-01') AS dd,
    time_bucket(INTERVAL 7 DAYS, o_orderdate, TIMESTAMP '1970-01-01') AS bin FROM orders""",
    "orders",
)
sql_query(
    "f_nested",
    """SELECT p_partkey, m['size'] AS size, array_join(map_keys(m), ',') AS keys, s.a AS a, array_join(flatten(array(w, array('end'))), ' ') AS flat, CAST(array_position(w, 'blue') AS BIGINT) AS at, array_join(array_sort(array_union(w, array('zz'))), ' ') AS both,
    array_join(array_sort(array_except(w, array('blue'))), ' ') AS less FROM (SELECT p_partkey, map('size', CAST(p_size AS STRING), 'brand', p_brand) AS m, named_struct('a', p_type) AS s, split(p_name, ' ') AS w FROM part) t""",
    """SELECT p_partkey, p_size::VARCHAR AS size, 'size,brand' AS keys, p_type AS a, p_name || ' end' AS flat, coalesce(list_position(w, 'blue'), 0)::BIGINT AS at, array_to_string(list_sort(list_distinct(w || ['zz'])), ' ') AS both,
    array_to_string(list_sort(list_distinct(list_filter(w, lambda x: x <> 'blue'))), ' ') AS less FROM (SELECT *, string_split(p_name, ' ') AS w FROM part) t""",
    "part",
)
sql_query(
    "f_json_forms",
    "SELECT n_nationkey, to_json(named_struct('k', n_nationkey, 'n', n_name)) AS j, from_json(concat('{\"v\":', n_nationkey, '}'), 'v INT').v AS v FROM nation",
    "SELECT n_nationkey, '{\"k\":' || n_nationkey || ',\"n\":\"' || n_name || '\"}' AS j, n_nationkey AS v FROM nation",
    "nation",
)
sql_query("f_types", "SELECT typeof(n_name) AS t, count(DISTINCT n_regionkey) AS n FROM nation GROUP BY 1", "SELECT 'string' AS t, count(DISTINCT n_regionkey) AS n FROM nation", "nation")


# Sources and sinks.
def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the folder source: fixed schema, Parquet files only."""
    from tidemark.sources.parquet import read_folder

    schema = table(spark, sf_dir, "region").schema
    return read_folder(spark, f"{sf_dir}/region.parquet", schema)


QUERIES["s1_parquet_folder"] = _round_trip
ORACLES["s1_parquet_folder"] = "SELECT * FROM region"


@query("s11_row_count", "SELECT count(*) AS n FROM lineitem", "lineitem")
def _(lineitem):
    return lineitem.agg(F.count(F.lit(1)).alias("n"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.streaming.changes import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events"), "1 hour").withColumn("total", F.round("total", 4))


QUERIES["event_windows"] = _windows
ORACLES["event_windows"] = "SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
