"""Market metrics over candle tables, as DataFrame functions and as SQL text.

Each builder takes the table and column names, so that any table of (time, name, value, volume) can be measured. The DataFrame
functions deal the windows of a name over ranges of time, as names may be few; in SQL text windows are partitioned by the name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ranges import running_max, trailing

CANDLES = T.StructType(
    [T.StructField("ts", T.TimestampNTZType(), False), T.StructField("asset", T.StringType(), False)]
    + [T.StructField(c, T.DoubleType(), False) for c in ("open", "high", "low", "close", "volume")]
)


@dataclass(frozen=True)
class Columns:
    ts: str = "ts"
    asset: str = "asset"
    close: str = "close"
    volume: str = "volume"


OHLCV = Columns()


def _span(rows: int) -> tuple[int, int]:
    """A window of so many rows that ends at the current one; 0 counts as the current row alone."""
    return -max(rows - 1, 0), 0


def _day(c: Columns):
    return F.date_trunc("day", F.col(c.ts)).cast("timestamp_ntz")


def _ratio(x: Column, y: Column) -> Column:
    """x / y as floating point numbers have it: infinite over zero, with the signs of both, and 0 / 0 is NaN."""
    over = F.when(y.cast("string") == "-0.0", F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(y == 0, x * over).otherwise(F.try_divide(x, y))


def _ln(x: Column) -> Column:
    """The logarithm as floating point numbers have it, where Spark's is null up to zero: -inf of zero, NaN below."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


def _sql_ratio(x: str, y: str) -> str:
    over = f"CASE WHEN CAST({y} AS STRING) = '-0.0' THEN CAST('-Infinity' AS DOUBLE) ELSE CAST('Infinity' AS DOUBLE) END"
    return f"CASE WHEN {y} = 0 THEN {x} * {over} ELSE try_divide({x}, {y}) END"


def latest_close(df: DataFrame, c: Columns = OHLCV) -> DataFrame:
    """asset, ts, close of each name's newest row: one partial aggregate, no sort."""
    newest = F.max_by(F.struct(c.ts, c.close), F.struct(c.ts, c.close)).alias("r")
    return df.groupBy(c.asset).agg(newest).select(c.asset, F.col(f"r.{c.ts}"), F.col(f"r.{c.close}")).orderBy(c.asset)


def daily_volume(df: DataFrame, c: Columns = OHLCV) -> DataFrame:
    return df.groupBy(c.asset, _day(c).alias("day")).agg(F.sum(c.volume).alias("volume")).orderBy(c.asset, "day")


def daily_vwap(df: DataFrame, c: Columns = OHLCV) -> DataFrame:
    """Null on days without volume."""
    vwap = F.try_divide(F.sum(F.col(c.close) * F.col(c.volume)), F.sum(c.volume))
    return df.groupBy(c.asset, _day(c).alias("day")).agg(vwap.alias("vwap")).orderBy(c.asset, "day")


def sma(df: DataFrame, n: int, c: Columns = OHLCV) -> DataFrame:
    rows = df.select(c.asset, c.ts, c.close)
    made = trailing(rows, c.asset, c.ts, max(n - 1, 0), lambda w: {f"sma_{n}": F.avg(c.close).over(w.rowsBetween(*_span(n)))})
    return made.orderBy(c.asset, c.ts)


def rolling_volatility(df: DataFrame, n: int, c: Columns = OHLCV) -> DataFrame:
    """Sample deviation of log returns; null with fewer than two returns, NaN where a frame holds a return from or to zero or
    with a change of sign."""
    rows = df.select(c.asset, c.ts, c.close)

    def columns(w):
        change = _ln(_ratio(F.col(c.close), F.lag(c.close, 1).over(w)))
        return {"__r": change, f"volatility_{n}": F.stddev_samp("__r").over(w.rowsBetween(*_span(n)))}

    made = trailing(rows, c.asset, c.ts, max(n, 1), columns)  # the first return of a frame needs one row more
    return made.select(c.asset, c.ts, f"volatility_{n}").orderBy(c.asset, c.ts)


def max_drawdown(df: DataFrame, c: Columns = OHLCV) -> DataFrame:
    peaks = running_max(df.select(c.asset, c.ts, c.close), c.asset, c.ts, c.close, "__peak")
    rows = peaks.select(c.asset, (_ratio(F.col(c.close), F.col("__peak")) - 1).alias("__d"))
    return rows.groupBy(c.asset).agg(F.min("__d").alias("max_drawdown")).orderBy(c.asset)


def volume_by_name(df: DataFrame, names: DataFrame, c: Columns = OHLCV) -> DataFrame:
    """Aggregates before the join, so that it moves a row for each asset."""
    totals = df.groupBy(c.asset).agg(F.sum(c.volume).alias("v"))
    return totals.join(names, c.asset, "inner").groupBy("name").agg(F.sum("v").alias("total_volume")).orderBy("name")


def sql_latest_close(table: str = "crypto_ohlcv") -> str:
    return f"SELECT asset, max(struct(ts, close)).ts AS ts, max(struct(ts, close)).close AS close FROM {table} GROUP BY asset ORDER BY asset"


def sql_daily_volume(table: str = "crypto_ohlcv") -> str:
    return f"SELECT asset, CAST(date_trunc('day', ts) AS timestamp_ntz) AS day, sum(volume) AS volume FROM {table} GROUP BY 1, 2 ORDER BY 1, 2"


def sql_daily_vwap(table: str = "crypto_ohlcv") -> str:
    return (
        f"SELECT asset, CAST(date_trunc('day', ts) AS timestamp_ntz) AS day, try_divide(sum(close * volume), sum(volume)) AS vwap "
        f"FROM {table} GROUP BY 1, 2 ORDER BY 1, 2"
    )


def sql_sma(n: int, table: str = "crypto_ohlcv") -> str:
    frame = f"ROWS BETWEEN {max(n - 1, 0)} PRECEDING AND CURRENT ROW"
    return f"SELECT asset, ts, close, avg(close) OVER (PARTITION BY asset ORDER BY ts {frame}) AS sma_{n} FROM {table} ORDER BY asset, ts"


def sql_rolling_volatility(n: int, table: str = "crypto_ohlcv") -> str:
    frame = f"ROWS BETWEEN {max(n - 1, 0)} PRECEDING AND CURRENT ROW"
    change = "CASE WHEN q > 0 THEN ln(q) WHEN q = 0 THEN CAST('-Infinity' AS DOUBLE) WHEN q < 0 THEN CAST('NaN' AS DOUBLE) END"
    return (
        f"WITH p AS (SELECT asset, ts, close, lag(close) OVER (PARTITION BY asset ORDER BY ts) AS before FROM {table}), "
        f"q AS (SELECT asset, ts, {_sql_ratio('close', 'before')} AS q FROM p), "
        f"r AS (SELECT asset, ts, {change} AS change FROM q) "
        f"SELECT asset, ts, stddev_samp(change) OVER (PARTITION BY asset ORDER BY ts {frame}) AS volatility_{n} FROM r ORDER BY asset, ts"
    )


def sql_max_drawdown(table: str = "crypto_ohlcv") -> str:
    peak = "max(close) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    fall = f"{_sql_ratio('close', 'peak')} - 1.0D"
    return f"WITH p AS (SELECT asset, close, {peak} AS peak FROM {table}) SELECT asset, min({fall}) AS max_drawdown FROM p GROUP BY asset ORDER BY asset"


def metrics_suite(window: int = 24, table: str = "crypto_ohlcv") -> list[tuple[str, str]]:
    return [
        ("latest_close", sql_latest_close(table)),
        ("daily_volume", sql_daily_volume(table)),
        ("daily_vwap", sql_daily_vwap(table)),
        (f"sma_{window}", sql_sma(window, table)),
        (f"volatility_{window}", sql_rolling_volatility(window, table)),
        ("max_drawdown", sql_max_drawdown(table)),
    ]


DATAFRAME_SUITE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "latest_close": latest_close,
    "daily_volume": daily_volume,
    "daily_vwap": daily_vwap,
    "sma_24": lambda df: sma(df, 24),
    "volatility_24": lambda df: rolling_volatility(df, 24),
    "max_drawdown": max_drawdown,
}

# Fixed values of the sample data: assets with base prices, start, step and the generator's constants.
SAMPLE_ASSETS = (("BTC", 40000.0), ("ETH", 2500.0), ("SOL", 90.0))
SAMPLE_START, SAMPLE_STEP = 1_700_000_000, 3600
LCG_SEED, LCG_MULTIPLIER, LCG_INCREMENT = 0x9E3779B97F4A7C15, 6364136223846793005, 1442695040888963407


def sample_candles(hours: int) -> list[tuple]:
    """Deterministic hourly candles: a seeded walk with a slow sine drift, four draws for each candle."""
    import math
    from datetime import UTC, datetime

    rows = []
    for number, (asset, base) in enumerate(SAMPLE_ASSETS, 1):
        state, previous = LCG_SEED ^ number, base

        def draw() -> float:
            nonlocal state
            state = (state * LCG_MULTIPLIER + LCG_INCREMENT) & (2**64 - 1)
            return (state >> 11) / 2**53

        for i in range(hours):
            shock, up, down, size = (draw() for _ in range(4))
            close = max(previous * (1 + math.sin(i / 12) * 0.02 / 24 + (shock - 0.5) * 0.02), base * 0.5)
            top, bottom = max(previous, close) * (1 + up * 0.005), min(previous, close) * (1 - down * 0.005)
            at = datetime.fromtimestamp(SAMPLE_START + i * SAMPLE_STEP, UTC).replace(tzinfo=None)
            rows.append((at, asset, previous, top, bottom, close, base * (50 + 25 * size)))
            previous = close
    return rows


def write_sample(spark: SparkSession, path: str, hours: int = 168) -> None:
    spark.createDataFrame(sample_candles(hours), CANDLES).coalesce(1).write.mode("overwrite").parquet(path)


def run_suite(spark: SparkSession, path: str, hours: int = 168, window: int = 24) -> dict[str, DataFrame]:
    """The whole suite over a folder of candles, which is filled with the sample if it holds no Parquet."""
    from tidemark.sources.parquet import has_parquet, parquet_view

    if not has_parquet(spark, path):
        write_sample(spark, path, hours)
    parquet_view(spark, path, CANDLES, "crypto_ohlcv")
    return {name: spark.sql(sql) for name, sql in metrics_suite(window)}
