"""Tick -> OHLCV bars (open=first, high=max, low=min, close=last, volume=sum).

One ``groupBy(symbol, bucket)`` with ``min_by``/``max_by``: all five
aggregates combine map-side, so a hot symbol's ticks are pre-aggregated
before the shuffle and every bucket is its own group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_COLS = ["symbol", "ts", "open", "high", "low", "close", "volume"]
_TRUNC = {"second", "minute", "hour", "day", "week", "month", "quarter", "year"}


def bucket(ts: Column, every: str) -> Column:
    """Calendar unit (``hour``, ``week``...) via date_trunc, else a fixed
    interval (``"5 minutes"``) via ``window`` start."""
    if every in _TRUNC:
        return F.date_trunc(every, ts).cast("timestamp")
    return F.window(ts, every).start.cast("timestamp")


def bars(df: DataFrame, symbol: str, ts: str, price: str | Column, volume: str | Column | None = None,
         every: str = "hour", order: list | None = None) -> DataFrame:
    """Aggregate ticks into bars.  ``order`` = tie-breaking columns after ts
    for first/last; ``volume`` None counts ticks."""
    t = F.col(ts).cast("timestamp")
    keys = [t] + [F.col(c) for c in (order or [])]
    okey = F.struct(*keys) if len(keys) > 1 else t
    p = F.col(price) if isinstance(price, str) else price
    v = F.count(F.lit(1)) if volume is None else F.sum(F.col(volume) if isinstance(volume, str) else volume)
    return (df.select(F.col(symbol).cast("string").alias("symbol"), bucket(t, every).alias("ts"),
                      okey.alias("_o"), p.cast("double").alias("_p"),
                      *([] if volume is None else [(F.col(volume) if isinstance(volume, str) else volume).alias("_v")]))
            .groupBy("symbol", "ts")
            .agg(F.min_by("_p", "_o").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"),
                 F.max_by("_p", "_o").alias("close"),
                 (F.count(F.lit(1)) if volume is None else F.sum("_v")).cast("long").alias("volume")))


def bars_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars from ``events``: symbol=event_type, price=value, volume=#events."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return bars(ev, "event_type", "ts", "value", None, "hour", order=["event_id"])


def bars_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars from ``lineitem``: symbol=l_suppkey, price=extendedprice/quantity,
    volume=sum(quantity); first/last by (shipdate, orderkey, linenumber)."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return bars(li, "l_suppkey", "l_shipdate", price, "l_quantity", "week",
                order=["l_orderkey", "l_linenumber"])


# SQL twins used by the DuckDB oracle (same definitions)
BARS_H_SQL = """
SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts,
       arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
       arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS BIGINT) AS volume
FROM events GROUP BY 1, 2
"""

BARS_W_SQL = """
SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS ts,
       arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS open,
       max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
       arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS close,
       CAST(sum(l_quantity) AS BIGINT) AS volume
FROM lineitem GROUP BY 1, 2
"""
