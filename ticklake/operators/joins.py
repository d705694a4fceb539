"""Joins of several bar sources and time filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklake.functions import blocks as B
from ticklake.operators.registry import _advance_all
from ticklake.plans.frame import SeriesFrame


def composite_join(sources: dict[str, DataFrame], on: list[str] = ("ts",), ffill: bool = True,
                   series: str = "composite", skip_empty: bool = True) -> DataFrame:
    """Full outer join of several sources on ``on``; colliding column names
    get a ``_<source>`` suffix; empty sources are skipped (all empty ->
    error); each joined series is forward filled in the order of the last
    ``on`` column.

    The other ``on`` columns name the series (``on=["symbol", "ts"]`` fills per
    symbol); with one column there is one series.  The fill runs on the
    segmented frame, so a long composite is still split over many tasks."""
    on = list(on)
    items = [(n, d) for n, d in sources.items() if not (skip_empty and d.isEmpty())]
    if not items:
        raise ValueError("All data sources returned empty frames")
    counts = {}
    for _, d in items:
        for c in d.columns:
            if c not in on:
                counts[c] = counts.get(c, 0) + 1
    renamed = []
    for n, d in items:
        renamed.append(d.select(*[F.col(c) for c in on],
                                *[F.col(c).alias(f"{c}_{n}" if counts[c] > 1 else c) for c in d.columns if c not in on]))
    out = renamed[0]
    for d in renamed[1:]:
        out = out.join(d, on, "full_outer")
    if not ffill:
        return out
    key = "__series"
    out = out.withColumn(key, F.to_json(F.struct(*on[:-1])) if len(on) > 1 else F.lit(series))
    ts = on[-1]
    f = SeriesFrame(out, key, ts, segment="auto", lookback=1)
    cols = [c for c in out.columns if c not in on and c != key]

    def gen(f):
        ys = yield tuple(B.ffill(f, c) for c in cols)
        return dict(zip(cols, ys))

    f.with_columns(_advance_all(f, [(gen, {}, {})]))
    return f.result().drop(key)


def common_start(df: DataFrame, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """Rows strictly after the latest first timestamp over all symbols
    (min per symbol, then max: one small aggregate job returning a scalar,
    then a plain filter that prunes at the scan)."""
    start = df.groupBy(symbol).agg(F.min(ts).alias("__f")).agg(F.max("__f").alias("s")).first()["s"]
    return df if start is None else df.filter(F.col(ts) > F.lit(start))


def date_range(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    c = F.col(ts)
    if start is not None:
        df = df.filter(c >= F.lit(start))
    if end is not None:
        df = df.filter(c <= F.lit(end))
    return df


def dates_filter(df: DataFrame, dates: list | DataFrame | None, ts: str = "ts") -> DataFrame | None:
    """Rows whose timestamp is in ``dates`` (a list or a one-column table)."""
    if dates is None:
        return None
    if isinstance(dates, DataFrame):
        d = dates.select(F.col(dates.columns[0]).cast("timestamp").alias(ts))
        return df.join(d, ts, "left_semi")
    return df.filter(F.col(ts).isin([F.lit(x).cast("timestamp") for x in dates]))


def period_to_date(df: DataFrame, period: str, as_of, ts: str = "ts") -> DataFrame:
    """Month / quarter / year to date as of ``as_of`` (a parameter, not the
    wall clock); the whole frame when no row qualifies.  QTD uses the
    current quarter's start (the reference jumps to the next quarter unless
    the month starts one)."""
    unit = {"mtd": "month", "qtd": "quarter", "ytd": "year"}[period.lower()]
    start = F.date_trunc(unit, F.lit(as_of).cast("timestamp"))
    sub = df.filter(F.col(ts) >= start)
    return df if sub.isEmpty() else sub


def tail(df: DataFrame, k: int, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """Newest k rows per symbol (a top-k: planned as a group limit)."""
    from pyspark.sql import Window
    w = Window.partitionBy(symbol).orderBy(F.col(ts).desc())
    return df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k).drop("__k")


def to_utc(df: DataFrame, ts: str = "ts", tz: str | None = None) -> DataFrame:
    """Localise naive timestamps from ``tz`` (or convert) to UTC."""
    if tz:
        return df.withColumn(ts, F.to_utc_timestamp(F.col(ts), tz))
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def is_ordered(df: DataFrame, symbol: str = "symbol", ts: str = "ts") -> bool:
    """True when every symbol's timestamps strictly increase in the order in
    which the rows stand (files in name order, rows as written).

    Each split of the input sums a symbol's rows up as (first, last, in order);
    the sums, one row per split and symbol, are combined in split order.  No
    symbol is gathered in one task."""
    from pyspark.sql import Window
    sums = order_summary(df, symbol, ts)
    before = F.lag("last").over(Window.partitionBy("symbol").orderBy("split"))
    return sums.withColumn("before", before).filter("NOT in_order OR first <= before").isEmpty()


def order_summary(df: DataFrame, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """``symbol, split, first, last, in_order, n`` of each input split and symbol; summaries of neighbouring splits combine."""
    from pyspark.sql import Window
    at = df.select(F.col(symbol).alias("symbol"), F.col(ts).alias("t")).withColumn("at", F.monotonically_increasing_id())
    at = at.withColumn("split", F.shiftright("at", 33))
    before = F.lag("t").over(Window.partitionBy("symbol", "split").orderBy("at"))
    rows = at.withColumn("before", before)
    return rows.groupBy("symbol", "split").agg(
        F.min_by("t", "at").alias("first"), F.max_by("t", "at").alias("last"),
        F.every(F.col("t").isNotNull() & F.coalesce(F.col("before") < F.col("t"), F.col("before").isNull())).alias("in_order"),
        F.count(F.lit(1)).alias("n"))


def resolve(df: DataFrame, name: str) -> str:
    """The column meant by ``name``: its exact name, the same in another case, or
    the only column that starts with it.  Several or none raise."""
    if name in df.columns:
        return name
    low = name.lower()
    for found in ([c for c in df.columns if c.lower() == low], [c for c in df.columns if c.lower().startswith(low)]):
        if len(found) == 1:
            return found[0]
        if found:
            raise KeyError(f"{name!r} may be any of {found}")
    raise KeyError(f"no column {name!r} in {df.columns}")


def constants(df: DataFrame, values) -> DataFrame:
    """One column per value, named by it, for levels that series are compared with."""
    return df.withColumns({str(v): F.lit(float(v)) for v in values})


def in_order(df: DataFrame, symbol: str = "symbol", ts: str = "ts", newest_first: bool = False) -> DataFrame:
    """Rows sorted by symbol and time (a range-partitioned sort), or newest first."""
    return df.orderBy(F.col(symbol), F.col(ts).desc() if newest_first else F.col(ts))
