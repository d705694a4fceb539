"""Signals and crossings (0/1 flags), candle helpers, trade tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklake.functions import blocks as B
from ticklake.functions.blocks import C, lag, nz_range
from ticklake.operators.registry import indicator
from ticklake.operators.metrics import zero


def _name(v):
    return f"{v}".replace(".", "_")


def above_col(a, b):
    return F.coalesce(zero(a) >= zero(b), F.lit(False))


def below_col(a, b):
    return F.coalesce(zero(a) <= zero(b), F.lit(False))


def cross_col(f, a, b, above: bool = True):
    """above: a > b now and a < b on the previous row; below: neither (so it
    is 1 on the first row and on ties, as in the reference)."""
    a, b = B.mat(f, zero(a)), B.mat(f, zero(b))
    cur = F.coalesce(a > b, F.lit(False))
    prev = F.coalesce(lag(f, a, 1) < lag(f, b, 1), F.lit(False))
    return (cur & prev) if above else (~cur & ~prev)


@indicator("above", "utility")
def above(f, series_a="close", series_b="open", asint=True):
    v = above_col(C(series_a), C(series_b))
    return {f"{series_a}_A_{series_b}": v.cast("int") if asint else v}


@indicator("below", "utility")
def below(f, series_a="close", series_b="open", asint=True):
    v = below_col(C(series_a), C(series_b))
    return {f"{series_a}_B_{series_b}": v.cast("int") if asint else v}


@indicator("above_value", "utility")
def above_value(f, series_a="close", value=0.0, asint=True):
    v = above_col(C(series_a), F.lit(float(value)))
    return {f"{series_a}_A_{_name(value)}": v.cast("int") if asint else v}


@indicator("below_value", "utility")
def below_value(f, series_a="close", value=0.0, asint=True):
    v = below_col(C(series_a), F.lit(float(value)))
    return {f"{series_a}_B_{_name(value)}": v.cast("int") if asint else v}


@indicator("cross", "utility")
def cross(f, series_a="close", series_b="open", above=True, asint=True):
    v = cross_col(f, C(series_a), C(series_b), above)
    return {f"{series_a}_{'XA' if above else 'XB'}_{series_b}": v.cast("int") if asint else v}


@indicator("cross_value", "utility")
def cross_value(f, series_a="close", value=0.0, above=True, asint=True):
    v = cross_col(f, C(series_a), F.lit(float(value)), above)
    return {f"{series_a}_{'XA' if above else 'XB'}_{_name(value)}": v.cast("int") if asint else v}


@indicator("signals", "utility")
def signals(f, indicator="close", xa=None, xb=None, cross_values=False, xserie=None, xserie_a=None,
            xserie_b=None, cross_series=True):
    """Level and series crossings of an indicator column (0/1 columns)."""
    out = {}
    ind = C(indicator)
    if isinstance(xa, (int, float)) and not isinstance(xa, bool):
        if cross_values:
            out[f"{indicator}_XA_{_name(xa)}"] = cross_col(f, ind, F.lit(float(xa)), True).cast("int")
            out[f"{indicator}_XB_{_name(xa)}"] = cross_col(f, ind, F.lit(float(xa)), False).cast("int")
        else:
            out[f"{indicator}_A_{_name(xa)}"] = above_col(ind, F.lit(float(xa))).cast("int")
    if isinstance(xb, (int, float)) and not isinstance(xb, bool):
        if cross_values:
            out[f"{indicator}_XA_{_name(xb)}"] = cross_col(f, ind, F.lit(float(xb)), True).cast("int")
            out[f"{indicator}_XB_{_name(xb)}"] = cross_col(f, ind, F.lit(float(xb)), False).cast("int")
        else:
            out[f"{indicator}_B_{_name(xb)}"] = below_col(ind, F.lit(float(xb))).cast("int")
    sa, sb = xserie_a or xserie, xserie_b or xserie
    if sa:
        out[f"{indicator}_{'XA' if cross_series else 'A'}_{sa}"] = (
            cross_col(f, ind, C(sa), True) if cross_series else above_col(ind, C(sa))).cast("int")
    if sb:
        out[f"{indicator}_{'XB' if cross_series else 'B'}_{sb}"] = (
            cross_col(f, ind, C(sb), False) if cross_series else below_col(ind, C(sb))).cast("int")
    return out


def signed_series(f, x, initial=None):
    d = F.signum(C(x) - lag(f, x, 1))
    first = F.lit(None).cast("double") if initial is None else F.lit(float(initial))
    return F.when(F.col("_rn") == 1, first).otherwise(d)


def unsigned_differences(f, x, amount: int = 1, asint: bool = False):
    d = F.coalesce(C(x) - lag(f, x, amount), F.lit(0.0))
    pos = F.when(d > 0, 1).otherwise(0)
    neg = F.when(d < 0, 1).otherwise(0)
    return (pos, neg) if asint else (pos.cast("double"), neg.cast("double"))


def candle_color(open_="open", close="close"):
    return F.when(C(close) >= C(open_), F.lit(1)).otherwise(F.lit(-1))


def real_body(open_="open", close="close"):
    return nz_range(close, open_)


def high_low_range(high="high", low="low"):
    return nz_range(high, low)


def recent_extreme_index(f, x, n: int, maximum: bool = True):
    """Rows since the most recent maximum (minimum) in the last n rows."""
    rn = F.col("_rn")
    x = B.mat(f, C(x))
    w = f.rows(n, 0, x)
    at = F.max_by(rn, F.struct(x, rn)).over(w) if maximum else F.min_by(rn, F.struct(x, -rn)).over(w)
    return rn - at


def trade_table(df: DataFrame, trend: str = "TS_Trends", trades: str = "TS_Trades", price: str = "close",
                symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """Rows where a trade happens, with entry / exit price columns."""
    t = df.filter(F.col(trades) != 0)
    return t.select(symbol, ts, F.col(trades).alias("trade"),
                    F.when(F.col(trades) > 0, F.col(price)).alias("entry_price"),
                    F.when(F.col(trades) < 0, F.col(price)).alias("exit_price"))


def trade_summary(df: DataFrame, trend: str = "TS_Trends", trades: str = "TS_Trades", symbol: str = "symbol") -> DataFrame:
    """Per symbol: coverage (share of rows in a trend), entries, exits and
    round trips (min of both): one combinable aggregate."""
    return df.groupBy(symbol).agg(F.avg(F.col(trend).cast("double")).alias("coverage"),
                                  F.sum(F.when(F.col(trades) > 0, 1).otherwise(0)).alias("entries"),
                                  F.sum(F.when(F.col(trades) < 0, 1).otherwise(0)).alias("exits")) \
        .withColumn("round_trips", F.least("entries", "exits"))


def open_trades(df: DataFrame, trend: str = "TS_Trends", trades: str = "TS_Trades", price: str = "close",
                symbol: str = "symbol", ts: str = "ts", segment="auto") -> DataFrame:
    """Every row of a trend with the price it was entered at and the unrealised
    result of the open trade; null outside trends.  The entry price is
    carried forward on the segmented frame."""
    from ticklake.operators.registry import _advance_all
    from ticklake.plans.frame import SeriesFrame
    f = SeriesFrame(df, symbol, ts, segment=segment)

    def carried(f):
        entry = yield B.ffill(f, F.when(C(trades) > 0, C(price).cast("double")))
        return {"entry_price": entry}

    f.with_columns(_advance_all(f, [(carried, {}, {})]))
    inside = F.col(trend).cast("int") > 0
    return f.result().withColumn("entry_price", F.when(inside, F.col("entry_price"))).withColumn(
        "unrealised", F.try_divide(F.col(price), F.col("entry_price")) - 1)
