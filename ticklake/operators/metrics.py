"""Per-symbol performance metrics.

One ordered pass computes returns and running-maximum drawdowns (window +
scan over the segmented frame); every metric is then a column of a single
``groupBy(symbol).agg`` whose aggregates all combine map-side, so a huge
symbol is pre-aggregated per task before the shuffle.

Deviations (intended behaviour rather than the reference's degenerate
code paths): ``volatility`` is sqrt(periods per year) * std(returns);
``pure_profit_score`` uses the row number as x and R^2; regressions are the
true OLS (no floor division of the slope).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklake.functions import blocks as B
from ticklake.functions.blocks import C, dv, lag
from ticklake.operators.registry import _advance_all
from ticklake.operators.registry import run as run_specs
from ticklake.plans.frame import SeriesFrame

# Calendar constants used for annualisation.
TRADING_DAYS_PER_YEAR = 252
DAYS_PER_MONTH_TT = 30.417


def metrics(bars: DataFrame, benchmark_rate: float = 0.0, calmar_years: int = 3, capital: float = 1.0,
            symbol: str = "symbol", ts: str = "ts", close: str = "close", segment="auto") -> DataFrame:
    """One row per symbol with total_time (all units), cagr, max drawdowns,
    log_max_drawdown, calmar_ratio, sharpe, sortino, downside deviation,
    volatility, optimal leverage, pure profit score, geometric means and the
    close-vs-row linear regression."""
    sym = symbol
    # calmar window: rows newer than (last ts - years * 365.25 days); the last
    # ts per symbol is a small aggregate joined back
    last = bars.groupBy(sym).agg(F.max(ts).alias("__last_ts"))
    span_us = int(365.25 * calmar_years * 86400 * 1_000_000) if calmar_years and calmar_years > 0 else None
    inwin = (F.unix_micros(F.col(ts)) > F.unix_micros(F.col("__last_ts")) - F.lit(span_us)) if span_us else F.lit(True)
    b2 = bars.join(last, sym).withColumn("__inwin", inwin)
    f = SeriesFrame(b2, sym, ts, segment=segment, lookback=2)
    run_specs(f, [dict(kind="drawdown", close=close)])
    # drawdown restricted to the calmar window: running max of in-window closes
    wclose = F.when(F.col("__inwin"), C(close))
    f.with_columns({"__r": dv(C(close), lag(f, close, 1)) - 1,
                    "__lr": B.log(dv(C(close), lag(f, close, 1)))})
    from ticklake.operators.registry import _advance_all

    def _win_dd(f):
        mx = yield B.cummax(f, wclose)
        return {"__wdd_pct": F.when(F.col("__inwin"), 1 - dv(C(close), mx))}

    f.with_columns(_advance_all(f, [(lambda f: _win_dd(f), {}, {})]))
    df = f.df.filter(~F.col("_halo"))
    r = F.col("__r")
    n = F.count(F.lit(1))
    first_c = F.min_by(C(close), "_rn")
    last_c = F.max_by(C(close), "_rn")
    days = F.floor((F.unix_seconds(F.max(ts)) - F.unix_seconds(F.min(ts))) / 86400.0)
    secs = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1e6
    years = days / TRADING_DAYS_PER_YEAR
    win_first = F.min_by(F.when(F.col("__inwin"), C(close)), F.when(F.col("__inwin"), F.col("_rn")))
    win_days = F.floor((F.unix_seconds(F.max(F.when(F.col("__inwin"), F.col(ts)))) -
                        F.unix_seconds(F.min(F.when(F.col("__inwin"), F.col(ts))))) / 86400.0)
    agg = df.groupBy(sym).agg(
        n.alias("n"), first_c.alias("first_close"), last_c.alias("last_close"),
        days.alias("tt_days"), secs.alias("tt_seconds"),
        F.avg(r).alias("mean_ret"), F.stddev_samp(r).alias("std_ret"),
        F.max("DD").alias("max_dd_dollar"), F.max("DD_PCT").alias("max_dd_percent"),
        F.max("DD_LOG").alias("max_dd_log"),
        F.sum(F.ln(F.coalesce(r, F.lit(0.0)) + 1)).alias("sum_log1p"),
        F.min(F.coalesce(r, F.lit(0.0)) + 1).alias("min_1p"),
        F.regr_r2(C(close), F.col("_rn").cast("double")).alias("r2_close_rn"),
        F.regr_slope(C(close), F.col("_rn").cast("double")).alias("lr_b"),
        F.regr_intercept(C(close), F.col("_rn").cast("double")).alias("lr_a"),
        F.corr(C(close), F.col("_rn").cast("double")).alias("lr_r"),
        win_first.alias("__wf"), win_days.alias("__wdays"), F.max("__wdd_pct").alias("__wdd"),
        # downside deviation needs the per-period benchmark, which depends on
        # n / years: its sum of squares is a second aggregate below
    )
    yrs = F.col("tt_days") / TRADING_DAYS_PER_YEAR
    cagr = F.pow(dv(F.col("last_close"), F.col("first_close")), dv(F.lit(1.0), yrs)) - 1
    wcagr = F.pow(dv(F.col("last_close"), F.col("__wf")), dv(F.lit(1.0), F.col("__wdays") / TRADING_DAYS_PER_YEAR)) - 1
    dpy = dv(F.col("n"), yrs)
    adj = F.pow(1 + F.lit(benchmark_rate), dv(F.lit(1.0), dpy)) - 1
    # second pass for downside deviation: sum over rows of max(adj - r, 0)^2
    dd_rows = df.join(agg.select(sym, adj.alias("__adj")), sym)
    ds = dd_rows.groupBy(sym).agg(F.sum(F.when(F.col("__adj") - r > 0, (F.col("__adj") - r) ** 2)).alias("__dss"))
    out = agg.join(ds, sym, "left")
    dsd = F.sqrt(dv(F.coalesce(F.col("__dss"), F.lit(0.0)), F.col("n") - 1)) * F.sqrt(dpy)
    mu = TRADING_DAYS_PER_YEAR * F.col("mean_ret")
    sd = math.sqrt(TRADING_DAYS_PER_YEAR) * F.col("std_ret")
    return out.select(
        sym, "n",
        yrs.alias("tt_years"), dv(F.col("tt_days"), F.lit(DAYS_PER_MONTH_TT)).alias("tt_months"),
        (F.col("tt_days") / 7).alias("tt_weeks"), F.col("tt_days").cast("double").alias("tt_days"),
        (F.col("tt_days") * 24).cast("double").alias("tt_hours"), (F.col("tt_seconds") / 60).alias("tt_minutes"),
        F.col("tt_seconds").cast("double").alias("tt_seconds"),
        cagr.alias("cagr"),
        "max_dd_dollar", "max_dd_percent", "max_dd_log",
        (F.log(F.col("last_close")) - F.log(F.col("first_close")) - F.col("max_dd_log")).alias("log_max_drawdown"),
        dv(wcagr, F.col("__wdd")).alias("calmar_ratio"),
        dv(mu - benchmark_rate, sd).alias("sharpe_ratio"),
        dsd.alias("downside_deviation"),
        dv(cagr - benchmark_rate, dsd).alias("sortino_ratio"),
        (F.sqrt(dpy) * F.col("std_ret")).alias("volatility"),
        (capital * dv(mu - benchmark_rate, sd * sd)).cast("long").alias("optimal_leverage"),
        (F.col("r2_close_rn") * cagr).alias("pure_profit_score"),
        F.when(F.col("n") >= 2, F.when(F.col("min_1p") > 0, F.exp(F.col("sum_log1p") / F.col("n")) - 1)
               .otherwise(F.lit(0.0))).alias("log_geometric_mean"),
        "lr_a", "lr_b", "lr_r",
        dv(F.col("lr_r"), F.sqrt(dv(1 - F.col("lr_r") * F.col("lr_r"), F.col("n") - 2))).alias("lr_t"),
    )


def jensens_alpha(bars: DataFrame, benchmark_symbol: str, symbol: str = "symbol", ts: str = "ts",
                  close: str = "close") -> DataFrame:
    """OLS intercept of each symbol's percent returns on the benchmark's
    returns, aligned by timestamp; where the benchmark has no bar, its return
    is interpolated linearly between its neighbours on the union of all
    timestamps (held at the ends).  The benchmark is one symbol's series
    (bounded by time, not by the number of symbols) joined on ts."""
    f = SeriesFrame(bars, symbol, ts, segment="auto", lookback=2)
    f.with_columns({"__r": dv(C(close), lag(f, close, 1)) - 1})
    rets = f.result(keep=[symbol, ts, "__r"])
    bench = rets.filter(F.col(symbol) == benchmark_symbol).select(F.col(ts), F.col("__r").alias("__br"))
    # the benchmark on every timestamp that occurs
    grid = rets.select(ts).distinct().join(bench, ts, "left").withColumn("__s", F.lit("benchmark"))
    line = SeriesFrame(grid, "__s", ts, segment="auto")

    def between(f):
        known = F.when(C("__br").isNotNull(), F.col("_rn").cast("double"))
        (a, ia, b, ib) = yield B.ffill(f, "__br"), B.ffill(f, known), B.bfill(f, "__br"), B.bfill(f, known)
        share = dv(F.col("_rn") - ia, ib - ia)
        return {"__br": F.coalesce(C("__br"), a + (b - a) * share, a)}

    line.with_columns(_advance_all(line, [(between, {}, {})]))
    j = rets.join(line.result(keep=[ts, "__br"]), ts)
    return j.groupBy(symbol).agg(F.regr_intercept("__r", "__br").alias("jensens_alpha"),
                                 F.regr_slope("__r", "__br").alias("beta"))


def all_null_columns(df: DataFrame) -> list[str]:
    """Names of the columns without any value (one aggregate job)."""
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c] == 0]


def erf(x):
    """Abramowitz-Stegun 7.1.26 approximation as a Column expression."""
    # Coefficients of formula 7.1.26.
    p, a1, a2, a3, a4, a5 = 0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429
    x = C(x)
    s = F.signum(x)
    ax = F.abs(x)
    t = 1.0 / (1.0 + p * ax)
    y = 1.0 - (((((a5 * t + a4) * t) + a3) * t + a2) * t + a1) * t * F.exp(-ax * ax)
    return s * y


def zero(x, eps: float = 2.220446049250313e-16):
    """Snap |x| < eps to 0."""
    x = C(x)
    return F.when(F.abs(x) < eps, F.lit(0.0)).otherwise(x)


def geometric_mean(df: DataFrame, col: str, symbol: str = "symbol") -> DataFrame:
    """Per symbol: product^(1/n) via exp(avg(ln)); with zeros present the
    series is shifted by +1 (nulls -> 0) and 1 is subtracted back; 0 when a
    value is not positive.  One combinable aggregate."""
    x = F.col(col)
    has0 = F.max(F.when(x == 0, 1).otherwise(0))
    s = F.coalesce(x, F.lit(0.0)) + 1
    return df.groupBy(symbol).agg(
        F.when(has0 == 1, F.when(F.min(s) > 0, F.exp(F.avg(F.ln(s))) - 1).otherwise(F.lit(0.0)))
        .otherwise(F.when(F.min(x) > 0, F.exp(F.avg(F.ln(x)))).otherwise(F.lit(0.0))).alias("geometric_mean"))


def df_error_analysis(a: DataFrame, b: DataFrame, col: str, keys=("symbol", "ts")) -> DataFrame:
    """Correlation of one column between two frames aligned on keys."""
    j = a.select(*keys, F.col(col).alias("__a")).join(b.select(*keys, F.col(col).alias("__b")), list(keys))
    return j.agg(F.corr("__a", "__b").alias("corr"))


def risk_ratios(bars: DataFrame, benchmark_rate: float = 0.0, period: float = TRADING_DAYS_PER_YEAR, log: bool = False,
                use_cagr: bool = False, capital: float = 1.0, symbol: str = "symbol", ts: str = "ts", close: str = "close",
                segment="auto") -> DataFrame:
    """Per symbol ``n, mean_return, volatility, sharpe_ratio, optimal_leverage`` with all options.

    ``log`` takes log returns, ``period`` annualises mean and deviation,
    ``use_cagr`` divides the growth rate by the volatility instead.  A symbol
    without two prices, or whose prices never move, has null ratios.
    """
    f = SeriesFrame(bars, symbol, ts, segment=segment, lookback=2)
    step = dv(C(close), lag(f, close, 1))
    f.with_columns({"__r": B.log(step) if log else step - 1})
    days = F.floor((F.unix_seconds(F.max(ts)) - F.unix_seconds(F.min(ts))) / 86400.0)
    sums = f.df.filter(~F.col("_halo")).groupBy(symbol).agg(
        F.count(F.lit(1)).alias("n"), F.avg("__r").alias("mean_return"), F.stddev_samp("__r").alias("__sd"),
        dv(F.max_by(C(close), "_rn"), F.min_by(C(close), "_rn")).alias("__growth"), (days / TRADING_DAYS_PER_YEAR).alias("__years"))
    growth = F.pow(F.col("__growth"), dv(F.lit(1.0), F.col("__years"))) - 1
    volatility = F.sqrt(dv(F.col("n"), F.col("__years"))) * F.col("__sd")
    excess, deviation = period * F.col("mean_return") - benchmark_rate, math.sqrt(period) * F.col("__sd")
    return sums.select(
        symbol, "n", "mean_return", volatility.alias("volatility"),
        (dv(growth, volatility) if use_cagr else dv(excess, deviation)).alias("sharpe_ratio"),
        (capital * dv(excess, deviation * deviation)).cast("long").alias("optimal_leverage"))


def linear_regression(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Ordinary least squares of ``y`` on ``x`` per group: ``n, a`` (intercept), ``b`` (slope), ``r, t``.

    Rows where either is null are left out; one combinable aggregate.  With
    fewer than two distinct ``x`` the line is null, with two rows ``t`` is.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    a, b = C(y).cast("double"), C(x).cast("double")
    out = both.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.regr_intercept(a, b).alias("a"), F.regr_slope(a, b).alias("b"), F.corr(b, a).alias("r"))
    r = F.col("r")
    return out.withColumn("t", dv(r, F.sqrt(dv(F.greatest(1 - r * r, F.lit(0.0)), F.when(F.col("n") > 2, F.col("n") - 2)))))
