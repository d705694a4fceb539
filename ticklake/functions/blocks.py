"""Column building blocks over a ``SeriesFrame``.

Bounded look-back pieces (rolling aggregates, lags, constant-weight sums,
rolling regressions) are plain window expressions.  Unbounded recurrences
(EMA, RMA, running sums / extremes) are returned as ``Need`` objects: an
indicator written as a generator ``yield``s them, the runner batches the
needs of all indicators of a step into one scan pass and sends back Columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ticklake.functions import long_ranks, long_windows
from ticklake.plans.frame import Scan, SeriesFrame, fresh

EPS = 2.220446049250313e-16  # float64 machine epsilon, added by non_zero_range

col = F.col


def C(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def has_window(x) -> bool:
    return not isinstance(x, str) and " OVER (" in str(x)


def mat(f: SeriesFrame, x) -> Column:
    """Materialise an input that already holds window functions (Spark does
    not nest windows); plain column expressions stay inline."""
    if has_window(x):
        nm = fresh("m")
        f.with_columns({nm: x})
        return F.col(nm)
    return C(x)


@dataclass
class Need:
    scans: list
    finish: Callable
    reverse: bool = False


# ----------------------------------------------------------- bounded windows
def roll(f: SeriesFrame, x, n: int, agg: str = "avg", minp: int | None = None, end: int = 0) -> Column:
    """``rolling(n, min_periods=minp).agg()`` as a ROWS frame; null below minp.
    Long windows are put together from blocks (``long_windows``), their quantiles
    and absolute deviations from counted ranks (``long_ranks``)."""
    x = mat(f, x)
    minp = n if minp is None else minp
    if n > long_windows.LONG and end == 0 and long_windows.supported(agg):
        return long_windows.rolling(f, x, n, agg, minp)
    if n > long_windows.LONG and end == 0 and (agg == "mad" or agg.startswith("q")):
        return long_ranks.rolling(f, x, n, agg, minp)
    w = f.rows(n, end, x)
    fns = {"avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "std": F.stddev_samp,
           "stdp": F.stddev_pop, "var": F.var_samp, "varp": F.var_pop, "count": F.count,
           "skew": F.skewness, "kurt": F.kurtosis}
    if agg in fns:
        v = fns[agg](x).over(w)
    elif agg.startswith("q"):
        v = F.percentile(x, float(agg[1:])).over(w)
    elif agg == "mad":
        arr = F.collect_list(x).over(w)
        mean = F.aggregate(arr, F.lit(0.0), lambda a, v: a + v) / F.size(arr)
        v = F.aggregate(arr, F.lit(0.0), lambda a, v: a + F.abs(v - mean)) / F.size(arr)
    else:
        raise ValueError(agg)
    if minp <= 0:
        return v
    return F.when(F.count(x).over(w) >= minp, v)


def sma(f, x, n, minp=None):
    return roll(f, x, n, "avg", minp)


def rsum(f, x, n, minp=None):
    return roll(f, x, n, "sum", minp)


def rmax(f, x, n, minp=None):
    return roll(f, x, n, "max", minp)


def rmin(f, x, n, minp=None):
    return roll(f, x, n, "min", minp)


def lag(f: SeriesFrame, x, k: int = 1) -> Column:
    if k == 0:
        return C(x)
    x = mat(f, x)
    f.reached(max(k, 0), max(-k, 0), x)
    return F.lead(C(x), -k).over(f.w) if k < 0 else F.lag(C(x), k).over(f.w)


def diff(f, x, k=1):
    return C(x) - lag(f, x, k)


def fir(f: SeriesFrame, x, weights: list[float]) -> Column:
    """sum_i weights[i] * x[t - (n-1) + i] (weights oldest -> newest); null
    until n rows exist or when any input in the frame is null."""
    n = len(weights)
    x = mat(f, x)
    if n <= 48:
        terms = [F.lit(float(wt)) * lag(f, x, n - 1 - i) for i, wt in enumerate(weights)]
        s = terms[0]
        for t in terms[1:]:
            s = s + t
        return s
    w = f.rows(n, 0, x)
    arr = F.collect_list(x).over(w)
    wl = F.array(*[F.lit(float(v)) for v in weights])
    dot = F.aggregate(F.zip_with(arr, wl, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.count(x).over(w) == n, dot)


def rn(f) -> Column:
    return F.col("_rn")


def regr(f: SeriesFrame, y, n: int):
    """Rolling OLS of y on x = 1..n inside the window: (slope, intercept at x=0,
    r).  Uses the global row number as x and rebases the intercept."""
    y = mat(f, y)
    w = f.rows(n, 0, y)
    x = F.col("_rn").cast("double")
    ok = F.count(y).over(w) == n
    m = F.regr_slope(y, x).over(w)
    b_raw = F.regr_intercept(y, x).over(w)
    # intercept for x' = x - (rn - n): window positions 1..n
    base = F.col("_rn").cast("double") - n
    b = b_raw + m * base
    r = F.corr(y, x).over(w)
    return F.when(ok, m), F.when(ok, b), F.when(ok, r)


def nz_range(hi, lo) -> Column:
    d = C(hi) - C(lo)
    return F.when(d == 0, F.lit(EPS)).otherwise(d)


def div(a, b) -> Column:
    """a / b, null for b == 0 (pandas gives inf/nan there; ANSI mode raises)."""
    return F.try_divide(C(a), C(b))


dv = div


def sign(x) -> Column:
    return F.signum(C(x))


# ----------------------------------------------------------- unbounded scans
def ema(f, x, n: int, warm: int = 0, sma_seed: bool = True, alpha: float | None = None,
        sliced: bool = False) -> Need:
    """pandas-style EMA: ``ewm(span=n, adjust=False)``; with ``sma_seed`` row n
    holds the mean of the first n rows (nulls skipped).  ``warm`` = number of
    leading null rows of x (known from the producing indicator).  ``sliced``:
    the series is first cut to its first valid row (MACD signal), so the seed
    is the mean of the first n valid values."""
    x = C(x)
    a = (1.0 - 2.0 / (n + 1)) if alpha is None else (1.0 - alpha)
    al = 1.0 - a
    k = F.col("_rn")
    if sma_seed and sliced:
        start = warm + n
        seed = roll(f, x, n, "avg", minp=1)
    elif sma_seed and warm < n:
        start = n
        seed = roll(f, x, n, "avg", minp=1)
    else:
        start = warm + 1
        seed = x
    b = (F.when(k < start, F.lit(0.0)).when(k == start, seed)
         .otherwise(F.when(x.isNull(), F.lit(0.0)).otherwise(al * x)))
    return Need([Scan(b=b, a=float(a), decays=(k > start) & x.isNotNull())], lambda ys: F.when(k >= start, ys[0]))


def ewm_adjusted(f, x, alpha: float, minp: int = 0, warm: int = 0) -> Need:
    """pandas ``ewm(alpha, adjust=True, min_periods=minp).mean()`` as
    numerator / denominator scans (exact also across interior nulls)."""
    x = C(x)
    a = 1.0 - alpha
    num = Scan(b=F.when(x.isNull(), F.lit(0.0)).otherwise(x), a=a)
    den = Scan(b=F.when(x.isNull(), F.lit(0.0)).otherwise(F.lit(1.0)), a=a)
    k = F.col("_rn")

    def fin(ys):
        v = F.when(ys[1] > 0, F.try_divide(ys[0], ys[1]))
        return F.when(k >= warm + max(minp, 1), v)

    return Need([num, den], fin)


def rma(f, x, n: int, warm: int = 0) -> Need:
    """Wilder average in its adjusted form: ``ewm(alpha=1/n,
    adjust=True, min_periods=n)``."""
    return ewm_adjusted(f, x, 1.0 / n, minp=n, warm=warm)


def _running(f):
    return f.w.rowsBetween(Window.unboundedPreceding, 0)


def _native(f) -> bool:
    """Unsegmented frames hold each symbol in one window partition, so
    running aggregates are exact native windows (no Python pass)."""
    return f.segment is None and not f.dry


def cumsum(f, x) -> Need:
    if _native(f):
        x = mat(f, x)
        return Need([], lambda ys: F.when(x.isNotNull(), F.sum(x).over(_running(f))))
    return Need([Scan(b=C(x), kind="sum")], lambda ys: ys[0])


def cummax(f, x) -> Need:
    if _native(f):
        x = mat(f, x)
        return Need([], lambda ys: F.when(x.isNotNull(), F.max(x).over(_running(f))))
    return Need([Scan(b=C(x), kind="max")], lambda ys: ys[0])


def cummin(f, x) -> Need:
    if _native(f):
        x = mat(f, x)
        return Need([], lambda ys: F.when(x.isNotNull(), F.min(x).over(_running(f))))
    return Need([Scan(b=C(x), kind="min")], lambda ys: ys[0])


def linrec(f, a, b, start: int = 1) -> Need:
    """Generic y = a*y + b from row ``start`` (zero state before)."""
    k = F.col("_rn")
    bb = F.when(k < start, F.lit(0.0)).otherwise(F.coalesce(C(b), F.lit(0.0)))
    if isinstance(a, float):
        one = Scan(b=bb, a=a, decays=k > start)
    else:
        one = Scan(b=bb, a=F.when(k <= start, F.lit(1.0)).otherwise(F.coalesce(C(a), F.lit(1.0))))
    return Need([one], lambda ys: F.when(k >= start, ys[0]))


def ffill(f, x) -> Need:
    """Last non-null value so far (null before the first one): the affine
    recurrence y = 0*y + x on values and y = 1*y on nulls, plus a seen flag."""
    if _native(f):
        x = mat(f, x)
        return Need([], lambda ys: F.last(x, ignorenulls=True).over(_running(f)).cast("double"))
    x = C(x)
    has = F.when(x.isNull(), F.lit(0.0)).otherwise(F.lit(1.0))
    val = Scan(b=F.coalesce(x.cast("double"), F.lit(0.0)), a=1.0 - has)
    seen = Scan(b=has, a=1.0 - has)
    return Need([val, seen], lambda ys: F.when(ys[1] > 0.5, ys[0]))


def bfill(f, x) -> Need:
    """Next non-null value (null after the last one): ``ffill`` run backwards."""
    if _native(f):
        x = mat(f, x)
        return Need([], lambda ys: F.first(x, ignorenulls=True).over(
            f.w.rowsBetween(0, Window.unboundedFollowing)).cast("double"))
    n = ffill(f, x)
    return Need(n.scans, n.finish, reverse=True)


MA_SCAN = {"ema", "rma", "dema", "tema", "t3", "zlma", "kama", "vidya"}


def log(x) -> Column:
    x = C(x)
    return F.when(x > 0, F.log(x))


def weights_wma(n):
    return [float(i) for i in range(1, n + 1)]


def weights_sum_norm(w):
    s = sum(w)
    return [v / s for v in w]


def roundx(x, d=4):
    return F.round(C(x), d)


__all__ = [n for n in dir() if not n.startswith("_")] + ["math"]
