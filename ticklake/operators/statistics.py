"""Rolling statistics."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ticklake.functions import blocks as B
from ticklake.functions.blocks import C, dv
from ticklake.operators.registry import indicator


def _len(v, d):
    return int(v) if v and v > 0 else d


def _ddof(v, n):
    return int(v) if isinstance(v, int) and not isinstance(v, bool) and 0 <= v < n else 1


@indicator("entropy", "statistics")
def entropy(f, close="close", length=10, base=2.0):
    n, b = _len(length, 10), float(base) if base and base > 0 else 2.0
    p = dv(C(close), B.rsum(f, close, n))
    t = -p * B.log(p) / math.log(b)
    return {f"ENTP_{n}": B.rsum(f, t, n)}


@indicator("kurtosis", "statistics")
def kurtosis(f, close="close", length=30, min_periods=None):
    """pandas' bias-corrected excess kurtosis from Spark's population one."""
    n = _len(length, 30)
    mp = int(min_periods) if min_periods is not None else n
    x = B.mat(f, C(close))
    w = f.rows(n, 0, x)
    cnt = F.count(x).over(w)
    g2 = F.kurtosis(x).over(w)
    k = (cnt - 1) / ((cnt - 2) * (cnt - 3)) * ((cnt + 1) * g2 + 6)
    return {f"KURT_{n}": F.when((cnt >= F.greatest(F.lit(mp), F.lit(4))), k)}


@indicator("skew", "statistics")
def skew(f, close="close", length=30, min_periods=None):
    n = _len(length, 30)
    mp = int(min_periods) if min_periods is not None else n
    x = B.mat(f, C(close))
    w = f.rows(n, 0, x)
    cnt = F.count(x).over(w)
    g1 = F.skewness(x).over(w)
    return {f"SKEW_{n}": F.when(cnt >= F.greatest(F.lit(mp), F.lit(3)), g1 * F.sqrt(cnt * (cnt - 1)) / (cnt - 2))}


@indicator("mad", "statistics")
def mad(f, close="close", length=30):
    n = _len(length, 30)
    from ticklake.operators.momentum import mad_col
    return {f"MAD_{n}": mad_col(f, close, n)}


@indicator("median", "statistics")
def median(f, close="close", length=30, min_periods=None):
    n = _len(length, 30)
    return {f"MEDIAN_{n}": B.roll(f, close, n, "q0.5", min_periods)}


@indicator("quantile", "statistics")
def quantile(f, close="close", length=30, q=0.5, min_periods=None):
    n = _len(length, 30)
    q = float(q) if q and 0 < q < 1 else 0.5
    return {f"QTL_{n}_{q}": B.roll(f, close, n, f"q{q}", min_periods)}


def stdev_col(f, x, n, ddof=1):
    v = B.roll(f, x, n, "varp" if ddof == 0 else "var")
    if ddof not in (0, 1):
        cnt = F.count(C(x)).over(f.rows(n, 0, x))
        v = B.roll(f, x, n, "varp") * cnt / (cnt - ddof)
    return F.sqrt(v)


@indicator("stdev", "statistics")
def stdev(f, close="close", length=30, ddof=1):
    n = _len(length, 30)
    return {f"STDEV_{n}": stdev_col(f, close, n, _ddof(ddof, n))}


@indicator("variance", "statistics")
def variance(f, close="close", length=30, ddof=1):
    n = _len(length, 30)
    d = _ddof(ddof, n)
    return {f"VAR_{n}": stdev_col(f, close, n, d) ** 2 if d not in (0, 1)
            else B.roll(f, close, n, "varp" if d == 0 else "var")}


@indicator("zscore", "statistics")
def zscore(f, close="close", length=30, std=1.0):
    n, s = _len(length, 30), float(std) if std and std > 0 else 1.0
    return {f"ZS_{n}": dv(C(close) - B.sma(f, close, n), s * stdev_col(f, close, n, 1))}


@indicator("tos_stdevall", "statistics")
def tos_stdevall(f, close="close", length=None, stds=None, ddof=1):
    """One least-squares line per symbol over its whole history (or its last
    ``length`` rows) with +-k standard-deviation bands.  A per-symbol
    aggregate (map-side combinable) joined back, never a whole-symbol window."""
    stds = stds if isinstance(stds, list) and stds else [1, 2, 3]
    props = "TOS_STDEVALL"
    sym = f.symbol
    real = f.df.filter(~F.col("_halo"))
    x = F.col("_rn").cast("double")
    if length is not None:
        length = int(length) if isinstance(length, int) and length > 2 else 30
        props = f"{props}_{length}"
    dd = int(ddof) if ddof is not None and ddof >= 0 else 1
    src = real
    if length is not None:
        tot = real.groupBy(sym).agg(F.max("_rn").alias("__n"))
        src = real.join(tot, sym).filter(F.col("_rn") > F.col("__n") - length)
    agg = src.groupBy(sym).agg(F.regr_slope(C(close), x).alias("__m"), F.regr_intercept(C(close), x).alias("__b"),
                               F.var_pop(C(close)).alias("__vp"), F.count(C(close)).alias("__c"),
                               F.min("_rn").alias("__r0"))
    f.df = f.df.join(agg, sym, "left")
    # X = 0..len-1 over the covered rows
    lr = F.col("__m") * x + F.col("__b")
    sd = F.sqrt(F.col("__vp") * F.col("__c") / (F.col("__c") - dd))
    cover = F.col("_rn") >= F.col("__r0")
    out = {f"{props}_LR": F.when(cover, lr)}
    for i in stds:
        out[f"{props}_L_{i}"] = F.when(cover, lr - i * sd)
        out[f"{props}_U_{i}"] = F.when(cover, lr + i * sd)
    return out
