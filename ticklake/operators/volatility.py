"""Volatility indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticklake.functions import blocks as B
from ticklake.functions.blocks import C, dv, lag, nz_range
from ticklake.operators.overlap import ma_gen
from ticklake.operators.registry import indicator


def _len(v, d):
    return int(v) if v and v > 0 else d


def _f(v, d):
    return float(v) if v else d


def true_range_col(f, high, low, close, drift=1):
    pc = lag(f, close, drift)
    hl = nz_range(high, low)
    tr = F.greatest(F.abs(hl), F.abs(C(high) - pc), F.abs(pc - C(low)))
    return F.when(F.col("_rn") > drift, tr)


def atr_gen(f, high, low, close, n, mamode="rma", drift=1):
    tr = true_range_col(f, high, low, close, drift)
    return (yield from ma_gen(f, mamode, tr, n, warm=drift))


@indicator("true_range", "volatility")
def true_range(f, high="high", low="low", close="close", drift=1):
    d = int(drift or 1)
    return {f"TRUERANGE_{d}": true_range_col(f, high, low, close, d)}


@indicator("atr", "volatility")
def atr(f, high="high", low="low", close="close", length=14, mamode="rma", drift=1, percent=False):
    n = _len(length, 14)
    mm = mamode.lower() if isinstance(mamode, str) else "rma"
    a = yield from atr_gen(f, high, low, close, n, mm, int(drift or 1))
    if percent:
        a = a * dv(F.lit(100.0), C(close))
    return {f"ATR{mm[0]}_{n}{'p' if percent else ''}": a}


@indicator("natr", "volatility")
def natr(f, high="high", low="low", close="close", length=14, scalar=100, mamode="ema", drift=1):
    n, s = _len(length, 14), _f(scalar, 100.0)
    mm = mamode.lower() if isinstance(mamode, str) else "ema"
    a = yield from atr_gen(f, high, low, close, n, mm, int(drift or 1))
    return {f"NATR_{n}": dv(F.lit(s), C(close)) * a}


@indicator("aberration", "volatility")
def aberration(f, high="high", low="low", close="close", length=5, atr_length=15):
    n, al = _len(length, 5), _len(atr_length, 15)
    a = yield from atr_gen(f, high, low, close, al)
    zg = B.sma(f, (C(high) + C(low) + C(close)) / 3.0, n)
    p = f"_{n}_{al}"
    return {f"ABER_ZG{p}": zg, f"ABER_SG{p}": zg + a, f"ABER_XG{p}": zg - a, f"ABER_ATR{p}": a}


@indicator("accbands", "volatility")
def accbands(f, high="high", low="low", close="close", length=20, c=4, mamode="sma", drift=1):
    n, cc = _len(length, 20), _f(c, 4.0)
    mm = mamode if isinstance(mamode, str) else "sma"
    r = cc * dv(nz_range(high, low), C(high) + C(low))
    lo = yield from ma_gen(f, mm, C(low) * (1 - r), n)
    mid = yield from ma_gen(f, mm, close, n)
    up = yield from ma_gen(f, mm, C(high) * (1 + r), n)
    return {f"ACCBL_{n}": lo, f"ACCBM_{n}": mid, f"ACCBU_{n}": up}


def bbands_parts(f, close, n, std, ddof=0, mamode="sma"):
    sd = B.roll(f, close, n, "stdp" if ddof == 0 else "std")
    mid = yield from ma_gen(f, mamode, close, n)
    return mid - std * sd, mid, mid + std * sd


@indicator("bbands", "volatility")
def bbands(f, close="close", length=5, std=2.0, ddof=0, mamode="sma"):
    n, s = _len(length, 5), float(std) if std and std > 0 else 2.0
    dd = int(ddof) if ddof is not None and 0 <= ddof < n else 1
    mm = mamode if isinstance(mamode, str) else "sma"
    lo, mid, up = yield from bbands_parts(f, close, n, s, dd, mm)
    ulr = nz_range(up, lo)
    p = f"_{n}_{s}"
    return {f"BBL{p}": lo, f"BBM{p}": mid, f"BBU{p}": up, f"BBB{p}": dv(100 * ulr, mid),
            f"BBP{p}": dv(nz_range(close, lo), ulr)}


@indicator("donchian", "volatility")
def donchian(f, high="high", low="low", lower_length=20, upper_length=20, lower_min_periods=None,
             upper_min_periods=None):
    ll, ul = _len(lower_length, 20), _len(upper_length, 20)
    lo = B.roll(f, low, ll, "min", lower_min_periods)
    up = B.roll(f, high, ul, "max", upper_min_periods)
    p = f"_{ll}_{ul}"
    return {f"DCL{p}": lo, f"DCM{p}": 0.5 * (lo + up), f"DCU{p}": up}


def kc_gen(f, high, low, close, n, scalar, mamode="ema", use_tr=True):
    rng = true_range_col(f, high, low, close) if use_tr else C(high) - C(low)
    basis = yield from ma_gen(f, mamode, close, n)
    band = yield from ma_gen(f, mamode, rng, n, warm=1 if use_tr else 0)
    return basis - scalar * band, basis, basis + scalar * band


@indicator("kc", "volatility")
def kc(f, high="high", low="low", close="close", length=20, scalar=None, mamode="ema", tr=True):
    n, s = _len(length, 20), float(scalar) if scalar and scalar > 0 else 2
    mm = mamode if isinstance(mamode, str) else "ema"
    lo, b, up = yield from kc_gen(f, high, low, close, n, s, mm, tr)
    p = f"{mm.lower()[0] if len(mm) else ''}_{n}_{s}"
    return {f"KCL{p}": lo, f"KCB{p}": b, f"KCU{p}": up}


@indicator("massi", "volatility")
def massi(f, high="high", low="low", fast=9, slow=25):
    fa, sl = _len(fast, 9), _len(slow, 25)
    if sl < fa:
        fa, sl = sl, fa
    hl = nz_range(high, low)
    e1 = yield B.ema(f, hl, fa)
    e2 = yield B.ema(f, e1, fa, warm=fa - 1)
    return {f"MASSI_{fa}_{sl}": B.rsum(f, dv(e1, e2), sl)}


@indicator("pdist", "volatility")
def pdist(f, open_="open", high="high", low="low", close="close", drift=1):
    d = int(drift or 1)
    v = 2 * nz_range(high, low) + F.abs(nz_range(open_, lag(f, close, d))) - F.abs(nz_range(close, open_))
    return {"PDIST": v}


def _rvi_one(f, src, n, scalar, mamode, drift):
    sd = B.roll(f, src, n, "std")
    d = F.coalesce(C(src) - lag(f, src, drift), F.lit(0.0))
    pos = F.when(d > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    neg = F.when(d < 0, F.lit(1.0)).otherwise(F.lit(0.0))
    pa = yield from ma_gen(f, mamode, pos * sd, n, warm=n - 1)
    na = yield from ma_gen(f, mamode, neg * sd, n, warm=n - 1)
    return dv(scalar * pa, pa + na)


def rvi_gen(f, close, high, low, n, scalar, mode, mamode, drift):
    if mode == "r":
        h = yield from _rvi_one(f, high, n, scalar, mamode, drift)
        lo = yield from _rvi_one(f, low, n, scalar, mamode, drift)
        return 0.5 * (h + lo)
    if mode == "t":
        h = yield from _rvi_one(f, high, n, scalar, mamode, drift)
        lo = yield from _rvi_one(f, low, n, scalar, mamode, drift)
        c = yield from _rvi_one(f, close, n, scalar, mamode, drift)
        return (h + lo + c) / 3.0
    return (yield from _rvi_one(f, close, n, scalar, mamode, drift))


@indicator("rvi", "volatility")
def rvi(f, close="close", high="high", low="low", length=14, scalar=100, refined=False, thirds=False,
        mamode="ema", drift=1):
    n, s = _len(length, 14), _f(scalar, 100.0)
    mode = "r" if refined else ("t" if thirds else "")
    mm = mamode if isinstance(mamode, str) else "ema"
    v = yield from rvi_gen(f, close, high, low, n, s, mode, mm, int(drift or 1))
    return {f"RVI{mode}_{n}": v}


@indicator("thermo", "volatility")
def thermo(f, high="high", low="low", length=20, long=None, short=None, mamode="ema", drift=1, asint=True):
    n, d = _len(length, 20), int(drift or 1)
    lg = float(long) if long and long > 0 else 2
    sh = float(short) if short and short > 0 else 0.5
    mm = mamode if isinstance(mamode, str) else "ema"
    tl = F.abs(lag(f, low, d) - C(low))
    th = F.abs(C(high) - lag(f, high, d))
    t = F.when(th < tl, tl).otherwise(th)
    tma = yield from ma_gen(f, mm, t, n, warm=d)
    lo = F.coalesce(t < tma * lg, F.lit(False))
    sho = F.coalesce(t > tma * sh, F.lit(False))
    p = f"_{n}_{lg}_{sh}"
    cast = (lambda c: c.cast("int")) if asint else (lambda c: c)
    return {f"THERMO{p}": t, f"THERMOma{p}": tma, f"THERMOl{p}": cast(lo), f"THERMOs{p}": cast(sho)}


@indicator("ui", "volatility")
def ui(f, close="close", length=14, scalar=100, everget=False):
    n, s = _len(length, 14), _f(scalar, 100.0)
    hc = B.rmax(f, close, n)
    dd = dv(s * (C(close) - hc), hc)
    d2 = dd * dd
    if everget:
        v = F.sqrt(B.sma(f, d2, n) / n)
    else:
        v = F.sqrt(B.rsum(f, d2, n) / n)
    return {f"UI{'e' if everget else ''}_{n}": v}
