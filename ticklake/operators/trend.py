"""Trend indicators (psar lives in ``operators.state``)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ticklake.functions import blocks as B
from ticklake.functions.blocks import C, dv, lag, nz_range
from ticklake.operators.overlap import ma_gen
from ticklake.operators.registry import indicator
from ticklake.operators.volatility import atr_gen, true_range_col


def _len(v, d):
    return int(v) if v and v > 0 else d


def _f(v, d):
    return float(v) if v else d


@indicator("adx", "trend")
def adx(f, high="high", low="low", close="close", length=14, lensig=None, scalar=100, mamode="rma", drift=1):
    n = _len(length, 14)
    ls = int(lensig) if lensig and lensig > 0 else n
    s, d = _f(scalar, 100.0), int(drift or 1)
    mm = mamode.lower() if isinstance(mamode, str) else "rma"
    a = yield from atr_gen(f, high, low, close, n, "rma", d)
    from ticklake.operators.momentum import dm_parts
    pos, neg = dm_parts(f, high, low, d)
    k = dv(F.lit(s), a)
    mp = yield from ma_gen(f, mm, pos, n, warm=d)
    mn = yield from ma_gen(f, mm, neg, n, warm=d)
    dmp, dmn = k * mp, k * mn
    dx = dv(s * F.abs(dmp - dmn), dmp + dmn)
    ax = yield from ma_gen(f, mm, dx, ls, warm=n + d - 1)
    return {f"ADX_{ls}": ax, f"DMP_{n}": dmp, f"DMN_{n}": dmn}


def inc_col(f, x, n=1, strict=False, percent=None, drift=1):
    x = C(x)
    xp = (1 + 0.01 * percent) * x if percent else x
    if strict:
        c = x > lag(f, xp, drift)
        for k in range(3, n + 1):
            c = c & (lag(f, x, k - (drift + 1)) > lag(f, xp, k - drift))
        return F.coalesce(c, F.lit(False))
    return F.coalesce((xp - lag(f, xp, n)) > 0, F.lit(False))


def dec_col(f, x, n=1, strict=False, percent=None, drift=1):
    x = C(x)
    xp = (1 - 0.01 * percent) * x if percent else x
    if strict:
        c = x < lag(f, xp, drift)
        for k in range(3, n + 1):
            c = c & (lag(f, x, k - (drift + 1)) < lag(f, xp, k - drift))
        return F.coalesce(c, F.lit(False))
    return F.coalesce((xp - lag(f, xp, n)) < 0, F.lit(False))


def _pct(p):
    return float(p) if isinstance(p, (int, float)) and 0 <= p <= 100 and not isinstance(p, bool) else None


@indicator("increasing", "trend")
def increasing(f, close="close", length=1, strict=False, asint=True, percent=None, drift=1):
    n, p = _len(length, 1), _pct(percent)
    v = inc_col(f, close, n, bool(strict), p, int(drift or 1))
    props = f"{'S' if strict else ''}INC{'p' if p else ''}"
    return {f"{props}_{n}{'_' + str(p) if p else ''}": v.cast("int") if asint else v}


@indicator("decreasing", "trend")
def decreasing(f, close="close", length=1, strict=False, asint=True, percent=None, drift=1):
    n, p = _len(length, 1), _pct(percent)
    v = dec_col(f, close, n, bool(strict), p, int(drift or 1))
    props = f"{'S' if strict else ''}DEC{'p' if p else ''}"
    return {f"{props}_{n}{'_' + str(p) if p else ''}": v.cast("int") if asint else v}


def long_run_col(f, fast, slow, n=2):
    return (inc_col(f, fast, n) & dec_col(f, slow, n)) | (inc_col(f, fast, n) & inc_col(f, slow, n))


def short_run_col(f, fast, slow, n=2):
    return (dec_col(f, fast, n) & inc_col(f, slow, n)) | (dec_col(f, fast, n) & dec_col(f, slow, n))


@indicator("long_run", "trend")
def long_run(f, fast="fast", slow="slow", length=2):
    n = _len(length, 2)
    return {f"LR_{n}": long_run_col(f, fast, slow, n).cast("int")}


@indicator("short_run", "trend")
def short_run(f, fast="fast", slow="slow", length=2):
    n = _len(length, 2)
    return {f"SR_{n}": short_run_col(f, fast, slow, n).cast("int")}


@indicator("amat", "trend")
def amat(f, close="close", fast=8, slow=21, lookback=2, mamode="ema"):
    fa, sl, lb = _len(fast, 8), _len(slow, 21), _len(lookback, 2)
    mm = mamode.lower() if isinstance(mamode, str) else "ema"
    a = yield from ma_gen(f, mm, close, fa)
    b = yield from ma_gen(f, mm, close, sl)
    a, b = B.mat(f, a), B.mat(f, b)
    p = f"{mm[0].upper()}"
    return {f"AMAT{p}_LR_{fa}_{sl}_{lb}": long_run_col(f, a, b, lb).cast("int"),
            f"AMAT{p}_SR_{fa}_{sl}_{lb}": short_run_col(f, a, b, lb).cast("int")}


@indicator("aroon", "trend")
def aroon(f, high="high", low="low", length=14, scalar=100):
    n, s = _len(length, 14), _f(scalar, 100.0)
    w = f.rows(n + 1, 0, F.struct(C(high), C(low)))
    rn = F.col("_rn")
    ok = F.count(C(high)).over(w) >= n + 1
    hh = F.max_by(rn, F.struct(C(high), rn)).over(w)
    ll = F.min_by(rn, F.struct(C(low), -rn)).over(w)
    up = F.when(ok, s * (1 - (rn - hh) / n))
    dn = F.when(ok, s * (1 - (rn - ll) / n))
    return {f"AROOND_{n}": dn, f"AROONU_{n}": up, f"AROONOSC_{n}": up - dn}


@indicator("chop", "trend")
def chop(f, high="high", low="low", close="close", length=14, atr_length=1, ln=False, scalar=None, drift=1):
    n, al = _len(length, 14), _len(atr_length, 1)
    s = float(scalar) if scalar else 100
    diff = B.rmax(f, high, n) - B.rmin(f, low, n)
    a = yield from atr_gen(f, high, low, close, al, "rma", int(drift or 1))
    asum = B.rsum(f, a, n)
    lg = F.log if ln else F.log10
    den = math.log(n) if ln else math.log10(n)
    v = s * (lg(F.when(asum > 0, asum)) - lg(F.when(diff > 0, diff))) / den
    return {f"CHOP{'ln' if ln else ''}_{n}_{al}_{s}": v}


@indicator("cksp", "trend")
def cksp(f, high="high", low="low", close="close", p=10, x=None, q=None, tvmode=None):
    p = _len(p, 10)
    x = float(x) if x and x > 0 else (1 if tvmode is True else 3)
    q = int(q) if q and q > 0 else (9 if tvmode is True else 20)
    tv = tvmode if isinstance(tvmode, bool) else True
    mm = "rma" if tv else "sma"
    a = yield from atr_gen(f, high, low, close, p, mm, 1)
    ls_ = B.rmax(f, high, p) - x * a
    ss_ = B.rmin(f, low, p) + x * a
    props = f"_{p}_{x}_{q}"
    return {f"CKSPl{props}": B.rmax(f, ls_, q), f"CKSPs{props}": B.rmin(f, ss_, q)}


@indicator("decay", "trend")
def decay(f, close="close", length=5, mode="linear"):
    n = _len(length, 5)
    exp = mode in ("exp", "exponential")
    step = math.exp(-n) if exp else 1.0 / n
    d = F.when(F.col("_rn") == 1, C(close)).otherwise(lag(f, close, 1) - step)
    return {f"{'EXP' if exp else 'L'}DECAY_{n}": F.greatest(C(close), d, F.lit(0.0))}


@indicator("dpo", "trend", lookahead=True)
def dpo(f, close="close", length=20, centered=True):
    n = _len(length, 20)
    t = int(0.5 * n) + 1
    ma = B.mat(f, B.sma(f, close, n))
    if centered:
        v = C(close) - lag(f, ma, -t)
    else:
        v = C(close) - lag(f, ma, t)
    return {f"DPO_{n}": v}


@indicator("qstick", "trend")
def qstick(f, open_="open", close="close", length=10, ma="sma"):
    n = _len(length, 10)
    mm = ma if ma in ("dema", "ema", "hma", "rma", "sma") else "sma"
    v = yield from ma_gen(f, mm, nz_range(close, open_), n)
    return {f"QS_{n}": v}


def tsignals_cols(f, trend, asbool=False, trade_offset=0, drift=1):
    tr = C(trend).cast("int")
    trd = B.mat(f, tr - lag(f, tr, drift))
    if trade_offset:
        trd = lag(f, trd, trade_offset)
    trades = F.coalesce(trd, F.lit(0)).cast("int")
    ent = (trades > 0)
    ex = (trades < 0)
    if asbool:
        return {"TS_Trends": tr.cast("boolean"), "TS_Trades": trades, "TS_Entries": ent, "TS_Exits": ex}
    return {"TS_Trends": tr, "TS_Trades": trades, "TS_Entries": ent.cast("int"), "TS_Exits": ex.cast("int")}


@indicator("tsignals", "trend")
def tsignals(f, trend="trend", asbool=False, trend_reset=0, trade_offset=None, drift=1):
    to = int(trade_offset) if trade_offset and isinstance(trade_offset, int) else 0
    return tsignals_cols(f, trend, bool(asbool), to, int(drift or 1))


@indicator("ttm_trend", "trend")
def ttm_trend(f, high="high", low="low", close="close", length=6):
    n = _len(length, 6)
    hl2 = 0.5 * (C(high) + C(low))
    avg = B.roll(f, hl2, n, "avg")
    v = F.when(C(close) > avg, F.lit(1)).otherwise(F.lit(-1))
    return {f"TTM_TRND_{n}": v}


@indicator("vhf", "trend")
def vhf(f, close="close", length=28, drift=1):
    n = _len(length, 28)
    hcp, lcp = B.rmax(f, close, n), B.rmin(f, close, n)
    d = F.abs(C(close) - lag(f, close, int(drift or 1)))
    return {f"VHF_{n}": dv(F.abs(nz_range(hcp, lcp)), B.rsum(f, d, n))}


@indicator("vortex", "trend")
def vortex(f, high="high", low="low", close="close", length=14, drift=1, min_periods=None):
    n, d = _len(length, 14), int(drift or 1)
    tr = true_range_col(f, high, low, close)
    trs = B.roll(f, tr, n, "sum", min_periods)
    vmp = F.abs(C(high) - lag(f, low, d))
    vmm = F.abs(C(low) - lag(f, high, d))
    return {f"VTXP_{n}": dv(B.roll(f, vmp, n, "sum", min_periods), trs),
            f"VTXM_{n}": dv(B.roll(f, vmm, n, "sum", min_periods), trs)}


def cross_value_col(f, x, value, above=True):
    cur = C(x) > F.lit(value)
    prev = lag(f, x, 1) < F.lit(value)
    cur, prev = F.coalesce(cur, F.lit(False)), F.coalesce(prev, F.lit(False))
    return (cur & prev) if above else (~cur & ~prev)


@indicator("xsignals", "trend")
def xsignals(f, signal="signal", xa=80, xb=20, above=True, long=True, asbool=False, trade_offset=None):
    sig = B.mat(f, C(signal))
    if above:
        ent = cross_value_col(f, sig, xa).cast("int")
        ex = -cross_value_col(f, sig, xb, above=False).cast("int")
    else:
        ent = cross_value_col(f, sig, xa, above=False).cast("int")
        ex = -cross_value_col(f, sig, xb).cast("int")
    trades = ent + ex
    # zeros -> null -> forward fill -> 0
    filled = yield B.ffill(f, F.when(trades != 0, trades))
    trades = F.coalesce(filled, F.lit(0.0))
    trends = (trades > 0).cast("int")
    if not long:
        trends = 1 - trends
    to = int(trade_offset) if trade_offset and isinstance(trade_offset, int) else 0
    return tsignals_cols(f, B.mat(f, trends), bool(asbool), to)
