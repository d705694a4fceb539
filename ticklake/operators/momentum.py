"""Momentum indicators (recursive state machines live in ``operators.state``)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ticklake.functions import blocks as B
from ticklake.functions.blocks import C, dv, fir, lag, nz_range, roll
from ticklake.functions.weights import symmetric_triangle
from ticklake.operators.overlap import linreg_value, ma_gen
from ticklake.operators.registry import indicator


def _len(v, d):
    return int(v) if v and v > 0 else d


def _f(v, d):
    return float(v) if v else d


def rsi_gen(f, x, n, scalar=100.0, drift=1, warm=0):
    d = C(x) - lag(f, x, drift)
    pos = F.when(d < 0, F.lit(0.0)).otherwise(d)
    neg = F.when(d > 0, F.lit(0.0)).otherwise(d)
    pa, na = yield B.rma(f, pos, n, warm=warm + drift), B.rma(f, neg, n, warm=warm + drift)
    return dv(scalar * pa, pa + F.abs(na))


@indicator("rsi", "momentum")
def rsi(f, close="close", length=14, scalar=100, drift=1):
    n = _len(length, 14)
    y = yield from rsi_gen(f, close, n, _f(scalar, 100.0), int(drift or 1))
    return {f"RSI_{n}": y}


@indicator("ao", "momentum")
def ao(f, high="high", low="low", fast=5, slow=34):
    fa, sl = _len(fast, 5), _len(slow, 34)
    if sl < fa:
        fa, sl = sl, fa
    mp = 0.5 * (C(high) + C(low))
    return {f"AO_{fa}_{sl}": B.sma(f, mp, fa) - B.sma(f, mp, sl)}


@indicator("apo", "momentum")
def apo(f, close="close", fast=12, slow=26, mamode="sma"):
    fa, sl = _len(fast, 12), _len(slow, 26)
    if sl < fa:
        fa, sl = sl, fa
    mm = mamode if isinstance(mamode, str) else "sma"
    a = yield from ma_gen(f, mm, close, fa)
    b = yield from ma_gen(f, mm, close, sl)
    return {f"APO_{fa}_{sl}": a - b}


@indicator("bias", "momentum")
def bias(f, close="close", length=26, mamode="sma"):
    n = _len(length, 26)
    mm = mamode if isinstance(mamode, str) else "sma"
    m = yield from ma_gen(f, mm, close, n)
    return {f"BIAS_{mm.upper()}_{n}": dv(C(close), m) - 1}


@indicator("bop", "momentum")
def bop(f, open_="open", high="high", low="low", close="close", scalar=1):
    s = _f(scalar, 1.0)
    return {"BOP": dv(s * nz_range(close, open_), nz_range(high, low))}


@indicator("brar", "momentum")
def brar(f, open_="open", high="high", low="low", close="close", length=26, scalar=100, drift=1):
    n, s, d = _len(length, 26), _f(scalar, 100.0), int(drift or 1)
    ho, ol = nz_range(high, open_), nz_range(open_, low)
    pc = lag(f, close, d)
    hcy = nz_range(high, pc)
    cyl = nz_range(pc, low)
    hcy = F.when(hcy < 0, F.lit(0.0)).otherwise(hcy)
    cyl = F.when(cyl < 0, F.lit(0.0)).otherwise(cyl)
    ar = dv(s * B.rsum(f, ho, n), B.rsum(f, ol, n))
    br = dv(s * B.rsum(f, hcy, n), B.rsum(f, cyl, n))
    return {f"AR_{n}": ar, f"BR_{n}": br}


def mad_col(f, x, n):
    """Rolling mean absolute deviation around the window mean."""
    return B.roll(f, x, n, "mad")


@indicator("cci", "momentum")
def cci(f, high="high", low="low", close="close", length=14, c=0.015):
    n, cc = _len(length, 14), float(c) if c and c > 0 else 0.015
    tp = (C(high) + C(low) + C(close)) / 3.0
    return {f"CCI_{n}_{cc}": dv(tp - B.sma(f, tp, n), cc * mad_col(f, tp, n))}


@indicator("cfo", "momentum")
def cfo(f, close="close", length=9, scalar=100):
    n, s = _len(length, 9), _f(scalar, 100.0)
    m, b, _ = B.regr(f, close, n)
    tsf = m * n + b
    return {f"CFO_{n}": dv(s * (C(close) - tsf), C(close))}


@indicator("cg", "momentum")
def cg(f, close="close", length=10):
    n = _len(length, 10)
    num = -fir(f, close, [float(n - i) for i in range(n)])
    return {f"CG_{n}": dv(num, B.rsum(f, close, n))}


@indicator("cmo", "momentum")
def cmo(f, close="close", length=14, scalar=100, drift=1, talib=True):
    n, s, d = _len(length, 14), _f(scalar, 100.0), int(drift or 1)
    mom = C(close) - lag(f, close, d)
    pos = F.when(mom < 0, F.lit(0.0)).otherwise(mom)
    neg = F.abs(F.when(mom > 0, F.lit(0.0)).otherwise(mom))
    if talib is None or talib:
        p, q = yield B.rma(f, pos, n, warm=d), B.rma(f, neg, n, warm=d)
    else:
        p, q = B.rsum(f, pos, n), B.rsum(f, neg, n)
    return {f"CMO_{n}": dv(s * (p - q), p + q)}


def roc_col(f, x, n, scalar=100.0):
    return dv(scalar * (C(x) - lag(f, x, n)), lag(f, x, n))


@indicator("coppock", "momentum")
def coppock(f, close="close", length=10, fast=11, slow=14):
    n, fa, sl = _len(length, 10), _len(fast, 11), _len(slow, 14)
    tot = roc_col(f, close, fa) + roc_col(f, close, sl)
    from ticklake.operators.overlap import wma_col
    return {f"COPC_{fa}_{sl}_{n}": wma_col(f, tot, n)}


@indicator("cti", "momentum")
def cti(f, close="close", length=12):
    n = _len(length, 12)
    _, _, r = B.regr(f, close, n)
    return {f"CTI_{n}": r}


def dm_parts(f, high, low, drift):
    up = C(high) - lag(f, high, drift)
    dn = lag(f, low, drift) - C(low)
    pos = F.when((up > dn) & (up > 0), up).otherwise(F.when(up.isNull() | dn.isNull(), None).otherwise(0.0))
    neg = F.when((dn > up) & (dn > 0), dn).otherwise(F.when(up.isNull() | dn.isNull(), None).otherwise(0.0))
    return pos, neg


@indicator("dm", "momentum")
def dm(f, high="high", low="low", length=14, mamode="rma", drift=1):
    n, d = _len(length, 14), int(drift or 1)
    mm = mamode.lower() if isinstance(mamode, str) else "rma"
    pos, neg = dm_parts(f, high, low, d)
    p = yield from ma_gen(f, mm, pos, n, warm=d)
    q = yield from ma_gen(f, mm, neg, n, warm=d)
    return {f"DMP_{n}": p, f"DMN_{n}": q}


@indicator("er", "momentum")
def er(f, close="close", length=10, drift=1):
    n, d = _len(length, 10), int(drift or 1)
    ch = F.abs(C(close) - lag(f, close, n))
    vol = B.rsum(f, F.abs(C(close) - lag(f, close, d)), n)
    return {f"ER_{n}": dv(ch, vol)}


@indicator("eri", "momentum")
def eri(f, high="high", low="low", close="close", length=13):
    n = _len(length, 13)
    e = yield B.ema(f, close, n)
    return {f"BULLP_{n}": C(high) - e, f"BEARP_{n}": C(low) - e}


@indicator("kdj", "momentum")
def kdj(f, high="high", low="low", close="close", length=9, signal=3):
    n, s = _len(length, 9), _len(signal, 3)
    hh, ll = B.rmax(f, high, n), B.rmin(f, low, n)
    fastk = dv(100 * (C(close) - ll), nz_range(hh, ll))
    k = yield B.rma(f, fastk, s, warm=n - 1)
    d = yield B.rma(f, k, s, warm=n - 1 + s - 1)
    return {f"K_{n}_{s}": k, f"D_{n}_{s}": d, f"J_{n}_{s}": 3 * k - 2 * d}


@indicator("kst", "momentum")
def kst(f, close="close", roc1=10, roc2=15, roc3=20, roc4=30, sma1=10, sma2=10, sma3=10, sma4=15, signal=9):
    r = [_len(roc1, 10), _len(roc2, 15), _len(roc3, 20), _len(roc4, 30)]
    s = [_len(sma1, 10), _len(sma2, 10), _len(sma3, 10), _len(sma4, 15)]
    sig = _len(signal, 9)
    parts = [B.sma(f, roc_col(f, close, r[i]), s[i]) for i in range(4)]
    k = B.mat(f, 100 * (parts[0] + 2 * parts[1] + 3 * parts[2] + 4 * parts[3]))
    return {f"KST_{r[0]}_{r[1]}_{r[2]}_{r[3]}_{s[0]}_{s[1]}_{s[2]}_{s[3]}": k,
            f"KSTs_{sig}": B.sma(f, k, sig)}


def macd_gen(f, x, fa, sl, sig, warm=0):
    ef, es = yield B.ema(f, x, fa, warm=warm), B.ema(f, x, sl, warm=warm)
    m = ef - es
    w = warm + sl - 1
    s = yield B.ema(f, m, sig, warm=w, sliced=True)
    return m, s, w


@indicator("macd", "momentum")
def macd(f, close="close", fast=12, slow=26, signal=9, asmode=False):
    fa, sl, sig = _len(fast, 12), _len(slow, 26), _len(signal, 9)
    if sl < fa:
        fa, sl = sl, fa
    m, s, w = yield from macd_gen(f, close, fa, sl, sig)
    tag = ""
    if asmode:
        m = m - s
        s = yield B.ema(f, m, sig, warm=w + sig - 1, sliced=True)
        tag = "AS"
    return {f"MACD{tag}_{fa}_{sl}_{sig}": m, f"MACD{tag}h_{fa}_{sl}_{sig}": m - s,
            f"MACD{tag}s_{fa}_{sl}_{sig}": s}


@indicator("mom", "momentum")
def mom(f, close="close", length=10):
    n = _len(length, 10)
    return {f"MOM_{n}": C(close) - lag(f, close, n)}


@indicator("pgo", "momentum")
def pgo(f, high="high", low="low", close="close", length=14):
    n = _len(length, 14)
    from ticklake.operators.volatility import atr_gen
    a = yield from atr_gen(f, high, low, close, n, "rma", 1)
    e = yield B.ema(f, a, n, warm=n)
    return {f"PGO_{n}": dv(C(close) - B.sma(f, close, n), e)}


@indicator("ppo", "momentum")
def ppo(f, close="close", fast=12, slow=26, signal=9, scalar=100, mamode="sma"):
    fa, sl, sig, s = _len(fast, 12), _len(slow, 26), _len(signal, 9), _f(scalar, 100.0)
    if sl < fa:
        fa, sl = sl, fa
    mm = mamode if isinstance(mamode, str) else "sma"
    a = yield from ma_gen(f, mm, close, fa)
    b = yield from ma_gen(f, mm, close, sl)
    p = dv(s * (a - b), b)
    sg = yield B.ema(f, p, sig, warm=sl - 1)
    return {f"PPO_{fa}_{sl}_{sig}": p, f"PPOh_{fa}_{sl}_{sig}": p - sg, f"PPOs_{fa}_{sl}_{sig}": sg}


@indicator("psl", "momentum")
def psl(f, close="close", open_=None, length=12, scalar=100, drift=1):
    n, s, d = _len(length, 12), float(scalar) if scalar and scalar > 0 else 100.0, int(drift or 1)
    if open_ is not None:
        dd = F.signum(C(close) - C(open_))
    else:
        dd = F.signum(C(close) - lag(f, close, d))
    dd = F.coalesce(dd, F.lit(0.0))
    dd = F.when(dd <= 0, F.lit(0.0)).otherwise(dd)
    return {f"PSL_{n}": s * B.rsum(f, dd, n) / n}


@indicator("pvo", "momentum")
def pvo(f, volume="volume", fast=12, slow=26, signal=9, scalar=100):
    fa, sl, sig, s = _len(fast, 12), _len(slow, 26), _len(signal, 9), _f(scalar, 100.0)
    if sl < fa:
        fa, sl = sl, fa
    a, b = yield B.ema(f, volume, fa), B.ema(f, volume, sl)
    p = dv(s * (a - b), b)
    sg = yield B.ema(f, p, sig, warm=sl - 1)
    return {f"PVO_{fa}_{sl}_{sig}": p, f"PVOh_{fa}_{sl}_{sig}": p - sg, f"PVOs_{fa}_{sl}_{sig}": sg}


@indicator("roc", "momentum")
def roc(f, close="close", length=10, scalar=100):
    n, s = _len(length, 10), float(scalar) if scalar and scalar > 0 else 100.0
    return {f"ROC_{n}": roc_col(f, close, n, s)}


@indicator("rvgi", "momentum")
def rvgi(f, open_="open", high="high", low="low", close="close", length=14, swma_length=4):
    n, sw = _len(length, 14), _len(swma_length, 4)
    wts = symmetric_triangle(sw, weighted=True)
    num = B.rsum(f, fir(f, nz_range(close, open_), wts), n)
    den = B.rsum(f, fir(f, nz_range(high, low), wts), n)
    r = B.mat(f, dv(num, den))
    return {f"RVGI_{n}_{sw}": r, f"RVGIs_{n}_{sw}": fir(f, r, wts)}


@indicator("slope", "momentum")
def slope(f, close="close", length=1, as_angle=None, to_degrees=None):
    n = _len(length, 1)
    # any bool (even False) switches the option on, as in the reference
    ang = isinstance(as_angle, bool)
    deg = isinstance(to_degrees, bool)
    v = (C(close) - lag(f, close, n)) / n
    if ang:
        v = F.atan(v)
        if deg:
            v = v * (180 / math.pi)
        return {f"ANGLE{'d' if deg else 'r'}_{n}": v}
    return {f"SLOPE_{n}": v}


def tsi_gen(f, x, fa, sl, sig, scalar, mamode="ema", drift=1):
    d = C(x) - lag(f, x, drift)
    s1, a1 = yield B.ema(f, d, sl, warm=drift), B.ema(f, F.abs(d), sl, warm=drift)
    w1 = drift + sl - 1
    s2, a2 = yield B.ema(f, s1, fa, warm=w1), B.ema(f, a1, fa, warm=w1)
    w2 = w1 if w1 >= fa else w1 + fa - 1
    t = dv(scalar * s2, a2)
    sg = yield from ma_gen(f, mamode, t, sig, warm=w2)
    return t, sg


@indicator("tsi", "momentum")
def tsi(f, close="close", fast=13, slow=25, signal=13, scalar=100, mamode="ema", drift=1):
    fa, sl, sig, s = _len(fast, 13), _len(slow, 25), _len(signal, 13), _f(scalar, 100.0)
    if sl < fa:
        fa, sl = sl, fa
    mm = mamode if isinstance(mamode, str) else "ema"
    t, sg = yield from tsi_gen(f, close, fa, sl, sig, s, mm, int(drift or 1))
    return {f"TSI_{fa}_{sl}_{sig}": t, f"TSIs_{fa}_{sl}_{sig}": sg}


@indicator("smi", "momentum")
def smi(f, close="close", fast=5, slow=20, signal=5, scalar=1):
    fa, sl, sig, s = _len(fast, 5), _len(slow, 20), _len(signal, 5), _f(scalar, 1.0)
    if sl < fa:
        fa, sl = sl, fa
    t, sg = yield from tsi_gen(f, close, fa, sl, sig, s)
    tag = f"_{fa}_{sl}_{sig}" + (f"_{s}" if s != 1 else "")
    return {f"SMI{tag}": t, f"SMIs{tag}": sg, f"SMIo{tag}": t - sg}


@indicator("stoch", "momentum")
def stoch(f, high="high", low="low", close="close", k=14, d=3, smooth_k=3, mamode="sma"):
    kk, dd, sk = _len(k, 14), _len(d, 3), _len(smooth_k, 3)
    mm = mamode if isinstance(mamode, str) else "sma"
    ll, hh = B.rmin(f, low, kk), B.rmax(f, high, kk)
    st = dv(100 * (C(close) - ll), nz_range(hh, ll))
    if mm.lower() == "ema":
        sk_ = yield B.ema(f, st, sk, warm=kk - 1, sliced=True)
        sd_ = yield B.ema(f, sk_, dd, warm=kk - 1 + sk - 1, sliced=True)
    else:
        sk_ = yield from ma_gen(f, mm, st, sk, warm=kk - 1)
        sd_ = yield from ma_gen(f, mm, sk_, dd, warm=kk - 1 + sk - 1)
    return {f"STOCHk_{kk}_{dd}_{sk}": sk_, f"STOCHd_{kk}_{dd}_{sk}": sd_}


@indicator("stochrsi", "momentum")
def stochrsi(f, close="close", length=14, rsi_length=14, k=3, d=3, mamode="sma"):
    n, rl, kk, dd = _len(length, 14), _len(rsi_length, 14), _len(k, 3), _len(d, 3)
    mm = mamode if isinstance(mamode, str) else "sma"
    r = yield from rsi_gen(f, close, rl)
    lo, hi = B.rmin(f, r, n), B.rmax(f, r, n)
    st = dv(100 * (r - lo), nz_range(hi, lo))
    w = rl + n - 1
    sk = yield from ma_gen(f, mm, st, kk, warm=w)
    sd = yield from ma_gen(f, mm, sk, dd, warm=w + kk - 1)
    return {f"STOCHRSIk_{n}_{rl}_{kk}_{dd}": sk, f"STOCHRSId_{n}_{rl}_{kk}_{dd}": sd}


@indicator("trix", "momentum")
def trix(f, close="close", length=30, signal=9, scalar=100, drift=1):
    n, sig, s, d = _len(length, 30), _len(signal, 9), _f(scalar, 100.0), int(drift or 1)
    e1 = yield B.ema(f, close, n)
    e2 = yield B.ema(f, e1, n, warm=n - 1)
    e3 = yield B.ema(f, e2, n, warm=2 * (n - 1))
    t = B.mat(f, s * (dv(e3, lag(f, e3, d)) - 1))
    return {f"TRIX_{n}_{sig}": t, f"TRIXs_{n}_{sig}": B.sma(f, t, sig)}


@indicator("uo", "momentum")
def uo(f, high="high", low="low", close="close", fast=7, medium=14, slow=28, fast_w=4.0, medium_w=2.0,
       slow_w=1.0, drift=1):
    fa, me, sl = _len(fast, 7), _len(medium, 14), _len(slow, 28)
    fw, mw, sw = _f(fast_w, 4.0), _f(medium_w, 2.0), _f(slow_w, 1.0)
    pc = lag(f, close, int(drift or 1))
    mx = F.greatest(C(high), pc)  # pandas max(axis=1) skips NaN, as greatest does
    mn = F.least(C(low), pc)
    bp, tr = C(close) - mn, mx - mn
    avg = lambda n: dv(B.rsum(f, bp, n), B.rsum(f, tr, n))
    return {f"UO_{fa}_{me}_{sl}": 100 * (fw * avg(fa) + mw * avg(me) + sw * avg(sl)) / (fw + mw + sw)}


@indicator("willr", "momentum")
def willr(f, high="high", low="low", close="close", length=14, min_periods=None):
    n = _len(length, 14)
    ll, hh = B.rmin(f, low, n, min_periods), B.rmax(f, high, n, min_periods)
    return {f"WILLR_{n}": 100 * (dv(C(close) - ll, hh - ll) - 1)}


@indicator("inertia", "momentum")
def inertia(f, close="close", high=None, low=None, length=20, rvi_length=14, scalar=100, refined=None,
            thirds=None, mamode="ema", drift=1):
    n, rl = _len(length, 20), _len(rvi_length, 14)
    from ticklake.operators.volatility import rvi_gen
    mode = "r" if refined is not None else ("t" if thirds is not None else "")
    r = yield from rvi_gen(f, close, high, low, rl, _f(scalar, 100.0), mode, mamode or "ema", int(drift or 1))
    return {f"INERTIA{mode}_{n}_{rl}": linreg_value(f, r, n)}


def _bb_kc(f, high, low, close, bb_length, bb_std, kc_length, kc_scalar, mamode, use_tr):
    from ticklake.operators.volatility import bbands_parts, kc_gen
    bl, bm, bu = bbands_parts(f, close, bb_length, bb_std, 0, mamode)
    return bl, bu, kc_gen(f, high, low, close, kc_length, kc_scalar, mamode, use_tr)


@indicator("squeeze", "momentum")
def squeeze(f, high="high", low="low", close="close", bb_length=20, bb_std=2.0, kc_length=20, kc_scalar=1.5,
            mom_length=12, mom_smooth=6, mamode="sma", tr=True, lazybear=False, asint=True, detailed=False):
    bl_, bs, kl, ks = _len(bb_length, 20), _f(bb_std, 2.0), _len(kc_length, 20), _f(kc_scalar, 1.5)
    ml, msm = _len(mom_length, 12), _len(mom_smooth, 6)
    mm = mamode if isinstance(mamode, str) else "sma"
    from ticklake.operators.volatility import bbands_parts, kc_gen
    bl, bm, bu = yield from bbands_parts(f, close, bl_, bs, 0, mm)
    kcl, kcb, kcu = yield from kc_gen(f, high, low, close, kl, ks, mm, tr)
    if lazybear:
        avg = 0.25 * (B.rmax(f, high, kl) + B.rmin(f, low, kl)) + 0.5 * kcb
        sq = linreg_value(f, C(close) - avg, kl)
    else:
        mo = C(close) - lag(f, close, ml)
        if mm.lower() == "ema":
            sq = yield B.ema(f, mo, msm, warm=ml)
        else:
            sq = B.sma(f, mo, msm)
    on = F.coalesce((bl > kcl) & (bu < kcu), F.lit(False))
    off = F.coalesce((bl < kcl) & (bu > kcu), F.lit(False))
    no = ~on & ~off
    props = ("" if tr else "hlr") + f"_{bl_}_{bs}_{kl}_{ks}" + ("_LB" if lazybear else "")
    cast = (lambda c: c.cast("int")) if asint else (lambda c: c)
    out = {f"SQZ{props}": sq, "SQZ_ON": cast(on), "SQZ_OFF": cast(off), "SQZ_NO": cast(no)}
    if detailed:
        sq = B.mat(f, sq)
        change = sq - lag(f, sq, 1)
        # rises and falls against the last value of the same sign, however many rows ago
        pos, neg = B.mat(f, F.when(sq >= 0, sq)), B.mat(f, F.when(sq < 0, sq))
        last_pos, last_neg = yield B.ffill(f, pos), B.ffill(f, neg)
        dp, dn = pos - lag(f, last_pos, 1), neg - lag(f, last_neg, 1)
        pick = lambda cond: F.when(cond & (sq != 0), sq)
        out.update({"SQZ_INC": pick(change > 0), "SQZ_DEC": pick(change < 0), "SQZ_PINC": pick(dp > 0), "SQZ_PDEC": pick(dp < 0),
                    "SQZ_NDEC": pick(dn < 0), "SQZ_NINC": pick(dn > 0)})
    return out


@indicator("squeeze_pro", "momentum")
def squeeze_pro(f, high="high", low="low", close="close", bb_length=20, bb_std=2.0, kc_length=20,
                kc_scalar_wide=2.0, kc_scalar_normal=1.5, kc_scalar_narrow=1.0, mom_length=12, mom_smooth=6,
                mamode="sma", tr=True, asint=True):
    bl_, bs, kl = _len(bb_length, 20), _f(bb_std, 2.0), _len(kc_length, 20)
    wi, no_, na = _f(kc_scalar_wide, 2.0), _f(kc_scalar_normal, 1.5), _f(kc_scalar_narrow, 1.0)
    if not (wi > no_ > na):
        return {}
    ml, msm = _len(mom_length, 12), _len(mom_smooth, 6)
    mm = mamode if isinstance(mamode, str) else "sma"
    from ticklake.operators.volatility import bbands_parts, kc_gen
    bl, bm, bu = yield from bbands_parts(f, close, bl_, bs, 0, mm)
    kw = yield from kc_gen(f, high, low, close, kl, wi, mm, tr)
    kn = yield from kc_gen(f, high, low, close, kl, no_, mm, tr)
    kr = yield from kc_gen(f, high, low, close, kl, na, mm, tr)
    mo = C(close) - lag(f, close, ml)
    if mm.lower() == "ema":
        sq = yield B.ema(f, mo, msm, warm=ml)
    else:
        sq = B.sma(f, mo, msm)
    z = lambda c: F.coalesce(c, F.lit(False))
    on_w = z((bl > kw[0]) & (bu < kw[2]))
    on_n = z((bl > kn[0]) & (bu < kn[2]))
    on_r = z((bl > kr[0]) & (bu < kr[2]))
    off_w = z((bl < kw[0]) & (bu > kw[2]))
    no = ~on_w & ~off_w
    props = ("" if tr else "hlr") + f"_{bl_}_{bs}_{kl}_{wi}_{no_}_{na}"
    cast = (lambda c: c.cast("int")) if asint else (lambda c: c)
    return {f"SQZPRO{props}": sq, "SQZPRO_ON_WIDE": cast(on_w), "SQZPRO_ON_NORMAL": cast(on_n),
            "SQZPRO_ON_NARROW": cast(on_r), "SQZPRO_OFF": cast(off_w), "SQZPRO_NO": cast(no)}


@indicator("td_seq", "momentum")
def td_seq(f, close="close", asint=False, show_all=True):
    """Length (capped at 13) of the current run of close vs close 4 bars ago.
    Gaps-and-islands: the run length is rn minus the last row where the
    condition failed, looked up inside the 13-row frame."""
    out = {}
    d4 = C(close) - lag(f, close, 4)
    for tag, cond in (("UP", d4 > 0), ("DN", d4 < 0)):
        c = B.mat(f, F.coalesce(cond, F.lit(False)))
        brk = F.when(~c, F.col("_rn"))
        # last failing row among the previous 12 rows and the current one
        last_fail = F.max(brk).over(f.rows(13, 0, c))
        run = F.when(c, F.least(F.col("_rn") - F.coalesce(last_fail, F.col("_rn") - F.least(F.col("_rn"), F.lit(13))),
                                 F.lit(13)))
        if show_all:
            v = F.when(run > 0, run)
        else:
            v = F.when((run >= 6) & (run <= 9), run)
        nm = f"TD_SEQ_{tag}a" if show_all else f"TD_SEQ_{tag}"
        out[nm] = F.coalesce(v, F.lit(0)).cast("int") if asint else v.cast("double")
    return out
