"""Volume indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklake.functions import blocks as B
from ticklake.functions.blocks import C, dv, lag, nz_range
from ticklake.operators.overlap import ma_gen
from ticklake.operators.registry import indicator


def _len(v, d):
    return int(v) if v and v > 0 else d


def ad_flow(high, low, close, volume, open_=None):
    a = nz_range(close, open_) if open_ is not None else 2 * C(close) - (C(high) + C(low))
    return a * dv(C(volume), nz_range(high, low))


def signed_col(f, x, initial=None):
    d = F.signum(C(x) - lag(f, x, 1))
    first = F.lit(None).cast("double") if initial is None else F.lit(float(initial))
    return F.when(F.col("_rn") == 1, first).otherwise(d)


@indicator("ad", "volume")
def ad(f, high="high", low="low", close="close", volume="volume", open_=None):
    y = yield B.cumsum(f, ad_flow(high, low, close, volume, open_))
    return {"AD" if open_ is None else "ADo": y}


@indicator("adosc", "volume")
def adosc(f, high="high", low="low", close="close", volume="volume", open_=None, fast=3, slow=10):
    fa, sl = _len(fast, 3), _len(slow, 10)
    if sl < fa:
        fa, sl = sl, fa
    a = yield B.cumsum(f, ad_flow(high, low, close, volume, open_))
    e1, e2 = yield B.ema(f, a, fa), B.ema(f, a, sl)
    return {f"ADOSC_{fa}_{sl}": e1 - e2}


@indicator("obv", "volume")
def obv(f, close="close", volume="volume"):
    y = yield B.cumsum(f, signed_col(f, close, 1) * C(volume))
    return {"OBV": y}


@indicator("aobv", "volume")
def aobv(f, close="close", volume="volume", fast=4, slow=12, max_lookback=2, min_lookback=2, mamode="ema",
         run_length=2):
    fa, sl = _len(fast, 4), _len(slow, 12)
    mx, mn, rl = _len(max_lookback, 2), _len(min_lookback, 2), _len(run_length, 2)
    if sl < fa:
        fa, sl = sl, fa
    mm = mamode if isinstance(mamode, str) else "ema"
    o = yield B.cumsum(f, signed_col(f, close, 1) * C(volume))
    maf = yield from ma_gen(f, mm, o, fa)
    mas = yield from ma_gen(f, mm, o, sl)
    maf, mas = B.mat(f, maf), B.mat(f, mas)
    from ticklake.operators.trend import long_run_col, short_run_col
    return {"OBV": o, f"OBV_min_{mn}": B.rmin(f, o, mn), f"OBV_max_{mx}": B.rmax(f, o, mx),
            f"OBV{mm[0].upper()}_{fa}": maf, f"OBV{mm[0].upper()}_{sl}": mas,
            f"AOBV_LR_{rl}": long_run_col(f, maf, mas, rl).cast("int"),
            f"AOBV_SR_{rl}": short_run_col(f, maf, mas, rl).cast("int")}


@indicator("cmf", "volume")
def cmf(f, high="high", low="low", close="close", volume="volume", open_=None, length=20, min_periods=None):
    n = _len(length, 20)
    a = ad_flow(high, low, close, volume, open_)
    return {f"CMF_{n}": dv(B.roll(f, a, n, "sum", min_periods), B.roll(f, volume, n, "sum", min_periods))}


@indicator("efi", "volume")
def efi(f, close="close", volume="volume", length=13, mamode="ema", drift=1):
    n, d = _len(length, 13), int(drift or 1)
    mm = mamode if isinstance(mamode, str) else "ema"
    pv = (C(close) - lag(f, close, d)) * C(volume)
    y = yield from ma_gen(f, mm, pv, n, warm=d)
    return {f"EFI_{n}": y}


@indicator("eom", "volume")
def eom(f, high="high", low="low", close="close", volume="volume", length=14, divisor=100000000, drift=1):
    n, d = _len(length, 14), int(drift or 1)
    dvs = float(divisor) if divisor and divisor > 0 else 100000000.0
    hl2 = 0.5 * (C(high) + C(low))
    dist = hl2 - lag(f, hl2, d)
    box = dv(C(volume) / dvs, nz_range(high, low))
    return {f"EOM_{n}_{int(dvs) if dvs == int(dvs) else dvs}": B.sma(f, dv(dist, box), n)}


def _signed_ma_src(f, high, low, close, volume):
    tp = (C(high) + C(low) + C(close)) / 3.0
    return C(volume) * signed_col(f, tp, 1)


@indicator("kvo", "volume")
def kvo(f, high="high", low="low", close="close", volume="volume", fast=34, slow=55, signal=13, mamode="ema"):
    fa, sl, sg = _len(fast, 34), _len(slow, 55), _len(signal, 13)
    mm = mamode if isinstance(mamode, str) else "ema"
    sv = _signed_ma_src(f, high, low, close, volume)
    if mm.lower() == "ema":
        a, b = yield B.ema(f, sv, fa, sliced=True), B.ema(f, sv, sl, sliced=True)
        k = a - b
        s = yield B.ema(f, k, sg, warm=sl - 1, sliced=True)
    else:
        a = yield from ma_gen(f, mm, sv, fa)
        b = yield from ma_gen(f, mm, sv, sl)
        k = a - b
        s = yield from ma_gen(f, mm, k, sg, warm=sl - 1)
    p = f"_{fa}_{sl}_{sg}"
    return {f"KVO{p}": k, f"KVOs{p}": s}


@indicator("mfi", "volume")
def mfi(f, high="high", low="low", close="close", volume="volume", length=14, drift=1):
    n, d = _len(length, 14), int(drift or 1)
    tp = (C(high) + C(low) + C(close)) / 3.0
    rmf = tp * C(volume)
    td = tp - lag(f, tp, d)
    pmf = F.when(td > 0, rmf).otherwise(F.lit(0.0))
    nmf = F.when(td < 0, rmf).otherwise(F.lit(0.0))
    ps, ns = B.rsum(f, pmf, n), B.rsum(f, nmf, n)
    return {f"MFI_{n}": dv(100 * ps, ps + ns)}


def _vi(f, close, volume, n, initial, pos):
    from ticklake.operators.momentum import roc_col
    sv = signed_col(f, volume, 1)
    sel = (sv > 0) if pos else (sv < 0)
    step = F.coalesce(F.when(sel, F.abs(sv)) * roc_col(f, close, n), F.lit(0.0))
    step = F.when(F.col("_rn") == 1, F.lit(float(initial))).otherwise(step)
    return (yield B.cumsum(f, step))


@indicator("nvi", "volume")
def nvi(f, close="close", volume="volume", length=1, initial=1000):
    n, i = _len(length, 1), int(initial) if initial and initial > 0 else 1000
    y = yield from _vi(f, close, volume, n, i, False)
    return {f"NVI_{n}": y}


@indicator("pvi", "volume")
def pvi(f, close="close", volume="volume", length=1, initial=1000):
    n, i = _len(length, 1), int(initial) if initial and initial > 0 else 1000
    y = yield from _vi(f, close, volume, n, i, True)
    return {f"PVI_{n}": y}


@indicator("pvol", "volume")
def pvol(f, close="close", volume="volume", signed=False):
    v = C(close) * C(volume)
    if signed:
        v = v * signed_col(f, close, 1)
    return {"PVOL": v}


@indicator("pvr", "volume")
def pvr(f, close="close", volume="volume"):
    cd = F.coalesce(C(close) - lag(f, close, 1), F.lit(0.0))
    vd = F.coalesce(C(volume) - lag(f, volume, 1), F.lit(0.0))
    v = (F.when((cd >= 0) & (vd >= 0), 1).when((cd >= 0) & (vd < 0), 2)
         .when((cd < 0) & (vd >= 0), 3).when((cd < 0) & (vd < 0), 4))
    return {"PVR": v.cast("double")}


@indicator("pvt", "volume")
def pvt(f, close="close", volume="volume", drift=1):
    from ticklake.operators.momentum import roc_col
    d = int(drift or 1)
    y = yield B.cumsum(f, roc_col(f, close, d) * C(volume))
    return {"PVT": y}


def _vp_by_price(df: DataFrame, w: int, symbol: str, close: str, volume: str) -> DataFrame:
    """Volume per price range: ``w`` ranges of equal width between the symbol's
    smallest and largest close, closed on the right, bounds rounded to two
    digits, the lowest one widened by a thousandth.  Empty ranges are listed."""
    ends = df.groupBy(symbol).agg(F.min(close).alias("__lo"), F.max(close).alias("__hi"))
    step = (F.col("__hi") - F.col("__lo")) / w
    j = df.join(ends, symbol)
    at = F.when(step > 0, F.ceil((C(close) - F.col("__lo")) / step) - 1).otherwise(F.lit(0))
    j = j.withColumn("chunk", F.least(F.greatest(at, F.lit(0)), F.lit(w - 1)).cast("int"))
    pos, neg = F.when(F.col("__sg") > 0, C(volume) * F.col("__sg")), F.when(F.col("__sg") < 0, -C(volume) * F.col("__sg"))
    sums = j.groupBy(symbol, "chunk").agg(F.avg(close).alias(f"mean_{close}"), F.sum(pos).alias("__p"), F.sum(neg).alias("__n"))
    every = ends.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
    low = F.col("__lo") + F.col("chunk") * step - F.when(F.col("chunk") == 0, (F.col("__hi") - F.col("__lo")) * 0.001).otherwise(F.lit(0.0))
    out = every.join(sums, [symbol, "chunk"], "left")
    return out.select(
        symbol, "chunk", F.round(low, 2).alias(f"low_{close}"), f"mean_{close}", F.round(F.col("__lo") + (F.col("chunk") + 1) * step, 2).alias(f"high_{close}"),
        F.coalesce("__p", F.lit(0.0)).alias(f"pos_{volume}"), F.coalesce("__n", F.lit(0.0)).alias(f"neg_{volume}"),
        (F.coalesce("__p", F.lit(0.0)) + F.coalesce("__n", F.lit(0.0))).alias(f"total_{volume}"))


def vp(bars: DataFrame, width: int = 10, symbol: str = "symbol", ts: str = "ts", close: str = "close",
       volume: str = "volume", sort_close: bool = False) -> DataFrame:
    """Volume profile per symbol (``sort_close``: by price range, see ``_vp_by_price``): rows split into ``width`` contiguous chunks
    by position exactly like ``array_split`` (the first N mod width chunks
    get one extra row).  Chunk ids come from the row number and the symbol's
    row count (a small aggregate); the profile itself is a combinable
    ``groupBy(symbol, chunk)`` aggregate, so a large symbol is pre-aggregated
    map-side instead of being windowed in one task."""
    w = int(width) if width and width > 0 else 10
    from ticklake.plans.frame import SeriesFrame
    fr = SeriesFrame(bars, symbol, ts, segment="auto", lookback=1)
    sgn = signed_col(fr, close, 1)
    fr.with_columns({"__sg": sgn})
    df = fr.result(keep=[symbol, ts, close, volume, "_rn", "__sg"])
    if sort_close:
        return _vp_by_price(df, w, symbol, close, volume)
    cnt = df.groupBy(symbol).agg(F.count(F.lit(1)).alias("__n"))
    df = df.join(cnt, symbol)
    q = F.floor(F.col("__n") / w)
    r = F.col("__n") - q * w
    big = r * (q + 1)
    k = F.col("_rn") - 1
    chunk = F.when(k < big, F.floor(k / (q + 1))).otherwise(r + F.floor((k - big) / F.greatest(q, F.lit(1))))
    pos = F.when(F.col("__sg") > 0, C(volume) * F.col("__sg"))
    neg = F.when(F.col("__sg") < 0, -C(volume) * F.col("__sg"))
    out = (df.withColumn("__chunk", chunk.cast("int"))
           .groupBy(symbol, "__chunk")
           .agg(F.min(close).alias(f"low_{close}"), F.avg(close).alias(f"mean_{close}"),
                F.max(close).alias(f"high_{close}"),
                F.coalesce(F.sum(pos), F.lit(0.0)).alias(f"pos_{volume}"),
                F.coalesce(F.sum(neg), F.lit(0.0)).alias(f"neg_{volume}")))
    return (out.withColumn(f"total_{volume}", F.col(f"pos_{volume}") + F.col(f"neg_{volume}"))
            .withColumnRenamed("__chunk", "chunk"))
