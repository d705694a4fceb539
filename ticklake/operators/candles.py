"""Candle patterns and Heikin-Ashi."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticklake.functions import blocks as B
from ticklake.functions.blocks import C, dv, lag, nz_range
from ticklake.operators.registry import indicator

# The pattern names a TA-Lib build would accept.  Only "doji"
# and "inside" are computed natively (as in the reference without TA-Lib).
ALL_PATTERNS = [
    "2crows", "3blackcrows", "3inside", "3linestrike", "3outside", "3starsinsouth",
    "3whitesoldiers", "abandonedbaby", "advanceblock", "belthold", "breakaway",
    "closingmarubozu", "concealbabyswall", "counterattack", "darkcloudcover", "doji",
    "dojistar", "dragonflydoji", "engulfing", "eveningdojistar", "eveningstar",
    "gapsidesidewhite", "gravestonedoji", "hammer", "hangingman", "harami",
    "haramicross", "highwave", "hikkake", "hikkakemod", "homingpigeon",
    "identical3crows", "inneck", "inside", "invertedhammer", "kicking", "kickingbylength",
    "ladderbottom", "longleggeddoji", "longline", "marubozu", "matchinglow", "mathold",
    "morningdojistar", "morningstar", "onneck", "piercing", "rickshawman",
    "risefall3methods", "separatinglines", "shootingstar", "shortline", "spinningtop",
    "stalledpattern", "sticksandwich", "takuri", "tasukigap", "thrusting", "tristar",
    "unique3river", "upsidegap2crows", "xsidegap3methods",
]


def _pct(v):
    return isinstance(v, (int, float)) and not isinstance(v, bool) and 0 <= v <= 100


def doji_col(f, open_, high, low, close, length=10, factor=10.0, scalar=100.0, asint=True, naive=False):
    body = F.abs(nz_range(close, open_))
    hl = F.abs(nz_range(high, low))
    avg = B.sma(f, hl, length)
    d = F.coalesce(body < 0.01 * factor * avg, F.lit(False))
    if naive:
        d = F.when(F.col("_rn") <= length, body < 0.01 * factor * hl).otherwise(d)
    return scalar * d.cast("int") if asint else d


@indicator("cdl_doji", "candles")
def cdl_doji(f, open_="open", high="high", low="low", close="close", length=10, factor=10, scalar=100,
             asint=True, naive=False):
    n = int(length) if length and length > 0 else 10
    fa = float(factor) if _pct(factor) else 10.0
    s = float(scalar) if scalar else 100.0
    return {f"CDL_DOJI_{n}_{0.01 * fa}": doji_col(f, open_, high, low, close, n, fa, s, asint, naive)}


def inside_col(f, open_, high, low, close, asbool=False):
    ins = F.coalesce((C(high) - lag(f, high, 1) < 0) & (C(low) - lag(f, low, 1) > 0), F.lit(False))
    if asbool:
        return ins
    color = F.when(C(close) >= C(open_), F.lit(1)).otherwise(F.lit(-1))
    return ins.cast("int") * color


@indicator("cdl_inside", "candles")
def cdl_inside(f, open_="open", high="high", low="low", close="close", asbool=False):
    return {"CDL_INSIDE": inside_col(f, open_, high, low, close, asbool)}


@indicator("cdl_pattern", "candles")
def cdl_pattern(f, open_="open", high="high", low="low", close="close", name="all", scalar=100):
    """Patterns by name.  ``all`` means the patterns built here (doji, inside);
    asking by name for one that only the external binary has raises."""
    names = ALL_PATTERNS if name == "all" else ([name] if isinstance(name, str) else list(name))
    out = {}
    for nm in names:
        if nm == "doji":
            out["CDL_DOJI_10_0.1"] = doji_col(f, open_, high, low, close, 10, 10.0, float(scalar))
        elif nm == "inside":
            out["CDL_INSIDE"] = inside_col(f, open_, high, low, close) * float(scalar)
        elif nm in ALL_PATTERNS:
            if name != "all":
                raise NotImplementedError(f"candle pattern {nm!r} needs the TA-Lib binary; not built")
        else:
            raise KeyError(f"unknown candle pattern {nm!r}")
    return out


def _zs(f, x, n, ddof):
    from ticklake.operators.statistics import stdev_col
    return dv(C(x) - B.sma(f, x, n), stdev_col(f, x, n, ddof))


@indicator("cdl_z", "candles")
def cdl_z(f, open_="open", high="high", low="low", close="close", length=30, full=False, ddof=1):
    n = int(length) if length and length > 0 else 30
    dd = int(ddof) if isinstance(ddof, int) and 0 <= ddof < n else 1
    if full:
        # whole-history z-score: only the last row has a full window, then backfilled
        # -> every row gets (x_last - mean_all) / std_all.  Per-symbol aggregate, joined back.
        sym = f.symbol
        real = f.df.filter(~F.col("_halo"))
        aggs = []
        for c in (open_, high, low, close):
            aggs += [F.max_by(C(c), F.col("_rn")).alias(f"__l_{c}"), F.avg(C(c)).alias(f"__a_{c}"),
                     F.stddev_samp(C(c)).alias(f"__s_{c}") if dd == 1 else F.stddev_pop(C(c)).alias(f"__s_{c}")]
        f.df = f.df.join(real.groupBy(sym).agg(*aggs), sym, "left")
        return {f"{nm}_Za": dv(F.col(f"__l_{c}") - F.col(f"__a_{c}"), F.col(f"__s_{c}"))
                for nm, c in (("open", open_), ("high", high), ("low", low), ("close", close))}
    p = f"_{n}_{dd}"
    return {f"open_Z{p}": _zs(f, open_, n, dd), f"high_Z{p}": _zs(f, high, n, dd),
            f"low_Z{p}": _zs(f, low, n, dd), f"close_Z{p}": _zs(f, close, n, dd)}


@indicator("ha", "candles")
def ha(f, open_="open", high="high", low="low", close="close"):
    hc = 0.25 * (C(open_) + C(high) + C(low) + C(close))
    k = F.col("_rn")
    seed = 0.5 * (C(open_) + C(close))
    b = F.when(k == 1, seed).otherwise(0.5 * lag(f, hc, 1))
    ho = yield B.linrec(f, F.lit(0.5), b, start=1)
    return {"HA_open": ho, "HA_high": F.greatest(ho, C(high), hc), "HA_low": F.least(ho, C(low), hc),
            "HA_close": hc}
