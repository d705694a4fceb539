"""Overlap indicators: moving averages and price transforms."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ticklake.functions import blocks as B
from ticklake.functions.blocks import C, dv, fir, lag, roll, sma as _sma
from ticklake.functions.weights import fibonacci, pascals_triangle, symmetric_triangle, sine_weights
from ticklake.operators.registry import indicator


def _len(v, d):
    return int(v) if v and v > 0 else d


# ---------------------------------------------------------------- prices
@indicator("hl2", "overlap")
def hl2(f, high="high", low="low"):
    return {"HL2": 0.5 * (C(high) + C(low))}


@indicator("hlc3", "overlap")
def hlc3(f, high="high", low="low", close="close"):
    return {"HLC3": (C(high) + C(low) + C(close)) / 3.0}


@indicator("ohlc4", "overlap")
def ohlc4(f, open_="open", high="high", low="low", close="close"):
    return {"OHLC4": 0.25 * (C(open_) + C(high) + C(low) + C(close))}


@indicator("wcp", "overlap")
def wcp(f, high="high", low="low", close="close"):
    return {"WCP": (C(high) + C(low) + 2 * C(close)) / 4.0}


# ------------------------------------------------------ bounded averages
@indicator("sma", "overlap")
def sma(f, close="close", length=10, min_periods=None):
    n = _len(length, 10)
    return {f"SMA_{n}": roll(f, close, n, "avg", min_periods)}


def wma_col(f, x, n):
    w = [float(i) for i in range(1, n + 1)]
    tot = 0.5 * n * (n + 1)
    return fir(f, x, [v / tot for v in w])


@indicator("wma", "overlap")
def wma(f, close="close", length=10):
    n = _len(length, 10)
    return {f"WMA_{n}": wma_col(f, close, n)}


@indicator("fwma", "overlap")
def fwma(f, close="close", length=10):
    n = _len(length, 10)
    return {f"FWMA_{n}": fir(f, close, fibonacci(n, weighted=True))}


@indicator("pwma", "overlap")
def pwma(f, close="close", length=10):
    n = _len(length, 10)
    return {f"PWMA_{n}": fir(f, close, pascals_triangle(n - 1, weighted=True))}


@indicator("swma", "overlap")
def swma(f, close="close", length=10):
    n = _len(length, 10)
    return {f"SWMA_{n}": fir(f, close, symmetric_triangle(n, weighted=True))}


@indicator("sinwma", "overlap")
def sinwma(f, close="close", length=14):
    n = _len(length, 14)
    return {f"SINWMA_{n}": fir(f, close, sine_weights(n))}


def trima_col(f, x, n):
    h = round(0.5 * (n + 1))
    return _sma(f, _sma(f, x, h), h)


@indicator("trima", "overlap")
def trima(f, close="close", length=10):
    n = _len(length, 10)
    return {f"TRIMA_{n}": trima_col(f, close, n)}


def hma_col(f, x, n):
    half, sq = int(n / 2), int(math.sqrt(n))
    return wma_col(f, 2 * wma_col(f, x, half) - wma_col(f, x, n), sq)


@indicator("hma", "overlap")
def hma(f, close="close", length=10):
    n = _len(length, 10)
    return {f"HMA_{n}": hma_col(f, close, n)}


@indicator("midpoint", "overlap")
def midpoint(f, close="close", length=2, min_periods=None):
    n = _len(length, 2)
    return {f"MIDPOINT_{n}": 0.5 * (roll(f, close, n, "min", min_periods) + roll(f, close, n, "max", min_periods))}


@indicator("midprice", "overlap")
def midprice(f, high="high", low="low", length=2, min_periods=None):
    n = _len(length, 2)
    return {f"MIDPRICE_{n}": 0.5 * (roll(f, low, n, "min", min_periods) + roll(f, high, n, "max", min_periods))}


@indicator("vwma", "overlap")
def vwma(f, close="close", volume="volume", length=10):
    n = _len(length, 10)
    pv = C(close) * C(volume)
    return {f"VWMA_{n}": dv(_sma(f, pv, n), _sma(f, volume, n))}


def linreg_cols(f, x, n):
    """(slope m, intercept b at x=0 for x = 1..n, r)."""
    m, b, r = B.regr(f, x, n)
    # regr gives intercept for positions 1..n shifted: y = m*pos + b0 with pos in 1..n
    return m, b - m * 0.0, r


@indicator("linreg", "overlap")
def linreg(f, close="close", length=14, angle=False, degrees=False, intercept=False, r=False, slope=False,
           tsf=False):
    n = _len(length, 14)
    m, b, rr = B.regr(f, close, n)
    # x = 1..n inside the window: value at position p is m*p + b  (b: x=0)
    if slope:
        v, nm = m, "m"
    elif intercept:
        v, nm = b, "b"
    elif angle:
        v = F.atan(m)
        if degrees:
            v = v * (180 / math.pi)
        nm = "a"
    elif r:
        v, nm = rr, "r"
    elif tsf:
        v, nm = m * n + b, ""
    else:
        v, nm = m * (n - 1) + b, ""
    return {f"LR{nm}_{n}": v}


def linreg_value(f, x, n):
    m, b, _ = B.regr(f, x, n)
    return m * (n - 1) + b


@indicator("alma", "overlap")
def alma(f, close="close", length=10, sigma=6.0, distribution_offset=0.85):
    n = _len(length, 10)
    sigma = float(sigma) if sigma and sigma > 0 else 6.0
    off = float(distribution_offset) if distribution_offset and distribution_offset > 0 else 0.85
    m = off * (n - 1)
    s = n / sigma
    wtd = [math.exp(-((i - m) ** 2) / (2 * s * s)) for i in range(n)]
    tot = sum(wtd)
    # wtd[j] multiplies close[t - j]: newest first -> reverse to oldest-first
    w = [v / tot for v in reversed(wtd)]
    val = fir(f, close, w)
    k = F.col("_rn")
    # row n-1 (1-based n) is 0 and row n+1 is null in the reference loop
    res = F.when(k == n, F.lit(0.0)).when(k == n + 1, F.lit(None)).otherwise(F.when(k > n + 1, val))
    return {f"ALMA_{n}_{sigma}_{off}": res}


# ---------------------------------------------------------- recurrences
@indicator("ema", "overlap")
def ema(f, close="close", length=10, sma=True, warm=0):
    n = _len(length, 10)
    y = yield B.ema(f, close, n, warm=warm, sma_seed=bool(sma))
    return {f"EMA_{n}": y}


@indicator("rma", "overlap")
def rma(f, close="close", length=10, warm=0):
    n = _len(length, 10)
    y = yield B.rma(f, close, n, warm=warm)
    return {f"RMA_{n}": y}


@indicator("dema", "overlap")
def dema(f, close="close", length=10):
    n = _len(length, 10)
    e1 = yield B.ema(f, close, n)
    e2 = yield B.ema(f, e1, n, warm=n - 1)
    return {f"DEMA_{n}": 2 * e1 - e2}


@indicator("tema", "overlap")
def tema(f, close="close", length=10):
    n = _len(length, 10)
    e1 = yield B.ema(f, close, n)
    e2 = yield B.ema(f, e1, n, warm=n - 1)
    e3 = yield B.ema(f, e2, n, warm=2 * (n - 1))
    return {f"TEMA_{n}": 3 * (e1 - e2) + e3}


@indicator("t3", "overlap")
def t3(f, close="close", length=10, a=0.7):
    n = _len(length, 10)
    a = float(a) if a and 0 < a < 1 else 0.7
    c1 = -a * a * a
    c2 = 3 * a * a + 3 * a * a * a
    c3 = -6 * a * a - 3 * a - 3 * a * a * a
    c4 = a * a * a + 3 * a * a + 3 * a + 1
    es = []
    x = C(close)
    for i in range(6):
        x = yield B.ema(f, x, n, warm=i * (n - 1))
        es.append(x)
    return {f"T3_{n}_{a}": c1 * es[5] + c2 * es[4] + c3 * es[3] + c4 * es[2]}


def ma_gen(f, name, x, n, warm=0):
    """By-name moving average (generator: ``y = yield from ma_gen(...)``)."""
    name = (name or "ema").lower()
    if name == "sma":
        return _sma(f, x, n)
    if name == "wma":
        return wma_col(f, x, n)
    if name == "hma":
        return hma_col(f, x, n)
    if name == "trima":
        return trima_col(f, x, n)
    if name == "fwma":
        return fir(f, x, fibonacci(n, weighted=True))
    if name == "pwma":
        return fir(f, x, pascals_triangle(n - 1, weighted=True))
    if name == "swma":
        return fir(f, x, symmetric_triangle(n, weighted=True))
    if name == "sinwma":
        return fir(f, x, sine_weights(n))
    if name == "linreg":
        return linreg_value(f, x, n)
    if name == "midpoint":
        return 0.5 * (roll(f, x, n, "min") + roll(f, x, n, "max"))
    if name == "rma":
        return (yield B.rma(f, x, n, warm=warm))
    if name == "dema":
        e1 = yield B.ema(f, x, n, warm=warm)
        e2 = yield B.ema(f, e1, n, warm=warm + n - 1)
        return 2 * e1 - e2
    if name == "tema":
        e1 = yield B.ema(f, x, n, warm=warm)
        e2 = yield B.ema(f, e1, n, warm=warm + n - 1)
        e3 = yield B.ema(f, e2, n, warm=warm + 2 * (n - 1))
        return 3 * (e1 - e2) + e3
    if name == "t3":
        a = 0.7
        c1, c2 = -a ** 3, 3 * a * a + 3 * a ** 3
        c3, c4 = -6 * a * a - 3 * a - 3 * a ** 3, a ** 3 + 3 * a * a + 3 * a + 1
        es, y = [], x
        for i in range(6):
            y = yield B.ema(f, y, n, warm=warm + i * (n - 1))
            es.append(y)
        return c1 * es[5] + c2 * es[4] + c3 * es[3] + c4 * es[2]
    if name == "zlma":
        lg = int(0.5 * (n - 1))
        return (yield B.ema(f, 2 * C(x) - lag(f, x, lg), n, warm=warm + lg))
    if name == "kama":
        from ticklake.operators.overlap import kama_gen
        return (yield from kama_gen(f, x, n, 2, 30, 1))
    if name == "vidya":
        from ticklake.operators.overlap import vidya_gen
        return (yield from vidya_gen(f, x, n, 1))
    return (yield B.ema(f, x, n, warm=warm))


@indicator("ma", "overlap")
def ma(f, name="ema", source="close", length=10):
    n = _len(length, 10)
    y = yield from ma_gen(f, name, source, n)
    return {f"{name.upper()}_{n}": y}


@indicator("zlma", "overlap")
def zlma(f, close="close", length=10, mamode="ema"):
    n = _len(length, 10)
    lg = int(0.5 * (n - 1))
    src = 2 * C(close) - lag(f, close, lg)
    mm = (mamode or "ema").lower()
    y = yield from ma_gen(f, mm, src, n, warm=lg)
    return {f"ZL_{mm.upper()}_{n}": y}


def kama_gen(f, x, n, fast, slow, drift):
    x = C(x)
    fr, sr = 2.0 / (fast + 1), 2.0 / (slow + 1)
    change = F.abs(x - lag(f, x, n))
    vol = roll(f, F.abs(x - lag(f, x, drift)), n, "sum")
    er = F.when(vol != 0, change / vol).otherwise(F.lit(0.0))
    sc = (er * (fr - sr) + sr) ** 2
    k = F.col("_rn")
    # k_t = sc*x + (1-sc)*k_{t-1}, seeded 0 at row n, values from row n+1
    y = yield B.linrec(f, F.when(k > n, 1 - sc), F.when(k > n, sc * x).otherwise(F.lit(0.0)), start=n)
    return y


@indicator("kama", "overlap")
def kama(f, close="close", length=10, fast=2, slow=30, drift=1):
    n, fa, sl = _len(length, 10), _len(fast, 2), _len(slow, 30)
    y = yield from kama_gen(f, close, n, fa, sl, drift)
    return {f"KAMA_{n}_{fa}_{sl}": y}


def vidya_gen(f, x, n, drift):
    x = C(x)
    alpha = 2.0 / (n + 1)
    d = x - lag(f, x, drift)
    pos = F.when(d > 0, d).otherwise(F.lit(0.0))
    neg = F.when(d < 0, F.abs(d)).otherwise(F.lit(0.0))
    ps, ns = roll(f, pos, n, "sum"), roll(f, neg, n, "sum")
    cmo = F.when(ps + ns != 0, (ps - ns) / (ps + ns))
    k = F.col("_rn")
    af = alpha * F.abs(cmo)
    # v_t = af*x + (1-af)*v_{t-1} from row n+1 (0 before, zeros -> null)
    y = yield B.linrec(f, F.when(k > n, 1 - af), F.when(k > n, af * x).otherwise(F.lit(0.0)), start=n)
    return F.when(y != 0, y)


@indicator("vidya", "overlap")
def vidya(f, close="close", length=14, drift=1):
    n = _len(length, 14)
    y = yield from vidya_gen(f, close, n, drift)
    return {f"VIDYA_{n}": y}


@indicator("vwap", "overlap")
def vwap(f, high="high", low="low", close="close", volume="volume", anchor="D"):
    """Cumulative typical-price VWAP reset per calendar period: running sums on
    the frame's own layout.  Segmented, a period may span segments: the sums
    are then recurrences whose coefficient is 0 on a period's first row."""
    unit = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year", "H": "hour"}.get(
        str(anchor).upper(), "day")
    from pyspark.sql import Window
    tp = (C(high) + C(low) + C(close)) / 3.0
    per = F.date_trunc(unit, F.col(f.ts))
    if B._native(f):
        wp = Window.partitionBy(f.symbol, "_part", per).orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
        num, den = F.sum(tp * C(volume)).over(wp), F.sum(C(volume)).over(wp)
    else:
        keep = B.mat(f, F.when(per == lag(f, per, 1), F.lit(1.0)).otherwise(F.lit(0.0)))
        num, den = yield B.linrec(f, keep, tp * C(volume)), B.linrec(f, keep, C(volume))
    return {f"VWAP_{str(anchor).upper()}": dv(num, den)}


@indicator("ichimoku", "overlap", lookahead=True)
def ichimoku(f, high="high", low="low", close="close", tenkan=9, kijun=26, senkou=52, include_chikou=True):
    t, k, s = _len(tenkan, 9), _len(kijun, 26), _len(senkou, 52)
    mid = lambda n: 0.5 * (roll(f, high, n, "max") + roll(f, low, n, "min"))
    ts_, ks_ = mid(t), mid(k)
    # span A / B are shifted forward by kijun-1 rows (pandas shift(kijun-1))
    spa = 0.5 * (lag(f, ts_, k - 1) + lag(f, ks_, k - 1))
    spb = lag(f, mid(s), k - 1)
    out = {f"ISA_{t}": spa, f"ISB_{k}": spb, f"ITS_{t}": ts_, f"IKS_{k}": ks_}
    if include_chikou:
        out[f"ICS_{k}"] = lag(f, close, -(k - 1))
    return out


@indicator("hilo", "overlap")
def hilo(f, high="high", low="low", close="close", high_length=13, low_length=21, mamode="sma"):
    """Gann HiLo: the low average from a close above yesterday's high average on,
    the high average from a close below yesterday's low average on; between
    such rows the line carries the last value forward."""
    hn, ln = _len(high_length, 13), _len(low_length, 21)
    mm = mamode.lower() if isinstance(mamode, str) else "sma"
    ha = yield from ma_gen(f, mm, high, hn)
    la = yield from ma_gen(f, mm, low, ln)
    ha, la = B.mat(f, ha), B.mat(f, la)
    up = F.coalesce(C(close) > lag(f, ha, 1), F.lit(False))
    down = F.coalesce(C(close) < lag(f, la, 1), F.lit(False)) & ~up
    up, down = B.mat(f, up), B.mat(f, down)
    line = yield B.ffill(f, F.when(up, la).when(down, ha))
    p = f"_{hn}_{ln}"
    return {f"HILO{p}": line, f"HILOl{p}": F.when(~down, line), f"HILOs{p}": F.when(~up, line)}


def ichimoku_span(bars, tenkan=9, kijun=26, senkou=52, symbol="symbol", ts="ts", segment="auto"):
    """The cloud ahead: the last ``kijun`` span values of each symbol, dated on
    the business days that follow its last bar (``symbol, ts, ISA, ISB``).
    A top-k per symbol over the finished indicator."""
    from ticklake.operators.joins import tail
    from ticklake.plans.frame import SeriesFrame
    t, k, s = _len(tenkan, 9), _len(kijun, 26), _len(senkou, 52)
    f = SeriesFrame(bars, symbol, ts, segment=segment, lookback=max(t, k, s))
    mid = lambda n: 0.5 * (roll(f, "high", n, "max") + roll(f, "low", n, "min"))
    f.with_columns({"__a": 0.5 * (mid(t) + mid(k)), "__b": mid(s)})
    rows = f.result(keep=[symbol, ts, "__a", "__b", "_rn"]).withColumnRenamed("_rn", "__rn")
    last = rows.groupBy(symbol).agg(F.max(ts).alias("__last"), F.max("__rn").alias("__n"))
    near = tail(rows, k, symbol, ts).join(last, symbol).where(F.col("__rn") > F.col("__n") - k)
    i = F.col("__rn") - (F.col("__n") - F.least(F.col("__n"), F.lit(k))) - 1
    day = F.weekday(F.date_add(F.col("__last").cast("date"), 1))
    skip = F.when(day >= 5, 7 - day).otherwise(F.lit(0))
    first = F.when(day >= 5, F.lit(0)).otherwise(day)
    ahead = (1 + skip + F.floor((first + i) / 5) * 7 + (first + i) % 5 - first).cast("int")
    date = F.col("__last") + F.make_interval(days=ahead)
    return near.select(symbol, date.alias(ts), F.col("__a").alias(f"ISA_{t}"), F.col("__b").alias(f"ISB_{k}"))
