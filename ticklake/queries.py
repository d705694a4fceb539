"""Registered queries: each is a Spark job over the driver tables plus (where
SQL can say it) an independent DuckDB SQL twin used as the oracle.

Indicator queries build bars from the whole ``events`` (hourly, 5 symbols)
or ``lineitem`` (weekly, one symbol per supplier) tables and run indicators
over every bar.  Float outputs are rounded to 4 digits in both engines,
integer flags are cast to int.
"""

from __future__ import annotations

import math
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import ticklake.operators  # noqa: F401  (registers indicators)
from ticklake.functions.weights import fibonacci, pascals_triangle, sine_weights, symmetric_triangle
from ticklake.oracle_sql import Sql, dv, fir, lag, nz, q, roll, w
from ticklake.operators import registry as R
from ticklake.plans.frame import SeriesFrame
from ticklake.sources.bars import BARS_H_SQL, BARS_W_SQL, bars_h, bars_w

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BARS_FN = {"h": bars_h, "w": bars_w}


def r4(c):
    """Round to 4 decimals, or to 8 significant digits when that is coarser
    (|x| >= 1e4), with the same IEEE steps as the SQL twin, so equal doubles
    round equally and last-bit differences of summation order only matter
    at exact half-way points."""
    c = c.cast("double")
    a = F.abs(c)
    e = F.floor(F.log10(F.when(a > 0, a)))
    d = F.when(e >= 4, F.lit(4) - (e - 3)).otherwise(F.lit(4))
    up = F.signum(c) * F.floor(a * F.pow(F.lit(10.0), d) + 0.5) / F.pow(F.lit(10.0), d)
    dn = F.signum(c) * F.floor(a / F.pow(F.lit(10.0), -d) + 0.5) * F.pow(F.lit(10.0), -d)
    finite = ~F.isnan(c) & (a != float("inf"))
    return F.when(F.isnan(c), F.lit(None).cast("double")).when(~finite | (a == 0), c) \
        .when(d >= 0, up).otherwise(dn)


def _ind_df(spark, sf_dir, bars, specs, outs, ints=(), segment="auto", lookahead=0):
    b = BARS_FN[bars](spark, sf_dir)
    f = SeriesFrame(b, segment=segment)
    R.run(f, specs)
    df = f.result()
    sel = [F.col("symbol"), F.col("ts")]
    for o in outs:
        c = F.col(f"`{o}`")
        sel.append(c.cast("int").alias(o) if o in ints else r4(c).alias(o))
    return df.select(*sel)


#: (specs, SQL builder, outputs, integer outputs) of every indicator query with a twin.
RECIPES: list[tuple] = []


def ind(name, bars, specs, sqlfn, outs, ints=(), segment="auto", lookahead=0):
    specs = specs if isinstance(specs, list) else [specs]
    if sqlfn is not None:
        RECIPES.append((specs, sqlfn, outs, ints))
    SPARK[name] = lambda spark, sf_dir: _ind_df(spark, sf_dir, bars, specs, outs, ints, segment, lookahead)
    if sqlfn is not None:
        s = Sql(bars)
        res = sqlfn(s)
        ORACLE[name] = s.sql(res, ints=ints)


# ---------------------------------------------------------------- bars
def _bars_q(kind):
    def fn(spark, sf_dir):
        return BARS_FN[kind](spark, sf_dir)
    return fn


SPARK["bars_hourly"] = _bars_q("h")
ORACLE["bars_hourly"] = "SELECT * FROM (" + Sql("h").ctes[0][1].split("FROM (", 1)[1].rsplit(") x", 1)[0] + ") t"
SPARK["bars_weekly"] = _bars_q("w")
ORACLE["bars_weekly"] = "SELECT * FROM (" + Sql("w").ctes[0][1].split("FROM (", 1)[1].rsplit(") x", 1)[0] + ") t"

C = "close"
TR = (f"CASE WHEN rn > 1 THEN greatest(abs({nz('high', 'low')}), abs(high - {lag('close')}), "
      f"abs({lag('close')} - low)) END")
HLC3 = "((high + low + close) / 3.0)"

# ---------------------------------------------------------------- overlap
ind("sma_hourly", "h", dict(kind="sma", length=10), lambda s: {"SMA_10": roll(C, 10)}, ["SMA_10"])
ind("sma_weekly", "w", dict(kind="sma", length=20), lambda s: {"SMA_20": roll(C, 20)}, ["SMA_20"])
ind("wma_hourly", "h", dict(kind="wma", length=10),
    lambda s: {"WMA_10": fir(C, [i / 55.0 for i in range(1, 11)])}, ["WMA_10"])
ind("fwma_hourly", "h", dict(kind="fwma", length=10), lambda s: {"FWMA_10": fir(C, fibonacci(10, True))}, ["FWMA_10"])
ind("pwma_hourly", "h", dict(kind="pwma", length=10), lambda s: {"PWMA_10": fir(C, pascals_triangle(9, True))},
    ["PWMA_10"])
ind("swma_hourly", "h", dict(kind="swma", length=10), lambda s: {"SWMA_10": fir(C, symmetric_triangle(10, True))},
    ["SWMA_10"])
ind("sinwma_hourly", "h", dict(kind="sinwma", length=14), lambda s: {"SINWMA_14": fir(C, sine_weights(14))},
    ["SINWMA_14"])


def _trima(s):
    s.cols(t1=roll(C, 6))
    return {"TRIMA_10": roll("t1", 6)}


ind("trima_hourly", "h", dict(kind="trima", length=10), _trima, ["TRIMA_10"])


def _hma(s):
    wf = lambda x, n: fir(x, [i / (0.5 * n * (n + 1)) for i in range(1, n + 1)])
    s.cols(h1=f"2 * {wf(C, 5)} - {wf(C, 10)}")
    return {"HMA_10": wf("h1", 3)}


ind("hma_hourly", "h", dict(kind="hma", length=10), _hma, ["HMA_10"])
ind("midpoint_hourly", "h", dict(kind="midpoint", length=5),
    lambda s: {"MIDPOINT_5": f"0.5 * ({roll(C, 5, 'min')} + {roll(C, 5, 'max')})"}, ["MIDPOINT_5"])
ind("midprice_hourly", "h", dict(kind="midprice", length=5),
    lambda s: {"MIDPRICE_5": f"0.5 * ({roll('low', 5, 'min')} + {roll('high', 5, 'max')})"}, ["MIDPRICE_5"])
ind("vwma_hourly", "h", dict(kind="vwma", length=10),
    lambda s: {"VWMA_10": dv(roll("close * volume", 10), roll("volume", 10))}, ["VWMA_10"])


def _ols_cols(s, x, n, pre):
    # closed-form least squares on positions 1..n
    xs = 0.5 * n * (n + 1)
    x2 = xs * (2 * n + 1) / 3
    div = n * x2 - xs * xs
    s.cols(**{f"{pre}_ys": f"sum({x}) {w(n)}", f"{pre}_xy": "(" + " + ".join(
        f"{i + 1} * {lag(x, n - 1 - i) if n - 1 - i else x}" for i in range(n)) + ")",
        f"{pre}_y2": f"sum({x} * {x}) {w(n)}", f"{pre}_c": f"count({x}) {w(n)}"})
    m = f"(({n} * {pre}_xy - {xs!r} * {pre}_ys) / {div!r})"
    b = f"(({pre}_ys * {x2!r} - {xs!r} * {pre}_xy) / {div!r})"
    r = (f"(({n} * {pre}_xy - {xs!r} * {pre}_ys) / sqrt({div!r} * ({n} * {pre}_y2 - {pre}_ys * {pre}_ys)))")
    ok = f"{pre}_c = {n}"
    return m, b, r, ok


def _linreg(s):
    m, b, r, ok = _ols_cols(s, C, 14, "lr")
    return {"LR_14": f"CASE WHEN {ok} THEN {m} * 13 + {b} END"}


ind("linreg_hourly", "h", dict(kind="linreg", length=14), _linreg, ["LR_14"])


def _linreg_all(s):
    m, b, r, ok = _ols_cols(s, C, 10, "lr")
    return {"LRm_10": f"CASE WHEN {ok} THEN {m} END", "LRb_10": f"CASE WHEN {ok} THEN {b} END",
            "LRr_10": f"CASE WHEN {ok} THEN {r} END"}


ind("linreg_parts_weekly", "w", [dict(kind="linreg", length=10, slope=True), dict(kind="linreg", length=10,
                                                                                  intercept=True),
                                 dict(kind="linreg", length=10, r=True)], _linreg_all, ["LRm_10", "LRb_10", "LRr_10"])


def _alma(s):
    n, m, sg = 10, 0.85 * 9, 10 / 6.0
    wt = [math.exp(-((i - m) ** 2) / (2 * sg * sg)) for i in range(n)]
    tot = sum(wt)
    val = fir(C, [v / tot for v in reversed(wt)])
    return {"ALMA_10_6.0_0.85": f"CASE WHEN rn = 10 THEN 0.0 WHEN rn > 11 THEN {val} END"}


ind("alma_hourly", "h", dict(kind="alma"), _alma, ["ALMA_10_6.0_0.85"])


def _ema(s):
    s.ema("EMA_10", C, 10)
    return {"EMA_10": q("EMA_10")}


ind("ema_hourly", "h", dict(kind="ema", length=10), _ema, ["EMA_10"])
ind("ema_weekly", "w", dict(kind="ema", length=5), lambda s: (s.ema("EMA_5", C, 5), {"EMA_5": q("EMA_5")})[1],
    ["EMA_5"])
ind("ema_segmented_hourly", "h", dict(kind="ema", length=20),
    lambda s: (s.ema("EMA_20", C, 20), {"EMA_20": q("EMA_20")})[1], ["EMA_20"], segment="2 days")


def _rma(s):
    s.rma("RMA_10", C, 10)
    return {"RMA_10": q("RMA_10")}


ind("rma_hourly", "h", dict(kind="rma", length=10), _rma, ["RMA_10"])


def _dema(s):
    s.ema("e1", C, 10).ema("e2", "e1", 10, warm=9)
    return {"DEMA_10": "2 * e1 - e2"}


ind("dema_hourly", "h", dict(kind="dema", length=10), _dema, ["DEMA_10"])


def _tema(s):
    s.ema("e1", C, 10).ema("e2", "e1", 10, warm=9).ema("e3", "e2", 10, warm=18)
    return {"TEMA_10": "3 * (e1 - e2) + e3"}


ind("tema_hourly", "h", dict(kind="tema", length=10), _tema, ["TEMA_10"])


def _t3(s):
    a = 0.7
    c1, c2 = -a ** 3, 3 * a * a + 3 * a ** 3
    c3, c4 = -6 * a * a - 3 * a - 3 * a ** 3, a ** 3 + 3 * a * a + 3 * a + 1
    prev = C
    for i in range(6):
        s.ema(f"e{i + 1}", prev, 10, warm=9 * i)
        prev = f"e{i + 1}"
    return {"T3_10_0.7": f"{c1!r} * e6 + {c2!r} * e5 + {c3!r} * e4 + {c4!r} * e3"}


ind("t3_hourly", "h", dict(kind="t3", length=10), _t3, ["T3_10_0.7"])


def _zlma(s):
    s.cols(zs=f"2 * close - {lag(C, 4)}")
    s.ema("ZL", "zs", 10, warm=4)
    return {"ZL_EMA_10": "ZL"}


ind("zlma_hourly", "h", dict(kind="zlma", length=10), _zlma, ["ZL_EMA_10"])


def _kama(s):
    n, fr, sr = 10, 2.0 / 3, 2.0 / 31
    s.cols(ch=f"abs(close - {lag(C, n)})", ad=f"abs(close - {lag(C, 1)})")
    s.cols(vol=roll("ad", n, "sum"))
    s.cols(er=f"CASE WHEN vol <> 0 THEN ch / vol ELSE 0.0 END")
    s.cols(sc=f"power(er * {fr - sr!r} + {sr!r}, 2)")
    s.cols(ka="CASE WHEN rn > 10 THEN 1 - sc ELSE 1.0 END", kb="CASE WHEN rn > 10 THEN sc * close ELSE 0.0 END")
    s.rec(n, KAMA=("ka", "kb"))
    return {"KAMA_10_2_30": "KAMA"}


ind("kama_hourly", "h", dict(kind="kama"), _kama, ["KAMA_10_2_30"])


def _vidya(s):
    n, al = 14, 2.0 / 15
    s.cols(d=f"close - {lag(C, 1)}")
    s.cols(p="CASE WHEN d > 0 THEN d ELSE 0.0 END", m="CASE WHEN d < 0 THEN abs(d) ELSE 0.0 END")
    s.cols(ps=roll("p", n, "sum"), ns=roll("m", n, "sum"))
    s.cols(cmo=dv("ps - ns", "ps + ns"))
    s.cols(af=f"{al!r} * abs(cmo)")
    s.cols(va="CASE WHEN rn > 14 THEN coalesce(1 - af, 1.0) ELSE 1.0 END",
           vb="CASE WHEN rn > 14 THEN coalesce(af * close, 0.0) ELSE 0.0 END")
    s.rec(n, V=("va", "vb"))
    return {"VIDYA_14": "CASE WHEN V <> 0 THEN V END"}


ind("vidya_hourly", "h", dict(kind="vidya"), _vidya, ["VIDYA_14"])


def _prices(s):
    return {"HL2": "0.5 * (high + low)", "HLC3": HLC3, "OHLC4": "0.25 * (open + high + low + close)",
            "WCP": "(high + low + 2 * close) / 4.0"}


ind("price_transforms_weekly", "w", [dict(kind=k) for k in ("hl2", "hlc3", "ohlc4", "wcp")], _prices,
    ["HL2", "HLC3", "OHLC4", "WCP"])


def _vwap(s):
    pw = "OVER (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return {"VWAP_D": f"sum({HLC3} * volume) {pw} / sum(volume) {pw}"}


ind("vwap_hourly", "h", dict(kind="vwap"), _vwap, ["VWAP_D"])


def _ichimoku(s):
    mid = lambda n: f"0.5 * ({roll('high', n, 'max')} + {roll('low', n, 'min')})"
    s.cols(its=mid(9), iks=mid(26), isb0=mid(52))
    return {"ISA_9": f"0.5 * ({lag('its', 25)} + {lag('iks', 25)})", "ISB_26": lag("isb0", 25), "ITS_9": "its",
            "IKS_26": "iks", "ICS_26": lag(C, -25)}


ind("ichimoku_hourly", "h", dict(kind="ichimoku"), _ichimoku, ["ISA_9", "ISB_26", "ITS_9", "IKS_26", "ICS_26"],
    lookahead=30)


# ---------------------------------------------------------------- flagship
def _flagship(s):
    s.cols(d=f"close - {lag(C, 1)}")
    s.cols(gp="CASE WHEN d < 0 THEN 0.0 ELSE d END", gn="CASE WHEN d > 0 THEN 0.0 ELSE d END")
    s.rma("pa", "gp", 14, warm=1).rma("na", "gn", 14, warm=1)
    s.ema("ef", C, 12).ema("es", C, 26)
    s.cols(m="ef - es")
    s.ema("sg", "m", 9, warm=25, sliced=True)
    return {"SMA_10": roll(C, 10), "RSI_14": dv("100 * pa", "pa + abs(na)"), "MACD_12_26_9": "m",
            "MACDh_12_26_9": "m - sg", "MACDs_12_26_9": "sg"}


ind("flagship_sma_rsi_macd_hourly", "h", [dict(kind="sma", length=10), dict(kind="rsi"), dict(kind="macd")],
    _flagship, ["SMA_10", "RSI_14", "MACD_12_26_9", "MACDh_12_26_9", "MACDs_12_26_9"])


# ---------------------------------------------------------------- momentum
def _rsi_sql(s, x, n, pre, warm=0):
    s.cols(**{f"{pre}_d": f"{x} - {lag(x, 1)}"})
    s.cols(**{f"{pre}_gp": f"CASE WHEN {pre}_d < 0 THEN 0.0 ELSE {pre}_d END",
              f"{pre}_gn": f"CASE WHEN {pre}_d > 0 THEN 0.0 ELSE {pre}_d END"})
    s.rma(f"{pre}pa", f"{pre}_gp", n, warm=warm + 1).rma(f"{pre}na", f"{pre}_gn", n, warm=warm + 1)
    return dv(f"100 * {pre}pa", f"{pre}pa + abs({pre}na)")


ind("rsi_weekly", "w", dict(kind="rsi"), lambda s: {"RSI_14": _rsi_sql(s, C, 14, "r")}, ["RSI_14"])
HL2 = "(0.5 * (high + low))"
ind("ao_hourly", "h", dict(kind="ao"), lambda s: {"AO_5_34": f"{roll(HL2, 5)} - {roll(HL2, 34)}"}, ["AO_5_34"])
ind("apo_hourly", "h", dict(kind="apo"), lambda s: {"APO_12_26": f"{roll(C, 12)} - {roll(C, 26)}"}, ["APO_12_26"])
ind("bias_hourly", "h", dict(kind="bias"), lambda s: {"BIAS_SMA_26": f"{dv(C, roll(C, 26))} - 1"}, ["BIAS_SMA_26"])
ind("bop_hourly", "h", dict(kind="bop"), lambda s: {"BOP": dv(nz("close", "open"), nz("high", "low"))}, ["BOP"])


def _brar(s):
    s.cols(pc=lag(C, 1))
    s.cols(ho=nz("high", "open"), ol=nz("open", "low"), hcy=nz("high", "pc"), cyl=nz("pc", "low"))
    s.cols(hcy2="CASE WHEN hcy < 0 THEN 0.0 ELSE hcy END", cyl2="CASE WHEN cyl < 0 THEN 0.0 ELSE cyl END")
    return {"AR_26": dv(f"100 * {roll('ho', 26, 'sum')}", roll("ol", 26, "sum")),
            "BR_26": dv(f"100 * {roll('hcy2', 26, 'sum')}", roll("cyl2", 26, "sum"))}


ind("brar_hourly", "h", dict(kind="brar"), _brar, ["AR_26", "BR_26"])


def _cci(s):
    s.cols(tp=HLC3)
    s.cols(mtp=roll("tp", 14))
    s.window_stat("mad", "tp", 14, "CASE WHEN count(b.tp) = 14 THEN avg(abs(b.tp - (SELECT avg(c.tp) FROM "
                  f"{s.cur} c WHERE c.symbol = a.symbol AND c.rn BETWEEN a.rn - 13 AND a.rn))) END")
    return {"CCI_14_0.015": dv("tp - mtp", "0.015 * mad")}


ind("cci_hourly", "h", dict(kind="cci"), _cci, ["CCI_14_0.015"])


def _cfo(s):
    m, b, r, ok = _ols_cols(s, C, 9, "cf")
    return {"CFO_9": f"CASE WHEN {ok} THEN {dv(f'100 * (close - ({m} * 9 + {b}))', 'close')} END"}


ind("cfo_hourly", "h", dict(kind="cfo"), _cfo, ["CFO_9"])
ind("cg_hourly", "h", dict(kind="cg"), lambda s: {"CG_10": dv(f"-{fir(C, [float(10 - i) for i in range(10)])}",
                                                                 roll(C, 10, "sum"))}, ["CG_10"])


def _cmo(s):
    s.cols(md=f"close - {lag(C, 1)}")
    s.cols(p="CASE WHEN md < 0 THEN 0.0 ELSE md END", m="abs(CASE WHEN md > 0 THEN 0.0 ELSE md END)")
    s.rma("pa", "p", 14, warm=1).rma("na", "m", 14, warm=1)
    return {"CMO_14": dv("100 * (pa - na)", "pa + na")}


ind("cmo_hourly", "h", dict(kind="cmo"), _cmo, ["CMO_14"])


def _roc(x, n):
    return dv(f"100 * ({x} - {lag(x, n)})", lag(x, n))


def _coppock(s):
    s.cols(tr2=f"{_roc(C, 11)} + {_roc(C, 14)}")
    return {"COPC_11_14_10": fir("tr2", [i / 55.0 for i in range(1, 11)])}


ind("coppock_weekly", "w", dict(kind="coppock"), _coppock, ["COPC_11_14_10"])


def _cti(s):
    m, b, r, ok = _ols_cols(s, C, 12, "ct")
    return {"CTI_12": f"CASE WHEN {ok} THEN {r} END"}


ind("cti_hourly", "h", dict(kind="cti"), _cti, ["CTI_12"])


def _dm_sql(s):
    s.cols(up=f"high - {lag('high', 1)}", dn=f"{lag('low', 1)} - low")
    s.cols(pp="CASE WHEN up IS NULL OR dn IS NULL THEN NULL WHEN up > dn AND up > 0 THEN up ELSE 0.0 END",
           nn="CASE WHEN up IS NULL OR dn IS NULL THEN NULL WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END")


def _dm(s):
    _dm_sql(s)
    s.rma("DMP", "pp", 14, warm=1).rma("DMN", "nn", 14, warm=1)
    return {"DMP_14": "DMP", "DMN_14": "DMN"}


ind("dm_hourly", "h", dict(kind="dm"), _dm, ["DMP_14", "DMN_14"])


def _er_fix(s):
    s.cols(ad=f"abs(close - {lag(C, 1)})")
    return {"ER_10": dv(f"abs(close - {lag(C, 10)})", roll("ad", 10, "sum"))}


ind("er_hourly", "h", dict(kind="er"), _er_fix, ["ER_10"])


def _eri(s):
    s.ema("e", C, 13)
    return {"BULLP_13": "high - e", "BEARP_13": "low - e"}


ind("eri_hourly", "h", dict(kind="eri"), _eri, ["BULLP_13", "BEARP_13"])


def _kdj(s):
    s.cols(fk=dv(f"100 * (close - {roll('low', 9, 'min')})", nz(roll("high", 9, "max"), roll("low", 9, "min"))))
    s.rma("K", "fk", 3, warm=8).rma("D", "K", 3, warm=10)
    return {"K_9_3": "K", "D_9_3": "D", "J_9_3": "3 * K - 2 * D"}


ind("kdj_hourly", "h", dict(kind="kdj"), _kdj, ["K_9_3", "D_9_3", "J_9_3"])


def _kst(s):
    s.cols(r1=_roc(C, 10), r2=_roc(C, 15), r3=_roc(C, 20), r4=_roc(C, 30))
    s.cols(k=f"100 * ({roll('r1', 10)} + 2 * {roll('r2', 10)} + 3 * {roll('r3', 10)} + 4 * {roll('r4', 15)})")
    return {"KST_10_15_20_30_10_10_10_15": "k", "KSTs_9": roll("k", 9)}


ind("kst_weekly", "w", dict(kind="kst"), _kst, ["KST_10_15_20_30_10_10_10_15", "KSTs_9"])


def _macd_w(s):
    s.ema("ef", C, 12).ema("es", C, 26)
    s.cols(m="ef - es")
    s.ema("sg", "m", 9, warm=25, sliced=True)
    return {"MACD_12_26_9": "m", "MACDh_12_26_9": "m - sg", "MACDs_12_26_9": "sg"}


ind("macd_weekly", "w", dict(kind="macd"), _macd_w, ["MACD_12_26_9", "MACDh_12_26_9", "MACDs_12_26_9"])
ind("mom_hourly", "h", dict(kind="mom"), lambda s: {"MOM_10": f"close - {lag(C, 10)}"}, ["MOM_10"])
ind("roc_hourly", "h", dict(kind="roc"), lambda s: {"ROC_10": _roc(C, 10)}, ["ROC_10"])
ind("slope_hourly", "h", dict(kind="slope"), lambda s: {"SLOPE_1": f"close - {lag(C, 1)}"}, ["SLOPE_1"])


def _atr_sql(s, out, n, warm=1):
    s.cols(**{f"{out}_tr": TR})
    s.rma(out, f"{out}_tr", n, warm=warm)


def _pgo(s):
    _atr_sql(s, "atr", 14)
    s.ema("ea", "atr", 14, warm=14)
    return {"PGO_14": dv(f"close - {roll(C, 14)}", "ea")}


ind("pgo_hourly", "h", dict(kind="pgo"), _pgo, ["PGO_14"])


def _ppo(s):
    s.cols(p=dv(f"100 * ({roll(C, 12)} - {roll(C, 26)})", roll(C, 26)))
    s.ema("sg", "p", 9, warm=25)
    return {"PPO_12_26_9": "p", "PPOh_12_26_9": "p - sg", "PPOs_12_26_9": "sg"}


ind("ppo_hourly", "h", dict(kind="ppo"), _ppo, ["PPO_12_26_9", "PPOh_12_26_9", "PPOs_12_26_9"])


def _psl(s):
    s.cols(sg=f"coalesce(sign(close - {lag(C, 1)}), 0)")
    s.cols(sp="CASE WHEN sg <= 0 THEN 0.0 ELSE sg END")
    return {"PSL_12": f"100 * {roll('sp', 12, 'sum')} / 12"}


ind("psl_hourly", "h", dict(kind="psl"), _psl, ["PSL_12"])


def _pvo(s):
    s.ema("ef", "volume", 12).ema("es", "volume", 26)
    s.cols(p=dv("100 * (ef - es)", "es"))
    s.ema("sg", "p", 9, warm=25)
    return {"PVO_12_26_9": "p", "PVOh_12_26_9": "p - sg", "PVOs_12_26_9": "sg"}


ind("pvo_hourly", "h", dict(kind="pvo"), _pvo, ["PVO_12_26_9", "PVOh_12_26_9", "PVOs_12_26_9"])


def _rvgi(s):
    wts = symmetric_triangle(4, True)
    s.cols(co=nz("close", "open"), hl=nz("high", "low"))
    s.cols(sn=fir("co", wts), sd=fir("hl", wts))
    s.cols(rv=dv(roll("sn", 14, "sum"), roll("sd", 14, "sum")))
    return {"RVGI_14_4": "rv", "RVGIs_14_4": fir("rv", wts)}


ind("rvgi_hourly", "h", dict(kind="rvgi"), _rvgi, ["RVGI_14_4", "RVGIs_14_4"])


def _tsi_sql(s, fa, sl, sig, scalar):
    s.cols(d=f"close - {lag(C, 1)}")
    s.cols(ad="abs(d)")
    s.ema("s1", "d", sl, warm=1).ema("a1", "ad", sl, warm=1)
    w1 = sl
    s.ema("s2", "s1", fa, warm=w1).ema("a2", "a1", fa, warm=w1)
    w2 = w1 if w1 >= fa else w1 + fa - 1
    s.cols(t=dv(f"{scalar} * s2", "a2"))
    s.ema("tsg", "t", sig, warm=w2)


def _tsi(s):
    _tsi_sql(s, 13, 25, 13, 100.0)
    return {"TSI_13_25_13": "t", "TSIs_13_25_13": "tsg"}


ind("tsi_hourly", "h", dict(kind="tsi"), _tsi, ["TSI_13_25_13", "TSIs_13_25_13"])


def _smi(s):
    _tsi_sql(s, 5, 20, 5, 1.0)
    return {"SMI_5_20_5": "t", "SMIs_5_20_5": "tsg", "SMIo_5_20_5": "t - tsg"}


ind("smi_hourly", "h", dict(kind="smi"), _smi, ["SMI_5_20_5", "SMIs_5_20_5", "SMIo_5_20_5"])


def _stoch(s):
    s.cols(st=dv(f"100 * (close - {roll('low', 14, 'min')})", nz(roll("high", 14, "max"), roll("low", 14, "min"))))
    s.cols(k=roll("st", 3))
    return {"STOCHk_14_3_3": "k", "STOCHd_14_3_3": roll("k", 3)}


ind("stoch_hourly", "h", dict(kind="stoch"), _stoch, ["STOCHk_14_3_3", "STOCHd_14_3_3"])


def _stochrsi(s):
    s.cols(rsi=_rsi_sql(s, C, 14, "r"))
    s.cols(st=dv(f"100 * (rsi - {roll('rsi', 14, 'min')})", nz(roll("rsi", 14, "max"), roll("rsi", 14, "min"))))
    s.cols(k=roll("st", 3))
    return {"STOCHRSIk_14_14_3_3": "k", "STOCHRSId_14_14_3_3": roll("k", 3)}


ind("stochrsi_hourly", "h", dict(kind="stochrsi"), _stochrsi, ["STOCHRSIk_14_14_3_3", "STOCHRSId_14_14_3_3"])


def _tdseq(s):
    s.cols(d4=f"close - {lag(C, 4)}")
    s.cols(cu="coalesce(d4 > 0, false)", cd="coalesce(d4 < 0, false)")
    s.cols(lu=f"max(CASE WHEN NOT cu THEN rn END) {w()}", ld=f"max(CASE WHEN NOT cd THEN rn END) {w()}")
    s.cols(ru="CASE WHEN cu THEN least(rn - coalesce(lu, 0), 13) END",
           rd="CASE WHEN cd THEN least(rn - coalesce(ld, 0), 13) END")
    return {"TD_SEQ_UPa": "CASE WHEN ru > 0 THEN ru END", "TD_SEQ_DNa": "CASE WHEN rd > 0 THEN rd END"}


ind("td_seq_hourly", "h", dict(kind="td_seq"), _tdseq, ["TD_SEQ_UPa", "TD_SEQ_DNa"])


def _trix(s):
    s.ema("e1", C, 30).ema("e2", "e1", 30, warm=29).ema("e3", "e2", 30, warm=58)
    s.cols(t=f"100 * ({dv('e3', lag('e3', 1))} - 1)")
    return {"TRIX_30_9": "t", "TRIXs_30_9": roll("t", 9)}


ind("trix_hourly", "h", dict(kind="trix"), _trix, ["TRIX_30_9", "TRIXs_30_9"])


def _uo(s):
    s.cols(pc=lag(C, 1))
    s.cols(mx="greatest(high, pc)", mn="least(low, pc)")
    s.cols(bp="close - mn", tr2="mx - mn")
    av = lambda n: dv(roll("bp", n, "sum"), roll("tr2", n, "sum"))
    return {"UO_7_14_28": f"100 * (4.0 * {av(7)} + 2.0 * {av(14)} + 1.0 * {av(28)}) / 7.0"}


ind("uo_hourly", "h", dict(kind="uo"), _uo, ["UO_7_14_28"])
ind("willr_hourly", "h", dict(kind="willr"),
    lambda s: {"WILLR_14": f"100 * ({dv(f'close - {roll(chr(108) + 'ow', 14, chr(109) + 'in')}', f'{roll(chr(104) + 'igh', 14, chr(109) + 'ax')} - {roll(chr(108) + 'ow', 14, chr(109) + 'in')}')} - 1)"},
    ["WILLR_14"])


def _squeeze(s):
    s.cols(mid=roll(C, 20), sd=roll(C, 20, "stddev_pop"), tr=TR)
    s.cols(bl="mid - 2.0 * sd", bu="mid + 2.0 * sd", band=roll("tr", 20))
    s.cols(kl="mid - 1.5 * band", ku="mid + 1.5 * band", mo=f"close - {lag(C, 12)}")
    return {"SQZ_20_2.0_20_1.5": roll("mo", 6), "SQZ_ON": "coalesce(bl > kl AND bu < ku, false)",
            "SQZ_OFF": "coalesce(bl < kl AND bu > ku, false)",
            "SQZ_NO": "NOT coalesce(bl > kl AND bu < ku, false) AND NOT coalesce(bl < kl AND bu > ku, false)"}


ind("squeeze_hourly", "h", dict(kind="squeeze"), _squeeze, ["SQZ_20_2.0_20_1.5", "SQZ_ON", "SQZ_OFF", "SQZ_NO"],
    ints=("SQZ_ON", "SQZ_OFF", "SQZ_NO"))


def _inertia(s):
    s.cols(sd=roll(C, 14, "stddev_samp"), dd=f"coalesce(close - {lag(C, 1)}, 0.0)")
    s.cols(ps="CASE WHEN dd > 0 THEN 1.0 ELSE 0.0 END * sd", ns="CASE WHEN dd < 0 THEN 1.0 ELSE 0.0 END * sd")
    s.ema("pa", "ps", 14, warm=13).ema("na", "ns", 14, warm=13)
    s.cols(rvi=dv("100.0 * pa", "pa + na"))
    m, b, r, ok = _ols_cols(s, "rvi", 20, "in")
    return {"INERTIA_20_14": f"CASE WHEN {ok} THEN {m} * 19 + {b} END"}


ind("inertia_hourly", "h", dict(kind="inertia"), _inertia, ["INERTIA_20_14"])


# ---------------------------------------------------------------- volatility
def _aber(s):
    _atr_sql(s, "atr", 15)
    s.cols(zg=roll(HLC3, 5))
    return {"ABER_ZG_5_15": "zg", "ABER_SG_5_15": "zg + atr", "ABER_XG_5_15": "zg - atr", "ABER_ATR_5_15": "atr"}


ind("aberration_hourly", "h", dict(kind="aberration"), _aber,
    ["ABER_ZG_5_15", "ABER_SG_5_15", "ABER_XG_5_15", "ABER_ATR_5_15"])


def _accb(s):
    s.cols(r=f"4.0 * {dv(nz('high', 'low'), 'high + low')}")
    s.cols(lo="low * (1 - r)", up="high * (1 + r)")
    return {"ACCBL_20": roll("lo", 20), "ACCBM_20": roll(C, 20), "ACCBU_20": roll("up", 20)}


ind("accbands_hourly", "h", dict(kind="accbands"), _accb, ["ACCBL_20", "ACCBM_20", "ACCBU_20"])


def _atr(s):
    _atr_sql(s, "atr", 14)
    return {"ATRr_14": "atr"}


ind("atr_hourly", "h", dict(kind="atr"), _atr, ["ATRr_14"])
ind("atr_weekly", "w", dict(kind="atr"), _atr, ["ATRr_14"])


def _bb(s):
    s.cols(mid=roll(C, 5), sd=roll(C, 5, "stddev_pop"))
    s.cols(lo="mid - 2.0 * sd", up="mid + 2.0 * sd")
    return {"BBL_5_2.0": "lo", "BBM_5_2.0": "mid", "BBU_5_2.0": "up", "BBB_5_2.0": dv(f"100 * {nz('up', 'lo')}", "mid"),
            "BBP_5_2.0": dv(nz("close", "lo"), nz("up", "lo"))}


ind("bbands_hourly", "h", dict(kind="bbands"), _bb, ["BBL_5_2.0", "BBM_5_2.0", "BBU_5_2.0", "BBB_5_2.0", "BBP_5_2.0"])


def _donch(s):
    s.cols(lo=roll("low", 20, "min"), up=roll("high", 20, "max"))
    return {"DCL_20_20": "lo", "DCM_20_20": "0.5 * (lo + up)", "DCU_20_20": "up"}


ind("donchian_hourly", "h", dict(kind="donchian"), _donch, ["DCL_20_20", "DCM_20_20", "DCU_20_20"])


def _kc(s):
    s.cols(tr=TR)
    s.ema("basis", C, 20).ema("band", "tr", 20, warm=1)
    return {"KCLe_20_2": "basis - 2 * band", "KCBe_20_2": "basis", "KCUe_20_2": "basis + 2 * band"}


ind("kc_hourly", "h", dict(kind="kc"), _kc, ["KCLe_20_2", "KCBe_20_2", "KCUe_20_2"])


def _massi(s):
    s.cols(hl=nz("high", "low"))
    s.ema("e1", "hl", 9).ema("e2", "e1", 9, warm=8)
    s.cols(rt=dv("e1", "e2"))
    return {"MASSI_9_25": roll("rt", 25, "sum")}


ind("massi_hourly", "h", dict(kind="massi"), _massi, ["MASSI_9_25"])


def _natr(s):
    s.cols(tr=TR)
    s.ema("a", "tr", 14, warm=1)
    return {"NATR_14": f"{dv('100.0', 'close')} * a"}


ind("natr_hourly", "h", dict(kind="natr"), _natr, ["NATR_14"])
ind("pdist_hourly", "h", dict(kind="pdist"),
    lambda s: {"PDIST": f"2 * {nz('high', 'low')} + abs({nz('open', lag(C, 1))}) - abs({nz('close', 'open')})"},
    ["PDIST"])


def _rvi(s):
    s.cols(sd=roll(C, 14, "stddev_samp"), dd=f"coalesce(close - {lag(C, 1)}, 0.0)")
    s.cols(ps="CASE WHEN dd > 0 THEN 1.0 ELSE 0.0 END * sd", ns="CASE WHEN dd < 0 THEN 1.0 ELSE 0.0 END * sd")
    s.ema("pa", "ps", 14, warm=13).ema("na", "ns", 14, warm=13)
    return {"RVI_14": dv("100.0 * pa", "pa + na")}


ind("rvi_hourly", "h", dict(kind="rvi"), _rvi, ["RVI_14"])


def _thermo(s):
    s.cols(tl=f"abs({lag('low', 1)} - low)", th=f"abs(high - {lag('high', 1)})")
    s.cols(t="CASE WHEN th < tl THEN tl ELSE th END")
    s.ema("tma", "t", 20, warm=1)
    return {"THERMO_20_2_0.5": "t", "THERMOma_20_2_0.5": "tma", "THERMOl_20_2_0.5": "coalesce(t < tma * 2, false)",
            "THERMOs_20_2_0.5": "coalesce(t > tma * 0.5, false)"}


ind("thermo_hourly", "h", dict(kind="thermo"), _thermo,
    ["THERMO_20_2_0.5", "THERMOma_20_2_0.5", "THERMOl_20_2_0.5", "THERMOs_20_2_0.5"],
    ints=("THERMOl_20_2_0.5", "THERMOs_20_2_0.5"))
ind("true_range_weekly", "w", dict(kind="true_range"), lambda s: {"TRUERANGE_1": TR}, ["TRUERANGE_1"])


def _ui(s):
    s.cols(hc=roll(C, 14, "max"))
    s.cols(dd=dv("100 * (close - hc)", "hc"))
    s.cols(d2="dd * dd")
    return {"UI_14": f"sqrt({roll('d2', 14, 'sum')} / 14)"}


ind("ui_hourly", "h", dict(kind="ui"), _ui, ["UI_14"])


# ---------------------------------------------------------------- trend
def _adx(s):
    _atr_sql(s, "atr", 14)
    _dm_sql(s)
    s.rma("mp", "pp", 14, warm=1).rma("mn", "nn", 14, warm=1)
    s.cols(dmp=f"{dv('100.0', 'atr')} * mp", dmn=f"{dv('100.0', 'atr')} * mn")
    s.cols(dx=dv("100 * abs(dmp - dmn)", "dmp + dmn"))
    s.rma("ax", "dx", 14, warm=14)
    return {"ADX_14": "ax", "DMP_14": "dmp", "DMN_14": "dmn"}


ind("adx_hourly", "h", dict(kind="adx"), _adx, ["ADX_14", "DMP_14", "DMN_14"])


def _inc(x, n):
    return f"coalesce({x} - {lag(x, n)} > 0, false)"


def _dec(x, n):
    return f"coalesce({x} - {lag(x, n)} < 0, false)"


def _amat(s):
    s.ema("fa", C, 8).ema("sl", C, 21)
    return {"AMATE_LR_8_21_2": f"({_inc('fa', 2)} AND {_dec('sl', 2)}) OR ({_inc('fa', 2)} AND {_inc('sl', 2)})",
            "AMATE_SR_8_21_2": f"({_dec('fa', 2)} AND {_inc('sl', 2)}) OR ({_dec('fa', 2)} AND {_dec('sl', 2)})"}


ind("amat_hourly", "h", dict(kind="amat"), _amat, ["AMATE_LR_8_21_2", "AMATE_SR_8_21_2"],
    ints=("AMATE_LR_8_21_2", "AMATE_SR_8_21_2"))


def _aroon(s):
    s.cols(hh=f"max(high) {w(15)}", ll=f"min(low) {w(15)}", cnt=f"count(high) {w(15)}")
    s.window_stat("hi_rn", "high", 15, "max(CASE WHEN b.high = a.hh THEN b.rn END)")
    s.window_stat("lo_rn", "low", 15, "max(CASE WHEN b.low = a.ll THEN b.rn END)")
    up = "CASE WHEN cnt >= 15 THEN 100.0 * (1 - (rn - hi_rn) / 14.0) END"
    dn = "CASE WHEN cnt >= 15 THEN 100.0 * (1 - (rn - lo_rn) / 14.0) END"
    return {"AROOND_14": dn, "AROONU_14": up, "AROONOSC_14": f"{up} - {dn}"}


ind("aroon_hourly", "h", dict(kind="aroon"), _aroon, ["AROOND_14", "AROONU_14", "AROONOSC_14"])


def _chop(s):
    s.cols(tr=TR)
    s.cols(asum=roll("tr", 14, "sum"), df=f"{roll('high', 14, 'max')} - {roll('low', 14, 'min')}")
    return {"CHOP_14_1_100": "100 * (log10(CASE WHEN asum > 0 THEN asum END) - log10(CASE WHEN df > 0 THEN df END))"
                             f" / {math.log10(14)!r}"}


ind("chop_hourly", "h", dict(kind="chop"), _chop, ["CHOP_14_1_100"])


def _cksp(s):
    _atr_sql(s, "atr", 10)
    s.cols(ls=f"{roll('high', 10, 'max')} - 3 * atr", ss=f"{roll('low', 10, 'min')} + 3 * atr")
    return {"CKSPl_10_3_20": roll("ls", 20, "max"), "CKSPs_10_3_20": roll("ss", 20, "min")}


ind("cksp_hourly", "h", dict(kind="cksp"), _cksp, ["CKSPl_10_3_20", "CKSPs_10_3_20"])
ind("decay_hourly", "h", dict(kind="decay"),
    lambda s: {"LDECAY_5": f"greatest(close, CASE WHEN rn = 1 THEN close ELSE {lag(C, 1)} - 0.2 END, 0.0)"},
    ["LDECAY_5"])
ind("increasing_decreasing_hourly", "h", [dict(kind="increasing", length=3), dict(kind="decreasing", length=3)],
    lambda s: {"INC_3": _inc(C, 3), "DEC_3": _dec(C, 3)}, ["INC_3", "DEC_3"], ints=("INC_3", "DEC_3"))


def _dpo(s):
    s.cols(ma=roll(C, 20))
    return {"DPO_20": f"close - {lag('ma', -11)}"}


ind("dpo_hourly", "h", dict(kind="dpo"), _dpo, ["DPO_20"], lookahead=15)
ind("qstick_hourly", "h", dict(kind="qstick"), lambda s: (s.cols(qd=nz("close", "open")),
                                                          {"QS_10": roll("qd", 10)})[1], ["QS_10"])
ind("ttm_trend_hourly", "h", dict(kind="ttm_trend"),
    lambda s: {"TTM_TRND_6": f"CASE WHEN close > {roll(HL2, 6)} THEN 1 ELSE -1 END"}, ["TTM_TRND_6"],
    ints=("TTM_TRND_6",))


def _vhf(s):
    s.cols(ad=f"abs(close - {lag(C, 1)})")
    return {"VHF_28": dv(f"abs({nz(roll(C, 28, 'max'), roll(C, 28, 'min'))})", roll("ad", 28, "sum"))}


ind("vhf_hourly", "h", dict(kind="vhf"), _vhf, ["VHF_28"])


def _vortex(s):
    s.cols(tr=TR, vp=f"abs(high - {lag('low', 1)})", vm=f"abs(low - {lag('high', 1)})")
    return {"VTXP_14": dv(roll("vp", 14, "sum"), roll("tr", 14, "sum")),
            "VTXM_14": dv(roll("vm", 14, "sum"), roll("tr", 14, "sum"))}


ind("vortex_hourly", "h", dict(kind="vortex"), _vortex, ["VTXP_14", "VTXM_14"])


# ---------------------------------------------------------------- statistics
def _entropy(s):
    s.cols(p=dv(C, roll(C, 10, "sum")))
    s.cols(t="-p * ln(CASE WHEN p > 0 THEN p END) / ln(2.0)")
    return {"ENTP_10": roll("t", 10, "sum")}


ind("entropy_hourly", "h", dict(kind="entropy"), _entropy, ["ENTP_10"])
ind("kurtosis_hourly", "h", dict(kind="kurtosis"), lambda s: {"KURT_30": roll(C, 30, "kurtosis")}, ["KURT_30"])
ind("skew_hourly", "h", dict(kind="skew"), lambda s: {"SKEW_30": roll(C, 30, "skewness")}, ["SKEW_30"])
ind("mad_hourly", "h", dict(kind="mad"),
    lambda s: (s.cols(m30=roll(C, 30)),
               s.window_stat("MAD", C, 30, "CASE WHEN count(b.close) = 30 THEN avg(abs(b.close - a.m30)) END"),
               {"MAD_30": "MAD"})[2], ["MAD_30"])
ind("median_hourly", "h", dict(kind="median"), lambda s: {"MEDIAN_30": roll(C, 30, "median")}, ["MEDIAN_30"])
ind("quantile_weekly", "w", dict(kind="quantile", length=20, q=0.25),
    lambda s: {"QTL_20_0.25": f"CASE WHEN count(close) {w(20)} >= 20 THEN quantile_cont(close, 0.25) {w(20)} END"},
    ["QTL_20_0.25"])
# weekly prices are not 2-decimal, so the variance never sits exactly on a rounding tie
ind("stdev_variance_weekly", "w", [dict(kind="stdev"), dict(kind="variance")],
    lambda s: {"STDEV_30": roll(C, 30, "stddev_samp"), "VAR_30": roll(C, 30, "var_samp")}, ["STDEV_30", "VAR_30"])
ind("zscore_hourly", "h", dict(kind="zscore"),
    lambda s: {"ZS_30": dv(f"close - {roll(C, 30)}", roll(C, 30, "stddev_samp"))}, ["ZS_30"])


def _tos(s):
    pw = "OVER (PARTITION BY symbol)"
    s.cols(m=f"regr_slope(close, rn) {pw}", b=f"regr_intercept(close, rn) {pw}", sd=f"stddev_samp(close) {pw}")
    out = {"TOS_STDEVALL_LR": "m * rn + b"}
    for i in (1, 2, 3):
        out[f"TOS_STDEVALL_L_{i}"] = f"m * rn + b - {i} * sd"
        out[f"TOS_STDEVALL_U_{i}"] = f"m * rn + b + {i} * sd"
    return out


ind("tos_stdevall_weekly", "w", dict(kind="tos_stdevall"), _tos,
    ["TOS_STDEVALL_LR"] + [f"TOS_STDEVALL_{s}_{i}" for i in (1, 2, 3) for s in ("L", "U")])


# ---------------------------------------------------------------- volume
AD_FLOW = f"(2 * close - (high + low)) * {dv('volume', nz('high', 'low'))}"


def _run_sum(x):
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE sum({x}) {w()} END"


def _ad(s):
    s.cols(af=AD_FLOW)
    return {"AD": _run_sum("af")}


ind("ad_hourly", "h", dict(kind="ad"), _ad, ["AD"])


def _adosc(s):
    s.cols(af=AD_FLOW)
    s.cols(adl=_run_sum("af"))
    s.ema("e1", "adl", 3).ema("e2", "adl", 10)
    return {"ADOSC_3_10": "e1 - e2"}


ind("adosc_hourly", "h", dict(kind="adosc"), _adosc, ["ADOSC_3_10"])
SIGNED_C = f"(CASE WHEN rn = 1 THEN 1.0 ELSE sign(close - {lag(C, 1)}) END)"


def _obv(s):
    s.cols(sv=f"{SIGNED_C} * volume")
    s.cols(obv=_run_sum("sv"))
    return {"OBV": "obv"}


ind("obv_hourly", "h", dict(kind="obv"), _obv, ["OBV"])


def _aobv(s):
    _obv(s)
    s.ema("fa", "obv", 4).ema("sl", "obv", 12)
    return {"OBV": "obv", "OBV_min_2": roll("obv", 2, "min"), "OBV_max_2": roll("obv", 2, "max"), "OBVE_4": "fa",
            "OBVE_12": "sl",
            "AOBV_LR_2": f"({_inc('fa', 2)} AND {_dec('sl', 2)}) OR ({_inc('fa', 2)} AND {_inc('sl', 2)})",
            "AOBV_SR_2": f"({_dec('fa', 2)} AND {_inc('sl', 2)}) OR ({_dec('fa', 2)} AND {_dec('sl', 2)})"}


ind("aobv_hourly", "h", dict(kind="aobv"), _aobv,
    ["OBV", "OBV_min_2", "OBV_max_2", "OBVE_4", "OBVE_12", "AOBV_LR_2", "AOBV_SR_2"], ints=("AOBV_LR_2", "AOBV_SR_2"))
ind("cmf_hourly", "h", dict(kind="cmf"),
    lambda s: (s.cols(af=AD_FLOW), {"CMF_20": dv(roll("af", 20, "sum"), roll("volume", 20, "sum"))})[1], ["CMF_20"])


def _efi(s):
    s.cols(pv=f"(close - {lag(C, 1)}) * volume")
    s.ema("e", "pv", 13, warm=1)
    return {"EFI_13": "e"}


ind("efi_hourly", "h", dict(kind="efi"), _efi, ["EFI_13"])


def _eom(s):
    s.cols(dist=f"{HL2} - 0.5 * ({lag('high', 1)} + {lag('low', 1)})",
           box=dv("volume / 100000000.0", nz("high", "low")))
    s.cols(e=dv("dist", "box"))
    return {"EOM_14_100000000": roll("e", 14)}


ind("eom_weekly", "w", dict(kind="eom"), _eom, ["EOM_14_100000000"])


def _kvo(s):
    s.cols(sv=f"volume * (CASE WHEN rn = 1 THEN 1.0 ELSE sign({HLC3} - {lag(HLC3, 1)}) END)")
    s.ema("fa", "sv", 34).ema("sl", "sv", 55)
    s.cols(k="fa - sl")
    s.ema("sg", "k", 13, warm=54, sliced=True)
    return {"KVO_34_55_13": "k", "KVOs_34_55_13": "sg"}


ind("kvo_hourly", "h", dict(kind="kvo"), _kvo, ["KVO_34_55_13", "KVOs_34_55_13"])


def _mfi(s):
    s.cols(tp=HLC3)
    s.cols(td=f"tp - {lag('tp', 1)}", rmf="tp * volume")
    s.cols(pm="CASE WHEN td > 0 THEN rmf ELSE 0.0 END", nm="CASE WHEN td < 0 THEN rmf ELSE 0.0 END")
    s.cols(ps=roll("pm", 14, "sum"), ns=roll("nm", 14, "sum"))
    return {"MFI_14": dv("100 * ps", "ps + ns")}


ind("mfi_hourly", "h", dict(kind="mfi"), _mfi, ["MFI_14"])


def _vi(s, pos):
    t = "p" if pos else "n"
    s.cols(**{f"svv{t}": f"CASE WHEN rn = 1 THEN 1.0 ELSE sign(volume - {lag('volume', 1)}) END", f"r1{t}": _roc(C, 1)})
    cond = f"svv{t} > 0" if pos else f"svv{t} < 0"
    s.cols(**{f"stp{t}": f"CASE WHEN rn = 1 THEN 1000.0 ELSE coalesce(CASE WHEN {cond} THEN abs(svv{t}) END * r1{t}, 0.0) END"})
    return _run_sum(f"stp{t}")


ind("nvi_pvi_hourly", "h", [dict(kind="nvi"), dict(kind="pvi")],
    lambda s: {"NVI_1": (s.cols(nvi=_vi(s, False)), "nvi")[1], "PVI_1": (s.cols(pvi=_vi(s, True)), "pvi")[1]},
    ["NVI_1", "PVI_1"])
ind("pvol_pvr_hourly", "h", [dict(kind="pvol"), dict(kind="pvr")],
    lambda s: {"PVOL": "close * volume",
               "PVR": f"CASE WHEN coalesce(close - {lag(C, 1)}, 0) >= 0 AND coalesce(volume - {lag('volume', 1)}, 0) >= 0 "
                      f"THEN 1 WHEN coalesce(close - {lag(C, 1)}, 0) >= 0 THEN 2 "
                      f"WHEN coalesce(volume - {lag('volume', 1)}, 0) >= 0 THEN 3 ELSE 4 END"}, ["PVOL", "PVR"])


def _pvt(s):
    s.cols(pv=f"{_roc(C, 1)} * volume")
    return {"PVT": _run_sum("pv")}


ind("pvt_hourly", "h", dict(kind="pvt"), _pvt, ["PVT"])


# ---------------------------------------------------------------- performance
def _dd(s):
    s.cols(mx=f"max(close) {w()}")
    return {"DD": "mx - close", "DD_PCT": f"1 - {dv('close', 'mx')}",
            "DD_LOG": "ln(CASE WHEN mx > 0 THEN mx END) - ln(CASE WHEN close > 0 THEN close END)"}


ind("drawdown_weekly", "w", dict(kind="drawdown"), _dd, ["DD", "DD_PCT", "DD_LOG"])


def _rets(s):
    s.cols(c0=f"first_value(close) OVER (PARTITION BY symbol ORDER BY rn)")
    return {"LOGRET_1": f"ln(CASE WHEN {dv(C, lag(C, 1))} > 0 THEN {dv(C, lag(C, 1))} END)",
            "PCTRET_1": f"{dv(C, lag(C, 1))} - 1", "CUMLOGRET_1": f"ln(CASE WHEN {dv(C, 'c0')} > 0 THEN {dv(C, 'c0')} END)",
            "CUMPCTRET_1": f"{dv(C, 'c0')} - 1"}


ind("returns_hourly", "h", [dict(kind="log_return"), dict(kind="percent_return"),
                            dict(kind="log_return", cumulative=True), dict(kind="percent_return", cumulative=True)],
    _rets, ["LOGRET_1", "PCTRET_1", "CUMLOGRET_1", "CUMPCTRET_1"])


# ---------------------------------------------------------------- candles
ind("cdl_doji_inside_hourly", "h", [dict(kind="cdl_doji"), dict(kind="cdl_inside")],
    lambda s: {"CDL_DOJI_10_0.1": f"100 * CAST(coalesce(abs({nz('close', 'open')}) < 0.1 * "
                                  f"{roll(f'abs({nz(chr(104) + chr(105) + chr(103) + chr(104), chr(108) + chr(111) + chr(119))})', 10)}, false) AS INTEGER)",
               "CDL_INSIDE": f"CAST(coalesce(high - {lag('high', 1)} < 0 AND low - {lag('low', 1)} > 0, false) AS INTEGER)"
                             " * (CASE WHEN close >= open THEN 1 ELSE -1 END)"},
    ["CDL_DOJI_10_0.1", "CDL_INSIDE"], ints=("CDL_INSIDE",))


def _cdlz(s):
    out = {}
    for c in ("open", "high", "low", "close"):
        out[f"{c}_Z_30_1"] = dv(f"{c} - {roll(c, 30)}", roll(c, 30, "stddev_samp"))
    return out


ind("cdl_z_hourly", "h", dict(kind="cdl_z"), _cdlz, [f"{c}_Z_30_1" for c in ("open", "high", "low", "close")])


def _ha(s):
    s.cols(hc="0.25 * (open + high + low + close)")
    s.cols(ha_a="CASE WHEN rn = 1 THEN 1.0 ELSE 0.5 END",
           ha_b=f"CASE WHEN rn = 1 THEN 0.5 * (open + close) ELSE 0.5 * {lag('hc', 1)} END")
    s.rec(1, ho=("ha_a", "ha_b"))
    return {"HA_open": "ho", "HA_high": "greatest(ho, high, hc)", "HA_low": "least(ho, low, hc)", "HA_close": "hc"}


ind("ha_weekly", "w", dict(kind="ha"), _ha, ["HA_open", "HA_high", "HA_low", "HA_close"])


# ---------------------------------------------------------------- metrics
def _metrics_spark(spark, sf_dir):
    from ticklake.operators.metrics import metrics
    m = metrics(bars_w(spark, sf_dir))
    ints = ("n", "optimal_leverage")
    return m.select("symbol", *[F.col(c).cast("long").alias(c) if c in ints else r4(F.col(c)).alias(c)
                                for c in m.columns if c != "symbol"])


SPARK["performance_metrics_weekly"] = _metrics_spark


def _metrics_sql():
    span = 365.25 * 3 * 86400 * 1_000_000
    body = f"""
WITH b0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM ({BARS_W_SQL}) x),
b1 AS (SELECT *, close / NULLIF(lag(close) OVER (PARTITION BY symbol ORDER BY rn), 0) - 1 AS r,
              max(close) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mx,
              epoch_us(ts) > epoch_us(max(ts) OVER (PARTITION BY symbol)) - {span} AS inwin FROM b0),
b2 AS (SELECT *, mx - close AS dd, 1 - close / NULLIF(mx, 0) AS ddp,
              ln(CASE WHEN mx > 0 THEN mx END) - ln(CASE WHEN close > 0 THEN close END) AS ddl,
              CASE WHEN inwin THEN 1 - close / NULLIF(max(CASE WHEN inwin THEN close END) OVER (PARTITION BY symbol
                ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) END AS wddp FROM b1),
a AS (SELECT symbol, count(*) AS n, arg_min(close, rn) AS fc, arg_max(close, rn) AS lc,
             floor((epoch(max(ts)) - epoch(min(ts))) / 86400.0) AS days, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS secs,
             avg(r) AS mr, stddev_samp(r) AS sr, max(dd) AS mdd, max(ddp) AS mddp, max(ddl) AS mddl,
             sum(ln(coalesce(r, 0) + 1)) AS sl, min(coalesce(r, 0) + 1) AS m1,
             regr_r2(close, rn) AS r2, regr_slope(close, rn) AS lb, regr_intercept(close, rn) AS la, corr(close, rn) AS lr,
             arg_min(CASE WHEN inwin THEN close END, CASE WHEN inwin THEN rn END) AS wf,
             floor((epoch(max(CASE WHEN inwin THEN ts END)) - epoch(min(CASE WHEN inwin THEN ts END))) / 86400.0) AS wdays,
             max(wddp) AS wdd FROM b2 GROUP BY symbol),
a2 AS (SELECT *, days / 252.0 AS yrs, power(lc / fc, 1.0 / NULLIF(days / 252.0, 0)) - 1 AS cagr,
              n / NULLIF(days / 252.0, 0) AS dpy FROM a),
a3 AS (SELECT *, power(1 + 0.0, 1.0 / dpy) - 1 AS adj FROM a2),
d AS (SELECT b2.symbol, sum(CASE WHEN a3.adj - b2.r > 0 THEN power(a3.adj - b2.r, 2) END) AS dss
      FROM b2 JOIN a3 USING (symbol) GROUP BY b2.symbol),
o AS (SELECT a3.*, sqrt(coalesce(d.dss, 0) / NULLIF(n - 1, 0)) * sqrt(dpy) AS dsd,
             252 * mr AS mu, sqrt(252) * sr AS sd FROM a3 LEFT JOIN d USING (symbol))
SELECT symbol, CAST(n AS BIGINT) AS n, {{cols}},
       CAST(trunc((mu - 0.0) / NULLIF(sd * sd, 0)) AS BIGINT) AS optimal_leverage FROM o"""
    from ticklake.oracle_sql import r4 as sr4
    cols = {"tt_years": "yrs", "tt_months": "days / 30.417", "tt_weeks": "days / 7", "tt_days": "days",
            "tt_hours": "days * 24", "tt_minutes": "secs / 60", "tt_seconds": "secs", "cagr": "cagr",
            "max_dd_dollar": "mdd", "max_dd_percent": "mddp", "max_dd_log": "mddl",
            "log_max_drawdown": "ln(lc) - ln(fc) - mddl",
            "calmar_ratio": "(power(lc / wf, 1.0 / NULLIF(wdays / 252.0, 0)) - 1) / NULLIF(wdd, 0)",
            "sharpe_ratio": "(mu - 0.0) / NULLIF(sd, 0)", "downside_deviation": "dsd",
            "sortino_ratio": "(cagr - 0.0) / NULLIF(dsd, 0)", "volatility": "sqrt(dpy) * sr",
            "pure_profit_score": "r2 * cagr",
            "log_geometric_mean": "CASE WHEN n >= 2 THEN CASE WHEN m1 > 0 THEN exp(sl / n) - 1 ELSE 0.0 END END",
            "lr_a": "la", "lr_b": "lb", "lr_r": "lr", "lr_t": "lr / NULLIF(sqrt((1 - lr * lr) / NULLIF(n - 2, 0)), 0)"}
    return body.replace("{cols}", ", ".join(f"{sr4(e)} AS {k}" for k, e in cols.items()))


ORACLE["performance_metrics_weekly"] = _metrics_sql()


# ---------------------------------------------------------------- cleaning
def _gappy(spark, sf_dir):
    """bars_h with close set to NULL where hour-of-epoch % 10 = 0 (a plain
    expression both engines evaluate alike): the imputation fixture."""
    b = bars_h(spark, sf_dir)
    return b.withColumn("close", F.when((F.unix_seconds("ts") / 3600) % 10 == 0, F.lit(None).cast("double"))
                        .otherwise(F.col("close")))


GAPPY_SQL = (f"SELECT symbol, ts, open, high, low, CASE WHEN (epoch(ts) / 3600) % 10 = 0 THEN NULL ELSE close END "
             f"AS close, volume FROM ({BARS_H_SQL}) g")
RUN = "OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
AFTER = "OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _clean_q(name, fn, sql_outs, outs, ints=(), src="gappy", sql_pre=None):
    def spark_fn(spark, sf_dir):
        b = _gappy(spark, sf_dir) if src == "gappy" else BARS_FN[src](spark, sf_dir)
        df = fn(b)
        return df.select("symbol", "ts", *[F.col(o).cast("int").alias(o) if o in ints else r4(F.col(o)).alias(o)
                                           for o in outs])
    SPARK[name] = spark_fn
    s = Sql(GAPPY_SQL if src == "gappy" else src)
    if sql_pre:
        sql_pre(s)
    ORACLE[name] = s.sql(sql_outs, ints=ints)


from ticklake.operators import clean as CL  # noqa: E402

_clean_q("impute_ffill_bfill_hourly", lambda b: CL.impute(b, "forward_fill", True, ["close"]),
         {"close": f"coalesce(last_value(close IGNORE NULLS) {RUN}, first_value(close IGNORE NULLS) {AFTER})"},
         ["close"])


def _interp_pre(s):
    s.cols(pv=f"last_value(close IGNORE NULLS) {RUN}", pr=f"last_value(CASE WHEN close IS NOT NULL THEN rn END "
           f"IGNORE NULLS) {RUN}", nv=f"first_value(close IGNORE NULLS) {AFTER}",
           nr=f"first_value(CASE WHEN close IS NOT NULL THEN rn END IGNORE NULLS) {AFTER}")


_clean_q("impute_interpolate_hourly", lambda b: CL.impute(b, "interpolate", False, ["close"]),
         {"close": f"coalesce(close, pv + (nv - pv) * {dv('rn - pr', 'nr - pr')}, pv, nv)"}, ["close"],
         sql_pre=_interp_pre)


def _z_pre(s):
    s.cols(m=f"avg(close) OVER (PARTITION BY symbol)", sd="stddev_pop(close) OVER (PARTITION BY symbol)")
    s.cols(x=f"CASE WHEN coalesce(abs({dv('close - m', 'sd')}) > 2.0, false) THEN NULL ELSE close END")


_clean_q("outliers_zscore_hourly", lambda b: CL.remove_outliers(b, "zscore", 2.0, cols=["close"]),
         {"close": f"last_value(x IGNORE NULLS) {RUN}"}, ["close"], src="h", sql_pre=_z_pre)


def _iqr_pre(s):
    s.cols(q1="quantile_cont(close, 0.25) OVER (PARTITION BY symbol)",
           q3="quantile_cont(close, 0.75) OVER (PARTITION BY symbol)")
    s.cols(x="CASE WHEN close < q1 - 1.5 * (q3 - q1) OR close > q3 + 1.5 * (q3 - q1) THEN NULL ELSE close END")


_clean_q("outliers_iqr_weekly", lambda b: CL.remove_outliers(b, "iqr", factor=1.5, cols=["close"]),
         {"close": f"last_value(x IGNORE NULLS) {RUN}"}, ["close"], src="w", sql_pre=_iqr_pre)


def _den_pre(s):
    s.rma("dc", "close", 5, alpha=2.0 / 6, minp=0).rma("dv", "volume", 5, alpha=2.0 / 6, minp=0)


_clean_q("denoise_ewm_hourly", lambda b: CL.denoise(b, 5, ["close", "volume"]), {"close": "dc", "volume": "dv"},
         ["close", "volume"], src="h", sql_pre=_den_pre)


def _rsis_pre(s):
    s.cols(d=f"close - {lag(C, 1)}")
    s.cols(g="CASE WHEN d IS NULL THEN NULL WHEN d > 0 THEN d ELSE 0.0 END",
           l="CASE WHEN d IS NULL THEN NULL WHEN d < 0 THEN -d ELSE 0.0 END")
    s.cols(ga=roll("g", 14), la=roll("l", 14))


_clean_q("rsi_simple_hourly", lambda b: CL.rsi_simple(b, 14), {
    "rsi": "CASE WHEN la <> 0 THEN 100 - 100 / (1 + ga / la) WHEN la = 0 AND ga > 0 THEN 100.0 END"}, ["rsi"],
         src="h", sql_pre=_rsis_pre)


def _macdi_pre(s):
    af, asl, ag = 2.0 / 13, 2.0 / 27, 2.0 / 10
    s.cols(fa=f"{1 - af!r}", fb=f"CASE WHEN rn = 1 THEN close ELSE {af!r} * close END",
           sa=f"{1 - asl!r}", sb=f"CASE WHEN rn = 1 THEN close ELSE {asl!r} * close END")
    s.rec(1, ef=("fa", "fb"), es=("sa", "sb"))
    s.cols(m="ef - es", ga=f"{1 - ag!r}")
    s.cols(gb=f"CASE WHEN rn = 1 THEN 0.0 ELSE {ag!r} * m END")
    s.rec(1, sg=("ga", "gb"))


_clean_q("macd_incremental_hourly", lambda b: CL.macd_incremental(b), {"macd": "m", "macd_signal": "sg"},
         ["macd", "macd_signal"], src="h", sql_pre=_macdi_pre)


def _holiday_sql():
    obs = lambda d: (f"(CASE WHEN dayofweek({d}) = 6 THEN {d} - INTERVAL 1 DAY WHEN dayofweek({d}) = 0 "
                     f"THEN {d} + INTERVAL 1 DAY ELSE {d} END)")
    md = lambda m, d: f"make_date(y, {m}, {d})"
    # n-th weekday: DuckDB dayofweek 0=Sun..6=Sat
    nth = lambda m, dow, n: (f"(make_date(y, {m}, 1) + INTERVAL (((({dow} - dayofweek(make_date(y, {m}, 1))) % 7 + 7) "
                             f"% 7) + 7 * ({n} - 1)) DAY)")
    lastw = lambda m, dow: (f"(last_day(make_date(y, {m}, 1)) - INTERVAL (((dayofweek(last_day(make_date(y, {m}, 1))) "
                            f"- {dow}) % 7 + 7) % 7) DAY)")
    rules = [obs(md(1, 1)), nth(1, 1, 3), nth(2, 1, 3), lastw(5, 1), f"CASE WHEN y >= 2021 THEN {obs(md(6, 19))} END",
             obs(md(7, 4)), nth(9, 1, 1), nth(10, 1, 2), obs(md(11, 11)), nth(11, 4, 4), obs(md(12, 25))]
    return ("SELECT DISTINCT CAST(d AS DATE) AS hd FROM (SELECT CAST(range AS INTEGER) AS y FROM range(1960, 2100)) yy, "
            f"LATERAL (SELECT unnest([{', '.join(rules)}]) AS d) t WHERE d IS NOT NULL")


def _cal_spark(spark, sf_dir):
    b = bars_w(spark, sf_dir)
    return CL.calendar_features(b).select("symbol", "ts", F.col("day_of_week").cast("int").alias("day_of_week"),
                                          F.col("is_holiday").cast("int").alias("is_holiday"))


SPARK["calendar_features_weekly"] = _cal_spark
ORACLE["calendar_features_weekly"] = (
    f"WITH h AS ({_holiday_sql()}) SELECT b.symbol, b.ts, CAST((dayofweek(b.ts) + 6) % 7 AS INTEGER) AS day_of_week, "
    f"CAST(h.hd IS NOT NULL AS INTEGER) AS is_holiday FROM ({BARS_W_SQL}) b LEFT JOIN h ON CAST(b.ts AS DATE) = h.hd")

# A small valence lexicon (word, valence) for the sentiment job.
LEXICON = [("good", 1.9), ("great", 3.1), ("excellent", 3.2), ("happy", 2.7), ("love", 3.2), ("nice", 1.8),
           ("best", 3.2), ("bad", -2.5), ("terrible", -2.1), ("awful", -2.0), ("poor", -2.1), ("hate", -2.7),
           ("sad", -2.1), ("worst", -3.1), ("wrong", -2.1), ("fail", -2.5), ("risk", -1.1), ("gain", 2.4),
           ("loss", -1.3), ("strong", 2.3), ("weak", -1.9), ("profit", 1.9)]


def _sent_spark(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lex = spark.createDataFrame(LEXICON, "word string, valence double")
    return CL.sentiment(docs, lex).select("doc_id", r4(F.col("sentiment")).alias("sentiment"))


SPARK["sentiment_lexicon_documents"] = _sent_spark
_lex_sql = ", ".join(f"('{w}', {v!r})" for w, v in LEXICON)
ORACLE["sentiment_lexicon_documents"] = (
    f"WITH lex(word, valence) AS (VALUES {_lex_sql}), d AS (SELECT doc_id, text FROM documents), "
    "t AS (SELECT doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '[^a-z'']+')) AS word FROM d), "
    "s AS (SELECT t.doc_id, sum(valence) AS s FROM t JOIN lex USING (word) WHERE word <> '' GROUP BY t.doc_id) "
    f"SELECT d.doc_id, {__import__('ticklake.oracle_sql', fromlist=['r4']).r4('coalesce(s.s / sqrt(s.s * s.s + 15.0), 0.0)')}"
    " AS sentiment FROM d LEFT JOIN s USING (doc_id)")


# ---------------------------------------------------------------- features
from ticklake.operators import features as FT  # noqa: E402


def _scale_spark(spark, sf_dir):
    b = bars_h(spark, sf_dir)
    a = FT.scale(b, ["close", "volume"], "minmax").select("symbol", "ts", r4(F.col("close")).alias("close_mm"),
                                                          r4(F.col("volume")).alias("volume_mm"))
    z = FT.scale(b, ["close", "volume"], "zscore").select("symbol", "ts", r4(F.col("close")).alias("close_z"),
                                                          r4(F.col("volume")).alias("volume_z"))
    return a.join(z, ["symbol", "ts"])


SPARK["scale_minmax_zscore_hourly"] = _scale_spark
_P = "OVER (PARTITION BY symbol)"
_sr4 = __import__("ticklake.oracle_sql", fromlist=["r4"]).r4
ORACLE["scale_minmax_zscore_hourly"] = (
    f"SELECT symbol, ts, "
    + ", ".join(
        f"{_sr4(f'({c} - min({c}) {_P}) / (CASE WHEN max({c}) {_P} - min({c}) {_P} = 0 THEN 1.0 ELSE max({c}) {_P} - min({c}) {_P} END)')} AS {c}_mm, "
        f"{_sr4(f'({c} - avg({c}) {_P}) / (CASE WHEN stddev_pop({c}) {_P} = 0 THEN 1.0 ELSE stddev_pop({c}) {_P} END)')} AS {c}_z"
        for c in ("close", "volume"))
    + f" FROM ({BARS_H_SQL}) b")


def _seq_spark(spark, sf_dir):
    b = FT.scale(bars_h(spark, sf_dir), ["close", "volume"], "minmax")
    s = FT.sequences(b, ["close", "volume"], seq_len=5, horizon=2)
    ex = s.select("symbol", "end_ts", "y", F.posexplode("X").alias("k", "row"))
    return ex.select("symbol", "end_ts", F.col("k").cast("int").alias("k"), r4(F.col("row")[0]).alias("x_close"),
                     r4(F.col("row")[1]).alias("x_volume"), r4(F.col("y")).alias("y"))


SPARK["sequences_long_hourly"] = _seq_spark
ORACLE["sequences_long_hourly"] = f"""
WITH b AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn,
  (close - min(close) {_P}) / (CASE WHEN max(close) {_P} - min(close) {_P} = 0 THEN 1.0 ELSE max(close) {_P} - min(close) {_P} END) AS c,
  (volume - min(volume) {_P}) / (CASE WHEN max(volume) {_P} - min(volume) {_P} = 0 THEN 1.0 ELSE max(volume) {_P} - min(volume) {_P} END) AS v
  FROM ({BARS_H_SQL}) x),
e AS (SELECT symbol, ts AS end_ts, rn, lead(c, 2) OVER (PARTITION BY symbol ORDER BY rn) AS y FROM b)
SELECT e.symbol, e.end_ts, CAST(b.rn - (e.rn - 4) AS INTEGER) AS k, {_sr4('b.c')} AS x_close, {_sr4('b.v')} AS x_volume,
       {_sr4('e.y')} AS y
FROM e JOIN b ON b.symbol = e.symbol AND b.rn BETWEEN e.rn - 4 AND e.rn
WHERE e.rn >= 5 AND e.y IS NOT NULL"""


# ---------------------------------------------------------------- sources / joins
from ticklake.operators import joins as JN  # noqa: E402
from ticklake.sources import loaders as LD  # noqa: E402

_BC = ["open", "high", "low", "close", "volume"]


_ALL_EVENTS = ("view", "click", "purchase", "signup", "error")


def _composite_spark(spark, sf_dir):
    b = bars_h(spark, sf_dir)
    src = {s: b.filter(F.col("symbol") == s).select("ts", *_BC) for s in _ALL_EVENTS}
    out = JN.composite_join(src, on=["ts"])
    return out.select("ts", *[r4(F.col(f"{c}_{s}")).alias(f"{c}_{s}") for s in _ALL_EVENTS for c in _BC])


SPARK["composite_outer_join_hourly"] = _composite_spark
_cj_cols = ", ".join(f"{_sr4(f'last_value({c}_{s} IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS {c}_{s}"
                     for s in _ALL_EVENTS for c in _BC)
ORACLE["composite_outer_join_hourly"] = (
    f"WITH b AS ({BARS_H_SQL}), j AS (SELECT ts, "
    + ", ".join(f"max(CASE WHEN symbol = '{s}' THEN {c} END) AS {c}_{s}" for s in _ALL_EVENTS for c in _BC)
    + f" FROM b GROUP BY ts) SELECT ts, {_cj_cols} FROM j")


def _refresh_spark(spark, sf_dir):
    b = bars_h(spark, sf_dir)
    cache = b.filter(F.col("ts") < F.lit("2024-01-21").cast("timestamp"))
    fresh = (b.filter(F.col("ts") >= F.lit("2024-01-20").cast("timestamp"))
             .withColumn("close", F.col("close") + 1000.0))  # marks rows that came from the new fetch
    out = LD.incremental_refresh(cache, fresh)
    return out.select("symbol", "ts", r4(F.col("close")).alias("close"), F.col("volume").cast("long").alias("volume"))


SPARK["incremental_refresh_hourly"] = _refresh_spark
ORACLE["incremental_refresh_hourly"] = (
    f"WITH b AS ({BARS_H_SQL}), u AS (SELECT symbol, ts, close, volume, 0 AS p FROM b WHERE ts < TIMESTAMP '2024-01-21' "
    f"UNION ALL SELECT symbol, ts, close + 1000.0, volume, 1 FROM b WHERE ts >= TIMESTAMP '2024-01-20') "
    f"SELECT symbol, ts, {_sr4('arg_max(close, p)')} AS close, CAST(arg_max(volume, p) AS BIGINT) AS volume "
    f"FROM u GROUP BY symbol, ts")


def _broker_spark(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    rec = ev.select(F.col("event_type").alias("symbol"), F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("date"),
                    *[F.col("value").alias(c) for c in ("open", "high", "low", "close")],
                    F.lit(1.0).alias("volume"), F.col("value").alias("wap"), F.lit(1).alias("barCount"), "event_id")
    out = LD.broker_bars(rec, order="event_id")
    return out.select("symbol", "ts", *[r4(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume",
                                                                         "average")], "barCount")


SPARK["broker_bars_events"] = _broker_spark
ORACLE["broker_bars_events"] = (
    "SELECT event_type AS symbol, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS ts, "
    + ", ".join(f"{_sr4('arg_max(value, event_id)')} AS {c}" for c in ("open", "high", "low", "close"))
    + f", {_sr4('1.0')} AS volume, {_sr4('arg_max(value, event_id)')} AS average, CAST(1 AS BIGINT) AS barCount "
      "FROM events GROUP BY 1, 2")


def _json_spark(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    return LD.parse_json_column(ev, "props", "k long").select("event_id", F.col("`props.k`").alias("props_k"))


SPARK["json_flatten_events"] = _json_spark
ORACLE["json_flatten_events"] = ("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events "
                                 "WHERE json_valid(props) AND json_extract(props, '$') IS NOT NULL")


def _common_start_spark(spark, sf_dir):
    return JN.common_start(bars_w(spark, sf_dir)).select("symbol", "ts", r4(F.col("close")).alias("close"))


SPARK["common_start_weekly"] = _common_start_spark
ORACLE["common_start_weekly"] = (
    f"WITH b AS ({BARS_W_SQL}) SELECT symbol, ts, {_sr4('close')} AS close FROM b "
    "WHERE ts > (SELECT max(f) FROM (SELECT min(ts) AS f FROM b GROUP BY symbol))")


def _tail_spark(spark, sf_dir):
    return JN.tail(bars_w(spark, sf_dir), 5).select("symbol", "ts", r4(F.col("close")).alias("close"))


SPARK["tail_5_weekly"] = _tail_spark
ORACLE["tail_5_weekly"] = (f"SELECT symbol, ts, {_sr4('close')} AS close FROM (SELECT *, row_number() OVER "
                           f"(PARTITION BY symbol ORDER BY ts DESC) AS k FROM ({BARS_W_SQL}) b) WHERE k <= 5")


def _qtd_spark(spark, sf_dir):
    return JN.period_to_date(bars_w(spark, sf_dir), "qtd", "1998-05-15").select("symbol", "ts")


SPARK["quarter_to_date_weekly"] = _qtd_spark
ORACLE["quarter_to_date_weekly"] = (f"SELECT symbol, ts FROM ({BARS_W_SQL}) b "
                                    "WHERE ts >= date_trunc('quarter', TIMESTAMP '1998-05-15')")


# ---------------------------------------------------------------- streaming
from ticklake.streaming import jobs as SJ  # noqa: E402


def _stream_bars_spark(spark, sf_dir):
    ticks = SJ.ordered_stream(spark, SJ.events_in_order(spark, sf_dir))
    out = SJ.run_to_table(SJ.stream_bars(ticks), "stream-bars")
    return out.where(F.col("symbol") != SJ.CLOSING).select("symbol", "ts", *[r4(F.col(c)).alias(c) for c in ("open", "high", "low", "close")],
                      F.col("volume").cast("long").alias("volume"))


SPARK["stream_bars_hourly"] = _stream_bars_spark
ORACLE["stream_bars_hourly"] = (
    f"SELECT symbol, ts, {', '.join(f'{_sr4(c)} AS {c}' for c in ('open', 'high', 'low', 'close'))}, volume "
    f"FROM ({BARS_H_SQL}) b")


def _stream_inc_spark(spark, sf_dir):
    ticks = SJ.ordered_stream(spark, SJ.events_in_order(spark, sf_dir)).where(F.col("event_type") != SJ.CLOSING).select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("close"))
    out = SJ.run_to_table(SJ.incremental_indicators(ticks), "stream-inc")
    return out.select("symbol", "ts", *[r4(F.col(c)).alias(c) for c in ("rsi", "macd", "macd_signal")])


SPARK["stream_incremental_rsi_macd_ticks"] = _stream_inc_spark


def _inc_sql():
    s = Sql("SELECT event_type AS symbol, CAST(ts AS TIMESTAMP) AS ts, value AS close FROM events")
    s.cols(d=f"close - {lag(C, 1)}")
    s.cols(g="CASE WHEN d > 0 THEN d ELSE 0.0 END", l="CASE WHEN d < 0 THEN -d ELSE 0.0 END")
    s.cols(gavg=f"fsum(g) {w(14)} / 14.0", lavg=f"fsum(l) {w(14)} / 14.0")  # correctly rounded sums
    _macdi_pre(s)
    return s.sql({"rsi": "CASE WHEN rn >= 15 THEN CASE WHEN lavg = 0 THEN 100.0 ELSE 100 - 100 / (1 + gavg / lavg) END END",
                  "macd": "m", "macd_signal": "sg"})


ORACLE["stream_incremental_rsi_macd_ticks"] = _inc_sql()


def _stream_buf_spark(spark, sf_dir):
    recs = SJ.ordered_stream(spark, SJ.events_in_order(spark, sf_dir)).where(F.col("event_type") != SJ.CLOSING).select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("close"),
        F.when(F.col("event_id") % 10 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("open"))
    out = SJ.run_to_table(SJ.count_buffer(recs, buffer_size=100, window=252), "stream-buf")
    return out.select("symbol", "ts", r4(F.col("close")).alias("close"), r4(F.col("open")).alias("open"))


SPARK["stream_count_buffer_ticks"] = _stream_buf_spark
ORACLE["stream_count_buffer_ticks"] = (
    "WITH e AS (SELECT event_type AS symbol, CAST(ts AS TIMESTAMP) AS ts, value AS close, "
    "CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS open, "
    "row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rn FROM events) "
    f"SELECT symbol, ts, {_sr4('close')} AS close, "
    f"{_sr4('last_value(open IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)')}"
    " AS open FROM e QUALIFY rn >= 100")


def _stream_join_spark(spark, sf_dir):
    """Two bar streams (views, clicks) outer-joined on ts; the closing ticks let the last rows through."""
    path = SJ.events_in_order(spark, sf_dir)

    def side(symbol):
        t = SJ.ordered_stream(spark, path).where(F.col("event_type").isin(symbol, SJ.CLOSING))
        t = t.withColumn("ts", F.date_trunc("minute", "ts")).withColumn("value", F.when(F.col("event_type") == SJ.CLOSING, None).otherwise(F.col("value")))
        return t.select("ts", "event_id", "value")

    out = SJ.run_to_table(SJ.join_streams(side("view"), side("click"), "view", "click"), "stream-join")
    return out.where("value_view IS NOT NULL OR value_click IS NOT NULL").select(
        F.col("ts").cast("timestamp").alias("ts"), "event_id_view", "event_id_click", r4(F.col("value_view")).alias("value_view"),
        r4(F.col("value_click")).alias("value_click"))


SPARK["stream_join_ticks"] = _stream_join_spark
ORACLE["stream_join_ticks"] = (
    "WITH e AS (SELECT date_trunc('minute', CAST(ts AS TIMESTAMP)) AS ts, event_id, event_type, value FROM events) "
    "SELECT coalesce(v.ts, c.ts) AS ts, v.event_id AS event_id_view, c.event_id AS event_id_click, "
    f"{_sr4('v.value')} AS value_view, {_sr4('c.value')} AS value_click FROM (SELECT * FROM e WHERE event_type = 'view') v "
    "FULL OUTER JOIN (SELECT * FROM e WHERE event_type = 'click') c ON v.ts = c.ts")


def _stream_json_spark(spark, sf_dir):
    path = SJ.events_in_order(spark, sf_dir)
    t = SJ.ordered_stream(spark, path).where(F.col("event_type") != SJ.CLOSING)
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{broken "), F.col("event_id"))).otherwise(
        F.to_json(F.struct("event_id", "event_type", "value")))
    good, bad = SJ.split_json_stream(t.select(text.alias("json")), "json", "event_id long, event_type string, value double", "stream-json")
    rows = good.select("event_id", "event_type", r4(F.col("value")).alias("value"))
    return rows.union(bad.select(F.regexp_extract("json", r"(\d+)$", 1).cast("long"), F.lit("bad"), F.lit(None).cast("double")))


SPARK["stream_json_parse"] = _stream_json_spark
ORACLE["stream_json_parse"] = (
    f"SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE event_type END AS event_type, "
    f"CASE WHEN event_id % 7 = 0 THEN NULL ELSE {_sr4('value')} END AS value FROM events")


def _stream_polled_spark(spark, sf_dir):
    """Polls that return every record twice."""
    path = SJ.events_in_order(spark, sf_dir)
    twice = SJ.ordered_stream(spark, path).where(F.col("event_type") != SJ.CLOSING).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).drop("again")
    out = SJ.run_to_table(SJ.polled(twice, ["event_id"], watermark="60 days"), "stream-polled")
    return out.select("event_id", "event_type", r4(F.col("value")).alias("value"))


SPARK["stream_polled_dedupe"] = _stream_polled_spark
ORACLE["stream_polled_dedupe"] = f"SELECT event_id, event_type, {_sr4('value')} AS value FROM events"


# ---------------------------------------------------------------- strategies
from ticklake.operators import strategy as ST  # noqa: E402


def _common_spark(spark, sf_dir):
    out = ST.run_strategy(bars_w(spark, sf_dir), ST.CommonStrategy)
    cols = ["SMA_10", "SMA_20", "SMA_50", "SMA_200", "VOLUME_SMA_20"]
    return out.select("symbol", "ts", *[r4(F.col(c)).alias(c) for c in cols])


SPARK["common_strategy_weekly"] = _common_spark
ORACLE["common_strategy_weekly"] = Sql("w").sql({"SMA_10": roll(C, 10), "SMA_20": roll(C, 20), "SMA_50": roll(C, 50),
                                                 "SMA_200": roll(C, 200), "VOLUME_SMA_20": roll("volume", 20)})


def _chained_spark(spark, sf_dir):
    """A chained strategy: the second spec reads the first spec's output."""
    out = ST.run_strategy(bars_h(spark, sf_dir), [dict(kind="ema", length=10),
                                                  dict(kind="sma", close="EMA_10", length=5, prefix="EMA10")])
    return out.select("symbol", "ts", r4(F.col("EMA_10")).alias("EMA_10"), r4(F.col("EMA10_SMA_5")).alias("EMA10_SMA_5"))


SPARK["chained_strategy_hourly"] = _chained_spark


def _chained_sql(s):
    s.ema("e", C, 10)
    return {"EMA_10": "e", "EMA10_SMA_5": roll("e", 5)}


_cs = Sql("h")
ORACLE["chained_strategy_hourly"] = _cs.sql(_chained_sql(_cs))


# ---------------------------------------------------------------- signals
def _sig_spark(spark, sf_dir):
    b = bars_h(spark, sf_dir)
    out = ST.run_strategy(b, [dict(kind="rsi"), dict(kind="sma", length=10), dict(kind="sma", length=20),
                              dict(kind="signals", indicator="RSI_14", xa=80, xb=20),
                              dict(kind="cross", series_a="SMA_10", series_b="SMA_20"),
                              dict(kind="cross", series_a="SMA_10", series_b="SMA_20", above=False),
                              dict(kind="above", series_a="close", series_b="SMA_10"),
                              dict(kind="cross_value", series_a="RSI_14", value=50)])
    cols = ["RSI_14_A_80", "RSI_14_B_20", "SMA_10_XA_SMA_20", "SMA_10_XB_SMA_20", "close_A_SMA_10", "RSI_14_XA_50"]
    return out.select("symbol", "ts", *[F.col(c).cast("int").alias(c) for c in cols])


SPARK["signals_crossings_hourly"] = _sig_spark


def _sig_sql(s):
    rsi = _rsi_sql(s, C, 14, "r")
    s.cols(rsi=rsi, s10=roll(C, 10), s20=roll(C, 20))
    cur = "coalesce(s10 > s20, false)"
    prev = f"coalesce({lag('s10', 1)} < {lag('s20', 1)}, false)"
    return {"RSI_14_A_80": "coalesce(rsi >= 80, false)", "RSI_14_B_20": "coalesce(rsi <= 20, false)",
            "SMA_10_XA_SMA_20": f"{cur} AND {prev}", "SMA_10_XB_SMA_20": f"NOT {cur} AND NOT {prev}",
            "close_A_SMA_10": "coalesce(close >= s10, false)",
            "RSI_14_XA_50": f"coalesce(rsi > 50, false) AND coalesce({lag('rsi', 1)} < 50, false)"}


_ss = Sql("h")
_ss_outs = _sig_sql(_ss)
ORACLE["signals_crossings_hourly"] = _ss.sql(_ss_outs, ints=tuple(_ss_outs))


def _xsig_spark(spark, sf_dir):
    out = ST.run_strategy(bars_h(spark, sf_dir), [dict(kind="rsi"), dict(kind="xsignals", signal="RSI_14", xa=60,
                                                                                       xb=40)])
    return out.select("symbol", "ts", *[F.col(c).cast("int").alias(c) for c in
                                        ("TS_Trends", "TS_Trades", "TS_Entries", "TS_Exits")])


SPARK["xsignals_rsi_hourly"] = _xsig_spark


def _xsig_sql(s):
    s.cols(rsi=_rsi_sql(s, C, 14, "r"))
    s.cols(ent=f"CAST(coalesce(rsi > 60, false) AND coalesce({lag('rsi', 1)} < 60, false) AS INTEGER)",
           ex=f"-CAST(NOT coalesce(rsi > 40, false) AND NOT coalesce({lag('rsi', 1)} < 40, false) AS INTEGER)")
    s.cols(tr=f"coalesce(last_value(CASE WHEN ent + ex <> 0 THEN ent + ex END IGNORE NULLS) {RUN}, 0)")
    s.cols(trend="CASE WHEN tr > 0 THEN 1 ELSE 0 END")
    s.cols(trades=f"coalesce(trend - {lag('trend', 1)}, 0)")
    return {"TS_Trends": "trend", "TS_Trades": "trades", "TS_Entries": "CASE WHEN trades > 0 THEN 1 ELSE 0 END",
            "TS_Exits": "CASE WHEN trades < 0 THEN 1 ELSE 0 END"}


_xs = Sql("h")
_xs_outs = _xsig_sql(_xs)
ORACLE["xsignals_rsi_hourly"] = _xs.sql(_xs_outs, ints=tuple(_xs_outs))


# ---------------------------------------------------------------- state machines
# Non-linear recurrences; their SQL twins (below) carry the state in recursive CTEs.
_STATE_Q = {
    "psar": ["PSARl_0.02_0.2", "PSARs_0.02_0.2", "PSARaf_0.02_0.2", "PSARr_0.02_0.2"],
    "supertrend": ["SUPERT_7_3.0", "SUPERTd_7_3.0", "SUPERTl_7_3.0", "SUPERTs_7_3.0"],
    "qqe": ["QQE_14_5_4.236", "QQE_14_5_4.236_RSIMA", "QQEl_14_5_4.236", "QQEs_14_5_4.236"],
    "fisher": ["FISHERT_9_1", "FISHERTs_9_1"], "rsx": ["RSX_14"],
    "stc": ["STC_10_12_26_0.5", "STCmacd_10_12_26_0.5", "STCstoch_10_12_26_0.5"], "jma": ["JMA_7_0"],
    "ebsw": ["EBSW_40_10"], "mcgd": ["MCGD_10"], "hwma": ["HWMA_0.2_0.1_0.1"], "hwc": ["HWM", "HWU", "HWL"],
    "ssf": ["SSF_10_2"]}
for _k, _outs in _STATE_Q.items():
    ind(f"{_k}_hourly", "h", dict(kind=_k), None, _outs,
        ints=tuple(o for o in _outs if o.startswith(("PSARr", "SUPERTd"))))


def _mcgd_spark(spark, sf_dir):
    """On the raw prices the McGinley recursion diverges (ratios far from 1 to the
    fourth power); on prices near 1,000 it is a moving average."""
    f = SeriesFrame(bars_h(spark, sf_dir).withColumn("level", F.col("close") + 1000.0))
    R.run(f, [dict(kind="mcgd", close="level")])
    return f.result().select("symbol", "ts", r4(F.col("MCGD_10")).alias("MCGD_10"))


SPARK["mcgd_hourly"] = _mcgd_spark


def _vp_spark(spark, sf_dir):
    from ticklake.operators.volume import vp
    v = vp(bars_w(spark, sf_dir), width=10)
    return v.select("symbol", F.col("chunk").cast("int").alias("chunk"),
                    *[r4(F.col(c)).alias(c) for c in ("low_close", "mean_close", "high_close", "pos_volume",
                                                      "neg_volume", "total_volume")])


SPARK["volume_profile_weekly"] = _vp_spark
ORACLE["volume_profile_weekly"] = f"""
WITH b AS (SELECT *, ntile(10) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS chunk,
  CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts) = 1 THEN 1.0
       ELSE sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)) END AS sg FROM ({BARS_W_SQL}) x)
SELECT symbol, CAST(chunk AS INTEGER) AS chunk, {_sr4('min(close)')} AS low_close, {_sr4('avg(close)')} AS mean_close,
  {_sr4('max(close)')} AS high_close, {_sr4('coalesce(sum(CASE WHEN sg > 0 THEN volume * sg END), 0.0)')} AS pos_volume,
  {_sr4('coalesce(sum(CASE WHEN sg < 0 THEN -volume * sg END), 0.0)')} AS neg_volume,
  {_sr4('coalesce(sum(CASE WHEN sg > 0 THEN volume * sg END), 0.0) + coalesce(sum(CASE WHEN sg < 0 THEN -volume * sg END), 0.0)')} AS total_volume
FROM b GROUP BY symbol, chunk"""


# SQL twins for three state machines: explicit recursive CTEs over the rows of
# each symbol (the recursion carries the machine's state columns).
def _rec_sql(state_cols, init_sel, step_sel, outs):
    return (f"WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn "
            f"FROM ({BARS_H_SQL}) x), r(symbol, rn, {', '.join(state_cols)}) AS ("
            f"SELECT symbol, rn, {init_sel} FROM b WHERE rn = 1 UNION ALL "
            f"SELECT b.symbol, b.rn, {step_sel} FROM r JOIN b ON b.symbol = r.symbol AND b.rn = r.rn + 1) "
            f"SELECT b.symbol, b.ts, {', '.join(f'{e} AS {q(n)}' for n, e in outs.items())} "
            f"FROM b JOIN r USING (symbol, rn)")


_na, _nb, _nc = 1.0 - 0.2, 1.0 - 0.1, 1.0 - 0.1
_F = f"({_na!r} * (r.f + r.v + 0.5 * r.a) + 0.2 * b.close)"
_V = f"({_nb!r} * (r.v + r.a) + 0.1 * ({_F} - r.f))"
_A = f"({_nc!r} * r.a + 0.1 * ({_V} - r.v))"
_F1 = f"({_na!r} * (close + 0.0 + 0.5 * 0.0) + 0.2 * close)"
_V1 = f"({_nb!r} * (0.0 + 0.0) + 0.1 * ({_F1} - close))"
_A1 = f"({_nc!r} * 0.0 + 0.1 * ({_V1} - 0.0))"
ORACLE["hwma_hourly"] = _rec_sql(["f", "v", "a"], f"{_F1}, {_V1}, {_A1}", f"{_F}, {_V}, {_A}",
                                 {"HWMA_0.2_0.1_0.1": _sr4("r.f + r.v + 0.5 * r.a")})


def _supertrend_sql():
    s = Sql("h")
    s.cols(tr=TR)
    s.rma("atr", "tr", 7, warm=1)
    s.cols(ub="0.5 * (high + low) + 3.0 * atr", lb="0.5 * (high + low) - 3.0 * atr")
    base = s.cur
    body = ",\n".join(f"{nm} AS ({txt})" for nm, txt in s.ctes)
    # state: d (direction), u / l (carried bands); row 1: d = 1, bands as computed
    step_d = "CASE WHEN c.close > r.u THEN 1 WHEN c.close < r.l THEN -1 ELSE r.d END"
    step_l = (f"CASE WHEN NOT (c.close > r.u) AND NOT (c.close < r.l) AND r.d > 0 AND c.lb < r.l THEN r.l ELSE c.lb END")
    step_u = (f"CASE WHEN NOT (c.close > r.u) AND NOT (c.close < r.l) AND r.d < 0 AND c.ub > r.u THEN r.u ELSE c.ub END")
    rec = (f"st(symbol, rn, d, u, l) AS (SELECT symbol, rn, 1, ub, lb FROM {base} WHERE rn = 1 UNION ALL "
           f"SELECT c.symbol, c.rn, {step_d}, {step_u}, {step_l} FROM st r JOIN {base} c "
           f"ON c.symbol = r.symbol AND c.rn = r.rn + 1)")
    sel = (f"SELECT b.symbol, b.ts, {_sr4('CASE WHEN b.rn = 1 THEN 0.0 WHEN st.d > 0 THEN st.l ELSE st.u END')} "
           f"AS \"SUPERT_7_3.0\", CAST(st.d AS INTEGER) AS \"SUPERTd_7_3.0\", "
           f"{_sr4('CASE WHEN b.rn > 1 AND st.d > 0 THEN st.l END')} AS \"SUPERTl_7_3.0\", "
           f"{_sr4('CASE WHEN b.rn > 1 AND st.d < 0 THEN st.u END')} AS \"SUPERTs_7_3.0\" "
           f"FROM {base} b JOIN st USING (symbol, rn)")
    return f"WITH RECURSIVE {body},\n{rec}\n{sel}"


ORACLE["supertrend_hourly"] = _supertrend_sql()


def _machine(s: Sql, first: dict, layers: list[dict], state: list[str], outs: dict, ints=()) -> str:
    """SQL of a state machine over the rows of ``s``: ``first`` gives the state
    columns on row 1 (over ``c``); each layer of expressions may use the row
    (``c``'s columns), the state before (``p_...``) and earlier layers."""
    base = s.cur
    body = ",\n".join(f"{nm} AS ({txt})" for nm, txt in s.ctes)
    names = ", ".join(state)
    inner = (f"SELECT c.*, {', '.join(f'r.{n} AS p_{n}' for n in state)} FROM m r JOIN {base} c "
             "ON c.symbol = r.symbol AND c.rn = r.rn + 1")
    for layer in layers:
        inner = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in layer.items())} FROM ({inner}) x"
    rec = (f"m(symbol, rn, {names}) AS (SELECT symbol, rn, {', '.join(f'CAST({first[n]} AS {_kind(first[n])})' for n in state)} FROM {base} c WHERE rn = 1 "
           f"UNION ALL SELECT symbol, rn, {names} FROM ({inner}) y)")
    sel = ", ".join(f"CAST({e} AS INTEGER) AS {q(n)}" if n in ints else f"{_sr4(e)} AS {q(n)}" for n, e in outs.items())
    return f"WITH RECURSIVE {body},\n{rec}\nSELECT b.symbol, b.ts, {sel} FROM {base} b JOIN m USING (symbol, rn)"


def _kind(e: str) -> str:
    return "DOUBLE[]" if e.startswith("[") else "DOUBLE"


def _from_end(col: str, k: int) -> str:
    """A symbol's value ``k`` rows before its last, on every row."""
    return f"nth_value({col}, {k + 1}) OVER (PARTITION BY symbol ORDER BY rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def _psar_sql():
    s = Sql("h").cols(lasth=_from_end("high", 0), lastl=_from_end("low", 0))
    first = dict(side="0", stop="close", extreme="0", speed="0.02", turned="0", h1="high", l1="low", h2="lasth", l2="lastl")
    new = "p_side = 0"
    layers = [
        dict(d0=f"CASE WHEN {new} THEN CASE WHEN p_l1 - low > greatest(high - p_h1, 0.0) THEN -1.0 ELSE 1.0 END ELSE p_side END"),
        dict(e0=f"CASE WHEN {new} THEN CASE WHEN d0 > 0 THEN p_h1 ELSE p_l1 END ELSE p_extreme END",
             best="CASE WHEN d0 > 0 THEN high ELSE low END", worst="CASE WHEN d0 > 0 THEN low ELSE high END"),
        dict(moved="p_stop + p_speed * (e0 - p_stop)"),
        dict(turned="CASE WHEN d0 * worst < d0 * moved THEN 1.0 ELSE 0.0 END", further="d0 * best > d0 * e0",
             held="CASE WHEN d0 > 0 THEN least(p_l1, p_l2, moved) ELSE greatest(p_h1, p_h2, moved) END"),
        dict(e1="CASE WHEN further THEN best ELSE e0 END", f1="CASE WHEN further THEN least(p_speed + 0.02, 0.2) ELSE p_speed END"),
        dict(side="CASE WHEN turned = 1 THEN -d0 ELSE d0 END", stop="CASE WHEN turned = 1 THEN e1 ELSE held END",
             extreme="CASE WHEN turned = 1 THEN worst ELSE e1 END", speed="CASE WHEN turned = 1 THEN 0.02 ELSE f1 END",
             h1="high", l1="low", h2="p_h1", l2="p_l1"),
    ]
    p = "_0.02_0.2"
    return _machine(s, first, layers, list(first), {
        f"PSARl{p}": "CASE WHEN m.side > 0 THEN m.stop END", f"PSARs{p}": "CASE WHEN m.side < 0 THEN m.stop END",
        f"PSARaf{p}": "m.speed", f"PSARr{p}": "m.turned"}, ints=(f"PSARr{p}",))


def _fisher_sql():
    s = Sql("h").cols(hl2="0.5 * (high + low)")
    s.cols(hh=roll("hl2", 9, "max"), ll=roll("hl2", 9, "min"))
    s.cols(pos=f"(hl2 - ll) / greatest({nz('hh', 'll')}, 0.001) - 0.5")
    first = dict(v="0.0", y="NULL")
    layers = [dict(raw="0.66 * pos + 0.67 * p_v"),
              dict(v="CASE WHEN rn <= 9 THEN 0.0 WHEN raw < -0.99 THEN -0.999 WHEN raw > 0.99 THEN 0.999 ELSE raw END"),
              dict(y="CASE WHEN rn < 9 THEN NULL WHEN rn = 9 THEN 0.0 ELSE 0.5 * (ln((1 + v) / (1 - v)) + p_y) END")]
    return _machine(s, first, layers, ["v", "y"], {"FISHERT_9_1": "m.y", "FISHERTs_9_1": "lag(m.y) OVER (PARTITION BY b.symbol ORDER BY b.rn)"})


def _ebsw_sql():
    n, bars = 40, 10
    cut = (1 - math.sin(360 / n)) / math.cos(360 / n)
    fade = math.exp(-math.sqrt(2) * math.pi / bars)
    one, two = 2 * fade * math.cos(math.sqrt(2) * 180 / bars), -fade * fade
    first = dict(price="0.0", hp="0.0", f1="0.0", f2="0.0", y="NULL")
    go = f"rn > {n}"
    layers = [dict(h=f"0.5 * (1 + {cut!r}) * (close - p_price) + {cut!r} * p_hp"),
              dict(f0=f"(1 - {one!r} - {two!r}) * (h + p_hp) / 2 + {one!r} * p_f1 + {two!r} * p_f2"),
              dict(pw="(f0 * f0 + p_f1 * p_f1 + p_f2 * p_f2) / 3"),
              dict(y=f"CASE WHEN rn < {n} THEN NULL WHEN rn = {n} THEN 0.0 WHEN pw > 0 THEN (f0 + p_f1 + p_f2) / 3 / sqrt(pw) END",
                   price=f"CASE WHEN {go} THEN close ELSE 0.0 END", hp=f"CASE WHEN {go} THEN h ELSE 0.0 END",
                   f1=f"CASE WHEN {go} THEN f0 ELSE 0.0 END", f2=f"CASE WHEN {go} THEN p_f1 ELSE 0.0 END")]
    return _machine(Sql("h"), first, layers, list(first), {"EBSW_40_10": "m.y"})


def _hwc_sql():
    level = "0.8 * (p_level + p_slope + 0.5 * p_bend) + 0.2 * close"
    first = dict(level="0.8 * close + 0.2 * close", slope="0.1 * (0.8 * close + 0.2 * close - close)",
                 bend="0.1 * (0.1 * (0.8 * close + 0.2 * close - close))", spread="0.0", seen="close", mid="0.0", reach="0.0")
    first["mid"] = f"{first['level']} + {first['slope']} + 0.5 * {first['bend']}"
    layers = [dict(level=level), dict(slope="0.9 * (p_slope + p_bend) + 0.1 * (level - p_level)"),
              dict(bend="0.9 * p_bend + 0.1 * (slope - p_slope)"),
              dict(mid="level + slope + 0.5 * bend", reach="sqrt(p_spread)", seen="close",
                   spread="0.9 * p_spread + 0.1 * (p_seen - p_mid) * (p_seen - p_mid)")]
    return _machine(Sql("h"), first, layers, list(first), {"HWM": "m.mid", "HWU": "m.mid + m.reach", "HWL": "m.mid - m.reach"})


def _ssf_sql():
    x = math.pi * math.sqrt(2) / 10
    a0 = math.exp(-x)
    c3, c2 = -a0 * a0, 2 * a0 * math.cos(x)
    c1 = 1 - c3 - c2
    s = Sql("h").cols(z1=_from_end("close", 0), z2=_from_end("close", 1))
    first = dict(y=f"{c1!r} * close + {c2!r} * z1 + {c3!r} * z2", before="z1")
    layers = [dict(y=f"{c1!r} * close + {c2!r} * p_y + {c3!r} * p_before", before="p_y")]
    return _machine(s, first, layers, ["y", "before"], {"SSF_10_2": "m.y"})


def _mcgd_sql():
    s = Sql("h").cols(level="close + 1000.0")
    return _machine(s, dict(y="level"), [dict(y="p_y + (level - p_y) / (10.0 * pow(level / p_y, 4))")], ["y"], {"MCGD_10": "m.y"})


def _rsx_sql():
    n = 14
    share, warm = 3.0 / (n + 2.0), n - 1
    keep = 1.0 - share
    poles = [f"{side}{k}{x}" for side in "un" for k in range(3) for x in "ab"]
    first = dict(age="0", moved="0", seen="0.0", y="NULL") | {p: "0.0" for p in poles}
    layers = [dict(price="100.0 * close", idle=f"rn <= {n} OR p_age = 0"),
              dict(du="CASE WHEN idle THEN 0.0 ELSE price - p_seen END"), dict(dn="abs(du)")]
    for k in range(3):
        layers.append({f"{s}{k}a": f"CASE WHEN idle THEN p_{s}{k}a ELSE {keep!r} * p_{s}{k}a + {share!r} * d{s} END" if k == 0 else
                       f"CASE WHEN idle THEN p_{s}{k}a ELSE {keep!r} * p_{s}{k}a + {share!r} * o{s}{k - 1} END" for s in "un"})
        layers.append({f"{s}{k}b": f"CASE WHEN idle THEN p_{s}{k}b ELSE {share!r} * {s}{k}a + {keep!r} * p_{s}{k}b END" for s in "un"})
        layers.append({f"o{s}{k}": f"1.5 * {s}{k}a - 0.5 * {s}{k}b" for s in "un"})
    layers += [dict(grown=f"CASE WHEN rn <= {n} THEN 0 WHEN p_age = 0 THEN 1 ELSE least(p_age, {warm}) + 1 END"),
               dict(moved="CASE WHEN idle THEN 0 WHEN p_moved = 1 OR du <> 0 THEN 1 ELSE 0 END", seen="price"),
               dict(age=f"CASE WHEN grown = {warm} AND moved = 0 THEN 0 ELSE grown END"),
               dict(y=f"CASE WHEN rn < {n} THEN NULL WHEN rn = {n} THEN 0.0 WHEN grown > {warm} AND on2 > 1e-10 "
                      f"THEN least(greatest((ou2 / on2 + 1.0) * 50.0, 0.0), 100.0) ELSE 50.0 END")]
    return _machine(Sql("h"), first, layers, list(first), {"RSX_14": "m.y"})


def _jma_sql():
    n = 7
    half = 0.5 * (n - 1)
    reach = max(math.log2(math.sqrt(half)) + 2.0, 0)
    power = max(reach - 2.0, 0.5)
    most, decay = reach ** (1 / power), reach * math.sqrt(half)
    band, keep, gain = decay / (decay + 1), 0.45 * (n - 1) / (0.45 * (n - 1) + 2.0), 1.5
    first = dict(above="close", below="close", average="close", line="close", err="0.0", speed="0.0", dist="[0.0]", sums="[0.0]")
    layers = [dict(ov="close - p_above", un="close - p_below"),
              dict(dd="CASE WHEN abs(ov) <> abs(un) THEN greatest(abs(ov), abs(un)) ELSE 0.0 END"),
              dict(sums="list_append(p_sums, p_sums[-1] + (dd - p_dist[1]) / 10)[-66:]", dist="list_append(p_dist, dd)[-10:]"),
              dict(mean="list_sum(sums) / len(sums)"),
              dict(odd=f"pow(greatest(1.0, least({most!r}, CASE WHEN mean = 0 THEN 0.0 ELSE dd / mean END)), {power!r})"),
              dict(slack=f"pow({band!r}, sqrt(odd))", slow=f"pow({keep!r}, odd)"),
              dict(above="CASE WHEN ov > 0 THEN close ELSE close - slack * ov END", below="CASE WHEN un < 0 THEN close ELSE close - slack * un END",
                   average="(1 - slow) * close + slow * p_average"),
              dict(err=f"(close - average) * (1 - {keep!r}) + {keep!r} * p_err"),
              dict(speed=f"(average + {gain!r} * err - p_line) * (1 - slow) * (1 - slow) + slow * slow * p_speed"),
              dict(line="p_line + speed")]
    return _machine(Sql("h"), first, layers, list(first), {"JMA_7_0": f"CASE WHEN b.rn >= {n} THEN m.line END"})


def _stc_sql():
    s = Sql("h").ema("ef", "close", 12).ema("es", "close", 26)
    s.cols(xm="CASE WHEN rn >= 26 THEN ef - es END")
    s.cols(lo=roll("xm", 10, "min"), hi=roll("xm", 10, "max"))
    s.cols(rg=nz("hi", "lo"))

    def stage(x, low, width, gate):
        return [dict(st=f"CASE WHEN coalesce({gate}, 0) > 0 THEN 100 * (({x} - {low}) / {width}) ELSE p_st END"),
                dict(pf="round(p_pf + 0.5 * (st - p_pf), 8)")]

    def carry(s, layers, name):
        base = s.cur
        inner = f"SELECT c.*, r.st AS p_st, r.pf AS p_pf FROM {name} r JOIN {base} c ON c.symbol = r.symbol AND c.rn = r.rn + 1"
        for layer in layers:
            inner = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in layer.items())} FROM ({inner}) x"
        s.ctes.append((f"{name}(symbol, rn, st, pf)", f"SELECT symbol, rn, CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE) FROM {base} WHERE rn = 1 "
                                                     f"UNION ALL SELECT symbol, rn, st, pf FROM ({inner}) y"))
        s.recursive = True
        nxt = f"{name}_rows"
        s.ctes.append((nxt, f"SELECT c.*, r.pf AS {name}_pf FROM {base} c JOIN {name} r USING (symbol, rn)"))
        s.cur = nxt

    carry(s, stage("xm", "lo", "rg", "lo"), "one")
    s.cols(lo2=roll("one_pf", 10, "min"), hi2=roll("one_pf", 10, "max"))
    s.cols(rg2=nz("hi2", "lo2"))
    carry(s, stage("one_pf", "lo2", "rg2", "rg2"), "two")
    p = "_10_12_26_0.5"
    return s.sql({f"STC{p}": "two_pf", f"STCmacd{p}": "xm", f"STCstoch{p}": "one_pf"})


def _qqe_sql():
    s = Sql("h").cols(d=f"close - {lag('close', 1)}")
    s.cols(up="CASE WHEN d < 0 THEN 0.0 ELSE d END", dn="CASE WHEN d > 0 THEN 0.0 ELSE d END")
    s.rma("pa", "up", 14, warm=1).rma("na", "dn", 14, warm=1)
    s.cols(rsi=dv("100.0 * pa", "(pa + abs(na))"))
    s.ema("line", "rsi", 5, warm=14)
    s.cols(ok_line="CASE WHEN rn >= 15 THEN line END")
    s.cols(tr=f"abs(ok_line - {lag('ok_line', 1)})")
    s.ema("s1", "tr", 27, warm=15)
    s.cols(ok_s1="CASE WHEN rn >= 27 THEN s1 END")
    s.ema("s2", "ok_s1", 27, warm=41)
    s.cols(dar="CASE WHEN rn >= 42 THEN 4.236 * s2 END")
    s.cols(hi="ok_line + dar", lo="ok_line - dar")
    first = dict(prev="ok_line", l1="0.0", l2="0.0", u1="0.0", u2="0.0", up="1", y="ok_line", yl="NULL", yu="NULL")

    def crossed(level, before):
        return (f"(coalesce(ok_line > {level} AND p_prev < {before}, false) OR coalesce(ok_line <= {level} AND p_prev >= {before}, false))")

    layers = [dict(tu=crossed("p_u1", "p_u2"), tl=crossed("p_l1", "p_l2"),
                   l1="CASE WHEN p_prev > p_l1 AND ok_line > p_l1 THEN CASE WHEN lo IS NULL THEN NULL ELSE greatest(p_l1, lo) END ELSE lo END",
                   u1="CASE WHEN p_prev < p_u1 AND ok_line < p_u1 THEN CASE WHEN hi IS NULL THEN NULL ELSE least(p_u1, hi) END ELSE hi END",
                   l2="p_l1", u2="p_u1", prev="ok_line"),
              dict(side="CASE WHEN tu THEN 1 WHEN tl THEN 0 ELSE p_up END"),
              dict(y="CASE WHEN side = 1 THEN l1 ELSE u1 END", yl="CASE WHEN side = 1 THEN l1 END", yu="CASE WHEN side = 0 THEN u1 END")]
    # (the row has a column named up as well: the state's is renamed)
    first = {("flag" if k == "up" else k): v for k, v in first.items()}
    layers[1]["side"] = layers[1]["side"].replace("p_up", "p_flag")
    layers.append(dict(flag="side"))
    return _machine(s, first, layers, list(first), {
        "QQE_14_5_4.236": "m.y", "QQE_14_5_4.236_RSIMA": "b.ok_line", "QQEl_14_5_4.236": "m.yl", "QQEs_14_5_4.236": "m.yu"})


for _k, _fn in (("psar", _psar_sql), ("fisher", _fisher_sql), ("ebsw", _ebsw_sql), ("hwc", _hwc_sql), ("ssf", _ssf_sql), ("mcgd", _mcgd_sql),
                ("rsx", _rsx_sql), ("jma", _jma_sql), ("stc", _stc_sql), ("qqe", _qqe_sql)):
    ORACLE[f"{_k}_hourly"] = _fn()


# ---------------------------------------------------------------- products: many indicators in one plan
def _twin(recipes, bars="h", raw=False) -> str:
    """The recipes' SQL on the same bars, side by side (``raw``: not rounded)."""
    parts, seen, cols = [], set(), []
    for i, (_, sqlfn, outs, ints) in enumerate(recipes):
        one = Sql(bars)
        res = {k: v for k, v in sqlfn(one).items() if k not in seen and k in outs}
        seen |= set(res)
        if res:
            parts.append(f"({one.sql(res, ints=ints, raw=raw)}) a{i}")
            cols += [f"a{i}.{q(k)}" for k in res]
    first = parts[0].rsplit(" ", 1)[1]
    joins = "".join(f"\nJOIN {x} ON {x.rsplit(' ', 1)[1]}.symbol = {first}.symbol AND {x.rsplit(' ', 1)[1]}.ts = {first}.ts" for x in parts[1:])
    return f"SELECT {first}.symbol, {first}.ts, {', '.join(cols)} FROM {parts[0]}{joins}"


def _product(df, recipes):
    outs = {o: o in ints for _, _, outs, ints in recipes for o in outs}
    return df.select("symbol", "ts", *[F.col(f"`{o}`").cast("int").alias(o) if i else r4(F.col(f"`{o}`")).alias(o) for o, i in outs.items()])


def _by_default(spec) -> bool:
    known = R.REGISTRY[spec["kind"]].defaults
    return all(k == "kind" or (k in known and known[k] == v) for k, v in spec.items())


def _category(cat):
    from ticklake.operators.strategy import run_strategy, specs_for
    kinds = {x["kind"] for x in specs_for(cat)}
    # (variance: a few sums of squares end on a tie of the 4-digit rounding; it has queries of its own)
    recipes = [r for r in RECIPES if all(x["kind"] in kinds and _by_default(x) and x["kind"] != "variance" for x in r[0])]
    SPARK[f"strategy_{cat}_hourly"] = lambda spark, sf_dir: _product(run_strategy(bars_h(spark, sf_dir), cat), recipes)
    ORACLE[f"strategy_{cat}_hourly"] = _twin(recipes)


# ---- indicators that had no query of their own
def _hilo_sql(s):
    s.cols(ha=roll("high", 13), la=roll("low", 21))
    s.cols(up=f"coalesce(close > {lag('ha', 1)}, false)", low_break=f"coalesce(close < {lag('la', 1)}, false)")
    s.cols(down="low_break AND NOT up")
    s.cols(line=f"last_value(CASE WHEN up THEN la WHEN down THEN ha END IGNORE NULLS) {RUN}")
    return {"HILO_13_21": "line", "HILOl_13_21": "CASE WHEN NOT down THEN line END", "HILOs_13_21": "CASE WHEN NOT up THEN line END"}


ind("hilo_hourly", "h", dict(kind="hilo"), _hilo_sql, ["HILO_13_21", "HILOl_13_21", "HILOs_13_21"])


def _squeeze_detail_sql(s):
    out = _squeeze(s)
    s.cols(sq=out["SQZ_20_2.0_20_1.5"])
    s.cols(pos="CASE WHEN sq >= 0 THEN sq END", neg="CASE WHEN sq < 0 THEN sq END")
    before = "OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    s.cols(pp=f"last_value(pos IGNORE NULLS) {before}", pn=f"last_value(neg IGNORE NULLS) {before}", ps=lag("sq", 1))
    keep = lambda cond: f"CASE WHEN sq <> 0 AND {cond} THEN sq END"
    return {"SQZ_INC": keep("sq > ps"), "SQZ_DEC": keep("sq < ps"), "SQZ_PINC": keep("pos > pp"), "SQZ_PDEC": keep("pos < pp"),
            "SQZ_NDEC": keep("neg < pn"), "SQZ_NINC": keep("neg > pn")}


ind("squeeze_detailed_hourly", "h", dict(kind="squeeze", detailed=True), _squeeze_detail_sql,
    ["SQZ_INC", "SQZ_DEC", "SQZ_PINC", "SQZ_PDEC", "SQZ_NDEC", "SQZ_NINC"])


def _squeeze_pro_sql(s):
    s.cols(mid=roll(C, 20), sd=roll(C, 20, "stddev_pop"), tr=TR)
    s.cols(bl="mid - 2.0 * sd", bu="mid + 2.0 * sd", band=roll("tr", 20), mo=f"close - {lag(C, 12)}")
    on = {k: f"coalesce(bl > mid - {w} * band AND bu < mid + {w} * band, false)" for k, w in (("WIDE", 2.0), ("NORMAL", 1.5), ("NARROW", 1.0))}
    off = "coalesce(bl < mid - 2.0 * band AND bu > mid + 2.0 * band, false)"
    return {"SQZPRO_20_2.0_20_2.0_1.5_1.0": roll("mo", 6), **{f"SQZPRO_ON_{k}": e for k, e in on.items()}, "SQZPRO_OFF": off,
            "SQZPRO_NO": f"NOT {on['WIDE']} AND NOT {off}"}


_SP = ["SQZPRO_ON_WIDE", "SQZPRO_ON_NORMAL", "SQZPRO_ON_NARROW", "SQZPRO_OFF", "SQZPRO_NO"]
ind("squeeze_pro_hourly", "h", dict(kind="squeeze_pro"), _squeeze_pro_sql, ["SQZPRO_20_2.0_20_2.0_1.5_1.0", *_SP], ints=tuple(_SP))


def _ma_sql(s):
    s.ema("e", C, 10)
    return {"EMA_10": "e"}


ind("ma_hourly", "h", dict(kind="ma"), _ma_sql, ["EMA_10"])


def _runs_sql(s):
    s.cols(f=roll(C, 5), g=roll(C, 20))
    inc = lambda x: f"coalesce({x} - {lag(x, 2)} > 0, false)"
    dec = lambda x: f"coalesce({x} - {lag(x, 2)} < 0, false)"
    s.cols(fi=inc("f"), fd=dec("f"), gi=inc("g"), gd=dec("g"))
    s.cols(lr="CAST((fi AND gd) OR (fi AND gi) AS INTEGER)", sr="CAST((fd AND gi) OR (fd AND gd) AS INTEGER)")
    s.cols(trades=f"coalesce(lr - {lag('lr', 1)}, 0)")
    return {"LR_2": "lr", "SR_2": "sr", "TS_Trends": "lr", "TS_Trades": "trades", "TS_Entries": "CASE WHEN trades > 0 THEN 1 ELSE 0 END",
            "TS_Exits": "CASE WHEN trades < 0 THEN 1 ELSE 0 END"}


_RUN_OUTS = ["LR_2", "SR_2", "TS_Trends", "TS_Trades", "TS_Entries", "TS_Exits"]
ind("runs_signals_hourly", "h",
    [dict(kind="sma", length=5), dict(kind="sma", length=20), dict(kind="long_run", fast="SMA_5", slow="SMA_20"),
     dict(kind="short_run", fast="SMA_5", slow="SMA_20"), dict(kind="tsignals", trend="LR_2")], _runs_sql, _RUN_OUTS, ints=tuple(_RUN_OUTS))

ind("cdl_pattern_hourly", "h", dict(kind="cdl_pattern", name=["inside"]),
    lambda s: {"CDL_INSIDE": f"100 * CAST(coalesce(high - {lag('high', 1)} < 0 AND low - {lag('low', 1)} > 0, false) AS INTEGER)"
                             " * (CASE WHEN close >= open THEN 1 ELSE -1 END)"}, ["CDL_INSIDE"])


for _cat in ("momentum", "overlap", "performance", "statistics", "trend", "volatility", "volume"):
    _category(_cat)


def _recipe(*kinds):
    return [next(r for r in RECIPES if [x["kind"] for x in r[0]] == [k] and _by_default(r[0][0])) for k in kinds]


def _segmented(name, recipes, segment):
    """The segmented plan must give what SQL gives."""
    from ticklake.operators.strategy import run_strategy
    specs = [x for r in recipes for x in r[0]]
    SPARK[name] = lambda spark, sf_dir: _product(run_strategy(bars_h(spark, sf_dir), specs, segment=segment), recipes)
    ORACLE[name] = _twin(recipes)


_segmented("vwap_rma_segmented", _recipe("vwap", "rma"), "2 days")
_segmented("trima_kst_segmented", _recipe("trima", "kst", "hma"), "6 hours")
_segmented("bundle_segmented", _recipe("rsi", "macd", "atr", "vwap", "bbands"), "2 days")

# the machines' segments, run side by side, must give what the serial twins give
for _k in ("psar", "supertrend", "qqe", "stc", "hwma", "hwc", "rsx", "ssf", "ebsw"):
    _outs = _STATE_Q[_k]
    ind(f"{_k}_segmented", "h", dict(kind=_k), None, _outs, ints=tuple(o for o in _outs if o.startswith(("PSARr", "SUPERTd"))),
        segment="2 days" if _k in ("psar", "supertrend", "qqe", "stc") else "6 hours")
    ORACLE[f"{_k}_segmented"] = ORACLE[f"{_k}_hourly"]


def _bundle_spark(spark, sf_dir):
    from ticklake.operators.features import indicator_bundle
    f = indicator_bundle(SeriesFrame(bars_h(spark, sf_dir)), bbands=(5, 2.0))
    names = ["rsi", "macd", "macd_signal", "macd_hist", "atr", "vwap", "bb_upper", "bb_lower"]
    return f.result().select("symbol", "ts", *[r4(F.col(c)).alias(c) for c in names])


SPARK["indicator_bundle_hourly"] = _bundle_spark
ORACLE["indicator_bundle_hourly"] = (
    'SELECT symbol, ts, "RSI_14" AS rsi, "MACD_12_26_9" AS macd, "MACDs_12_26_9" AS macd_signal, "MACDh_12_26_9" AS macd_hist, '
    f'"ATRr_14" AS atr, "VWAP_D" AS vwap, "BBU_5_2.0" AS bb_upper, "BBL_5_2.0" AS bb_lower FROM ({_twin(_recipe("rsi", "macd", "atr", "vwap", "bbands"))}) t')


_PRICES = ("open", "high", "low", "close", "volume")
_GAPPY_SQL = (f"SELECT symbol, ts, open, high, low, CASE WHEN CAST(epoch(ts) / 3600 AS BIGINT) % 10 = 0 THEN NULL ELSE close END AS close, "
              f"CAST(volume AS DOUBLE) AS volume FROM ({BARS_H_SQL}) g")


def _clean_pipeline_spark(spark, sf_dir):
    b = bars_h(spark, sf_dir)
    gappy = b.withColumn("close", F.when((F.unix_seconds("ts") / 3600).cast("long") % 10 == 0, None).otherwise(F.col("close")))
    out = CL.clean(gappy.withColumn("volume", F.col("volume").cast("double")), threshold=2.0)
    return out.select("symbol", "ts", *[r4(F.col(c)).alias(c) for c in (*_PRICES, "rsi", "macd", "macd_signal")],
                      F.col("day_of_week").cast("int").alias("day_of_week"), F.col("is_holiday").cast("int").alias("is_holiday"))


def _clean_pipeline_sql():
    run = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    after = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    each = lambda f: ", ".join(f"{f(c)} AS {c}" for c in _PRICES)
    whole = "OVER (PARTITION BY symbol)"
    text = f"SELECT symbol, ts, {each(lambda c: f'coalesce(last_value({c} IGNORE NULLS) {run}, first_value({c} IGNORE NULLS) {after})')} FROM ({_GAPPY_SQL}) a"
    text = (f"SELECT symbol, ts, {each(lambda c: f'CASE WHEN coalesce(abs(({c} - avg({c}) {whole}) / nullif(stddev_pop({c}) {whole}, 0)) > 2.0, false) THEN NULL ELSE {c} END')} "
            f"FROM ({text}) z")
    text = f"SELECT symbol, ts, {each(lambda c: f'last_value({c} IGNORE NULLS) {run}')} FROM ({text}) f"
    s = Sql(text)
    for c in _PRICES:
        s.rma(f"d_{c}", c, 5, alpha=2.0 / 6, minp=0)
    body = ",\n".join(f"{nm} AS ({txt})" for nm, txt in s.ctes)
    text = f"WITH RECURSIVE {body}\nSELECT symbol, ts, {', '.join(f'd_{c} AS {c}' for c in _PRICES)} FROM {s.cur}"
    s = Sql(text)
    _rsis_pre(s)
    s.cols(rsi_v="CASE WHEN la <> 0 THEN 100 - 100 / (1 + ga / la) WHEN la = 0 AND ga > 0 THEN 100.0 END")
    # the averages start at the symbol's first price (the outlier step can blank the first row)
    seen = f"count(close) {run}"
    s.cols(seen=seen)
    s.cols(seed="CASE WHEN seen = 1 AND close IS NOT NULL THEN 1 ELSE 0 END", go="CASE WHEN seen > 1 AND close IS NOT NULL THEN 1 ELSE 0 END")
    for name, share in (("ef", 2.0 / 13), ("es", 2.0 / 27)):
        s.cols(**{f"{name}_a": f"CASE WHEN go = 1 THEN {1 - share!r} ELSE 1.0 END",
                  f"{name}_b": f"CASE WHEN seed = 1 THEN close WHEN go = 1 THEN {share!r} * close ELSE 0.0 END"})
    s.rec(1, ef=("ef_a", "ef_b"), es=("es_a", "es_b"))
    s.cols(m0="ef - es")
    s.cols(sg_a=f"CASE WHEN go = 1 THEN {1 - 2.0 / 10!r} ELSE 1.0 END", sg_b=f"CASE WHEN go = 1 THEN {2.0 / 10!r} * m0 ELSE 0.0 END")
    s.rec(1, sg0=("sg_a", "sg_b"))
    s.cols(m="CASE WHEN seen > 0 THEN m0 END", sg="CASE WHEN seen > 0 THEN sg0 END")
    inner = s.sql({**{c: c for c in _PRICES}, "rsi": "rsi_v", "macd": "m", "macd_signal": "sg"})
    return (f"SELECT b.*, CAST((dayofweek(b.ts) + 6) % 7 AS INTEGER) AS day_of_week, CAST(h.hd IS NOT NULL AS INTEGER) AS is_holiday "
            f"FROM ({inner}) b LEFT JOIN ({_holiday_sql()}) h ON CAST(b.ts AS DATE) = h.hd")


SPARK["clean_pipeline_hourly"] = _clean_pipeline_spark
ORACLE["clean_pipeline_hourly"] = _clean_pipeline_sql()


def _preprocess_spark(spark, sf_dir):
    from ticklake.operators import features as FT
    out = FT.preprocess(bars_h(spark, sf_dir), seq_len=10, horizon=1, indicators=dict(bbands=(5, 2.0)))
    total = F.aggregate("X", F.lit(0.0), lambda a, row: a + F.aggregate(row, F.lit(0.0), lambda x, v: x + v))
    return out.select("symbol", "start_ts", "end_ts", F.size("X").alias("rows"), F.size(F.col("X")[0]).alias("features"),
                      r4(total).alias("x_sum"), r4(F.col("X")[9][3]).alias("last_close"), r4(F.col("y")).alias("y"))


def _preprocess_sql():
    feats = ["open", "high", "low", "close", "volume", "rsi", "macd", "macd_signal", "macd_hist", "atr", "vwap", "bb_upper", "bb_lower"]
    recipes = _recipe("rsi", "macd", "atr", "vwap", "bbands")
    raw = (f'SELECT b.symbol, b.ts, b.open, b.high, b.low, b.close, b.volume, "RSI_14" AS rsi, "MACD_12_26_9" AS macd, "MACDs_12_26_9" AS macd_signal, '
           f'"MACDh_12_26_9" AS macd_hist, "ATRr_14" AS atr, "VWAP_D" AS vwap, "BBU_5_2.0" AS bb_upper, "BBL_5_2.0" AS bb_lower '
           f"FROM ({BARS_H_SQL}) b JOIN ({_twin(recipes, raw=True)}) t ON t.symbol = b.symbol AND t.ts = b.ts")
    ends = "OVER (PARTITION BY symbol)"
    scaled = ", ".join(f"({c} - min({c}) {ends}) / (CASE WHEN max({c}) {ends} - min({c}) {ends} = 0 THEN 1.0 ELSE max({c}) {ends} - min({c}) {ends} END) AS {c}" for c in feats)
    w10 = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
    return (f"WITH s AS (SELECT symbol, ts, {scaled} FROM ({raw}) r), k AS (SELECT *, {' + '.join(feats)} AS t FROM s WHERE {' AND '.join(f'{c} IS NOT NULL' for c in feats)}), "
            f"q AS (SELECT symbol, first_value(ts) {w10} AS start_ts, ts AS end_ts, count(*) {w10} AS n, sum(t) {w10} AS x_sum, close, "
            f"lead(close) OVER (PARTITION BY symbol ORDER BY ts) AS y FROM k) "
            f"SELECT symbol, start_ts, end_ts, 10 AS rows, {len(feats)} AS features, {_sr4('x_sum')} AS x_sum, {_sr4('close')} AS last_close, {_sr4('y')} AS y "
            f"FROM q WHERE n = 10 AND y IS NOT NULL")


SPARK["preprocess_sequences_hourly"] = _preprocess_spark
ORACLE["preprocess_sequences_hourly"] = _preprocess_sql()


def _geo_spark(spark, sf_dir):
    from ticklake.operators.metrics import geometric_mean
    return geometric_mean(bars_h(spark, sf_dir), "close").select("symbol", r4(F.col("geometric_mean")).alias("geometric_mean"))


SPARK["geometric_mean_hourly"] = _geo_spark
ORACLE["geometric_mean_hourly"] = f"SELECT symbol, {_sr4('exp(avg(ln(close)))')} AS geometric_mean FROM ({BARS_H_SQL}) b GROUP BY symbol"


def _error_spark(spark, sf_dir):
    from ticklake.operators.metrics import df_error_analysis
    b = bars_h(spark, sf_dir)
    return df_error_analysis(b, b.withColumn("close", F.col("close") + F.col("high")), "close").select(r4(F.col("corr")).alias("corr"))


SPARK["error_analysis_hourly"] = _error_spark
ORACLE["error_analysis_hourly"] = f"SELECT {_sr4('corr(close, close + high)')} AS corr FROM ({BARS_H_SQL}) b"


def _value_cross_sql(s):
    up = f"coalesce(close > 50 AND {lag('close', 1)} < 50, false)"
    return {"close_A_50": "CAST(close >= 50 AS INTEGER)", "close_B_50": "CAST(close <= 50 AS INTEGER)", "close_XA_50": f"CAST({up} AS INTEGER)"}


ind("value_crossings_hourly", "h",
    [dict(kind="above_value", series_a="close", value=50), dict(kind="below_value", series_a="close", value=50),
     dict(kind="cross_value", series_a="close", value=50)], _value_cross_sql, ["close_A_50", "close_B_50", "close_XA_50"],
    ints=("close_A_50", "close_B_50", "close_XA_50"))


def _alpha_spark(spark, sf_dir):
    from ticklake.operators.metrics import jensens_alpha
    b = bars_h(spark, sf_dir).where(~((F.col("symbol") == "view") & (F.hour("ts") % 5 == 0)))  # the benchmark has gaps
    return jensens_alpha(b, "view").select("symbol", r4(F.col("jensens_alpha")).alias("jensens_alpha"), r4(F.col("beta")).alias("beta"))


SPARK["jensens_alpha_hourly"] = _alpha_spark
ORACLE["jensens_alpha_hourly"] = f"""
WITH b AS (SELECT * FROM ({BARS_H_SQL}) x WHERE NOT (symbol = 'view' AND extract('hour' FROM ts) % 5 = 0)),
r AS (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM b),
g AS (SELECT t.ts, v.r AS v, row_number() OVER (ORDER BY t.ts) AS n FROM (SELECT DISTINCT ts FROM r) t LEFT JOIN (SELECT * FROM r WHERE symbol = 'view') v ON v.ts = t.ts),
w AS (SELECT *, last_value(v IGNORE NULLS) OVER f AS pv, last_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER f AS pn,
  first_value(v IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER a AS nn FROM g
  WINDOW f AS (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i AS (SELECT ts, coalesce(v, pv + (nv - pv) * (n - pn) / nullif(nn - pn, 0), pv) AS v FROM w)
SELECT r.symbol, {_sr4('regr_intercept(r.r, i.v)')} AS jensens_alpha, {_sr4('regr_slope(r.r, i.v)')} AS beta FROM r JOIN i ON i.ts = r.ts GROUP BY r.symbol"""


# ---------------------------------------------------------------- option variants and trades
def _risk_spark(**options):
    def run(spark, sf_dir):
        from ticklake.operators.metrics import risk_ratios
        m = risk_ratios(bars_w(spark, sf_dir), **options)
        return m.select("symbol", "n", "optimal_leverage", *[r4(F.col(c)).alias(c) for c in ("mean_return", "volatility", "sharpe_ratio")])
    return run


def _risk_sql(log, use_cagr, period, rate):
    from ticklake.oracle_sql import r4 as sr4
    step = "close / NULLIF(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0)"
    ret = f"ln(CASE WHEN {step} > 0 THEN {step} END)" if log else f"{step} - 1"
    excess, dev = f"({period} * mr - {rate})", f"(sqrt({period}) * sr)"
    vol = "(sqrt(n / NULLIF(yrs, 0)) * sr)"
    sharpe = f"(power(lc / fc, 1.0 / NULLIF(yrs, 0)) - 1) / NULLIF({vol}, 0)" if use_cagr else f"{excess} / NULLIF({dev}, 0)"
    return f"""
WITH r AS (SELECT symbol, ts, close, {ret} AS r FROM ({BARS_W_SQL}) x),
a AS (SELECT symbol, count(*) AS n, avg(r) AS mr, stddev_samp(r) AS sr, arg_min(close, ts) AS fc, arg_max(close, ts) AS lc,
             floor((epoch(max(ts)) - epoch(min(ts))) / 86400.0) / 252.0 AS yrs FROM r GROUP BY symbol)
SELECT symbol, CAST(n AS BIGINT) AS n, {sr4('mr')} AS mean_return, {sr4(vol)} AS volatility, {sr4(sharpe)} AS sharpe_ratio,
       CAST(trunc({excess} / NULLIF({dev} * {dev}, 0)) AS BIGINT) AS optimal_leverage FROM a"""


for _name, _o in {"risk_ratios_log_weekly": dict(log=True, use_cagr=False, period=52, benchmark_rate=0.01),
                  "risk_ratios_cagr_weekly": dict(log=False, use_cagr=True, period=252, benchmark_rate=0.0)}.items():
    SPARK[_name] = _risk_spark(**_o)
    ORACLE[_name] = _risk_sql(_o["log"], _o["use_cagr"], _o["period"], _o["benchmark_rate"])


def _regression_spark(spark, sf_dir):
    from ticklake.operators.metrics import linear_regression
    m = linear_regression(bars_w(spark, sf_dir), "volume", "close", ["symbol"])
    return m.select("symbol", "n", *[r4(F.col(c)).alias(c) for c in ("a", "b", "r", "t")])


def _regression_sql():
    from ticklake.oracle_sql import r4 as sr4
    cols = {"a": "a", "b": "b", "r": "r", "t": "r / NULLIF(sqrt(greatest(1 - r * r, 0) / NULLIF(greatest(n - 2, 0), 0)), 0)"}
    return f"""
WITH g AS (SELECT symbol, count(*) AS n, regr_intercept(close, volume) AS a, regr_slope(close, volume) AS b, corr(close, volume) AS r
           FROM ({BARS_W_SQL}) x WHERE close IS NOT NULL AND volume IS NOT NULL GROUP BY symbol)
SELECT symbol, CAST(n AS BIGINT) AS n, {', '.join(f'{sr4(e)} AS {k}' for k, e in cols.items())} FROM g"""


SPARK["linear_regression_weekly"] = _regression_spark
ORACLE["linear_regression_weekly"] = _regression_sql()


def _crossed(spark, sf_dir):
    """Hourly bars with the trend "short average above the long one" and its entries and exits."""
    f = SeriesFrame(bars_h(spark, sf_dir), lookback=30)
    R.run(f, [dict(kind="sma", length=5), dict(kind="sma", length=20)])
    f.with_columns({"TS_Trends": F.coalesce((F.col("SMA_5") > F.col("SMA_20")).cast("int"), F.lit(0))})
    before = F.lag("TS_Trends").over(f.w)
    f.with_columns({"TS_Trades": F.when(before.isNull(), 0).otherwise(F.col("TS_Trends") - before)})
    return f.result()


_TRADES_SQL = f"""
WITH s AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn,
  avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS fast,
  avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS slow FROM ({BARS_H_SQL}) x),
t AS (SELECT *, CASE WHEN rn >= 20 AND fast > slow THEN 1 ELSE 0 END AS trend FROM s),
u AS (SELECT *, coalesce(trend - lag(trend) OVER (PARTITION BY symbol ORDER BY ts), 0) AS trade FROM t)"""


def _trade_table_spark(spark, sf_dir):
    from ticklake.operators.signals import trade_table
    t = trade_table(_crossed(spark, sf_dir))
    return t.select("symbol", "ts", F.col("trade").cast("int").alias("trade"), r4(F.col("entry_price")).alias("entry_price"),
                    r4(F.col("exit_price")).alias("exit_price"))


def _trade_summary_spark(spark, sf_dir):
    from ticklake.operators.signals import trade_summary
    t = trade_summary(_crossed(spark, sf_dir))
    return t.select("symbol", r4(F.col("coverage")).alias("coverage"), *[F.col(c).cast("long").alias(c) for c in ("entries", "exits", "round_trips")])


def _trade_sql():
    from ticklake.oracle_sql import r4 as sr4
    table = (f"{_TRADES_SQL} SELECT symbol, ts, CAST(trade AS INTEGER) AS trade, {sr4('CASE WHEN trade > 0 THEN close END')} AS entry_price, "
             f"{sr4('CASE WHEN trade < 0 THEN close END')} AS exit_price FROM u WHERE trade <> 0")
    summary = (f"{_TRADES_SQL}, g AS (SELECT symbol, avg(trend) AS c, count(*) FILTER (trade > 0) AS e, count(*) FILTER (trade < 0) AS x FROM u GROUP BY symbol) "
               f"SELECT symbol, {sr4('c')} AS coverage, CAST(e AS BIGINT) AS entries, CAST(x AS BIGINT) AS exits, CAST(least(e, x) AS BIGINT) AS round_trips FROM g")
    return table, summary


SPARK["trade_table_hourly"], SPARK["trade_summary_hourly"] = _trade_table_spark, _trade_summary_spark
ORACLE["trade_table_hourly"], ORACLE["trade_summary_hourly"] = _trade_sql()


# ---------------------------------------------------------------- cleaning counters
def _clean_counters_spark(spark, sf_dir):
    """What every step of the cleaning pipeline did, observed while its rows were written."""
    b = bars_h(spark, sf_dir)
    gappy = b.withColumn("close", F.when((F.unix_seconds("ts") / 3600).cast("long") % 10 == 0, None).otherwise(F.col("close")))
    counters = CL.CleaningCounters()
    CL.clean(gappy.withColumn("volume", F.col("volume").cast("double")), threshold=2.0, span=None, rsi_window=None, macd=None,
             counters=counters).write.format("noop").mode("overwrite").save()
    return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in counters.read().items()])


def _clean_counters_sql():
    whole = "OVER (PARTITION BY symbol)"
    run = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    after = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    filled = ", ".join(f"coalesce(last_value({c} IGNORE NULLS) {run}, first_value({c} IGNORE NULLS) {after}) AS {c}" for c in _PRICES)
    nulls = lambda: " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in _PRICES)
    z = ", ".join(f"abs(({c} - avg({c}) {whole}) / NULLIF(stddev_pop({c}) {whole}, 0)) > 2.0 AS {c}" for c in _PRICES)
    bad = " + ".join(f"count(*) FILTER ({c})" for c in _PRICES)
    return (f"WITH a AS ({_GAPPY_SQL}), b AS (SELECT symbol, ts, {filled} FROM a), z AS (SELECT {z} FROM b), "
            f"n AS (SELECT count(*) AS rows, {nulls()} AS m FROM a), l AS (SELECT {nulls()} AS m FROM b), o AS (SELECT {bad} AS k FROM z) "
            f"SELECT CAST(n.rows AS BIGINT) AS rows, CAST(n.m AS BIGINT) AS missing_before, CAST(n.m - l.m AS BIGINT) AS missing_imputed, "
            f"CAST(o.k AS BIGINT) AS outliers_removed, CAST(0 AS BIGINT) AS anomalies_removed FROM n, l, o")


SPARK["clean_counters_hourly"] = _clean_counters_spark
ORACLE["clean_counters_hourly"] = _clean_counters_sql()


# ---------------------------------------------------------------- isolation forest
def _forest_spark(spark, sf_dir):
    """What must hold for the scores of all hourly bars, whatever the trees: every row is scored, scores lie between
    0 and 1, equal values score alike, and the rows removed are the highest-scored share."""
    from ticklake.session import written
    cols = list(_PRICES)
    bars = bars_h(spark, sf_dir).select("symbol", "ts", *[F.col(c).cast("double").alias(c) for c in cols])
    scored = written(CL.anomaly_scores(bars, cols), "scored")
    limit = scored.agg(F.percentile_approx("anomaly_score", 0.9, 100000)).first()[0]
    apart = scored.groupBy(*cols).agg((F.max("anomaly_score") - F.min("anomaly_score")).alias("apart")).agg(F.max("apart")).first()[0]
    inside = F.col("anomaly_score") <= F.lit(limit)
    share = scored.agg(F.avg(inside.cast("int"))).first()[0]
    return scored.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("anomaly_score").between(0, 1)).alias("scored")).select(
        "symbol", "rows", "scored", F.lit((apart or 0.0) <= 1e-12).alias("alike"), F.lit(share is not None and 0.9 <= share < 0.92).alias("kept_share"))


SPARK["isolation_forest_hourly"] = _forest_spark
ORACLE["isolation_forest_hourly"] = (
    f"SELECT symbol, count(*) AS rows, count(*) AS scored, true AS alike, true AS kept_share FROM ({BARS_H_SQL}) b GROUP BY symbol")


# ---------------------------------------------------------------- long windows and exact quartiles
_LONG = 100


def _long_windows_spark(spark, sf_dir):
    from ticklake.functions import blocks as B
    f = SeriesFrame(_gappy(spark, sf_dir), segment="36 hours", lookback=_LONG)
    aggs = {"hi": "max", "lo": "min", "mean": "avg", "dev": "std", "total": "sum"}
    f.with_columns({k: B.roll(f, "close", _LONG, a, minp=_LONG // 2) for k, a in aggs.items()})
    return f.result(["symbol", "ts", *aggs]).select("symbol", "ts", *[r4(F.col(k)).alias(k) for k in aggs])


def _long_windows_sql():
    from ticklake.oracle_sql import r4 as sr4
    win = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {_LONG - 1} PRECEDING AND CURRENT ROW)"
    aggs = {"hi": "max", "lo": "min", "mean": "avg", "dev": "stddev_samp", "total": "sum"}
    return (f"WITH r AS (SELECT symbol, ts, count(close) {win} AS n, {', '.join(f'{a}(close) {win} AS {k}' for k, a in aggs.items())} "
            f"FROM ({GAPPY_SQL}) b) SELECT symbol, ts, {', '.join(f'{sr4(f'CASE WHEN n >= {_LONG // 2} THEN {k} END')} AS {k}' for k in aggs)} FROM r")


SPARK["long_windows_hourly"] = _long_windows_spark
ORACLE["long_windows_hourly"] = _long_windows_sql()

_RANKED = {"mid": "q0.5", "high_tenth": "q0.9", "away": "mad"}


def _long_ranks_spark(spark, sf_dir):
    from ticklake.functions import blocks as B
    f = SeriesFrame(_gappy(spark, sf_dir), segment="36 hours", lookback=_LONG)
    f.with_columns({k: B.roll(f, "close", _LONG, a, minp=_LONG // 2) for k, a in _RANKED.items()})
    return f.result(["symbol", "ts", *_RANKED]).select("symbol", "ts", *[r4(F.col(k)).alias(k) for k in _RANKED])


def _long_ranks_sql():
    from ticklake.oracle_sql import r4 as sr4
    win = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {_LONG - 1} PRECEDING AND CURRENT ROW)"
    full = f"CASE WHEN n >= {_LONG // 2} THEN {{}} END"
    return (f"WITH r AS (SELECT symbol, ts, count(close) {win} AS n, quantile_cont(close, 0.5) {win} AS mid, quantile_cont(close, 0.9) {win} AS high_tenth, "
            f"avg(close) {win} AS mean, list_filter(list(close) {win}, lambda v: v IS NOT NULL) AS held FROM ({GAPPY_SQL}) b) "
            f"SELECT symbol, ts, {sr4(full.format('mid'))} AS mid, {sr4(full.format('high_tenth'))} AS high_tenth, "
            f"{sr4(full.format('list_avg(list_transform(held, lambda v: abs(v - mean)))'))} AS away FROM r")


SPARK["long_ranks_hourly"] = _long_ranks_spark
ORACLE["long_ranks_hourly"] = _long_ranks_sql()


def _quartiles_spark(spark, sf_dir):
    """Quartiles of all ticks of an event type, exact whatever its size."""
    from ticklake.operators.selection import exact_quantiles
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), "value")
    q = exact_quantiles(ev, "symbol", ["value"], [0.25, 0.5, 0.75])
    return q.select("symbol", *[r4(F.get("value", F.lit(i))).alias(n) for i, n in enumerate(("q1", "q2", "q3"))])


SPARK["exact_quartiles_ticks"] = _quartiles_spark
ORACLE["exact_quartiles_ticks"] = (
    "SELECT event_type AS symbol, " + ", ".join(f"{_sr4(f'quantile_cont(value, {p})')} AS {n}" for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75)))
    + " FROM events GROUP BY event_type")


# ---------------------------------------------------------------- cache merged in place
def _cache_merge_spark(spark, sf_dir):
    """A cache of the first bars, two deltas that overlap it (the second one comes twice), read again."""
    from ticklake.session import scratch_path
    from ticklake.sources.cache import BarCache
    b = bars_h(spark, sf_dir).select("symbol", "ts", "close", "volume")
    at = lambda d: F.lit(d).cast("timestamp")
    cache = BarCache(spark, scratch_path(spark, "bar-cache"), unit="day")
    cache.merge(b.where(F.col("ts") < at("2024-01-21")))
    first = b.where(F.col("ts").between(at("2024-01-20"), at("2024-01-25"))).withColumn("close", F.col("close") + 1000.0)
    second = b.where(F.col("ts") >= at("2024-01-24 12:00:00")).withColumn("close", F.col("close") + 2000.0)
    for delta in (first, second, second):
        cache.merge(delta)
    return cache.read().select("symbol", "ts", r4(F.col("close")).alias("close"), F.col("volume").cast("long").alias("volume"))


SPARK["cache_merge_hourly"] = _cache_merge_spark
ORACLE["cache_merge_hourly"] = (
    f"WITH b AS ({BARS_H_SQL}), u AS (SELECT symbol, ts, close, volume, 0 AS p FROM b WHERE ts < TIMESTAMP '2024-01-21' "
    "UNION ALL SELECT symbol, ts, close + 1000.0, volume, 1 FROM b WHERE ts BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-25' "
    "UNION ALL SELECT symbol, ts, close + 2000.0, volume, 2 FROM b WHERE ts >= TIMESTAMP '2024-01-24 12:00:00') "
    f"SELECT symbol, ts, {_sr4('arg_max(close, p)')} AS close, CAST(arg_max(volume, p) AS BIGINT) AS volume FROM u GROUP BY symbol, ts")


# ---------------------------------------------------------------- streaming composite
def _stream_composite_spark(spark, sf_dir):
    """The bars of all event types as five streams, joined and filled; equals the batch composite join."""
    from ticklake.streaming.composite import run_filled
    path = SJ.rows_in_order(bars_h(spark, sf_dir), "bars-in-order")
    rows = spark.read.parquet(path)

    def side(symbol):
        t = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
        own = t.where(F.col("symbol") == symbol)
        return own.select("ts", *[F.col(c) for c in _BC])

    closing = (spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
               .where(F.col("symbol") == SJ.CLOSING).select("ts", F.lit(1).alias("closing")))
    out = run_filled({**{s: side(s) for s in _ALL_EVENTS}, "end": closing}, "bars")
    return out.where("closing IS NULL").select("ts", *[r4(F.col(f"{c}_{s}")).alias(f"{c}_{s}") for s in _ALL_EVENTS for c in _BC])


SPARK["stream_composite_filled_hourly"] = _stream_composite_spark
ORACLE["stream_composite_filled_hourly"] = ORACLE["composite_outer_join_hourly"]


# ---------------------------------------------------------------- streaming forest
_FOREST = dict(refit_every=1000, window=1000, n_trees=50, contamination=0.05)


def _stream_forest_spark(spark, sf_dir):
    """Anomalies of the ticks, removed in four micro-batches and in a single batch: per symbol the rows that no forest
    judges (all kept), whether both ways keep the same rows, and whether the share kept is near the one asked for."""
    from ticklake.session import written
    from ticklake.streaming.forest import run_forest
    ticks = lambda df: df.where(F.col("event_type") != SJ.CLOSING).select(
        F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").cast("double").alias("value"))
    path = SJ.events_in_order(spark, sf_dir)
    stream = run_forest(ticks(SJ.ordered_stream(spark, path)), ["value"], "ticks", **_FOREST)
    at_once = written(ticks(spark.read.parquet(path)), "ticks")
    batch = run_forest(at_once, ["value"], "ticks-once", **_FOREST)
    first = -(-_FOREST["window"] // _FOREST["refit_every"]) * _FOREST["refit_every"]
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("ts", "value", F.xxhash64("symbol", "ts", "event_id", "value")))
    ids = lambda df, name: df.select("event_id", F.lit(True).alias(name))
    rows = at_once.withColumn("n", n).join(ids(stream, "one"), "event_id", "left").join(ids(batch, "two"), "event_id", "left")
    one, two = F.coalesce("one", F.lit(False)), F.coalesce("two", F.lit(False))
    judged = F.col("n") > first
    share = F.try_divide(F.count_if(judged & one), F.count_if(judged))
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~judged & one).alias("passed"), F.bool_and(one == two).alias("same_as_one_batch"),
        F.coalesce(share.between(0.85, 0.99), F.lit(True)).alias("share_near"))


SPARK["stream_forest_ticks"] = _stream_forest_spark
ORACLE["stream_forest_ticks"] = (
    "SELECT event_type AS symbol, count(*) AS rows, least(count(*), 1000) AS passed, true AS same_as_one_batch, true AS share_near "
    "FROM events GROUP BY event_type")


# ---------------------------------------------------------------- watchlist, whole buffer
def _ticker_files(spark, bars, tf):
    """One CSV file per symbol, named after symbol and time frame.

    Every task writes the files of its symbols straight under their names.  In a store that only Spark opens, Spark's
    own writer makes them, and they get their names one after another.
    """
    import uuid

    import pyarrow as pa
    from pyarrow import fs as stores

    from ticklake.session import scratch_path
    root = scratch_path(spark, "watchlist")
    try:
        stores.FileSystem.from_uri(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return _renamed_files(spark, bars, tf, root)
    head = ",".join(bars.columns) + "\n"

    def write(batches):
        store, folder = stores.FileSystem.from_uri(root)
        store.create_dir(f"{folder}/files", recursive=True)
        out, ticker, own = None, None, f"{folder}/files/.{uuid.uuid4().hex}"

        def done():
            out.close()
            store.move(own, f"{folder}/files/{ticker}_{tf}.csv")

        for b in batches:
            names, lines = b.column("ticker").to_pylist(), b.column("line").to_pylist()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i < j and (out is None or names[i] != ticker):
                    if out is not None:
                        done()
                    ticker, out = names[i], store.open_output_stream(own)
                    out.write(head.encode())
                out.write("".join(f"{x}\n" for x in lines[i:j]).encode())
            yield pa.record_batch([pa.array([len(names)], pa.int64())], names=["lines"])
        if out is not None:
            done()

    lines = bars.select(F.upper("symbol").alias("ticker"), F.to_csv(F.struct(*bars.columns)).alias("line"))
    lines.repartition("ticker").sortWithinPartitions("ticker").mapInArrow(write, "lines long").agg(F.sum("lines")).first()
    return f"{root}/files"


def _renamed_files(spark, bars, tf, root):
    path = spark._jvm.org.apache.hadoop.fs.Path
    bars.withColumn("ticker", F.upper("symbol")).repartition("ticker").write.partitionBy("ticker").option("header", True).csv(f"{root}/parts")
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{root}/files"))
    for part in fs.globStatus(path(f"{root}/parts/ticker=*/part-*.csv")):  # one per ticker
        ticker = part.getPath().getParent().getName().split("=", 1)[1]
        fs.rename(part.getPath(), path(f"{root}/files/{ticker}_{tf}.csv"))
    return f"{root}/files"


def _watchlist_spark(spark, sf_dir):
    """The common strategy over a watchlist of CSV files, one per symbol."""
    bars = bars_w(spark, sf_dir)
    folder = _ticker_files(spark, bars, "W")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields)
    tickers = [r["symbol"] for r in bars.select("symbol").distinct().collect()]  # the watchlist itself
    out = ST.run_watchlist(spark, folder, tickers=tickers, tf="W", schema=schema)
    cols = ["SMA_10", "SMA_20", "SMA_50", "SMA_200", "VOLUME_SMA_20"]
    return out.select(F.lower("symbol").alias("symbol"), "ts", *[r4(F.col(c)).alias(c) for c in cols])


SPARK["watchlist_common_strategy_weekly"] = _watchlist_spark
ORACLE["watchlist_common_strategy_weekly"] = ORACLE["common_strategy_weekly"]


def _whole_buffer_spark(spark, sf_dir):
    recs = SJ.ordered_stream(spark, SJ.events_in_order(spark, sf_dir)).where(F.col("event_type") != SJ.CLOSING).select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("close"),
        F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("open"))
    out = SJ.run_to_table(SJ.whole_buffer(recs, buffer_size=4, window=6), "stream-whole")
    return out.select("symbol", "number", "ts", r4(F.col("close")).alias("close"), r4(F.col("open")).alias("open"))


SPARK["stream_whole_buffer_ticks"] = _whole_buffer_spark
ORACLE["stream_whole_buffer_ticks"] = (
    "WITH e AS (SELECT event_type AS symbol, CAST(ts AS TIMESTAMP) AS ts, value AS close, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS open, "
    "row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rn FROM events), "
    "b AS (SELECT a.rn AS number, e.* FROM e a JOIN e ON a.symbol = e.symbol AND e.rn BETWEEN a.rn - 5 AND a.rn WHERE a.rn >= 4) "
    f"SELECT symbol, number, ts, {_sr4('close')} AS close, "
    f"{_sr4('coalesce(last_value(open IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(open IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')}"
    " AS open FROM b WINDOW w AS (PARTITION BY symbol, number ORDER BY rn)")
