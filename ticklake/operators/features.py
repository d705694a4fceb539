"""Feature building: indicator bundle, per-symbol scaling, model sequences.

``preprocess`` is the per-symbol transform of the reference as one
DataFrame plan: lower-case -> validate -> forward fill -> indicators ->
custom features -> scale -> drop nulls -> sequences.  Sequences are built
with a bounded ROWS frame (``collect_list`` over the last L rows) plus a
``lead`` for the target, so no symbol is ever gathered into one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklake.functions import blocks as B
from ticklake.functions.blocks import C, dv
from ticklake.operators import clean as CL
from ticklake.operators.registry import _advance_all, run as run_specs
from ticklake.plans.frame import SeriesFrame

# Columns the reference accepts as model features.
FEATURES = ["open", "high", "low", "close", "volume", "rsi", "macd", "macd_signal", "macd_hist", "atr", "vwap",
            "bb_upper", "bb_lower", "sentiment", "esg_score"]
NEVER = ("ticker", "symbol", "date", "timestamp", "ts")


def indicator_bundle(f: SeriesFrame, rsi: int | None = 14, macd=(12, 26, 9), atr: int | None = 14,
                     vwap: bool = True, bbands=(20, 2.0), fill: dict | None = None) -> SeriesFrame:
    """rsi, macd / macd_signal / macd_hist, atr, vwap, bb_upper / bb_lower,
    each with its fill policy (``ffill`` / ``zero`` / None), in one fused
    plan (all indicators share the scan passes)."""
    fill = fill or {}
    specs, rename = [], {}
    if rsi:
        specs.append(dict(kind="rsi", length=rsi))
        rename[f"RSI_{rsi}"] = "rsi"
    if macd:
        fa, sl, sg = macd
        specs.append(dict(kind="macd", fast=fa, slow=sl, signal=sg))
        rename.update({f"MACD_{fa}_{sl}_{sg}": "macd", f"MACDs_{fa}_{sl}_{sg}": "macd_signal",
                       f"MACDh_{fa}_{sl}_{sg}": "macd_hist"})
    if atr:
        specs.append(dict(kind="atr", length=atr))
        rename[f"ATRr_{atr}"] = "atr"
    if vwap:
        specs.append(dict(kind="vwap"))
        rename["VWAP_D"] = "vwap"
    if bbands:
        n, sd = bbands
        specs.append(dict(kind="bbands", length=n, std=float(sd)))
        rename.update({f"BBU_{n}_{float(sd)}": "bb_upper", f"BBL_{n}_{float(sd)}": "bb_lower"})
    run_specs(f, specs)
    from ticklake.operators.registry import safe
    f.with_columns({new: F.col(safe(old)) for old, new in rename.items()})
    f.df = f.df.drop(*[safe(k) for k in rename])
    groups = {"rsi": ["rsi"], "macd": ["macd", "macd_signal", "macd_hist"], "atr": ["atr"], "vwap": ["vwap"],
              "bollinger_bands": ["bb_upper", "bb_lower"]}
    ff, zero = [], []
    for g, cols in groups.items():
        pol = fill.get(g)
        cols = [c for c in cols if c in f.df.columns]
        (ff if pol == "ffill" else zero if pol == "zero" else []).extend(cols)
    if zero:
        f.with_columns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in zero})
    if ff:
        def gen(f):
            ys = yield tuple(B.ffill(f, c) for c in ff)
            return dict(zip(ff, ys))
        f.with_columns(_advance_all(f, [(gen, {}, {})]))
    return f


def scale(df: DataFrame, cols: list[str], method: str = "minmax", symbol: str = "symbol") -> DataFrame:
    """Per-symbol min-max (constant column -> 0) or z-score (population std;
    std 0 -> divide by 1) over the symbol's whole history.  Statistics are one
    map-side-combinable aggregate joined back.  Uses the whole history (look
    ahead), as the reference does; scale on a training slice to avoid it."""
    if method is None or not cols:
        return df
    aggs = []
    for c in cols:
        if method == "minmax":
            aggs += [F.min(c).alias(f"__a_{c}"), F.max(c).alias(f"__b_{c}")]
        elif method in ("zscore", "standard"):
            aggs += [F.avg(c).alias(f"__a_{c}"), F.stddev_pop(c).alias(f"__b_{c}")]
        else:
            raise ValueError(method)
    st = df.groupBy(symbol).agg(*aggs)
    out = df.join(st, symbol, "left")
    new = {}
    for c in cols:
        a, b = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        if method == "minmax":
            rng = b - a
            new[c] = (C(c) - a) / F.when(rng == 0, F.lit(1.0)).otherwise(rng)
        else:
            new[c] = (C(c) - a) / F.when(b == 0, F.lit(1.0)).otherwise(b)
    return out.withColumns(new).drop(*[x for c in cols for x in (f"__a_{c}", f"__b_{c}")])


def sequences(df: DataFrame, features: list[str], seq_len: int, horizon: int = 1, target: str = "close",
              symbol: str = "symbol", ts: str = "ts", segment="auto") -> DataFrame:
    """One row per window: ``X`` = the ``seq_len`` rows ending at ``ts`` as
    array<array<double>> (rows x features), ``y`` = ``target`` ``horizon``
    rows after the window.  T - L - h + 1 rows per symbol; a symbol shorter
    than L + h yields none (the reference raises)."""
    f = SeriesFrame(df, symbol, ts, segment=segment, lookback=seq_len, lookahead=horizon)
    row = F.array(*[C(c).cast("double") for c in features])
    w = f.rows(seq_len)
    f.with_columns({"X": F.collect_list(row).over(w), "__cnt": F.count(F.lit(1)).over(w),
                    "y": B.lag(f, target, -horizon), "__start_ts": F.first(ts).over(w)})
    out = f.result(keep=[symbol, ts, "__start_ts", "X", "y", "__cnt"])
    return (out.filter((F.col("__cnt") == seq_len) & F.col("y").isNotNull())
            .select(symbol, F.col("__start_ts").alias("start_ts"), F.col(ts).alias("end_ts"), "X",
                    F.col("y").cast("double").alias("y")))


def custom_features(df: DataFrame, sentiment: bool = False, esg: str | None = None) -> DataFrame:
    out = df
    if sentiment:
        out = (out.withColumn("sentiment", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sentiment"))))
               if "sentiment" in out.columns else out.withColumn("sentiment", F.lit(0.0)))
    if esg:
        if "esg_score" not in out.columns:
            out = out.withColumn("esg_score", F.lit(0.0))
        else:
            out = scale(out, ["esg_score"], esg)
    return out


def preprocess(df: DataFrame, seq_len: int = 60, horizon: int = 1, normalization: str | None = "minmax",
               symbol: str = "symbol", ts: str = "ts", indicators: dict | None = None, sentiment: bool = False,
               esg: str | None = None, segment="auto") -> DataFrame:
    """Per-symbol transform into model-ready sequences (one plan, no dict of
    per-symbol frames)."""
    df = CL.lower_columns(df)
    CL.require_columns(df, CL.OHLCV, case_insensitive=True)
    if "ticker" in df.columns and symbol not in df.columns:
        df = df.withColumnRenamed("ticker", symbol)
    if "date" in df.columns and ts not in df.columns:
        df = df.withColumn(ts, F.col("date").cast("timestamp")).drop("date")
    base = [c for c in CL.OHLCV if c in df.columns]
    f = SeriesFrame(df, symbol, ts, segment=segment, lookback=300)

    def fill(f):
        ys = yield tuple(B.ffill(f, c) for c in base)
        return dict(zip(base, ys))

    f.with_columns(_advance_all(f, [(fill, {}, {})]))
    ind = {} if indicators is None else indicators
    if ind is not False:
        indicator_bundle(f, **ind)
    out = custom_features(f.result(), sentiment, esg)
    feats = [c for c in FEATURES if c in out.columns and c not in NEVER]
    out = scale(out, [c for c in feats], normalization, symbol) if normalization else out
    out = out.dropna(subset=feats)
    return sequences(out, feats, seq_len, horizon, "close", symbol, ts, segment)


def preprocess_file(spark, path: str, **options) -> DataFrame:
    """``preprocess`` of bars in a CSV file or folder with a header."""
    from ticklake.sources.loaders import load_csv
    return preprocess(load_csv(spark, path), **options)
