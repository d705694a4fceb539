"""Call options, joins and the less common indicators against plain pandas."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticklake.operators import joins, metrics
from ticklake.operators.overlap import ichimoku_span
from ticklake.operators.strategy import run_strategy, ta
from ticklake.operators.volume import vp
from ticklake.sources.loaders import read_json_records


@pytest.fixture(scope="module")
def one(spark, bars_h):
    return bars_h.where("symbol = 'click'").cache()


@pytest.fixture(scope="module")
def pdf(one):
    return one.toPandas().sort_values("ts").reset_index(drop=True)


def got(df):
    return df.toPandas().sort_values("ts").reset_index(drop=True)


def same(a, b):
    assert np.allclose(np.asarray(a, float), np.asarray(b, float), rtol=1e-9, atol=1e-9, equal_nan=True)


def test_column_options(one, pdf):
    out = got(ta(one, "bbands", col_numbers=(0, 2), prefix="P"))
    assert [c for c in out.columns if "BB" in c] == ["P_BBL_5_2.0", "P_BBU_5_2.0"]
    out = got(ta(one, "sma", length=10, fill_method="bfill"))
    same(out["SMA_10"], pdf.close.rolling(10).mean().bfill())
    out = got(ta(one, "mom", length=5, offset=2, fill_method="ffill"))
    same(out["MOM_5"], pdf.close.diff(5).shift(2).ffill())
    with pytest.raises(ValueError):
        ta(one, "sma", fill_method="sideways")
    assert "SMA_500" in got(ta(one, "sma", length=500)).columns


def test_signal_indicators(one):
    out = got(ta(one, "rsi", signal_indicators=True, xa=60))
    same(out["RSI_14_A_60"], out["RSI_14"] >= 60)
    same(out["RSI_14_B_20"], out["RSI_14"] <= 20)
    out = got(ta(one, "macd", signal_indicators=True))
    h, m = out["MACDh_12_26_9"], out["MACD_12_26_9"]
    same(out["MACDh_12_26_9_XA_0"], (h > 0) & (h.shift() < 0))
    same(out["MACD_12_26_9_A_0"], m >= 0)
    with pytest.raises(ValueError):
        ta(one, "sma", signal_indicators=True)


def test_price_column_override_skips_indicators_without_it(one):
    df = one.withColumn("adj_close", F.col("close") * 2)
    out = got(run_strategy(df, [dict(kind="ao"), dict(kind="sma")], close="adj_close"))
    same(out["SMA_10"], out["adj_close"].rolling(10).mean())


def test_hilo(one, pdf):
    out = got(ta(one, "hilo", high_length=5, low_length=8))
    ha, la = pdf.high.rolling(5).mean(), pdf.low.rolling(8).mean()
    line, long, short = (np.full(len(pdf), np.nan) for _ in range(3))
    for i in range(1, len(pdf)):
        if pdf.close[i] > ha[i - 1]:
            line[i] = long[i] = la[i]
        elif pdf.close[i] < la[i - 1]:
            line[i] = short[i] = ha[i]
        else:
            line[i] = long[i] = short[i] = line[i - 1]
    same(out["HILO_5_8"], line)
    same(out["HILOl_5_8"], long)
    same(out["HILOs_5_8"], short)


def test_squeeze_detailed(one):
    out = got(ta(one, "squeeze", detailed=True))
    s = out["SQZ_20_2.0_20_1.5"]
    pos, neg = s[s >= 0].diff(), s[s < 0].diff()
    nan0 = lambda v: v.where(v != 0)
    same(out["SQZ_PINC"], nan0(s.where(pos.reindex(s.index) > 0)))
    same(out["SQZ_PDEC"], nan0(s.where(pos.reindex(s.index) < 0)))
    same(out["SQZ_NINC"], nan0(s.where(neg.reindex(s.index) > 0)))
    same(out["SQZ_NDEC"], nan0(s.where(neg.reindex(s.index) < 0)))
    same(out["SQZ_INC"], nan0(s.where(s.diff() > 0)))


def test_volume_by_price(one, pdf):
    out = vp(one, width=6, sort_close=True).toPandas().sort_values("chunk").reset_index(drop=True)
    sign = np.sign(pdf.close.diff()).fillna(1)
    bins = pd.cut(pdf.close, 6, include_lowest=True, precision=2)
    pos = (pdf.volume * sign.where(sign > 0)).groupby(bins, observed=False).sum()
    neg = (-pdf.volume * sign.where(sign < 0)).groupby(bins, observed=False).sum()
    same(out.pos_volume, pos)
    same(out.neg_volume, neg)
    same(out.mean_close, pdf.close.groupby(bins, observed=False).mean())
    assert np.allclose(out.high_close, [i.right for i in pos.index], atol=0.011)


def test_ichimoku_span(one, pdf):
    out = got(ichimoku_span(one, tenkan=3, kijun=7, senkou=9))
    mid = lambda n: 0.5 * (pdf.high.rolling(n).max() + pdf.low.rolling(n).min())
    same(out["ISA_3"], (0.5 * (mid(3) + mid(7))).tail(7))
    same(out["ISB_7"], mid(9).tail(7))
    want = pd.date_range(pdf.ts.iloc[-1] + pd.Timedelta(days=1), periods=7, freq="B")
    assert out.ts.dt.tz_localize(None).tolist() == [t.tz_localize(None) for t in want]


def test_composite_fill_is_per_symbol(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    a = spark.createDataFrame([("A", t[0], 10.0), ("B", t[1], 7.0)], "symbol string, ts timestamp, x double")
    b = spark.createDataFrame([("A", t[2], 5.0), ("B", t[0], 6.0)], "symbol string, ts timestamp, y double")
    out = {(r["symbol"], r["ts"].day): (r["x"], r["y"]) for r in joins.composite_join({"a": a, "b": b}, on=["symbol", "ts"]).collect()}
    assert out == {("A", 1): (10.0, None), ("A", 3): (10.0, 5.0), ("B", 1): (None, 6.0), ("B", 2): (7.0, 6.0)}


def test_empty_response_gives_no_record(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"data": [{"x": 1}, {"x": 2}]}))
    (tmp_path / "b.json").write_text(json.dumps({"data": []}))
    assert sorted(r["x"] for r in read_json_records(spark, str(tmp_path)).collect()) == [1, 2]


def test_is_ordered(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = lambda *x: spark.createDataFrame([(s, t[i]) for s, i in x], "symbol string, ts timestamp").coalesce(1)
    assert joins.is_ordered(rows(("A", 0), ("B", 2), ("A", 1), ("A", 2)))
    assert not joins.is_ordered(rows(("A", 1), ("A", 0)))
    assert not joins.is_ordered(rows(("A", 1), ("A", 1)))


def test_jensens_alpha_interpolates_the_benchmark(spark):
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
    rng = np.random.default_rng(1)
    p, q = 100 + rng.normal(size=30).cumsum(), 100 + rng.normal(size=30).cumsum()
    gone = {9, 10, 17}
    rows = [("S", day(i), float(p[i])) for i in range(30)] + [("M", day(i), float(q[i])) for i in range(30) if i not in gone]
    out = {r["symbol"]: r["jensens_alpha"] for r in metrics.jensens_alpha(spark.createDataFrame(rows, "symbol string, ts timestamp, close double"), "M").collect()}
    s = pd.Series(p).pct_change()
    m = pd.Series([q[i] for i in range(30) if i not in gone], index=[i for i in range(30) if i not in gone]).pct_change().reindex(range(30))
    m = m.interpolate()
    ok = s.notna() & m.notna()
    assert abs(out["S"] - np.polyfit(m[ok], s[ok], 1)[1]) < 1e-12


def test_columns_constants_and_order(one):
    assert joins.resolve(one, "close") == "close" and joins.resolve(one, "CLOSE") == "close" and joins.resolve(one, "vol") == "volume"
    with pytest.raises(KeyError):
        joins.resolve(one, "nothing")
    assert joins.constants(one, [70, 30.5]).first()["70"] == 70.0
    t = [r["ts"] for r in joins.in_order(one, newest_first=True).select("ts").collect()]
    assert t == sorted(t, reverse=True)


def test_open_trades(spark):
    from ticklake.operators.signals import open_trades
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
    trend, trades, close = [0, 1, 1, 0, 1, 1], [0, 1, 0, -1, 1, 0], [1.0, 2.0, 3.0, 4.0, 5.0, 4.0]
    df = spark.createDataFrame([("A", day(i), trend[i], trades[i], close[i]) for i in range(6)], "symbol string, ts timestamp, TS_Trends int, TS_Trades int, close double")
    out = [(r["entry_price"], r["unrealised"]) for r in open_trades(df).orderBy("ts").collect()]
    assert out == [(None, None), (2.0, 0.0), (2.0, 0.5), (None, None), (5.0, 0.0), (5.0, 4.0 / 5 - 1)]


def test_preprocess_from_a_file(spark, one, tmp_path):
    from ticklake.operators.features import preprocess_file
    one.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).coalesce(1).write.option("header", True).csv(str(tmp_path / "bars"))
    out = preprocess_file(spark, str(tmp_path / "bars"), seq_len=5)
    assert out.count() > 500 and len(out.first()["X"]) == 5
