"""Long rolling windows put together from blocks, against sliding frames and pandas."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticklake.functions import blocks as B
from ticklake.functions import long_ranks, long_windows
from ticklake.plans.frame import SeriesFrame

N, ROWS = 150, 1100


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(5)
    frames = []
    for symbol, n in (("A", ROWS), ("B", 260), ("C", 40)):
        x = 1e6 + rng.normal(size=n).cumsum()
        x[rng.random(n) < 0.1] = np.nan
        x[:3] = np.nan
        if symbol == "B":
            x[80:255] = 7.0  # a whole window without spread
        frames.append(pd.DataFrame({"symbol": symbol, "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "x": x}))
    pdf = pd.concat(frames, ignore_index=True)
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    return pdf, df


def pandas_rolled(pdf, agg, minp):
    r = lambda s: s.rolling(N, min_periods=minp)
    fns = {"avg": lambda s: r(s).mean(), "sum": lambda s: r(s).sum(), "max": lambda s: r(s).max(), "min": lambda s: r(s).min(),
           "std": lambda s: r(s).apply(lambda v: np.nanstd(v, ddof=1) if np.sum(v == v) > 1 else np.nan, raw=True),
           "stdp": lambda s: r(s).apply(np.nanstd, raw=True), "var": lambda s: r(s).apply(lambda v: np.nanvar(v, ddof=1) if np.sum(v == v) > 1 else np.nan, raw=True),
           "varp": lambda s: r(s).apply(np.nanvar, raw=True)}

    def central(k):
        def one(v):
            v = v[v == v]
            d = v - v.mean()
            q = (d ** 2).mean()
            return np.nan if q == 0 else (d ** k).mean() / q ** (k / 2) - (3.0 if k == 4 else 0.0)
        return lambda s: r(s).apply(one, raw=True)

    fns.update(skew=central(3), kurt=central(4))
    return pdf.groupby("symbol")["x"].transform(fns[agg])


@pytest.mark.parametrize("segment", [None, "2 days"])
@pytest.mark.parametrize("minp", [N, 20])
def test_equal_to_pandas(series, segment, minp):
    pdf, df = series
    aggs = ["avg", "sum", "max", "min", "std", "stdp", "var", "varp", "skew", "kurt"]
    f = SeriesFrame(df, segment=segment, lookback=N)
    f.with_columns({a: B.roll(f, "x", N, a, minp) for a in aggs})
    got = f.result(["symbol", "ts", *aggs]).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    for a in aggs:
        want = pandas_rolled(pdf, a, minp)
        assert (got[a].isna() == want.isna()).all(), a
        np.testing.assert_allclose(got[a].to_numpy(), want.to_numpy(), rtol=1e-6 if a in ("skew", "kurt") else 1e-9, atol=1e-6 if a in ("skew", "kurt") else 1e-9, err_msg=a)


def test_counts_and_chains_reach_far_enough(series):
    """A long window over a long window: the halo covers both."""
    pdf, df = series
    f = SeriesFrame(df, segment="1 day", lookback=2 * N)
    f.with_columns({"m": B.roll(f, "x", N, "max", 1)})
    f.with_columns({"mm": B.roll(f, "m", N, "min", 1), "c": B.roll(f, "x", N, "count", 0)})
    assert f.need == 2 * (N - 1)
    got = f.result(["symbol", "ts", "mm", "c"]).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    m = pdf.groupby("symbol")["x"].transform(lambda s: s.rolling(N, min_periods=1).max())
    want = m.groupby(pdf["symbol"]).transform(lambda s: s.rolling(N, min_periods=1).min())
    np.testing.assert_allclose(got["mm"].to_numpy(), want.to_numpy())
    held = pdf.groupby("symbol")["x"].transform(lambda s: s.notna().astype(float).rolling(N, min_periods=1).sum())
    np.testing.assert_allclose(got["c"].to_numpy(), held.to_numpy())


def test_too_short_halo_is_an_error(series):
    _, df = series
    f = SeriesFrame(df, segment="1 day", lookback=N - 2)
    with pytest.raises(ValueError):
        B.roll(f, "x", N, "max")


def test_a_window_of_2000_costs_about_what_one_of_20_costs(spark):
    rows = spark.range(400_000).select(F.concat(F.lit("S"), F.col("id") % 4).alias("symbol"), F.timestamp_seconds("id").alias("ts"), F.rand(3).alias("x"))

    def seconds(n):
        f = SeriesFrame(rows, segment=None)
        f.with_columns({a: B.roll(f, "x", n, a) for a in ("max", "std")})
        t = time.time()
        f.result().write.format("noop").mode("overwrite").save()
        return time.time() - t

    seconds(20)
    short, long = min(seconds(20) for _ in range(2)), min(seconds(2000) for _ in range(2))
    assert long < 3 * short + 2.0, (short, long)
    assert 2000 > long_windows.LONG


def absolute(v):
    v = v[v == v]
    return np.abs(v - v.mean()).mean()


@pytest.mark.parametrize("segment", [None, "2 days"])
@pytest.mark.parametrize("minp", [N, 20, 1])
def test_quantiles_and_deviations_equal_pandas(series, segment, minp):
    pdf, df = series
    f = SeriesFrame(df, segment=segment, lookback=N)
    f.with_columns({a.replace(".", ""): B.roll(f, "x", N, a, minp) for a in ("q0.5", "q0.05", "q0.9", "mad")})
    got = f.result(["symbol", "ts", "q05", "q005", "q09", "mad"]).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    rolled = lambda fn: pdf.groupby("symbol")["x"].transform(lambda s: fn(s.rolling(N, min_periods=minp)))
    for name, want in (("q05", rolled(lambda r: r.median())), ("q005", rolled(lambda r: r.quantile(0.05))), ("q09", rolled(lambda r: r.quantile(0.9))),
                       ("mad", rolled(lambda r: r.apply(absolute, raw=True)))):
        assert (got[name].isna() == want.isna()).all(), name
        np.testing.assert_allclose(got[name].to_numpy(), want.to_numpy(), rtol=1e-12, atol=1e-9, err_msg=name)


@pytest.mark.parametrize("n", [65, 300, 5000])
def test_rank_windows_equal_brute_force(n):
    """Ties, nulls, NaN, infinities, windows longer than the series, chunks with rows before them."""
    rng = np.random.default_rng(n)
    x = rng.integers(0, 40, 900).astype(float)
    x[rng.random(900) < 0.01] = np.inf
    x[850:860] = np.nan
    valid = rng.random(900) > 0.2
    valid[:70] = False
    for agg in ("q0.25", "q0.5", "mad"):
        for first in (0, 400):
            got, null = long_ranks.windows(x, valid, first, n, agg, 3)
            for i, t in enumerate(range(first, 900)):
                v = x[max(t + 1 - n, 0):t + 1][valid[max(t + 1 - n, 0):t + 1]]
                assert null[i] == (len(v) < 3)
                if null[i]:
                    continue
                with np.errstate(invalid="ignore"):
                    if agg == "mad":
                        want = np.abs(v - v.mean()).mean() if np.isfinite(v).all() else np.nan
                    else:
                        s, at = np.sort(v), float(agg[1:]) * (len(v) - 1)
                        a, b = s[int(np.floor(at))], s[int(np.ceil(at))]
                        want = a if a == b else (np.ceil(at) - at) * a + (at - np.floor(at)) * b if at % 1 else a
                np.testing.assert_allclose(got[i], want, rtol=1e-12, atol=1e-12)


def test_chunks_and_repeated_symbols_keep_their_own_rows(spark, monkeypatch):
    """Batches end inside windows, symbols inside batches; the null symbol is one like any other."""
    import pyarrow as pa
    monkeypatch.setattr(long_ranks, "FEWEST", 100)
    rng = np.random.default_rng(3)
    names = ["A"] * 333 + ["B"] * 80 + [None] * 150
    x = rng.normal(size=len(names))
    rows = pa.table({"s": names, "_part": pa.array([0] * len(names), pa.int64()), "v": x})
    out = [b for b in long_ranks._slid("s", "v", 70, "q0.5", 70)(iter(rows.to_batches(max_chunksize=37)))]
    got = np.concatenate([b.column("_slid").to_numpy(zero_copy_only=False) for b in out])
    want = np.concatenate([pd.Series(x[a:b]).rolling(70).median() for a, b in ((0, 333), (333, 413), (413, 563))])
    np.testing.assert_allclose(got, want)


def test_a_median_of_2000_costs_about_what_one_of_30_costs(spark):
    rows = spark.range(200_000).select(F.concat(F.lit("S"), F.col("id") % 4).alias("symbol"), F.timestamp_seconds("id").alias("ts"), F.rand(3).alias("x"))

    def seconds(n):
        f = SeriesFrame(rows, segment=None)
        f.with_columns({a: B.roll(f, "x", n, f"q{q}") for a, q in (("mid", 0.5),)})
        t = time.time()
        f.result().write.format("noop").mode("overwrite").save()
        return time.time() - t

    seconds(30)
    short, long = min(seconds(30) for _ in range(2)), min(seconds(2000) for _ in range(2))
    print("quantiles", short, long)
    assert long < 3 * short + 2.0, (short, long)
