"""Exact quantiles by selection, against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticklake.operators import clean, selection

PROBS = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def quantiles(spark, pdf, cols=("x",), bins=selection.BINS):
    out = selection.exact_quantiles(spark.createDataFrame(pdf), "symbol", list(cols), PROBS, bins)
    return {r["symbol"]: r for r in out.collect()}


@pytest.mark.parametrize("bins", [4, selection.BINS])
def test_equal_to_numpy(spark, bins):
    rng = np.random.default_rng(2)
    wide = np.concatenate([rng.normal(size=3000), 10.0 ** rng.integers(-300, 300, 500) * rng.choice([-1, 1], 500)])
    parts = {"normal": rng.normal(100, 5, 5000), "ties": rng.integers(0, 4, 3000).astype(float), "one": np.array([3.5]),
             "same": np.full(700, -2.25), "wide": wide, "ends": np.array([1.7e308, -1.7e308, 1.0, 2.0])}
    pdf = pd.concat([pd.DataFrame({"symbol": k, "x": v, "y": -v}) for k, v in parts.items()])
    got = quantiles(spark, pdf, ("x", "y"), bins)
    assert set(got) == set(parts)
    for k, v in parts.items():
        if k == "ends":  # numpy's interpolation overflows there
            assert got[k]["x"][0] == -1.7e308 and got[k]["x"][-1] == 1.7e308 and got[k]["x"][2] == 1.5
            continue
        np.testing.assert_allclose(got[k]["x"], np.quantile(v, PROBS), rtol=1e-12)
        np.testing.assert_allclose(got[k]["y"], np.quantile(-v, PROBS), rtol=1e-12)


def test_nulls_keys_and_empty_tables(spark):
    rows = [("A", 1.0), ("A", None), ("A", float("nan")), ("A", float("inf")), ("A", 3.0), ("B", None), (None, 5.0)]
    df = spark.createDataFrame(rows, "symbol string, x double")
    got = {r["symbol"]: r["x"] for r in selection.exact_quantiles(df, "symbol", ["x"], [0.5]).collect()}
    assert got == {"A": [2.0], "B": None, None: [5.0]}
    assert selection.exact_quantiles(df.where("false"), "symbol", ["x"], [0.5]).count() == 0


def test_outliers_by_exact_quartiles(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(50, 2, 2000)
    x[::97] = 500.0
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=2000, freq="h"), "close": x})
    out = clean.remove_outliers(spark.createDataFrame(pdf), "iqr", cols=["close"]).orderBy("ts").toPandas()["close"]
    q1, q3 = np.quantile(x, [0.25, 0.75])
    bad = (x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))
    want = pd.Series(np.where(bad, np.nan, x)).ffill()
    np.testing.assert_allclose(out.to_numpy(), want.to_numpy())
