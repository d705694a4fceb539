"""Crossing vectors and small utilities (literal expectations of the
reference's utility tests)."""

from ticklake.functions.weights import combination, fibonacci, pascals_triangle, symmetric_triangle
from ticklake.operators import strategy as ST
from tests.helpers import col_list, frame

DATA = {"zero": [0, 0], "a": [0, 1], "b": [1, 0], "c": [1, 1], "crossed": [0, 1]}


def test_above_below_cross(spark):
    df = frame(spark, {k: [float(x) for x in v] for k, v in DATA.items()})
    out = ST.run_strategy(df, [dict(kind="above", series_a="a", series_b="zero"),
                               dict(kind="above", series_a="zero", series_b="a"),
                               dict(kind="below", series_a="zero", series_b="a"),
                               dict(kind="above_value", series_a="a", value=0),
                               dict(kind="below_value", series_a="a", value=0),
                               dict(kind="cross", series_a="a", series_b="b"),
                               dict(kind="cross", series_a="b", series_b="a", above=False)], lookback=5)
    assert col_list(out, "a_A_zero") == DATA["c"]
    assert col_list(out, "zero_A_a") == DATA["b"]
    assert col_list(out, "zero_B_a") == DATA["c"]
    assert col_list(out, "a_A_0") == DATA["c"]
    assert col_list(out, "a_B_0") == DATA["b"]
    assert col_list(out, "a_XA_b") == DATA["crossed"]
    assert col_list(out, "b_XB_a") == DATA["crossed"]


def test_weights_and_combination():
    assert combination(n=1, r=0) == 1
    assert combination(n=10, r=4) == 210
    assert combination(n=10, r=4, repetition=True) == 715
    assert fibonacci(5) == [1.0, 1.0, 2.0, 3.0, 5.0]
    assert pascals_triangle(4, weighted=True) == [0.0625, 0.25, 0.375, 0.25, 0.0625]
    assert symmetric_triangle(4) == [1.0, 2.0, 2.0, 1.0]
    assert symmetric_triangle(5) == [1.0, 2.0, 3.0, 2.0, 1.0]


def test_total_time_constants(spark):
    """7,606 whole days between first and last row."""
    import datetime as dt
    from ticklake.operators.metrics import metrics
    rows = [("S", dt.datetime(1999, 11, 1), 100.0), ("S", dt.datetime(1999, 11, 1) + dt.timedelta(days=7606), 200.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double")
    m = metrics(df, calmar_years=0).first()
    assert abs(m["tt_years"] - 30.182539682539684) < 1e-12
    assert abs(m["tt_months"] - 250.05753361606995) < 1e-9
    assert abs(m["tt_weeks"] - 1086.5714285714287) < 1e-9
    assert m["tt_days"] == 7606
    assert m["tt_hours"] == 182544
    assert m["tt_minutes"] == 10952640
    assert m["tt_seconds"] == 657158400
