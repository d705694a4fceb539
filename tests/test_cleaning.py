"""Cleaner steps on the reference's literal frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ticklake.operators import clean as CL
from tests.helpers import col_list, frame

NULL = None


def test_forward_backward_fill(spark):
    df = frame(spark, {"A": [1.0, NULL, NULL, 4.0], "B": [NULL, 2.0, 3.0, NULL]})
    out = CL.impute(df, "forward_fill", backward_fill=True, cols=["A", "B"])
    assert col_list(out, "A") == [1, 1, 1, 4]
    assert col_list(out, "B") == [2, 2, 3, 3]


def test_interpolate(spark):
    df = frame(spark, {"A": [1.0, NULL, NULL, 4.0], "B": [NULL, 2.0, 3.0, NULL]})
    out = CL.impute(df, "interpolate", cols=["A", "B"])
    assert col_list(out, "A") == [1, 2, 3, 4]
    assert col_list(out, "B") == [2, 2, 3, 3]


def test_fill_segmented_equals_whole(spark):
    df = frame(spark, {"A": [1.0, NULL, NULL, 4.0, NULL, 6.0, NULL, NULL], "B": [NULL, 2.0] + [NULL] * 6})
    a = CL.impute(df, "interpolate", cols=["A", "B"], segment="2 days")
    b = CL.impute(df, "interpolate", cols=["A", "B"], segment=None)
    assert col_list(a, "A") == col_list(b, "A")
    assert col_list(a, "B") == col_list(b, "B")
    f1 = CL.impute(df, "forward_fill", True, cols=["A", "B"], segment="2 days")
    f2 = CL.impute(df, "forward_fill", True, cols=["A", "B"], segment=None)
    assert col_list(f1, "A") == col_list(f2, "A") and col_list(f1, "B") == col_list(f2, "B")


def test_zscore_outlier(spark):
    # population z of 100 is 1.9993: threshold 1.9 flags it, then ffill
    df = frame(spark, {"x": [1.0, 2.0, 100.0, 3.0, 4.0]})
    out = CL.remove_outliers(df, "zscore", 1.9, cols=["x"])
    assert max(col_list(out, "x")) < 100
    assert col_list(out, "x") == [1, 2, 2, 3, 4]


def test_incremental_rsi_macd_nulls(spark):
    df = frame(spark, {"close": [100.0, 101.0, 102.0, 103.0, 104.0]})
    r = CL.rsi_simple(df, window=2)
    assert sum(v is None for v in col_list(r, "rsi")) == 2
    m = CL.macd_incremental(df, 12, 26, 9)
    assert all(v is not None for v in col_list(m, "macd")) and all(v is not None for v in col_list(m, "macd_signal"))
    assert col_list(m, "macd")[0] == 0.0


def test_calendar(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 1, d),) for d in (1, 2, 3)], "ts timestamp")
    out = CL.calendar_features(df)
    assert col_list(out, "day_of_week") == [6, 0, 1]
    assert col_list(out, "is_holiday") == [False, True, False]


def test_validation_errors(spark):
    dup = spark.createDataFrame([("T", dt.datetime(2023, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0)] * 2,
                                "symbol string, ts timestamp, open double, high double, low double, close double, "
                                "volume double")
    with pytest.raises(CL.DataValidationError):
        CL.validate(dup)
    miss = spark.createDataFrame([(1.0, 2.0)], "open double, high double")
    with pytest.raises(CL.DataValidationError):
        CL.validate(miss)
    neg = dup.limit(1).withColumn("low", F.lit(-1.0))
    with pytest.raises(CL.DataValidationError):
        CL.validate(neg)


def test_anomaly_removal(spark):
    df = frame(spark, {"close": [1.0, 1.0, 1.0, 100.0, 1.0]})
    out = CL.remove_anomalies(df, ["close"], contamination=0.2, n_trees=50, sample_size=5)
    vals = col_list(out, "close")
    assert len(vals) < 5 and 100.0 not in vals


def test_sentiment_lexicon(spark):
    docs = spark.createDataFrame([(1, "Good great day"), (2, "awful, terrible loss"), (3, "   "), (4, None)],
                                 "doc_id long, text string")
    lex = spark.createDataFrame([("good", 1.9), ("great", 3.1), ("awful", -2.0), ("terrible", -2.1),
                                 ("loss", -1.3)], "word string, valence double")
    out = {r["doc_id"]: r["sentiment"] for r in CL.sentiment(docs, lex).collect()}
    s = 5.0
    assert abs(out[1] - s / (s * s + 15) ** 0.5) < 1e-12
    assert out[2] < 0 and out[3] == 0.0 and out[4] == 0.0


def test_counters_of_every_step(spark):
    import random

    from pyspark.sql import functions as F

    from ticklake.operators import clean as CL
    rng = random.Random(2)
    rows = [("a", i * 60, 100.0 + rng.random(), 5.0) for i in range(200)]
    rows[10] = ("a", 600, None, 5.0)
    rows[50] = ("a", 3000, 900.0, 5.0)
    df = spark.createDataFrame(rows, "symbol string, at long, close double, volume double").select(
        "symbol", F.col("at").cast("timestamp").alias("ts"), *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], "volume")
    counters = CL.CleaningCounters()
    out = CL.clean(df, span=None, rsi_window=None, macd=None, calendar=False, anomaly_contamination=0.1, counters=counters)
    assert not set(CL.CleaningCounters.TALLIES) & set(out.columns)
    n = out.count()
    assert counters.read() == {"rows": 200, "missing_before": 4, "missing_imputed": 4, "outliers_removed": 4, "anomalies_removed": 200 - n}
    assert 10 <= 200 - n <= 30
