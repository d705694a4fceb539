"""Preprocessor, sources and caches on literal fixtures."""

import datetime as dt
import json

from pyspark.sql import functions as F

from ticklake.operators import features as FT
from ticklake.session import scratch_path
from ticklake.sources import loaders as LD


def test_sequences_title_case(spark):
    rows = [(dt.datetime(2023, 1, i + 1), float(i + 1), float(i + 2), float(i), float(i + 1), 100.0) for i in range(4)]
    df = spark.createDataFrame(rows, "date timestamp, Open double, High double, Low double, Close double, Volume double")
    df = df.withColumn("ticker", F.lit("A"))
    seq = FT.preprocess(df, seq_len=2, horizon=1, normalization=None, indicators=False)
    got = sorted((r["y"], len(r["X"])) for r in seq.collect())
    assert got == [(3.0, 2), (4.0, 2)]


def test_sentiment_clip(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, -0.5, 1.0, -1.5)], "sentiment double")
    out = [r[0] for r in FT.custom_features(df, sentiment=True).collect()]
    assert out[-1] == -1.0 and out[2] == 1.0


def test_minmax_zscore_scale(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 3.0), ("B", 5.0), ("B", 5.0)], "symbol string, x double")
    mm = {(r["symbol"], r["x"]) for r in FT.scale(df, ["x"], "minmax").collect()}
    assert mm == {("A", 0.0), ("A", 1.0), ("B", 0.0)}
    z = sorted(r["x"] for r in FT.scale(df, ["x"], "zscore").filter("symbol = 'A'").collect())
    assert z == [-1.0, 1.0]


def test_broker_bars_and_refresh(spark):
    mock = LD.mock_bars(spark, 3, "2025-01-01")
    dup = mock.union(mock.limit(1).withColumn("close", F.lit(999.0)).withColumn("barCount", F.lit(7).cast("long")))
    rec = dup.withColumnRenamed("ts", "date").withColumnRenamed("average", "wap") \
        .withColumn("__o", F.monotonically_increasing_id())
    bars = LD.broker_bars(rec, order="__o")
    assert bars.count() == 3
    assert bars.orderBy("ts").first()["close"] == 999.0  # duplicate timestamp keeps the last record
    cache = LD.mock_bars(spark, 1, "2025-01-01")
    new = LD.mock_bars(spark, 2, "2025-01-02")
    merged = LD.incremental_refresh(cache, new)
    assert merged.count() == 3
    path = scratch_path(spark, "cache")
    LD.write_bar_cache(merged, path)
    back = LD.read_bar_cache(spark, path)
    assert back is not None and back.count() == 3


def test_json_records_flatten(spark, tmp_path):
    recs = {"data": [{"id": 1, "score": {"value": 0.5, "label": "x"}}, {"id": 2, "score": {"value": 0.7, "label": "y"}}]}
    p = tmp_path / "r.json"
    p.write_text(json.dumps(recs))
    df = LD.read_json_records(spark, str(p))
    assert set(df.columns) == {"id", "score.label", "score.value"}
    assert df.count() == 2
    fb = LD.read_or_fallback(spark, str(tmp_path / "missing.json"), str(p))
    assert fb.count() == 1


def test_loader_registry(spark, tmp_path):
    import pytest
    p = tmp_path / "a.csv"
    p.write_text("open,high,low,close,volume\n1,2,0.5,1.5,10\n2,3,1,2.5,20\n")
    df = LD.load(spark, "csv", str(p))
    assert df.count() == 2 and "close" in df.columns
    with pytest.raises(KeyError):
        LD.load(spark, "nope", str(p))
