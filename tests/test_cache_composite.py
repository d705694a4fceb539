"""The bar cache merged in place, and the streaming composite join."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticklake.operators.joins import composite_join
from ticklake.session import scratch_path
from ticklake.sources.cache import BarCache
from ticklake.streaming.composite import run_filled


def bars(spark, rows):
    return spark.createDataFrame([(s, pd.Timestamp(t).to_pydatetime(), c) for s, t, c in rows], "symbol string, ts timestamp, close double")


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def content(cache, *cols):
    return sorted(map(tuple, cache.read().select("symbol", F.date_format("ts", "MM-dd HH").alias("t"), *cols).collect()), key=str)


def test_merge_touches_only_its_own_spans(spark):
    cache = BarCache(spark, scratch_path(spark, "cache-test"))
    cache.merge(bars(spark, [("A", "2024-01-05", 1.0), ("A", "2024-02-05", 2.0), ("B", "2024-01-05", 3.0), ("007", "2024-01-06", 4.0)]))
    before = files(cache.path)
    delta = bars(spark, [("A", "2024-02-05", 20.0), ("A", "2024-02-06", 21.0)])
    cache.merge(delta)
    assert {f for f in before if "symbol=A" not in f or "span=2024-01" in f} <= files(cache.path)
    want = [("007", "01-06 00", 4.0), ("A", "01-05 00", 1.0), ("A", "02-05 00", 20.0), ("A", "02-06 00", 21.0), ("B", "01-05 00", 3.0)]
    assert content(cache, "close") == want
    cache.merge(delta)
    assert content(cache, "close") == want


def test_plans_prune_partitions(spark):
    cache = BarCache(spark, scratch_path(spark, "cache-test"))
    cache.merge(bars(spark, [("A", f"2024-{m:02d}-05", float(m)) for m in range(1, 7)]))
    fresh = bars(spark, [("A", "2024-02-05", 20.0)]).withColumn("span", F.lit("2024-02"))
    plan = cache.merged(fresh)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "2024-02" in plan.split("PartitionFilters: [")[1].split("]")[0]
    part = cache.read(["A"], "2024-03-01", "2024-04-30")
    assert sorted(r["close"] for r in part.collect()) == [3.0, 4.0]
    assert len(part.inputFiles()) == 6 and "2024-03" in part._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_repeated_keys_new_columns_and_missing_keys(spark):
    cache = BarCache(spark, scratch_path(spark, "cache-test"), unit="day")
    cache.merge(bars(spark, [("A", "2024-01-05 01:00", 1.0), ("A", "2024-01-06 01:00", 2.0)]))
    delta = bars(spark, [("A", "2024-01-06 01:00", 9.0), ("A", "2024-01-06 01:00", 5.0), ("A", "2024-01-06 02:00", 6.0)])
    delta = delta.withColumn("seq", -F.col("close")).withColumn("volume", F.lit(7.0))
    cache.merge(delta, order="seq")  # the last record of a key wins
    assert content(cache, "close", "volume") == [("A", "01-05 01", 1.0, None), ("A", "01-06 01", 5.0, 7.0), ("A", "01-06 02", 6.0, 7.0)]
    with pytest.raises(ValueError):
        cache.merge(bars(spark, [(None, "2024-01-05", 1.0)]))
    cache.merge(bars(spark, []))
    assert len(content(cache, "close")) == 3


def test_streams_joined_and_filled_equal_the_batch_join(spark):
    a = [(1, 1.0, 5.0), (2, None, 6.0), (9, 3.0, None)]
    b = [(2, 10.0), (3, 11.0), (8, None), (10, 12.0)]
    c = [(4, 0.5), (12, 0.25)]
    schema = {"a": "h int, close double, low double", "b": "h int, close double", "c": "h int, rate double"}
    rows = {"a": a, "b": b, "c": c}
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("h") * 3600).alias("ts")
    batch = {k: spark.createDataFrame(rows[k], schema[k]).select(ts, *[x for x in schema[k].replace(",", "").split()[2::2]]) for k in rows}
    folders = {k: scratch_path(spark, f"side-{k}") for k in rows}

    def feed(lo, hi):
        for k, d in batch.items():
            h = (F.unix_seconds("ts") - 1_700_000_000) / 3600
            d.where((h >= lo) & (h < hi)).coalesce(1).write.mode("append").parquet(folders[k])

    sides = lambda: {k: spark.readStream.schema(d.schema).parquet(folders[k]) for k, d in batch.items()}
    folder = scratch_path(spark, "joined")
    for lo, hi in ((0, 3), (3, 9), (9, 11), (11, 13)):  # stopped and started again on the same folder
        feed(lo, hi)
        out = run_filled(sides(), "t", watermark="1 hour", folder=folder)
    want = composite_join(batch, on=["ts"])
    cols = ["ts", "close_a", "low", "close_b", "rate"]
    got = {r["ts"]: tuple(r) for r in out.select(*cols).collect()}
    full = {r["ts"]: tuple(r) for r in want.select(*cols).collect()}
    held_back = [t for t in full if t not in got]
    assert got == {t: full[t] for t in got}
    assert len(got) >= 7 and all(t > max(got) for t in held_back)  # only times that the watermark has not passed
