"""State machines and streams: invariance and batch-vs-stream checks."""

import numpy as np
from pyspark.sql import functions as F

from ticklake.operators import strategy as ST
from ticklake.streaming import jobs as SJ

STATE = [dict(kind=k) for k in ("psar", "supertrend", "qqe", "fisher", "rsx", "stc", "jma", "ebsw", "mcgd", "hwma",
                                 "hwc", "ssf")]


def test_state_machines_segment_invariant(bars_h):
    b = bars_h.filter((F.col("symbol") == "view") & (F.col("ts") < F.lit("2024-01-14").cast("timestamp")))
    a = ST.run_strategy(b, STATE, segment=None).orderBy("symbol", "ts").toPandas()
    s = ST.run_strategy(b, STATE, segment="3 days").orderBy("symbol", "ts").toPandas()
    for c in a.columns:
        if a[c].dtype.kind == "f":
            assert np.allclose(a[c].to_numpy(), s[c].to_numpy(), equal_nan=True), c


def test_hwma_is_linear_recurrence(bars_h):
    """hwma's three-state Holt recurrence vs a plain numpy loop."""
    b = bars_h.filter(F.col("symbol") == "view")
    out = ST.run_strategy(b, [dict(kind="hwma")]).orderBy("ts").toPandas()
    x = out["close"].to_numpy()
    f, v, a, res = x[0], 0.0, 0.0, []
    for p in x:
        F_ = 0.8 * (f + v + 0.5 * a) + 0.2 * p
        V = 0.9 * (v + a) + 0.1 * (F_ - f)
        A = 0.9 * a + 0.1 * (V - v)
        res.append(F_ + V + 0.5 * A)
        f, v, a = F_, V, A
    assert np.allclose(out["HWMA_0.2_0.1_0.1"].to_numpy(), res)


def test_count_buffer_fixture(spark, tmp_path):
    import datetime as dt
    rows = [("A", dt.datetime(2024, 1, 1, 0, i), float(10 + i), None if i == 0 else float(20 + i)) for i in range(3)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double, open double")
    p = str(tmp_path / "recs")
    df.write.parquet(p)
    stream = spark.readStream.schema(df.schema).parquet(p)
    out = SJ.run_to_table(SJ.count_buffer(stream, buffer_size=2, window=252), "buf-test").orderBy("ts").collect()
    assert len(out) == 2
    assert all(r["open"] is not None for r in out)


def test_stream_anomalies_follow_running_statistics(spark, tmp_path):
    import datetime as dt
    rng = np.random.default_rng(3)
    v = rng.normal(10, 1, size=300)
    v[[150, 220]] = [60.0, -40.0]
    rows = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), float(x)) for i, x in enumerate(v)]
    schema = "symbol string, ts timestamp, close double"
    p = str(tmp_path / "recs")
    for k in range(0, 300, 100):  # three micro-batches: the state is carried over
        spark.createDataFrame(rows[k:k + 100], schema).coalesce(1).write.mode("append").parquet(p)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(p)
    out = SJ.run_to_table(SJ.remove_stream_anomalies(stream, ["close"], warm=50, threshold=6.0), "anomaly-test").collect()
    assert sorted(r["close"] for r in out) == sorted(np.delete(v, [150, 220]))


def test_validation_reports_every_offender(spark):
    import datetime as dt

    import pytest

    from ticklake.operators import clean as CL
    t = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) for i in range(100)]
    rows = [("A", x, 1.0, 1.0, 1.0, -1.0, 1.0) for x in t] + [("B", t[0], 1.0, 1.0, 1.0, 1.0, 1.0)] * 2
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    with pytest.raises(CL.DataValidationError) as e:
        CL.validate(df)
    found = e.value.details["offenders"] if hasattr(e.value, "details") else e.value.args[1]["offenders"]
    assert {(r["problem"], r["count"]) for r in found.groupBy("problem").count().collect()} == {("duplicate", 1), ("close", 100)}


def test_whole_buffer_over_micro_batches(spark, tmp_path):
    import datetime as dt

    import pandas as pd
    rng = np.random.default_rng(1)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(s, t0 + dt.timedelta(minutes=i), float(i), None if rng.random() < 0.5 else float(i)) for s, n in (("A", 300), ("B", 7), ("C", 3)) for i in range(n)]
    schema = "symbol string, ts timestamp, close double, open double"
    p = str(tmp_path / "recs")
    for lo, hi in ((0, 5), (5, 6), (6, 300)):
        spark.createDataFrame([r for r in rows if lo <= r[2] < hi], schema).coalesce(1).write.mode("append").parquet(p)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(p)
    out = SJ.run_to_table(SJ.whole_buffer(stream, buffer_size=4, window=6), "whole-test").toPandas()
    want = []
    for s, g in pd.DataFrame(rows, columns=["symbol", "ts", "close", "open"]).groupby("symbol"):
        for i in range(4, len(g) + 1):
            b = g.iloc[max(i - 6, 0):i]
            want += [(s, i, c, o) for c, o in zip(b["close"], b["open"].astype(float).ffill().bfill())]
    got = [tuple(r) for r in out[["symbol", "number", "close", "open"]].itertuples(index=False)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert (out["ts"] == pd.Timestamp(t0) + pd.to_timedelta(out["close"], unit="min")).all()
    none = SJ.run_to_table(SJ.whole_buffer(stream, buffer_size=7, window=6), "whole-none")
    assert none.count() == 0


def test_watchlist_names_and_choices(spark, tmp_path):
    import pytest

    from ticklake.operators.strategy import run_watchlist
    from ticklake.sources.loaders import DataFetchError, watchlist
    for name in ("BRK.B_D", "SPY_D", "^GSPC_D", "SPY_W", "A B_D", "X+Y%_D"):
        (tmp_path / f"{name}.csv").write_text("ts,close,volume,split,symbol\n" + "".join(f"2024-01-{i:02d},{i}.0,1.0,0,zz\n" for i in range(1, 29)))
    folder, schema = str(tmp_path), "ts timestamp, close double, volume double, split int, symbol string"
    symbols = lambda df: sorted(r[0] for r in df.select("symbol").distinct().collect())
    assert symbols(watchlist(spark, folder, schema=schema)) == ["A B", "BRK.B", "SPY", "X+Y%", "^GSPC"]
    assert watchlist(spark, folder, schema=schema, tf="w").count() == 28
    chosen = watchlist(spark, folder, schema=schema, tickers=["brk.b", "SPY", "^gspc"], tf="D", drop=["split", "nothing"])
    assert symbols(chosen) == ["BRK.B", "SPY", "^GSPC"] and chosen.columns == ["ts", "close", "volume", "symbol"] and chosen.count() == 84
    with pytest.raises(DataFetchError):
        watchlist(spark, folder, schema=schema, tickers=["SPY", "NONE"], tf="D")
    out = run_watchlist(spark, folder, tickers=["SPY", "BRK.B"], tf="D", schema=schema)
    assert out.where("SMA_10 IS NOT NULL").count() == 2 * 19


def test_replay_files_are_in_time_order_and_hold_all_rows(spark):
    rows = spark.range(0, 4000, 1, 8).selectExpr("id", "concat('s', id % 3) AS symbol", "timestamp_seconds(1700000000 + (id * 7919) % 4000) AS ts")
    path = SJ.rows_in_order(rows, "replay-test")
    got = spark.read.parquet(path).selectExpr("*", "_metadata.file_path AS file", "_metadata.file_modification_time AS at").where(f"symbol <> '{SJ.CLOSING}'").toPandas()
    assert sorted(got["id"]) == list(range(4000))
    files = [g["ts"] for _, g in got.groupby("file", sort=False)]
    assert len(files) == 4 and all(ts.is_monotonic_increasing for ts in files)
    times = got.groupby("file").agg(lo=("ts", "min"), hi=("ts", "max"), at=("at", "min")).sort_values("lo")
    assert times["at"].is_monotonic_increasing and (times["lo"].iloc[1:].to_numpy() > times["hi"].iloc[:-1].to_numpy()).all()


def test_whole_buffer_of_a_long_symbol(spark, tmp_path):
    import pandas as pd
    n, window = 25_000, 40  # several chunks, each left in several pieces
    rows = spark.range(n).selectExpr("'A' AS symbol", "timestamp_seconds(id) AS ts", "CAST(id AS double) AS close", "IF(id % 97 = 5, CAST(id AS double), NULL) AS open")
    rows.coalesce(1).write.parquet(str(tmp_path / "long"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "long"))
    out = SJ.run_to_table(SJ.whole_buffer(stream, buffer_size=39, window=window), "whole-long")
    assert out.count() == 39 + (n - 39) * window
    last = out.where("number IN (39, 40, 10000, 10001, 25000)").orderBy("number", "ts").toPandas()
    for number, g in last.groupby("number"):
        ids = pd.Series(range(max(number - window, 0), number), dtype=float)
        assert g["close"].tolist() == ids.tolist()
        assert g["open"].fillna(-1).tolist() == ids.where(ids % 97 == 5).ffill().bfill().fillna(-1).tolist()


def test_ticker_files_are_written_under_their_names(spark):
    import os

    from ticklake.queries import _ticker_files
    from ticklake.sources.loaders import watchlist
    n = 4 * spark.sparkContext.defaultParallelism + 20
    bars = spark.range(n * 30).selectExpr(f"concat('s.', id % {n}) AS symbol", "timestamp_seconds(id) AS ts", "IF(id % 7 = 0, NULL, id / 3) AS close")
    folder = _ticker_files(spark, bars, "W")
    local = folder.removeprefix("file://")
    assert sorted(f for f in os.listdir(local) if not f.startswith(".")) == sorted(f"S.{i}_W.csv" for i in range(n))
    assert not os.path.exists(f"{os.path.dirname(local)}/parts")
    sc = spark.sparkContext
    sc.setJobGroup("watchlist-test", "listing")
    held = watchlist(spark, folder, tickers=[f"s.{i}" for i in range(n)], tf="W", schema="symbol string, ts timestamp, close double")
    track = sc.statusTracker()
    stages = [track.getStageInfo(s) for j in track.getJobIdsForGroup("watchlist-test") for s in track.getJobInfo(j).stageIds]
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert max((s.numTasks for s in stages if s), default=0) <= 4 * sc.defaultParallelism
    key = lambda df: sorted(map(str, df.selectExpr("lower(symbol) AS symbol", "ts", "close").collect()))
    assert key(held) == key(bars)
