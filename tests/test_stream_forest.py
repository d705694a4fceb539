"""Streaming anomaly removal by refitted forests: against one batch, and against a plain restatement."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticklake.operators.clean import grown_tree, isolation_scores
from ticklake.session import scratch_path
from ticklake.streaming.forest import ForestStream, run_forest

SETTINGS = dict(refit_every=60, window=100, n_trees=20, sample_size=64, contamination=0.05)
SCHEMA = "symbol string, ts timestamp, x double, y double, note string"


def records():
    rng = np.random.default_rng(2)
    frames = []
    for symbol, n in (("A", 500), ("B", 130), ("C", 90), (None, 170)):
        x, y = rng.normal(size=n), rng.normal(size=n)
        x[::37] += 40.0
        x[5] = np.nan
        frames.append(pd.DataFrame({"symbol": symbol, "ts": pd.date_range("2024-01-01", periods=n, freq="min"), "x": x, "y": y, "note": [f"{symbol}{i}" for i in range(n)]}))
    return pd.concat(frames, ignore_index=True)


def plain(pdf):
    """The same rule, one record after another."""
    kept, every, window = [], SETTINGS["refit_every"], SETTINGS["window"]
    for _, g in pdf.groupby("symbol", dropna=False):
        g = g.sort_values("ts")
        x = g[["x", "y"]].to_numpy(dtype=float)
        forests = {}
        for i in range(len(g)):
            v = i // every
            if v * every >= window and v not in forests:
                rng = np.random.default_rng([42, v])
                seen = x[v * every - window:v * every]
                forest = [grown_tree(seen[rng.choice(window, 64, replace=False)], rng) for _ in range(SETTINGS["n_trees"])]
                forests[v] = forest, np.quantile(isolation_scores(forest, seen, 64), 0.95)
            if v not in forests or isolation_scores(forests[v][0], x[i:i + 1], 64)[0] <= forests[v][1]:
                kept.append(g["note"].iloc[i])
    return sorted(kept)


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(records().astype({"symbol": object}).where(lambda d: d.notna(), None), SCHEMA)
    return df.withColumn("x", F.nanvl("x", F.lit(None).cast("double")))


def names(df):
    return sorted(r["note"] for r in df.select("note").collect())


def test_one_batch_equals_the_rule(table):
    got, want = names(run_forest(table, ["x", "y"], **SETTINGS)), plain(records())
    assert got == want
    dropped = set(records()["note"]) - set(got)
    assert {f"A{i}" for i in range(0, 500, 37) if i >= 120} <= dropped  # planted
    assert len(dropped) < 0.2 * 890 and not any(n.startswith("C") for n in dropped)


def test_any_cut_into_batches_gives_the_same_and_a_restart_goes_on(spark, table):
    path, folder = scratch_path(spark, "forest-in"), scratch_path(spark, "forest")
    ts = F.unix_seconds("ts") - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    out = None
    for lo, hi in ((0, 45), (45, 46), (46, 300), (300, 301), (301, 10_000)):
        table.where((ts >= lo * 60) & (ts < hi * 60)).coalesce(1).write.mode("append").parquet(path)
        out = run_forest(spark.readStream.schema(SCHEMA).parquet(path), ["x", "y"], folder=folder, **SETTINGS)
    assert names(out) == plain(records())


def test_a_batch_run_again_replaces_its_rows(spark, table):
    job = ForestStream(table.schema, ["x", "y"], scratch_path(spark, "forest-again"), **SETTINGS)
    job.batch(table, 0)
    job.batch(table.limit(0), 1)
    job.batch(table.limit(0), 1)
    assert names(job.kept(spark)) == plain(records())


def test_bad_settings_and_empty_input(spark, table):
    with pytest.raises(ValueError):
        ForestStream(table.schema, ["x"], "unused", contamination=0.0)
    assert run_forest(table.limit(0), ["x", "y"], **SETTINGS).count() == 0


def test_only_the_newest_forests_are_written(spark, table):
    folder = scratch_path(spark, "forest-lean")
    run_forest(table, ["x", "y"], folder=folder, **SETTINGS)
    fitted = spark.read.parquet(f"{folder}/fitted").groupBy("symbol").agg(F.count("*").alias("n"), F.max("_v").alias("v"))
    assert {r["symbol"]: (r["n"], r["v"]) for r in fitted.collect()} == {"A": (1, 8), "B": (1, 2), None: (1, 2)}


def test_trees_and_scores_as_node_by_node():
    def plain_tree(x, rng):
        limit, nodes = int(np.ceil(np.log2(max(len(x), 2)))), []

        def build(idx, depth):
            me = [-1.0, 0.0, -1.0, -1.0, float(len(idx))]
            nodes.append(me)
            lo, hi = np.fmin.reduce(x[idx], axis=0, initial=np.inf), np.fmax.reduce(x[idx], axis=0, initial=-np.inf)
            ok = np.where(hi > lo)[0]
            if depth >= limit or len(idx) <= 1 or not len(ok):
                return
            q = int(rng.choice(ok))
            me[0], me[1] = float(q), float(rng.uniform(lo[q], hi[q]))
            below = x[idx, q] < me[1]
            for place, part in ((2, idx[below]), (3, idx[~below])):
                me[place] = float(len(nodes))
                build(part, depth + 1)

        build(np.arange(len(x)), 0)
        return np.array(nodes)

    def plain_depth(nodes, row):
        at, depth = 0, 0
        while nodes[at, 0] >= 0:
            at, depth = int(nodes[at, 2 if row[int(nodes[at, 0])] < nodes[at, 1] else 3]), depth + 1
        n = nodes[at, 4]
        return depth + (2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2))

    rng = np.random.default_rng(5)
    for features in (1, 3):
        x = rng.normal(size=(90, features)).round(1)
        x[rng.random(x.shape) < 0.1] = np.nan
        forest = [grown_tree(x, np.random.default_rng(k)) for k in range(4)]
        assert all(np.array_equal(t, plain_tree(x, np.random.default_rng(k))) for k, t in enumerate(forest))
        usual = 2 * (np.log(89) + 0.5772156649) - 2 * 89 / 90
        want = [2 ** (-np.mean([plain_depth(t, row) for t in forest]) / usual) for row in x]
        assert np.allclose(isolation_scores(forest, x, 90), want, rtol=1e-12)
