"""Machines whose segments run side by side, and linear systems, against a plain loop."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticklake.operators.state import _Jma, _Psar, _Qqe, _Trail
from ticklake.plans import machines as M
from ticklake.plans.frame import SeriesFrame


def switch():
    class Switch:
        """Remembers the last large input and two rows; forgets the rest."""

        def __init__(self, tail):
            self.held, self.rows = 0.0, []

        def step(self, x):
            if abs(x) > 2:
                self.held = x
            self.rows = [*self.rows[-1:], x]
            return (self.held + sum(self.rows),)

    return Switch


def total():
    class Total:
        """Never forgets: its segments do not agree before each has its predecessor's state."""

        def __init__(self, tail):
            self.total = 0.0

        def step(self, x):
            self.total = self.total + x
            return (self.total,)

    return Total


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(4)
    rows = [(s, i * 3600, rng.gauss(0, 1)) for s in ("a", "b") for i in range(200)] + [("c", 0, 3.0)]
    df = spark.createDataFrame(rows, "symbol string, at long, x double")
    return df.select("symbol", F.col("at").cast("timestamp").alias("ts"), "x"), rows


def run(df, make, segment):
    f = SeriesFrame(df, segment=segment)
    name = M.run_state(f, make, [F.col("x")], ["y"])[0]
    f.with_columns({"y": F.col(name)})
    return {(r["symbol"], int(r["ts"].timestamp())): r["y"] for r in f.result(["symbol", "ts", "y"]).collect()}


def serial(rows, make):
    out, m, last = {}, None, None
    for s, at, x in rows:
        if s != last:
            m, last = make([]), s
        out[s, at] = m.step(x)[0]
    return out


@pytest.mark.parametrize("make", [switch(), total()])
@pytest.mark.parametrize("segment", [None, "1 day", "4 days"])
def test_side_by_side_is_serial(walk, make, segment):
    df, rows = walk
    got, want = run(df, make, segment), serial(rows, make)
    assert {k[0] for k in got} == {"a", "b", "c"} and len(got) == len(rows)
    shift = min(k[1] for k in got)  # the session's time zone
    assert {(s, t - shift): v for (s, t), v in got.items()} == want


def test_unsettled_symbols_are_streamed_whole(walk, monkeypatch):
    monkeypatch.setattr(M, "ROUNDS", 1)
    df, rows = walk
    make = total()
    got, want = run(df, make, "1 day"), serial(rows, make)
    shift = min(k[1] for k in got)
    assert {(s, t - shift): v for (s, t), v in got.items()} == want


@pytest.mark.parametrize("segment", [None, "6 hours", "4 days"])
def test_linear_system(walk, segment):
    df, rows = walk
    m = np.array([[0.9, 0.2, 0.0], [-0.3, 0.7, 0.1], [0.0, 1.0, 0.0]])
    f = SeriesFrame(df, segment=segment)
    x = F.col("x")
    names = M.scan_linear(f, m, [x, 0.5 * x, F.lit(0.0)], start=[x, F.lit(1.0), F.lit(-1.0)])
    f.with_columns({f"s{i}": F.col(n) for i, n in enumerate(names)})
    got = {}
    for r in f.result(["symbol", "ts", "s0", "s1", "s2"]).orderBy("symbol", "ts").collect():
        got.setdefault(r["symbol"], []).append((r["s0"], r["s1"], r["s2"]))
    for sym in ("a", "b", "c"):
        xs = [v for s, _, v in rows if s == sym]
        s = np.array([xs[0], 1.0, -1.0])
        for have, v in zip(got[sym], xs):
            s = m @ s + np.array([v, 0.5 * v, 0.0])
            assert np.allclose(have, s, rtol=1e-11, atol=1e-12)


@pytest.mark.parametrize("make,width", [(lambda: _Psar([5.0, 4.0], 0.02, 0.02, 0.2, True), 3), (lambda: _Trail([]), 3),
                                        (lambda: _Qqe([]), 3), (lambda: _Jma([], 7, 0), 1)])
def test_frozen_states_go_on_as_if_nothing_happened(make, width):
    rng = random.Random(1)
    rows = [sorted((rng.gauss(50, 5) for _ in range(width)), reverse=True) for _ in range(300)]
    whole, halves = make(), make()
    for i, r in enumerate(rows):
        if i % 7 == 0:
            state = json.dumps(M.freeze(halves), sort_keys=True)
            halves = make()
            M.thaw(halves, json.loads(state))
        a, b = whole.step(*r), halves.step(*r)
        assert all(x == y or (x != x and y != y) for x, y in zip(a, b))
