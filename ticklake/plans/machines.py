"""State machines and linear systems over a ``SeriesFrame``, split by time segment.

A linear system ``s = M s + u`` of a few numbers is scanned like a scalar
recurrence: each segment from a zero state, the ends composed with powers of
``M`` over the per-segment summary, and each segment again from its exact
start (``scan_linear``).

A machine that is not linear has no such summary.  Its segments are first all
run at once, each from the machine's fresh state, and what is kept of a
segment is the state it ends in.  Then every segment whose predecessor ends in
another state than the one it was run from is run again, from that state; the
rounds stop when no segment is left.  By induction over segments every state
is then the serial one, bit by bit.  Trailing stops, ratchets and rounded
averages forget where they came from within a few turns, so that two or three
rounds do (``run_state``); symbols that are not settled after ``ROUNDS``
rounds are streamed whole, one task a symbol.
"""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklake.plans.frame import SeriesFrame, _floats, fresh
from ticklake.session import written

ROUNDS = 4
#: Rows that a linear system advances in one matrix product.
STRETCH = 32


# ------------------------------------------------------------ states as text
def freeze(x):
    """Attributes of a machine as plain lists and numbers."""
    if hasattr(x, "__dict__"):
        return {k: freeze(v) for k, v in vars(x).items()}
    if isinstance(x, (list, tuple, deque)):
        return [freeze(v) for v in x]
    return float(x) if isinstance(x, np.floating) else x


def thaw(machine, saved: dict) -> None:
    """Give a machine the attributes of ``saved``."""
    for k, v in saved.items():
        now = getattr(machine, k, None)
        if hasattr(now, "__dict__"):
            thaw(now, v)
        else:
            setattr(machine, k, deque(v, now.maxlen) if isinstance(now, deque) else v)


def _groups(b: pa.RecordBatch, keys: list[str]):
    """Runs of equal keys in a batch, as (key, start, stop)."""
    n = b.num_rows
    codes = [b.column(k).dictionary_encode() for k in keys]
    at = [c.indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in codes]
    change = np.zeros(n, bool)
    change[0] = True
    for a in at:
        change[1:] |= a[1:] != a[:-1]
    edges = [*np.flatnonzero(change).tolist(), n]
    names = [[*c.dictionary.to_pylist(), None] for c in codes]
    for lo, hi in zip(edges[:-1], edges[1:]):
        yield tuple(v[a[lo]] for v, a in zip(names, at)), lo, hi


class _Contiguous:
    """Says whether a run begins a new group; a group that comes back is a broken layout."""

    def __init__(self):
        self.now, self.seen = None, set()

    def begins(self, key) -> bool:
        if key == self.now:
            return False
        if key in self.seen:
            raise RuntimeError(f"rows of {key} are not contiguous in the partition")
        self.seen.add(key)
        self.now = key
        return True


def _with(b: pa.RecordBatch, cols: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, from_pandas=True) for c in cols]], names=[*b.schema.names, *names])


# ------------------------------------------------------------ machines
def run_state(f: SeriesFrame, make, inputs: list[Column], outs: list[str], tails: dict | None = None) -> list[str]:
    """Run a machine (``make(tail values)``, ``step(*inputs) -> tuple``) over every symbol's real rows in order.

    ``tails`` asks for a symbol's last rows ({name: (column, k)}: the value k
    rows before the last), a bounded per-symbol aggregate.  Returns the names
    of the output columns.
    """
    names = [fresh("s") for _ in outs]
    ins = {fresh("i"): c for c in inputs}
    # inputs may be windows: evaluate them with the halo rows, then drop those
    real = f.df.withColumns(ins).filter(~F.col("_halo"))
    real, tail_cols = _tails(f, real, tails)
    if f.segment is None:
        src = f.ordered(real)
        schema = T.StructType([*src.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
        f.df = src.mapInArrow(_stepped(make, [f.symbol], list(ins), tail_cols, names), schema).drop(*ins, *tail_cols, "_ord")
    else:
        f.df = _settled(f, make, real, list(ins), tail_cols, names)
    f.rehalo()
    return names


def _tails(f: SeriesFrame, real: DataFrame, tails: dict | None) -> tuple[DataFrame, list[str]]:
    if not tails:
        return real, []
    last = max(k for _, k in tails.values()) + 1
    kept = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("_rn")).alias("at"), *[c.alias(n) for n, (c, _) in tails.items()]))), 1, last)
    end = real.groupBy(f.symbol).agg(F.max("_rn").alias("__N"))
    near = real.join(end, f.symbol).filter(F.col("_rn") > F.col("__N") - last)
    found = near.groupBy(f.symbol).agg(kept.alias("__last"))
    cols = {n: fresh("tl") for n in tails}
    found = found.select(f.symbol, *[F.get("__last", F.lit(k))[n].alias(cols[n]) for n, (_, k) in tails.items()])
    return real.join(found, f.symbol, "left"), list(cols.values())


def _machine(make, tail, saved: str | None):
    m = make(tail)
    if saved is not None:
        thaw(m, json.loads(saved))
    return m


def _stepped(make, keys: list[str], ins: list[str], tail_cols: list[str], names: list[str], entry: str | None = None):
    """Outputs of every row; a group's machine starts fresh, or from the state in column ``entry``."""

    def fn(batches):
        order, m = _Contiguous(), None
        for b in batches:
            if b.num_rows == 0:
                continue
            cols = [_floats(b.column(c)).tolist() for c in ins]
            out = []
            for key, lo, hi in _groups(b, keys):
                if order.begins(key):
                    m = _machine(make, [_floats(b.column(c).slice(lo, 1))[0] for c in tail_cols],
                                 b.column(entry)[lo].as_py() if entry else None)
                out += [m.step(*row) for row in zip(*(c[lo:hi] for c in cols))]
            yield _with(b, list(np.array(out, dtype="float64").T), names)

    return fn


def _ends(make, keys: list[str], ins: list[str], tail_cols: list[str]):
    """One row per group: the state it was run from and the state it ends in."""

    def fn(batches):
        order, m, began, out = _Contiguous(), None, None, None

        def row():
            return pa.RecordBatch.from_arrays([*out, pa.array([began], pa.string()), pa.array([json.dumps(freeze(m), sort_keys=True)])],
                                              names=[*keys, "ran", "exit"])

        for b in batches:
            if b.num_rows == 0:
                continue
            cols = [_floats(b.column(c)).tolist() for c in ins]
            for key, lo, hi in _groups(b, keys):
                if order.begins(key):
                    if m is not None:
                        yield row()
                    began = b.column("entry")[lo].as_py()
                    m = _machine(make, [_floats(b.column(c).slice(lo, 1))[0] for c in tail_cols], began)
                    out = [b.column(k).slice(lo, 1) for k in keys]
                for values in zip(*(c[lo:hi] for c in cols)):
                    m.step(*values)
        if m is not None:
            yield row()

    return fn


def _settled(f: SeriesFrame, make, real: DataFrame, ins: list[str], tail_cols: list[str], names: list[str]) -> DataFrame:
    """Rows with the machine's outputs, every segment from its exact state (see the module's text)."""
    sym, keys = f.symbol, [f.symbol, "_part"]
    held = written(real.withColumn("_part", F.col("_seg")), "machine-rows")
    slim = held.select(*keys, "_rn", *ins, *tail_cols)
    kind = T.StructType([*[held.schema[k] for k in keys], T.StructField("ran", T.StringType()), T.StructField("exit", T.StringType())])

    def ends(rows: DataFrame) -> DataFrame:
        return f.ordered(rows).mapInArrow(_ends(make, keys, ins, tail_cols), kind)

    known = written(ends(slim.withColumn("entry", F.lit(None).cast("string"))), "machine-ends")
    before = F.lag("exit").over(Window.partitionBy(sym).orderBy("_part"))
    for _ in range(ROUNDS):
        stale = known.withColumn("entry", before).where("NOT entry <=> ran").select(*keys, "entry")
        if stale.isEmpty():
            break
        again = ends(slim.join(stale, keys)).withColumnsRenamed({"ran": "ran_2", "exit": "exit_2"})
        known = written(known.join(again, keys, "left").select(
            *keys, F.coalesce("ran_2", "ran").alias("ran"), F.coalesce("exit_2", "exit").alias("exit")), "machine-ends")
    entered = known.withColumn("entry", before)
    open_ = entered.where("NOT entry <=> ran").select(sym).distinct().withColumn("whole", F.lit(True))
    rows = held.join(entered.select(*keys, "entry"), keys).join(open_, sym, "left")
    # a symbol that did not settle is one group of its own, from the fresh state
    rows = rows.withColumns({"_part": F.when(F.col("whole"), F.lit(-1)).otherwise(F.col("_part")),
                             "entry": F.when(F.col("whole"), F.lit(None).cast("string")).otherwise(F.col("entry"))}).drop("whole")
    src = f.ordered(rows)
    schema = T.StructType([*src.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    out = src.mapInArrow(_stepped(make, keys, ins, tail_cols, names, "entry"), schema)
    return written(out.drop(*ins, *tail_cols, "_ord", "entry").withColumn("_part", F.col("_seg")), "machine-out")


# ------------------------------------------------------------ linear systems
class _System:
    """``s = M s + u`` over runs of rows, ``STRETCH`` rows in one matrix product."""

    def __init__(self, matrix):
        self.matrix = np.array(matrix, dtype="float64")
        k = len(self.matrix)
        power = [np.eye(k)]
        for _ in range(STRETCH):
            power.append(self.matrix @ power[-1])
        self.after = np.stack(power[1:])  # row j of a stretch sees its start through M^(j+1)
        lower = np.zeros((STRETCH, k, STRETCH, k))
        for i in range(STRETCH):
            for j in range(i + 1):
                lower[i, :, j, :] = power[i - j]
        self.lower = lower.reshape(STRETCH * k, STRETCH * k).T.copy()

    def run(self, u: np.ndarray, start: np.ndarray) -> np.ndarray:
        n, k = u.shape
        pad = -n % STRETCH
        blocks = np.concatenate([u, np.zeros((pad, k))]).reshape(-1, STRETCH * k) @ self.lower
        out = blocks.reshape(-1, STRETCH, k)
        s = start
        for y in out:
            y += self.after @ s
            s = y[-1]
        return out.reshape(-1, k)[:n]


def scan_linear(f: SeriesFrame, matrix, inputs: list[Column], start: list[Column] | None = None, tails: dict | None = None) -> list[str]:
    """State of the system ``s = M s + u`` after every row, from ``start`` (evaluated at a symbol's first row; else zero).

    ``u`` are ``inputs`` (null counts as 0).  With ``tails`` the start is a
    symbol's last rows instead (see ``run_state``).  Returns the names of the
    state's columns.
    """
    k, keys = len(inputs), [f.symbol, "_part"]
    names, ins = [fresh("v") for _ in inputs], [fresh("u") for _ in inputs]
    first = [fresh("b") for _ in inputs]
    given = dict(zip(ins, (c.cast("double") for c in inputs)))
    if start is not None:
        given.update(dict(zip(first, (c.cast("double") for c in start))))
    real = f.df.withColumns(given).filter(~F.col("_halo"))
    real, tail_cols = _tails(f, real, tails)
    if start is None:
        first = tail_cols
    elif tails:
        raise ValueError("give a start or tails")
    matrix = np.array(matrix, dtype="float64").tolist()

    def vectors(b, cols):
        return np.column_stack([np.nan_to_num(_floats(b.column(c)), nan=0.0) for c in cols]) if cols else np.zeros((b.num_rows, k))

    def walked(batches, carry: str | None):
        """(batch, runs) with runs = (key, new group, rows lo..hi, states)."""
        system, order, s = _System(matrix), _Contiguous(), np.zeros(k)
        for b in batches:
            if b.num_rows == 0:
                continue
            u, begin, at = vectors(b, ins), vectors(b, first), b.column("_rn").to_numpy()
            runs = []
            for key, lo, hi in _groups(b, keys):
                new = order.begins(key)
                if new:
                    s = begin[lo] if at[lo] == 1 else np.zeros(k)
                    if carry is not None and at[lo] != 1:
                        s = np.array(b.column(carry)[lo].as_py())
                y = system.run(u[lo:hi], s)
                s = y[-1]
                runs.append((key, new, lo, hi, y))
            yield b, runs

    def outputs(carry):
        def fn(batches):
            for b, runs in walked(batches, carry):
                yield _with(b, list(np.concatenate([r[4] for r in runs]).T), names)
        return fn

    def states(src: DataFrame, carry: str | None) -> DataFrame:
        schema = T.StructType([*src.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
        return src.mapInArrow(outputs(carry), schema).drop(*ins, *first, "_ord")

    if f.segment is None:
        f.df = states(f.ordered(real), None)
        f.rehalo()
        return names

    held = written(real.withColumn("_part", F.col("_seg")), "linear-rows")

    def ends(batches):
        last = None
        for b, runs in walked(batches, None):
            for _, new, lo, hi, y in runs:
                if new and last is not None:
                    yield pa.RecordBatch.from_arrays([*last[0], pa.array([last[1]], pa.int64()), pa.array([last[2]], pa.list_(pa.float64()))],
                                                     names=[*keys, "n", "end"])
                n = hi - lo + (0 if new or last is None else last[1])
                last = [b.column(c).slice(lo, 1) for c in keys], n, y[-1].tolist()
        if last is not None:
            yield pa.RecordBatch.from_arrays([*last[0], pa.array([last[1]], pa.int64()), pa.array([last[2]], pa.list_(pa.float64()))],
                                             names=[*keys, "n", "end"])

    kind = T.StructType([*[held.schema[c] for c in keys], T.StructField("n", T.LongType()), T.StructField("end", T.ArrayType(T.DoubleType()))])
    slim = held.select(*keys, "_rn", *ins, *first)
    summary = f.ordered(slim).mapInArrow(ends, kind)
    sym = f.symbol

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part")
        m, s, carry = np.array(matrix), np.zeros(k), []
        for n, end in zip(pdf["n"], pdf["end"]):
            carry.append(s.tolist())
            s = np.linalg.matrix_power(m, int(n)) @ s + np.array(end)
        return pd.DataFrame({sym: pdf[sym], "_part": pdf["_part"], "carry": carry})

    carried = summary.groupBy(sym).applyInPandas(
        composed, T.StructType([*[held.schema[c] for c in keys], T.StructField("carry", T.ArrayType(T.DoubleType()))]))
    f.df = written(states(f.ordered(held.join(carried, keys)), "carry").drop("carry"), "linear-out")
    f.rehalo()
    return names
