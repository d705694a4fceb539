"""Rolling quantiles and mean absolute deviations over long windows, by counted ranks.

Spark sorts the frame of every row anew, so a window of n rows costs n steps a
row and more.  Here the rows of a partition pass by in order, some thousands at
a time together with the n - 1 rows before them, and all their windows are
answered at once from one structure, a wavelet matrix over the ranks of the
values: one level per bit of the rank, each level the values in the order the
levels above left them, with running counts (and running sums) of those whose
bit is 0.  The k-th smallest of a window, and number and sum of its values below
a bound, follow the window's two borders through the levels.  A row costs one
step a level, whatever the length of the window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklake.plans.frame import SeriesFrame, fresh

#: Rows answered at a time: as many as the window has, within these bounds.
FEWEST, MOST = 8_192, 65_536


class RankMatrix:
    """Order statistics of any run of ``values`` (no nulls; NaN above all, like Spark's order)."""

    def __init__(self, values: np.ndarray, sums: bool = False):
        order = np.argsort(values, kind="stable")
        self.sorted = values[order]
        ranks = np.empty(len(values), dtype=np.int64)
        ranks[order] = np.arange(len(values))
        self.levels = []
        parts = values if sums else None
        for bit in range(max(len(values) - 1, 1).bit_length() - 1, -1, -1):
            zero = (ranks >> bit) & 1 == 0
            counts = np.concatenate(([0], np.cumsum(zero)))
            totals = np.concatenate(([0.0], np.cumsum(np.where(zero, parts, 0.0)))) if sums else None
            self.levels.append((bit, counts, totals))
            ranks = np.concatenate((ranks[zero], ranks[~zero]))
            if sums:
                parts = np.concatenate((parts[zero], parts[~zero]))

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest (from 0) of ``values[lo:hi]``, for arrays of runs."""
        rank = np.zeros(len(k), dtype=np.int64)
        for bit, counts, _ in self.levels:
            a, b = counts[lo], counts[hi]
            low = k < b - a
            lo, hi = np.where(low, a, counts[-1] + lo - a), np.where(low, b, counts[-1] + hi - b)
            rank |= np.where(low, 0, 1 << bit)
            k = np.where(low, k, k - (b - a))
        return self.sorted[rank]

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the values of ``values[lo:hi]`` up to ``bound``."""
        rank = np.searchsorted(self.sorted, bound, side="right")
        every = rank >= len(self.sorted)
        rank = np.where(every, len(self.sorted) - 1, rank)
        number, total = np.zeros(len(lo), dtype=np.int64), np.zeros(len(lo))
        for bit, counts, totals in self.levels:
            a, b = counts[lo], counts[hi]
            up = (rank >> bit) & 1 == 1
            number += np.where(up, b - a, 0)
            total += np.where(up, totals[hi] - totals[lo], 0.0)
            lo, hi = np.where(up, counts[-1] + lo - a, a), np.where(up, counts[-1] + hi - b, b)
        # the borders have come down to the bound's own rank, which is not below itself
        number += np.where(every, hi - lo, 0)
        total += np.where(every, (hi - lo) * self.sorted[-1], 0.0)
        return number, total


def windows(x: np.ndarray, valid: np.ndarray, first: int, n: int, agg: str, minp: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and null mask of the windows of ``n`` rows that end at ``x[first:]``; rows not ``valid`` are skipped."""
    upto = np.concatenate(([0], np.cumsum(valid)))
    ends = np.arange(first, len(x))
    lo, hi = upto[np.maximum(ends + 1 - n, 0)], upto[ends + 1]
    held = hi - lo
    null = held < max(minp, 1)
    out = np.full(len(ends), np.nan)
    ask = np.flatnonzero(~null)
    if len(ask):
        lo, hi, held, v = lo[ask], hi[ask], held[ask], x[valid]
        out[ask] = _deviation(v, lo, hi, held) if agg == "mad" else _quantile(v, lo, hi, held, float(agg[1:]))
    return out, null


def _quantile(v, lo, hi, held, q):
    """Between the two nearest ranks by linear interpolation, in the steps of ``percentile``."""
    ranks = RankMatrix(v)
    at = q * (held - 1)
    k1, k2 = np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)
    a = ranks.kth(lo, hi, k1)
    b = ranks.kth(lo, hi, k2)
    with np.errstate(invalid="ignore"):
        return np.where((k1 == k2) | (a == b), a, (k2 - at) * a + (at - k1) * b)


def _deviation(v, lo, hi, held):
    """Mean distance from the mean: twice what lies below it, a row."""
    finite = np.isfinite(v)
    odd = np.concatenate(([0], np.cumsum(~finite)))
    middle = float(np.median(v[finite])) if finite.any() else 0.0  # sums of distances from it: no digits cancel
    d = np.where(finite, v - middle, 0.0)
    sums = np.concatenate(([0.0], np.cumsum(d)))
    mean = (sums[hi] - sums[lo]) / held
    number, total = RankMatrix(d, sums=True).below(lo, hi, mean)
    out = np.maximum(2.0 * (mean * number - total) / held, 0.0)
    change = np.concatenate(([0], np.cumsum(v[1:] != v[:-1])))
    out[change[hi - 1] == change[lo]] = 0.0  # one value all through
    out[odd[hi] > odd[lo]] = np.nan
    return out


def _slid(sym: str, x: str, n: int, agg: str, minp: int):
    """Arrow batches of ordered rows -> the same with the windows' values."""
    size = min(max(n, FEWEST), MOST)

    def fn(batches):
        key, past = None, (np.empty(0), np.empty(0, dtype=bool))

        def answered(held):
            nonlocal key, past
            rows = pa.Table.from_batches(held)
            column = rows[x].combine_chunks()
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            value = column.fill_null(0.0).to_numpy(zero_copy_only=False)
            code = rows[sym].combine_chunks().dictionary_encode()
            names = [*code.dictionary.to_pylist(), None]
            at = code.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            part = rows["_part"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (part[1:] != part[:-1])])
            out, null = np.empty(len(value)), np.empty(len(value), dtype=bool)
            for a, b in zip(starts, [*starts[1:], len(value)]):
                if (names[at[a]], part[a]) != key:
                    key, past = (names[at[a]], part[a]), (np.empty(0), np.empty(0, dtype=bool))
                values, valids = np.concatenate((past[0], value[a:b])), np.concatenate((past[1], valid[a:b]))
                out[a:b], null[a:b] = windows(values, valids, len(past[0]), n, agg, minp)
                past = (values[max(len(values) - n + 1, 0):], valids[max(len(values) - n + 1, 0):])
            done = 0
            for b in held:
                span = slice(done, done + b.num_rows)
                done += b.num_rows
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out[span], mask=null[span])], names=[*b.schema.names, "_slid"])

        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= size:
                yield from answered(held)
                held, rows = [], 0
        if held:
            yield from answered(held)

    return fn


def rolling(f: SeriesFrame, x: Column, n: int, agg: str, minp: int) -> Column:
    """``agg`` (``q0.5``, any quantile; ``mad``) of the last ``n`` rows; nulls are skipped, null below ``minp`` values."""
    f.reached(n - 1, 0, x)
    inner = f.depth(x)
    value, name = fresh("v"), fresh("ranks")
    src = f.ordered(f.df.withColumn(value, x.cast("double")))
    schema = T.StructType([*src.schema.fields, T.StructField("_slid", T.DoubleType())])
    f.df = src.mapInArrow(_slid(f.symbol, value, n, agg, minp), schema).drop("_ord", value).withColumnRenamed("_slid", name)
    f.depths[name] = (inner[0] + n - 1, inner[1])
    return F.col(name)
