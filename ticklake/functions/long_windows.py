"""Rolling aggregates over long windows at a cost that does not grow with the window.

Spark computes a sliding frame anew for every row, so a frame of n rows costs
n steps a row.  Here the rows of a partition are cut into blocks of n rows by
their row number.  A window of n rows is the end of one block and the beginning
of the next: a running aggregate from the block's start up to the row, and one
from a row to the block's end, read n - 1 rows back.  Both are running frames
(one step a row; the second one runs over descending rows, since Spark is also
quadratic on frames that end in the future).

Extremes of the two pieces are compared, counts and sums added, and moments
merged around their own means, so nothing is subtracted from long prefix sums
and no digits cancel.  The blocks lie inside the frame's partitions: no shuffle
comes on top, only one more sort for the descending runs.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ticklake.plans.frame import SeriesFrame, fresh

#: Windows above this many rows take the blocks; below it a sliding frame is cheaper than a second sort.
LONG = 64

EXTREMES = {"max": (F.max, F.greatest), "min": (F.min, F.least)}
MOMENTS = {"sum": 1, "avg": 1, "var": 2, "varp": 2, "std": 2, "stdp": 2, "skew": 3, "kurt": 4, "count": 0}


def supported(agg: str) -> bool:
    return agg in EXTREMES or agg in MOMENTS


def _pieces(f: SeriesFrame, x: Column, n: int, wanted: dict) -> dict[str, tuple[Column, Column]]:
    """``name -> (beginning of the row's block, end of the block before)`` of each running aggregate.

    The end is null where the window is exactly one block, or starts before the series does.
    """
    block = fresh("blk")
    inner = f.depth(x)
    f.with_columns({block: F.floor((F.col("_rn") - 1) / F.lit(n))})
    up = Window.partitionBy(f.symbol, "_part", block).orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(f.symbol, "_part", block).orderBy(F.col("_rn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    heads, tails = {k: fresh(f"h{k}") for k in wanted}, {k: fresh(f"t{k}") for k in wanted}
    f.with_columns({heads[k]: fn(x).over(up) for k, fn in wanted.items()})
    f.with_columns({tails[k]: fn(x).over(down) for k, fn in wanted.items()})
    for name in (*heads.values(), *tails.values()):
        f.depths[name] = inner  # the n - 1 rows back are counted by the lag below
    whole = F.col("_rn") % F.lit(n) == 0
    return {k: (F.col(heads[k]), F.when(~whole, F.lag(F.col(tails[k]), n - 1).over(f.w))) for k in wanted}


def rolling(f: SeriesFrame, x: Column, n: int, agg: str, minp: int) -> Column:
    """``agg`` of the last ``n`` rows; nulls are skipped, null below ``minp`` values."""
    f.reached(n - 1, 0, x)
    if agg in EXTREMES:
        fn, pick = EXTREMES[agg]
        p = _pieces(f, x, n, {"n": F.count, "v": fn})
        value = pick(*p["v"])  # skips nulls
        held = p["n"][0] + F.coalesce(p["n"][1], F.lit(0))
    else:
        order = MOMENTS[agg]
        fns = {"n": F.count}
        if order == 1:
            fns["s"] = F.sum
        if order >= 2:
            fns.update({"m": F.avg, "v": F.var_pop})
        if order >= 3:
            fns["g"] = F.skewness
        if order >= 4:
            fns["k"] = F.kurtosis
        p = _pieces(f, x, n, fns)
        zero = F.lit(0.0)
        n1, n2 = p["n"][0].cast("double"), F.coalesce(p["n"][1], F.lit(0)).cast("double")
        held = p["n"][0] + F.coalesce(p["n"][1], F.lit(0))
        total = n1 + n2
        if agg == "count":
            value = held
        elif order == 1:
            s = F.when(held > 0, F.coalesce(p["s"][0], F.lit(0)) + F.coalesce(p["s"][1], F.lit(0)))
            value = s if agg == "sum" else F.try_divide(s.cast("double"), total)
        else:
            value = _moment(agg, order, p, n1, n2, total, zero)
    return F.when(held >= minp, value) if minp > 0 else value


def _moment(agg: str, order: int, p: dict, n1: Column, n2: Column, n: Column, zero: Column) -> Column:
    """Variance, skewness or kurtosis of two pieces together, from their own central moments."""
    both = lambda k: tuple(F.coalesce(v, zero) for v in p[k])
    (m1, m2), (v1, v2) = both("m"), both("v")
    d = F.when((n1 > 0) & (n2 > 0), m2 - m1).otherwise(zero)
    a2, b2 = v1 * n1, v2 * n2  # sums of squared deviations
    share = F.coalesce(F.try_divide(n1 * n2, n), zero)
    q2 = a2 + b2 + d * d * share
    if order == 2:
        down = n if agg in ("varp", "stdp") else F.when(n > 1, n - 1)
        var = F.try_divide(q2, down)
        return F.sqrt(var) if agg in ("std", "stdp") else var
    # Spark's skewness is sqrt(n) * q3 / q2^1.5, its kurtosis n * q4 / q2^2 - 3; null where q2 is 0
    third = lambda g, q, c: F.coalesce(F.try_divide(g * F.pow(q, F.lit(1.5)), F.sqrt(c)), zero)
    g1, g2 = both("g")
    a3, b3 = third(g1, a2, n1), third(g2, b2, n2)
    q3 = a3 + b3 + d * d * d * F.coalesce(F.try_divide(share * (n1 - n2), n), zero) + 3.0 * d * F.coalesce(F.try_divide(n1 * b2 - n2 * a2, n), zero)
    if order == 3:
        return F.try_divide(F.sqrt(n) * q3, F.pow(q2, F.lit(1.5)))
    fourth = lambda k, q, c: F.when((c > 0) & (q > 0), F.try_divide((k + 3.0) * q * q, c)).otherwise(zero)
    k1, k2 = p["k"]
    a4, b4 = F.coalesce(fourth(k1, a2, n1), zero), F.coalesce(fourth(k2, b2, n2), zero)
    n_2 = n * n
    q4 = (a4 + b4 + F.pow(d, F.lit(4.0)) * F.coalesce(F.try_divide(share * (n1 * n1 - n1 * n2 + n2 * n2), n_2), zero)
          + 6.0 * d * d * F.coalesce(F.try_divide(n1 * n1 * b2 + n2 * n2 * a2, n_2), zero)
          + 4.0 * d * F.coalesce(F.try_divide(n1 * b3 - n2 * a3, n), zero))
    return F.try_divide(n * q4, q2 * q2) - 3.0
