"""Exact quantiles per key by bulk-synchronous selection.

``percentile`` keeps the distinct values of a key in one task's memory.  Here
each wanted rank has a bracket of values that surely holds it, at first the
whole key's range narrowed by a quantile sketch.  A round cuts every bracket
into ``BINS`` equal bins, counts the rows of each bin (partial sums before the
shuffle, one more bin below and above the bracket), walks the counts up to the
rank and takes that bin's own smallest and largest value as the next bracket.
The rank is met when they are the same value.  Bins are monotone in the value
whatever their rounding, so counts are exact ranks; a sketch that misses
only costs another round, since the outer bins hold the rest.

A round's state is at most ``BINS + 2`` rows per key, column and rank.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklake.session import written

BINS = 1024


def exact_quantiles(df: DataFrame, key: str, cols: list[str], probs: list[float], bins: int = BINS) -> DataFrame:
    """``key`` and one array column per column of ``cols``: its quantiles at ``probs``, between the two nearest
    ranks by linear interpolation (as ``percentile``).

    Nulls, NaN and infinities are no values; a column without values gives null.  The null key is a key like any other.
    ``df`` is written once, as keys and values only.  The table of brackets has a row per key, column and rank.
    """
    value = lambda c: F.when(F.abs(F.col(c).cast("double")) < F.lit(float("inf")), F.col(c).cast("double"))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), value(c).alias("x")) for i, c in enumerate(cols)])).alias("cell")
    data = written(df.select(F.col(key).alias("k"), cells).select("k", "cell.c", "cell.x").where("x IS NOT NULL"), "selection")

    slack = 0.001
    near = F.percentile_approx("x", [q for p in probs for q in (max(p - slack, 0.0), min(p + slack, 1.0))], 2000)
    whole = data.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"), near.alias("near"))
    ranks = F.explode(F.array(*[
        F.struct(F.lit(i).alias("p"), F.lit(j).alias("upper"), (F.floor if j == 0 else F.ceil)(F.lit(p) * (F.col("n") - 1)).alias("rank"),
                 F.get("near", F.lit(2 * i)).alias("lo"), F.get("near", F.lit(2 * i + 1)).alias("hi"))
        for i, p in enumerate(probs) for j in (0, 1)])).alias("t")
    open_ = written(whole.select("k", "c", "n", ranks).select("k", "c", "n", "t.*"), "brackets")
    met = []
    while True:
        narrowed = written(_narrowed(data, open_, bins), "brackets")
        met.append(narrowed.where("lo = hi"))
        open_ = narrowed.where("lo < hi")
        if open_.isEmpty():
            break
    found = reduce(DataFrame.unionByName, met)
    at = lambda i, j: F.max(F.when((F.col("p") == i) & (F.col("upper") == j), F.col("lo")))
    n = F.max("n") - 1
    share = [F.lit(p) * n - F.floor(F.lit(p) * n) for p in probs]
    quantiles = F.array(*[at(i, 0) + share[i] * (at(i, 1) - at(i, 0)) for i in range(len(probs))])
    per = found.groupBy("k", "c").agg(quantiles.alias("q"))
    wide = per.groupBy("k").agg(*[F.max(F.when(F.col("c") == i, F.col("q"))).alias(c) for i, c in enumerate(cols)])
    keys = df.select(F.col(key).alias("k")).distinct()
    return keys.join(wide, keys["k"].eqNullSafe(wide["k"]), "left").select(keys["k"].alias(key), *[wide[c] for c in cols])


def _narrowed(data: DataFrame, brackets: DataFrame, bins: int) -> DataFrame:
    """The brackets, each cut down to the bin that holds its rank."""
    mine = brackets.groupBy("k", "c").agg(F.collect_list(F.struct("p", "upper", "lo", "hi")).alias("ts"))  # two per quantile
    rows = data.alias("d").join(mine.alias("m"), F.col("d.k").eqNullSafe(F.col("m.k")) & (F.col("d.c") == F.col("m.c")))
    rows = rows.select("d.k", "d.c", "d.x", F.explode("m.ts").alias("t"))
    x, lo, hi = F.col("x"), F.col("t.lo"), F.col("t.hi")
    inside = F.coalesce(F.try_divide(x / 2 - lo / 2, hi / 2 - lo / 2), F.lit(0.0))  # halves: the range may not fit a double
    bin_ = F.when(x < lo, -1).when(x > hi, bins).otherwise(F.least(F.floor(inside * bins), F.lit(bins - 1))).cast("int")
    target = ["k", "c", "p", "upper"]
    counts = (rows.select("k", "c", F.col("t.p").alias("p"), F.col("t.upper").alias("upper"), bin_.alias("bin"), "x")
              .groupBy(*target, "bin").agg(F.count(F.lit(1)).alias("rows"), F.min("x").alias("low"), F.max("x").alias("high")))
    upto = F.sum("rows").over(Window.partitionBy(*target).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("upto", upto)
    b, s = brackets.select(*target, "n", "rank").alias("b"), counts.alias("s")
    same = F.col("b.k").eqNullSafe(F.col("s.k")) & reduce(lambda u, v: u & v, [F.col(f"b.{t}") == F.col(f"s.{t}") for t in target[1:]])
    holds = (F.col("s.upto") > F.col("b.rank")) & (F.col("s.upto") - F.col("s.rows") <= F.col("b.rank"))
    return b.join(s, same & holds).select("b.*", F.col("s.low").alias("lo"), F.col("s.high").alias("hi"))
