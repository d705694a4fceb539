"""Cleaning pipeline for bar tables.

Every step is a DataFrame -> DataFrame transformation run per symbol over a
``SeriesFrame`` (the reference cleans the whole frame across symbols; we
never mix symbols).  Unbounded steps (forward / backward fill,
interpolation, EWM denoising, seeded EMAs) go through the distributed scan
engine; whole-history statistics (z-score / IQR bounds) are per-symbol
aggregates joined back.
"""

from __future__ import annotations

import bisect
import datetime as _dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklake.functions import blocks as B
from ticklake.functions.blocks import C, dv, lag
from ticklake.operators.registry import _advance_all
from ticklake.operators.selection import exact_quantiles
from ticklake.plans.frame import SeriesFrame
from ticklake.session import written

PRICE_COLS = ["open", "high", "low", "close"]
OHLCV = ["open", "high", "low", "close", "volume"]


class DataValidationError(ValueError):
    def __init__(self, msg, details=None):
        super().__init__(msg)
        self.details = details or {}


# ------------------------------------------------------------ validation
def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def require_columns(df: DataFrame, required=OHLCV, case_insensitive: bool = False) -> None:
    cols = [c.lower() for c in df.columns] if case_insensitive else list(df.columns)
    missing = [c for c in required if (c.lower() if case_insensitive else c) not in cols]
    if missing:
        raise DataValidationError(f"Missing required columns: {missing}", {"missing_columns": missing})


def offenders(df: DataFrame, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """Every key that validation objects to: its ``problem`` (``duplicate``, or
    the name of a column with a negative value) and how many rows have it."""
    keys = [symbol, ts] if symbol in df.columns else [ts]
    pcs = [c for c in PRICE_COLS if c in df.columns]
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("duplicate"), *[F.sum((F.col(c) < 0).cast("int")).alias(c) for c in pcs])
    found = F.array(F.struct(F.lit("duplicate").alias("problem"), F.when(F.col("duplicate") > 1, F.col("duplicate")).alias("n")),
                    *[F.struct(F.lit(c).alias("problem"), F.when(F.col(c) > 0, F.col(c)).alias("n")) for c in pcs])
    return per.select(*keys, F.explode(F.filter(found, lambda x: x["n"].isNotNull())).alias("_p")).select(*keys, "_p.problem", "_p.n")


def validate(df: DataFrame, required=OHLCV, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """Schema check (no job), then one job that looks for the first offender.
    The error carries all offenders as a DataFrame (``details["offenders"]``);
    its message names a few of them."""
    require_columns(df, required)
    bad = offenders(df, symbol, ts)
    some = bad.orderBy((F.col("problem") != "duplicate"), "problem", *[c for c in bad.columns if c not in ("problem", "n")]).limit(20).collect()
    if some:
        first = some[0]["problem"]
        rows = [tuple(r[:-2]) for r in some if r["problem"] == first]
        if first == "duplicate":
            raise DataValidationError(f"Duplicate timestamps found: {rows}", {"duplicate_timestamps": rows, "offenders": bad})
        raise DataValidationError(f"Negative values found in column {first}", {"column": first, "negative_indices": rows, "offenders": bad})
    return df


def validate_symbols(df: DataFrame, symbol: str = "symbol", date_col: str | None = None) -> DataFrame:
    """Adds ``valid``: alphanumeric symbol and a ``%Y%m%d %H:%M:%S`` (or
    empty) date string; callers split the quarantine with a filter."""
    ok = F.col(symbol).rlike("^[A-Za-z0-9]+$")
    if date_col:
        d = F.col(date_col)
        ok = ok & ((d == "") | F.try_to_timestamp(d, F.lit("yyyyMMdd HH:mm:ss")).isNotNull())
    return df.withColumn("valid", F.coalesce(ok, F.lit(False)))


# ------------------------------------------------------------------ fills
def _frame(df, symbol, ts, segment, lookback=2):
    return df if isinstance(df, SeriesFrame) else SeriesFrame(df, symbol, ts, segment=segment, lookback=lookback)


def _num_cols(df: DataFrame, exclude) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude
            and not f.name.startswith("_")]


def impute(df, method: str = "forward_fill", backward_fill: bool = False, cols=None, symbol="symbol", ts="ts",
           segment="auto") -> DataFrame:
    """``forward_fill`` (+ optional backward fill of what is still missing)
    or ``interpolate`` (linear by position, ends take the nearest value)."""
    f = _frame(df, symbol, ts, segment)
    cols = cols or _num_cols(f.df, (symbol, ts))

    def gen(f):
        out = {}
        if method == "forward_fill":
            ff = yield tuple(B.ffill(f, c) for c in cols)
            out = dict(zip(cols, ff))
            if backward_fill:
                bf = yield tuple(B.bfill(f, out[c]) for c in cols)
                out = {c: F.coalesce(out[c], b) for c, b in zip(cols, bf)}
        elif method == "interpolate":
            rn = F.col("_rn").cast("double")
            prev = yield tuple(B.ffill(f, c) for c in cols) + tuple(
                B.ffill(f, F.when(C(c).isNotNull(), rn)) for c in cols)
            nxt = yield tuple(B.bfill(f, c) for c in cols) + tuple(
                B.bfill(f, F.when(C(c).isNotNull(), rn)) for c in cols)
            k = len(cols)
            for i, c in enumerate(cols):
                pv, pr, nv, nr = prev[i], prev[k + i], nxt[i], nxt[k + i]
                lin = pv + (nv - pv) * dv(rn - pr, nr - pr)
                out[c] = F.coalesce(C(c), lin, pv, nv)
        else:
            raise ValueError(f"unknown imputation method {method!r}")
        return out

    f.with_columns(_advance_all(f, [(gen, {}, {})]))
    return f.result() if not isinstance(df, SeriesFrame) else f


def _history_stats(f: SeriesFrame, cols, method: str, exact: bool):
    """Mean and deviation, or quartiles, of each symbol's history."""
    real = f.df.filter(~F.col("_halo"))
    if method == "zscore":
        return real.groupBy(f.symbol).agg(*[a for c in cols for a in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))])
    if exact:
        return exact_quantiles(real, f.symbol, cols, [0.25, 0.75]).withColumnsRenamed({c: f"__q_{c}" for c in cols})
    return real.groupBy(f.symbol).agg(*[F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.75)), 100000).alias(f"__q_{c}") for c in cols])


def remove_outliers(df, method: str = "zscore", threshold: float = 3.0, factor: float = 1.5, cols=None,
                    exact: bool = True, symbol="symbol", ts="ts", segment="auto", observation=None, count_as: str | None = None):
    """Null values with |z| > threshold (population std over the symbol's
    history) or outside [Q1 - factor*IQR, Q3 + factor*IQR], then forward
    fill.  Bounds are a per-symbol aggregate joined back.  Quartiles are exact
    (``selection``: no state that grows with a symbol); ``exact=False`` takes a
    bounded quantile sketch instead, in one pass.  ``count_as``
    names a column that says how many values of a row were outliers."""
    f = _frame(df, symbol, ts, segment)
    cols = cols or _num_cols(f.df, (symbol, ts))
    if method not in ("zscore", "iqr"):
        raise ValueError(method)
    st = _history_stats(f, cols, method, exact)
    f.df = f.df.join(st, symbol, "left")
    masked = {}
    flags = []
    for c in cols:
        x = C(c)
        if method == "zscore":
            bad = F.abs(dv(x - F.col(f"__m_{c}"), F.col(f"__s_{c}"))) > threshold
        elif method == "iqr":
            q1, q3 = F.col(f"__q_{c}")[0], F.col(f"__q_{c}")[1]
            iqr = q3 - q1
            bad = (x < q1 - factor * iqr) | (x > q3 + factor * iqr)
        bad = F.coalesce(bad, F.lit(False))
        masked[c] = F.when(bad, F.lit(None).cast("double")).otherwise(x.cast("double"))
        flags.append(bad.cast("int"))
    f.with_columns({"__outliers": sum(flags[1:], flags[0])})
    f.with_columns(masked)

    def gen(f):
        ff = yield tuple(B.ffill(f, c) for c in cols)
        return dict(zip(cols, ff))

    f.with_columns(_advance_all(f, [(gen, {}, {})]))
    drop = [c for c in f.df.columns if c.startswith("__m_") or c.startswith("__s_") or c.startswith("__q_")]
    f.df = f.df.drop(*drop)
    if observation is not None:
        f.df = f.df.observe(observation, F.sum(F.when(~F.col("_halo"), F.col("__outliers"))).alias("outliers_removed"))
    if count_as:
        f.df = f.df.withColumn(count_as, F.col("__outliers"))
    f.df = f.df.drop("__outliers")
    return f if isinstance(df, SeriesFrame) else f.result()


def denoise(df, span: int = 5, cols=None, symbol="symbol", ts="ts", segment="auto") -> DataFrame:
    """``ewm(span, adjust=True).mean()`` of every numeric column (incl. volume)."""
    f = _frame(df, symbol, ts, segment)
    cols = cols or _num_cols(f.df, (symbol, ts))
    alpha = 2.0 / (span + 1)

    def gen(f):
        ys = yield tuple(B.ewm_adjusted(f, c, alpha, minp=0) for c in cols)
        return {c: y for c, y in zip(cols, ys)}

    f.with_columns(_advance_all(f, [(gen, {}, {})]))
    return f if isinstance(df, SeriesFrame) else f.result()


def rsi_simple(df, window: int = 14, fillna_method: str | None = None, close="close", symbol="symbol", ts="ts",
               segment="auto") -> DataFrame:
    """RSI from simple rolling means of gains and losses: 100 when there are
    no losses, null when there is no movement at all."""
    f = _frame(df, symbol, ts, segment, lookback=window + 1)
    d = C(close) - lag(f, close, 1)
    gain = B.sma(f, F.when(d > 0, d).otherwise(F.when(d.isNull(), None).otherwise(0.0)), window)
    loss = B.sma(f, F.when(d < 0, -d).otherwise(F.when(d.isNull(), None).otherwise(0.0)), window)
    rsi = F.when(loss != 0, 100 - 100 / (1 + gain / loss)).when((loss == 0) & (gain > 0), F.lit(100.0))
    f.with_columns({"rsi": rsi})
    if fillna_method == "ffill":
        def gen(f):
            v = yield B.ffill(f, "rsi")
            return {"rsi": v}
        f.with_columns(_advance_all(f, [(gen, {}, {})]))
    elif fillna_method == "zero":
        f.with_columns({"rsi": F.coalesce(F.col("rsi"), F.lit(0.0))})
    return f if isinstance(df, SeriesFrame) else f.result()


def macd_incremental(df, fast: int = 12, slow: int = 26, signal: int = 9, close="close", symbol="symbol", ts="ts",
                     segment="auto") -> DataFrame:
    """EMAs seeded with the first price there is, signal seeded with 0 (the
    streaming form, differs from the ``macd`` indicator).  Null before the
    first price; a missing price later leaves the averages where they are."""
    f = _frame(df, symbol, ts, segment)

    def gen(f):
        af, as_, ag = 2.0 / (fast + 1), 2.0 / (slow + 1), 2.0 / (signal + 1)
        x = C(close)
        seen = yield B.cumsum(f, F.when(x.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0)))
        seen = B.mat(f, seen)
        first, moves = (seen == 1) & x.isNotNull(), (seen > 1) & x.isNotNull()

        def average(share, v, seed):
            return B.linrec(f, F.when(moves, F.lit(1 - share)).otherwise(F.lit(1.0)),
                            F.when(first, seed).when(moves, share * v).otherwise(F.lit(0.0)))

        ef, es = yield average(af, x, x), average(as_, x, x)
        m = ef - es
        sg = yield average(ag, m, F.lit(0.0))
        return {"macd": F.when(seen > 0, m), "macd_signal": F.when(seen > 0, sg)}

    f.with_columns(_advance_all(f, [(gen, {}, {})]))
    return f if isinstance(df, SeriesFrame) else f.result()


# --------------------------------------------------------------- calendar
def _nth_weekday(y: Column, month: int, dow: int, n: int) -> Column:
    """n-th (1-based) weekday ``dow`` (1=Sun..7=Sat, Spark dayofweek) of a month."""
    first = F.make_date(y, F.lit(month), F.lit(1))
    off = (F.lit(dow) - F.dayofweek(first) + 7) % 7
    return F.date_add(first, off + 7 * (n - 1))


def _last_weekday(y: Column, month: int, dow: int) -> Column:
    last = F.last_day(F.make_date(y, F.lit(month), F.lit(1)))
    off = (F.dayofweek(last) - F.lit(dow) + 7) % 7
    return F.date_sub(last, off)


def _observed(d: Column) -> Column:
    """Saturday -> Friday, Sunday -> Monday."""
    dw = F.dayofweek(d)
    return F.when(dw == 7, F.date_sub(d, 1)).when(dw == 1, F.date_add(d, 1)).otherwise(d)


def holiday_rules(y: Column) -> list[tuple[str, Column]]:
    """US federal holidays of a year (observed dates), by their rules."""
    fixed = lambda m, d: _observed(F.make_date(y, F.lit(m), F.lit(d)))
    return [
        ("New Years Day", fixed(1, 1)),
        ("Birthday of Martin Luther King, Jr.", _nth_weekday(y, 1, 2, 3)),
        ("Washington's Birthday", _nth_weekday(y, 2, 2, 3)),
        ("Memorial Day", _last_weekday(y, 5, 2)),
        ("Juneteenth National Independence Day", F.when(y >= 2021, fixed(6, 19))),
        ("Independence Day", fixed(7, 4)),
        ("Labor Day", _nth_weekday(y, 9, 2, 1)),
        ("Columbus Day", _nth_weekday(y, 10, 2, 2)),
        ("Veterans Day", fixed(11, 11)),
        ("Thanksgiving Day", _nth_weekday(y, 11, 5, 4)),
        ("Christmas Day", fixed(12, 25)),
    ]


def holiday_dimension(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """The holidays of a year range as a table (11 rows a year)."""
    years = spark.range(first_year - 1, last_year + 2)
    rules = holiday_rules(F.col("id").cast("int"))
    hol = years.select(F.explode(F.array(*[F.struct(F.lit(n).alias("holiday"), d.alias("date")) for n, d in rules]))
                       .alias("h")).select("h.*").filter(F.col("date").isNotNull())
    return hol.filter((F.year("date") >= first_year) & (F.year("date") <= last_year))


def calendar_features(df: DataFrame, ts: str = "ts", day_of_week: bool = True, is_holiday: bool = True) -> DataFrame:
    """day_of_week (Monday=0) and is_holiday (by date; the reference only
    matches exact midnights).  The rules are evaluated for the row's own year
    and, for a New Year observed on 31 December, the next: an expression,
    without a join or a look at the data first."""
    out = df
    if day_of_week:
        out = out.withColumn("day_of_week", F.weekday(F.col(ts)))
    if is_holiday:
        y = F.year(F.col(ts))
        days = [d for _, d in holiday_rules(y)] + [_observed(F.make_date(y + 1, F.lit(1), F.lit(1)))]
        day = F.to_date(F.col(ts))
        out = out.withColumn("is_holiday", F.exists(F.array(*days), lambda d: F.coalesce(d == day, F.lit(False))))
    return out


# -------------------------------------------------------------- sentiment
def sentiment(docs: DataFrame, lexicon: DataFrame, text: str = "text", key: str = "doc_id",
              alpha: float = 15.0) -> DataFrame:
    """Compound score per text: tokens (lower-cased words) joined to a
    ``(word, valence)`` lexicon, summed, normalised to s / sqrt(s^2 + alpha).
    Blank or non-string text -> 0.0.  Adaptive execution broadcasts the
    lexicon if its measured size allows, else the join shuffles on the word."""
    toks = (docs.select(key, F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z']+"))
                        .alias("word")).filter(F.col("word") != ""))
    s = toks.join(lexicon, "word").groupBy(key).agg(F.sum("valence").alias("__s"))
    return (docs.join(s, key, "left")
            .withColumn("sentiment", F.coalesce(F.col("__s") / F.sqrt(F.col("__s") * F.col("__s") + alpha),
                                                F.lit(0.0)))
            .drop("__s"))


# ---------------------------------------------------------------- anomaly
def grown_tree(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One isolation tree over the rows of ``x``: (feature, split, left, right, size) per node, -1 as a leaf's feature.

    Nodes are small, so they are split as lists; a single feature is sorted once, and a node is a slice of it.
    """
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes = []

    def split(lo, hi):
        if hi - lo == math.inf:
            raise OverflowError("a split between infinite values")
        return lo + (hi - lo) * rng.random()

    def halves(idx):
        ok = []
        for q, (col, gaps) in enumerate(columns):
            v = [col[i] for i in idx]
            v = [y for y in v if y == y] if gaps else v
            lo, hi = min(v, default=0.0), max(v, default=0.0)
            if hi > lo:
                ok.append((q, lo, hi))
        if not ok:
            return None
        q, lo, hi = ok[int(rng.integers(len(ok)))]
        sp, col = split(lo, hi), columns[q][0]
        return q, sp, [i for i in idx if col[i] < sp], [i for i in idx if not col[i] < sp]

    def slices(idx):
        a, end = idx.start, min(idx.stop, known)
        if a >= end or not values[end - 1] > values[a]:
            return None
        sp = split(values[a], values[end - 1])
        m = bisect.bisect_left(values, sp, a, end)
        return 0, sp, range(a, m), range(m, idx.stop)

    def build(idx, depth):
        me = [-1.0, 0.0, -1.0, -1.0, float(len(idx))]
        nodes.append(me)
        parts = cut(idx) if depth < limit and len(idx) > 1 else None
        if parts is not None:
            me[0], me[1] = float(parts[0]), parts[1]
            me[2] = float(len(nodes))
            build(parts[2], depth + 1)
            me[3] = float(len(nodes))
            build(parts[3], depth + 1)

    if x.shape[1] == 1:
        cut, values, known = slices, np.sort(x[:, 0]).tolist(), int(np.count_nonzero(~np.isnan(x[:, 0])))
    else:
        cut, columns = halves, [(c.tolist(), bool(np.isnan(c).any())) for c in x.T]
    build(range(len(x)), 0)
    return np.array(nodes)


def _usual_depth(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    return 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else (1.0 if n == 2 else 0.0)


def isolation_scores(forest: list[np.ndarray], x: np.ndarray, sample: int) -> np.ndarray:
    """Scores in (0, 1] of the rows of ``x``, higher as more anomalous; a missing value lies above every split."""
    usual = _usual_depth(sample)
    depth = np.zeros(len(x))
    most = max((int(nodes[:, 4].max()) for nodes in forest), default=0)
    usuals = np.array([_usual_depth(n) for n in range(most + 1)])
    one = x[:, 0] if x.shape[1] == 1 else None
    for nodes in forest:
        rest = usuals[nodes[:, 4].astype(int)]
        if one is not None:
            # a single feature: the leaves, in the order of the nodes, are the intervals between the sorted splits
            level, at = 0, np.zeros(1, dtype=int)
            while len(at):
                rest[at] += level
                inner = at[nodes[at, 0] >= 0]
                at, level = nodes[inner, 2:4].astype(int).ravel(), level + 1
            leaf = nodes[:, 0] < 0
            depth += rest[leaf][np.searchsorted(np.sort(nodes[~leaf, 1]), one, side="right")]
            continue
        cur = np.zeros(len(x), dtype=int)
        inner = np.flatnonzero(nodes[cur, 0] >= 0)
        while len(inner):
            at = cur[inner]
            left = x[inner, nodes[at, 0].astype(int)] < nodes[at, 1]
            cur[inner] = np.where(left, nodes[at, 2], nodes[at, 3]).astype(int)
            depth[inner] += 1
            inner = inner[nodes[cur[inner], 0] >= 0]
        depth += rest[cur]
    avg = depth / max(len(forest), 1)
    return np.power(2.0, -avg / usual) if usual > 0 else np.zeros(len(x))


def anomaly_scores(df: DataFrame, cols: list[str], n_trees: int = 100, sample_size: int = 256, seed: int = 42,
                   key: str | None = None) -> DataFrame:
    """Isolation-forest scores.  One rule at every size: each row is dealt to
    about ``1.5 * n_trees * sample_size / rows`` trees (at most all of them),
    by a hash of its values, so the sample does not depend on partitions.
    Trees are grown in parallel (one Spark group per tree, on the
    ``sample_size`` smallest hashes dealt to it: bounded), collected as small
    arrays (n_trees x 2*sample_size nodes), broadcast, and every row is scored
    in Arrow batches by ``mapInPandas``.  Higher score = more anomalous."""
    spark = df.sparkSession
    num = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    total = num.count()
    if total == 0:
        return df.withColumn("anomaly_score", F.lit(None).cast("double"))
    shares = min(float(n_trees), 1.5 * n_trees * sample_size / total)
    h = F.xxhash64(*cols, F.lit(seed))
    unit = F.pmod(h, F.lit(1 << 20)) / float(1 << 20)
    copies = F.lit(int(shares)) + (unit < shares - int(shares)).cast("int")
    begin = F.pmod(F.shiftright(h, 20), F.lit(n_trees)).cast("int")
    samp = (num.withColumn("_copies", copies).where("_copies > 0").withColumn("_begin", begin)
            .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
            .withColumn("tree", ((F.col("_begin") + F.col("_i")) % n_trees).cast("int"))
            .withColumn("_h", F.xxhash64(*cols, F.col("tree"))).drop("_copies", "_begin", "_i"))
    k = len(cols)
    schema = "tree int, nodes array<double>"

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("_h", kind="stable").head(sample_size)[cols].to_numpy(dtype=float)
        return pd.DataFrame({"tree": [t], "nodes": [grown_tree(x, np.random.default_rng(seed * 7919 + t)).ravel().tolist()]})

    trees = samp.groupBy("tree").applyInPandas(grow, schema).collect()  # n_trees small arrays
    forest = [np.array(r["nodes"]).reshape(-1, 5) for r in trees]
    bc = spark.sparkContext.broadcast(forest)
    psi = min(sample_size, total)

    out_schema = T.StructType(list(df.schema.fields) + [T.StructField("anomaly_score", T.DoubleType())])

    def score(batches):
        for pdf in batches:
            yield pdf.assign(anomaly_score=isolation_scores(bc.value, pdf[cols].to_numpy(dtype=float), psi))

    return df.mapInPandas(score, out_schema)


def remove_anomalies(df: DataFrame, cols: list[str], contamination: float = 0.1, **kw) -> DataFrame:
    """Keep inliers: rows whose score is below the (1 - contamination)
    quantile of all scores (a bounded sketch aggregate)."""
    sc = anomaly_scores(df, cols, **kw)
    thr = sc.agg(F.percentile_approx("anomaly_score", 1 - contamination, 100000).alias("t")).first()["t"]
    return sc.filter(F.col("anomaly_score") <= thr).drop("anomaly_score") if thr is not None else sc.drop(
        "anomaly_score")


# --------------------------------------------------------------- pipeline
class CleaningCounters:
    """What a run of ``clean`` did, observed while its rows pass by (no extra job).

    Each step leaves its count on the row; the sums are taken once, where the
    rows leave the ordered steps, and again behind the anomaly removal.
    """

    TALLIES = ("tally_before", "tally_after", "tally_outliers")

    def __init__(self):
        self.cleaned, self.kept = Observation(), Observation()
        self.anomalies = False

    def taken(self, df: DataFrame) -> DataFrame:
        """Sums of the tallies; their columns go."""
        before, after, outliers = (F.sum(F.col(c)) for c in self.TALLIES)
        return df.observe(self.cleaned, F.count(F.lit(1)).alias("rows"), F.coalesce(before, F.lit(0)).alias("missing_before"),
                          F.coalesce(before - after, F.lit(0)).alias("missing_imputed"),
                          F.coalesce(outliers, F.lit(0)).alias("outliers_removed")).drop(*self.TALLIES)

    def left(self, df: DataFrame) -> DataFrame:
        self.anomalies = True
        return df.observe(self.kept, F.count(F.lit(1)).alias("rows"))

    def read(self) -> dict[str, int]:
        """The counts; waits for an action on the cleaned rows."""
        got = dict(self.cleaned.get)
        got["anomalies_removed"] = got["rows"] - self.kept.get["rows"] if self.anomalies else 0
        return got


def clean(df: DataFrame, symbol: str = "symbol", ts: str = "ts", impute_method: str = "forward_fill",
          backward_fill: bool = True, outlier_method: str | None = "zscore", threshold: float = 3.0,
          span: int | None = 5, rsi_window: int | None = 14, macd=(12, 26, 9), calendar: bool = True,
          anomaly_contamination: float | None = None, segment="auto", observation: Observation | None = None,
          counters: CleaningCounters | None = None):
    """The batch cleaning pipeline: validate -> impute -> outliers -> denoise
    -> RSI -> MACD -> calendar -> anomalies.  ``observation`` collects
    rows / missing-before counters without an extra job, ``counters`` what
    every step did."""
    validate(df, symbol=symbol, ts=ts)
    cols = [c for c in OHLCV if c in df.columns]
    if observation is not None:
        df = df.observe(observation, F.count(F.lit(1)).alias("rows"),
                        sum((F.sum(F.col(c).isNull().cast("int")) for c in cols), F.lit(0)).alias("missing_before"))
    # one ordered frame (one shuffle, one row numbering) for all ordered steps
    f = SeriesFrame(df, symbol, ts, segment=segment, lookback=max(2, (rsi_window or 0) + 1))
    before, after, outliers = CleaningCounters.TALLIES
    nulls = lambda: sum((F.col(c).isNull().cast("long") for c in cols), F.lit(0).cast("long"))
    if counters is not None:
        f.with_columns({before: nulls()})
    impute(f, impute_method, backward_fill, cols, symbol, ts, segment)
    if counters is not None:
        f.with_columns({after: nulls(), outliers: F.lit(0).cast("long")})
    if outlier_method:
        remove_outliers(f, outlier_method, threshold, cols=cols, symbol=symbol, ts=ts, segment=segment,
                        count_as=outliers if counters is not None else None)
    if span:
        denoise(f, span, cols, symbol, ts, segment)
    if rsi_window:
        rsi_simple(f, rsi_window, None, "close", symbol, ts, segment)
    if macd:
        macd_incremental(f, *macd, close="close", symbol=symbol, ts=ts, segment=segment)
    out = f.result()
    if counters is not None:
        out = counters.taken(out)
    if calendar:
        out = calendar_features(out, ts)
    if anomaly_contamination:
        # counting, growing, the threshold and the scoring read one written table
        out = remove_anomalies(written(out, "cleaned"), cols, anomaly_contamination)
        if counters is not None:
            out = counters.left(out)
    return out
