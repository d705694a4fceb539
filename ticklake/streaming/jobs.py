"""Structured Streaming jobs.

* ``stream_bars``: ticks -> OHLCV bars per event-time window with a
  watermark (append mode: a bar is emitted once the watermark passes it).
* ``incremental_indicators``: per-symbol state (previous price, ring buffer
  of the last ``window`` gains / losses, three EMA states) in
  ``applyInPandasWithState``; every record advances the state exactly once
  (the reference re-feeds overlapping buffers and double-counts).
* ``count_buffer``: once ``buffer_size`` records of the last ``window`` are
  held, each new record is emitted with its gaps filled from them.
* ``whole_buffer``: as ``count_buffer``, but every record emits all the records held.
* ``polled``: overlapping polls of a source, each record once.
* ``remove_stream_anomalies``: running statistics per symbol as state.
* ``join_streams``: stream-stream full outer join of two bar streams on ts
  with watermarks and an equality time bound.
* ``split_json_stream``: ``from_json`` of a value column, records and rows
  that do not parse to two tables through ``foreachBatch``.

A symbol's rows are taken in time order within a micro-batch's chunk; the size
of a micro-batch is bounded by the source's trigger options.

State lives in the checkpoint folder (``spark.checkpoint.dir``), so a
restarted query resumes instead of losing it.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ticklake.session import scratch_path

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """The driver's ``events`` table as a file stream (its ts is NTZ; cast to
    timestamp so watermarks apply)."""
    return (spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events*.parquet")
            .option("maxFilesPerTrigger", max_files).parquet(sf_dir)
            .withColumn("ts", F.col("ts").cast("timestamp")))


CLOSING = "__closing__"


def rows_in_order(rows: DataFrame, name: str, symbol: str = "symbol", ts: str = "ts", parts: int = 4) -> str:
    """A replay of a table for tests of streams: ``parts`` files, one after another in time, and a row far ahead that
    lets the watermark release the last windows (its symbol is ``CLOSING``, its other columns are null).  Each file is
    written by one task, in time order, so that it is one micro-batch.  Returns the folder, below the checkpoint folder."""
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    cuts = rows.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)], 10_000).alias("c"), F.max(ts).alias("m")).first()
    edges = cuts["c"] or []
    number = sum([(at >= edge).cast("int") for edge in edges], F.lit(0))
    dealt = scratch_path(spark, f"{name}-dealt")  # the table is read once, by all tasks; a part's task reads its own rows
    rows.withColumn("_file", number).write.partitionBy("_file").parquet(dealt)
    dealt = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_file", T.IntegerType())])).parquet(dealt)
    for k in range(len(edges) + 1):
        dealt.where(F.col("_file") == k).select(*rows.columns).coalesce(1).sortWithinPartitions(ts).write.mode("append").parquet(path)
    fixed = {symbol: F.lit(CLOSING), ts: F.lit(cuts["m"]) + F.expr("INTERVAL 30 DAYS")}
    last = spark.range(1).select(*[fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    last.coalesce(1).write.mode("append").parquet(path)
    return path


def events_in_order(spark: SparkSession, sf_dir: str, parts: int = 4) -> str:
    """``rows_in_order`` of the ``events`` table."""
    return rows_in_order(spark.read.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet"), "events-in-order", "event_type", parts=parts)


def ordered_stream(spark: SparkSession, path: str) -> DataFrame:
    """``events_in_order`` as a stream of one file per micro-batch."""
    return (spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
            .withColumn("ts", F.col("ts").cast("timestamp")))


def fetch(spark: SparkSession, path: str, mode: str = "batch", schema=None, fmt: str = "parquet", **opts) -> DataFrame:
    """Same source as a batch read or a stream: downstream transforms are shared."""
    r = spark.readStream if mode == "stream" else spark.read
    if schema is not None:
        r = r.schema(schema)
    for k, v in opts.items():
        r = r.option(k, v)
    return r.format(fmt).load(path)


def stream_bars(ticks: DataFrame, symbol: str = "event_type", ts: str = "ts", price: str = "value",
                every: str = "1 hour", watermark: str = "1 hour", order: str = "event_id") -> DataFrame:
    """Tumbling event-time bars; first / last by (ts, order)."""
    o = F.struct(F.col(ts), F.col(order))
    return (ticks.withWatermark(ts, watermark)
            .groupBy(F.col(symbol).alias("symbol"), F.window(ts, every).alias("w"))
            .agg(F.min_by(price, o).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
                 F.max_by(price, o).alias("close"), F.count(F.lit(1)).cast("long").alias("volume"))
            .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume"))


def run_to_table(df: DataFrame, name: str, output_mode: str = "append", fmt: str = "parquet"):
    """Run a stream over everything available now into a parquet table in
    the shared checkpoint folder; returns the table as a batch DataFrame."""
    spark = df.sparkSession
    out, ck = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ck")
    q = (df.writeStream.format(fmt).outputMode(output_mode).option("checkpointLocation", ck)
         .trigger(availableNow=True).start(out))
    q.awaitTermination()
    return spark.read.format(fmt).load(out)


# ------------------------------------------------------ incremental state
INC_OUT = "symbol string, ts timestamp, close double, rsi double, macd double, macd_signal double"
INC_STATE = ("prev double, gains array<double>, losses array<double>, ef double, es double, sg double, "
             "started boolean")


def _incremental_fn(window: int, fast: int, slow: int, signal: int):
    af, asl, ag = 2.0 / (fast + 1), 2.0 / (slow + 1), 2.0 / (signal + 1)

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            prev, gains, losses, ef, es, sg, started = state.get
            gains, losses = list(gains), list(losses)
        else:
            prev, gains, losses, ef, es, sg, started = None, [], [], None, None, 0.0, False
        out = []
        for t, p in ((t, p) for pdf in pdfs for t, p in zip(*(pdf.sort_values("ts")[c] for c in ("ts", "close")))):
            # incremental RSI: ring buffer of the last `window` gains / losses
            if prev is None or (isinstance(prev, float) and math.isnan(prev)) or not started:
                rsi = float("nan")
            else:
                d = p - prev
                gains.append(max(d, 0.0))
                losses.append(max(-d, 0.0))
                gains, losses = gains[-window:], losses[-window:]
                if len(gains) < window:
                    rsi = float("nan")
                else:
                    ag_, al_ = math.fsum(gains) / window, math.fsum(losses) / window
                    rsi = 100.0 if al_ == 0 else 100 - 100 / (1 + ag_ / al_)
            # incremental MACD: EMAs seeded with the first price, signal with 0
            if not started:
                ef, es, sg, m = p, p, 0.0, 0.0
            else:
                ef = p * af + ef * (1 - af)
                es = p * asl + es * (1 - asl)
                m = ef - es
                sg = m * ag + sg * (1 - ag)
            started = True
            prev = p
            out.append((key[0], t, p, rsi, m, sg))
        state.update((prev, gains, losses, ef, es, sg, started))
        yield pd.DataFrame(out, columns=["symbol", "ts", "close", "rsi", "macd", "macd_signal"])

    return fn


def incremental_indicators(bars: DataFrame, window: int = 14, fast: int = 12, slow: int = 26,
                           signal: int = 9) -> DataFrame:
    """Per-symbol streaming RSI (simple-mean ring buffer) and MACD."""
    return bars.groupBy("symbol").applyInPandasWithState(
        _incremental_fn(window, fast, slow, signal), INC_OUT, INC_STATE, "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------- count buffer
BUF_STATE = "n long, vals array<double>, at array<long>"


def count_buffer(records: DataFrame, buffer_size: int = 100, window: int = 252, cols=("close", "open")) -> DataFrame:
    """Over the last ``window`` records per symbol: once ``buffer_size`` are
    held, each new record is emitted with its nulls filled by the last value
    the buffer holds.  Never emits when buffer_size > window.

    The newest record stands last, so only the last value of each column and
    its position matter: the state is two numbers per column."""
    cols = list(cols)
    out_schema = "symbol string, ts timestamp, " + ", ".join(f"`{c}` double" for c in cols)

    def fn(key, pdfs, state: GroupState):
        n, vals, at = state.get if state.exists else (0, [math.nan] * len(cols), [0] * len(cols))
        vals, at = list(vals), list(at)
        for pdf in pdfs:
            pdf = pdf.sort_values("ts")
            out = []
            for row in zip(pdf["ts"], *[pdf[c].astype("float64") for c in cols]):
                n += 1
                for i, v in enumerate(row[1:]):
                    if v == v:
                        vals[i], at[i] = v, n
                if min(n, window) >= buffer_size:
                    out.append((key[0], row[0], *[v if k and n - k < window else math.nan for v, k in zip(vals, at)]))
            yield pd.DataFrame(out, columns=["symbol", "ts", *cols])
        state.update((n, vals, at))

    return records.groupBy("symbol").applyInPandasWithState(fn, out_schema, BUF_STATE, "append", GroupStateTimeout.NoTimeout)


RING_STATE = "n long, at array<timestamp>, vals array<double>"


def whole_buffer(records: DataFrame, buffer_size: int = 100, window: int = 252, cols=("close", "open")) -> DataFrame:
    """Over the last ``window`` records per symbol: once ``buffer_size`` are held, every record emits the whole buffer,
    gaps filled forward and then backward within it.

    ``number`` counts a symbol's records and tells the emissions apart; ``ts`` and the columns are the buffer's.  Up to
    ``window`` rows leave per record (``count_buffer`` emits the newest alone).  Never emits when buffer_size > window.
    State: the buffer.
    """
    cols = list(cols)
    out_schema = "symbol string, number long, ts timestamp, " + ", ".join(f"`{c}` double" for c in cols)

    step = max(200_000 // max(window, 1), 1)  # records whose buffers leave together

    def filled(vals, back, ahead, rows, lo, hi):
        # the last value that the buffer holds up to the row, else the first one behind it
        source = np.where(back[rows] >= lo, back[rows], np.where(ahead[rows] < hi, ahead[rows], -1))
        return np.where(source >= 0, vals[source], np.nan)

    def fn(key, pdfs, state: GroupState):
        n, at, vals = state.get if state.exists else (0, [], [])
        at, vals = np.array(pd.to_datetime(list(at)), dtype="datetime64[us]"), np.array(vals, dtype=float).reshape(-1, len(cols))
        for pdf in pdfs:
            pdf = pdf.sort_values("ts")
            held = len(at)
            at = np.concatenate((at, pdf["ts"].to_numpy(dtype="datetime64[us]")))
            vals = np.concatenate((vals, pdf[cols].to_numpy(dtype=float)))
            place = np.arange(len(at))[:, None]
            back = np.maximum.accumulate(np.where(np.isnan(vals), -1, place), axis=0)
            ahead = np.minimum.accumulate(np.where(np.isnan(vals), len(at), place)[::-1], axis=0)[::-1]
            for start in range(held + 1, len(at) + 1, step):
                ends = np.arange(start, min(start + step, len(at) + 1))
                size = np.minimum(ends, window)
                ends, size = ends[size >= buffer_size], size[size >= buffer_size]
                if not len(ends):
                    continue
                lo, hi = np.repeat(ends - size, size), np.repeat(ends, size)
                rows = lo + np.arange(len(lo)) - np.repeat(np.cumsum(size) - size, size)
                out = pd.DataFrame({"symbol": key[0], "number": n + hi - held, "ts": at[rows]})
                yield out.assign(**{c: filled(vals[:, k], back[:, k], ahead[:, k], rows, lo, hi) for k, c in enumerate(cols)})
            n += len(pdf)
            at, vals = at[-window:], vals[-window:]
        state.update((n, [t.to_pydatetime() for t in pd.DatetimeIndex(at)], vals.ravel().tolist()))

    return records.groupBy("symbol").applyInPandasWithState(fn, out_schema, RING_STATE, "append", GroupStateTimeout.NoTimeout)


# -------------------------------------------------------------- stream join
def join_streams(left: DataFrame, right: DataFrame, lname: str, rname: str, ts: str = "ts",
                 watermark: str = "2 hours") -> DataFrame:
    """Full outer stream-stream join on ts; value columns suffixed with the
    source name.  Watermarks bound the join state; forward fill of the
    result is a batch step (``foreachBatch`` or the composite join)."""
    lcols = [c for c in left.columns if c != ts]
    rcols = [c for c in right.columns if c != ts]
    l2 = left.select(F.col(ts).alias("__lt"), *[F.col(c).alias(f"{c}_{lname}") for c in lcols]).withWatermark("__lt",
                                                                                                          watermark)
    r2 = right.select(F.col(ts).alias("__rt"), *[F.col(c).alias(f"{c}_{rname}") for c in rcols]).withWatermark("__rt",
                                                                                                           watermark)
    j = l2.join(r2, F.expr("__lt = __rt AND __rt BETWEEN __lt - INTERVAL 0 SECONDS AND __lt + INTERVAL 0 SECONDS"),
                "full_outer")
    return j.select(F.coalesce("__lt", "__rt").alias(ts), *[c for c in j.columns if c not in ("__lt", "__rt")])


def parse_json_stream(stream: DataFrame, col: str, schema: str) -> DataFrame:
    """Parsed records beside the original columns, and ``bad``: the JSON did not parse."""
    j = F.from_json(F.col(col), schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    p = stream.withColumn("__j", j)
    bad = F.col(col).isNotNull() & (F.col("__j").isNull() | F.col("__j._bad").isNotNull())
    return p.withColumn("bad", bad).select("*", "__j.*").drop("__j", "_bad")


def split_json_stream(stream: DataFrame, col: str, schema: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Run the parser over everything available: (records, rows that did not parse).
    Each micro-batch goes to both tables, under the batch's own folder, so a
    batch that is run again after a failure replaces what it had written."""
    spark = stream.sparkSession
    good, bad, ck = (scratch_path(spark, f"{name}-{k}") for k in ("good", "bad", "ck"))
    parsed = parse_json_stream(stream, col, schema)

    def write(batch: DataFrame, number: int) -> None:
        batch.where("NOT bad").drop("bad", col).write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.where("bad").select(col).write.mode("overwrite").parquet(f"{bad}/batch={number}")

    q = parsed.writeStream.foreachBatch(write).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(good).drop("batch"), spark.read.parquet(bad).drop("batch")


def polled(snapshots: DataFrame, keys: list[str], ts: str = "ts", watermark: str = "1 day") -> DataFrame:
    """A polled source whose snapshots overlap: each record passes once, as long as
    it comes no later than the watermark after its first appearance."""
    return snapshots.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([*keys, ts])


# ---------------------------------------------------------------- anomalies
OUT_STATE = "n long, mean array<double>, m2 array<double>"


def remove_stream_anomalies(records: DataFrame, cols, warm: int = 100, threshold: float = 4.0) -> DataFrame:
    """Streaming anomaly filter: a record is dropped if a value lies further than
    ``threshold`` standard deviations from its symbol's mean so far.  The first
    ``warm`` records pass (there is nothing to judge by); dropped records do
    not enter the statistics.  State: count, mean and sum of squares per column
    (for refitted forests over all columns together see ``streaming.forest``)."""
    cols = list(cols)

    def fn(key, pdfs, state: GroupState):
        n, mean, m2 = state.get if state.exists else (0, [0.0] * len(cols), [0.0] * len(cols))
        mean, m2 = list(mean), list(m2)
        for pdf in pdfs:
            pdf = pdf.sort_values("ts")
            keep = []
            for row in zip(*[pdf[c].astype("float64") for c in cols]):
                odd = n >= warm and any(v == v and abs(v - m) > threshold * math.sqrt(q / n) for v, m, q in zip(row, mean, m2))
                keep.append(not odd)
                if not odd:
                    n += 1
                    for i, v in enumerate(row):
                        if v == v:
                            d = v - mean[i]
                            mean[i] += d / n
                            m2[i] += d * (v - mean[i])
            yield pdf[pd.Series(keep, index=pdf.index, dtype=bool)]
        state.update((n, mean, m2))

    return records.groupBy("symbol").applyInPandasWithState(fn, records.schema, OUT_STATE, "append", GroupStateTimeout.NoTimeout)
