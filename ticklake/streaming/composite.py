"""Outer join of many streams on event time, with the last values carried on.

The sources are put into one stream, each row's columns in a struct named after
its source, and grouped by time under one watermark.  That is the outer join of
any number of streams with one state store and one shuffle, instead of a chain
of two-sided joins that hold every row once per side.  A time is released when
the watermark has passed it, so the times of a micro-batch all lie behind those
of the batches before.

The fill follows in ``foreachBatch``: a batch's rows are filled in order of
time, with the values that the batch before left as the start.  Rows and the
values left are written under the batch's number, so a batch that is run again
replaces what it had written, and a restarted stream goes on from the files.

Rows that come later than the watermark are dropped, as in any stream; feed the
sources in time order, or widen the watermark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklake.session import scratch_path


def _names(sources: dict[str, DataFrame], ts: str) -> dict[tuple[str, str], str]:
    """Output name of each source's column: suffixed with the source where several sources have it."""
    held = [c for d in sources.values() for c in d.columns if c != ts]
    return {(s, c): f"{c}_{s}" if held.count(c) > 1 else c for s, d in sources.items() for c in d.columns if c != ts}


def joined(sources: dict[str, DataFrame], ts: str = "ts", watermark: str = "2 hours") -> DataFrame:
    """One row per time that any source has.  A source brings one row per time (bars do); of several the one with the
    greatest values stays, whole."""
    if not sources:
        raise ValueError("no sources")
    names = _names(sources, ts)
    sides = []
    for s, d in sources.items():
        cols = [c for c in d.columns if c != ts]
        sides.append(d.select(F.col(ts).cast("timestamp").alias("__at"), F.struct(*[F.col(c).alias(names[s, c]) for c in cols]).alias(s)))
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides)
    at = together.withWatermark("__at", watermark).groupBy("__at").agg(*[F.max(s).alias(s) for s in sources])
    return at.select(F.col("__at").alias(ts), *[F.col(f"`{s}`.`{n}`").alias(n) for (s, _), n in names.items()])


def run_filled(sources: dict[str, DataFrame], name: str, ts: str = "ts", watermark: str = "2 hours", folder: str | None = None) -> DataFrame:
    """Run the join over everything available and return the filled rows as a table.

    ``folder`` holds rows, carried values and the stream's own progress; with the same folder a later call goes on
    where the last one stopped.  None starts a new one below the checkpoint folder.
    """
    stream = joined(sources, ts, watermark)
    spark = stream.sparkSession
    folder = folder or scratch_path(spark, f"{name}-composite")
    cols = [c for c in stream.columns if c != ts]
    left = {f.name: f.dataType for f in stream.schema.fields}

    def fill(batch: DataFrame, number: int) -> None:
        # the batch before wrote its last values; the first batch has none
        carried = spark.read.schema(stream.schema).parquet(f"{folder}/carry/batch={number - 1}") if number else None
        start = carried.first() if carried is not None else None  # one row of one value per column
        running = Window.partitionBy(F.lit(0)).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)  # one batch of one series
        known = lambda c: F.lit(start[c] if start is not None else None).cast(left[c])
        batch.select(ts, *[F.coalesce(F.last(c, ignorenulls=True).over(running), known(c)).alias(c) for c in cols]) \
            .write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        rows = spark.read.schema(stream.schema).parquet(f"{folder}/rows/batch={number}")
        last = [F.coalesce(F.max_by(F.struct(*cols), ts)[c], known(c)).alias(c) for c in cols]
        newest = F.coalesce(F.max(ts), F.lit(start[ts] if start is not None else None).cast("timestamp")).alias(ts)
        rows.agg(newest, *last).select(stream.columns).write.mode("overwrite").parquet(f"{folder}/carry/batch={number}")

    q = (stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/progress")
         .foreachBatch(fill).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").drop("batch")
