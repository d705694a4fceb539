"""A bar cache in files that takes deltas in place.

The cache is parquet below ``symbol=.../span=.../``; a span is a calendar unit
of the bar's time.  ``merge`` reads only the spans that a delta touches (their
names are literals of the scan's partition filter), drops the cached rows whose
key the delta brings anew, and overwrites just those folders.  All other
folders are neither read nor written, so a refresh costs what it changes.

The delta wins on equal keys and is first reduced to one row per key, so the
same delta merged twice, or again after a driver was lost halfway through the
commit, gives the same cache.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake.session import written

FORMATS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def _span(ts: Column, unit: str) -> Column:
    return F.date_format(ts, FORMATS[unit])


class BarCache:
    """Bars by (symbol, ts) in files; rows without a symbol or time have no key and are refused."""

    def __init__(self, spark: SparkSession, path: str, unit: str = "month", symbol: str = "symbol", ts: str = "ts"):
        if unit not in FORMATS:
            raise ValueError(f"unit must be one of {', '.join(FORMATS)}")
        self.spark, self.path, self.unit, self.symbol, self.ts = spark, path, unit, symbol, ts

    def _exists(self) -> bool:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(place) and bool(fs.listStatus(place))

    def _files(self, schema=None) -> DataFrame:
        """The cached rows with their ``span``; partition names stay text (a symbol may look like a number)."""
        read = self.spark.read
        if schema is None:
            schema = self.spark.read.parquet(self.path).schema
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name not in (self.symbol, "span")]
        return read.schema(", ".join([*fields, f"`{self.symbol}` string", "span string"])).parquet(self.path)

    def _write(self, rows: DataFrame) -> None:
        (rows.repartition(self.symbol, "span").sortWithinPartitions(self.symbol, "span", self.ts)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.symbol, "span").parquet(self.path))

    def latest(self, delta: DataFrame, order: str | None) -> DataFrame:
        """One row per key of a delta: the one of the highest ``order``, ties and no order by the greatest values."""
        rest = [c for c in delta.columns if c not in (self.symbol, self.ts, order)]
        by = F.struct(*([F.col(order)] if order else []), *[F.col(c) for c in rest])
        best = delta.groupBy(self.symbol, self.ts).agg(F.max(F.struct(by.alias("by"), F.struct(*rest).alias("row"))).alias("best"))
        return best.select(self.symbol, self.ts, *[F.col(f"best.row.`{c}`").alias(c) for c in rest])

    def merge(self, delta: DataFrame, order: str | None = None) -> None:
        """Bring a delta into the cache.  New columns are added (null in older rows of untouched spans), missing ones are null."""
        sym, ts = self.symbol, self.ts
        rows = self.latest(delta, order).withColumn(sym, F.col(sym).cast("string")).withColumn("span", _span(F.col(ts), self.unit))
        fresh = written(rows, "cache-delta")
        if fresh.where(F.col(sym).isNull() | F.col(ts).isNull()).limit(1).count():
            raise ValueError(f"a delta's rows need {sym} and {ts}")
        if not self._exists():
            self._write(fresh)
            return
        self._write(self.merged(fresh))

    def merged(self, fresh: DataFrame) -> DataFrame:
        """The new content of the spans that ``fresh`` touches."""
        # the names of the folders to be replaced: the commit lists the same ones on the driver
        spans = [r["span"] for r in fresh.select("span").distinct().collect()]
        touched = fresh.select(self.symbol, "span").distinct()
        old = self._files().where(F.col("span").isin(spans)).join(touched, [self.symbol, "span"], "left_semi")
        kept = old.join(fresh.select(self.symbol, "span", self.ts), [self.symbol, "span", self.ts], "left_anti")
        return kept.unionByName(fresh, allowMissingColumns=True)

    def read(self, symbols: list[str] | None = None, start=None, end=None) -> DataFrame:
        """Cached bars with ``start <= ts <= end``; folders outside are pruned."""
        out = self.spark.read.option("mergeSchema", True).parquet(self.path)
        out = self._files(out.schema)
        if symbols is not None:
            out = out.where(F.col(self.symbol).isin(list(symbols)))
        for edge, keep in ((start, lambda c, e: c >= e), (end, lambda c, e: c <= e)):
            if edge is not None:
                at = F.lit(edge).cast("timestamp")
                out = out.where(keep(F.col("span"), _span(at, self.unit)) & keep(F.col(self.ts), at))
        return out.drop("span")
