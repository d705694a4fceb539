"""Anomaly removal from a stream by isolation forests that are fitted again and again.

A symbol's records are numbered in the order they come (time order within a
micro-batch).  Forest ``v`` of a symbol is fitted on the ``window`` records that
end with number ``v * refit_every``, as soon as that many are there, and judges
the records behind it up to number ``(v + 1) * refit_every``.  Records before the
first forest pass.  So the rows kept depend on the order of the records alone:
any cut into micro-batches, and a single batch, give the same.

``foreachBatch`` writes, under the batch's number, the rows kept, the newest
``window`` records of each symbol and each symbol's newest forest.  A batch that
is run again replaces what it had written; a restarted stream goes on from the
files.  A forest is fitted where its records are judged, in one group of
(symbol, forest): at most ``window`` and ``refit_every`` records, however hot the
symbol; only the newest forests are written.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklake.operators.clean import grown_tree, isolation_scores
from ticklake.session import scratch_path


class ForestStream:
    """One stream's settings and folder; ``batch`` is the ``foreachBatch`` function.

    A record is dropped if its score is above the ``1 - contamination`` quantile of the scores of the records that its
    forest was fitted on.  Missing values count as above every split; the null symbol is a symbol like any other.
    Records must come in time order from one micro-batch to the next.
    """

    def __init__(self, schema: T.StructType, cols: list[str], folder: str, symbol: str = "symbol", ts: str = "ts", contamination: float = 0.1,
                 refit_every: int = 1000, window: int = 1000, n_trees: int = 100, sample_size: int = 256, seed: int = 42):
        if not 0 < contamination < 1 or min(refit_every, window, n_trees, sample_size) < 1:
            raise ValueError("contamination lies between 0 and 1; refit_every, window, n_trees and sample_size are positive")
        self.schema, self.cols, self.folder, self.symbol, self.ts = schema, list(cols), folder, symbol, ts
        self.contamination, self.every, self.window = contamination, refit_every, window
        self.n_trees, self.sample, self.seed = n_trees, sample_size, seed
        numeric = ", ".join(f"`{c}` double" for c in self.cols)
        kind = schema[symbol].dataType.simpleString()
        self.tail_schema = T._parse_datatype_string(f"`{symbol}` {kind}, _n long, {numeric}")
        self.forest_schema = T._parse_datatype_string(f"`{symbol}` {kind}, _v long, bound double, trees array<array<double>>")

    def _read(self, what: str, number: int, schema: T.StructType, spark) -> DataFrame:
        if number < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.folder}/{what}/batch={number}")

    def _write(self, df: DataFrame, what: str, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{what}/batch={number}")

    def _grown(self, pdf: pd.DataFrame):
        """The forest of one (symbol, forest) group of records, these records' values, and the rows a tree was grown from."""
        x = pdf.sort_values("_n")[self.cols].to_numpy(dtype=float)
        rng = np.random.default_rng([self.seed, int(pdf["_v"].iloc[0])])
        size = min(self.sample, len(x))
        return [grown_tree(x[rng.choice(len(x), size, replace=False)], rng) for _ in range(self.n_trees)], x, size

    def _fit(self):
        sym, share = self.symbol, 1 - self.contamination

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            forest, x, size = self._grown(pdf)
            bound = float(np.quantile(isolation_scores(forest, x, size), share))
            return pd.DataFrame({sym: pdf[sym].iloc[:1].to_numpy(), "_v": pdf["_v"].iloc[:1].to_numpy(), "bound": [bound], "trees": [[t.ravel().tolist() for t in forest]]})

        return fit

    def _judge(self, names: list[str]):
        cols, sample, share = self.cols, min(self.sample, self.window), 1 - self.contamination

        def judge(rows: pd.DataFrame, source: pd.DataFrame) -> pd.DataFrame:
            """``source``: the forest, if an earlier batch fitted it, or the records it is fitted on."""
            if len(rows) and len(source):
                x, held = rows[cols].to_numpy(dtype=float), source[source["bound"].notna()]
                if len(held):
                    forest = [np.asarray(t, dtype=float).reshape(-1, 5) for t in held["trees"].iloc[0]]
                    scores, bound = isolation_scores(forest, x, sample), held["bound"].iloc[0]
                else:
                    forest, seen, size = self._grown(source)
                    scores = isolation_scores(forest, np.concatenate((seen, x)), size)
                    bound, scores = np.quantile(scores[:len(seen)], share), scores[len(seen):]
                rows = rows[scores <= bound]
            return rows[names]

        return judge

    def batch(self, records: DataFrame, number: int) -> None:
        spark, sym, every, window = records.sparkSession, self.symbol, self.every, self.window
        names = self.schema.names
        tail = self._read("tail", number - 1, self.tail_schema, spark)
        seen = tail.groupBy(F.col(sym).alias("_s")).agg(F.max("_n").alias("_seen"))
        order = Window.partitionBy(sym).orderBy(self.ts, *self.cols, F.xxhash64(*names))
        rows = (records.select(*names).join(seen, F.col(sym).eqNullSafe(F.col("_s")), "left")
                .withColumn("_n", F.coalesce("_seen", F.lit(0)) + F.row_number().over(order)).drop("_s", "_seen"))
        self._write(rows, "numbered", number)
        numbered = T.StructType([*self.schema.fields, T.StructField("_n", T.LongType())])
        rows = self._read("numbered", number, numbered, spark)

        # the forests that this batch completes: their last record is one of its rows
        slim = rows.select(sym, "_n", *[F.col(c).cast("double").alias(c) for c in self.cols])
        known = tail.withColumn("_new", F.lit(False)).unionByName(slim.withColumn("_new", F.lit(True)))
        first = F.greatest(F.ceil(F.col("_n") / F.lit(every)), F.lit(-(-window // every))).cast("long")
        last = F.floor((F.col("_n") + F.lit(window - 1)) / F.lit(every)).cast("long")
        ends = known.groupBy(F.col(sym).alias("_s")).agg(F.max("_n").alias("_all"), F.max(F.when(~F.col("_new"), F.col("_n"))).alias("_old"))
        wanted = (known.withColumn("_v", F.explode(F.when(first <= last, F.sequence(first, last)))).join(ends, F.col(sym).eqNullSafe(F.col("_s")))
                  .where((F.col("_v") * every <= F.col("_all")) & (F.col("_v") * every > F.coalesce("_old", F.lit(0)))))
        older = self._read("newest", number - 1, self.forest_schema, spark)
        # a forest is fitted where it judges, and not written; only a symbol's newest one goes on to later batches
        source = wanted.select(sym, "_v", "_n", *self.cols).unionByName(older, allowMissingColumns=True)
        judged = rows.withColumn("_v", F.floor((F.col("_n") - 1) / F.lit(every)).cast("long"))
        kept = judged.groupBy(sym, "_v").cogroup(source.groupBy(sym, "_v")).applyInPandas(self._judge(names), self.schema)
        self._write(kept, "rows", number)

        counts = ends.select("_s", "_all")
        self._write(known.join(counts, F.col(sym).eqNullSafe(F.col("_s"))).where(F.col("_n") > F.col("_all") - window).select(*self.tail_schema.names), "tail", number)
        last = wanted.where(F.col("_v") == F.floor(F.col("_all") / F.lit(every))).select(sym, "_n", "_v", *self.cols)
        self._write(last.groupBy(sym, "_v").applyInPandas(self._fit(), self.forest_schema), "fitted", number)
        forests = older.unionByName(self._read("fitted", number, self.forest_schema, spark))
        newest = forests.groupBy(F.col(sym).alias("_s")).agg(F.max("_v").alias("_newest"))
        self._write(forests.join(newest, F.col(sym).eqNullSafe(F.col("_s")) & (F.col("_v") == F.col("_newest"))).select(*self.forest_schema.names), "newest", number)

    def kept(self, spark) -> DataFrame:
        """All rows kept so far."""
        return spark.read.schema(self.schema).parquet(f"{self.folder}/rows").drop("batch")


def run_forest(records: DataFrame, cols: list[str], name: str = "stream", folder: str | None = None, **settings) -> DataFrame:
    """Run the removal over everything available and return the rows kept as a table.

    ``records`` is a stream, or a table that is taken as one batch.  With the same ``folder`` a later call goes on where
    the last one stopped; None starts a new one below the checkpoint folder.
    """
    spark = records.sparkSession
    folder = folder or scratch_path(spark, f"{name}-forest")
    job = ForestStream(records.schema, cols, folder, **settings)
    if records.isStreaming:
        q = records.writeStream.option("checkpointLocation", f"{folder}/progress").foreachBatch(job.batch).trigger(availableNow=True).start()
        q.awaitTermination()
    else:
        job.batch(records, 0)
    return job.kept(spark)
