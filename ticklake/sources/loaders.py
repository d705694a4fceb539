"""File sources and sinks for bar tables, record feeds and caches.

Network clients of the reference (market data APIs, sockets) are not built:
their records enter as files (CSV / JSON / parquet) or file streams, read by
Spark with declared schemas.
"""

from __future__ import annotations

from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()),
                           T.StructField("open", T.DoubleType()), T.StructField("high", T.DoubleType()),
                           T.StructField("low", T.DoubleType()), T.StructField("close", T.DoubleType()),
                           T.StructField("volume", T.DoubleType())])
CACHE_COLS = ["open", "high", "low", "close", "volume", "average", "barCount"]


class DataFetchError(RuntimeError):
    pass


# ------------------------------------------------------------------ CSV
def load_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True,
             **options) -> DataFrame:
    """Batch CSV (gzip / bz2 decompressed by extension).  Without a schema
    the columns are inferred (a sampling pass), as the reference does."""
    r = spark.read.option("header", header)
    for k, v in options.items():
        r = r.option(k, v)
    if schema is not None:
        return r.schema(schema).csv(path)
    return r.option("inferSchema", True).csv(path)


def stream_csv(spark: SparkSession, path: str, schema: T.StructType | str, max_files_per_trigger: int = 1,
               header: bool = True) -> DataFrame:
    """Chunked CSV as a file stream (one or more files per micro-batch)."""
    return (spark.readStream.schema(schema).option("header", header)
            .option("maxFilesPerTrigger", max_files_per_trigger).csv(path))


# ----------------------------------------------------------------- JSON
def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Struct fields become top-level ``a.b`` columns (``json_normalize``)."""
    while True:
        structs = [f for f in df.schema.fields if isinstance(f.dataType, T.StructType)]
        if not structs:
            return df
        cols = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType):
                cols += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}{sep}{g.name}") for g in f.dataType.fields]
            else:
                cols.append(F.col(f"`{f.name}`"))
        df = df.select(*cols)


def read_json_records(spark: SparkSession, path: str, data_field: str | None = "data", schema=None,
                      multiline: bool = True) -> DataFrame:
    """Responses ``{data: [records]}`` (or plain records) -> one flat row per
    record; malformed documents are dropped."""
    r = spark.read.option("multiLine", multiline).option("mode", "DROPMALFORMED")
    df = r.schema(schema).json(path) if schema is not None else r.json(path)
    if data_field and data_field in df.columns:
        df = df.select(F.explode(data_field).alias("__rec")).select("__rec.*") \
            if isinstance(df.schema[data_field].dataType, T.ArrayType) else df.select(f"{data_field}.*")
    return flatten(df)


def parse_json_column(df: DataFrame, col: str, schema: T.StructType | str, bad_sink: Callable | None = None,
                      prefix: str | None = None) -> DataFrame:
    """``from_json`` of a string column, flattened; rows that do not parse
    are dropped (or handed to ``bad_sink(df)`` first)."""
    parsed = df.withColumn("__j", F.from_json(F.col(col), schema))
    if bad_sink is not None:
        bad_sink(parsed.filter(F.col("__j").isNull()).drop("__j"))
    good = parsed.filter(F.col("__j").isNotNull())
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    pre = f"{prefix or col}."
    return good.select(*[F.col(f"`{c}`") for c in df.columns],
                       *[F.col(f"__j.`{fld.name}`").alias(pre + fld.name) for fld in st.fields])


def read_or_fallback(spark: SparkSession, primary: str, cache: str | None, reader: Callable | None = None) -> DataFrame:
    """Read ``primary``; when it fails, read the cached JSON records at
    ``cache``; with no cache configured, an empty frame."""
    reader = reader or (lambda p: read_json_records(spark, p))
    try:
        df = reader(primary)
        df.schema  # force path resolution
        return df
    except Exception:  # noqa: BLE001 - any source failure falls back
        if cache:
            return read_json_records(spark, cache, data_field=None)
        return spark.createDataFrame([], T.StructType([]))


# -------------------------------------------------------------- parquet cache
def write_bar_cache(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Per-symbol partitioned parquet; ``overwrite`` replaces only the
    symbols present (dynamic partition overwrite)."""
    (df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path))


def read_bar_cache(spark: SparkSession, path: str, required=CACHE_COLS) -> DataFrame | None:
    """The cache if it exists, is non-empty and has all required columns."""
    try:
        df = spark.read.parquet(path)
    except Exception:  # noqa: BLE001 - missing cache
        return None
    if any(c not in df.columns for c in required) or df.isEmpty():
        return None
    return df


def keep_last(df: DataFrame, keys=("symbol", "ts"), order: str = "__prio") -> DataFrame:
    """One row per key: the one with the highest ``order`` (later source wins).
    A map-side-combinable ``max_by`` aggregate, not a window over the key."""
    others = [c for c in df.columns if c not in keys and c != order]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in others]), F.col(order)).alias("__v"))
    return agg.select(*keys, "__v.*")


def incremental_refresh(cache: DataFrame | None, fresh: DataFrame, end_ts=None, symbol: str = "symbol",
                        ts: str = "ts") -> DataFrame:
    """Cache + newer bars.  Symbols whose cache already reaches ``end_ts``
    keep the cache; otherwise new bars are appended and (symbol, ts)
    duplicates keep the newest source (the reference compares whole rows;
    we key on the timestamp)."""
    if cache is None:
        return fresh
    if end_ts is not None:
        last = cache.groupBy(symbol).agg(F.max(ts).alias("__last"))
        need = last.filter(F.col("__last") < F.lit(end_ts)).select(symbol)
        fresh = fresh.join(need, symbol, "left_semi")
    u = cache.withColumn("__prio", F.lit(0)).unionByName(fresh.withColumn("__prio", F.lit(1)),
                                                          allowMissingColumns=True)
    return keep_last(u, (symbol, ts))


def broker_bars(records: DataFrame, symbol: str = "symbol", date: str = "date", order: str | None = None,
                segment="auto") -> DataFrame:
    """Broker bar records -> clean bar table: typed, UTC timestamps, ``wap``
    renamed ``average``, duplicate timestamps keep the last record, missing
    values forward filled, 7 columns."""
    df = records
    if "wap" in df.columns:
        df = df.withColumnRenamed("wap", "average")
    missing = [c for c in CACHE_COLS if c not in df.columns]
    if missing:
        raise DataFetchError(f"Missing expected columns: {', '.join(missing)}")
    t = F.col(date)
    tsc = (F.coalesce(F.try_to_timestamp(t.cast("string"), F.lit("yyyyMMdd HH:mm:ss")), t.cast("timestamp"))
           if not isinstance(df.schema[date].dataType, T.TimestampType) else t)
    df = df.select(F.col(symbol).cast("string").alias("symbol"), tsc.alias("ts"),
                   *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume", "average")],
                   F.col("barCount").cast("long").alias("barCount"),
                   (F.col(order) if order else F.monotonically_increasing_id()).alias("__prio"))
    df = keep_last(df, ("symbol", "ts"))
    from ticklake.operators.clean import impute
    return impute(df, "forward_fill", False, CACHE_COLS, segment=segment).select("symbol", "ts", *CACHE_COLS)


def mock_bars(spark: SparkSession, n: int, start: str = "2025-01-01", symbol: str = "TEST") -> DataFrame:
    """Linear synthetic daily bars (test fixture)."""
    i = F.col("id")
    return spark.range(n).select(F.lit(symbol).alias("symbol"),
                                 (F.to_timestamp(F.lit(start)) + F.make_dt_interval(i.cast("int"))).alias("ts"),
                                 (100.0 + i).alias("open"), (101.0 + i).alias("high"), (99.0 + i).alias("low"),
                                 (100.5 + i).alias("close"), (1000 + i).cast("double").alias("volume"),
                                 (100.25 + i).alias("average"), F.lit(1).cast("long").alias("barCount"))


def watchlist(spark: SparkSession, path: str, fmt: str = "csv", schema=None, tickers: list[str] | None = None, tf: str | None = None,
              drop: list[str] | None = None, **opts) -> DataFrame:
    """All ticker files of a folder (or a glob) in one read, with ``symbol``, the file's name without its ending and
    its time frame (``BRK.B_D.csv`` is ``BRK.B``).

    ``tickers`` (any case) and ``tf`` choose files by name: only these are read, and a ticker without a file is an
    error.  ``drop`` names columns to leave out; those that are not there do not matter.  A column ``symbol`` of the
    files gives way to the name.
    """
    reader = spark.read.format(fmt)
    for k, v in {"header": True, **opts}.items():
        reader = reader.option(k, v)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    if tickers is None:
        df = reader.load(path if tf is None else f"{path.rstrip('/')}/*_{tf.upper()}.*")
    else:
        wanted = sorted({t.upper() for t in tickers})
        if not wanted:
            raise ValueError("no tickers")
        escaped = ["".join(f"\\{c}" if c in "*?[]{}\\" else c for c in t) for t in wanted]
        # Spark lists each path in a task of its own, up to 10,000: a few tasks for each core do the same
        conf, key = spark.conf, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
        tasks = conf.get(key)
        conf.set(key, str(min(int(tasks), 4 * spark.sparkContext.defaultParallelism)))
        try:  # a path without a file is an error that names it
            df = reader.load([f"{path.rstrip('/')}/{t}{'' if tf is None else '_' + tf.upper()}.{fmt}" for t in escaped])
        except AnalysisException as e:
            raise DataFetchError(f"tickers without a file under {path}: {e}") from e
        finally:
            conf.set(key, tasks)
    file = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))  # a URI's part: a plus is a plus
    name = F.regexp_extract(file, r"^(.+?)(?:_([^_.]*))?\.[^.]+?(?:\.(?:gz|bz2|zst))?$", 1)
    return df.select(*[c for c in df.columns if c not in {"symbol", *(drop or [])}], name.alias("symbol"))


# -------------------------------------------------------------- registry
LOADERS: dict[str, Callable] = {
    "csv": load_csv,
    "json": read_json_records,
    "parquet": lambda spark, path, **o: spark.read.parquet(path),
    "cache": read_bar_cache,
}


def load(spark: SparkSession, name: str, path: str, observation: Observation | None = None, **options) -> DataFrame:
    """Loader by name; unknown names raise.  ``observation`` records the row
    count of the load without an extra job."""
    if name not in LOADERS:
        raise KeyError(f"Unknown data source: {name}")
    df = LOADERS[name](spark, path, **options)
    if observation is not None and df is not None:
        df = df.observe(observation, F.count(F.lit(1)).alias("rows"))
    return df
