"""Shared pieces of the training-data operators."""

from __future__ import annotations

import sys
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark (any path Spark can open)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back.

    The written table cuts the lineage: a lost executor costs a re-read of
    this table, not a re-run of what made it.  Parquet keeps the files small
    (columns are compressed, later readers fetch only what they need).
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/ticklake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` once all that reads them has itself been written."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are small enough for rows that are whole documents.

    Sets two session options for Python stages: at most 2,000 rows and 8 MB a
    batch (a longer document is a batch of its own), instead of 10,000 and 64 MB.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


def process_cache(key, build):
    """``build()`` once per Python worker process, shared by its tasks.

    The package is shipped to workers by value, so module globals start
    fresh in each task; the cache lives in a module of its own instead.
    """
    store = sys.modules.setdefault("_ticklake_process_cache", types.ModuleType("_ticklake_process_cache")).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets (n + 1) of an Arrow string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = pc.cast(column, pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def doc_chunks(offsets: np.ndarray, size: int):
    """Ranges [i, j) of whole documents holding about ``size`` bytes each (one longer document stands alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int):
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    held = process_cache("powers", dict)
    if held.get("n", 0) < n:
        n = max(1 << 16, 1 << int(n - 1).bit_length())
        inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
        for name, base in (("up", _MULT), ("down", inverse)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            held[name] = np.multiply.accumulate(p)
        held["n"] = n
    return held["up"], held["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of disjoint ascending slices: sums of a mixed value of each code with its place in the slice.

    A code at another place counts as another value, so no regular pattern of
    a text cancels out (as the powers of one multiplier can).  Whoever merges
    slices by their hash alone has the odds of 64 random bits.
    """
    n = len(codes)
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    place = np.arange(n, dtype=np.int64)
    place[start[0]:] -= np.repeat(start, np.diff(np.append(start, n)))
    mixed = codes.astype(np.uint64) << np.uint64(40)
    mixed += place.astype(np.uint64)
    mixed *= _MULT
    mixed = mix64(mixed)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed, out=sums[1:])
    return mix64(sums[end] - sums[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Prefix:
    """Prefix sums of a polynomial code; hashes any slice in O(1)."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        c = codes.astype(np.uint64)
        c += np.uint64(1)
        c *= self.up[:n]
        np.cumsum(c, out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix64(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def window(self, k: int) -> np.ndarray:
        """Hashes of all slices of length ``k``."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        raw = (self.sums[k:] - self.sums[:n]) * self.down[:n]
        return mix64(raw + np.uint64(k * 0xD6E8FEB86659FD93 % (1 << 64)))


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + l)`` for each pair."""
    lens = np.asarray(lens, np.int64)
    total = int(lens.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.repeat(np.asarray(starts, np.int64) - (ends - lens), lens) + np.arange(total, dtype=np.int64)


def components(links: DataFrame, name: str = "cc") -> DataFrame:
    """Smallest reachable id of every vertex of ``links`` (a long, b long).

    Rounds of contraction: each vertex points at its smallest neighbour (or
    itself), links are redrawn between those targets, until no link is left;
    the chain of pointer tables is then followed once.  Every round at least
    halves the vertices that still have links, and nothing but a row count
    comes to the driver.  Returns (id, component); ids without links are not
    listed.
    """
    spark = links.sparkSession
    edges = cut(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(
            edges.select(F.col("b").alias("id"), F.col("a").alias("to")))
        point = both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("to"))
        # one jump: a vertex takes its target's target
        point = cut(point, f"{name}-point")
        jump = point.alias("p").join(point.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "left").select(
            "id", F.coalesce("next", "to").alias("to"))
        first, point = point, cut(jump, f"{name}-jump")
        release(first)
        maps.append(point)
        left = point.select(F.col("id").alias("a"), F.col("to").alias("ta"))
        right = point.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(left, "a").join(right, "b").where("ta <> tb")
        first, edges = edges, cut(moved.select(F.greatest("ta", "tb").alias("a"), F.least("ta", "tb").alias("b")).distinct(), f"{name}-edges")
        release(first)
    release(edges)
    if not maps:
        return spark.createDataFrame([], "id long, component long")
    out = maps[0].select("id", F.col("to").alias("component"))
    for m in maps[1:]:
        out = out.join(m.select(F.col("id").alias("component"), F.col("to").alias("next")), "component", "left").select(
            "id", F.coalesce("next", "component").alias("component"))
    return out
