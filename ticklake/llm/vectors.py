"""Vector columns and pivot permutations, shared by the two vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, int]:
    """``(id, v array<double>)`` of vectors that take part, their dimension and number.

    Left out: null and zero vectors, vectors with null or non-finite
    components, and vectors whose length is not the table's commonest one.
    """
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    sizes = held.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return held, 0, 0
    return held.where(F.size("v") == sizes[0]["d"]), sizes[0]["d"], sizes[0]["count"]


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Unit rows of a list<double> column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    # scaled first: squares of very large or small components stay finite
    x = x / np.abs(x).max(axis=1, initial=0, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def directions(count: int, d: int) -> np.ndarray:
    """``count`` random directions (normal components, not scaled), the same on every run.

    They do not depend on the rows, so no group of rows can take them up, and
    the scores of two vectors on them are bivariate normal draws with the
    vectors' cosine as correlation, in any number of dimensions.
    """
    return np.random.RandomState(7).standard_normal((count, d))


def permutations(x: np.ndarray, pivot: np.ndarray, length: int) -> np.ndarray:
    """Each row's nearest pivots (largest cosine), nearest first, ties to the smaller pivot number."""
    s = x @ pivot.T
    length = min(length, s.shape[1])
    part = np.argpartition(-s, length - 1, axis=1)[:, :length] if length < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape).copy()
    part.sort(axis=1)
    order = np.argsort(-np.take_along_axis(s, part, axis=1), axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1).astype(np.int32)
