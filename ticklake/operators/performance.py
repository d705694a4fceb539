"""Performance series: drawdown and returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticklake.functions import blocks as B
from ticklake.functions.blocks import C, dv, lag
from ticklake.operators.registry import indicator


@indicator("drawdown", "performance")
def drawdown(f, close="close"):
    mx = yield B.cummax(f, close)
    return {"DD": mx - C(close), "DD_PCT": 1 - dv(C(close), mx), "DD_LOG": B.log(mx) - B.log(C(close))}


def _first_close(f, close):
    """close of the symbol's first row: a running 'first value' is the affine
    recurrence y = y (a=1) seeded at row 1."""
    return B.linrec(f, F.lit(1.0), F.when(F.col("_rn") == 1, C(close)).otherwise(F.lit(0.0)), start=1)


@indicator("log_return", "performance")
def log_return(f, close="close", length=1, cumulative=False):
    n = int(length) if length and length > 0 else 1
    if cumulative:
        c0 = yield _first_close(f, close)
        v = B.log(dv(C(close), c0))
    else:
        v = B.log(dv(C(close), lag(f, close, n)))
    return {f"{'CUM' if cumulative else ''}LOGRET_{n}": v}


@indicator("percent_return", "performance")
def percent_return(f, close="close", length=1, cumulative=False):
    n = int(length) if length and length > 0 else 1
    if cumulative:
        c0 = yield _first_close(f, close)
        v = dv(C(close), c0) - 1
    else:
        v = dv(C(close), lag(f, close, n)) - 1
    return {f"{'CUM' if cumulative else ''}PCTRET_{n}": v}
