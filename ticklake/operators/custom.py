"""User indicators: ``register`` adds a Column builder (or generator) under a
category; the sample below is the reference's example of a custom file."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticklake.functions import blocks as B
from ticklake.functions.blocks import C, lag
from ticklake.operators.registry import register


def ni(f, close="close", length=20, centered=False):
    """Example custom indicator: price minus its SMA; ``centered`` shifts the
    SMA back half a window (uses future rows)."""
    n = int(length) if length and length > 0 else 20
    t = int(0.5 * n) + 1
    ma = B.mat(f, B.sma(f, close, n))
    v = C(close) - (lag(f, ma, -t) if centered else lag(f, ma, t))
    return {f"NI_{n}": v}


register("ni", "trend", ni)
