"""Strategies: many indicators fused into one plan.

A strategy is a named list of specs ``{"kind": ..., params, prefix, suffix,
col_names}``.  All specs are advanced together, so indicators that need
recurrences share scan passes and window expressions over the same frame
are planned as one Window operator; one shuffle on (symbol, segment) serves
the whole strategy.  Specs that read an earlier spec's output are run in a
later level (chained strategies).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ticklake.operators import registry as R
from ticklake.plans.frame import SeriesFrame

# Indicators left out of "all" by default (they need extra inputs
# or give another shape).
DEFAULT_EXCLUDE = ["above", "above_value", "below", "below_value", "cross", "cross_value", "long_run",
                   "short_run", "tsignals", "xsignals", "vp", "td_seq"]


@dataclass
class Strategy:
    name: str
    ta: list[dict] = field(default_factory=list)
    description: str = ""


CommonStrategy = Strategy(
    "Common Price and Volume SMAs",
    [dict(kind="sma", length=10), dict(kind="sma", length=20), dict(kind="sma", length=50),
     dict(kind="sma", length=200), dict(kind="sma", close="volume", length=20, prefix="VOLUME")],
    "Common Price SMAs: 10, 20, 50, 200 and Volume SMA: 20.")


def specs_for(strategy, exclude=None) -> list[dict]:
    if isinstance(strategy, Strategy):
        return list(strategy.ta)
    if isinstance(strategy, list):
        return strategy
    ex = set(DEFAULT_EXCLUDE if exclude is None else exclude)
    if strategy == "all":
        return [dict(kind=k) for k in R.indicators() if k not in ex]
    if strategy in R.CATEGORIES:
        return [dict(kind=k) for k in R.indicators(strategy) if k not in ex]
    raise KeyError(f"unknown strategy {strategy!r}")


def run_strategy(bars: DataFrame, strategy="all", exclude=None, symbol: str = "symbol", ts: str = "ts",
                 segment="auto", lookback: int = 0, close: str | None = None) -> DataFrame:
    """Apply a strategy; ``close`` renames the price column used as ``close``
    (e.g. ``adj_close``)."""
    specs = specs_for(strategy, exclude)
    if close:
        specs = [dict(s, close=close) if "close" not in s and "close" in R.REGISTRY[s["kind"]].defaults else s for s in specs]
    f = SeriesFrame(bars, symbol, ts, segment=segment, lookback=lookback)
    R.run(f, specs)
    return f.result()


def ta(bars: DataFrame, kind: str, symbol: str = "symbol", ts: str = "ts", segment="auto", lookback: int = 0,
       **params) -> DataFrame:
    """Accessor-style single indicator (``df.ta(kind=...)``); unknown kinds raise."""
    if kind not in R.REGISTRY:
        raise KeyError(f"unknown indicator {kind!r}")
    return run_strategy(bars, [dict(kind=kind, **params)], symbol=symbol, ts=ts, segment=segment, lookback=lookback)


def run_watchlist(spark, path: str, strategy=CommonStrategy, tickers: list[str] | None = None, tf: str | None = None, ts: str = "ts",
                  analyze: bool = True, segment="auto", **load) -> DataFrame:
    """One strategy over many ticker files: all files are one read, all indicators one plan, ``symbol`` names the
    ticker.  ``analyze=False`` only reads; see ``sources.loaders.watchlist`` for the other options."""
    from ticklake.sources.loaders import watchlist
    bars = watchlist(spark, path, tickers=tickers, tf=tf, **load)
    return run_strategy(bars, strategy, ts=ts, segment=segment) if analyze else bars
