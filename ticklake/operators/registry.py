"""Indicator registry and the runner that fuses many indicators into one plan.

An indicator is a function ``fn(f, **params)`` over a ``SeriesFrame`` that
returns ``{output_name: Column}``.  If it needs unbounded recurrences it is a
generator that ``yield``s ``Need`` objects (or tuples of them) and receives
Columns back.  ``run`` advances all requested indicators together, so every
step's recurrences of all indicators share one scan pass.
"""

from __future__ import annotations

import inspect
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticklake.functions.blocks import Need, bfill, ffill, lag
from ticklake.plans.frame import SeriesFrame, fresh

REGISTRY: dict[str, "Indicator"] = {}
CATEGORIES = ["candles", "cycles", "momentum", "overlap", "performance", "statistics", "trend",
              "volatility", "volume"]


@dataclass
class Indicator:
    name: str
    category: str
    fn: Callable
    lookahead: bool = False
    defaults: dict = field(default_factory=dict)


def indicator(name: str, category: str, lookahead: bool = False):
    def deco(fn):
        sig = inspect.signature(fn)
        defaults = {k: p.default for k, p in list(sig.parameters.items())[1:]
                    if p.default is not inspect._empty}
        REGISTRY[name] = Indicator(name, category, fn, lookahead, defaults)
        return fn
    return deco


def register(name: str, category: str, fn: Callable, lookahead: bool = False):
    """Add a user indicator (Column builder or generator, same protocol)."""
    return indicator(name, category, lookahead)(fn)


def indicators(category: str | None = None, exclude=()) -> list[str]:
    return sorted(n for n, i in REGISTRY.items() if (category is None or i.category == category)
                  and n not in exclude)


def _post(f: SeriesFrame, cols: dict, spec: dict) -> dict:
    """offset / fillna / col_numbers / prefix / suffix / col_names handling of one call."""
    if spec.get("col_numbers") is not None and len(cols) > 1:
        items = list(cols.items())
        cols = dict(items[int(k)] for k in spec["col_numbers"])
    offset = int(spec.get("offset") or 0)
    fillna = spec.get("fillna")
    prefix = spec.get("prefix")
    suffix = spec.get("suffix")
    names = spec.get("col_names")
    out = {}
    for i, (nm, c) in enumerate(cols.items()):
        if offset:
            c = lag(f, c, offset)
        if fillna is not None:
            c = F.coalesce(c, F.lit(fillna))
        if names and i < len(names):
            nm = names[i]
        if prefix:
            nm = f"{prefix}_{nm}"
        if suffix:
            nm = f"{nm}_{suffix}"
        out[safe(nm)] = c
    spec["_made"] = list(out)
    return out


_CTRL = ("kind", "offset", "fillna", "fill_method", "prefix", "suffix", "col_names", "col_numbers", "signal_indicators", "_made")
#: Options of ``signal_indicators`` and, per indicator, the outputs they are drawn for with their defaults.
_SIGNAL_OPTIONS = ("xa", "xb", "xserie", "xserie_a", "xserie_b", "cross_values", "cross_series")
_SIGNALS = {
    "rsi": [(0, dict(xa=80, xb=20))], "er": [(0, dict(xa=80, xb=20))],
    "macd": [(1, dict(xa=0, xb=None, cross_values=True)), (0, dict(xa=0, xb=None))],
}


def _filled(f: SeriesFrame, names: list[str], method: str) -> None:
    """Forward or backward fill of finished outputs."""
    if method not in ("ffill", "pad", "bfill", "backfill"):
        raise ValueError(f"unknown fill_method {method!r}")
    fill = ffill if method in ("ffill", "pad") else bfill

    def gen(f):
        ys = yield tuple(fill(f, F.col(n)) for n in names)
        return dict(zip(names, ys))

    f.with_columns(_advance_all(f, [(gen, {}, {})]))


def _signal_specs(spec: dict) -> list[dict]:
    given = {k: spec[k] for k in _SIGNAL_OPTIONS if k in spec}
    if spec["kind"] not in _SIGNALS:
        raise ValueError(f"{spec['kind']!r} takes no signal_indicators")
    out = []
    for at, defaults in _SIGNALS[spec["kind"]]:
        out.append({**defaults, **given, "kind": "signals", "indicator": spec["_made"][at].replace(DOT, ".")})
        given = {}  # the options hold for the first output only
    return out
DOT = "__DOT__"


def safe(name: str) -> str:
    """Working-frame name of an output: dots (``BBL_5_2.0``) are kept as
    ``__DOT__`` until ``SeriesFrame.result`` (some PySpark paths re-parse
    names with dots as struct access)."""
    return name.replace(".", DOT)


def col(name: str):
    return F.col(safe(name))


def run(f: SeriesFrame, specs: list[dict]) -> dict[str, str]:
    """Evaluate indicator specs ``{"kind": name, **params}`` on ``f``.

    Returns ``{output name: column name in f.df}``; outputs are added to
    ``f.df``.  Later specs may use outputs of earlier ones by name (chained
    strategies): a spec whose input column is not yet present waits until the
    producer is materialised.  On a segmented frame a dry run on an empty
    frame first finds the look-back that the whole chain needs.
    """
    if f.segment is not None:
        dry = f.probe()
        _run(dry, specs)
        f.reach(dry.need, dry.need_ahead)
    return _run(f, specs)


def _run(f: SeriesFrame, specs: list[dict]) -> dict[str, str]:
    pending = []
    for spec in [dict(s) for s in specs]:
        kind = spec["kind"]
        if kind not in REGISTRY:
            raise KeyError(f"unknown indicator {kind!r}")
        params = {k: (safe(v) if isinstance(v, str) and k in ("close", "open_", "high", "low", "volume", "source",
                                                                "fast", "slow", "trend", "signal", "series_a",
                                                                "series_b", "indicator", "xserie", "xserie_a",
                                                                "xserie_b") else v)
                  for k, v in spec.items() if k not in _CTRL and not (spec.get("signal_indicators") and k in _SIGNAL_OPTIONS)}
        pending.append((spec, params))
    result: dict[str, str] = {}
    while pending:
        existing = set(f.df.columns)
        ready, later = [], []
        for spec, params in pending:
            srcs = [v for k, v in params.items() if k in ("close", "open_", "high", "low", "volume", "source",
                                                           "series_a", "series_b", "indicator", "trend", "signal",
                                                           "fast", "slow", "xserie", "xserie_a", "xserie_b")
                    and isinstance(v, str)]
            (ready if all(s in existing for s in srcs) else later).append((spec, params))
        if not ready:
            raise KeyError("indicator inputs not found: " + ", ".join(str(s["kind"]) for s, _ in later))
        outs = _advance_all(f, [(REGISTRY[s["kind"]].fn, p, s) for s, p in ready])
        f.with_columns(outs)
        result.update({k: k for k in outs})
        for method in {s.get("fill_method") for s, _ in ready} - {None}:
            _filled(f, [n for s, _ in ready if s.get("fill_method") == method for n in s["_made"]], method)
        drawn = [x for s, _ in ready if s.get("signal_indicators") for x in _signal_specs(s)]
        if drawn:
            result.update(_run(f, drawn))
        pending = later
    return result


def _advance_all(f: SeriesFrame, calls) -> dict:
    gens = []
    outs: dict[str, Column] = {}
    for fn, params, spec in calls:
        r = fn(f, **params)
        if inspect.isgenerator(r):
            gens.append((r, spec))
        else:
            outs.update(_post(f, r, spec))
    sends = [None] * len(gens)
    active = list(range(len(gens)))
    while active:
        needs = {}
        nxt = []
        for i in active:
            g, spec = gens[i]
            try:
                y = g.send(sends[i])
            except StopIteration as stop:
                outs.update(_post(f, stop.value, spec))
                continue
            needs[i] = y
            nxt.append(i)
        if not nxt:
            break
        fwd, bwd = [], []
        for i in nxt:
            y = needs[i]
            items = list(y) if isinstance(y, (tuple, list)) else [y]
            for need in items:
                (bwd if need.reverse else fwd).extend(need.scans)
        # materialise the window expressions already produced (they may feed scans)
        if outs:
            tmp = {k: v for k, v in outs.items()}
            f.with_columns(tmp)
            outs = {k: F.col(k) for k in tmp}
        names_f = f.scan(fwd) if fwd else []
        names_b = f.scan(bwd, reverse=True) if bwd else []
        pf = pb = 0
        for i in nxt:
            y = needs[i]
            items = list(y) if isinstance(y, (tuple, list)) else [y]
            res = []
            for need in items:
                k = len(need.scans)
                if need.reverse:
                    cols, pb = names_b[pb:pb + k], pb + k
                else:
                    cols, pf = names_f[pf:pf + k], pf + k
                res.append(need.finish([F.col(n) for n in cols]))
            sends[i] = tuple(res) if isinstance(y, (tuple, list)) else res[0]
        active = nxt
    return outs


def apply(f: SeriesFrame, kind: str, **params) -> dict[str, str]:
    return run(f, [dict(kind=kind, **params)])


__all__ = ["REGISTRY", "CATEGORIES", "indicator", "register", "indicators", "run", "apply", "fresh"]
