"""DuckDB SQL twins of the registered queries (the correctness oracle).

Written independently of the Spark code path: plain window functions over a
``row_number`` per symbol, self-joins where a window cannot express the
statistic, and recursive CTEs for recurrences (EMA/RMA/...), so an error in
the distributed scan engine cannot hide in the oracle.
"""

from __future__ import annotations

from ticklake.sources.bars import BARS_H_SQL, BARS_W_SQL

BARS = {"h": BARS_H_SQL, "w": BARS_W_SQL}


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def w(n: int | None = None, end: int = 0) -> str:
    """OVER clause: the n rows up to the current one (or running when None)."""
    if n is None:
        return "OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n - 1 - end} PRECEDING AND {'CURRENT ROW' if end == 0 else str(end) + ' FOLLOWING'})"


def lag(x: str, k: int = 1) -> str:
    if k < 0:
        return f"lead({x}, {-k}) OVER (PARTITION BY symbol ORDER BY rn)"
    return f"lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY rn)"


def roll(x: str, n: int, fn: str = "avg", minp: int | None = None) -> str:
    m = n if minp is None else minp
    return f"CASE WHEN count({x}) {w(n)} >= {m} THEN {fn}({x}) {w(n)} END"


def nz(a: str, b: str) -> str:
    return f"(CASE WHEN ({a}) - ({b}) = 0 THEN 2.220446049250313e-16 ELSE ({a}) - ({b}) END)"


def dv(a: str, b: str) -> str:
    return f"(({a}) / NULLIF({b}, 0))"


def fir(x: str, weights: list[float]) -> str:
    n = len(weights)
    terms = [f"{float(wt)!r} * {lag(x, n - 1 - i) if n - 1 - i else x}" for i, wt in enumerate(weights)]
    return "(" + " + ".join(terms) + ")"


def r4(e: str) -> str:
    """4 decimals, or 8 significant digits when coarser; the Spark side uses
    the same steps (sign * floor(|x| * 10^d + 0.5) / 10^d)."""
    x = f"CAST({e} AS DOUBLE)"
    a = f"abs({x})"
    d = f"(CASE WHEN floor(log10({a})) >= 4 THEN 4 - (floor(log10({a})) - 3) ELSE 4 END)"
    return (f"(CASE WHEN isnan({x}) THEN NULL WHEN isinf({x}) OR {a} = 0 THEN {x} "
            f"WHEN {d} >= 0 THEN sign({x}) * floor({a} * pow(10.0, {d}) + 0.5) "
            f"/ pow(10.0, {d}) ELSE sign({x}) * floor({a} / pow(10.0, -{d}) + 0.5) * pow(10.0, -{d}) END)")


class Sql:
    """A chain of CTEs over bars with a per-symbol row number ``rn``."""

    def __init__(self, bars: str = "h"):
        src = BARS[bars] if bars in BARS else bars
        self.ctes = [("b0", f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM ({src}) x")]
        self.cur = "b0"
        self.k = 0
        self.recursive = False

    def _next(self, p="b"):
        self.k += 1
        return f"{p}{self.k}"

    def cols(self, **exprs) -> "Sql":
        nm = self._next()
        sel = ", ".join(f"{e} AS {q(n)}" for n, e in exprs.items())
        self.ctes.append((nm, f"SELECT *, {sel} FROM {self.cur}"))
        self.cur = nm
        return self

    def rec(self, start: int | str, **states) -> "Sql":
        """``name=(a_col, b_col)``: y = a*y + b from rn = start (zero state
        before), one recursive CTE carrying all states."""
        self.recursive = True
        base = self.cur
        r = self._next("r")
        names = list(states)
        init = ", ".join(f"CAST({states[n][1]} AS DOUBLE) AS {q(n)}" for n in names)
        step = ", ".join(f"s.{states[n][0]} * r.{q(n)} + s.{states[n][1]}" for n in names)
        st = f"s.rn = r.rn + 1"
        start_cond = f"rn = {start}" if isinstance(start, int) else start
        self.ctes.append((f"{r}(symbol, rn, {', '.join(q(n) for n in names)})",
                          f"SELECT symbol, rn, {init} FROM {base} WHERE {start_cond} "
                          f"UNION ALL SELECT s.symbol, s.rn, {step} FROM {r} r JOIN {base} s "
                          f"ON s.symbol = r.symbol AND {st}"))
        nm = self._next()
        self.ctes.append((nm, f"SELECT {base}.*, {', '.join(r + '.' + q(n) for n in names)} "
                              f"FROM {base} LEFT JOIN {r} USING (symbol, rn)"))
        self.cur = nm
        return self

    def window_stat(self, out: str, x: str, n: int, agg: str) -> "Sql":
        """Per row, an aggregate over the row's last n rows via a self-join
        (``agg`` sees ``b.<col>`` for the window rows and ``a.<col>`` for the
        current row), for statistics a window function cannot express."""
        base = self.cur
        nm = self._next()
        self.ctes.append((nm, f"SELECT a.*, (SELECT {agg} FROM {base} b WHERE b.symbol = a.symbol AND "
                              f"b.rn BETWEEN a.rn - {n - 1} AND a.rn) AS {q(out)} FROM {base} a"))
        self.cur = nm
        return self

    # ------------------------------------------------------------ recurrences
    def ema(self, out: str, x: str, n: int, warm: int = 0, sliced: bool = False, sma_seed: bool = True,
            alpha: float | None = None) -> "Sql":
        a = (1.0 - 2.0 / (n + 1)) if alpha is None else 1.0 - alpha
        al = 1.0 - a
        if sma_seed and (sliced or warm < n):
            start = warm + n if sliced else n
            seed = f"avg({x}) {w(n)}"
        else:
            start, seed = warm + 1, x
        self.cols(**{f"{out}__a": f"CASE WHEN rn <= {start} THEN 1.0 WHEN {x} IS NULL THEN 1.0 ELSE {a!r} END",
                     f"{out}__b": f"CASE WHEN rn = {start} THEN {seed} WHEN {x} IS NULL THEN 0.0 ELSE {al!r} * {x} END"})
        return self.rec(start, **{out: (q(out + "__a"), q(out + "__b"))})

    def rma(self, out: str, x: str, n: int, warm: int = 0, alpha: float | None = None, minp: int | None = None):
        """ewm(alpha, adjust=True, min_periods): numerator / denominator."""
        al = 1.0 / n if alpha is None else alpha
        a = 1.0 - al
        mp = n if minp is None else minp
        self.cols(**{f"{out}__nb": f"coalesce({x}, 0.0)", f"{out}__db": f"CASE WHEN {x} IS NULL THEN 0.0 ELSE 1.0 END",
                     f"{out}__a": f"{a!r}"})
        self.rec(1, **{f"{out}__n": (q(out + "__a"), q(out + "__nb")), f"{out}__d": (q(out + "__a"), q(out + "__db"))})
        return self.cols(**{out: f"CASE WHEN rn >= {warm + max(mp, 1)} AND {q(out + '__d')} > 0 "
                                 f"THEN {q(out + '__n')} / {q(out + '__d')} END"})

    def sql(self, outs: dict[str, str], ints: tuple = (), keep: tuple = ("symbol", "ts"), digits: int = 4,
            where: str | None = None, raw: bool = False) -> str:
        sel = list(keep)
        for n, e in outs.items():
            if n in ints:
                sel.append(f"CAST({e} AS INTEGER) AS {q(n)}")
            else:
                sel.append(f"{e if raw else r4(e)} AS {q(n)}")
        body = ",\n".join(f"{nm} AS ({txt})" for nm, txt in self.ctes)
        head = "WITH RECURSIVE " if self.recursive else "WITH "
        wh = f" WHERE {where}" if where else ""
        return f"{head}{body}\nSELECT {', '.join(sel)} FROM {self.cur}{wh}"
