"""Constant weight vectors for weighted moving sums (oldest -> newest)."""

from __future__ import annotations

import math


def fibonacci(n: int, weighted: bool = False) -> list[float]:
    """n terms 1, 1, 2, 3, 5, ...; normalised to sum 1 when weighted."""
    seq, a, b = [], 1, 1
    for _ in range(max(n, 1)):
        seq.append(a)
        a, b = b, a + b
    if weighted:
        s = sum(seq)
        return [v / s for v in seq]
    return [float(v) for v in seq]


def pascals_triangle(n: int, weighted: bool = False, inverse: bool = False) -> list[float]:
    """Row n of Pascal's triangle (n+1 terms)."""
    row = [math.comb(n, i) for i in range(n + 1)]
    s = sum(row)
    w = [v / s for v in row]
    if weighted and inverse:
        return [1 - v for v in w]
    return w if weighted else [float(v) for v in row]


def symmetric_triangle(n: int, weighted: bool = False) -> list[float]:
    """1,2,..,2,1 shape of n terms (n >= 2)."""
    n = max(int(abs(n)), 2)
    if n == 2:
        tri = [1, 1]
    elif n % 2 == 0:
        front = list(range(1, n // 2 + 1))
        tri = front + front[::-1]
    else:
        front = list(range(1, (n + 1) // 2 + 1))
        tri = front + front[:-1][::-1]
    if weighted:
        s = sum(tri)
        return [v / s for v in tri]
    return [float(v) for v in tri]


def sine_weights(n: int) -> list[float]:
    s = [math.sin((i + 1) * math.pi / (n + 1)) for i in range(n)]
    t = sum(s)
    return [v / t for v in s]


def combination(n: int, r: int, repetition: bool = False) -> int:
    n, r = abs(int(n)), abs(int(r))
    if repetition:
        n = n + r - 1
    return math.comb(n, min(r, n)) if r <= n else 0
