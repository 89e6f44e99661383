"""Tail probabilities for result tables of a few rows (Spark SQL has none)."""

from __future__ import annotations

import math

import numpy as np


def _continued_beta(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _continued_beta(a, b, x) / a
    return 1.0 - front * _continued_beta(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t; the normal tail beyond a million degrees."""
    if df > 1e6:
        return normal_two_sided(t)
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_sf(x: float, k: float) -> float:
    """Upper tail of the chi-square distribution."""
    if x <= 0.0:
        return 1.0
    a, y = k / 2.0, x / 2.0
    front = math.exp(-y + a * math.log(y) - math.lgamma(a))
    if y < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1.0
            term *= y / n
            total += term
        return max(0.0, 1.0 - front * total)
    b = y + 1.0 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2.0
        d = 1.0 / (num * d + b)
        c = b + num / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def inversion_two_sided(n: int, few: int) -> float:
    """P(at most ``few`` or at least all but ``few`` of the pairs of a random order are inverted).

    Orders of n with k inversions arise from those of n - 1 by putting the last one 0 to n - 1 places
    further to the front, so their numbers are running sums of the shorter ones.
    """
    pairs = n * (n - 1) // 2
    if 2 * few >= pairs:
        return 1.0
    ways = [1] + [0] * few
    for size in range(2, n + 1):
        total, grown = 0, []
        for k in range(few + 1):
            total += ways[k] - (ways[k - size] if k >= size else 0)
            grown.append(total)
        ways = grown
    # lgamma keeps n! in range for long samples with few inversions.
    return min(1.0, math.exp(math.log(2 * sum(ways)) - math.lgamma(n + 1)))


def lattice_tail(n: int, m: int, distance: int) -> float:
    """P(the CDFs of two random samples of n and m distinct values differ by ``distance / (n m)`` or more).

    Orders of the pooled values are lattice paths from (0, 0) to (n, m). Of the paths to each point, the share
    that stays within ``|i m - j n| < distance`` follows from its two predecessors, one diagonal at a time.
    """
    if distance <= 0:
        return 1.0
    i = np.arange(n + 1)
    inside = np.zeros(n + 1)
    inside[0] = 1.0
    for d in range(1, n + m + 1):
        j = d - i
        # Of the paths to (i, j) a share i / (i + j) comes along i, the rest along j.
        moved = inside * j
        moved[1:] += inside[:-1] * i[1:]
        inside = np.where((j >= 0) & (j <= m) & (np.abs(i * m - j * n) < distance), moved / d, 0.0)
    return float(min(1.0, max(0.0, 1.0 - inside[n])))
