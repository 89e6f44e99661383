"""Scalar expressions shared by the operators. Everything returns a Column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(col: Column) -> Column:
    """Six-digit half-even rounding, the precision of every published metric."""
    return F.bround(col, 6)


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """``num / den`` with ``default`` on a zero or missing denominator."""
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(default))


def count_if(cond: Column) -> Column:
    return F.coalesce(F.count_if(cond), F.lit(0).cast("bigint"))


def uniform_edges(n_bins: int) -> list[float]:
    """Edges ``i * (1 / n_bins)`` of the unit interval, as doubles."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def bin_by_edges(value: Column, edges: Sequence[float], close_last: bool = False) -> Column:
    """0-based index of the half-open bin ``[edge_i, edge_i+1)``; null outside.

    The edges are compared, never divided, so a value on an edge lands where the
    comparison says it does whatever the binary representation of the edge.
    """
    last = len(edges) - 2
    out: Column | None = None
    for i in range(last + 1):
        upper = value <= edges[i + 1] if close_last and i == last else value < edges[i + 1]
        cond = (value >= edges[i]) & upper
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out


def count_edges_below(value: Column, edges: Column) -> Column:
    """How many inner edges of an array column lie strictly below ``value``."""
    return F.aggregate(edges, F.lit(0), lambda acc, e: acc + F.when(value > e, 1).otherwise(0))


def sigmoid(x: Column) -> Column:
    """Logistic function that never overflows."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softplus(x: Column) -> Column:
    """``log(1 + exp(x))``, linear above 20."""
    return F.when(x > 20, x).otherwise(F.log1p(F.exp(x)))


def log_sum_exp(values: Column) -> Column:
    """``log(sum(exp(v)))`` of an array column, shifted by its maximum."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    return top + F.log(total)


def percent_text(x: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)


def ladder_label(value: Column, ladder: Sequence[tuple[float, str]], default: str, strict: bool = False) -> Column:
    """First label whose bound ``value`` reaches (``>=``, or ``>`` when strict)."""
    out: Column | None = None
    for bound, label in ladder:
        cond = value > bound if strict else value >= bound
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))
