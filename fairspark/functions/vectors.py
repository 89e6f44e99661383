"""Array-column linear algebra, evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DENOMINATOR_FLOOR = 1e-10
NORM_FLOOR = 1e-12


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalise(v: Column) -> Column:
    """Unit vector; vectors shorter than the floor stay as they are."""
    length = norm(v)
    return F.when(length < NORM_FLOOR, v).otherwise(F.transform(v, lambda x: x / length))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null when the lengths differ, so a bad pair is a visible row and not a failed job."""
    denominator = F.greatest(norm(a) * norm(b), F.lit(DENOMINATOR_FLOOR))
    return F.when(F.size(a) == F.size(b), dot(a, b) / denominator)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - cosine_similarity(a, b)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x
    )


def linear_score(features: Column, weights: list[float], bias: float = 0.0) -> Column:
    """``w . x + b`` for a fixed weight list."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return dot(features, w) + F.lit(float(bias))
