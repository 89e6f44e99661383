"""Counterfactuals on feature arrays: flip, explain, validate, interpolate, boundary."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairspark.functions.numeric import count_if, r6, sigmoid
from fairspark.functions.vectors import as_doubles, dot, linear_score, norm, squared_distance

try:  # Python's own build of MD5: for texts this short, OpenSSL's set-up costs more than the hashing
    from _md5 import md5
except ImportError:
    from hashlib import md5


def _clip(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def flip_attribute(features: Column, index: int, target: Column | float) -> Column:
    """Set one feature to its target; the others stay, clipped to [0, 1]."""
    goal = F.lit(float(target)) if isinstance(target, (int, float)) else target
    return F.transform(features, lambda v, i: F.when(i == index, goal).otherwise(_clip(v)))


#: Largest value of the 52 bits that a uniform is drawn from, plus one.
_DRAWS = float((1 << 52) + 1)


def uniforms(ids: list[str | None], samples: Sequence[int], positions: Sequence[int], seed: int) -> np.ndarray:
    """Two uniforms in (0, 1] per id, sample and position, in that order, from the first 13 hex digits of an MD5.

    A retried task draws the same values. A null id is left out of the hashed text, as ``concat_ws`` does.
    """
    ends = [f"{s}|{i}|{salt}|{seed}".encode() for s in samples for i in positions for salt in ("radius", "angle")]
    starts = [b"" if x is None else f"{x}|".encode() for x in ids]
    hashed = b"".join([md5(a + b).digest() for a in starts for b in ends])
    first = (np.frombuffer(hashed, ">u8")[::2] >> np.uint64(12)).astype(np.int64)
    return (first + 1).astype(float) / _DRAWS


def _with_uniforms(df: DataFrame, id_col: str, samples: Sequence[int], positions: Sequence[int], seed: int) -> DataFrame:
    """``__draws``: the uniforms of a row's id in one array, drawn once per row before samples are spread."""
    width = 2 * len(samples) * len(positions)

    @F.arrow_udf("array<double>")
    def draws(ids: pa.Array) -> pa.Array:
        values = uniforms(ids.to_pylist(), samples, positions, seed)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * width, pa.int32()), pa.array(values))

    return df.withColumn("__draws", draws(F.col(id_col).cast("string")))


def _normal(at: Column | int) -> Column:
    """Standard normal from the two uniforms at this place of ``__draws`` (Box-Muller)."""
    radius, angle = F.get("__draws", F.lit(at)), F.get("__draws", F.lit(at) + 1)
    return F.sqrt(-2.0 * F.log(radius)) * F.cos(2.0 * math.pi * angle)


def counterfactual(
    df: DataFrame, features: str, index: int, target: float, id_col: str | None = None, size: int = 0, noise: float = 0.0, seed: int = 42
) -> DataFrame:
    """Flip one feature; with ``noise`` the other ``size - 1`` features are jittered too."""
    base = as_doubles(F.col(features))
    if noise == 0.0:
        return df.withColumn("counterfactual", flip_attribute(base, index, target))
    moved = [i for i in range(size) if i != index]
    values = [F.lit(float(target)) if i == index else _clip(base[i] + noise * _normal(2 * moved.index(i))) for i in range(size)]
    return _with_uniforms(df, id_col, [0], moved, seed).withColumn("counterfactual", F.array(*values)).drop("__draws")


def counterfactual_variants(
    df: DataFrame, id_col: str, features: str, size: int, index: int, target: float, n_samples: int = 5, noise: float = 0.01, seed: int = 42
) -> DataFrame:
    """``n_samples`` jittered counterfactuals per row."""
    moved = [i for i in range(size) if i != index]
    drawn = _with_uniforms(df, id_col, range(1, n_samples + 1), moved, seed)
    spread = drawn.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_samples))).alias("sample"))
    base = as_doubles(F.col(features))
    start = (F.col("sample") - 1) * (2 * len(moved))
    values = [F.lit(float(target)) if i == index else _clip(base[i] + noise * _normal(start + 2 * moved.index(i))) for i in range(size)]
    return spread.withColumn("counterfactual", F.array(*values)).drop("__draws")


def explain_changes(df: DataFrame, id_cols: Sequence[str], original: str, changed: str, names: Sequence[str], threshold: float = 0.01) -> DataFrame:
    """One row per feature whose absolute change exceeds the threshold."""
    both = F.arrays_zip(F.col(original).alias("o"), F.col(changed).alias("c"))
    rows = df.select(*id_cols, F.posexplode(both).alias("i", "z"))
    label = F.array(*[F.lit(n) for n in names])
    delta = F.col("z.c") - F.col("z.o")
    return rows.where(F.abs(delta) > threshold).select(
        *id_cols, label[F.col("i")].alias("feature"), F.col("z.o").alias("original"), F.col("z.c").alias("counterfactual"), delta.alias("change")
    )


def score_both(df: DataFrame, original: str, changed: str, weights: Sequence[float], bias: float) -> DataFrame:
    """Linear-model probabilities and predictions of both versions of each row."""
    z0, z1 = linear_score(F.col(original), list(weights), bias), linear_score(F.col(changed), list(weights), bias)
    return df.select(
        "*", sigmoid(z0).alias("p_original"), sigmoid(z1).alias("p_counterfactual"),
        (z0 >= 0).cast("int").alias("pred_original"), (z1 >= 0).cast("int").alias("pred_counterfactual"),
    ).withColumn("prediction_changed", F.col("pred_original") != F.col("pred_counterfactual"))


def validation_summary(scored: DataFrame, original: str, changed: str, threshold: float = 0.01) -> DataFrame:
    """Flip rate, L2 distances and the mean number of changed features."""
    moved = F.size(F.filter(F.zip_with(original, changed, lambda a, b: F.abs(b - a)), lambda d: d > threshold))
    l2 = F.sqrt(squared_distance(F.col(original), F.col(changed)))
    staged = scored.select("prediction_changed", l2.alias("l2"), moved.alias("moved"))
    return staged.agg(
        F.count("*").alias("n"),
        count_if(F.col("prediction_changed")).alias("n_flipped"),
        r6(F.avg(F.col("prediction_changed").cast("double"))).alias("flip_rate"),
        r6(F.avg("l2")).alias("mean_l2"), r6(F.min("l2")).alias("min_l2"), r6(F.max("l2")).alias("max_l2"),
        r6(F.avg("moved")).alias("mean_changed"),
    )


def _mix(a: Column, b: Column, wa: Column, wb: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: wa * x + wb * y)


def interpolate(df: DataFrame, a: str, b: str, n_steps: int = 10, method: str = "linear") -> DataFrame:
    """``n_steps + 1`` points between two vectors: linear, or spherical unless nearly parallel."""
    t = F.col("step") / float(n_steps)
    va, vb = F.col(a), F.col(b)
    cos = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(va, vb) / F.greatest(norm(va) * norm(vb), F.lit(1e-12))))
    # The angle is fixed per pair before the steps are generated, not once per element.
    measured = df if method == "linear" else df.withColumn("__angle", F.when(F.abs(cos) <= 0.9995, F.acos(cos)))
    spread = measured.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_steps))).alias("step"))
    straight = _mix(va, vb, 1.0 - t, t)
    if method == "linear":
        return spread.withColumn("point", straight)
    angle = F.col("__angle")
    curved = _mix(va, vb, F.sin((1.0 - t) * angle) / F.sin(angle), F.sin(t * angle) / F.sin(angle))
    return spread.withColumn("point", F.when(angle.isNull(), straight).otherwise(curved)).drop("__angle")


def decision_boundary(df: DataFrame, id_col: str, a: str, b: str, weights: Sequence[float], bias: float, n_steps: int = 20) -> DataFrame:
    """First interpolation step whose prediction differs from step 0, else -1.

    The steps of a row are evaluated inside its own array; nothing is shuffled.
    """
    w = [float(x) for x in weights]
    za, zb = linear_score(F.col(a), w, bias), linear_score(F.col(b), w, bias)
    staged = df.select(id_col, za.alias("za"), zb.alias("zb"))
    steps = F.sequence(F.lit(0), F.lit(n_steps))
    first = F.col("za") >= 0
    crossing = F.filter(steps, lambda s: (((1.0 - s / float(n_steps)) * F.col("za") + s / float(n_steps) * F.col("zb")) >= 0) != first)
    found = F.when(F.size(crossing) > 0, crossing[0]).otherwise(F.lit(-1))
    return staged.select(id_col, first.cast("int").alias("first_prediction"), found.alias("boundary_step"))
