"""Feature preparation: fitted statistics are one-row tables attached to the data."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairspark.functions.numeric import count_edges_below
from fairspark.functions.ordering import attach_row, exact_quantiles, first_by_hash, hash_key, pinned, string_index
from fairspark.session import stored

AGE_EDGES = [0, 25, 35, 45, 55, 65, 100]
AGE_LABELS = ["18-25", "25-35", "35-45", "45-55", "55-65", "65+"]


def _long(df: DataFrame, columns: Sequence[str], cast: str) -> DataFrame:
    return df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast(cast).alias("value")) for c in columns]))
    )


def _pivot_row(long: DataFrame, columns: Sequence[str], value: str, prefix: str) -> DataFrame:
    return long.agg(*[F.max(F.when(F.col("column_name") == c, F.col(value))).alias(f"{prefix}{c}") for c in columns])


def fit_imputer(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """One row with the median of each numeric and the mode of each categorical column."""
    parts = []
    if numeric:
        med = exact_quantiles(_long(df, numeric, "double"), ["column_name"], "value", [0.5])
        parts.append(_pivot_row(med, numeric, "q0", "__fill_"))
    if categorical:
        counts = (
            _long(df, categorical, "string").where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count("*").alias("cnt"))
        )
        modes = counts.groupBy("column_name").agg(F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("mode"))
        parts.append(_pivot_row(modes, categorical, "mode", "__fill_"))
    out = parts[0]
    for p in parts[1:]:
        out = attach_row(out, p)
    return out


def impute(df: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = ()) -> DataFrame:
    """Fill nulls with the fitted medians and modes (mode ties: smallest value)."""
    fitted = fit_imputer(df, numeric, categorical)
    out = attach_row(df, fitted)
    for c in [*numeric, *categorical]:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"__fill_{c}")))
    return out.drop(*[f"__fill_{c}" for c in [*numeric, *categorical]])


def standard_scale(df: DataFrame, columns: Sequence[str], impute_median: bool = True) -> DataFrame:
    """``(x - mean) / population std`` fitted on the non-null values, applied after imputation."""
    stats = df.agg(
        *[F.avg(c).alias(f"__mean_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__std_{c}") for c in columns]
    )
    filled = impute(df, columns) if impute_median else df
    out = attach_row(filled, stats)
    for c in columns:
        std = F.when(F.col(f"__std_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"__std_{c}"))
        out = out.withColumn(c, (F.col(c) - F.col(f"__mean_{c}")) / std)
    return out.drop(*[f"__mean_{c}" for c in columns], *[f"__std_{c}" for c in columns])


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values with their 0-based codes, ranked in blocks."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    ranked = string_index(values, column, "__pos")
    return ranked.select(column, (F.col("__pos") - 1).alias("code"))


def label_encode(df: DataFrame, column: str, alias: str | None = None) -> DataFrame:
    """Replace a categorical column by its index in sorted distinct order.

    A code table of up to ``PINNED_ROWS`` values is broadcast, a larger one joins by shuffle.
    """
    codes = pinned(label_codes(df, column).withColumnRenamed("code", alias or f"{column}_code"))
    return df.join(codes, column, "left")


def interactions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairwise products as ``a_x_b``."""
    return df.select("*", *[(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for a, b in combinations(columns, 2)])


def polynomial(df: DataFrame, columns: Sequence[str], degree: int = 2) -> DataFrame:
    powers = [F.pow(F.col(c), F.lit(d)).alias(f"{c}_pow{d}") for c in columns for d in range(2, degree + 1)]
    return df.select("*", *powers)


def quantile_bin(df: DataFrame, column: str, n_bins: int, alias: str) -> DataFrame:
    """Right-closed quantile bins with the lowest value included; equal edges collapse."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    fitted = exact_quantiles(df.select(F.col(column).cast("double").alias("v")), [], "v", probs)
    edges = fitted.select(F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(n_bins + 1)])).alias("__edges"))
    inner = F.slice("__edges", F.lit(2), F.greatest(F.size("__edges") - 2, F.lit(0)))
    out = attach_row(df, edges)
    code = F.when(F.col(column).isNotNull(), count_edges_below(F.col(column).cast("double"), inner))
    return out.withColumn(alias, code).drop("__edges")


def equal_width_bin(df: DataFrame, column: str, n_bins: int, alias: str) -> DataFrame:
    """Right-closed equal-width bins. The lowest edge sits 0.1 % of the range lower, so
    the minimum belongs to bin 0, which counting inner edges gives for free."""
    ends = df.agg(F.min(column).cast("double").alias("__lo"), F.max(column).cast("double").alias("__hi"))
    out = attach_row(df, ends)
    step = (F.col("__hi") - F.col("__lo")) / n_bins
    inner = F.transform(F.sequence(F.lit(1), F.lit(n_bins - 1)), lambda i: F.col("__lo") + i * step)
    code = F.when(F.col(column).isNotNull(), count_edges_below(F.col(column).cast("double"), inner))
    return out.withColumn(alias, code).drop("__lo", "__hi")


def age_group(age: Column) -> Column:
    """Right-closed age bands; null outside 0..100."""
    out = None
    for low, high, label in zip(AGE_EDGES, AGE_EDGES[1:], AGE_LABELS):
        cond = (age > low) & (age <= high)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def stratified_split(
    df: DataFrame, stratum: str, id_col: str, test_fraction: float = 0.2, seed: int = 42, once: bool = False
) -> DataFrame:
    """Mark exactly ``round(n * fraction)`` rows of every stratum as test.

    Membership depends on the md5 of (id, seed) only, so a re-run or a retried task
    gives the same split; no stratum is sorted as a whole. ``once`` writes all columns of
    ``df`` beside the hashes and marks that copy, for a ``df`` that is dear to evaluate twice.
    """
    rows = df.withColumn("__hash", hash_key(F.col(id_col), F.lit(seed)))
    rows = stored(rows, "hashed") if once else rows
    take = F.bround(F.col("n") * F.lit(test_fraction), 0).cast("bigint")
    return first_by_hash(rows, [stratum], "__hash", id_col, take, "is_test", written=once).drop("__hash")


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale to [0, 1]; a constant column maps to 0."""
    ends = df.agg(*[F.min(c).alias(f"__lo_{c}") for c in columns], *[F.max(c).alias(f"__hi_{c}") for c in columns])
    out = attach_row(df, ends)
    for c in columns:
        span = F.col(f"__hi_{c}") - F.col(f"__lo_{c}")
        scaled = (F.col(c) - F.col(f"__lo_{c}")) / F.when(span == 0, F.lit(1.0)).otherwise(span)
        out = out.withColumn(c, F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))
    return out.drop(*[f"__lo_{c}" for c in columns], *[f"__hi_{c}" for c in columns])
