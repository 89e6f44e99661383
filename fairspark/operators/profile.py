"""Profiling and validation of a table. Each function is one aggregate over the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairspark.functions.numeric import count_if
from fairspark.functions.ordering import attach_row, exact_quantiles

MIN_ROWS = 10


def _long_counts(df: DataFrame, named: Mapping[str, Column], key: str, value: str) -> DataFrame:
    """One aggregate with a column per name, turned into ``(key, value)`` rows."""
    one = df.agg(*[expr.alias(f"v{i}") for i, expr in enumerate(named.values())])
    entries = F.array(*[F.struct(F.lit(n).alias(key), F.col(f"v{i}").alias(value)) for i, n in enumerate(named)])
    return one.select(F.inline(entries))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns or df.columns)
    return _long_counts(df, {c: count_if(F.col(c).isNull()) for c in names}, "column_name", "null_count")


def validate_schema(
    df: DataFrame, required: Sequence[str], numeric: Sequence[str] = (), categorical: Sequence[str] = ()
) -> DataFrame:
    """One row per finding: missing or extra columns, wrong kinds, nulls in required columns."""
    types = {f.name: f.dataType for f in df.schema.fields}
    kinds: list[tuple[str, str, str]] = []
    for c in required:
        kinds.append((c, "required", "ok" if c in types else "missing"))
    for c in types:
        if c not in required:
            kinds.append((c, "extra", "warning"))
    for c in numeric:
        if c in types:
            kinds.append((c, "numeric", "ok" if isinstance(types[c], T.NumericType) else "warning"))
    for c in categorical:
        if c in types:
            kinds.append((c, "categorical", "ok" if isinstance(types[c], T.StringType) else "warning"))
    present = [c for c in required if c in types]
    nulls = null_counts(df, present) if present else None
    entries = F.array(
        *[F.struct(F.lit(a).alias("column_name"), F.lit(b).alias("check_name"), F.lit(c).alias("status")) for a, b, c in kinds]
    )
    total = df.agg(F.count("*").alias("n_rows"))
    checks = total.select(F.inline(entries), F.col("n_rows"))
    if nulls is None:
        return checks.select("column_name", "check_name", "status", F.lit(0).cast("bigint").alias("null_count"))
    found = checks.join(F.broadcast(nulls), "column_name", "left")
    return found.select(
        "column_name",
        "check_name",
        F.when((F.col("check_name") == "required") & (F.col("null_count") > 0), "warning").otherwise(F.col("status")).alias("status"),
        F.when(F.col("check_name") == "required", F.col("null_count")).alias("null_count"),
    )


def validate_domain(
    df: DataFrame,
    target: str,
    valid_targets: Sequence,
    numeric: Sequence[str],
    sensitive: Sequence[str],
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Target domain, numeric types, nulls, minimum size and sensitive columns as check rows.

    The target check counts violating rows; it never gathers the distinct values.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    nulls = sum((F.col(c).isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    one = df.agg(
        count_if(F.col(target).isNotNull() & ~F.col(target).isin(list(valid_targets))).alias("bad_target"),
        F.coalesce(F.sum(nulls), F.lit(0)).alias("nulls"),
        F.count("*").alias("n"),
    )
    not_numeric = [c for c in numeric if not isinstance(types.get(c), T.NumericType)]
    missing = [c for c in sensitive if c not in types]
    rows = [
        ("target_values", F.col("bad_target") == 0, F.col("bad_target")),
        ("numeric_types", F.lit(not not_numeric), F.lit(len(not_numeric)).cast("bigint")),
        ("total_nulls", F.col("nulls") == 0, F.col("nulls")),
        ("minimum_rows", F.col("n") >= min_rows, F.col("n")),
        ("sensitive_columns", F.lit(not missing), F.lit(len(missing)).cast("bigint")),
    ]
    return one.select(
        F.inline(F.array(*[F.struct(F.lit(a).alias("check_name"), ok.alias("ok"), d.alias("detail")) for a, ok, d in rows]))
    )


def check_values(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows violating each named rule. A rule is the condition that must hold; nulls pass."""
    return _long_counts(df, {n: count_if(~rule) for n, rule in rules.items()}, "rule", "violations")


def in_range(col: Column, low: float | None = None, high: float | None = None, strict: bool = False) -> Column:
    cond = F.lit(True)
    if low is not None:
        cond = cond & ((col > low) if strict else (col >= low))
    if high is not None:
        cond = cond & ((col < high) if strict else (col <= high))
    return cond


def is_probability(col: Column) -> Column:
    return in_range(col, 0.0, 1.0)


def describe_numeric(df: DataFrame, columns: Sequence[str], rows_per_block: int = 200_000) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max per numeric column, 4 digits.

    The columns are unpivoted so that one plan serves all; quartiles come from the
    distributed rank, not from a per-column buffer of all distinct values.
    """
    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns]))
    )
    basic = long.groupBy("column_name").agg(
        F.count("value").alias("cnt"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quart = exact_quantiles(long, ["column_name"], "value", [0.25, 0.5, 0.75], rows_per_block).drop("n")
    joined = basic.join(quart.toDF("column_name", "p25", "p50", "p75"), "column_name", "left")
    return joined.select(
        "column_name", "cnt", *[F.bround(c, 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")]
    )


def categorical_profile(df: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    """Distinct count and the ``top`` most frequent values per column (ties by value).

    Values are counted with partial aggregation and ranked in two levels: inside 64
    hash slices per column, then over the at most ``64 * top`` survivors.
    """
    counts = (
        df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])))
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("cnt"))
    )
    distinct = counts.groupBy("column_name").agg(F.count("*").alias("n_distinct"))
    slices = counts.withColumn("slice", F.pmod(F.xxhash64("value"), F.lit(64)))
    order = [F.col("cnt").desc(), F.col("value")]
    first = slices.withColumn("r", F.row_number().over(Window.partitionBy("column_name", "slice").orderBy(*order)))
    ranked = first.where(F.col("r") <= top).withColumn(
        "value_rank", F.row_number().over(Window.partitionBy("column_name").orderBy(*order)).cast("bigint")
    )
    kept = ranked.where(F.col("value_rank") <= top)
    return kept.join(distinct, "column_name").select("column_name", "n_distinct", "value_rank", "value", "cnt")


def sample_preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """First ``n`` rows by key, as strings with nulls shown empty (a preview, so a top-n)."""
    return df.orderBy(*order_by).limit(n).select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    )


def numeric_features(df: DataFrame, target: str, min_numeric: int = 3, fallback: int | None = None) -> list[str]:
    """Numeric columns except the target; with fewer than three all other columns, or the first ``fallback``."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != target]
    return names if len(names) >= min_numeric else [c for c in df.columns if c != target][:fallback]


def numeric_frame(df: DataFrame, target: str, keep: Sequence[str] = ()) -> DataFrame:
    """The selected features as doubles, unreadable or null values as 0."""
    names = numeric_features(df, target)
    zero = F.lit(0.0)
    return df.select(*keep, *[F.coalesce(F.expr(f"try_cast(`{c}` AS double)"), zero).alias(c) for c in names if c not in keep])


def binarise_target(df: DataFrame, target: str, alias: str = "y_true") -> DataFrame:
    """1 where the target equals its largest distinct value, else 0."""
    top = df.agg(F.max(target).alias("__top"))
    return attach_row(df, top).withColumn(alias, F.coalesce((F.col(target) == F.col("__top")).cast("double"), F.lit(0.0))).drop("__top")


def binarise_sensitive(df: DataFrame, column: str, alias: str = "grp") -> DataFrame:
    """Two distinct values become 0/1 in sorted order, more become ``value > median``.

    Whether there are more than two follows from a min/max pass; no distinct list.
    """
    ends = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    between = attach_row(df, ends).agg(
        F.max("__lo").alias("__lo"),
        F.max("__hi").alias("__hi"),
        count_if((F.col(column) != F.col("__lo")) & (F.col(column) != F.col("__hi"))).alias("__mid"),
    )
    numeric = isinstance(df.schema[column].dataType, T.NumericType)
    with_ends = attach_row(df, between)
    two = (F.col(column) == F.col("__hi")) & (F.col("__lo") != F.col("__hi"))
    if numeric:
        median = exact_quantiles(df.select(F.col(column).cast("double").alias("v")), [], "v", [0.5]).select(F.col("q0").alias("__median"))
        with_ends = attach_row(with_ends, median)
        many = F.col(column) > F.col("__median")
        flag = F.when(F.col("__mid") > 0, many).otherwise(two)
        return with_ends.withColumn(alias, flag.cast("int")).drop("__lo", "__hi", "__mid", "__median")
    return with_ends.withColumn(alias, two.cast("int")).drop("__lo", "__hi", "__mid")
