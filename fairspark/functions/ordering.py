"""Order-dependent building blocks that stay distributed.

A window that is partitioned only by a small key (a feature, a protected group)
puts a whole key into one task. Everything here adds a *block* to the window
partition: contiguous ranges of the order column, cut at global quantiles, so a
task sees at most about ``rows_per_block`` rows however the keys are skewed.
Only one small row per (key, block) is combined across blocks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairspark.session import materialise, stored

ROWS_PER_BLOCK = 200_000
BLOCK = "__block"
COARSE = 256


def split_points(
    df: DataFrame,
    order_col: str,
    rows_per_block: int = ROWS_PER_BLOCK,
    n_rows: int | None = None,
) -> list[float]:
    """Quantile cut points of ``order_col``; empty when one block is enough.

    This is a fit step: it runs a small aggregate and returns at most
    ``rows / rows_per_block`` doubles. The points are constants of the later plan,
    so every branch and every retried task agrees on the blocks. They may be
    approximate; the scans are exact for any set of points.
    """
    column = F.col(order_col).cast("double")
    coarse: list[float] = []
    if n_rows is None:
        grid = [i / COARSE for i in range(1, COARSE)]
        row = df.agg(F.count("*").alias("n"), F.percentile_approx(column, grid, 10_000).alias("p")).first()
        n_rows, coarse = row["n"], row["p"] or []
    n_blocks = math.ceil(n_rows / rows_per_block)
    if n_blocks <= 1:
        return []
    if coarse and n_blocks <= COARSE:
        return sorted({coarse[round(i * COARSE / n_blocks) - 1] for i in range(1, n_blocks)})
    fractions = [i / n_blocks for i in range(1, n_blocks)]
    found = df.agg(F.percentile_approx(column, fractions, max(10_000, 4 * n_blocks)).alias("p")).first()["p"]
    return sorted(set(found or []))


def with_blocks(df: DataFrame, order_col: str, points: Sequence[float], name: str = BLOCK) -> DataFrame:
    """Add the block number of ``order_col`` (binary search over the constant points)."""
    if not points:
        return df.withColumn(name, F.lit(0.0))
    bounds = [-math.inf, *points, math.inf]
    helper = f"{name}_order"
    staged = df.withColumn(helper, F.col(order_col).cast("double"))
    bucketed = Bucketizer(splits=bounds, inputCol=helper, outputCol=name, handleInvalid="keep").transform(staged)
    return bucketed.drop(helper)


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    sums: Mapping[str, Column],
    points: Sequence[float] | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
    parts: int | None = None,
) -> DataFrame:
    """Inclusive running sums per key in ``order_by`` order (first entry numeric).

    ``parts`` sets the number of partitions of the scan, where the engine's would hold too many blocks each.

    Two-level prefix sum: local running sums inside (key, block), plus the sum of
    all earlier blocks of the key, which is a window over one row per block.
    """
    if points is None:
        points = split_points(df, order_by[0], rows_per_block)
    staged = df.select("*", *[expr.alias(f"__in_{name}") for name, expr in sums.items()])
    blocked = with_blocks(staged, order_by[0], points)
    part = [*keys, BLOCK]
    if parts:
        blocked = blocked.repartition(parts, *part)
    local = Window.partitionBy(*part).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    scanned = blocked.select(
        "*", *[F.sum(f"__in_{name}").over(local).alias(name) for name in sums]
    )
    if not points:
        return scanned.select(*df.columns, *sums)
    totals = blocked.groupBy(*part).agg(*[F.sum(f"__in_{n}").alias(f"__tot_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *part, *[F.coalesce(F.sum(f"__tot_{n}").over(before), F.lit(0)).alias(f"__carry_{n}") for n in sums]
    )
    shifted = [(F.col(name) + F.col(f"__carry_{name}")).alias(name) for name in sums]
    return scanned.join(carry, part).select(*df.columns, *shifted)


def next_in_order(
    df: DataFrame,
    keys: Sequence[str],
    order_col: str,
    alias: str,
    points: Sequence[float] | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Following value of ``order_col`` per key, across block borders."""
    if points is None:
        points = split_points(df, order_col, rows_per_block)
    blocked = with_blocks(df, order_col, points)
    part = [*keys, BLOCK]
    out = blocked.withColumn(alias, F.lead(order_col).over(Window.partitionBy(*part).orderBy(order_col)))
    if not points:
        return out.drop(BLOCK)
    firsts = blocked.groupBy(*part).agg(F.min(order_col).alias("__first"))
    after = Window.partitionBy(*keys).orderBy(BLOCK)
    border = firsts.select(*part, F.lead("__first").over(after).alias("__border"))
    return out.join(border, part).withColumn(alias, F.coalesce(alias, "__border")).drop(BLOCK, "__border")


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order_col: str,
    columns: Sequence[str],
    prefix: str = "prev_",
    points: Sequence[float] | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Values of the preceding row of the key as ``prev_<column>``, across block borders.

    ``order_col`` is unique inside a key.
    """
    if points is None:
        points = split_points(df, order_col, rows_per_block)
    part = [*keys, BLOCK]
    blocked = with_blocks(df, order_col, points).withColumn("__row", F.struct(*columns))
    lagged = blocked.withColumn("__prev", F.lag("__row").over(Window.partitionBy(*part).orderBy(order_col)))
    if points:
        last = blocked.groupBy(*part).agg(F.max_by("__row", order_col).alias("__last"))
        chain = Window.partitionBy(*keys).orderBy(BLOCK)
        border = last.select(*part, F.lag("__last").over(chain).alias("__border"))
        lagged = lagged.join(border, part).withColumn("__prev", F.coalesce("__prev", "__border"))
    return lagged.select(*df.columns, *[F.col("__prev")[c].alias(f"{prefix}{c}") for c in columns])


def trailing_windows(
    df: DataFrame,
    keys: Sequence[str],
    order_col: str,
    width: int,
    aggregates: Mapping[str, Column],
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Aggregates over the last ``width`` rows of a key, at every row.

    Rows are numbered, cut into blocks by number, and the last ``width - 1`` rows of a
    block are also sent to the next one, so each block sees whole windows on its own.
    ``aggregates`` may refer to the row number ``rn``.
    """
    numbered = row_index(df, keys, [order_col], "rn", rows_per_block=rows_per_block)
    size = max(rows_per_block, width)
    own = F.floor((F.col("rn") - 1) / size)
    tail = (F.pmod(F.col("rn") - 1, F.lit(size)) >= size - (width - 1)) & (F.lit(width) > 1)
    homes = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    spread = numbered.withColumn("__own", own).withColumn("__home", F.explode(homes))
    over = Window.partitionBy(*keys, "__home").orderBy("rn").rowsBetween(-(width - 1), 0)
    computed = spread.select("*", *[a.over(over).alias(n) for n, a in aggregates.items()])
    return computed.where(F.col("__own") == F.col("__home")).select(*df.columns, *aggregates)


def row_index(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    alias: str = "rn",
    points: Sequence[float] | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
    parts: int | None = None,
) -> DataFrame:
    """1-based position of each row inside its key."""
    return running_sums(df, keys, order_by, {alias: F.lit(1).cast("bigint")}, points, rows_per_block, parts)


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with counts: combines on the map side, so a hot value is one row."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("cnt"))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Exact linearly interpolated quantiles as ``q0, q1, ...`` per key.

    ``percentile`` keeps every distinct value of a key in one aggregation buffer;
    here the distinct values are ranked by a distributed prefix sum and only the
    values at the needed ranks survive the final aggregate.
    """
    if not keys:
        whole = exact_quantiles(df.withColumn("__all", F.lit(1)), ["__all"], value, probs, rows_per_block)
        return whole.drop("__all")
    # Read by the cut-point fit, the totals and the scan: written once, not recounted.
    counts = materialise(value_counts(df, keys, value))
    ranked = running_sums(counts, keys, [value], {"cum": F.col("cnt")}, rows_per_block=rows_per_block)
    totals = counts.groupBy(*keys).agg(F.sum("cnt").alias("n"))
    joined = ranked.join(pinned(totals), list(keys))
    picks = []
    for i, p in enumerate(probs):
        pos = (F.col("n") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("cum") - F.col("cnt") <= rank) & (rank < F.col("cum"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"{side}{i}"))
    picked = joined.groupBy(*keys).agg(F.max("n").alias("n"), *picks)
    out = [
        (
            F.col(f"lo{i}")
            + (F.col(f"hi{i}") - F.col(f"lo{i}")) * ((F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p))))
        ).alias(f"q{i}")
        for i, p in enumerate(probs)
    ]
    return picked.select(*keys, "n", *out)


PINNED_ROWS = 10_000


def pinned(small: DataFrame, limit: int = PINNED_ROWS) -> DataFrame:
    """A fitted side table, evaluated and size-checked, ready to join.

    Up to ``limit`` rows it becomes a local relation, which Spark broadcasts, so the
    large side is neither shuffled nor skewed by the join key. A larger table is
    returned as it is and joins by shuffle with adaptive skew handling.
    """
    rows = small.limit(limit + 1).collect()
    if len(rows) > limit:
        return small
    return F.broadcast(small.sparkSession.createDataFrame(rows, small.schema))


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a global aggregate (exactly one row) to every row."""
    return df.crossJoin(F.broadcast(one_row))


def hash_key(*parts: Column) -> Column:
    """Reproducible pseudo-random order key: the md5 hex string of the joined parts."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


#: Hexadecimal digits of :func:`hash_key`.
HASH_DIGITS = 32


def _same_keys(keys: Sequence[str], left: str = "l", right: str = "r") -> Column:
    """Null-safe equality of the key columns of two aliased tables."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return same


def _edge_buckets(sizes: DataFrame, keys: Sequence[str], limit: Column) -> tuple[DataFrame, DataFrame]:
    """Bucket sizes with running totals, and per key the bucket in which the limit falls and the rows left to take there."""
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    filled = (
        sizes.withColumn("n", F.sum("__cnt").over(whole))
        .withColumn("__cum", F.sum("__cnt").over(upto))
        .withColumn("__limit", limit)
    )
    room = F.col("__limit") - (F.col("__cum") - F.col("__cnt"))
    return filled, filled.where((room > 0) & (room <= F.col("__cnt"))).select(*keys, "__bucket", "__cnt", room.alias("__room"))


def _in_buckets(slim: DataFrame, edges: DataFrame, keys: Sequence[str], digits: int) -> DataFrame:
    """Rows of the keys' edge buckets, whatever the length of a bucket's prefix."""
    lead = F.substring("__bucket", 1, digits).alias("__edge_lead")
    found = slim.alias("l").join(
        pinned(edges.select(*keys, "__bucket", "__room", lead)).alias("r"),
        _same_keys(keys) & (F.col("l.__lead") == F.col("r.__edge_lead")) & F.col("l.__hash").startswith(F.col("r.__bucket")),
    )
    return found.select("l.*", "r.__room")


def hash_cuts(
    rows: DataFrame,
    keys: Sequence[str],
    hash_col: str,
    id_col: str,
    limit: Column,
    carry: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BLOCK,
    digits: int = 4,
    written: bool = False,
) -> DataFrame:
    """Per key the (hash, id) of the ``limit``-th smallest row, as ``cut_hash, cut_id``.

    Radix selection on a hexadecimal hash. The input is evaluated once, into a written
    copy of key, hash and id. Counts per prefix of ``digits`` digits (combined on the map
    side) tell the bucket that holds the limit; while that bucket of some key has more
    than ``rows_per_bucket`` rows, its rows alone are counted by ``digits`` more. Only the
    last bucket is ranked, repeated (hash, id) as one row, so a key is never sorted as a
    whole at any input size, and an id that holds a third of the rows is one row too.
    ``limit`` may use ``n``, the row count of the key, and the ``carry`` columns, which are
    constant per key. ``take_all`` tells keys whose limit covers every row. A null key is
    a key of its own; null ids come first among equal hashes. ``written`` tells that ``rows``
    is such a copy already.
    """
    slim = rows.select(*keys, *carry, F.col(hash_col).alias("__hash"), F.col(id_col).alias("__id"))
    slim = (slim if written else stored(slim, "hashes")).withColumn("__lead", F.substring("__hash", 1, digits))
    counted = F.count("*").alias("__cnt")
    sizes = slim.groupBy(*keys, F.col("__lead").alias("__bucket")).agg(counted, *[F.max(c).alias(c) for c in carry])
    filled, edges = _edge_buckets(materialise(sizes), keys, limit)
    limits = filled.groupBy(*keys).agg((F.max("__limit") >= F.max("n")).alias("take_all"))

    settled, length = None, digits
    while True:
        edges = materialise(edges)
        large = edges.where(F.col("__cnt") > rows_per_bucket)
        if length >= HASH_DIGITS or large.isEmpty():
            settled = edges if settled is None else settled.unionByName(edges)
            break
        small = edges.where(F.col("__cnt") <= rows_per_bucket)
        settled = small if settled is None else settled.unionByName(small)
        length += digits
        finer = (
            _in_buckets(slim, large, keys, digits)
            .groupBy(*keys, F.substring("__hash", 1, length).alias("__bucket"))
            .agg(counted, F.max("__room").alias("__want"))
        )
        edges = _edge_buckets(finer, keys, F.col("__want"))[1]

    distinct = _in_buckets(slim, settled, keys, digits).groupBy(*keys, "__hash", "__id").agg(counted, F.max("__room").alias("__room"))
    upto = Window.partitionBy(*keys).orderBy("__hash", "__id").rowsBetween(Window.unboundedPreceding, 0)
    ranked = distinct.withColumn("__cum", F.sum("__cnt").over(upto))
    at_cut = (F.col("__cum") >= F.col("__room")) & (F.col("__cum") - F.col("__cnt") < F.col("__room"))
    cuts = ranked.where(at_cut).select(*keys, F.col("__hash").alias("cut_hash"), F.col("__id").alias("cut_id"))
    return (
        limits.alias("l")
        .join(cuts.alias("r"), _same_keys(keys), "left")
        .select(*[f"l.{k}" for k in keys], "take_all", "cut_hash", "cut_id")
    )


def within_cut(hash_col: Column, id_col: Column) -> Column:
    """Whether a row comes at or before its key's cut."""
    before = (hash_col < F.col("cut_hash")) | ((hash_col == F.col("cut_hash")) & (id_col.isNull() | (id_col <= F.col("cut_id"))))
    return F.coalesce(F.col("take_all") | before, F.lit(False))


def first_by_hash(
    rows: DataFrame,
    keys: Sequence[str],
    hash_col: str,
    id_col: str,
    limit: Column,
    flag: str = "chosen",
    carry: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BLOCK,
    digits: int = 4,
    written: bool = False,
) -> DataFrame:
    """Flag the ``limit`` rows per key with the smallest (hash, id).

    The cut table has one row per key and joins back without moving the rows, which are
    read once by the returned plan. Rows that repeat the cut's (hash, id) are all flagged.
    ``written`` tells that ``rows``, hash included, is a stored file already.
    """
    cuts = hash_cuts(rows, keys, hash_col, id_col, limit, carry, rows_per_bucket, digits, written)
    joined = rows.alias("l").join(pinned(cuts).alias("r"), _same_keys(keys))
    marked = joined.select("l.*", "take_all", "cut_hash", "cut_id")
    return marked.withColumn(flag, within_cut(F.col(hash_col), F.col(id_col))).drop("cut_hash", "cut_id", "take_all")


def string_index(values: DataFrame, column: str, alias: str, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """1-based position of distinct strings in binary order, ranked in blocks.

    Blocks are ranges of the full value, laid out once, so a prefix that all values share
    does not matter. A block needs only the sizes of the earlier blocks.
    """
    n_blocks = max(1, math.ceil(values.count() / rows_per_block))
    laid = materialise(values.repartitionByRange(n_blocks, column).withColumn(BLOCK, F.spark_partition_id()))
    sizes = laid.groupBy(BLOCK).agg(F.count("*").alias("__size"))
    before = Window.partitionBy(F.lit(1)).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select(BLOCK, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    inside = laid.withColumn("__inside", F.row_number().over(Window.partitionBy(BLOCK).orderBy(column)))
    return inside.join(carry, BLOCK).select(*values.columns, (F.col("__inside") + F.col("__before")).alias(alias))
