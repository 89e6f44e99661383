"""Streaming detectors built on the batch operators.

Each micro-batch runs the distributed batch scan and continues from a state row per
feature, so a feature that sends a third of the traffic is not tied to one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairspark.functions.ordering import BLOCK, ROWS_PER_BLOCK, row_index, split_points, with_blocks
from fairspark.operators import drift as dr
from fairspark.streaming.microbatch import Process, late_path, output_path, read_state, state_path

REFERENCE_SIZE = 500
TEST_SIZE = 100
STRIDE = 50
COOLDOWN_SECONDS = 300


def cusum_process(fit_path: str, root: str, threshold: float = dr.CUSUM_THRESHOLD, k: float = dr.DRIFT_PARAMETER) -> Process:
    """foreachBatch function of a stateful CUSUM per feature.

    State: ``feature, g_pos, g_neg, n, last_seq, n_late``. Rows at or behind the
    carried ``seq`` are late: dropped and counted.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fit = spark.read.parquet(fit_path)
        state = read_state(spark, root, batch_id)
        clean = batch.where(F.col("value").isNotNull())
        if state is None:
            fresh = clean
            late = clean.groupBy("feature").agg(F.lit(0).cast("bigint").alias("late"))
        else:
            known = clean.join(state.select("feature", "last_seq"), "feature", "left")
            behind = F.col("last_seq").isNotNull() & (F.col("seq") <= F.col("last_seq"))
            fresh = known.where(~behind).drop("last_seq")
            late = known.groupBy("feature").agg(F.count_if(behind).alias("late"))
        carried = None if state is None else state.select("feature", "g_pos", "g_neg")
        scan = dr.cusum_scan(fresh, fit, threshold, k, carried)
        scan.write.mode("overwrite").parquet(output_path(root, batch_id))
        done = spark.read.parquet(output_path(root, batch_id))
        last = done.groupBy("feature").agg(
            F.max_by("g_pos", "seq").alias("g_pos"), F.max_by("g_neg", "seq").alias("g_neg"), F.count("*").alias("n"), F.max("seq").alias("last_seq")
        )
        update = last.join(late, "feature", "full_outer")
        if state is None:
            new = update.select("feature", "g_pos", "g_neg", F.coalesce("n", F.lit(0)).alias("n"), "last_seq", F.coalesce("late", F.lit(0)).alias("n_late"))
        else:
            s, u = state.alias("s"), update.alias("u")
            zero = F.lit(0)
            new = s.join(u, F.col("s.feature") == F.col("u.feature"), "full_outer").select(
                F.coalesce("u.feature", "s.feature").alias("feature"),
                F.coalesce("u.g_pos", "s.g_pos").alias("g_pos"),
                F.coalesce("u.g_neg", "s.g_neg").alias("g_neg"),
                (F.coalesce("u.n", zero) + F.coalesce("s.n", zero)).alias("n"),
                F.coalesce("u.last_seq", "s.last_seq").alias("last_seq"),
                (F.coalesce("u.late", zero) + F.coalesce("s.n_late", zero)).alias("n_late"),
            )
        new.write.mode("overwrite").parquet(state_path(root, batch_id))

    return run


def last_rows(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows per feature by ``seq``, found from the row numbers."""
    numbered = row_index(df, ["feature"], ["seq"], "rn")
    total = df.groupBy("feature").agg(F.count("*").alias("total"))
    return numbered.join(total, "feature").where(F.col("rn") > F.col("total") - n).drop("rn", "total")


def reference_window(ref: DataFrame, size: int = REFERENCE_SIZE) -> DataFrame:
    """Statistics of the last ``size`` reference rows per feature."""
    return last_rows(ref, size).groupBy("feature").agg(
        F.count("*").alias("ref_rows"), F.avg("value").alias("ref_mean"), F.max("seq").alias("ref_last_seq")
    )


def count_windows(numbered: DataFrame, size: int = TEST_SIZE, stride: int = STRIDE) -> DataFrame:
    """Full test windows of ``size`` rows every ``stride`` rows, from rows numbered ``rn``."""
    idx = F.col("rn") - 1
    first = F.greatest(F.lit(0), F.floor((idx - size) / stride) + 1)
    spread = numbered.withColumn("window_id", F.explode(F.sequence(first, F.floor(idx / stride))))
    out = spread.groupBy("feature", "window_id").agg(
        F.count("*").alias("n_rows"), F.avg("value").alias("mean"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )
    return out.where(F.col("n_rows") == size)


def window_process(root: str, size: int = TEST_SIZE, stride: int = STRIDE) -> Process:
    """foreachBatch function of count-based windows: a window is emitted by the batch that
    fills it. State: the last ``size - 1`` rows per feature (one at least) with their numbers.

    Rows at or behind the last ``seq`` of their feature are late: dropped, and counted per
    batch and feature below ``late``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        clean = batch.where(F.col("value").isNotNull()).select("feature", "seq", "value")
        state = read_state(spark, root, batch_id)
        if state is not None:
            known = clean.join(state.groupBy("feature").agg(F.max("seq").alias("last_seq")), "feature", "left")
            behind = F.coalesce(F.col("seq") <= F.col("last_seq"), F.lit(False))
            late = known.where(behind).groupBy("feature").agg(F.count("*").alias("n_late"))
            late.write.mode("overwrite").parquet(late_path(root, batch_id))
            clean = known.where(~behind).drop("last_seq")
        numbered = row_index(clean, ["feature"], ["seq"], "rn")
        if state is not None:
            seen = state.groupBy("feature").agg(F.max("rn").alias("seen"))
            shifted = numbered.join(seen, "feature", "left").withColumn("rn", F.col("rn") + F.coalesce("seen", F.lit(0))).drop("seen")
            numbered = shifted.withColumn("is_new", F.lit(True)).unionByName(state.withColumn("is_new", F.lit(False)))
        else:
            numbered = numbered.withColumn("is_new", F.lit(True))
        border = numbered.where("NOT is_new").groupBy("feature").agg(F.max("rn").alias("before"))
        windows = count_windows(numbered, size, stride).join(border, "feature", "left")
        ended = F.col("window_id") * stride + size > F.coalesce("before", F.lit(0))
        windows.where(ended).drop("before").write.mode("overwrite").parquet(output_path(root, batch_id))
        total = numbered.groupBy("feature").agg(F.max("rn").alias("total"))
        tail = numbered.join(total, "feature").where(F.col("rn") > F.col("total") - max(size - 1, 1))
        tail.select("feature", "seq", "value", "rn").write.mode("overwrite").parquet(state_path(root, batch_id))

    return run


def monitor_process(reference: str, root: str) -> Process:
    """foreachBatch function that scores every arriving batch against a stored reference.

    ``reference`` was written by ``reference.write_reference``; a batch reads only the blocks that its own
    values fall into.
    """
    from fairspark.streaming import reference as stored

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        clean = batch.where(F.col("value").isNotNull()).select("feature", "seq", "value")
        dist = stored.distances_to_reference(spark, reference, clean)
        fit = stored.read_totals(spark, reference).select("feature", "mu", "sd", "status")
        cusum = dr.cusum_summary(dr.cusum_scan(clean, fit))
        out = dist.join(cusum, "feature", "left").select(
            "feature", F.col("n_new").alias("n_rows"), "w1", "ks_statistic", "ks_p",
            F.coalesce("n_drift_points", F.lit(0)).alias("n_drift_points"), "max_statistic",
        )
        out.write.mode("overwrite").parquet(output_path(root, batch_id))

    return run


def event_time_stats(events: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Watermarked tumbling or sliding statistics per feature; works on streams and tables."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (
        events.withWatermark("ts", delay)
        .groupBy(span.alias("w"), "feature")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "feature", "n", "mean", "std")
    )


# Alert cooldown ------------------------------------------------------------------


def _greedy_ends(t: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Next kept position after each alert, and the last kept time of the chain from it."""
    following = np.searchsorted(t, t + gap, side="left")
    ends = t.copy()
    for i in range(len(t) - 1, -1, -1):
        if following[i] < len(t):
            ends[i] = ends[following[i]]
    return following, ends


def alert_cooldown(alerts: DataFrame, seconds: float = COOLDOWN_SECONDS, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Keep an alert only if its feature's last kept alert is at least ``seconds`` older.

    ``alerts(feature, t)`` with ``t`` in epoch seconds. What a time block does to the last
    kept time is a step function of the time it starts from; each block reports that
    function, one task per feature chains the (few) steps, and the blocks then mark
    their alerts with the known start.
    """
    distinct = alerts.select("feature", F.col("t").cast("double").alias("t")).distinct()
    blocked = with_blocks(distinct, "t", split_points(distinct, "t", rows_per_block))
    keys = ["feature", BLOCK]

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["t"].to_numpy())
        _, ends = _greedy_ends(t, seconds)
        # The start is before the block, so its first kept alert is one of these.
        firsts = min(len(t), int(np.searchsorted(t, t[0] + seconds, side="left")) + 1)
        upto = np.append(np.flatnonzero(np.diff(ends[:firsts])), firsts - 1)
        return pd.DataFrame(
            {"feature": [pdf["feature"].iloc[0]], BLOCK: [pdf[BLOCK].iloc[0]], "upto": [t[upto].tolist()], "ends": [ends[upto].tolist()], "last_t": [t[-1]]}
        )

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, last = [], -np.inf
        for r in pdf.sort_values(BLOCK).itertuples(index=False):
            block, upto, ends, last_t = r[1], np.asarray(r[2]), np.asarray(r[3]), r[4]
            rows.append((r[0], block, last))
            first = last + seconds
            if first <= last_t:
                at = np.searchsorted(upto, first, side="left")
                last = ends[min(at, len(ends) - 1)]
        return pd.DataFrame(rows, columns=["feature", BLOCK, "last_kept"])

    def mark(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["t"].to_numpy())
        following, _ = _greedy_ends(t, seconds)
        kept, i = [], int(np.searchsorted(t, start["last_kept"].iloc[0] + seconds, side="left"))
        while i < len(t):
            kept.append(t[i])
            i = following[i]
        return pd.DataFrame({"feature": pdf["feature"].iloc[0], "t": kept})

    steps = blocked.groupBy(*keys).applyInPandas(
        report, f"feature string, `{BLOCK}` double, upto array<double>, ends array<double>, last_t double"
    )
    starts = steps.groupBy("feature").applyInPandas(chain, f"feature string, `{BLOCK}` double, last_kept double")
    return blocked.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInPandas(mark, "feature string, t double")
