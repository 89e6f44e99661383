"""Mitigation search: candidate sweeps, Pareto front, rewards, guards and data fixes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairspark.functions.numeric import count_if, r6, ratio
from fairspark.functions.ordering import (
    ROWS_PER_BLOCK,
    attach_row,
    first_by_hash,
    hash_key,
    pinned,
    row_index,
    split_points,
    previous_row,
    running_sums,
    trailing_windows,
)
from fairspark.session import materialise

OBJECTIVES = ["accuracy", "dp_gap", "eo_gap", "calibration_error"]
EPSILON = 1e-6


# Sweeps --------------------------------------------------------------------------


def offset_threshold(offset: float) -> float:
    return 0.5 + offset * 0.1


def _scored_cells(df: DataFrame, group: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Counts per (group, number of thresholds at or below the score): one scan for all
    candidates, found by binary search instead of pairing rows with candidates."""
    cuts = sorted(set(thresholds))
    clean = df.dropna(subset=["y_true", score, group])
    binned = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=score, outputCol="__bin").transform(clean)
    return binned.groupBy(F.col(group).cast("string").alias("grp"), F.col("__bin").cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.sum("y_true").alias("pos"), F.sum(F.abs(F.col(score) - F.col("y_true"))).alias("abs_err")
    )


def _candidate_cells(df: DataFrame, group: str, score: str, candidates: dict[int, float]) -> DataFrame:
    """Confusion counts per (candidate, group) from the binned cells.

    The cell table has one row per group and threshold, so pairing it with the
    candidates is bounded by groups x candidates squared and never sees raw rows.
    """
    cuts = sorted(set(candidates.values()))
    cells = _scored_cells(df, group, score, list(candidates.values()))
    rank = {t: i + 1 for i, t in enumerate(cuts)}
    entries = F.array(*[F.struct(F.lit(c).alias("candidate"), F.lit(t).alias("threshold"), F.lit(rank[t]).alias("r")) for c, t in candidates.items()])
    spread = cells.select("*", F.inline(entries))
    hit = F.col("bin") >= F.col("r")
    neg = F.col("n") - F.col("pos")
    return spread.groupBy("candidate", "threshold", "grp").agg(
        F.sum("n").alias("n"),
        F.sum("pos").alias("pos"),
        F.sum("abs_err").alias("abs_err"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0.0)).alias("tp"),
        F.sum(F.when(hit, neg).otherwise(0.0)).alias("fp"),
    )


def _gaps(per_group: DataFrame, by: Sequence[str]) -> DataFrame:
    neg = F.col("n") - F.col("pos")
    rates = per_group.select(
        *by, "n", "pos", "tp", "fp", "abs_err",
        ((F.col("tp") + F.col("fp")) / F.col("n")).alias("rate"),
        ratio(F.col("tp"), F.col("pos")).alias("tpr"),
        ratio(F.col("fp"), neg).alias("fpr"),
    )
    spread = lambda c: F.max(c) - F.min(c)
    return rates.groupBy(*by).agg(
        r6(F.sum(F.col("tp") + F.col("n") - F.col("pos") - F.col("fp")) / F.sum("n")).alias("accuracy"),
        r6(spread("rate")).alias("dp_gap"),
        r6(F.greatest(spread("tpr"), spread("fpr"))).alias("eo_gap"),
        r6(F.sum("abs_err") / F.sum("n")).alias("calibration_error"),
    )


def evaluate_offsets(df: DataFrame, group: str, offsets: Sequence[float], score: str = "y_prob") -> DataFrame:
    """Accuracy, gaps and mean absolute error of every threshold offset."""
    candidates = {i: offset_threshold(o) for i, o in enumerate(offsets)}
    return _gaps(_candidate_cells(df, group, score, candidates), ["candidate", "threshold"])


def composite(accuracy: Column, dp: Column, eo: Column) -> Column:
    return accuracy - 0.5 * dp - 0.5 * eo


def sweep(
    evaluated: DataFrame, max_dp: float = 0.05, max_eo: float = 0.05, min_accuracy: float = 0.55
) -> DataFrame:
    """Target flag and composite score of every candidate, with the best one marked.

    The objective is a table, so any ``DataFrame -> DataFrame`` evaluation can feed it.
    """
    score = r6(composite(F.col("accuracy"), F.col("dp_gap"), F.col("eo_gap")))
    target = (F.col("dp_gap") <= max_dp) & (F.col("eo_gap") <= max_eo) & (F.col("accuracy") >= min_accuracy)
    scored = evaluated.withColumn("composite", score).withColumn("target_reached", target)
    best = scored.agg(F.min_by("candidate", F.struct(-F.col("composite"), F.col("candidate"))).alias("__best"))
    return attach_row(scored, best).withColumn("is_best", F.col("candidate") == F.col("__best")).drop("__best")


def sweep_with(df: DataFrame, evaluate: Callable[[DataFrame], DataFrame], **limits: float) -> DataFrame:
    """Sweep with a user-defined evaluation callback."""
    return sweep(evaluate(df), **limits)


def evaluate_weights(
    df: DataFrame, features: Sequence[str], coefficients: Sequence[float], bias: float, group: str, weights: Sequence[Sequence[float]]
) -> DataFrame:
    """Re-score a linear model under candidate feature weights, clipped to [0, 2].

    Candidates are expanded inside the map task and combined before the shuffle, so
    the exchange carries candidates x groups rows per task.
    """
    def score(w: Sequence[float]) -> Column:
        out = F.lit(float(bias))
        for f, c, x in zip(features, coefficients, w):
            out = out + F.col(f) * F.lit(float(c) * min(2.0, max(0.0, float(x))))
        return out

    entries = F.array(*[F.struct(F.lit(i).alias("candidate"), score(w).alias("z")) for i, w in enumerate(weights)])
    rows = df.dropna(subset=["y_true", group, *features]).select(
        F.col(group).cast("string").alias("grp"), "y_true", F.inline(entries)
    )
    hit = F.col("z") >= 0
    p = F.when(hit, 1 / (1 + F.exp(-F.col("z")))).otherwise(F.exp("z") / (1 + F.exp("z")))
    per_group = rows.groupBy("candidate", "grp").agg(
        F.count("*").alias("n"), F.sum("y_true").alias("pos"), F.sum(F.abs(p - F.col("y_true"))).alias("abs_err"),
        F.sum(F.when(hit, F.col("y_true")).otherwise(0.0)).alias("tp"),
        F.sum(F.when(hit, 1 - F.col("y_true")).otherwise(0.0)).alias("fp"),
    )
    return _gaps(per_group, ["candidate"])


# Pareto front --------------------------------------------------------------------


#: Points of a block in the domination tests.
BLOCK_POINTS = 1_024
_KEY_BITS = 10


def _better(c: str) -> Column:
    """An objective as 'larger is better'."""
    return F.col(c) if c == "accuracy" else -F.col(c)


def _z_order(df: DataFrame, block_points: int) -> DataFrame:
    """``block`` per row: runs of about ``block_points`` rows along a Z-order curve over the objectives.

    The curve interleaves the leading bits of each objective's place between its least and greatest value,
    so rows of a block lie close together in all of them. ``df`` should be written already, unless it has
    no more rows than one block.
    """
    if df.limit(block_points + 1).count() <= block_points:
        return df.withColumn("block", F.lit(0))
    ends = df.agg(F.count("*").alias("n"), *[f(_better(c)).alias(f"{n}_{c}") for c in OBJECTIVES for n, f in (("lo", F.min), ("hi", F.max))]).first()
    blocks = -(-ends["n"] // block_points)
    key = F.lit(0).cast("bigint")
    for i, c in enumerate(OBJECTIVES):
        low, width = ends[f"lo_{c}"], ends[f"hi_{c}"] - ends[f"lo_{c}"]
        if not width > 0:
            continue
        at = F.least(F.floor((_better(c) - F.lit(low)) / F.lit(width) * 2**_KEY_BITS), F.lit(2**_KEY_BITS - 1)).cast("bigint")
        for bit in range(_KEY_BITS):
            key = key + F.shiftleft(F.shiftright(at, bit).bitwiseAND(F.lit(1)), bit * len(OBJECTIVES) + i)
    laid = df.withColumn("__key", key).repartitionByRange(blocks, "__key", *OBJECTIVES).withColumn("block", F.spark_partition_id())
    return materialise(laid.drop("__key"))


def _matrix(rows: Sequence) -> np.ndarray:
    m = np.array([[r[c] for c in OBJECTIVES] for r in rows], dtype=float).reshape(len(rows), len(OBJECTIVES))
    return m * np.array([1.0, -1.0, -1.0, -1.0])


def _weakly_dominated(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which points another point is at least as good as in all objectives and better in one."""
    out = np.zeros(len(points), bool)
    for at in range(0, len(by), 256):
        part = by[at : at + 256]
        ok = (part[None, :, :] >= points[:, None, :]).all(axis=2)
        out |= (ok & (part[None, :, :] > points[:, None, :]).any(axis=2)).any(axis=1)
    return out


def _local_skyline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct points of a partition without those that others of the same batch weakly dominate."""
    for pdf in batches:
        distinct = pdf.drop_duplicates()
        kept = []
        order = distinct.iloc[np.argsort(-_matrix(distinct.to_dict("records")).sum(axis=1), kind="stable")]
        for at in range(0, len(order), BLOCK_POINTS):
            part = order.iloc[at : at + BLOCK_POINTS]
            own = _matrix(part.to_dict("records"))
            kept.append(part[~_weakly_dominated(own, own)])
        if kept:
            yield pd.concat(kept)


def _flagged(points: DataFrame, others: DataFrame, epsilon: float, direction: str, name: str) -> DataFrame:
    """``points`` with ``name``: whether a row of ``others`` dominates it, or is dominated by it, within the tolerance.

    Both sides lie in Z-order blocks. A block's corners tell whether any of its rows can be involved with
    another block's; only such pairs of blocks are compared, each in one task, as two matrices. What the
    tasks send back is the numbers of the flagged rows.
    """
    rows = _z_order(points, BLOCK_POINTS).withColumn("__row", F.monotonically_increasing_id())
    corners = [f(_better(c)).alias(f"{n}_{c}") for c in OBJECTIVES for n, f in (("lo", F.min), ("hi", F.max))]
    packed = F.collect_list(F.struct("__row", *OBJECTIVES)).alias("rows")
    mine = rows.groupBy("block").agg(packed, *corners)
    theirs = _z_order(others.select(*OBJECTIVES), BLOCK_POINTS).withColumn("__row", F.lit(0)).groupBy(F.col("block").alias("other")).agg(
        packed.alias("others"), *[f(_better(c)).alias(f"o{n}_{c}") for c in OBJECTIVES for n, f in (("lo", F.min), ("hi", F.max))]
    )
    strong, weak = ("o", "") if direction == "by" else ("", "o")
    possible, strictly = F.lit(True), F.lit(False)
    for c in OBJECTIVES:
        possible = possible & (F.col(f"{strong}hi_{c}") >= F.col(f"{weak}lo_{c}") - epsilon)
        strictly = strictly | (F.col(f"{strong}hi_{c}") > F.col(f"{weak}lo_{c}") + epsilon)
    # Corners first, rows after: the pairs of blocks are found from two small tables.
    meet = mine.drop("rows").join(theirs.drop("others"), possible & strictly).select("block", "other")
    pairs = meet.join(mine.select("block", "rows"), "block").join(theirs.select("other", "others"), "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine_, theirs_ in zip(batch.column("rows"), batch.column("others")):
                a, b = mine_.as_py(), theirs_.as_py()
                p, q = _matrix(a), _matrix(b)
                hit = np.zeros(len(p), bool)
                for at in range(0, len(q), 128):
                    x, y = (q[at : at + 128][None, :, :], p[:, None, :]) if direction == "by" else (p[:, None, :], q[at : at + 128][None, :, :])
                    hit |= ((x >= y - epsilon).all(axis=2) & (x > y + epsilon).any(axis=2)).any(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([r["__row"] for r, h in zip(a, hit) if h], pa.int64())], names=["__row"])

    hits = pairs.select("rows", "others").mapInArrow(run, "__row bigint").distinct().withColumn(name, F.lit(True))
    return rows.drop("block").join(hits, "__row", "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("__row")


def skyline(candidates: DataFrame) -> DataFrame:
    """Distinct points that no other point weakly dominates, by merging skylines of Z-order blocks.

    Tasks first drop what their own rows dominate; the rest is tested block against block.
    """
    shape = ", ".join(f"{c} double" for c in OBJECTIVES)
    points = candidates.select(*[F.col(c).cast("double").alias(c) for c in OBJECTIVES])
    near = materialise(points.mapInPandas(_local_skyline, shape).distinct())
    if near.limit(BLOCK_POINTS + 1).count() <= BLOCK_POINTS:
        return near.coalesce(1).mapInPandas(_local_skyline, shape)
    left = materialise(_z_order(near, BLOCK_POINTS).select(*OBJECTIVES).mapInPandas(_local_skyline, shape).distinct())
    return _flagged(left, left, 0.0, "by", "__out").where("NOT __out").select(*OBJECTIVES)


def pareto_front(candidates: DataFrame, epsilon: float = EPSILON, max_front: int | None = None) -> DataFrame:
    """Candidates that none dominates within the tolerance; the best ``max_front`` by score if asked.

    With a tolerance domination is not transitive, so a plain merge of local fronts could differ. Whatever a
    point that is weakly dominated without tolerance dominates, its dominator dominates too. So the points
    of :func:`skyline` stand for all, and every candidate is tested against them, block by block. Neither the
    front nor its dominators pass through the driver or one task.
    """
    clean = materialise(candidates.dropna(subset=OBJECTIVES))
    front = _flagged(clean, materialise(skyline(clean)), epsilon, "by", "__out").where("NOT __out").drop("__out")
    score = F.col("accuracy") - (F.col("dp_gap") + F.col("eo_gap") + F.col("calibration_error")) / 3.0
    front = front.withColumn("front_score", score)
    return front if max_front is None else front.orderBy(F.col("front_score").desc(), *OBJECTIVES).limit(max_front)


def pareto_multiplier(candidates: DataFrame, front: DataFrame, epsilon: float = EPSILON, bonus: float = 0.5, penalty: float = -0.3) -> DataFrame:
    """1.5 for candidates that dominate a front point, 0.7 for dominated ones, else 1.

    The front is compared block by block, like the candidates. A candidate without all objectives keeps 1.
    """
    points = materialise(front.select(*OBJECTIVES).dropna().distinct())
    whole = materialise(candidates.dropna(subset=OBJECTIVES))
    tested = _flagged(materialise(_flagged(whole, points, epsilon, "over", "__wins")), points, epsilon, "by", "__loses")
    value = F.when(F.col("__wins"), 1.0 + bonus).when(F.col("__loses"), 1.0 + penalty).otherwise(1.0)
    tested = tested.withColumn("multiplier", value).drop("__wins", "__loses")
    missing = F.lit(False)
    for c in OBJECTIVES:
        missing = missing | F.col(c).isNull() | F.isnan(c)
    return tested.unionByName(candidates.where(missing).withColumn("multiplier", F.lit(1.0)))


# Metric histories ----------------------------------------------------------------


def step_changes(history: DataFrame, rows_per_block: int = 200_000) -> DataFrame:
    """Each step of a run beside the previous one; first steps have none and drop out."""
    joined = previous_row(history, ["run"], "step", OBJECTIVES, rows_per_block=rows_per_block)
    return joined.where(F.col("prev_accuracy").isNotNull())


def rewards(changes: DataFrame, action: Column | None = None) -> DataFrame:
    """Shaped reward between consecutive steps with its parts.

    Penalties: accuracy drops beyond 0.02, and the squared norm of an action array.
    """
    delta = F.col("accuracy") - F.col("prev_accuracy")
    gain = lambda c: F.col(f"prev_{c}") - F.col(c)
    drop = F.when(delta < -0.02, -5.0 * (F.abs(delta) - 0.02) * 100.0).otherwise(F.lit(0.0))
    effort = F.lit(0.0) if action is None else -0.01 * F.aggregate(action, F.lit(0.0), lambda acc, a: acc + a * a)
    parts = changes.select(
        "run", "step",
        (0.3 * delta * 100.0).alias("accuracy_reward"),
        (0.25 * gain("dp_gap") * 10.0).alias("dp_reward"),
        (0.25 * gain("eo_gap") * 10.0).alias("eo_reward"),
        (0.2 * gain("calibration_error") * 10.0).alias("calibration_reward"),
        (drop + effort).alias("penalty"),
    )
    names = ["accuracy_reward", "dp_reward", "eo_reward", "calibration_reward", "penalty"]
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    return parts.withColumn("total_reward", total)


def normalised_rewards(reward: DataFrame, rows_per_block: int = 200_000) -> DataFrame:
    """``(r - mean) / std`` with running moments of the run; 0 below a std of 1e-8."""
    r = F.col("total_reward")
    sums = running_sums(
        reward.select("run", "step", "total_reward"), ["run"], ["step"],
        {"cnt": F.lit(1).cast("bigint"), "s1": r, "s2": r * r}, rows_per_block=rows_per_block,
    )
    mean = F.col("s1") / F.col("cnt")
    std = F.sqrt(F.greatest(F.col("s2") / F.col("cnt") - mean * mean, F.lit(0.0)))
    return sums.select("run", "step", "total_reward", F.when(std < 1e-8, 0.0).otherwise((r - mean) / std).alias("normalised"))


def goodhart_guard(changes: DataFrame, max_ratio: float = 0.5, warn_ratio: float = 0.3, floor: float = 0.60) -> DataFrame:
    """Relative degradation per metric, alert level and reward factor of every step."""
    def degradation(c: str) -> Column:
        old, new = F.col(f"prev_{c}"), F.col(c)
        worse = old - new if c == "accuracy" else new - old
        return worse / F.greatest(F.abs(old), F.lit(1e-8))

    scored = changes.select(
        "run", "step", "accuracy", *[degradation(c).alias(f"d_{c}") for c in OBJECTIVES]
    )
    below = F.col("accuracy") < floor
    names = F.concat_ws(
        ",", *[F.when(F.col(f"d_{c}") > warn_ratio, F.lit(c)) for c in OBJECTIVES], F.when(below, "accuracy_below_floor")
    )
    unsafe = below & (floor - F.col("accuracy") > max_ratio)
    for c in OBJECTIVES:
        unsafe = unsafe | (F.col(f"d_{c}") > max_ratio)
    level = F.when(names == "", "safe").when(unsafe, "unsafe").otherwise("warning")
    return scored.select(
        "run", "step", *[r6(F.col(f"d_{c}")).alias(f"d_{c}") for c in OBJECTIVES],
        names.alias("degraded"), level.alias("alert_level"),
    )


def guarded_reward(reward: Column, level: Column) -> Column:
    """Cut by 30 % of its size under a warning, by 80 % when unsafe."""
    return reward - F.abs(reward) * F.when(level == "warning", 0.3).when(level == "unsafe", 0.8).otherwise(0.0)


def metric_trend(history: DataFrame, metric: str, window: int = 10, rows_per_block: int = 200_000) -> DataFrame:
    """Least-squares slope, mean and population deviation over the last ``window`` values."""
    y, x = F.col(metric), F.col("rn").cast("double")
    out = trailing_windows(
        history.select("run", "step", metric), ["run"], "step", window,
        {
            "n": F.count(y), "mean": F.avg(y), "sxy": F.covar_pop(y, x), "sxx": F.var_pop(x), "std": F.stddev_pop(y),
        },
        rows_per_block,
    )
    slope = F.when(F.col("n") >= 2, F.col("sxy") / F.col("sxx")).otherwise(F.lit(0.0))
    return out.select("run", "step", metric, slope.alias("slope"), "mean", "std")


LOWER_IS_BETTER = ["gap", "error", "loss", "distance", "drift", "bias"]


def compare_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change and direction of every metric of two ``(metric, value)`` tables."""
    joined = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), "metric", "full_outer")
    change = F.col("after") - F.col("before")
    lower = F.lit(False)
    for word in LOWER_IS_BETTER:
        lower = lower | F.contains(F.lower("metric"), F.lit(word))
    improved = (lower & (change < 0)) | (~lower & (change > 0))
    direction = (
        F.when(F.col("before").isNull(), "new")
        .when(F.col("after").isNull(), "removed")
        .when(F.abs(change) < 1e-8, "unchanged")
        .when(improved, "improved")
        .otherwise("regressed")
    )
    pct = F.when(F.abs("before") > 1e-10, change / F.abs("before") * 100).otherwise(F.when(change.isNotNull(), 0.0))
    return joined.select(
        "metric", "before", "after", r6(change).alias("change"), F.bround(pct, 2).alias("pct_change"), direction.alias("direction")
    )


def comparison_counts(comparison: DataFrame) -> DataFrame:
    names = ["improved", "regressed", "unchanged", "new", "removed"]
    return comparison.agg(*[count_if(F.col("direction") == d).alias(f"n_{d}") for d in names])


def module_summary(modules: DataFrame) -> DataFrame:
    """Key figures of a long ``(module, metric, value, label)`` result table, one row."""
    num = lambda mod, met: F.max(F.when((F.col("module") == mod) & (F.col("metric") == met), F.col("value")))
    lab = lambda mod, met: F.max(F.when((F.col("module") == mod) & (F.col("metric") == met), F.col("label")))
    one = modules.agg(
        F.count_distinct("module").alias("n_modules"),
        num("fairness", "accuracy").alias("accuracy"),
        num("fairness", "dp_gap").alias("dp_gap"),
        num("fairness", "eo_gap").alias("eo_gap"),
        num("drift", "n_drifted").cast("bigint").alias("n_drifted"),
        F.coalesce(lab("drift", "severity"), F.lit("none")).alias("drift_severity"),
        num("text_bias", "bias_index").alias("bias_index"),
    )
    return one.withColumn("worst_fairness_gap", F.greatest(F.coalesce("dp_gap", F.lit(0.0)), F.coalesce("eo_gap", F.lit(0.0))))


def assess_health(summary: DataFrame) -> DataFrame:
    """degraded on high or critical drift, warning on medium drift or a gap above 0.2."""
    sev = F.col("drift_severity")
    drifted = F.coalesce(F.col("n_drifted"), F.lit(0)) > 0
    dp, eo = F.coalesce("dp_gap", F.lit(0.0)), F.coalesce("eo_gap", F.lit(0.0))
    gap = (dp > 0.2) | (eo > 0.2)
    bad, medium = drifted & sev.isin("high", "critical"), drifted & (sev == "medium")
    return summary.select(
        F.when(bad, "degraded").when(medium | gap, "warning").otherwise("healthy").alias("status"),
        F.when(bad, F.concat(F.lit("Drift severity: "), sev)).otherwise("").alias("issues"),
        F.concat_ws(
            "; ",
            F.when(medium, F.concat(F.lit("Drift severity: "), sev)),
            F.when(gap, F.format_string("High fairness gap: DP=%.3f, EO=%.3f", dp, eo)),
        ).alias("warnings"),
    )


# Data fixes ----------------------------------------------------------------------


#: Copies that one row makes in its own task; more are spread over tasks.
COPIES_PER_TASK = 10_000


def _spread(df: DataFrame, count: Column, alias: str, keys: Sequence[str], per_task: int) -> DataFrame:
    """``alias`` from 1 to ``count`` for every row, in chunks that are dealt out to the tasks."""
    chunked = df.withColumn("__count", count).withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__count") - 1) / per_task))))
    dealt = chunked.repartition(*keys, "__chunk")
    upto = F.least("__count", (F.col("__chunk") + 1) * per_task)
    return dealt.withColumn(alias, F.explode(F.sequence(F.col("__chunk") * per_task + 1, upto))).drop("__count", "__chunk")


def oversample(df: DataFrame, group: str, id_col: str, seed: int = 42, per_task: int = COPIES_PER_TASK) -> DataFrame:
    """Repeat rows so that every group reaches the largest group's size.

    All but the last copy of a group are complete; the last copy keeps the rows whose
    hash comes first, so the result is reproducible and of exact size. Copies are made
    where the rows are; those of groups so small that a row makes more than ``per_task``
    copies are dealt out to all tasks.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("__n"))
    target = attach_row(sizes, sizes.agg(F.max("__n").alias("__max")))
    full, rest = F.floor(F.col("__max") / F.col("__n")), F.col("__max") % F.col("__n")
    rows = df.join(pinned(target), group).withColumn("__hash", hash_key(F.col(id_col), F.lit(seed)))
    marked = first_by_hash(rows, [group], "__hash", id_col, F.col("__max") % F.col("__n"), "__extra", carry=["__max", "__n"])
    copies = (full + F.when((rest > 0) & F.col("__extra"), 1).otherwise(0)).cast("bigint")
    rare = full >= per_task
    here = marked.where(~rare).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
    dealt = _spread(marked.where(rare), copies, "copy", [group, id_col], per_task)
    return here.select(*df.columns, "copy").unionByName(dealt.select(*df.columns, "copy"))


def resample(df: DataFrame, group: str, id_col: str, seed: int = 42, per_task: int = COPIES_PER_TASK) -> DataFrame:
    """Smaller groups drawn with replacement to the largest group's size; largest groups stay.

    Draw ``copy`` of a group picks the row whose place in the order of a hash follows from
    md5 of group, draw and seed, so a retried task draws the same rows.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("__n"))
    target = attach_row(sizes, sizes.agg(F.max("__n").alias("__max")))
    short = F.col("__n") < F.col("__max")
    number = lambda *parts: F.conv(F.substring(hash_key(*parts), 1, 13), 16, 10).cast("bigint")
    draws = _spread(target.where(short), F.col("__max"), "copy", [group], per_task)
    picked = draws.select(group, "copy", (F.pmod(number(F.col(group), F.col("copy"), F.lit(seed)), F.col("__n")) + 1).alias("__place"))
    hashed = df.withColumn("__order", number(F.col(id_col), F.lit(seed)))
    # As many partitions as the rows need, so the sorts of a task do not grow with the table.
    n_rows = df.count()
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-n_rows // ROWS_PER_BLOCK))
    points = split_points(hashed, "__order", n_rows=n_rows)
    placed = row_index(hashed, [group], ["__order", id_col], "__place", points, parts=parts).repartition(parts, group, "__place")
    drawn = placed.join(picked.repartition(parts, group, "__place"), [group, "__place"]).select(*df.columns, "copy")
    whole = df.join(target.where(~short).select(group), group, "left_semi").withColumn("copy", F.lit(1).cast("bigint"))
    return drawn.unionByName(whole.select(*df.columns, "copy"))


def group_thresholds(
    df: DataFrame, group: str, score: str = "y_prob", grid: Sequence[float] | None = None, base: float = 0.5
) -> DataFrame:
    """Threshold with the best accuracy per group (first best wins; base if none beats 0)."""
    grid = list(grid) if grid is not None else [0.1 + i * 0.05 for i in range(16)]
    cells = _candidate_cells(df, group, score, dict(enumerate(grid)))
    acc = (F.col("tp") + F.col("n") - F.col("pos") - F.col("fp")) / F.col("n")
    scored = cells.withColumn("acc", acc)
    best = F.min_by(F.struct("threshold", "acc"), F.struct(-F.col("acc"), F.col("candidate")))
    chosen = scored.groupBy("grp").agg(best.alias("b"), F.max("n").cast("bigint").alias("n"))
    ok = F.col("b.acc") > 0
    return chosen.select(
        "grp", "n", F.bround(F.when(ok, F.col("b.threshold")).otherwise(F.lit(base)), 3).alias("threshold"), r6(F.col("b.acc")).alias("accuracy")
    )


def apply_thresholds(df: DataFrame, thresholds: DataFrame, group: str, score: str = "y_prob") -> DataFrame:
    """Group-specific predictions; the threshold table has one row per group."""
    t = pinned(thresholds.select(F.col("grp").alias("__grp"), F.col("threshold").alias("__t")))
    joined = df.join(t, F.col(group).cast("string") == F.col("__grp"), "left")
    flag = F.when(F.col("__t").isNull(), F.lit(0.0)).otherwise((F.col(score) >= F.col("__t")).cast("double"))
    return joined.withColumn("fair_pred", flag).drop("__grp", "__t")


def fairness_weights(df: DataFrame, group: str) -> DataFrame:
    """Largest group size over own size, divided by the mean weight, as a group table.

    The mean weight over all rows follows from the group sizes; no row is touched twice.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    whole = sizes.agg(F.max("n").alias("__max"), F.sum("n").alias("__all"), F.count("*").alias("__groups"))
    raw = F.col("__max") / F.col("n")
    mean = F.col("__max") * F.col("__groups") / F.col("__all")
    return attach_row(sizes, whole).select(group, "n", (raw / mean).alias("weight"))


def apply_weights(df: DataFrame, group: str) -> DataFrame:
    return df.join(pinned(fairness_weights(df, group).drop("n")), group)


def choose_fix(reports: DataFrame) -> DataFrame:
    """Fix type and expected improvement from ``(name, metrics array, bias_index)`` rows."""
    idx = F.col("bias_index")
    parity = F.arrays_overlap("metrics", F.array(F.lit("disparate_impact"), F.lit("demographic_parity")))
    kind = (
        F.when(parity, F.when(idx > 60, "preprocessing").otherwise("reweighting"))
        .when(F.array_contains("metrics", "equalized_odds"), "threshold")
        .otherwise(F.when(idx > 50, "preprocessing").otherwise("reweighting"))
    )

    def text(span: str, low: float, high: float) -> Column:
        return F.format_string(
            f"Expected to reduce bias index by {span} (from %.0f to ~%.0f-%.0f)", idx, F.bround(idx * low), F.bround(idx * high)
        )

    return reports.select(
        "name", "bias_index", kind.alias("fix_type"),
        F.when(idx > 70, text("50-70%%", 0.5, 0.7)).when(idx > 40, text("40-60%%", 0.6, 0.8)).otherwise(text("30-50%%", 0.7, 0.9)).alias("expected"),
    )
