"""Drift detection on long tables ``(feature, seq, side, value)`` with side ``ref``/``new``.

All features run in one plan. Order-dependent parts (CUSUM, empirical CDFs, window
numbering) use blocked scans, so one dominant feature does not end in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairspark.functions.numeric import count_if, ladder_label, r6, ratio
from fairspark.functions.ordering import (
    BLOCK,
    ROWS_PER_BLOCK,
    exact_quantiles,
    hash_key,
    next_in_order,
    pinned,
    row_index,
    running_sums,
    split_points,
    with_blocks,
)
from fairspark.functions.permutation import MOST_CUTS, ROWS_PER_MATRIX, coefficients, labels, permutation_cuts
from fairspark.functions.special import lattice_tail
from fairspark.session import materialise

MIN_REFERENCE = 30
MIN_COMPARE = 20
STD_FLOOR = 1e-10
DRIFT_PARAMETER = 0.5
CUSUM_THRESHOLD = 5.0
WASSERSTEIN_THRESHOLD = 0.1
SIGNIFICANCE = 0.05
PERMUTATIONS = 200
JSD_BINS = 50
PSI_BINS = 10
EPS = 1e-10


def side(df: DataFrame, name: str) -> DataFrame:
    return df.where((F.col("side") == name) & F.col("value").isNotNull())


def reference_fit(df: DataFrame, min_reference: int = MIN_REFERENCE) -> DataFrame:
    """Mean and floored population deviation per feature; small samples are flagged."""
    return side(df, "ref").groupBy("feature").agg(
        F.count("*").alias("n_ref"),
        F.avg("value").alias("mu"),
        F.greatest(F.stddev_pop("value"), F.lit(STD_FLOOR)).alias("sd"),
        F.when(F.count("*") >= min_reference, "fitted").otherwise("insufficient").alias("status"),
    )


def cusum_scan(
    new: DataFrame,
    fit: DataFrame,
    threshold: float = CUSUM_THRESHOLD,
    k: float = DRIFT_PARAMETER,
    state: DataFrame | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
    points: Sequence[float] | None = None,
) -> DataFrame:
    """Two-sided CUSUM of every new value in ``seq`` order.

    ``g = max(0, g + z - k)`` over a run of rows is the map ``g -> max(G, g + S)``
    with ``S`` the sum of the steps and ``G`` the value reached from zero. Inside a
    block both come from window sums; blocks are chained through one row each. An
    optional ``state(feature, g_pos, g_neg)`` continues an earlier run.
    """
    if points is None:
        points = split_points(new, "seq", rows_per_block)
    z = (F.col("value") - F.col("mu")) / F.col("sd")
    steps = new.join(pinned(fit.where(F.col("status") == "fitted").select("feature", "mu", "sd")), "feature").select(
        "feature", "seq", "value", "mu", "sd", (z - k).alias("up"), (-z - k).alias("down")
    )
    blocked = with_blocks(steps, "seq", points)
    part = ["feature", BLOCK]
    order = Window.partitionBy(*part).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    sums = blocked.select("*", F.sum("up").over(order).alias("s_up"), F.sum("down").over(order).alias("s_down"))
    zero = F.lit(0.0)
    local = sums.select(
        "*",
        (F.col("s_up") - F.least(zero, F.min("s_up").over(order))).alias("l_up"),
        (F.col("s_down") - F.least(zero, F.min("s_down").over(order))).alias("l_down"),
    )
    if not points and state is None:
        out = local.withColumn("g_pos", F.col("l_up")).withColumn("g_neg", F.col("l_down"))
    else:
        ends = local.groupBy(*part).agg(
            F.sum("up").alias("S_up"),
            F.sum("down").alias("S_down"),
            F.max_by("l_up", "seq").alias("G_up"),
            F.max_by("l_down", "seq").alias("G_down"),
        )
        start = ends if state is None else ends.join(state, "feature", "left")
        g0 = {"up": zero, "down": zero}
        if state is not None:
            g0 = {"up": F.coalesce("g_pos", zero), "down": F.coalesce("g_neg", zero)}
        upto = Window.partitionBy("feature").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        carried = start
        for d in ("up", "down"):
            # P = sum of the steps of all earlier blocks; entering value = P + max(g0, max(G_b - P_b_end)).
            carried = carried.withColumn(f"P_{d}", F.coalesce(F.sum(f"S_{d}").over(upto), zero))
            reached = F.col(f"G_{d}") - (F.col(f"P_{d}") + F.col(f"S_{d}"))
            carried = carried.withColumn(f"R_{d}", reached).withColumn(f"g0_{d}", g0[d])
            best = F.greatest(F.col(f"g0_{d}"), F.coalesce(F.max(f"R_{d}").over(upto), F.col(f"g0_{d}")))
            carried = carried.withColumn(f"in_{d}", best + F.col(f"P_{d}"))
        carry = carried.select(*part, "in_up", "in_down")
        out = (
            local.join(carry, part)
            .withColumn("g_pos", F.greatest(F.col("l_up"), F.col("in_up") + F.col("s_up"), zero))
            .withColumn("g_neg", F.greatest(F.col("l_down"), F.col("in_down") + F.col("s_down"), zero))
        )
    stat = F.greatest("g_pos", "g_neg")
    drifted = stat >= threshold
    return out.select(
        "feature",
        "seq",
        "value",
        "g_pos",
        "g_neg",
        stat.alias("statistic"),
        drifted.alias("drift_detected"),
        F.when(drifted, "drift").when(stat >= threshold * 0.6, "warning").otherwise("none").alias("status"),
        F.when(drifted, F.when(F.col("g_pos") > F.col("g_neg"), "upward").otherwise("downward")).alias("direction"),
        (F.col("mu") + F.col("g_pos") * F.col("sd")).alias("mean_estimate"),
    )


def cusum(df: DataFrame, threshold: float = CUSUM_THRESHOLD, k: float = DRIFT_PARAMETER, **kw) -> DataFrame:
    return cusum_scan(side(df, "new"), reference_fit(df), threshold, k, **kw)


def cusum_summary(scan: DataFrame) -> DataFrame:
    hit = F.col("drift_detected")
    return scan.groupBy("feature").agg(
        F.count("*").alias("total_points"),
        count_if(hit).alias("n_drift_points"),
        (count_if(hit) / F.count("*")).alias("drift_ratio"),
        F.max("statistic").alias("max_statistic"),
        F.max_by("statistic", "seq").alias("last_statistic"),
        F.min(F.when(hit, F.col("seq"))).alias("first_drift_seq"),
    )


def pooled_counts(df: DataFrame) -> DataFrame:
    """Distinct values per feature with their counts on both sides."""
    return (
        df.where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(count_if(F.col("side") == "ref").alias("c_ref"), count_if(F.col("side") == "new").alias("c_new"))
    )


def ecdf_scan(df: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Both empirical CDFs at every pooled distinct value, with the next value."""
    pooled = materialise(pooled_counts(df))
    points = split_points(pooled, "value", rows_per_block)
    ranked = running_sums(
        pooled, ["feature"], ["value"], {"cum_ref": F.col("c_ref"), "cum_new": F.col("c_new")}, points
    )
    chained = next_in_order(ranked, ["feature"], "value", "next_value", points)
    totals = pooled.groupBy("feature").agg(F.sum("c_ref").alias("n_ref"), F.sum("c_new").alias("n_new"))
    return chained.join(pinned(totals), "feature").withColumn(
        # Null for a feature that has rows on one side only.
        "cdf_gap", F.abs(F.try_divide("cum_ref", "n_ref") - F.try_divide("cum_new", "n_new"))
    )


def kolmogorov_p(stat: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample p-value: the alternating Kolmogorov series at sqrt(nm/(n+m))*D."""
    lam2 = n * m / (n + m) * stat * stat
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, i: acc + F.when(i % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * i * i * lam2),
    )
    tail = F.when(lam2 < 0.04, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))
    return F.when(stat.isNotNull(), tail)


def distances(df: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Wasserstein-1 and Kolmogorov-Smirnov per feature from one scan."""
    width = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
    agg = ecdf_scan(df, rows_per_block).groupBy("feature").agg(
        F.max("n_ref").alias("n_ref"),
        F.max("n_new").alias("n_new"),
        F.sum(F.col("cdf_gap") * width).alias("w1"),
        F.max("cdf_gap").alias("ks_statistic"),
    )
    return agg.withColumn("ks_p", kolmogorov_p(F.col("ks_statistic"), F.col("n_ref"), F.col("n_new")))


#: Samples of up to so many rows get the exact Kolmogorov-Smirnov tail.
EXACT_ROWS = 10_000


def ks_test(df: DataFrame, exact_rows: int = EXACT_ROWS, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Two-sample test per feature: ``feature, n_ref, n_new, ks_statistic, p_value, p_method``.

    Where both samples have at most ``exact_rows`` rows the p-value counts lattice paths (``exact``), beyond
    that it is the Kolmogorov series (``asymptotic``). Features on one side only have neither.
    """

    @F.pandas_udf("double")
    def exact(n: pd.Series, m: pd.Series, statistic: pd.Series) -> pd.Series:
        out = []
        for a, b, d in zip(n, m, statistic):
            if d != d or d is None or max(a, b) > exact_rows:
                out.append(None)
            else:
                step = math.gcd(int(a), int(b))
                out.append(lattice_tail(int(a), int(b), round(d * int(a) * int(b) / step) * step))
        return pd.Series(out, dtype="float64")

    found = distances(df, rows_per_block).select("feature", "n_ref", "n_new", "ks_statistic", "ks_p")
    counted = found.withColumn("__exact", exact("n_ref", "n_new", "ks_statistic"))
    method = F.when(F.col("ks_statistic").isNull(), None).when(F.col("__exact").isNotNull(), "exact").otherwise("asymptotic")
    return counted.select("feature", "n_ref", "n_new", "ks_statistic", F.coalesce("__exact", "ks_p").alias("p_value"), method.alias("p_method"))


def wasserstein_equal(df: DataFrame, a: str, b: str, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Mean absolute difference of two columns after sorting each.

    For equal sample sizes this is the area between both empirical CDFs, so no rank is
    formed. Samples of unequal size have no such pairing: evaluating the result fails.
    """
    entries = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).cast("double").alias("value")) for s, c in (("ref", a), ("new", b))])
    long = df.select(F.lit("pair").alias("feature"), F.inline(entries)).where(F.col("value").isNotNull())
    one = distances(long, rows_per_block).agg(
        F.coalesce(F.max("n_ref"), F.lit(0)).alias("n"), F.coalesce(F.max("n_new"), F.lit(0)).alias("n_b"), F.max("w1").alias("w1")
    )
    text = F.format_string("samples of unequal size: %d and %d values", F.col("n"), F.col("n_b"))
    return one.select("n", F.when(F.col("n") == F.col("n_b"), F.col("w1")).otherwise(F.raise_error(text)).alias("w1"))


#: Rows of one part of the permutation test; a task holds one part, so its memory stays as the table grows.
ROWS_PER_PART = 50_000


def _label_counts(part: pd.DataFrame, coef: np.ndarray, cut: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Per row 1, the observed label and the label of every permutation."""
    marked = labels(part["id"].to_numpy(), coef, cut)
    return np.column_stack([np.ones(len(part), bool), part["is_ref"].to_numpy(bool), marked])


def _part_totals(coef: np.ndarray, cuts: dict):
    """Per feature and part: rows, reference rows and rows labelled as reference by every permutation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}
        for pdf in batches:
            for key, rows in pdf.groupby(["grp", "part"]):
                total = sum(
                    _label_counts(rows.iloc[lo : lo + ROWS_PER_MATRIX], coef, cuts[key[0]]).sum(axis=0, dtype=np.int64)
                    for lo in range(0, len(rows), ROWS_PER_MATRIX)
                )
                first = rows["value"].min()
                known = acc.get(key)
                acc[key] = (first, total) if known is None else (min(first, known[0]), total + known[1])
        yield pd.DataFrame(
            [(g, part, first, total.tolist()) for (g, part), (first, total) in acc.items()], columns=["grp", "part", "first_value", "total"]
        )

    return run


def _part_distances(coef: np.ndarray, cuts: dict, sizes: dict):
    """Sum of |F - G| * width over one part for the observed labels and all permutations.

    Rows are taken in order of value; equal values have no width, so only the last of them
    counts. The last row of a part reaches to the first value of the next part.
    """

    def run(pdf: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        known = {r.grp: r for r in carry.itertuples(index=False)}
        out = []
        for g, rows in pdf.groupby("grp"):
            n, m = sizes[g]
            rows = rows.sort_values("value", kind="stable")
            values = rows["value"].to_numpy()
            after = known[g].next_value
            width = np.append(values[1:], values[-1] if after is None or pd.isna(after) else after) - values
            before = np.asarray(known[g].carry, dtype=np.int64)
            total = np.zeros(len(before) - 1)
            for lo in range(0, len(rows), ROWS_PER_MATRIX):
                cum = _label_counts(rows.iloc[lo : lo + ROWS_PER_MATRIX], coef, cuts[g]).cumsum(axis=0, dtype=np.int64) + before
                before = cum[-1]
                gap = np.abs(cum[:, 1:] / max(m, 1) - (cum[:, :1] - cum[:, 1:]) / max(n - m, 1))
                total += width[lo : lo + ROWS_PER_MATRIX] @ gap
            out.append((g, total.tolist()))
        return pd.DataFrame(out, columns=["grp", "sums"])

    return run


def _even_parts(spark: SparkSession, n_rows: int, rows_per_part: int = ROWS_PER_PART) -> int:
    """At least one partition per core, else as many as the rows need."""
    return max(spark.sparkContext.defaultParallelism, -(-n_rows // rows_per_part))


def permutation_test(
    df: DataFrame, n_perm: int = PERMUTATIONS, seed: int = 42, rows_per_block: int = ROWS_PER_PART, most_cuts: int = MOST_CUTS
) -> DataFrame:
    """W1 of the observed labelling and of ``n_perm`` random relabellings per feature.

    Every permutation labels exactly ``n_ref`` rows of the feature as reference. The rows are
    laid out once in ranges of (value, id), so a hot value spans several parts. A label follows
    from the id and the cut of its permutation and is computed where it is needed: the rows
    move as they are, and only one total per part and permutation leaves a task. A part turns
    its labels into cumulative counts from the totals of the earlier parts.
    A feature with rows on one side only has no distance (null). Cuts are held by the tasks;
    more than ``most_cuts`` of them are worked off in several passes over a share of the features.
    """
    base = df.where(F.col("feature").isNotNull() & F.col("value").isNotNull() & F.col("side").isin("ref", "new")).select(
        F.col("feature").alias("grp"), F.col("seq").cast("bigint").alias("id"), F.col("value").cast("double").alias("value"),
        (F.col("side") == "ref").alias("is_ref"),
    )
    n_features = base.agg(F.count_distinct("grp")).first()[0]
    passes = max(1, -(-n_features * n_perm // most_cuts))
    share = F.pmod(F.xxhash64("grp"), F.lit(passes))
    tested = [_permuted(base.where(share == k) if passes > 1 else base, n_perm, seed, rows_per_block) for k in range(passes)]
    return reduce(DataFrame.unionByName, tested)


def _permuted(base: DataFrame, n_perm: int, seed: int, rows_per_part: int) -> DataFrame:
    spark = base.sparkSession
    counted = base.groupBy("grp").agg(F.count("*").alias("n"), count_if(F.col("is_ref")).alias("m")).collect()
    sizes_local = {r["grp"]: (r["n"], r["m"]) for r in counted}
    sizes = spark.createDataFrame(counted, "grp string, n bigint, m bigint")
    n_parts = _even_parts(spark, sum(n for n, _ in sizes_local.values()), rows_per_part)
    rows = materialise(base.repartitionByRange(n_parts, "value", "id").withColumn("part", F.spark_partition_id()))
    cuts = permutation_cuts(rows.select("grp", "id"), sizes, n_perm, seed)
    coef = coefficients(n_perm, seed)
    totals = materialise(
        rows.mapInPandas(_part_totals(coef, cuts), "grp string, part int, first_value double, total array<bigint>")
    )
    per_perm = totals.select("grp", "part", "first_value", F.posexplode("total").alias("perm", "cnt"))
    order = Window.partitionBy("grp", "perm").orderBy("part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        per_perm.select(
            "grp", "part", "perm", F.coalesce(F.sum("cnt").over(before), F.lit(0)).alias("c"), F.lead("first_value").over(order).alias("nv")
        )
        .groupBy("grp", "part")
        .agg(
            F.transform(F.sort_array(F.collect_list(F.struct("perm", "c"))), lambda x: x["c"]).alias("carry"),
            F.max("nv").alias("next_value"),
        )
    )
    parts = (
        rows.groupBy("part")
        .cogroup(carry.groupBy("part"))
        .applyInPandas(_part_distances(coef, cuts, sizes_local), "grp string, sums array<double>")
    )
    summed = parts.select("grp", F.posexplode("sums").alias("perm", "d")).groupBy("grp", "perm").agg(F.sum("d").alias("d"))
    wide = summed.groupBy("grp").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("perm", "d"))), lambda x: x["d"]).alias("all")
    )
    return wide.join(sizes, "grp").select(
        F.col("grp").alias("feature"),
        F.col("m").alias("n_ref"),
        (F.col("n") - F.col("m")).alias("n_new"),
        F.when((F.col("m") > 0) & (F.col("m") < F.col("n")), F.col("all")[0]).alias("w1"),
        F.slice("all", 2, n_perm).alias("permuted"),
    )


def permutation_rows(test: DataFrame) -> DataFrame:
    return test.select("feature", "w1", F.posexplode("permuted").alias("perm", "perm_w1"))


def wasserstein_verdict(
    test: DataFrame, threshold: float = WASSERSTEIN_THRESHOLD, significance: float = SIGNIFICANCE
) -> DataFrame:
    """p-value and status: drift needs both the distance and the significance.

    Distances are compared at nine digits, so that summation order does not decide ties.
    """
    above = F.size(F.filter("permuted", lambda p: F.bround(p, 9) >= F.bround(F.col("w1"), 9)))
    p = F.when(F.col("w1").isNotNull(), (above + 1) / (F.size("permuted") + 1))
    drift = F.coalesce((F.col("w1") >= threshold) & (F.col("p_value") < significance), F.lit(False))
    return test.withColumn("p_value", p).select(
        "feature",
        "w1",
        "p_value",
        drift.alias("drift_detected"),
        F.when(F.col("w1").isNull(), "insufficient").when(drift, "drift").when(F.col("w1") >= threshold * 0.5, "warning").otherwise("none").alias("status"),
    )


def histogram_bin(value: Column, low: Column, step: Column, n_bins: int) -> Column:
    """Bin by the edges ``low + i * step``: half-open, last bin closed."""
    guess = F.floor((value - low) / step).cast("int")
    down = F.when(value < low + guess * step, guess - 1).otherwise(guess)
    up = F.when(value >= low + (down + 1) * step, down + 1).otherwise(down)
    return F.least(F.greatest(up, F.lit(0)), F.lit(n_bins - 1))


def histogram_counts(df: DataFrame, n_bins: int = JSD_BINS) -> DataFrame:
    """Counts of both sides over equal-width bins of the pooled range per feature."""
    clean = df.where(F.col("value").isNotNull())
    ends = clean.groupBy("feature").agg(
        F.min("value").alias("low"),
        ((F.max("value") - F.min("value")) / n_bins).alias("step"),
        count_if(F.col("side") == "ref").alias("n_ref"),
        count_if(F.col("side") == "new").alias("n_new"),
    )
    binned = clean.join(pinned(ends), "feature").withColumn(
        "bin", F.when(F.col("step") > 0, histogram_bin(F.col("value"), F.col("low"), F.col("step"), n_bins)).otherwise(F.lit(0))
    )
    return binned.groupBy("feature", "bin").agg(
        F.max("step").alias("step"),
        F.max("n_ref").alias("n_ref"),
        F.max("n_new").alias("n_new"),
        count_if(F.col("side") == "ref").alias("c_ref"),
        count_if(F.col("side") == "new").alias("c_new"),
    )


def jensen_shannon(df: DataFrame, n_bins: int = JSD_BINS) -> DataFrame:
    """Jensen-Shannon divergence of smoothed densities, natural log.

    Bins that are empty on both sides have equal smoothed mass and add nothing, so no
    spine of bins is built; they only enter the normalisation, which is closed form.
    """
    counts = histogram_counts(df, n_bins).where(F.col("step") > 0)
    norm = 1 / F.col("step") + n_bins * EPS
    p = (F.try_divide("c_ref", "n_ref") / F.col("step") + EPS) / norm
    q = (F.try_divide("c_new", "n_new") / F.col("step") + EPS) / norm
    m = 0.5 * (p + q)
    term = 0.5 * p * F.log(p / m) + 0.5 * q * F.log(q / m)
    return counts.groupBy("feature").agg(F.sum(term).alias("jsd"))


def population_stability(df: DataFrame, n_bins: int = PSI_BINS) -> DataFrame:
    """PSI over the pooled, de-duplicated quantile edges; 0 when under three edges."""
    clean = df.where(F.col("value").isNotNull())
    probs = [i / n_bins for i in range(n_bins + 1)]
    edges = exact_quantiles(clean, ["feature"], "value", probs).select(
        "feature", F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(n_bins + 1)])).alias("edges")
    )
    sizes = clean.groupBy("feature").agg(
        count_if(F.col("side") == "ref").alias("n_ref"), count_if(F.col("side") == "new").alias("n_new")
    )
    fitted = edges.join(sizes, "feature")
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    at_or_above = F.aggregate(inner, F.lit(0), lambda acc, e: acc + F.when(F.col("value") >= e, 1).otherwise(0))
    counts = (
        clean.join(pinned(fitted), "feature")
        .groupBy("feature", at_or_above.alias("bin"))
        .agg(
            F.max(F.size("edges")).alias("n_edges"),
            F.max("n_ref").alias("n_ref"),
            F.max("n_new").alias("n_new"),
            count_if(F.col("side") == "ref").alias("c_ref"),
            count_if(F.col("side") == "new").alias("c_new"),
        )
    )
    e = F.col("c_ref") / F.greatest("n_ref", F.lit(1)) + EPS
    a = F.col("c_new") / F.greatest("n_new", F.lit(1)) + EPS
    term = F.when(F.col("n_edges") >= 3, (a - e) * F.log(a / e)).otherwise(F.lit(0.0))
    return counts.groupBy("feature").agg(F.sum(term).alias("psi"))


def compare_distributions(df: DataFrame, ks_alpha: float = 0.05, jsd_limit: float = 0.1, psi_limit: float = 0.25) -> DataFrame:
    """KS, JSD, PSI, mean shift, deviation ratio and a text summary per feature."""
    moments = df.where(F.col("value").isNotNull()).groupBy("feature").agg(
        F.avg(F.when(F.col("side") == "new", F.col("value"))).alias("m_new"),
        F.avg(F.when(F.col("side") == "ref", F.col("value"))).alias("m_ref"),
        F.stddev_pop(F.when(F.col("side") == "new", F.col("value"))).alias("s_new"),
        F.stddev_pop(F.when(F.col("side") == "ref", F.col("value"))).alias("s_ref"),
    )
    joined = (
        distances(df).join(jensen_shannon(df), "feature", "left").join(population_stability(df), "feature", "left").join(moments, "feature")
    )
    enough = (F.col("n_ref") >= MIN_COMPARE) & (F.col("n_new") >= MIN_COMPARE)
    jsd, psi = F.coalesce("jsd", F.lit(0.0)), F.coalesce("psi", F.lit(0.0))
    ks_hit, jsd_hit, psi_hit = F.col("ks_p") < ks_alpha, jsd > jsd_limit, psi > psi_limit
    text = F.concat_ws(
        "; ",
        F.when(ks_hit, F.format_string("KS test significant (p=%.4f)", F.col("ks_p"))),
        F.when(jsd_hit, F.format_string("JSD elevated (%.4f)", jsd)),
        F.when(psi_hit, F.format_string("PSI %s (%.4f)", F.when(psi > 0.5, "significant").otherwise("moderate"), psi)),
    )
    summary = F.when(~enough, "Insufficient samples for comparison").when(text == "", "No significant drift").otherwise(text)
    have = lambda c: F.when(enough, r6(c)).otherwise(F.lit(0.0))
    return joined.select(
        "feature",
        have(F.col("ks_statistic")).alias("ks_statistic"),
        F.when(enough, r6(F.col("ks_p"))).otherwise(F.lit(1.0)).alias("ks_p"),
        have(jsd).alias("jsd"),
        have(psi).alias("psi"),
        have(F.col("m_new") - F.col("m_ref")).alias("mean_shift"),
        F.when(enough, r6(F.col("s_new") / F.greatest("s_ref", F.lit(STD_FLOOR)))).otherwise(F.lit(1.0)).alias("std_ratio"),
        (enough & (ks_hit | jsd_hit | psi_hit)).alias("drift_detected"),
        summary.alias("summary"),
    )


def divergence_and_entropy(df: DataFrame, n_bins: int = JSD_BINS) -> DataFrame:
    """Discrete KL(ref || new) and the entropy of ref, probabilities clipped to [1e-8, 1]."""
    clip = lambda c: F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(1e-8), c)))
    p, q = clip(F.try_divide("c_ref", "n_ref")), clip(F.try_divide("c_new", "n_new"))
    return histogram_counts(df, n_bins).groupBy("feature").agg(
        F.sum(p * F.log(p / q)).alias("kl"), F.sum(-p * F.log(p)).alias("entropy")
    )


def window_rows(new: DataFrame, size: int = 100, stride: int = 50, min_rows: int = 15, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Assign each row to its sliding windows; trailing short windows are kept from ``min_rows`` on."""
    numbered = row_index(new, ["feature"], ["seq"], "rn", rows_per_block=rows_per_block)
    idx = F.col("rn") - 1
    last = F.floor(idx / stride)
    first = F.greatest(F.lit(0), F.floor((idx - size) / stride) + 1)
    spread = numbered.withColumn("window_id", F.explode(F.sequence(first, last)))
    counted = spread.withColumn("n_window", F.count("*").over(Window.partitionBy("feature", "window_id")))
    return counted.where(F.col("n_window") >= min_rows)


def _null_windows(df: DataFrame, lengths: DataFrame, n_perm: int, seed: int, rows_per_block: int) -> DataFrame:
    """Windows drawn from the pooled rows of a feature: ``n_perm`` for each window length.

    A draw names a place in the order of the pooled values; places come from md5, so SQL and
    retried tasks draw the same rows. Windows have the ids -1, -2, ...
    """
    pool = df.where(F.col("value").isNotNull()).select("feature", "value", "side", "seq")
    placed = row_index(pool, ["feature"], ["value", "side", "seq"], "place", rows_per_block=rows_per_block).select("feature", "place", "value")
    sizes = pool.groupBy("feature").agg(F.count("*").alias("n"))
    draws = lengths.join(pinned(sizes), "feature").select(
        "feature", "n_window", "n", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("perm")
    ).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_window") - 1)).alias("seq"))
    drawn = hash_key(F.col("feature"), F.col("n_window"), F.col("perm"), F.col("seq"), F.lit(seed))
    place = F.pmod(F.conv(F.substring(drawn, 1, 13), 16, 10).cast("bigint"), F.col("n")) + 1
    return draws.withColumn("place", place).join(placed, ["feature", "place"]).select(
        "feature", (-1 - F.col("perm")).cast("bigint").alias("window_id"), "n_window", "value", "seq"
    )


def _window_distances(area: DataFrame, windows: DataFrame) -> DataFrame:
    """W1 of every window against the reference.

    Between neighbouring window values the window CDF is a constant ``c`` while the
    reference CDF ``F`` rises, so the integral of ``|F - c|`` needs only the primitive
    ``A`` of ``F`` at the window values and at the reference quantile of ``c``. Both come
    from one scan of the pooled values; the reference is never paired with the windows.
    """
    ends = pinned(
        area.where("c_ref > 0").groupBy("feature").agg(
            F.max("value").alias("ref_max"), F.max_by("A", "value").alias("A_max"), F.max("n_ref").alias("n_ref")
        )
    )
    points = windows.join(area.select("feature", "value", "A"), ["feature", "value"])
    w = Window.partitionBy("feature", "n_window", "window_id").orderBy("value", "seq")
    ordered = points.select(
        "feature", "window_id", "n_window", "value", "A",
        F.row_number().over(w).alias("i"),
        F.lead("value").over(w).alias("next_value"),
        F.lead("A").over(w).alias("next_A"),
    )
    # Reference quantiles F^-1(i / n): one row per distinct (feature, window size, i).
    need = windows.select("feature", "n_window").distinct().join(ends, "feature").select(
        "feature", "n_window", F.explode(F.sequence(F.lit(1), F.col("n_window") - 1)).alias("i"), "n_ref"
    ).withColumn("rank", F.ceil(F.col("i") * F.col("n_ref") / F.col("n_window")))
    ranks = pinned(need.groupBy("feature").agg(F.sort_array(F.collect_set("rank")).alias("ranks")))
    inside = F.filter("ranks", lambda r: (r > F.col("cum_ref") - F.col("c_ref")) & (r <= F.col("cum_ref")))
    quant = area.where("c_ref > 0").join(ranks, "feature").select(
        "feature", F.explode(inside).alias("rank"), F.col("value").alias("qv"), F.col("A").alias("qA")
    )
    cuts = need.join(quant, ["feature", "rank"]).select("feature", "n_window", "i", "qv", "qA")
    c = F.col("i") / F.col("n_window")
    q = F.least(F.greatest(F.col("qv"), F.col("value")), F.col("next_value"))
    qa = F.when(F.col("qv") <= F.col("value"), F.col("A")).when(F.col("qv") >= F.col("next_value"), F.col("next_A")).otherwise(F.col("qA"))
    middle = (c * (q - F.col("value")) - (qa - F.col("A"))) + ((F.col("next_A") - qa) - c * (F.col("next_value") - q))
    pieces = ordered.join(cuts, ["feature", "n_window", "i"], "left").join(ends.drop("n_ref"), "feature")
    first = F.when(F.col("i") == 1, F.col("A")).otherwise(F.lit(0.0))
    tail = F.greatest(F.lit(0.0), F.col("ref_max") - F.col("value")) - F.greatest(F.lit(0.0), F.col("A_max") - F.col("A"))
    last = F.when(F.col("next_value").isNull() & (F.col("ref_max") > F.col("value")), tail).otherwise(F.lit(0.0))
    total = F.sum(F.coalesce(middle, F.lit(0.0)) + first + last)
    return pieces.groupBy("feature", "n_window", "window_id").agg(total.alias("w1"))


def sliding_wasserstein(
    df: DataFrame,
    size: int = 100,
    min_rows: int = 15,
    threshold: float = WASSERSTEIN_THRESHOLD,
    rows_per_block: int = ROWS_PER_BLOCK,
    significance: float = SIGNIFICANCE,
    n_perm: int = PERMUTATIONS,
    seed: int = 42,
) -> DataFrame:
    """W1, p-value and verdict of every window of new rows against the whole reference.

    The p-value compares a window with ``n_perm`` windows of its length drawn from the pooled
    rows of its feature; all windows of one length share them, so the work is linear in the rows.
    """
    scan = ecdf_scan(df, rows_per_block)
    step = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0)) * F.try_divide("cum_ref", "n_ref")
    area = running_sums(scan.withColumn("piece", step), ["feature"], ["value"], {"A_next": F.col("piece")}, rows_per_block=rows_per_block)
    area = materialise(
        area.withColumn("A", F.col("A_next") - F.col("piece")).select("feature", "value", "A", "c_ref", "cum_ref", "n_ref")
    )
    windows = materialise(
        window_rows(side(df, "new"), size, size // 2, min_rows, rows_per_block).select("feature", "window_id", "n_window", "value", "seq")
    )
    lengths = windows.select("feature", "n_window").distinct()
    drawn = _null_windows(df, lengths, n_perm, seed, rows_per_block)
    stat = materialise(_window_distances(area, windows.unionByName(drawn)))
    null = stat.where("window_id < 0").groupBy("feature", "n_window").agg(F.collect_list("w1").alias("null"))
    above = F.size(F.filter("null", lambda p: F.bround(p, 9) >= F.bround(F.col("w1"), 9)))
    # A feature without reference rows has no distance; its windows stay and say so.
    every = windows.select("feature", "n_window", "window_id").distinct().join(stat, ["feature", "n_window", "window_id"], "left")
    p_value = F.when(F.col("w1").isNotNull(), (above + 1) / (F.size("null") + 1))
    tested = every.join(null, ["feature", "n_window"], "left").withColumn("p_value", p_value)
    drift = F.coalesce((F.col("w1") >= threshold) & (F.col("p_value") < significance), F.lit(False))
    status = F.when(F.col("w1").isNull(), "insufficient").when(drift, "drift").when(F.col("w1") >= threshold * 0.5, "warning").otherwise("none")
    return tested.select("feature", "window_id", F.col("n_window").alias("n_rows"), "w1", "p_value", drift.alias("drift_detected"), status.alias("status"))


SEVERITY_BY_RATIO = [(2.0, "critical"), (1.5, "high"), (1.0, "medium")]


def ensemble_verdict(cusum_stats: DataFrame, verdict: DataFrame) -> DataFrame:
    """OR of both detectors; severity from the larger ratio to its threshold."""
    both = cusum_stats.select("feature", "n_drift_points", "max_statistic", "last_statistic").join(
        verdict.select("feature", "w1", "p_value", F.col("drift_detected").alias("w_drift")), "feature", "full"
    )
    # A feature that one detector could not judge counts as not drifted there.
    both = both.withColumn("w_drift", F.coalesce("w_drift", F.lit(False)))
    c_drift = F.coalesce(F.col("n_drift_points") > 0, F.lit(False))
    drift = c_drift | F.col("w_drift")
    magnitude = F.greatest(F.col("last_statistic") / CUSUM_THRESHOLD, F.col("w1") / WASSERSTEIN_THRESHOLD)
    used = F.concat_ws(", ", F.when(c_drift, "CUSUM"), F.when(F.col("w_drift"), "Wasserstein"))
    return both.select(
        "feature",
        c_drift.alias("cusum_drift"),
        F.col("w_drift").alias("wasserstein_drift"),
        drift.alias("drift_detected"),
        "last_statistic",
        "max_statistic",
        "w1",
        "p_value",
        F.when(drift, ladder_label(magnitude, SEVERITY_BY_RATIO, "low")).otherwise("none").alias("severity"),
        F.concat(F.lit("Drift detected by: "), F.when(used == "", "none").otherwise(used)).alias("details"),
    )


def ensemble(df: DataFrame, n_perm: int = PERMUTATIONS) -> DataFrame:
    return ensemble_verdict(cusum_summary(cusum(df)), wasserstein_verdict(permutation_test(df, n_perm)))


def feature_scores(verdict: DataFrame) -> DataFrame:
    return verdict.select(
        "feature", F.col("w1").alias("route_score"), F.greatest("last_statistic", "w1").alias("pipeline_score")
    )


SEVERITY_RANK = ["none", "low", "medium", "high", "critical"]


def monitor_report(verdict: DataFrame) -> DataFrame:
    """One row for the run: drifted share, overall severity, recommendations."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY_RANK]), F.col("severity"))
    one = verdict.agg(
        F.count("*").alias("n_features"),
        count_if(F.col("drift_detected")).alias("n_drifted"),
        F.max_by("severity", rank).alias("overall_severity"),
    )
    sev, share = F.col("overall_severity"), ratio(F.col("n_drifted"), F.col("n_features"))
    text = F.concat_ws(
        " | ",
        F.when(sev == "none", "No significant drift detected. Continue regular monitoring."),
        F.when(sev.isin("critical", "high"), "CRITICAL/HIGH drift detected. Immediate model retraining is recommended."),
        F.when(sev.isin("critical", "high"), "Investigate upstream data pipeline for distribution changes."),
        F.when(sev.isin("critical", "high"), "Consider rolling back to a previous model version as a safety measure."),
        F.when(sev == "medium", "Moderate drift detected. Schedule model retraining within 24-48 hours."),
        F.when(sev == "medium", "Compare reference data timeframe with current data to identify root cause."),
        F.when(sev == "low", "Minor drift detected. Increase monitoring frequency."),
        F.when(sev == "low", "No immediate action required, but track trend over next monitoring window."),
        F.when(
            (sev != "none") & (share > 0.5),
            F.format_string("Drift detected in %.0f%% of features. This may indicate a systematic data pipeline issue.", share * 100),
        ),
    )
    return one.select(
        "n_features", "n_drifted", (F.col("n_drifted") > 0).alias("drift_detected"), "overall_severity", text.alias("recommendations")
    )


def monitor(df: DataFrame, n_perm: int = PERMUTATIONS) -> DataFrame:
    return monitor_report(ensemble(df, n_perm))


def split_halves(df: DataFrame, features: Sequence[str], order_col: str, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """First half of the ordered rows as reference, second as new, unpivoted."""
    numbered = row_index(df.select(F.lit(1).alias("__k"), order_col, *features), ["__k"], [order_col], "rn", rows_per_block=rows_per_block)
    total = df.count()
    label = F.when(F.col("rn") <= total // 2, "ref").otherwise("new")
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return numbered.select(F.col("rn").alias("seq"), label.alias("side"), F.inline(entries)).select("feature", "seq", "side", "value")
