"""Group fairness metrics as one fused aggregate plus small finishing steps.

The raw decisions are read once. ``cell_sums`` reduces them to additive counts per
combination of attribute values and score bin (partial aggregation runs before
the shuffle, so a dominant group costs one row per task); every metric below is a
projection of that small table.

A decisions table has ``y_true`` and ``y_pred`` doubles, optionally a score column,
and any number of attribute columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairspark.functions.numeric import bin_by_edges, count_if, ladder_label, r6, ratio, uniform_edges
from fairspark.functions.ordering import attach_row, running_sums
from fairspark.session import materialise

MIN_SUBGROUP = 5
MIN_CALIBRATION_GROUP = 10
DEFAULT_THRESHOLD = 0.1
RATIO_THRESHOLD = 0.8

COUNTS = ["n", "sum_pred", "sum_true", "tp", "fp", "fn", "tn", "correct"]


def usable(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def count_dropped(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows the metrics skip because a label, prediction or group is null."""
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    return df.agg(F.count("*").alias("n_rows"), count_if(~complete).alias("n_dropped"))


def confusion_aggs() -> list[Column]:
    t, p = F.col("y_true"), F.col("y_pred")
    return [
        F.count("*").alias("n"),
        F.sum(p).alias("sum_pred"),
        F.sum(t).alias("sum_true"),
        count_if((p == 1) & (t == 1)).alias("tp"),
        count_if((p == 1) & (t == 0)).alias("fp"),
        count_if((p == 0) & (t == 1)).alias("fn"),
        count_if((p == 0) & (t == 0)).alias("tn"),
        count_if(p == t).alias("correct"),
    ]


def cell_sums(
    df: DataFrame,
    attributes: Sequence[str],
    score_col: str = "y_pred",
    n_bins: int = 10,
    close_last_bin: bool = False,
) -> DataFrame:
    """Counts per (attribute values..., score bin); the only step that touches raw rows.

    The metrics read this table several times: write it once (``materialise``) first.
    """
    binned = usable(df, ["y_true", "y_pred"]).withColumn(
        "bin", bin_by_edges(F.col(score_col), uniform_edges(n_bins), close_last_bin)
    )
    named = [F.col(a).cast("string").alias(a) for a in attributes]
    return binned.groupBy(*named, "bin").agg(*confusion_aggs(), F.sum(score_col).alias("sum_score"))


def long_cells(cells: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Marginal counts ``(attribute, grp, bin)`` from the combined cells."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("grp")) for a in attributes])
    )
    sums = [*COUNTS, "sum_score"]
    return (
        cells.select(pairs.alias("k"), "bin", *sums)
        .where(F.col("k.grp").isNotNull())
        .groupBy("k.attribute", "k.grp", "bin")
        .agg(*[F.sum(c).alias(c) for c in sums])
    )


def group_sums(cells: DataFrame) -> DataFrame:
    """Counts per (attribute, grp)."""
    return cells.groupBy("attribute", "grp").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _with_stats(groups: DataFrame, spreads: Sequence[str], **extra: Column) -> DataFrame:
    """Add ``spread_<column>`` (max - min, 0 below two groups) and other aggregates per attribute.

    An attribute may have very many groups, so this aggregates and joins back instead of
    running a window over all groups of an attribute; the joined side has one row per
    audited attribute, which is a list given by the caller.
    """
    spread = lambda c: F.when(F.count(c) >= 2, F.max(c) - F.min(c)).otherwise(F.lit(0.0))
    stats = groups.groupBy("attribute").agg(
        *[spread(c).alias(f"spread_{c}") for c in spreads], *[e.alias(n) for n, e in extra.items()]
    )
    return groups.join(F.broadcast(stats), "attribute")


def demographic_parity(cells: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Positive rate per group, gap between the rounded extremes, verdict."""
    rates = group_sums(cells).select("attribute", "grp", "n", "sum_pred", r6(F.col("sum_pred") / F.col("n")).alias("group_value"))
    joined = _with_stats(rates, ["group_value"], overall_value=r6(F.sum("sum_pred") / F.sum("n")))
    gap = F.col("spread_group_value")
    return joined.select(
        "attribute",
        F.lit("demographic_parity").alias("metric"),
        "grp",
        "group_value",
        "overall_value",
        r6(gap).alias("gap"),
        F.lit(float(threshold)).alias("threshold"),
        (gap <= threshold).alias("is_fair"),
    )


def equalized_odds(cells: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Error rates per group; the gap is the larger of the FPR and FNR gaps."""
    pos, neg = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    rates = group_sums(cells).select(
        "attribute",
        "grp",
        r6(ratio(F.col("tp"), pos)).alias("tpr"),
        r6(ratio(F.col("fp"), neg)).alias("fpr"),
        r6(ratio(F.col("fn"), pos)).alias("fnr"),
        r6(ratio(F.col("tn"), neg)).alias("tnr"),
    )
    gap = F.greatest("spread_fpr", "spread_fnr")
    return _with_stats(rates, ["fpr", "fnr"]).select(
        "attribute",
        F.lit("equalized_odds").alias("metric"),
        "grp",
        "tpr",
        "fpr",
        "fnr",
        "tnr",
        r6(F.col("spread_fpr")).alias("fpr_gap"),
        r6(F.col("spread_fnr")).alias("fnr_gap"),
        r6(gap).alias("gap"),
        F.lit(float(threshold)).alias("threshold"),
        (gap <= threshold).alias("is_fair"),
    )


def calibration(cells: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Unweighted mean over non-empty bins of abs(mean score - mean label) per group.

    Groups under ten rows score 0.0 and still enter the gap. Scores outside every
    bin (exactly 1.0 unless the last bin is closed) count for the group size only.
    """
    error = F.abs(F.col("sum_score") / F.col("n") - F.col("sum_true") / F.col("n"))
    groups = cells.groupBy("attribute", "grp").agg(
        F.sum("n").alias("n"), F.avg(F.when(F.col("bin").isNotNull(), error)).alias("err")
    )
    value = F.when(F.col("n") < MIN_CALIBRATION_GROUP, F.lit(0.0)).otherwise(r6(F.coalesce("err", F.lit(0.0))))
    values = groups.select("attribute", "grp", value.alias("group_value"))
    gap = F.col("spread_group_value")
    return _with_stats(values, ["group_value"], overall_value=r6(F.avg("group_value"))).select(
        "attribute",
        F.lit("calibration").alias("metric"),
        "grp",
        "group_value",
        "overall_value",
        r6(gap).alias("gap"),
        F.lit(float(threshold)).alias("threshold"),
        (gap <= threshold).alias("is_fair"),
    )


def expected_calibration_error(df: DataFrame, score_col: str = "y_prob", n_bins: int = 10) -> DataFrame:
    """Count-weighted calibration error over closed bins, one row."""
    cells = cell_sums(df, [], score_col, n_bins, close_last_bin=True)
    error = F.abs(F.col("sum_true") / F.col("n") - F.col("sum_score") / F.col("n"))
    total = cells.agg(F.sum("n").alias("total"))
    weighted = F.sum(F.when(F.col("bin").isNotNull(), F.col("n") / F.col("total") * error))
    return attach_row(cells, total).agg(F.max("total").alias("n_rows"), r6(weighted).alias("ece"))


def raw_differences(cells: DataFrame) -> DataFrame:
    """Unrounded parity and odds differences per attribute; empty denominators count as 1."""
    pos = F.greatest(F.col("fn") + F.col("tp"), F.lit(1))
    neg = F.greatest(F.col("fp") + F.col("tn"), F.lit(1))
    rates = group_sums(cells).select(
        "attribute", (F.col("sum_pred") / F.col("n")).alias("rate"), (F.col("fp") / neg).alias("fpr"), (F.col("fn") / pos).alias("fnr")
    )
    return rates.groupBy("attribute").agg(
        (F.max("rate") - F.min("rate")).alias("dp_difference"),
        F.greatest(F.max("fpr") - F.min("fpr"), F.max("fnr") - F.min("fnr")).alias("eo_difference"),
    )


def parity_ratio(cells: DataFrame, threshold: float = RATIO_THRESHOLD) -> DataFrame:
    """Lowest over highest positive rate per attribute (ideal 1)."""
    rates = group_sums(cells).select("attribute", (F.col("sum_pred") / F.col("n")).alias("rate"))
    value = ratio(F.min("rate"), F.max("rate"))
    return rates.groupBy("attribute").agg(r6(value).alias("dp_ratio")).withColumn("is_fair", F.col("dp_ratio") >= threshold)


def metric_summary(per_group: DataFrame, overall: str) -> DataFrame:
    """One row per (attribute, metric) from a per-group metric table."""
    return per_group.groupBy("attribute", "metric").agg(
        F.count("*").alias("n_groups"),
        F.max(overall).alias("overall_value"),
        F.max("gap").alias("gap"),
        F.max("threshold").alias("threshold"),
        F.bool_and("is_fair").alias("is_fair"),
    )


@dataclass
class MetricSuite:
    """Named metrics over the long cell table; each maps cells to summary rows.

    A user-defined metric is any callable ``cells -> DataFrame`` with the summary
    columns. ``compute_all`` writes the few rows of all metrics at once. If one fails,
    while it is planned or while it runs, each is written on its own, and the faulty one
    is a row with its error instead of stopping the others.
    """

    metrics: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def register(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> MetricSuite:
        self.metrics[name] = fn
        return self

    def get(self, name: str) -> Callable[[DataFrame], DataFrame]:
        if name not in self.metrics:
            raise KeyError(f"unknown metric {name!r}; registered: {sorted(self.metrics)}")
        return self.metrics[name]

    def compute_all(self, cells: DataFrame, written: bool = False) -> DataFrame:
        # Each metric prunes the cells differently, so without this every metric would
        # scan the decisions again. The cell table is tiny; writing it once is cheap.
        cells = cells if written else materialise(cells)

        def planned(name: str, run: bool) -> DataFrame:
            try:
                out = self.metrics[name](cells).withColumn("error", F.lit(None).cast("string"))
                return materialise(out) if run else out
            except Exception as exc:  # a faulty metric must not hide the others
                text = str(exc).split("\n")[0]
                return cells.limit(1).select(
                    F.lit(None).cast("string").alias("attribute"), F.lit(name).alias("metric"), F.lit(text).alias("error")
                )

        def together(run: bool) -> DataFrame:
            return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [planned(name, run) for name in self.metrics])

        try:
            return materialise(together(run=False))
        except Exception:  # some metric fails at run time: each one by itself tells which
            return together(run=True)


def default_suite() -> MetricSuite:
    suite = MetricSuite()
    suite.register("demographic_parity", lambda c: metric_summary(demographic_parity(c), "overall_value"))
    suite.register("equalized_odds", lambda c: metric_summary(equalized_odds(c), "gap"))
    suite.register("calibration", lambda c: metric_summary(calibration(c), "overall_value"))
    return suite


def subgroup_metrics(df: DataFrame, group_col: str, columns: Sequence[str] = ()) -> DataFrame:
    """Count, share, accuracy, selection rate and FPR per group, and per group x column
    value when that cell has at least five rows. All levels come from one aggregate."""
    clean = usable(df, ["y_true", "y_pred", group_col])
    cells = clean.groupBy(group_col, *columns).agg(*confusion_aggs())
    levels = [F.struct(F.lit(None).cast("string").alias("col"), F.lit(None).cast("string").alias("val"))]
    levels += [F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("val")) for c in columns]
    grouped = (
        cells.select(F.col(group_col).cast("string").alias("grp"), F.explode(F.array(*levels)).alias("lv"), *COUNTS)
        .where(F.col("lv.col").isNull() | F.col("lv.val").isNotNull())
        .groupBy("grp", F.col("lv.col").alias("subgroup_column"), F.col("lv.val").alias("subgroup_value"))
        .agg(*[F.sum(c).alias(c) for c in COUNTS])
    )
    total = grouped.where(F.col("subgroup_column").isNull()).agg(F.sum("n").alias("total"))
    top = F.col("subgroup_column").isNull()
    return (
        attach_row(grouped, total)
        .where(top | (F.col("n") >= MIN_SUBGROUP))
        .select(
            "grp",
            "subgroup_column",
            "subgroup_value",
            F.col("n").alias("cnt"),
            F.when(top, r6(F.col("n") / F.col("total"))).alias("proportion"),
            r6(F.col("correct") / F.col("n")).alias("accuracy"),
            r6(F.col("sum_pred") / F.col("n")).alias("selection_rate"),
            F.when(top, r6(ratio(F.col("fp"), F.col("fp") + F.col("tn")))).alias("false_positive_rate"),
        )
    )


def subgroup_label(attributes: Sequence[str]) -> Column:
    parts = [F.concat(F.lit(f"{a}_"), F.col(a).cast("string")) for a in attributes]
    return F.concat_ws("_", *parts)


def intersectional(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """All observed combinations of the attributes against the rest of the rows.

    The rest of a subgroup is the total minus the subgroup, so no subgroup rescans
    the data. Subgroups under five rows are kept as skipped rows with a reason.
    """
    return intersectional_from_cells(cell_sums(df, attributes), attributes)


def intersectional_from_cells(cells: DataFrame, attributes: Sequence[str]) -> DataFrame:
    groups = usable(cells, attributes).groupBy(*attributes).agg(*[F.sum(c).alias(c) for c in COUNTS])
    total = groups.agg(*[F.sum(c).alias(f"all_{c}") for c in COUNTS])
    rest = {c: F.col(f"all_{c}") - F.col(c) for c in COUNTS}
    small = F.col("n") < MIN_SUBGROUP
    keep = lambda col: F.when(~small, col)

    def error_gap(bad: str, other: str) -> Column:
        inside = r6(ratio(F.col(bad), F.col(bad) + F.col(other)))
        outside = r6(ratio(rest[bad], rest[bad] + rest[other]))
        return F.abs(inside - outside)

    only = rest["n"] == 0
    dp_gap = F.when(only, F.lit(0.0)).otherwise(
        F.abs(r6(F.col("sum_pred") / F.col("n")) - r6(ratio(rest["sum_pred"], rest["n"])))
    )
    eo_gap = F.when(only, F.lit(0.0)).otherwise(F.greatest(error_gap("fp", "tn"), error_gap("fn", "tp")))
    return attach_row(groups, total).select(
        subgroup_label(attributes).alias("subgroup"),
        F.col("n").alias("sample_size"),
        small.alias("skipped"),
        F.when(small, F.lit("Too few samples")).alias("reason"),
        keep(r6(F.col("correct") / F.col("n"))).alias("accuracy"),
        keep(r6(F.col("sum_pred") / F.col("n"))).alias("positive_rate"),
        keep(r6(dp_gap)).alias("dp_gap"),
        keep(r6(eo_gap)).alias("eo_gap"),
    )


def intersectional_cube(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Accuracy and positive rate of every sub-combination of the attributes (cube)."""
    cells = usable(cell_sums(df, attributes), attributes)
    return (
        cells.cube(*attributes)
        .agg(*[F.sum(c).alias(c) for c in ("n", "correct", "sum_pred")])
        .select(
            *attributes,
            F.col("n").alias("sample_size"),
            r6(F.col("correct") / F.col("n")).alias("accuracy"),
            r6(F.col("sum_pred") / F.col("n")).alias("positive_rate"),
        )
    )


def most_biased_subgroup(groups: DataFrame, metric: str, name_col: str) -> DataFrame:
    """Largest spread of a metric and the groups at both ends (ties by name)."""
    have = groups.where(F.col(metric).isNotNull())
    high = F.min_by(name_col, F.struct(-F.col(metric), F.col(name_col)))
    low = F.min_by(name_col, F.struct(F.col(metric), F.col(name_col)))
    return have.agg(
        F.lit(metric).alias("metric"),
        r6(F.max(metric) - F.min(metric)).alias("max_gap"),
        high.alias("highest_group"),
        low.alias("lowest_group"),
    )


SEVERITY = [(0.3, "CRITICAL"), (0.1, "MODERATE")]


def bias_report(results: DataFrame) -> DataFrame:
    """One row per attribute: findings, worst metric, severity and advice."""
    unfair = ~F.col("is_fair")
    gap = F.when(unfair, F.col("gap"))
    per_attr = results.groupBy("attribute").agg(
        count_if(unfair).alias("n_findings"),
        F.max(gap).alias("worst_gap"),
        F.min_by(F.when(unfair, F.col("metric")), F.struct(F.coalesce(-gap, F.lit(1.0)), F.col("metric"))).alias("worst_metric"),
        F.coalesce(F.bool_or(unfair & (F.col("metric") == "equalized_odds")), F.lit(False)).alias("odds_violated"),
    )
    severity = ladder_label(F.col("worst_gap"), SEVERITY, "MILD", strict=True)
    shown = F.format_string("%.1f%%", F.col("worst_gap") * 100)
    name = F.col("attribute")
    advice = (
        F.when(
            severity == "CRITICAL",
            F.concat(F.lit("CRITICAL: '"), name, F.lit("' shows severe bias (gap="), shown,
                     F.lit("). Consider removing or carefully re-encoding this attribute.")),
        )
        .when(
            severity == "MODERATE",
            F.concat(F.lit("MODERATE: '"), name, F.lit("' shows notable bias (gap="), shown,
                     F.lit("). Consider reweighting or adversarial debiasing.")),
        )
        .otherwise(
            F.concat(F.lit("MILD: '"), name, F.lit("' shows slight bias (gap="), shown,
                     F.lit("). Monitor and consider pre-processing adjustments."))
        )
    )
    biased = F.col("n_findings") > 0
    return per_attr.select(
        "attribute",
        biased.alias("is_biased"),
        "n_findings",
        F.coalesce("worst_gap", F.lit(0.0)).alias("worst_gap"),
        F.when(biased, F.col("worst_metric")).alias("worst_metric"),
        F.when(biased, severity).otherwise("NONE").alias("severity"),
        F.when(biased, advice).otherwise(F.lit("No significant bias detected. Continue monitoring.")).alias("recommendation"),
        "odds_violated",
    )


def report_summary(report: DataFrame) -> DataFrame:
    """Totals of a bias report, one row."""
    worst_key = F.struct(-F.col("worst_gap"), F.col("attribute"))
    full_name = F.concat_ws("/", "attribute", "worst_metric")
    return report.agg(
        F.count("*").alias("total_attributes"),
        count_if(F.col("is_biased")).alias("biased_attributes"),
        count_if(~F.col("is_biased")).alias("fair_attributes"),
        (count_if(F.col("is_biased")) == 0).alias("overall_fair"),
        F.max("worst_gap").alias("worst_gap"),
        F.min_by(F.when(F.col("is_biased"), full_name), worst_key).alias("worst_metric"),
        F.when(
            F.bool_or("odds_violated"),
            F.lit("Equalized odds violations detected. Consider running the threshold sweep to optimize fairness constraints."),
        ).alias("odds_advice"),
    )


def confusion_metrics(df: DataFrame) -> DataFrame:
    """Confusion matrix, accuracy, precision, recall and F1 as one row."""
    sums = usable(df, ["y_true", "y_pred"]).agg(*confusion_aggs())
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(
        "tp", "fp", "fn", "tn",
        r6(ratio(F.col("correct"), F.col("n"))).alias("accuracy"),
        r6(precision).alias("precision"),
        r6(recall).alias("recall"),
        r6(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"),
    )


def roc_points(df: DataFrame, score_col: str = "y_prob", rows_per_block: int = 200_000) -> DataFrame:
    """Cumulative positives and negatives per distinct score, highest score first."""
    scored = usable(df, ["y_true", score_col]).groupBy(F.col(score_col).alias("score")).agg(
        F.sum("y_true").alias("pos"), F.sum(1 - F.col("y_true")).alias("neg")
    )
    keyed = scored.select(F.lit(1).alias("k"), "score", (-F.col("score")).alias("rank_key"), "pos", "neg")
    return running_sums(keyed, ["k"], ["rank_key"], {"tp": F.col("pos"), "fp": F.col("neg")}, rows_per_block=rows_per_block)


def roc_curve(points: DataFrame) -> DataFrame:
    total = points.agg(F.sum("pos").alias("p_all"), F.sum("neg").alias("n_all"))
    return attach_row(points, total).select(
        F.col("score").alias("threshold"),
        r6(ratio(F.col("fp"), F.col("n_all"))).alias("fpr"),
        r6(ratio(F.col("tp"), F.col("p_all"))).alias("tpr"),
    )


def auc_scores(points: DataFrame) -> DataFrame:
    """ROC AUC and PR AUC by the trapezoid rule; each point carries its own step,
    so the sum needs no neighbour lookup across tasks. Null where a class is missing."""
    total = points.agg(F.sum("pos").alias("p_all"), F.sum("neg").alias("n_all"))
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    precision = tp / (tp + fp)
    before = tp - pos
    earlier = F.when(before + fp - neg > 0, before / (before + fp - neg)).otherwise(F.lit(1.0))
    return attach_row(points, total).agg(
        F.max("p_all").cast("bigint").alias("positives"),
        F.max("n_all").cast("bigint").alias("negatives"),
        r6(F.try_divide(F.sum(neg * (tp + before) / 2), F.max(F.col("p_all") * F.col("n_all")))).alias("roc_auc"),
        r6(F.try_divide(F.sum(pos * (precision + earlier) / 2), F.max("p_all"))).alias("pr_auc"),
    )


HEALTH = [(90.0, "OPTIMAL"), (80.0, "STABLE"), (60.0, "WARNING")]


def metric_health(results: DataFrame) -> DataFrame:
    """Share of passed metrics as a score with its band."""
    counted = results.agg(F.count("*").alias("n_metrics"), count_if(F.col("is_fair")).alias("n_passed"))
    score = ratio(F.col("n_passed"), F.col("n_metrics")) * 100
    return counted.select("n_metrics", "n_passed", r6(score).alias("score"), ladder_label(score, HEALTH, "CRITICAL").alias("band"))
