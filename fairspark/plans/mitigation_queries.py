"""Mitigation operators over decisions, orders and the daily metric history."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairspark.operators import mitigation as mit
from fairspark.plans import views
from fairspark.plans.views import table

OFFSETS = [-0.5 + i * 0.05 for i in range(21)]
FEATURES = ["f_quantity", "f_discount", "f_tax"]
COEFFICIENTS = [1.2, -0.8, -0.4]
BIAS = -0.1
WEIGHTS = [[a * 0.5, b * 0.5, 1.0] for a in range(5) for b in range(5)]


def _r(df, *cols, digits=6):
    return df.select(*[F.bround(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def m1(spark, sf):
    return mit.evaluate_offsets(views.decisions(spark, sf), "l_linestatus", OFFSETS)


def m2(spark, sf):
    return mit.sweep(m1(spark, sf))


def u6(spark, sf):
    def evaluate(df):
        return mit.evaluate_offsets(df, "grp", [-0.5, -0.25, 0.0, 0.25, 0.5])

    return mit.sweep_with(views.decisions_order(spark, sf), evaluate, max_dp=0.1, max_eo=0.1)


def m3(spark, sf):
    line = table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("double").alias("y_true"), "l_linestatus",
        (F.col("l_quantity") / F.lit(50.0)).alias("f_quantity"), (F.col("l_discount") * F.lit(10.0)).alias("f_discount"),
        (F.col("l_tax") * F.lit(10.0)).alias("f_tax"),
    )
    return mit.evaluate_weights(line, FEATURES, COEFFICIENTS, BIAS, "l_linestatus", WEIGHTS)


def m4(spark, sf):
    return mit.pareto_front(views.history(spark, sf)).drop("front_score")


def m5(spark, sf):
    history = views.history(spark, sf)
    return mit.pareto_multiplier(history, mit.pareto_front(history)).select("run", "step", "multiplier")


def _changes(spark, sf):
    return mit.step_changes(views.history(spark, sf))


def _rewards(spark, sf):
    action = F.array(F.col("accuracy") - F.col("prev_accuracy"), F.col("dp_gap") - F.col("prev_dp_gap"))
    return mit.rewards(_changes(spark, sf), action)


def m6(spark, sf):
    out = _rewards(spark, sf)
    return _r(out, *[c for c in out.columns if c not in ("run", "step")], digits=9)


def m7(spark, sf):
    out = mit.normalised_rewards(_rewards(spark, sf))
    return _r(_r(out, "total_reward", digits=9), "normalised")


def m8(spark, sf):
    return mit.goodhart_guard(_changes(spark, sf))


def m8_reward(spark, sf):
    guard = mit.goodhart_guard(_changes(spark, sf)).select("run", "step", "alert_level")
    joined = _rewards(spark, sf).join(guard, ["run", "step"])
    adjusted = mit.guarded_reward(F.col("total_reward"), F.col("alert_level"))
    return joined.select("run", "step", "alert_level", F.bround(adjusted, 9).alias("adjusted_reward"))


def m9(spark, sf):
    return _r(mit.metric_trend(views.history(spark, sf), "accuracy"), "slope", "mean", "std", digits=9)


def _by_source(spark, sf, early):
    """Metrics of the languages up to ``en`` or of those after it: together all rows."""
    docs = views.labels_documents(spark, sf).where(F.col("lang") <= "en" if early else F.col("lang") > "en")
    rates = docs.groupBy("source").agg(F.avg("y_true").alias("q"), F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("e"))
    return rates.select(
        F.inline(
            F.array(
                F.struct(F.concat("source", F.lit("_quality")).alias("metric"), F.bround("q", 6).alias("value")),
                F.struct(F.concat("source", F.lit("_error")).alias("metric"), F.bround("e", 6).alias("value")),
            )
        )
    )


def m10(spark, sf):
    return mit.compare_metrics(_by_source(spark, sf, True), _by_source(spark, sf, False))


def m10_counts(spark, sf):
    return mit.comparison_counts(m10(spark, sf))


def m11(spark, sf):
    return mit.assess_health(mit.module_summary(views.module_results(spark, sf)))


def m12(spark, sf):
    return mit.module_summary(views.module_results(spark, sf))


def m13(spark, sf):
    return mit.oversample(views.decisions_order(spark, sf).select("row_id", "grp"), "grp", "row_id")


def m13_resample(spark, sf):
    return mit.resample(views.decisions_order(spark, sf).select("row_id", "grp"), "grp", "row_id")


def m14(spark, sf):
    return mit.group_thresholds(views.decisions_order(spark, sf), "grp")


def m15(spark, sf):
    df = views.decisions_order(spark, sf)
    return mit.apply_thresholds(df, mit.group_thresholds(df, "grp"), "grp").select("row_id", "grp", "fair_pred")


def m16(spark, sf):
    return _r(mit.fairness_weights(views.decisions_order(spark, sf), "grp"), "weight")


def m16_rows(spark, sf):
    out = mit.apply_weights(views.decisions_order(spark, sf).select("row_id", "grp"), "grp")
    return out.select("row_id", "grp", F.bround("weight", 6).alias("weight"))


def m17(spark, sf):
    """Unfair metrics and a 0-100 index per document source, as bias reports."""
    docs = views.labels_documents(spark, sf)
    cells = docs.groupBy("source", "lang").agg(
        F.avg("y_pred").alias("rate"), F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("err")
    )
    gaps = cells.groupBy("source").agg(
        F.bround(F.max("rate") - F.min("rate"), 6).alias("dp"), F.bround(F.max("err") - F.min("err"), 6).alias("eo"), F.bround(F.avg("err") * 100, 2).alias("bias_index")
    )
    names = F.array_compact(
        F.array(F.when(F.col("dp") > 0.5, F.lit("demographic_parity")), F.when(F.col("eo") > 0.3, F.lit("equalized_odds")))
    )
    return mit.choose_fix(gaps.select(F.col("source").alias("name"), names.alias("metrics"), "bias_index"))


QUERIES = {
    "m1_evaluate_offsets": m1,
    "m2_threshold_sweep": m2,
    "m3_weight_sweep": m3,
    "m4_pareto_front": m4,
    "m5_pareto_multiplier": m5,
    "m6_rewards": m6,
    "m7_normalised_rewards": m7,
    "m8_goodhart_guard": m8,
    "m8_guarded_reward": m8_reward,
    "m9_metric_trend": m9,
    "m10_compare_metrics": m10,
    "m10_comparison_counts": m10_counts,
    "m11_health": m11,
    "m12_module_summary": m12,
    "m13_oversample": m13,
    "m13_resample": m13_resample,
    "m14_group_thresholds": m14,
    "m15_apply_thresholds": m15,
    "m16_fairness_weights": m16,
    "m16_sample_weights": m16_rows,
    "m17_choose_fix": m17,
    "u6_sweep_callback": u6,
}
