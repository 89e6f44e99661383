"""Drift operators over the event stream table."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairspark.operators import alerts as al
from fairspark.operators import drift as dr
from fairspark.plans import views


def _r(df, *cols, digits=6):
    return df.select(*[F.bround(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def d1(spark, sf):
    return _r(dr.reference_fit(views.drift_long(spark, sf)), "mu", "sd")


def _scan(spark, sf):
    return dr.cusum(views.drift_long(spark, sf, shifted=True))


def d2(spark, sf):
    return _r(_r(_scan(spark, sf), "g_pos", "g_neg", "statistic"), "mean_estimate", digits=4)


def d3(spark, sf):
    return _r(dr.cusum_summary(_scan(spark, sf)), "drift_ratio", "max_statistic", "last_statistic")


def d4(spark, sf):
    out = dr.distances(views.drift_long(spark, sf, shifted=True))
    return _r(out, "w1").select("feature", "n_ref", "n_new", "w1")


def d5(spark, sf):
    return _r(dr.wasserstein_equal(views.numeric_matrix(spark, sf), "extendedprice", "charge"), "w1", digits=4)


def _test(spark, sf):
    return dr.permutation_test(views.drift_long(spark, sf))


def d6(spark, sf):
    out = dr.permutation_rows(_test(spark, sf))
    return _r(out.withColumn("perm", F.col("perm").cast("bigint")), "w1", "perm_w1")


def d7(spark, sf):
    return _r(dr.wasserstein_verdict(_test(spark, sf)), "w1", "p_value")


def d8(spark, sf):
    return _r(dr.sliding_wasserstein(views.drift_long(spark, sf, shifted=True)), "w1", "p_value")


def d9(spark, sf):
    out = dr.distances(views.drift_long(spark, sf, shifted=True))
    return _r(out, "ks_statistic", "ks_p").select("feature", "ks_statistic", "ks_p")


def d9_exact(spark, sf):
    """Daily means before and after the split: few values, so the exact tail."""
    events = views.table(spark, sf, "events").where("value IS NOT NULL")
    daily = events.groupBy(F.col("event_type").alias("feature"), F.dayofmonth("ts").alias("day")).agg(F.bround(F.avg("value"), 6).alias("value"))
    side = F.when(F.col("day") < 16, "ref").otherwise("new")
    out = dr.ks_test(daily.select("feature", F.col("day").cast("bigint").alias("seq"), side.alias("side"), "value"))
    return _r(out, "ks_statistic", "p_value")


def d10(spark, sf):
    return _r(dr.jensen_shannon(views.drift_long(spark, sf, shifted=True)), "jsd")


def d11(spark, sf):
    return _r(dr.population_stability(views.drift_long(spark, sf, shifted=True)), "psi")


def d12(spark, sf):
    return dr.compare_distributions(views.drift_long(spark, sf, shifted=True))


def d13(spark, sf):
    return _r(dr.divergence_and_entropy(views.drift_long(spark, sf, shifted=True)), "kl", "entropy")


def _verdict(spark, sf):
    return dr.ensemble(views.drift_long(spark, sf, shifted=True))


def d14(spark, sf):
    return _r(_verdict(spark, sf), "last_statistic", "max_statistic", "w1", "p_value")


def d15(spark, sf):
    return _r(dr.feature_scores(_verdict(spark, sf)), "route_score", "pipeline_score")


def d16(spark, sf):
    return dr.monitor(views.drift_long(spark, sf, shifted=True))


def _alerts(spark, sf):
    return al.create_alerts(views.drift_records(spark, sf), "day", "statistic")


def _events(spark, sf):
    """An alert is resolved when the feature has no drift on the next day, and
    acknowledged when it was high or critical."""
    records = views.drift_records(spark, sf)
    calm = records.where("NOT drift_detected").select("feature", (F.col("day") - 1).alias("day"))
    alerts = _alerts(spark, sf)
    resolved = alerts.join(calm, ["feature", "day"]).select("alert_id", F.lit("resolved").alias("status"))
    seen = alerts.where("severity IN ('high', 'critical')").select("alert_id", F.lit("acknowledged").alias("status"))
    return resolved.unionByName(seen)


def d17(spark, sf):
    return _alerts(spark, sf)


def d18_active(spark, sf):
    return al.active_alerts(_alerts(spark, sf), _events(spark, sf)).select("alert_id", "feature", "day", "severity", "acknowledged")


def d18_counts(spark, sf):
    return al.severity_counts(_alerts(spark, sf), al.ALERT_LEVELS)


def d18_latest(spark, sf):
    return al.latest(_alerts(spark, sf), "day").select("alert_id", "day", "feature", "severity")


def d19(spark, sf):
    return al.alert_summary(_alerts(spark, sf))


def d20(spark, sf):
    return al.query_records(views.drift_records(spark, sf), drifted=True, limit=10)


def d21(spark, sf):
    return al.record_totals(views.drift_records(spark, sf))


def d22(spark, sf):
    return al.feature_summary(views.drift_records(spark, sf))


def d23(spark, sf):
    records = views.drift_records(spark, sf).drop("severity")
    return records.select("record_id", al.record_severity(F.col("statistic"), F.col("drift_detected")).alias("severity"))


def d24(spark, sf):
    orders = views.table(spark, sf, "orders")
    halves = dr.split_halves(orders, ["o_totalprice", "o_custkey"], "o_orderkey")
    return _r(dr.distances(halves), "w1", "ks_statistic", "ks_p")


QUERIES = {
    "d1_reference_fit": d1,
    "d2_cusum": d2,
    "d3_cusum_summary": d3,
    "d4_wasserstein": d4,
    "d5_wasserstein_equal": d5,
    "d6_permutation_test": d6,
    "d7_wasserstein_verdict": d7,
    "d8_sliding_wasserstein": d8,
    "d9_kolmogorov_smirnov": d9,
    "d9_exact_test": d9_exact,
    "d10_jensen_shannon": d10,
    "d11_population_stability": d11,
    "d12_compare_report": d12,
    "d13_divergence_entropy": d13,
    "d14_ensemble_verdict": d14,
    "d15_feature_scores": d15,
    "d16_drift_monitor": d16,
    "d17_create_alerts": d17,
    "d18_active_alerts": d18_active,
    "d18_severity_counts": d18_counts,
    "d18_latest_alerts": d18_latest,
    "d19_alert_summary": d19,
    "d20_record_query": d20,
    "d21_severity_summary": d21,
    "d22_feature_summary": d22,
    "d23_severity_inference": d23,
    "d24_half_split": d24,
}
