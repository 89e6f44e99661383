"""Fairness operators over the warehouse tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairspark.operators import fairness as fair
from fairspark.plans import audit, views
from fairspark.session import materialise

A = views.ATTRIBUTES


def _cells(spark, sf, attributes=A, score="y_pred"):
    """The long cell table, written once; every metric reads it instead of the decisions."""
    return materialise(fair.long_cells(fair.cell_sums(views.decisions(spark, sf), attributes, score), attributes))


def _results(spark, sf):
    return fair.default_suite().compute_all(_cells(spark, sf), written=True)


def f1(spark, sf):
    return fair.demographic_parity(_cells(spark, sf, ["c_mktsegment"]))


def f2(spark, sf):
    return fair.equalized_odds(_cells(spark, sf, ["o_orderpriority"]))


def f3(spark, sf):
    return fair.calibration(_cells(spark, sf, ["c_mktsegment"], "y_prob"))


def f4(spark, sf):
    return fair.expected_calibration_error(views.decisions(spark, sf))


def f5(spark, sf):
    out = fair.raw_differences(_cells(spark, sf))
    return out.select("attribute", *[F.bround(c, 9).alias(c) for c in ("dp_difference", "eo_difference")])


def f6(spark, sf):
    return fair.parity_ratio(_cells(spark, sf))


def f7(spark, sf):
    cells = _cells(spark, sf, score="y_prob")
    keep = ["attribute", "metric", "grp", "group_value", "gap", "is_fair"]
    odds = fair.equalized_odds(cells).withColumn("group_value", F.greatest("fpr", "fnr"))
    parts = [fair.demographic_parity(cells), odds, fair.calibration(cells)]
    return parts[0].select(keep).unionByName(parts[1].select(keep)).unionByName(parts[2].select(keep))


def f8(spark, sf):
    return _results(spark, sf).select("attribute", "metric", "n_groups", "overall_value", "gap", "is_fair")


def f9(spark, sf):
    return fair.subgroup_metrics(views.decisions(spark, sf), "c_mktsegment").drop("subgroup_column", "subgroup_value")


def f10(spark, sf):
    df = views.labels_documents(spark, sf)
    return fair.subgroup_metrics(df, "lang", ["source"])


def f11(spark, sf):
    return fair.intersectional(views.labels_documents(spark, sf), ["lang", "source"])


def f11_cube(spark, sf):
    return fair.intersectional_cube(views.decisions(spark, sf), A)


def f12(spark, sf):
    groups = fair.intersectional(views.decisions(spark, sf), A)
    return fair.most_biased_subgroup(groups, "positive_rate", "subgroup")


def f13(spark, sf):
    return fair.bias_report(fair.default_suite().compute_all(_cells_small(spark, sf)))


def _cells_small(spark, sf):
    attrs = ["lang", "source"]
    return fair.long_cells(fair.cell_sums(views.labels_documents(spark, sf), attrs), attrs)


def f13_summary(spark, sf):
    return fair.report_summary(f13(spark, sf))


def f14(spark, sf):
    return audit.full_audit(views.decisions(spark, sf), A)


def f16(spark, sf):
    return fair.confusion_metrics(views.decisions(spark, sf))


def f17_auc(spark, sf):
    return fair.auc_scores(fair.roc_points(views.decisions_order(spark, sf)))


def f17_curve(spark, sf):
    return fair.roc_curve(fair.roc_points(views.decisions_order(spark, sf)))


def f18(spark, sf):
    return fair.metric_health(_results(spark, sf))


QUERIES = {
    "f1_demographic_parity": f1,
    "f2_equalized_odds": f2,
    "f3_calibration": f3,
    "f4_expected_calibration_error": f4,
    "f5_raw_differences": f5,
    "f6_parity_ratio": f6,
    "f7_all_attributes": f7,
    "f8_metric_suite": f8,
    "f9_subgroup_metrics": f9,
    "f10_subgroup_by_column": f10,
    "f11_intersectional": f11,
    "f11_intersectional_cube": f11_cube,
    "f12_most_biased_subgroup": f12,
    "f13_bias_report": f13,
    "f13_bias_report_summary": f13_summary,
    "f14_full_audit": f14,
    "f16_confusion_metrics": f16,
    "f17_auc": f17_auc,
    "f17_roc_curve": f17_curve,
    "f18_metric_health": f18,
}
