"""Counterfactual operators over line-item features and embedding pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairspark.operators import counterfactual as cf
from fairspark.plans import views

NAMES = ["quantity", "discount", "tax", "status", "flag"]
MODEL = [1.5, -1.0, -0.5, -0.8, 0.6]
BIAS = 0.1
EMB_MODEL = [1.0 if i % 2 == 0 else -1.0 for i in range(64)]


def _flipped(spark, sf):
    return cf.counterfactual(views.applicants(spark, sf), "features", 3, 0.0)


def k1(spark, sf):
    out = _flipped(spark, sf)
    return out.select("row_id", *[F.col("counterfactual")[i].alias(n) for i, n in enumerate(NAMES)])


def k1_noise(spark, sf):
    out = cf.counterfactual(views.applicants(spark, sf), "features", 3, 0.0, "row_id", 5, noise=0.02)
    return out.select("row_id", *[F.bround(F.col("counterfactual")[i], 6).alias(n) for i, n in enumerate(NAMES)])


def k2(spark, sf):
    out = cf.counterfactual_variants(views.applicants(spark, sf), "row_id", "features", 5, 3, 0.0)
    return out.select("row_id", "sample", *[F.bround(F.col("counterfactual")[i], 6).alias(n) for i, n in enumerate(NAMES)])


def k3(spark, sf):
    return cf.explain_changes(_flipped(spark, sf), ["row_id"], "features", "counterfactual", NAMES)


def k4(spark, sf):
    scored = cf.score_both(_flipped(spark, sf), "features", "counterfactual", MODEL, BIAS)
    return cf.validation_summary(scored, "features", "counterfactual")


def k4_rows(spark, sf):
    scored = cf.score_both(_flipped(spark, sf), "features", "counterfactual", MODEL, BIAS)
    return scored.select(
        "row_id", F.bround("p_original", 6).alias("p_original"), F.bround("p_counterfactual", 6).alias("p_counterfactual"), "prediction_changed"
    )


def _points(spark, sf, method):
    out = cf.interpolate(views.pairs(spark, sf), "emb_a", "emb_b", 4, method)
    rows = out.select("pair_id", "step", F.posexplode("point").alias("dim", "v"))
    return rows.select("pair_id", "step", "dim", F.bround("v", 6).alias("v"))


def k5(spark, sf):
    return _points(spark, sf, "linear")


def k5_slerp(spark, sf):
    return _points(spark, sf, "slerp")


def k6(spark, sf):
    return cf.decision_boundary(views.pairs(spark, sf), "pair_id", "emb_a", "emb_b", EMB_MODEL, 0.0)


QUERIES = {
    "k1_attribute_flip": k1,
    "k1_attribute_flip_noise": k1_noise,
    "k2_variants": k2,
    "k3_explain_changes": k3,
    "k4_validation": k4,
    "k4_scored_rows": k4_rows,
    "k5_interpolate_linear": k5,
    "k5_interpolate_slerp": k5_slerp,
    "k6_decision_boundary": k6,
}
