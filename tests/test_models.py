"""Trained models against Newton's method and counting in NumPy."""

import numpy as np
import pandas as pd
import pytest

from fairspark.operators import models

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 3)) * [1.0, 5.0, 0.2] + [0.0, 3.0, 1.0]
    z = 1.4 * x[:, 0] - 0.3 * (x[:, 1] - 3) + rng.logistic(size=600)
    pdf = pd.DataFrame(x, columns=FEATURES)
    pdf["y_true"] = (z > 0).astype(float)
    pdf["row_id"] = np.arange(600)
    return pdf


def newton(x, y, steps=30):
    """Weights and bias that minimise the summed log loss plus half the squared weights."""
    design = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(design.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve(design.T * (p * (1 - p)) @ design + ridge, design.T @ (p - y) + ridge @ w)
    return w


def scaled(pdf):
    x = pdf[FEATURES].to_numpy()
    return (x - x.mean(0)) / x.std(0, ddof=1)


def test_logistic_training_equals_newton(spark, rows):
    df = spark.createDataFrame(rows)
    w = newton(scaled(rows), rows["y_true"].to_numpy())
    model = models.train(df, FEATURES)
    ranked = models.feature_importance(model, df, FEATURES).toPandas().sort_values("importance_rank")
    assert list(ranked["feature"]) == [FEATURES[i] for i in np.argsort(-np.abs(w[:3]))]
    assert np.allclose(ranked.set_index("feature").loc[FEATURES, "importance"], np.abs(w[:3]), atol=2e-3)

    got = models.score(model, df, FEATURES).toPandas().sort_values("row_id")
    want = 1 / (1 + np.exp(-(scaled(rows) @ w[:3] + w[3])))
    assert np.allclose(got["y_prob"], want, atol=2e-3)
    clear = np.abs(want - 0.5) > 2e-3
    assert (got["y_pred"].to_numpy() == (want >= 0.5))[clear].all()


def test_evaluation_of_a_fixed_model_equals_counting(spark, rows):
    scored = models.score_with(models.LinearModel([1.0, -0.2, 0.0], 0.6), spark.createDataFrame(rows), FEATURES, ["row_id", "y_true"])
    pdf = scored.toPandas()
    got = models.evaluate(scored).toPandas().iloc[0]
    up, down = pdf[pdf["y_true"] == 1]["y_prob"].to_numpy(), pdf[pdf["y_true"] == 0]["y_prob"].to_numpy()
    pairs = (up[:, None] > down).mean() + 0.5 * (up[:, None] == down).mean()
    assert got["roc_auc"] == pytest.approx(pairs, abs=1e-5)
    assert got["accuracy"] == pytest.approx((pdf["y_true"] == pdf["y_pred"]).mean(), abs=1e-5)
    parts = models.train_test_accuracy(scored.where("row_id < 100"), scored.where("row_id >= 100")).toPandas().set_index("part")
    for part, rows_of in (("train", pdf[pdf["row_id"] < 100]), ("test", pdf[pdf["row_id"] >= 100])):
        assert parts.loc[part, "n"] == len(rows_of)
        assert parts.loc[part, "accuracy"] == pytest.approx((rows_of["y_true"] == rows_of["y_pred"]).mean(), abs=1e-5)


def test_missing_features_count_as_zero(spark, rows):
    gaps = rows.assign(a=rows["a"].where(rows["row_id"] % 7 > 0))
    model = models.train(spark.createDataFrame(rows), FEATURES)
    blank = models.score(model, spark.createDataFrame(gaps).replace(float("nan"), None), FEATURES).toPandas().sort_values("row_id")
    zero = models.score(model, spark.createDataFrame(gaps.fillna({"a": 0.0})), FEATURES).toPandas().sort_values("row_id")
    assert np.allclose(blank["y_prob"], zero["y_prob"])


def test_training_evaluates_its_input_once(spark, rows):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    df = spark.createDataFrame(rows)
    models.train(df.mapInPandas(count, df.schema), FEATURES)
    assert seen.value == len(rows)


def test_split_is_written_without_ids(spark, rows, monkeypatch):
    from fairspark.plans import audit

    written, plain = [], audit.stored
    monkeypatch.setattr(audit, "stored", lambda df, name: written.append(df.columns) or plain(df, name))
    pdf = rows.assign(g=["x", "y"] * 300, note="not needed")
    out = audit.train_and_audit(spark.createDataFrame(pdf), FEATURES, ["g"], "row_id").collect()
    assert written == [["y_true", *FEATURES, "g", "is_test"]]
    assert [r["n"] for r in out if r["section"] == "accuracy"] == [120]
