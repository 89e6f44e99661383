import numpy as np
import pandas as pd
import pytest

from fairspark.operators import fairness as fair
from fairspark.plans import audit


def decisions(spark, t, p, g, **more):
    pdf = pd.DataFrame({"y_true": np.asarray(t, float), "y_pred": np.asarray(p, float), "g": [str(x) for x in g], **more})
    return spark.createDataFrame(pdf)


def cells(df, attrs=("g",), score="y_pred", **kw):
    return fair.long_cells(fair.cell_sums(df, list(attrs), score, **kw), list(attrs))


def test_parity_gap_extremes(spark):
    df = decisions(spark, [1] * 8, [1, 1, 1, 1, 1, 0, 0, 0], [0, 0, 0, 0, 0, 1, 1, 1])
    row = fair.demographic_parity(cells(df)).first()
    assert row["gap"] == 1.0 and row["is_fair"] is False
    same = decisions(spark, [1, 0, 1, 0], [1, 0, 1, 0], [0, 0, 1, 1])
    assert fair.demographic_parity(cells(same)).first()["gap"] == 0.0


def test_single_group_has_no_gap(spark):
    df = decisions(spark, [1, 0, 1], [1, 1, 0], [0, 0, 0])
    assert fair.demographic_parity(cells(df)).first()["gap"] == 0.0
    assert fair.equalized_odds(cells(df)).first()["gap"] == 0.0


def test_equalized_odds_rates(spark):
    df = decisions(spark, [1, 1, 0, 0, 1, 1, 0, 0], [1, 0, 1, 0, 1, 1, 0, 0], [0] * 4 + [1] * 4)
    got = {r["grp"]: r for r in fair.equalized_odds(cells(df)).collect()}
    assert (got["0"]["tpr"], got["0"]["fpr"], got["0"]["fnr"]) == (0.5, 0.5, 0.5)
    assert (got["1"]["tpr"], got["1"]["fpr"]) == (1.0, 0.0)
    assert got["0"]["gap"] == 0.5


def test_calibration_small_groups_and_open_last_bin(spark):
    t = [1] * 10 + [1] * 5
    s = [0.95] * 9 + [1.0] + [0.2] * 5
    df = decisions(spark, t, [1.0] * 15, [0] * 10 + [1] * 5, s=s)
    got = {r["grp"]: r["group_value"] for r in fair.calibration(cells(df, score="s")).collect()}
    assert got == {"0": pytest.approx(0.05), "1": 0.0}
    closed = {r["grp"]: r["group_value"] for r in fair.calibration(cells(df, score="s", close_last_bin=True)).collect()}
    assert closed["0"] == pytest.approx(0.045)


def test_bin_edges_use_comparison(spark):
    df = spark.createDataFrame([(0.3,), (0.30000000000000004,), (0.0,), (1.0,), (None,)], "s double")
    from pyspark.sql import functions as F

    from fairspark.functions.numeric import bin_by_edges, uniform_edges

    got = [r[0] for r in df.select(bin_by_edges(F.col("s"), uniform_edges(10))).collect()]
    assert got == [2, 3, 0, None, None]


def test_nulls_are_dropped_and_counted(spark):
    df = spark.createDataFrame([(1.0, 1.0, "a"), (None, 1.0, "a"), (0.0, None, "b"), (1.0, 0.0, None)], "y_true double, y_pred double, g string")
    row = fair.count_dropped(df, ["y_true", "y_pred", "g"]).first()
    assert (row["n_rows"], row["n_dropped"]) == (4, 3)
    assert [r["grp"] for r in fair.demographic_parity(cells(df)).collect()] == ["a"]


def test_subgroups_skip_small_ones(spark):
    df = decisions(spark, [1] * 12, [1] * 12, ["x"] * 9 + ["y"] * 3, h=["p"] * 12)
    got = {r["subgroup"]: r for r in fair.intersectional(df, ["g", "h"]).collect()}
    assert got["g_x_h_p"]["skipped"] is False and got["g_x_h_p"]["accuracy"] == 1.0
    assert got["g_y_h_p"]["skipped"] is True and got["g_y_h_p"]["reason"] == "Too few samples"


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(0)
    t = rng.integers(0, 2, 120)
    s = np.round(rng.random(120), 1)
    df = decisions(spark, t, t, ["a"] * 120, y_prob=s)
    got = fair.auc_scores(fair.roc_points(df, rows_per_block=3)).first()
    pos, neg = s[t == 1], s[t == 0]
    want = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    assert got["roc_auc"] == pytest.approx(want, abs=1e-6)


def test_suite_isolates_a_failing_metric(spark):
    df = decisions(spark, [1, 0, 1, 0], [1, 0, 0, 0], [0, 0, 1, 1])
    suite = fair.default_suite().register("broken", lambda c: c.select("no_such_column"))
    got = suite.compute_all(cells(df)).toPandas()
    assert got["error"].notna().sum() == 1 and len(got) == 4
    with pytest.raises(KeyError):
        suite.get("missing")


def test_full_audit_sections(spark):
    rng = np.random.default_rng(3)
    df = decisions(spark, rng.integers(0, 2, 200), rng.integers(0, 2, 200), rng.integers(0, 2, 200), h=rng.choice(["u", "v"], 200))
    got = audit.full_audit(df, ["g", "h"]).toPandas()
    assert set(got["section"]) == {"metric", "report", "subgroup", "subgroup_accuracy", "accuracy"}
    assert (got["section"] == "metric").sum() == 6
