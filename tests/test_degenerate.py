"""Input that leaves a statistic undefined gives a flagged row, not an error and no false number."""

import pytest
from pyspark.sql import functions as F

from fairspark.functions import special
from fairspark.operators import alerts, causal, drift, fairness, graph, mitigation
from fairspark.streaming import detectors, microbatch


def one_sided(spark):
    rows = [("both", i, "ref" if i < 60 else "new", float(i % 17)) for i in range(120)]
    rows += [("ref_only", i, "ref", float(i)) for i in range(40)] + [("new_only", i, "new", float(i)) for i in range(40)]
    return spark.createDataFrame(rows, "feature string, seq bigint, side string, value double")


def by_feature(df):
    return {r["feature"]: r for r in df.collect()}


def test_one_sided_features_have_no_distance(spark):
    df = one_sided(spark)
    found = by_feature(drift.distances(df))
    assert found["both"]["w1"] is not None and found["ref_only"]["w1"] is None and found["new_only"]["ks_p"] is None
    assert by_feature(drift.jensen_shannon(df))["new_only"]["jsd"] is None
    assert by_feature(drift.divergence_and_entropy(df))["ref_only"]["kl"] is None
    report = by_feature(drift.compare_distributions(df))
    assert not report["ref_only"]["drift_detected"] and report["new_only"]["summary"] == "Insufficient samples for comparison"


def test_one_sided_features_stay_in_the_verdict(spark):
    df = one_sided(spark)
    verdict = by_feature(drift.wasserstein_verdict(drift.permutation_test(df, 20)))
    assert verdict["ref_only"]["status"] == "insufficient" and verdict["ref_only"]["p_value"] is None
    assert set(by_feature(drift.ensemble(df, 20))) == {"both", "ref_only", "new_only"}


def test_more_permutations_than_the_default(spark):
    df = one_sided(spark).where("feature = 'both'")
    assert len(drift.permutation_test(df, 300).first()["permuted"]) == 300


def test_single_class_has_no_auc(spark):
    df = spark.createDataFrame([(1.0, i / 10) for i in range(10)], "y_true double, y_prob double")
    row = fairness.auc_scores(fairness.roc_points(df)).first()
    assert row["roc_auc"] is None and row["positives"] == 10


def test_constant_column_has_no_rank_correlation(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(20)], "x double, y double")
    assert causal.spearman(df, "x", "y").first()["correlation"] is None
    assert causal.kendall(df, "x", "y").first()["correlation"] is None


def test_front_is_whole_unless_asked(spark):
    points = spark.range(400).select(
        (F.col("id") / 1000).alias("accuracy"), (F.col("id") / 1000).alias("dp_gap"), F.lit(0.1).alias("eo_gap"), F.lit(0.1).alias("calibration_error")
    )
    assert mitigation.pareto_front(points).count() == 400
    assert mitigation.pareto_front(points, max_front=7).count() == 7


def test_cycle_behind_a_chain(spark):
    edges = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(12)]
    chain = spark.createDataFrame(edges, "src string, dst string")
    ring = spark.createDataFrame([*edges, ("n12", "n10")], "src string, dst string")
    assert graph.is_acyclic(chain).first()["is_dag"] and not graph.is_acyclic(ring).first()["is_dag"]
    assert graph.reachable(chain, spark.createDataFrame([("n00",)], "node string")).count() == 12


def test_permutations_do_not_depend_on_parts_or_passes(spark):
    df = one_sided(spark)
    whole = by_feature(drift.permutation_test(df, 20, rows_per_block=1_000_000))
    split = by_feature(drift.permutation_test(df.repartition(3), 20, rows_per_block=4, most_cuts=20))
    assert set(whole) == set(split)
    for name, row in whole.items():
        assert (row["w1"] is None) == (split[name]["w1"] is None)
        assert all(abs(a - b) < 1e-9 for a, b in zip(row["permuted"], split[name]["permuted"]))


def test_paired_distance_needs_equal_sizes(spark):
    pairs = spark.createDataFrame([(1.0, 4.0), (5.0, 2.0), (2.0, 2.0)], "a double, b double")
    row = drift.wasserstein_equal(pairs, "a", "b").first()
    assert row["n"] == 3 and abs(row["w1"] - 2 / 3) < 1e-12
    with pytest.raises(Exception, match="unequal size"):
        drift.wasserstein_equal(pairs.unionByName(spark.createDataFrame([(1.0, None)], pairs.schema)), "a", "b").collect()


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    root = str(tmp_path)
    process = detectors.window_process(root, size=4, stride=2)
    schema = "feature string, seq bigint, value double"
    process(spark.createDataFrame([("a", i, float(i)) for i in range(5)], schema), 0)
    late = [("a", 1, 100.0), ("a", 4, 100.0)]
    process(spark.createDataFrame(late + [("a", i, float(i)) for i in range(5, 8)] + [("b", 0, 1.0)], schema), 1)
    windows = {r["window_id"]: (r["first_seq"], r["last_seq"], r["mean"]) for r in microbatch.read_output(spark, root).collect()}
    assert windows == {0: (0, 3, 1.5), 1: (2, 5, 3.5), 2: (4, 7, 5.5)}
    counted = spark.read.parquet(microbatch.late_path(root, 1)).collect()
    assert [(r["feature"], r["n_late"]) for r in counted] == [("a", 2)]


def test_windows_without_a_reference_are_flagged(spark):
    rows = one_sided(spark)
    found = drift.sliding_wasserstein(rows, size=20, n_perm=20).collect()
    flagged = [r for r in found if r["feature"] == "new_only"]
    assert len(flagged) == 3 and all(r["status"] == "insufficient" and r["w1"] is None and not r["drift_detected"] for r in flagged)
    assert all(r["w1"] is not None and 0 < r["p_value"] <= 1 for r in found if r["feature"] == "both")


def test_exact_tails_equal_counting():
    from itertools import combinations, permutations

    for n in range(2, 7):
        counts = [sum(p[i] > p[j] for i, j in combinations(range(n), 2)) for p in permutations(range(n))]
        pairs = n * (n - 1) // 2
        for k in range(pairs // 2 + 1):
            want = sum(c <= k or c >= pairs - k for c in counts) / len(counts)
            assert special.inversion_two_sided(n, k) == pytest.approx(want)
    assert special.inversion_two_sided(300, 1) == 0.0
    for n, m in [(1, 1), (2, 3), (4, 4), (3, 8), (5, 6)]:
        gaps = []
        for chosen in combinations(range(n + m), n):
            i = j = best = 0
            for at in range(n + m):
                i, j = (i + 1, j) if at in chosen else (i, j + 1)
                best = max(best, abs(i * m - j * n))
            gaps.append(best)
        for d in sorted(set(gaps)):
            assert special.lattice_tail(n, m, d) == pytest.approx(sum(g >= d for g in gaps) / len(gaps))
        assert special.lattice_tail(n, m, 0) == 1.0


def test_a_metric_that_fails_at_run_time_leaves_the_others(spark):
    suite = fairness.default_suite()
    suite.register("broken", lambda cells: fairness.metric_summary(fairness.demographic_parity(cells), "overall_value").withColumn("gap", F.raise_error(F.lit("no such luck")).cast("double")))
    rows = spark.createDataFrame([(float(i % 2), float(i % 3 == 0), 0.5, "ab"[i % 2]) for i in range(40)], "y_true double, y_pred double, y_prob double, g string")
    cells = fairness.long_cells(fairness.cell_sums(rows, ["g"]), ["g"])
    got = {r["metric"]: r for r in suite.compute_all(cells).collect()}
    assert set(got) == {"demographic_parity", "equalized_odds", "calibration", "broken"}
    assert "no such luck" in got["broken"]["error"] and got["calibration"]["error"] is None


def test_exact_tail_for_short_samples_only(spark):
    rows = [("a", "ref", float(v)) for v in range(8)] + [("a", "new", v + 3.5) for v in range(5)] + [("only", "ref", 1.0)]
    df = spark.createDataFrame([(f, i, s, v) for i, (f, s, v) in enumerate(rows)], "feature string, seq bigint, side string, value double")
    got = {r["feature"]: r for r in drift.ks_test(df).collect()}
    d = round(got["a"]["ks_statistic"] * 40)
    assert got["a"]["p_method"] == "exact" and got["a"]["p_value"] == pytest.approx(special.lattice_tail(8, 5, d))
    assert got["only"]["p_value"] is None and got["only"]["p_method"] is None
    assert {r["p_method"] for r in drift.ks_test(df, exact_rows=6).collect()} == {"asymptotic", None}


def test_alert_summary_has_a_total_without_alerts(spark):
    some = spark.createDataFrame([("low", "a"), ("low", "b"), ("high", "a"), ("low", "a")], "severity string, feature string")
    found = lambda df: {tuple(r) for r in alerts.alert_summary(df).collect()}
    assert found(some) == {("by_severity", "low", 3), ("by_severity", "high", 1), ("by_feature", "a", 3), ("by_feature", "b", 1), ("total", "all", 4)}
    assert found(some.where("false")) == {("total", "all", 0)}
