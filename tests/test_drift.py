import numpy as np
import pandas as pd
import pytest

from fairspark.operators import drift as dr
from fairspark.streaming import detectors as det


def long(spark, ref, new, feature="f"):
    rows = [(feature, i, "ref", float(v)) for i, v in enumerate(ref)]
    rows += [(feature, len(ref) + i, "new", float(v)) for i, v in enumerate(new)]
    return spark.createDataFrame(rows, "feature string, seq bigint, side string, value double")


def cusum_loop(ref, new, k=0.5):
    mu, sd = np.mean(ref), np.std(ref)
    up = down = 0.0
    out = []
    for v in new:
        z = (v - mu) / sd
        up, down = max(0.0, up + z - k), max(0.0, down - z - k)
        out.append((up, down))
    return np.array(out)


def w1(a, b):
    xs = np.sort(np.unique(np.concatenate([a, b])))
    f = np.searchsorted(np.sort(a), xs, side="right") / len(a)
    g = np.searchsorted(np.sort(b), xs, side="right") / len(b)
    return float(np.sum(np.abs(f - g)[:-1] * np.diff(xs)))


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(42)
    return rng.normal(size=200), np.round(rng.normal(0.3, 1.4, size=330), 2)


@pytest.mark.parametrize("rows_per_block", [20, 100_000])
def test_cusum_equals_the_loop(spark, sample, rows_per_block):
    ref, new = sample
    got = dr.cusum(long(spark, ref, new), rows_per_block=rows_per_block).toPandas().sort_values("seq")
    assert np.allclose(got[["g_pos", "g_neg"]].to_numpy(), cusum_loop(ref, new), atol=1e-9)


def test_cusum_continues_from_state(spark, sample):
    ref, new = sample
    df = long(spark, ref, new)
    fit = dr.reference_fit(df)
    first = dr.side(df, "new").where("seq < 350")
    rest = dr.side(df, "new").where("seq >= 350")
    end = dr.cusum_scan(first, fit, rows_per_block=25).toPandas().sort_values("seq").iloc[-1]
    state = spark.createDataFrame([("f", float(end["g_pos"]), float(end["g_neg"]))], "feature string, g_pos double, g_neg double")
    got = dr.cusum_scan(rest, fit, state=state, rows_per_block=25).toPandas().sort_values("seq")
    want = cusum_loop(ref, new)[150:]
    assert np.allclose(got[["g_pos", "g_neg"]].to_numpy(), want, atol=1e-9)


def test_too_small_reference_is_flagged(spark):
    df = long(spark, [1.0] * 10, [1.0] * 10)
    assert dr.reference_fit(df).first()["status"] == "insufficient"
    assert dr.cusum(df).count() == 0


def test_distances_with_unequal_sizes(spark, sample):
    ref, new = sample
    got = dr.distances(long(spark, ref, new), rows_per_block=30).first()
    xs = np.concatenate([ref, new])
    f = np.searchsorted(np.sort(ref), xs, side="right") / len(ref)
    g = np.searchsorted(np.sort(new), xs, side="right") / len(new)
    assert got["w1"] == pytest.approx(w1(ref, new), abs=1e-9)
    assert got["ks_statistic"] == pytest.approx(np.max(np.abs(f - g)), abs=1e-12)


def test_permutation_test_block_borders_do_not_matter(spark, sample):
    ref, new = sample
    df = long(spark, ref, new)
    a = dr.permutation_test(df, 12, rows_per_block=25).first()
    b = dr.permutation_test(df, 12, rows_per_block=100_000).first()
    assert a["w1"] == pytest.approx(w1(ref, new), abs=1e-9)
    assert np.allclose(a["permuted"], b["permuted"], atol=1e-9) and len(a["permuted"]) == 12


def test_permutation_verdict_sees_known_drift(spark):
    rng = np.random.default_rng(5)
    df = long(spark, rng.normal(size=100), rng.normal(2.0, size=80)).unionByName(
        long(spark, np.zeros(50) + rng.normal(size=50), rng.normal(size=50), "same")
    )
    got = {r["feature"]: r for r in dr.wasserstein_verdict(dr.permutation_test(df, 60)).collect()}
    assert got["f"]["drift_detected"] and got["f"]["p_value"] == pytest.approx(1 / 61)
    assert not got["same"]["drift_detected"]


def test_hot_value_in_permutation_test(spark):
    rng = np.random.default_rng(8)
    ref = np.where(rng.random(300) < 0.4, 1.0, rng.normal(size=300))
    new = np.where(rng.random(200) < 0.4, 1.0, rng.normal(size=200))
    got = dr.permutation_test(long(spark, ref, new), 8, rows_per_block=20).first()
    assert got["w1"] == pytest.approx(w1(ref, new), abs=1e-9)


def test_sliding_windows_against_direct_distance(spark, sample):
    ref, new = sample
    got = dr.sliding_wasserstein(long(spark, ref, new), rows_per_block=60).toPandas().sort_values("window_id")
    want = [w1(ref, new[s : s + 100]) for s in range(0, len(new), 50) if len(new[s : s + 100]) >= 15]
    assert len(got) == len(want) and np.allclose(got["w1"].to_numpy(), want, atol=1e-9)


def test_constant_feature_and_empty_side(spark):
    same = dr.compare_distributions(long(spark, [2.0] * 40, [2.0] * 40)).first()
    assert same["psi"] == 0.0 and same["jsd"] == 0.0 and not same["drift_detected"]
    few = dr.compare_distributions(long(spark, [1.0, 2.0], [1.0, 3.0])).first()
    assert few["summary"] == "Insufficient samples for comparison"


@pytest.mark.parametrize("rows_per_block", [15, 100_000])
def test_cooldown_equals_the_greedy_loop(spark, rows_per_block):
    rng = np.random.default_rng(2)
    rows = [("a", float(t)) for t in rng.integers(0, 9000, 300)] + [("b", float(t)) for t in rng.integers(0, 90000, 60)]
    got = det.alert_cooldown(spark.createDataFrame(rows, "feature string, t double"), 300, rows_per_block).toPandas()
    for f, part in pd.DataFrame(rows, columns=["f", "t"]).groupby("f"):
        kept, last = [], -np.inf
        for t in sorted(set(part["t"])):
            if t >= last + 300:
                kept.append(t)
                last = t
        assert sorted(got[got["feature"] == f]["t"]) == kept


def test_permutation_tasks_hold_bounded_parts(spark, monkeypatch):
    """Parts do not grow with the table, and the keys of a part are formed a few rows at a time."""
    assert dr._even_parts(spark, 6_000_000) >= 120
    held, plain = [], dr._label_counts
    monkeypatch.setattr(dr, "_label_counts", lambda part, coef, cut: held.append(len(part)) or plain(part, coef, cut))
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"grp": "a", "part": 0, "id": np.arange(9_000), "value": rng.normal(size=9_000), "is_ref": rng.random(9_000) < 0.5})
    coef, cuts = dr.coefficients(5, 42), {"a": (np.full(5, 2**30), np.full(5, -1))}
    (out,) = list(dr._part_totals(coef, cuts)(iter([pdf])))
    assert max(held) <= 2_000 and out["total"][0] == plain(pdf, coef, cuts["a"]).sum(axis=0).tolist()
