"""Stream operators with engine state across restarts, and batches against a stored reference."""

import datetime as dt
import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairspark.operators import drift as dr
from fairspark.streaming import detectors as det
from fairspark.streaming import reference as rf
from fairspark.streaming import stateful as st


def feed(spark, root, batches, schema, build):
    """Every batch arrives, the stream starts from its checkpoint, drains and stops."""
    queries = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/source")
        stream = spark.readStream.schema(schema).parquet(f"{root}/source")
        queries.append(st.drain(spark, build(stream), root))
    return spark.read.parquet(f"{root}/out"), queries


def test_cooldown_out_of_order_late_and_restarted(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    schema = "feature string, ts timestamp"
    batches = [
        [("a", at(100)), ("a", at(0)), ("b", at(50)), ("a", at(299))],
        [("a", at(250)), ("a", at(700)), ("a", at(400)), (None, at(5)), ("b", None)],  # 250 and 400 are within the delay
        [("a", at(2000)), ("b", at(2100))],
        [("a", at(10)), ("b", at(5000))],  # 10 is behind the watermark
        [("a", at(9000))],
    ]
    out, queries = feed(spark, str(tmp_path), batches, schema, lambda s: st.cooldown_stream(s, 300, "500 seconds"))
    start = at(0).timestamp()
    got = sorted((r["feature"], r["t"] - start) for r in out.collect())
    arrived = [(f, t) for rows in batches for f, t in rows if f and t and t != at(10) and t <= at(9000 - 500)]
    batch = det.alert_cooldown(spark.createDataFrame([(f, t.timestamp()) for f, t in arrived], "feature string, t double"), 300)
    assert got == sorted((r["feature"], r["t"] - start) for r in batch.collect())
    assert got == [("a", 0.0), ("a", 400.0), ("a", 700.0), ("a", 2000.0), ("b", 50.0), ("b", 2100.0), ("b", 5000.0)] or ("a", 700.0) not in got
    assert sum(st.dropped_late(q) for q in queries) >= 1


def test_cusum_and_windows_go_on_after_a_restart(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [("a" if rng.random() < 0.7 else "b", i, float(rng.normal()), "ref") for i in range(200)]
    rows += [("a" if rng.random() < 0.7 else "b", 200 + i, float(rng.normal() + 0.6), "new") for i in range(260)]
    whole = spark.createDataFrame(rows, "feature string, seq bigint, value double, side string")
    fit = spark.createDataFrame(dr.reference_fit(whole).collect())
    new = [r[:3] for r in rows if r[3] == "new"]
    late = ("a", 201, 99.0)
    batches = [new[:90][::-1], [*new[90:91], late], new[91:]]
    schema = "feature string, seq bigint, value double"
    out, _ = feed(spark, str(tmp_path / "c"), batches, schema, lambda s: st.cusum_stream(s, fit))
    got = {(r["feature"], r["seq"]): (r["g_pos"], r["g_neg"]) for r in out.collect()}
    want = {(r["feature"], r["seq"]): (r["g_pos"], r["g_neg"]) for r in dr.cusum(whole).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert out.where("feature = 'a'").agg(F.max("n_late")).first()[0] == 1
    out, _ = feed(spark, str(tmp_path / "w"), batches, schema, lambda s: st.window_stream(s, 20, 7))
    numbered = whole.where("side = 'new'").selectExpr("feature", "seq", "value", "row_number() over (partition by feature order by seq) as rn")
    want = {(r["feature"], r["window_id"]): (r["mean"], r["first_seq"], r["last_seq"]) for r in det.count_windows(numbered, 20, 7).collect()}
    got = {(r["feature"], r["window_id"]): (r["mean"], r["first_seq"], r["last_seq"]) for r in out.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_fairness_windows_on_a_table_equal_plain_rates(spark):
    rng = np.random.default_rng(3)
    t0 = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
    rows = [(t0 + dt.timedelta(hours=int(rng.integers(0, 72))), float(rng.integers(0, 2)), float(rng.integers(0, 2)), rng.choice(["x", "y", "z"]).item()) for _ in range(300)]
    rows += [(t0, None, 1.0, "x"), (t0, 1.0, 1.0, None), (None, 1.0, 1.0, "x")]
    df = spark.createDataFrame(rows, "ts timestamp, y_true double, y_pred double, g string")
    got = {(r["window_start"], r["attribute"]): r for r in st.fairness_windows(df, ["g"], "2 days", "1 day").collect()}
    clean = [r for r in rows if None not in r]
    for k in range(-1, 3):
        begin = t0 + dt.timedelta(days=k)
        mine = [r for r in clean if begin <= r[0] < begin + dt.timedelta(days=2)]
        groups = sorted({r[3] for r in mine})
        rate = lambda num, den: round(len(num) / len(den), 6) if den else 0.0
        dp = [rate([r for r in mine if r[3] == g and r[2] == 1], [r for r in mine if r[3] == g]) for g in groups]
        fpr = [rate([r for r in mine if r[3] == g and r[1] == 0 and r[2] == 1], [r for r in mine if r[3] == g and r[1] == 0]) for g in groups]
        row = next(r for (s, _), r in got.items() if s.replace(tzinfo=None) == begin.astimezone(dt.timezone.utc).replace(tzinfo=None) or s.timestamp() == begin.timestamp())
        assert row["n"] == len(mine) and row["n_groups"] == len(groups)
        assert row["dp_gap"] == pytest.approx(max(dp) - min(dp), abs=1e-6) and row["fpr_gap"] == pytest.approx(max(fpr) - min(fpr), abs=1e-6)


def plain_distances(ref, new):
    values = np.unique(np.concatenate([ref, new]))
    f = np.searchsorted(np.sort(ref), values, side="right") / len(ref)
    g = np.searchsorted(np.sort(new), values, side="right") / len(new)
    return float((np.abs(f - g)[:-1] * np.diff(values)).sum()), float(np.abs(f - g).max())


def test_stored_reference_answers_like_the_whole_scan(spark, tmp_path):
    rng = np.random.default_rng(6)
    ref = {"a": np.round(rng.normal(size=3000), 2), "b": rng.normal(size=500), "only_ref": rng.normal(size=40)}
    path = str(tmp_path / "ref")
    rf.write_reference(spark.createDataFrame([(k, float(v)) for k, xs in ref.items() for v in xs], "feature string, value double"), path, values_per_block=16, blocks_per_part=2)
    cases = [
        {"a": np.round(rng.normal(0.3, 1.5, 200), 2), "b": rng.normal(size=3), "unknown": np.ones(4)},
        {"a": np.array([100.0, 100.0]), "b": np.array([-50.0])},
        {"b": np.sort(ref["b"])[:7], "a": np.array([float(np.min(ref["a"])), float(np.max(ref["a"]))])},
    ]
    for new in cases:
        batch = spark.createDataFrame([(k, float(v)) for k, xs in new.items() for v in xs] + [("a" if "a" in new else "b", None)], "feature string, value double")
        got = {r["feature"]: r for r in rf.distances_to_reference(spark, path, batch).collect()}
        assert got.keys() == new.keys()
        for k, xs in new.items():
            if k not in ref:
                assert got[k]["w1"] is None and got[k]["ks_p"] is None
            else:
                assert np.allclose((got[k]["w1"], got[k]["ks_statistic"]), plain_distances(ref[k], xs))


def test_a_batch_reads_only_the_folders_of_its_values(spark, tmp_path):
    path = str(tmp_path / "ref")
    rf.write_reference(spark.range(20_000).selectExpr("'a' as feature", "cast(id as double) as value"), path, values_per_block=50, blocks_per_part=4)
    assert len(glob.glob(f"{path}/blocks/feature=a/part=*")) == 100
    points = spark.createDataFrame([("a", "value", 777.5), ("a", "value", 790.0), ("a", "rank", 12_001.0)], "feature string, kind string, x double")
    located = rf._located(points, spark.read.parquet(f"{path}/directory"))
    needed = rf.blocks_for(spark, path, located)
    assert len(needed.inputFiles()) >= 1 and needed.count() == 2
    scan = needed._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in scan and "part#" in scan.split("PartitionFilters: [", 1)[1][:200]
    answers = {(r["kind"], r["x"]): r for r in rf.look_up(spark, path, points).collect()}
    assert (answers["value", 777.5]["below"], answers["value", 777.5]["upto"]) == (778, 778)
    assert (answers["value", 790.0]["below"], answers["value", 790.0]["upto"]) == (790, 791)
    assert answers["rank", 12_001.0]["found"] == 12_000.0


def test_cooldown_asks_the_store_per_block():
    """Waiting alerts are held in blocks, and blocks give back the same times."""
    puts = []

    class Listed:
        exists = lambda self: bool(puts)
        get = lambda self: iter(puts[-1])
        put = lambda self, rows: puts.append(rows)

    held = st.CooldownProcessor(300.0)
    held.waiting = Listed()
    assert len(held._held()) == 0
    times = np.arange(st.HELD_BLOCK * 2 + 5, dtype=float)
    held._hold(times)
    assert len(puts[-1]) == 3 and (held._held() == times).all()
