"""Blocked scans against plain loops, with blocks of a few rows and one hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairspark.functions import ordering as o
from fairspark.functions import permutation as pm


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    n = 600
    keys = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b"], n))
    return pd.DataFrame({"k": keys, "seq": rng.permutation(n), "v": np.round(rng.normal(size=n), 1)})


def test_running_sums_cross_block_borders(spark, rows):
    df = spark.createDataFrame(rows)
    got = o.running_sums(df, ["k"], ["seq"], {"s": F.col("v")}, rows_per_block=40).toPandas().sort_values("seq")
    want = rows.sort_values("seq").groupby("k")["v"].cumsum()
    assert np.allclose(got["s"].to_numpy(), want.to_numpy())


def test_row_index_and_next_and_previous(spark, rows):
    df = spark.createDataFrame(rows)
    ordered = rows.sort_values("seq")
    idx = o.row_index(df, ["k"], ["seq"], rows_per_block=50).toPandas().sort_values("seq")
    assert (idx["rn"].to_numpy() == ordered.groupby("k").cumcount().to_numpy() + 1).all()
    nxt = o.next_in_order(df, ["k"], "seq", "nx", rows_per_block=50).toPandas().sort_values("seq")
    want = ordered.groupby("k")["seq"].shift(-1)
    assert np.allclose(nxt["nx"].fillna(-1).to_numpy(float), want.fillna(-1).to_numpy())
    prev = o.previous_row(df, ["k"], "seq", ["v"], rows_per_block=50).toPandas().sort_values("seq")
    assert np.allclose(prev["prev_v"].fillna(99).to_numpy(float), ordered.groupby("k")["v"].shift(1).fillna(99).to_numpy())


def test_trailing_windows_with_halo(spark, rows):
    df = spark.createDataFrame(rows)
    got = o.trailing_windows(df, ["k"], "seq", 10, {"m": F.avg("v")}, rows_per_block=25).toPandas().sort_values("seq")
    want = rows.sort_values("seq").groupby("k")["v"].transform(lambda s: s.rolling(10, min_periods=1).mean())
    assert len(got) == len(rows) and np.allclose(got["m"].to_numpy(), want.to_numpy())


def test_exact_quantiles_equal_numpy(spark, rows):
    probs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = o.exact_quantiles(spark.createDataFrame(rows), ["k"], "v", probs, rows_per_block=10).toPandas().set_index("k")
    for k, part in rows.groupby("k"):
        assert np.allclose(got.loc[k, [f"q{i}" for i in range(len(probs))]].to_numpy(float), np.quantile(part["v"], probs))


def test_first_by_hash_takes_exact_counts(spark, rows):
    df = spark.createDataFrame(rows).withColumn("h", o.hash_key(F.col("seq"), F.lit(7)))
    got = o.first_by_hash(df, ["k"], "h", "seq", F.floor(F.col("n") / 3)).toPandas()
    for _, part in got.groupby("k"):
        m = len(part) // 3
        assert part["chosen"].sum() == m
        assert set(part[part["chosen"]]["seq"]) == set(part.sort_values(["h", "seq"])["seq"].head(m))
    everything = o.first_by_hash(df, ["k"], "h", "seq", F.col("n") + 5).toPandas()
    assert everything["chosen"].all()
    assert not o.first_by_hash(df, ["k"], "h", "seq", F.lit(0)).toPandas()["chosen"].any()


def test_string_index_is_sorted_order(spark):
    words = [f"Customer#{i:05d}" for i in range(300)] + ["Customer", "Customer#é"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = o.string_index(df, "w", "pos", rows_per_block=20).toPandas().sort_values("pos")
    assert list(got["w"]) == sorted(words, key=lambda w: w.encode())
    assert list(got["pos"]) == list(range(1, len(words) + 1))


def test_permutation_cuts_label_exactly_m(spark, rows):
    df = spark.createDataFrame(rows).select(F.col("k").alias("grp"), F.col("seq").cast("bigint").alias("id"))
    sizes = df.groupBy("grp").agg(F.count("*").alias("n"), F.floor(F.count("*") / 2).alias("m"))
    cuts = pm.permutation_cuts(df, sizes, 20, 3)
    coef = pm.coefficients(20, 3)
    for k, part in rows.groupby("k"):
        marked = pm.labels(part["seq"].to_numpy(np.int64), coef, cuts[k])
        assert (marked.sum(axis=0) == len(part) // 2).all()


def test_empty_input(spark):
    empty = spark.createDataFrame([], "k string, seq bigint, v double")
    assert o.running_sums(empty, ["k"], ["seq"], {"s": F.col("v")}).count() == 0
    assert o.exact_quantiles(empty, ["k"], "v", [0.5]).count() == 0


def test_string_index_with_a_shared_prefix_and_an_outlier(spark):
    names = [f"https://example.org/item/{i:05d}" for i in range(60)] + ["!", "é", "https://example.org/"]
    got = o.string_index(spark.createDataFrame([(n,) for n in names], "name string"), "name", "place", rows_per_block=7).collect()
    ranked = sorted(names, key=lambda n: n.encode())
    assert {r["name"]: r["place"] for r in got} == {n: i + 1 for i, n in enumerate(ranked)}


@pytest.mark.parametrize("digits", [1, 2])
def test_selection_refines_large_buckets(spark, digits):
    """One-digit buckets of about 250 rows against 3 rows a bucket: two refinements or more, the cut stays exact."""
    got = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise("cold").alias("k"), "id"
    )
    rows = got.withColumn("h", o.hash_key(F.col("id"), F.lit(7)))
    out = o.first_by_hash(rows, ["k"], "h", "id", F.floor(F.col("n") / 4), rows_per_bucket=3, digits=digits)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 4000") == 1
    pdf = out.toPandas()
    assert len(pdf) == 4000
    for _, part in pdf.groupby(pdf["k"].fillna("none")):
        want = set(part.sort_values("h")["id"].head(len(part) // 4))
        assert set(part[part["chosen"]]["id"]) == want


def test_selection_with_one_id_for_most_rows(spark):
    """Repeats of the cut's id are taken together; without a hash in common nothing else is."""
    rows = spark.range(900).select(F.lit("a").alias("k"), F.when(F.col("id") < 600, F.lit(None)).otherwise(F.col("id")).alias("id"))
    rows = rows.withColumn("h", o.hash_key(F.col("id"), F.lit(1)))
    out = o.first_by_hash(rows, ["k"], "h", "id", F.lit(300), rows_per_bucket=10).toPandas()
    blank = out[out["id"].isna()]
    smaller = (out[out["id"].notna()]["h"] < blank["h"].iloc[0]).sum()
    assert blank["chosen"].all() if smaller < 300 else not blank["chosen"].any()
    assert out["chosen"].sum() == (600 + smaller if smaller < 300 else 300)


def test_selection_of_an_empty_table(spark):
    rows = spark.createDataFrame([], "k string, id long, h string")
    assert o.first_by_hash(rows, ["k"], "h", "id", F.lit(3)).count() == 0


def test_partitions_of_a_scan_can_be_set(spark):
    from fairspark.functions import ordering

    df = spark.range(100).selectExpr("id % 3 AS k", "id AS v")
    out = ordering.row_index(df, ["k"], ["v"], "rn", [30.0, 60.0], parts=7)
    got = {(r["k"], r["v"]): r["rn"] for r in out.collect()}
    assert got == {(i % 3, i): i // 3 + 1 for i in range(100)}
