import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairspark.functions import numeric, special, vectors
from fairspark.operators import causal as ca
from fairspark.operators import counterfactual as cf
from fairspark.operators import graph as gr
from fairspark.operators import mitigation as mit
from fairspark.operators import prepare as prep
from fairspark.operators import text_bias as tb


def dominates(a, b, e=1e-6):
    ok = a[0] >= b[0] - e and all(a[i] <= b[i] + e for i in (1, 2, 3))
    return ok and (a[0] > b[0] + e or any(a[i] < b[i] - e for i in (1, 2, 3)))


def test_pareto_front_equals_pairwise_test(spark):
    rng = np.random.default_rng(4)
    points = np.round(rng.random((300, 4)), 2)
    points[:20] = points[20:40] + rng.uniform(-1.5e-6, 1.5e-6, (20, 4))
    df = spark.createDataFrame(pd.DataFrame(points, columns=mit.OBJECTIVES)).repartition(5)
    got = {tuple(r) for r in mit.pareto_front(df, max_front=10_000).select(*mit.OBJECTIVES).collect()}
    want = {tuple(p) for p in points if not any(dominates(q, p) for q in points)}
    assert got == want


def test_reward_and_guard(spark):
    rows = [("r", 1, 0.75, 0.15, 0.20, 0.10), ("r", 2, 0.77, 0.10, 0.15, 0.08), ("r", 3, 0.55, 0.30, 0.15, 0.08)]
    hist = spark.createDataFrame(rows, "run string, step bigint, accuracy double, dp_gap double, eo_gap double, calibration_error double")
    changes = mit.step_changes(hist, rows_per_block=1)
    got = {r["step"]: r for r in mit.rewards(changes).collect()}
    assert got[2]["total_reward"] == pytest.approx(0.6 + 0.125 + 0.125 + 0.04)
    assert got[3]["penalty"] == pytest.approx(-5.0 * (0.22 - 0.02) * 100)
    guard = {r["step"]: r for r in mit.goodhart_guard(changes).collect()}
    assert guard[2]["alert_level"] == "safe" and guard[3]["alert_level"] == "unsafe"
    assert guard[3]["degraded"] == "dp_gap,accuracy_below_floor"


def test_metric_comparison_directions(spark):
    a = spark.createDataFrame([("accuracy", 0.8), ("dp_gap", 0.15), ("old", 1.0), ("same", 2.0)], "metric string, value double")
    b = spark.createDataFrame([("accuracy", 0.85), ("dp_gap", 0.18), ("fresh", 1.0), ("same", 2.0)], "metric string, value double")
    got = {r["metric"]: r["direction"] for r in mit.compare_metrics(a, b).collect()}
    assert got == {"accuracy": "improved", "dp_gap": "regressed", "old": "removed", "fresh": "new", "same": "unchanged"}


def test_oversample_reaches_the_largest_group(spark):
    df = spark.createDataFrame([(i, "a" if i < 17 else "b" if i < 22 else "c") for i in range(25)], "id bigint, g string")
    got = mit.oversample(df, "g", "id").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {"a": 17, "b": 17, "c": 17}


def test_offsets_against_direct_evaluation(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"y_true": rng.integers(0, 2, 80).astype(float), "y_prob": rng.random(80), "g": rng.choice(["a", "b"], 80)})
    got = mit.evaluate_offsets(spark.createDataFrame(pdf), "g", [-0.5, 0.0, 0.5]).orderBy("candidate").collect()
    for r, o in zip(got, [-0.5, 0.0, 0.5]):
        hit = (pdf["y_prob"] >= 0.5 + o * 0.1).astype(float)
        rates = hit.groupby(pdf["g"]).mean()
        assert r["accuracy"] == pytest.approx((hit == pdf["y_true"]).mean(), abs=1e-6)
        assert r["dp_gap"] == pytest.approx(rates.max() - rates.min(), abs=1e-6)


@pytest.mark.parametrize("rows_per_block", [20, 100_000])
def test_kendall_equals_pairs(spark, rows_per_block):
    rng = np.random.default_rng(6)
    x = np.where(rng.random(150) < 0.4, 3.0, rng.integers(0, 12, 150)).astype(float)
    y = np.round(0.4 * x + rng.normal(size=150), 1)
    got = ca.kendall(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "x", "y", rows_per_block).first()["correlation"]
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(150) for j in range(i))
    n0 = 150 * 149 / 2
    tie = lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1])
    assert got == pytest.approx(s / math.sqrt((n0 - tie(x)) * (n0 - tie(y))), abs=1e-9)


def test_spearman_with_ties(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"x": rng.integers(0, 8, 90).astype(float), "y": rng.normal(size=90)})
    got = ca.spearman(spark.createDataFrame(pdf), "x", "y", rows_per_block=9).first()["correlation"]
    assert got == pytest.approx(pdf["x"].rank().corr(pdf["y"].rank()), abs=1e-9)


def test_pc_finds_the_chain_and_the_collider(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=4000), rng.normal(size=4000)
    c = a + b + 0.3 * rng.normal(size=4000)
    got = ca.pc_edges(spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": c})), ["a", "b", "c"])
    assert {(r["src"], r["dst"], r["directed"]) for r in got.collect()} == {("a", "c", True), ("b", "c", True)}


def test_chi_square_against_expected(spark):
    rows = [("x", "p")] * 30 + [("x", "q")] * 10 + [("y", "p")] * 12 + [("y", "q")] * 28 + [("z", "p")] * 5
    got = ca.chi_square(spark.createDataFrame(rows, "a string, b string"), ["a", "b"]).first()
    table = np.array([[30, 10], [12, 28], [5, 0]])
    e = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    assert got["statistic"] == pytest.approx(((table - e) ** 2 / e).sum()) and got["dof"] == 2
    two = ca.chi_square(spark.createDataFrame([r for r in rows if r[0] != "z"], "a string, b string"), ["a", "b"]).first()
    t2 = table[:2]
    e2 = t2.sum(1, keepdims=True) * t2.sum(0) / t2.sum()
    assert two["statistic"] == pytest.approx(((np.abs(t2 - e2) - 0.5) ** 2 / e2).sum())


def test_special_functions():
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert special.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)


EDGES = [("age", "income", 0.8), ("age", "education", 0.6), ("income", "employment", 0.5), ("education", "employment", 0.7), ("employment", "credit_score", 0.9)]


def test_graph_of_five_nodes(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string, weight double")
    assert gr.is_acyclic(edges).first()["is_dag"]
    looped = edges.unionByName(spark.createDataFrame([("credit_score", "age", 1.0)], edges.schema))
    assert not gr.is_acyclic(looped).first()["is_dag"]
    with pytest.raises(ValueError):
        gr.topological_order(looped)
    start = spark.createDataFrame([("age",)], "node string")
    assert {r["node"] for r in gr.reachable(looped, start).collect()} == {"income", "education", "employment", "credit_score"}
    assert [r["node"] for r in gr.sensitive_nodes(edges).collect()] == ["age"]
    assert gr.outcome_node(edges).first()["node"] == "credit_score"
    end = spark.createDataFrame([("credit_score",)], "node string")
    chains = gr.proxy_chains(edges, start, end, max_nodes=4).collect()
    assert {tuple(r["path"]) for r in chains} == {("age", "income", "employment", "credit_score"), ("age", "education", "employment", "credit_score")}
    w = [0.8, 0.5, 0.9]
    want = 0.4 * np.mean(w) + 0.3 * 3 / 5 + 0.3 * (1 - min(10 * np.var(w), 1))
    got = next(r["risk"] for r in chains if "income" in r["path"])
    assert got == pytest.approx(want, abs=1e-4)
    assert gr.proxy_chains(edges, start, end).count() == 0


def test_cosine_and_levels(spark):
    rows = [(1, [1.0, 0.0], [1.0, 0.0]), (2, [1.0, 0.0], [-1.0, 0.0]), (3, [1.0], [1.0, 2.0])]
    got = {r["pair_id"]: r for r in tb.pair_distances(spark.createDataFrame(rows, "pair_id int, emb_a array<double>, emb_b array<double>")).collect()}
    assert got[1]["distance"] == pytest.approx(0.0) and got[2]["distance"] == pytest.approx(2.0)
    assert got[3]["distance"] is None and got[3]["length_mismatch"]
    d = spark.createDataFrame([(0.0,), (0.1,), (0.2,), (0.5,), (0.8,), (1.5,)], "distance double")
    levels = [r[0] for r in d.select(tb.bias_level(F.col("distance"))).collect()]
    assert levels == ["none", "none", "low", "medium", "high", "severe"]


def test_hash_embedding_equals_the_loop(spark):
    text = "Größe 𝄞 of a test, of a text"
    vec = np.zeros(64)
    for i in range(len(text) - 1):
        h = hashlib.sha256(text[i : i + 2].encode()).hexdigest()
        for ch in h[:8]:
            vec[(i + ord(ch)) % 64] += (int(ch, 16) - 7.5) / 7.5
    vec /= np.linalg.norm(vec)
    got = spark.createDataFrame([(text,), ("x",), (None,)], "t string").select(tb.hash_embedding(F.col("t"), 64)).collect()
    assert np.allclose(got[0][0], vec) and not any(got[1][0]) and not any(got[2][0])


def test_mean_cosine_matrix_equals_pairs(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(12, 5))
    g = [i % 2 for i in range(12)]
    df = spark.createDataFrame([(g[i], m[i].tolist()) for i in range(12)], "g int, v array<double>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = {(r["group_a"], r["group_b"]): r["mean_cosine"] for r in tb.mean_cosine_matrix(df, "g", "v").collect()}
    inside = [unit[i] @ unit[j] for i in range(12) for j in range(12) if i != j and g[i] == g[j] == 0]
    across = [unit[i] @ unit[j] for i in range(12) for j in range(12) if g[i] == 0 and g[j] == 1]
    assert got[(0, 0)] == pytest.approx(np.mean(inside)) and got[(0, 1)] == pytest.approx(np.mean(across))


def test_jitter_is_drawn_once_per_row(spark):
    """Uniforms come from the 13 hex digits as SQL draws them, null ids too, and before the samples are spread."""
    df = spark.createDataFrame([("a-1", [0.5, 0.2]), (None, [0.5, 0.2])], "id string, f array<double>")
    text = "concat_ws('|', id, '{}', '{}|{}|7')"
    drawn = "(cast(conv(substring(md5({}), 1, 13), 16, 10) as bigint) + 1) / 4503599627370497D"
    plain = [drawn.format(text.format(s, i, salt)) for s in (1, 2) for i in (0, 2) for salt in ("radius", "angle")]
    for row in df.selectExpr("id", f"array({', '.join(plain)}) as u").collect():
        assert cf.uniforms([row["id"]], [1, 2], [0, 2], 7).tolist() == row["u"]
    assert len(cf.uniforms([], [1], [0], 7)) == 0
    out = cf.counterfactual_variants(df, "id", "f", 2, 1, 0.0, n_samples=3)
    assert out.columns == ["id", "f", "sample", "counterfactual"] and out.count() == 6
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    assert plan.index("Generate") < plan.index("ArrowEvalPython") and "conv(" not in plan


def test_counterfactual_steps(spark):
    df = spark.createDataFrame([("r", [0.5, 1.2, 0.0])], "id string, f array<double>")
    flipped = cf.counterfactual(df, "f", 2, 1.0)
    assert flipped.first()["counterfactual"] == [0.5, 1.0, 1.0]
    changes = cf.explain_changes(flipped, ["id"], "f", "counterfactual", ["a", "b", "c"]).collect()
    assert {r["feature"] for r in changes} == {"b", "c"}
    variants = cf.counterfactual_variants(df, "id", "f", 3, 2, 1.0).collect()
    assert len(variants) == 5 and all(0 <= x <= 1 for r in variants for x in r["counterfactual"])
    noise = [r["counterfactual"][0] - 0.5 for r in variants]
    assert len(set(noise)) == 5 and max(map(abs, noise)) < 0.06


def test_preparation_edge_cases(spark):
    df = spark.createDataFrame([(1, 5.0, "b"), (2, None, "a"), (3, 7.0, None), (4, 9.0, "a"), (5, 5.0, "b")], "id int, x double, c string")
    filled = {r["id"]: r for r in prep.impute(df, ["x"], ["c"]).collect()}
    assert filled[2]["x"] == 6.0 and filled[3]["c"] == "a"
    bins = {r["id"]: r["q"] for r in prep.quantile_bin(df, "x", 4, "q").collect()}
    assert bins[2] is None and bins[1] == bins[5] == 0 and bins[4] == 2
    constant = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [r["x"] for r in prep.min_max(constant, ["x"]).collect()] == [0.0, 0.0]


def test_scalar_functions(spark):
    one = spark.range(1)
    row = one.select(
        numeric.sigmoid(F.lit(-800.0)).alias("low"), numeric.sigmoid(F.lit(0.0)).alias("mid"),
        numeric.softplus(F.lit(50.0)).alias("big"), numeric.log_sum_exp(F.array(F.lit(1000.0), F.lit(1000.0))).alias("lse"),
        numeric.percent_text(F.lit(0.1234)).alias("p"), vectors.norm(F.array(F.lit(3.0), F.lit(4.0))).alias("n"),
    ).first()
    assert (row["low"], row["mid"], row["big"], row["n"], row["p"]) == (0.0, 0.5, 50.0, 5.0, "12.34%")
    assert row["lse"] == pytest.approx(1000 + math.log(2))


@pytest.mark.parametrize("kind", ["logistic_regression", "random_forest", "svm"])
def test_models_learn_a_separable_label(spark, kind):
    from fairspark.operators import models

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y_true": (x[:, 0] + x[:, 1] > 0).astype(float)})
    df = spark.createDataFrame(pdf)
    model = models.train(df, ["a", "b"], kind)
    scored = models.score(model, df, ["a", "b"])
    row = models.evaluate(scored).first()
    assert row["accuracy"] > 0.9 and row["roc_auc"] > 0.9
    assert models.feature_importance(model, df, ["a", "b"]).count() == 2


def test_unknown_names_are_reported(spark, tmp_path):
    from fairspark.operators import models
    from fairspark.sources import catalog

    with pytest.raises(ValueError):
        models.classifier("perceptron")
    with pytest.raises(KeyError, match="adult_census"):
        catalog.default_catalog(str(tmp_path)).load(spark, "nope")
    with pytest.raises(ValueError):
        catalog.load_file(spark, "table.xlsx")
    metric = models.GroupMetric("m", F.avg("y_pred"), 0.1)
    assert metric.is_fair(0.05) and not metric.is_fair(0.15)


def test_catalog_roles_and_trimmed_scan(spark, tmp_path):
    from fairspark.sources import catalog

    (tmp_path / "raw.csv").write_text("39, State-gov, ?\n 50 , Private ,Bachelors\n")
    schema = catalog._schema("age int,workclass string,education string")
    got = catalog.load_trimmed(spark, str(tmp_path / "raw.csv"), schema)
    assert [tuple(r) for r in got.orderBy("age").collect()] == [(39, "State-gov", None), (50, "Private", "Bachelors")]
    assert catalog.clean_tokens(got).count() == 1
    typed = catalog.Dataset("raw.csv", schema, "education", ("workclass",)).typed()
    assert [f.metadata["role"] for f in typed] == ["feature", "sensitive", "target"]


def test_deep_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    real = gr.materialise
    monkeypatch.setattr(gr, "materialise", lambda df: rounds.append(1) or real(df))
    chain = spark.range(400).selectExpr("format_string('n%04d', id) as src", "format_string('n%04d', id + 1) as dst")
    levels = {r["node"]: r["level"] for r in gr.topological_order(chain).collect()}
    assert levels == {f"n{i:04d}": i for i in range(401)}
    start = spark.createDataFrame([("n0003",)], "node string")
    assert {r["node"] for r in gr.reachable(chain, start).collect()} == {f"n{i:04d}" for i in range(4, 401)}
    assert len(rounds) < 90
    ring = chain.unionByName(spark.createDataFrame([("n0400", "n0390"), ("n0400", "tail")], "src string, dst string"))
    assert gr.is_acyclic(ring).first()["n_on_cycles"] == 12
    side = chain.unionByName(spark.createDataFrame([("n0002", "n0300"), ("x", "n0399"), ("n0005", "y")], "src string, dst string"))
    levels = {r["node"]: r["level"] for r in gr.topological_order(side).collect()}
    assert (levels["n0300"], levels["n0400"], levels["x"], levels["y"]) == (300, 400, 0, 6)


def plain_paths(edges, starts, ends, most):
    out, open_ = [], [([s], []) for s in starts]
    for _ in range(most):
        open_ = [([*p, d], [*w, x]) for p, w in open_ for s, d, x in edges if s == p[-1] and d not in p]
        out += [(tuple(p), tuple(w)) for p, w in open_ if p[-1] in ends]
    return sorted(out)


def test_simple_paths_meet_in_the_middle(spark):
    rng = np.random.default_rng(12)
    edges = [(f"v{a}", f"v{b}", float(k)) for k, (a, b) in enumerate(rng.integers(0, 9, (26, 2)).tolist())] + [("v1", "v2", 77.0)]
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    for starts, ends, most in [(["v0", "v1"], ["v5", "v7"], 6), (["v2"], ["v2", "v3"], 3), (["v4"], ["v8"], 1), (["v0"], ["absent"], 5)]:
        table = lambda names: spark.createDataFrame([(n,) for n in names], "node string")
        got = sorted((tuple(r["path"]), tuple(r["weights"])) for r in gr.simple_paths(df, table(starts), table(ends), most).collect())
        assert got == plain_paths(edges, starts, ends, most)


def test_front_over_many_blocks_equals_the_pairwise_test(spark, monkeypatch):
    monkeypatch.setattr(mit, "BLOCK_POINTS", 32)
    rng = np.random.default_rng(9)
    points = np.round(rng.random((500, 4)), 3)
    points[:, 0] = np.round(points[:, 1:].sum(axis=1) / 3, 3)  # most points trade accuracy against gaps
    points[:30] = points[30:60]
    rows = [tuple(map(float, p)) + (i,) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in mit.OBJECTIVES) + ", id bigint").repartition(4)
    front = mit.pareto_front(df)
    got = {r["id"] for r in front.collect()}
    want = {i for i, p in enumerate(points) if not any(dominates(q, p) for q in points)}
    assert got == want and len(got) > 64
    others = rng.random((90, 4)).round(3)
    extra = spark.createDataFrame([tuple(map(float, p)) for p in others] + [(None, 0.1, 0.1, 0.1)], ", ".join(f"{c} double" for c in mit.OBJECTIVES))
    kept = [p for i, p in enumerate(points) if i in want]
    multiplier = lambda p: 1.5 if any(dominates(p, q) for q in kept) else 0.7 if any(dominates(q, p) for q in kept) else 1.0
    got = sorted((tuple(r[c] for c in mit.OBJECTIVES), r["multiplier"]) for r in mit.pareto_multiplier(extra, front).where("accuracy is not null").collect())
    assert got == sorted((tuple(map(float, p)), multiplier(p)) for p in others)


def test_embedding_in_parts_keeps_few_bigrams(spark, monkeypatch):
    text = "né à l'école, 日本 " * 40
    whole = tb._bigram_vector(text, 384, {})
    monkeypatch.setattr(tb, "BIGRAMS_PER_PASS", 7)
    assert np.allclose(tb._bigram_vector(text, 384, {}), whole)
    rows = spark.createDataFrame([(0, text), (1, None), (2, "a")], "k int, t string")
    got = {r["k"]: r["e"] for r in rows.select("k", tb.hash_embedding(F.col("t")).alias("e")).collect()}
    assert np.allclose(got[0], whole / np.linalg.norm(whole)) and len(got[1]) == 384 and not any(got[2])
