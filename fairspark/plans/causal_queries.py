"""Correlation, independence and edge scores over the line-item matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairspark.operators import causal as ca
from fairspark.plans import views
from fairspark.plans.views import MATRIX, table

CATEGORIES = ["l_returnflag", "l_linestatus", "ship_mode", "big"]


def _r(df, *cols, digits=6):
    return df.select(*[F.bround(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def _corr(spark, sf):
    return ca.correlation_matrix(views.numeric_matrix(spark, sf), MATRIX)


def _categories(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", F.col("l_linenumber").alias("ship_mode"), (F.col("l_quantity") > 25).cast("int").alias("big")
    )


def c1(spark, sf):
    return _r(_corr(spark, sf), "r").select("a", "b", "n", "r")


def c2(spark, sf):
    return _r(ca.correlation_edges(_corr(spark, sf)), "weight")


def c3(spark, sf):
    return _r(ca.partial_correlations(_corr(spark, sf)), "partial_r", digits=5).select("a", "b", "k", "partial_r")


def c3_sets(spark, sf):
    """All conditioning sets of up to three of the seven columns."""
    out = ca.independence_given(_corr(spark, sf), 3)
    return out.select("a", "b", F.array_join("given", ",").alias("given"), "size", F.bround("partial_r", 4).alias("partial_r"), "independent")


def c4(spark, sf):
    return _r(ca.fisher_tests(_corr(spark, sf)), "r", "z", digits=4)


def c5(spark, sf):
    return _r(ca.residual_tests(_corr(spark, sf)), "residual_r", digits=5).select("a", "b", "k", "residual_r")


def c6(spark, sf):
    return _r(ca.chi_square(_categories(spark, sf), CATEGORIES), "statistic")


def c6_tests(spark, sf):
    return _r(ca.chi_square_tests(_categories(spark, sf), CATEGORIES), "statistic", "p_value")


def c7(spark, sf):
    return ca.pc_edges(views.numeric_matrix(spark, sf), MATRIX)


def c7_categorical(spark, sf):
    """Codes of flag, status and line number beside two readings of the quantity, which depend on each other."""
    cats = table(spark, sf, "lineitem").select(
        *[F.ascii(c).alias(c) for c in ("l_returnflag", "l_linestatus")],
        F.col("l_linenumber").alias("ship_mode"),
        (F.col("l_quantity") > 25).cast("int").alias("big"),
        F.floor(F.col("l_quantity") / 10).cast("int").alias("band"),
    )
    return ca.pc_edges(cats, [*CATEGORIES, "band"])


def c8(spark, sf):
    return _r(ca.bic_table(_corr(spark, sf)), "bic_alone", "bic_with_parent", digits=2)


def c9(spark, sf):
    parents = ca.strongest_parent(_corr(spark, sf))
    out = ca.score_edges_bic(views.numeric_matrix(spark, sf), MATRIX, parents)
    return out.select("src", "dst", "score", F.bround("bic_improvement", 2).alias("bic_improvement"))


def c10(spark, sf):
    corr = _corr(spark, sf).select("a", "b", "n", F.col("r").alias("correlation"))
    scored = ca.correlation_score(corr)
    return scored.select(
        "a", "b", F.bround("correlation", 4).alias("correlation"), F.bround("abs_correlation", 4).alias("score"), F.bround("p_value", 6).alias("p_value"), "significant"
    )


def c11(spark, sf):
    scored = ca.correlation_score(ca.spearman(views.numeric_matrix(spark, sf), "extendedprice", "unit_price"))
    return _r(scored.drop("abs_correlation"), "correlation", "p_value")


def c12(spark, sf):
    return _r(ca.kendall(views.numeric_matrix(spark, sf), "quantity", "discount").drop("abs_correlation"), "correlation", "p_value")


def c12_continuous(spark, sf):
    return _r(ca.kendall(table(spark, sf, "customer"), "c_acctbal", "c_custkey").drop("abs_correlation"), "correlation", "p_value")


def c12_exact(spark, sf):
    """Nation numbers against their customers' greatest balances: few rows without ties, so the exact tail."""
    best = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("best"))
    return _r(ca.kendall(best, "c_nationkey", "best").drop("abs_correlation"), "correlation", "p_value")


def c13(spark, sf):
    return _r(ca.rank_edges(ca.correlation_edges(_corr(spark, sf), 0.0), 5), "weight")


def _directed(spark, sf):
    return ca.correlation_edges(_corr(spark, sf), 0.0)


def c14(spark, sf):
    return _r(ca.threshold_edges(_directed(spark, sf)), "weight")


def c14_sparsity(spark, sf):
    edges = _directed(spark, sf)
    names = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return _r(ca.sparsity(edges, names), "sparsity")


def c15(spark, sf):
    corr = _corr(spark, sf)
    out = ca.compare_edges(ca.correlation_edges(corr, 0.3), ca.strongest_parent(corr))
    return _r(out, "jaccard")


QUERIES = {
    "c1_correlation_matrix": c1,
    "c2_correlation_edges": c2,
    "c3_partial_correlation": c3,
    "c3_conditioning_sets": c3_sets,
    "c4_fisher_z": c4,
    "c5_residual_test": c5,
    "c6_chi_square": c6,
    "c6_chi_square_tests": c6_tests,
    "c7_pc_search": c7,
    "c7_pc_categorical": c7_categorical,
    "c8_bic": c8,
    "c9_edge_confidence": c9,
    "c10_pearson_score": c10,
    "c11_spearman": c11,
    "c12_kendall": c12,
    "c12_kendall_continuous": c12_continuous,
    "c12_kendall_exact": c12_exact,
    "c13_rank_edges": c13,
    "c14_threshold_edges": c14,
    "c14_sparsity": c14_sparsity,
    "c15_compare_edges": c15,
}
