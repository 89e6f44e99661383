"""Profiling and preparation over the warehouse tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairspark.operators import prepare as prep
from fairspark.operators import profile as prof
from fairspark.plans.views import table

LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _holey_orders(spark, sf):
    """Orders with the prices and priorities of open orders treated as missing."""
    open_ = F.col("o_orderstatus") == "O"
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(~open_, F.col("o_totalprice")).alias("price"),
        F.when(~open_, F.col("o_orderpriority")).alias("priority"),
    )


def p1(spark, sf):
    required = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_clerk"]
    return prof.validate_schema(table(spark, sf, "orders"), required, ["o_totalprice", "o_orderpriority"], ["o_orderstatus"])


def p2(spark, sf):
    return prof.validate_domain(
        table(spark, sf, "orders"), "o_orderstatus", ["F", "O"], ["o_totalprice", "o_orderpriority"], ["o_orderpriority", "o_region"]
    )


def p3(spark, sf):
    line = table(spark, sf, "lineitem")
    return prof.check_values(
        line,
        {
            "returnflag_known": F.col("l_returnflag").isin("A", "R"),
            "quantity_above_1": prof.in_range(F.col("l_quantity"), 1.0, None, strict=True),
            "discount_at_most_8_percent": prof.in_range(F.col("l_discount"), 0.0, 0.08),
            "tax_is_probability": prof.is_probability(F.col("l_tax")),
        },
    )


def p4(spark, sf):
    return prof.null_counts(_holey_orders(spark, sf))


def p5(spark, sf):
    return prof.describe_numeric(table(spark, sf, "lineitem"), LINE_NUM)


def p6(spark, sf):
    return prof.categorical_profile(table(spark, sf, "part"), ["p_brand", "p_type", "p_name"])


def p7(spark, sf):
    return prof.sample_preview(_holey_orders(spark, sf), ["o_orderkey"], 20)


def p8(spark, sf):
    frame = prof.numeric_frame(table(spark, sf, "customer"), "c_acctbal", keep=["c_custkey"])
    return frame.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


def p9(spark, sf):
    return prof.binarise_target(table(spark, sf, "orders"), "o_orderstatus").select("o_orderkey", "y_true")


def p10_numeric(spark, sf):
    return prof.binarise_sensitive(table(spark, sf, "customer"), "c_acctbal").select("c_custkey", "grp")


def p10_pair(spark, sf):
    return prof.binarise_sensitive(table(spark, sf, "lineitem"), "l_linestatus").groupBy("l_linestatus", "grp").agg(F.count("*").alias("cnt"))


def e1(spark, sf):
    return prep.impute(_holey_orders(spark, sf), ["price"], ["priority"])


def e2(spark, sf):
    out = prep.standard_scale(_holey_orders(spark, sf), ["price"])
    return out.select("o_orderkey", F.bround("price", 6).alias("price"))


def e3(spark, sf):
    return prep.label_encode(table(spark, sf, "customer"), "c_mktsegment", "code").select("c_custkey", "c_mktsegment", "code")


def e3_many(spark, sf):
    return prep.label_encode(table(spark, sf, "customer"), "c_name", "code").select("c_custkey", "c_name", "code")


def e4(spark, sf):
    line = table(spark, sf, "lineitem").select(*LINE_KEY, "l_quantity", "l_discount", "l_tax")
    return prep.interactions(line, ["l_quantity", "l_discount", "l_tax"])


def e5(spark, sf):
    return prep.quantile_bin(table(spark, sf, "orders"), "o_totalprice", 5, "bin").select("o_orderkey", "bin")


def e5_ties(spark, sf):
    out = prep.quantile_bin(table(spark, sf, "lineitem"), "l_discount", 20, "bin")
    return out.groupBy("l_discount", "bin").agg(F.count("*").alias("cnt"))


def e6(spark, sf):
    return prep.equal_width_bin(table(spark, sf, "orders"), "o_totalprice", 5, "bin").select("o_orderkey", "bin")


def e7(spark, sf):
    line = table(spark, sf, "lineitem").select(*LINE_KEY, "l_quantity", "l_discount")
    out = prep.polynomial(line, ["l_quantity", "l_discount"], 3)
    return out.select(*LINE_KEY, *[F.bround(c, 9).alias(c) for c in out.columns if "_pow" in c])


def e8(spark, sf):
    part = table(spark, sf, "part")
    return part.select("p_partkey", prep.age_group(F.col("p_size") * 3 - 10).alias("age_group"))


def e9(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return prep.stratified_split(orders, "o_orderpriority", "o_orderkey")


def e10(spark, sf):
    out = prep.min_max(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return out.select("c_custkey", F.bround("c_acctbal", 9).alias("c_acctbal"))


QUERIES = {
    "p1_validate_schema": p1,
    "p2_validate_domain": p2,
    "p3_value_checks": p3,
    "p4_null_counts": p4,
    "p5_describe": p5,
    "p6_categorical_profile": p6,
    "p7_sample_preview": p7,
    "p8_numeric_features": p8,
    "p9_binarise_target": p9,
    "p10_binarise_sensitive": p10_numeric,
    "p10_binarise_pair": p10_pair,
    "e1_impute": e1,
    "e2_standard_scale": e2,
    "e3_label_encode": e3,
    "e3_label_encode_many": e3_many,
    "e4_interactions": e4,
    "e5_quantile_bins": e5,
    "e5_quantile_bins_ties": e5_ties,
    "e6_equal_width_bins": e6,
    "e7_polynomial": e7,
    "e8_age_groups": e8,
    "e9_stratified_split": e9,
    "e10_min_max": e10,
}
