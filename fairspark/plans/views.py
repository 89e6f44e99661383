"""Audit inputs derived from the warehouse tables (all rows of each table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTRIBUTES = ["o_orderpriority", "c_mktsegment", "l_linestatus"]
MATRIX = ["quantity", "extendedprice", "discount", "tax", "revenue", "charge", "unit_price"]
SPLIT_TS = "2024-01-16 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision per line item: label, score, hard prediction, three attributes."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    prob = F.col("l_quantity") / F.lit(51.0)
    return (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(customer, orders.o_custkey == customer.c_custkey)
        .select(
            F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_id"),
            (F.col("l_returnflag") == "R").cast("double").alias("y_true"),
            prob.alias("y_prob"),
            (prob >= F.lit(0.5)).cast("double").alias("y_pred"),
            *ATTRIBUTES,
        )
    )


def decisions_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision per order with (nearly) distinct scores; ``row_id`` is unique."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    prob = F.col("o_totalprice") / F.lit(500000.0)
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("row_id"),
        (F.col("o_orderstatus") == "F").cast("double").alias("y_true"),
        prob.alias("y_prob"),
        (prob >= F.lit(0.5)).cast("double").alias("y_pred"),
        F.col("c_mktsegment").alias("grp"),
    )


def labels_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: quality as truth, non-toxic as prediction, language as group."""
    labels = table(spark, sf_dir, "labels")
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return labels.join(documents, "doc_id").select(
        F.col("doc_id").alias("row_id"),
        F.col("quality").cast("double").alias("y_true"),
        (1 - F.col("toxic")).cast("double").alias("y_pred"),
        "lang",
        "source",
    )


def drift_long(spark: SparkSession, sf_dir: str, shifted: bool = False) -> DataFrame:
    """Event values in long form ``(feature, seq, side, value)``; optional known drift."""
    events = table(spark, sf_dir, "events")
    side = F.when(F.col("ts") < F.lit(SPLIT_TS).cast("timestamp"), "ref").otherwise("new")
    value = F.col("value")
    if shifted:
        value = (
            F.when((side == "new") & (F.col("event_type") == "click"), value * 1.8)
            .when((side == "new") & (F.col("event_type") == "view"), value + 25.0)
            .otherwise(value)
        )
    return events.select(
        F.col("event_type").alias("feature"), F.col("event_id").alias("seq"), side.alias("side"), value.alias("value")
    )


def numeric_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven numeric columns of the line items, three of them derived from the others."""
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        revenue.alias("revenue"),
        (revenue * (1 + F.col("l_tax"))).alias("charge"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding 2k paired with 2k+1; the label of the first is the category."""
    emb = table(spark, sf_dir, "embeddings")
    both = emb.groupBy(F.expr("vec_id div 2").alias("pair_id")).agg(
        F.count("*").alias("members"),
        F.min_by("label", "vec_id").alias("label"),
        F.min_by("embedding", "vec_id").cast("array<double>").alias("emb_a"),
        F.max_by("embedding", "vec_id").cast("array<double>").alias("emb_b"),
    )
    return both.where("members = 2").select(
        "pair_id", F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"), "emb_a", "emb_b"
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily metric history per event type: accuracy-like and gap-like rates."""
    events = table(spark, sf_dir, "events").where("value IS NOT NULL")
    day = F.dayofmonth("ts").cast("bigint")
    return events.groupBy(F.col("event_type").alias("run"), day.alias("step")).agg(
        F.bround(F.avg((F.col("value") >= 10).cast("double")), 6).alias("accuracy"),
        F.bround(F.avg((F.col("value") >= 60).cast("double")), 6).alias("dp_gap"),
        F.bround(F.avg((F.col("value") >= 90).cast("double")), 6).alias("eo_gap"),
        F.bround(F.avg((F.col("value") < 3).cast("double")), 6).alias("calibration_error"),
    )


def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision-flow graph over attribute values: each edge is the share of the
    source value's line items that continue to the target value.

    Layers: region of origin -> segment -> priority -> return flag -> outcome.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    cells = (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .groupBy("n_regionkey", "c_mktsegment", "o_orderpriority", "l_returnflag", "l_linestatus")
        .agg(F.count("*").alias("n"))
    )
    layers = [
        F.concat(F.lit("race_region_"), F.col("n_regionkey").cast("string")),
        F.concat(F.lit("segment "), F.col("c_mktsegment")),
        F.concat(F.lit("priority "), F.col("o_orderpriority")),
        F.concat(F.lit("flag "), F.col("l_returnflag")),
        F.concat(F.lit("decision_"), F.col("l_linestatus")),
    ]
    steps = F.explode(
        F.array(*[F.struct(a.alias("src"), b.alias("dst"), F.col("n").alias("n")) for a, b in zip(layers, layers[1:])])
    )
    flows = cells.select(steps.alias("s")).groupBy("s.src", "s.dst").agg(F.sum("s.n").alias("n"))
    out = flows.groupBy("src").agg(F.sum("n").alias("total"))
    return flows.join(out, "src").select("src", "dst", F.bround(F.col("n") / F.col("total"), 6).alias("weight"))


def drift_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One check per feature and day after the split: distance of the daily mean from
    the reference mean in reference deviations."""
    events = table(spark, sf_dir, "events").where("value IS NOT NULL")
    day = F.dayofmonth("ts").cast("bigint")
    late = F.col("ts") >= F.lit(SPLIT_TS).cast("timestamp")
    fit = events.where(~late).groupBy(F.col("event_type").alias("feature")).agg(
        F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd")
    )
    daily = events.where(late).groupBy(F.col("event_type").alias("feature"), day.alias("day")).agg(F.avg("value").alias("m"))
    stat = F.bround(F.abs(F.col("m") - F.col("mu")) / F.greatest("sd", F.lit(1e-10)), 6)
    drifted = F.col("statistic") >= 0.05
    scored = daily.join(fit, "feature").withColumn("statistic", stat)
    code = F.ascii(F.col("feature")).cast("bigint")
    return scored.select(
        (F.col("day") * 1000 + code).alias("record_id"), "day", "feature", F.lit("mean_shift").alias("detector_type"),
        "statistic", drifted.alias("drift_detected"),
        F.when(~drifted, "none").when(F.col("statistic") >= 0.5, "critical").when(F.col("statistic") >= 0.3, "high")
        .when(F.col("statistic") >= 0.15, "medium").otherwise("low").alias("severity"),
    )


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as unit-interval feature arrays: quantity, discount, tax, status, flag."""
    line = table(spark, sf_dir, "lineitem")
    features = F.array(
        F.col("l_quantity") / F.lit(50.0),
        F.col("l_discount") * F.lit(10.0),
        F.col("l_tax") * F.lit(10.0),
        (F.col("l_linestatus") == "O").cast("double"),
        (F.col("l_returnflag") == "A").cast("double"),
    )
    return line.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_id"), features.alias("features")
    )


def module_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long result table of the audit modules ``(module, metric, value, label)``."""
    from fairspark.operators import alerts, fairness, text_bias

    cells = fairness.long_cells(fairness.cell_sums(decisions(spark, sf_dir), ["c_mktsegment"]), ["c_mktsegment"])
    gaps = fairness.default_suite().compute_all(cells)
    short = F.when(F.col("metric") == "demographic_parity", "dp_gap").when(F.col("metric") == "equalized_odds", "eo_gap").otherwise("calibration")
    none = F.lit(None).cast("string")
    acc = fairness.confusion_metrics(decisions(spark, sf_dir))
    latest = alerts.feature_summary(drift_records(spark, sf_dir))
    rank = F.array_position(F.array(*[F.lit(x) for x in alerts.RECORD_LEVELS]), F.col("latest_severity"))
    drift = latest.agg(
        F.sum((F.col("latest_severity") != "none").cast("double")).alias("value"), F.max_by("latest_severity", rank).alias("label")
    )
    index = text_bias.bias_index(text_bias.score_pairs(text_bias.pair_distances(pairs(spark, sf_dir))))
    parts = [
        gaps.select(F.lit("fairness").alias("module"), short.alias("metric"), F.col("gap").alias("value"), none.alias("label")),
        acc.select(F.lit("fairness").alias("module"), F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"), none.alias("label")),
        drift.select(F.lit("drift").alias("module"), F.lit("n_drifted").alias("metric"), "value", none.alias("label")),
        drift.select(F.lit("drift").alias("module"), F.lit("severity").alias("metric"), F.lit(None).cast("double").alias("value"), "label"),
        index.select(F.lit("text_bias").alias("module"), F.lit("bias_index").alias("metric"), F.col("bias_index").alias("value"), none.alias("label")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
