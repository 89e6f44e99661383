"""Sources and sinks: tables are written to the scratch area and read back whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairspark.operators import alerts as al
from fairspark.plans import views
from fairspark.plans.views import table
from fairspark.session import scratch_path
from fairspark.sources import catalog as cat
from fairspark.sources import sinks


def _catalog(spark, sf):
    root = scratch_path(spark, "catalog")
    customer = table(spark, sf, "customer")
    customer.write.option("header", True).csv(f"{root}/customer.csv")
    described = cat.Dataset("customer.csv", cat.CUSTOMER, "c_acctbal", ("c_mktsegment",))
    return cat.Catalog(root).register("customer", described)


def s1(spark, sf):
    return _catalog(spark, sf).load(spark, "customer")


def s2(spark, sf):
    c = _catalog(spark, sf)
    return cat.load_custom(spark, f"{c.root}/customer.csv")


def s3(spark, sf):
    """Parts through every supported extension."""
    part = table(spark, sf, "part")
    root = scratch_path(spark, "formats")
    part.write.option("header", True).csv(f"{root}/part.csv")
    part.write.option("header", True).option("sep", "\t").csv(f"{root}/part.tsv")
    part.write.json(f"{root}/part.json")
    part.write.parquet(f"{root}/part.parquet")
    out = None
    for kind in ("csv", "tsv", "json", "parquet"):
        one = cat.load_file(spark, f"{root}/part.{kind}", None if kind == "parquet" else part.schema)
        one = one.select(F.lit(kind).alias("kind"), *part.columns)
        out = one if out is None else out.unionByName(one)
    return out


def s4(spark, sf):
    return _catalog(spark, sf).listing(spark)


def s5(spark, sf):
    orders = table(spark, sf, "orders")
    dirty = orders.withColumn("o_orderpriority", F.when(F.col("o_orderstatus") == "P", "?").otherwise(F.col("o_orderpriority")))
    return cat.clean_tokens(dirty, keep=["o_orderkey", "o_orderstatus", "o_orderpriority", "o_absent"])


def s6(spark, sf):
    """Suppliers as raw lines ``key , name , nation , ?`` with blanks, read trimmed."""
    path = scratch_path(spark, "raw")
    supplier = table(spark, sf, "supplier")
    balance = F.when(F.col("s_acctbal") < 0, F.lit("?")).otherwise(F.col("s_acctbal").cast("string"))
    line = F.concat_ws(" , ", F.col("s_suppkey").cast("string"), "s_name", F.col("s_nationkey").cast("string"), balance)
    supplier.select(F.concat(F.lit("  "), line, F.lit("  "))).write.text(path)
    return cat.load_trimmed(spark, path, supplier.schema)


def s7(spark, sf):
    records = views.drift_records(spark, sf)
    path = scratch_path(spark, "records")
    sinks.write_json(records, path)
    return sinks.read_json(spark, path, records.schema)


def s8(spark, sf):
    """Feature summaries of two datasets appended to one audit table and read back."""
    path = scratch_path(spark, "audits")
    summary = al.feature_summary(views.drift_records(spark, sf))
    sinks.append_audit(summary, path, "events", "daily_mean", "run-1")
    sinks.append_audit(summary.where("n_drift > 0"), path, "events_drifted", "daily_mean", "run-1")
    return spark.read.parquet(path).select(
        "feature", "total_checks", "n_drift", "model_name", "run_id", F.col("dataset_name").cast("string").alias("dataset_name")
    )


QUERIES = {
    "s1_named_dataset": s1,
    "s2_custom_file": s2,
    "s3_scan_by_extension": s3,
    "s4_catalog_listing": s4,
    "s5_clean_tokens": s5,
    "s6_trimmed_scan": s6,
    "s7_json_round_trip": s7,
    "s8_audit_table": s8,
}
