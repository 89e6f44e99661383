"""SQL for sources and sinks: the written tables read back."""

from oracles.views import sql

ORACLES = {
    "s1_named_dataset": "SELECT * FROM customer",
    "s2_custom_file": "SELECT c_custkey::INT AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "s3_scan_by_extension": "SELECT kind, part.* FROM part, (SELECT unnest(['csv', 'tsv', 'json', 'parquet']) AS kind)",
    "s4_catalog_listing": "SELECT 'customer' AS name, count(*) AS n_rows, 5 AS n_columns, 'c_acctbal' AS target, 'c_mktsegment' AS sensitive FROM customer",
    "s5_clean_tokens": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'",
    "s6_trimmed_scan": "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS s_acctbal FROM supplier",
    "s7_json_round_trip": sql("SELECT * FROM drift_records", "drift_records"),
    "s8_audit_table": sql("""SELECT feature, total_checks, n_drift, 'daily_mean' AS model_name, 'run-1' AS run_id, d AS dataset_name FROM (
        SELECT feature, count(*) AS total_checks, count(*) FILTER (WHERE drift_detected) AS n_drift FROM drift_records GROUP BY feature), (SELECT unnest(['events', 'events_drifted']) AS d)
        WHERE d = 'events' OR n_drift > 0""", "drift_records"),
}
