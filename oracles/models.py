"""SQL for batch scoring and user-defined metrics (trained models have none)."""

from oracles.fairness import long
from oracles.views import sql

ATTRS = ["o_orderpriority", "c_mktsegment", "l_linestatus"]

LINES = """SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_id, l_extendedprice / 100000.0::DOUBLE * (1 - l_discount) + l_tax > 0.45::DOUBLE AS y
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
SPLIT = """SELECT y, row_number() OVER (PARTITION BY y ORDER BY md5(row_id || '|42'), row_id) <= round_even(count(*) OVER (PARTITION BY y) * 0.2::DOUBLE, 0) AS is_test FROM lines"""

ORACLES = {
    "u2_model_kinds": sql("""SELECT kind, count(*) FILTER (WHERE is_test) AS n_test, count(*) FILTER (WHERE NOT is_test) AS n_train, true AS beats_majority
        FROM split, (SELECT unnest(['logistic_regression', 'random_forest', 'gradient_boosting', 'svm']) AS kind) GROUP BY kind""", lines=LINES, split=SPLIT),
    "u7_sql_functions": sql("""SELECT pair_id, step::INT AS step, round_even(d, 6) AS distance, CASE WHEN d > 1 THEN 'severe' WHEN d > 0.6 THEN 'high' WHEN d > 0.3 THEN 'medium' WHEN d > 0.1 THEN 'low' ELSE 'none' END AS level,
        round_even(100 / (1 + exp(-6.0::DOUBLE * (d - 0.5::DOUBLE))), 2) AS score
        FROM (SELECT pair_id, step, step / 4.0::DOUBLE * (1 - list_cosine_similarity(emb_a, emb_b)) AS d FROM pairs, range(0, 5) g(step))""", "pairs"),
    "u7_window_function": sql("""SELECT feature, window_id, count(*) AS n_rows FROM (SELECT feature, unnest([idx // 50, idx // 50 - 1]) AS window_id FROM (
        SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY seq) - 1 AS idx FROM drift_long WHERE side = 'new')) WHERE window_id >= 0 GROUP BY ALL""", "drift_long"),
    "u1_batch_scoring": """SELECT row_id, y_true, (z >= 0)::INT::DOUBLE AS y_pred, round_even(1 / (1 + exp(-z)), 6) AS y_prob FROM (
        SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_id,
        (l_extendedprice / 100000.0::DOUBLE * (1 - l_discount) + l_tax > 0.45::DOUBLE)::INT::DOUBLE AS y_true,
        l_quantity / 50.0::DOUBLE * 1.5::DOUBLE + l_discount * 10 * -0.5::DOUBLE + l_tax * 10 * 0.25::DOUBLE + l_extendedprice / 100000.0::DOUBLE * 2.0::DOUBLE - 1.75::DOUBLE AS z
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "u5_user_metric": sql("""SELECT attribute, 'false_discovery_rate' AS metric, count(*) AS n_groups, round_even(max(v) - min(v), 6) AS gap, max(v) - min(v) <= 0.05 AS is_fair
        FROM (SELECT attribute, grp, round_even(coalesce(avg(1 - y_true) FILTER (WHERE y_pred = 1), 0), 6) AS v FROM long GROUP BY attribute, grp) GROUP BY attribute""",
        "decisions", long=long("decisions", ATTRS)),
}
