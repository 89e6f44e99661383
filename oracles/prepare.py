"""SQL for profiling and preparation."""

from oracles.views import sql

HOLEY = """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS price,
    CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS priority FROM orders"""
NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def edges(n: int) -> str:
    return "[" + ", ".join(f"{i / n!r}::DOUBLE" for i in range(n + 1)) + "]"


def describe(c: str) -> str:
    r = lambda e: f"round_even({e}, 4)"
    return f"""SELECT '{c}' AS column_name, count({c}) AS cnt, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min,
        {r(f'quantile_cont({c}, 0.25)')} AS p25, {r(f'quantile_cont({c}, 0.5)')} AS p50, {r(f'quantile_cont({c}, 0.75)')} AS p75, {r(f'max({c})')} AS max FROM lineitem"""


def profile(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, n_distinct, r AS value_rank, v AS value, cnt FROM (
        SELECT {c} AS v, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, {c}) AS r, count(*) OVER () AS n_distinct
        FROM part WHERE {c} IS NOT NULL GROUP BY {c}) WHERE r <= 10"""


ORACLES = {
    "p1_validate_schema": """SELECT column_name, check_name, CASE WHEN check_name = 'required' AND nc > 0 THEN 'warning' ELSE status END AS status, nc AS null_count FROM (
        SELECT 'o_orderkey' AS column_name, 'required' AS check_name, 'ok' AS status, (SELECT count(*) FROM orders WHERE o_orderkey IS NULL) AS nc
        UNION ALL SELECT 'o_custkey', 'required', 'ok', (SELECT count(*) FROM orders WHERE o_custkey IS NULL)
        UNION ALL SELECT 'o_orderstatus', 'required', 'ok', (SELECT count(*) FROM orders WHERE o_orderstatus IS NULL)
        UNION ALL SELECT 'o_totalprice', 'required', 'ok', (SELECT count(*) FROM orders WHERE o_totalprice IS NULL)
        UNION ALL SELECT 'o_clerk', 'required', 'missing', NULL
        UNION ALL SELECT 'o_orderdate', 'extra', 'warning', NULL UNION ALL SELECT 'o_orderpriority', 'extra', 'warning', NULL
        UNION ALL SELECT 'o_totalprice', 'numeric', 'ok', NULL UNION ALL SELECT 'o_orderpriority', 'numeric', 'warning', NULL
        UNION ALL SELECT 'o_orderstatus', 'categorical', 'ok', NULL)""",
    "p2_validate_domain": """SELECT 'target_values' AS check_name, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) = 0 AS ok, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS detail FROM orders
        UNION ALL SELECT 'numeric_types', false, 1
        UNION ALL SELECT 'total_nulls', sum(k) = 0, sum(k)::BIGINT FROM (SELECT (o_orderkey IS NULL)::INT + (o_custkey IS NULL)::INT + (o_orderstatus IS NULL)::INT
            + (o_totalprice IS NULL)::INT + (o_orderdate IS NULL)::INT + (o_orderpriority IS NULL)::INT AS k FROM orders)
        UNION ALL SELECT 'minimum_rows', count(*) >= 10, count(*) FROM orders
        UNION ALL SELECT 'sensitive_columns', false, 1""",
    "p3_value_checks": """SELECT 'returnflag_known' AS rule, count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'R')) AS violations FROM lineitem
        UNION ALL SELECT 'quantity_above_1', count(*) FILTER (WHERE l_quantity <= 1) FROM lineitem
        UNION ALL SELECT 'discount_at_most_8_percent', count(*) FILTER (WHERE NOT (l_discount BETWEEN 0.0::DOUBLE AND 0.08::DOUBLE)) FROM lineitem
        UNION ALL SELECT 'tax_is_probability', count(*) FILTER (WHERE NOT (l_tax BETWEEN 0.0::DOUBLE AND 1.0::DOUBLE)) FROM lineitem""",
    "p4_null_counts": sql("""SELECT 'o_orderkey' AS column_name, count(*) FILTER (WHERE o_orderkey IS NULL) AS null_count FROM holey
        UNION ALL SELECT 'price', count(*) FILTER (WHERE price IS NULL) FROM holey UNION ALL SELECT 'priority', count(*) FILTER (WHERE priority IS NULL) FROM holey""", holey=HOLEY),
    "p5_describe": " UNION ALL ".join(describe(c) for c in NUMS),
    "p6_categorical_profile": " UNION ALL ".join(profile(c) for c in ("p_brand", "p_type", "p_name")),
    "p7_sample_preview": sql("""SELECT o_orderkey::VARCHAR AS o_orderkey, coalesce(price::VARCHAR, '') AS price, coalesce(priority, '') AS priority
        FROM (SELECT * FROM holey ORDER BY o_orderkey LIMIT 20)""", holey=HOLEY),
    "p8_numeric_features": """SELECT c_custkey, coalesce(try_cast(c_name AS DOUBLE), 0.0::DOUBLE) AS c_name, c_nationkey::DOUBLE AS c_nationkey,
        coalesce(try_cast(c_mktsegment AS DOUBLE), 0.0::DOUBLE) AS c_mktsegment FROM customer""",
    "p9_binarise_target": "SELECT o_orderkey, (o_orderstatus = (SELECT max(o_orderstatus) FROM orders))::INT::DOUBLE AS y_true FROM orders",
    "p10_binarise_sensitive": "SELECT c_custkey, (c_acctbal > (SELECT quantile_cont(c_acctbal, 0.5) FROM customer))::INT AS grp FROM customer",
    "p10_binarise_pair": "SELECT l_linestatus, (l_linestatus = (SELECT max(l_linestatus) FROM lineitem))::INT AS grp, count(*) AS cnt FROM lineitem GROUP BY ALL",
    "e1_impute": sql("""SELECT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM holey)) AS price,
        coalesce(priority, (SELECT priority FROM holey WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)) AS priority FROM holey""", holey=HOLEY),
    "e2_standard_scale": sql("""SELECT o_orderkey, round_even((coalesce(price, (SELECT quantile_cont(price, 0.5) FROM holey)) - (SELECT avg(price) FROM holey))
        / (SELECT stddev_pop(price) FROM holey), 6) AS price FROM holey""", holey=HOLEY),
    "e3_label_encode": "SELECT c_custkey, c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer",
    "e3_label_encode_many": "SELECT c_custkey, c_name, dense_rank() OVER (ORDER BY c_name) - 1 AS code FROM customer",
    "e4_interactions": f"""SELECT {KEY}, l_quantity, l_discount, l_tax, l_quantity * l_discount AS l_quantity_x_l_discount,
        l_quantity * l_tax AS l_quantity_x_l_tax, l_discount * l_tax AS l_discount_x_l_tax FROM lineitem""",
    "e5_quantile_bins": f"""SELECT o_orderkey, len(list_filter(e[2:len(e) - 1], lambda x: o_totalprice > x))::INT AS bin
        FROM orders, (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, {edges(5)}))) AS e FROM orders)""",
    "e5_quantile_bins_ties": f"""SELECT l_discount, len(list_filter(e[2:len(e) - 1], lambda x: l_discount > x))::INT AS bin, count(*) AS cnt
        FROM lineitem, (SELECT list_sort(list_distinct(quantile_cont(l_discount, {edges(20)}))) AS e FROM lineitem) GROUP BY ALL""",
    "e6_equal_width_bins": """SELECT o_orderkey, ((o_totalprice > lo + 1 * (hi - lo) / 5)::INT + (o_totalprice > lo + 2 * (hi - lo) / 5)::INT
        + (o_totalprice > lo + 3 * (hi - lo) / 5)::INT + (o_totalprice > lo + 4 * (hi - lo) / 5)::INT) AS bin
        FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)""",
    "e7_polynomial": f"""SELECT {KEY}, round_even(pow(l_quantity, 2), 9) AS l_quantity_pow2, round_even(pow(l_quantity, 3), 9) AS l_quantity_pow3,
        round_even(pow(l_discount, 2), 9) AS l_discount_pow2, round_even(pow(l_discount, 3), 9) AS l_discount_pow3 FROM lineitem""",
    "e8_age_groups": """SELECT p_partkey, CASE WHEN a > 0 AND a <= 25 THEN '18-25' WHEN a > 25 AND a <= 35 THEN '25-35' WHEN a > 35 AND a <= 45 THEN '35-45'
        WHEN a > 45 AND a <= 55 THEN '45-55' WHEN a > 55 AND a <= 65 THEN '55-65' WHEN a > 65 AND a <= 100 THEN '65+' END AS age_group
        FROM (SELECT p_partkey, p_size * 3 - 10 AS a FROM part)""",
    "e9_stratified_split": """SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || '|42'), o_orderkey)
        <= round_even(count(*) OVER (PARTITION BY o_orderpriority) * 0.2::DOUBLE, 0) AS is_test FROM orders""",
    "e10_min_max": "SELECT c_custkey, round_even((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer), 9) AS c_acctbal FROM customer",
}
