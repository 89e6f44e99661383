"""The SQL form of the derived inputs, as WITH clauses."""

VIEWS = {
    "decisions": """SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_id,
        CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y_true,
        l_quantity / 51.0::DOUBLE AS y_prob,
        CASE WHEN l_quantity / 51.0::DOUBLE >= 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y_pred,
        o_orderpriority, c_mktsegment, l_linestatus
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "decisions_order": """SELECT o_orderkey AS row_id,
        CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y_true,
        o_totalprice / 500000.0::DOUBLE AS y_prob,
        CASE WHEN o_totalprice / 500000.0::DOUBLE >= 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y_pred,
        c_mktsegment AS grp
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "labels_documents": """SELECT doc_id AS row_id, quality::DOUBLE AS y_true, (1 - toxic)::DOUBLE AS y_pred, lang, source
        FROM labels JOIN documents USING (doc_id)""",
    "drift_long": """SELECT event_type AS feature, event_id AS seq,
        CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'ref' ELSE 'new' END AS side, value FROM events""",
    "drift_shifted": """SELECT feature, seq, side,
        CASE WHEN side = 'new' AND feature = 'click' THEN value * 1.8::DOUBLE
             WHEN side = 'new' AND feature = 'view' THEN value + 25.0::DOUBLE ELSE value END AS value
        FROM (SELECT event_type AS feature, event_id AS seq,
              CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'ref' ELSE 'new' END AS side, value FROM events)""",
    "numeric_matrix": """SELECT l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax,
        l_extendedprice * (1 - l_discount) AS revenue,
        l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
        l_extendedprice / l_quantity AS unit_price FROM lineitem""",
    "pairs": """SELECT vec_id // 2 AS pair_id, 'c' || arg_min(label, vec_id) AS category,
        arg_min(embedding, vec_id)::DOUBLE[] AS emb_a, arg_max(embedding, vec_id)::DOUBLE[] AS emb_b
        FROM embeddings GROUP BY vec_id // 2 HAVING count(*) = 2""",
    "history": """SELECT event_type AS run, dayofmonth(ts)::BIGINT AS step,
        round_even(avg(CASE WHEN value >= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy,
        round_even(avg(CASE WHEN value >= 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS dp_gap,
        round_even(avg(CASE WHEN value >= 90 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS eo_gap,
        round_even(avg(CASE WHEN value < 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS calibration_error
        FROM events WHERE value IS NOT NULL GROUP BY ALL""",
    "drift_records": """SELECT day * 1000 + ascii(feature) AS record_id, day, feature, 'mean_shift' AS detector_type, statistic,
        statistic >= 0.05::DOUBLE AS drift_detected,
        CASE WHEN statistic < 0.05::DOUBLE THEN 'none' WHEN statistic >= 0.5::DOUBLE THEN 'critical' WHEN statistic >= 0.3::DOUBLE THEN 'high'
             WHEN statistic >= 0.15::DOUBLE THEN 'medium' ELSE 'low' END AS severity
        FROM (SELECT f.feature, d.day, round_even(abs(m - mu) / greatest(sd, 1e-10), 6) AS statistic
        FROM (SELECT event_type AS feature, avg(value) AS mu, stddev_pop(value) AS sd FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1) f
        JOIN (SELECT event_type AS feature, dayofmonth(ts)::BIGINT AS day, avg(value) AS m FROM events WHERE ts >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1, 2) d
        ON f.feature = d.feature)""",
    "flow_edges": """SELECT src, dst, round_even(n::DOUBLE / sum(n) OVER (PARTITION BY src)::DOUBLE, 6) AS weight FROM (
        SELECT src, dst, count(*) AS n FROM (
          SELECT unnest([
            {'src': 'race_region_' || n_regionkey, 'dst': 'segment ' || c_mktsegment},
            {'src': 'segment ' || c_mktsegment, 'dst': 'priority ' || o_orderpriority},
            {'src': 'priority ' || o_orderpriority, 'dst': 'flag ' || l_returnflag},
            {'src': 'flag ' || l_returnflag, 'dst': 'decision_' || l_linestatus}], recursive := true)
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
          JOIN nation ON c_nationkey = n_nationkey) GROUP BY src, dst)""",
}


def sql(body: str, *names: str, recursive: bool = False, **ctes: str) -> str:
    """``WITH`` the named views and extra clauses (in the given order) in front of ``body``."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + [f"{n} AS ({q})" for n, q in ctes.items()]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" + body) if parts else body
