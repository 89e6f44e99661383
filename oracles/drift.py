"""SQL for the drift operators."""

from oracles.views import sql

FIT = "SELECT feature, count(*) AS n_ref, avg(value) AS mu, greatest(stddev_pop(value), 1e-10) AS sd FROM {v} WHERE side = 'ref' GROUP BY feature"


def cusum(view: str) -> dict[str, str]:
    return {
        "fit": FIT.format(v=view),
        "steps": f"SELECT feature, seq, value, mu, sd, (value - mu) / sd - 0.5 AS up, -(value - mu) / sd - 0.5 AS down FROM {view} JOIN fit USING (feature) WHERE side = 'new'",
        "sums": "SELECT *, sum(up) OVER w AS s_up, sum(down) OVER w AS s_down FROM steps WINDOW w AS (PARTITION BY feature ORDER BY seq ROWS UNBOUNDED PRECEDING)",
        "g": "SELECT *, s_up - least(0.0::DOUBLE, min(s_up) OVER w) AS g_pos, s_down - least(0.0::DOUBLE, min(s_down) OVER w) AS g_neg FROM sums WINDOW w AS (PARTITION BY feature ORDER BY seq ROWS UNBOUNDED PRECEDING)",
        "scan": """SELECT feature, seq, value, mu, sd, g_pos, g_neg, greatest(g_pos, g_neg) AS statistic, greatest(g_pos, g_neg) >= 5 AS drift_detected FROM g""",
        "cs": """SELECT feature, count(*) AS total_points, count(*) FILTER (WHERE drift_detected) AS n_drift_points,
            max(statistic) AS max_statistic, arg_max(statistic, seq) AS last_statistic, min(seq) FILTER (WHERE drift_detected) AS first_drift_seq FROM scan GROUP BY feature""",
    }


def ecdf(view: str) -> dict[str, str]:
    return {
        "pool": f"SELECT feature, value, count(*) FILTER (WHERE side = 'ref') AS c_ref, count(*) FILTER (WHERE side = 'new') AS c_new FROM {view} WHERE value IS NOT NULL GROUP BY ALL",
        "cum": """SELECT feature, value, c_ref, c_new, sum(c_ref) OVER w::DOUBLE AS fr, sum(c_new) OVER w::DOUBLE AS fn, sum(c_ref) OVER (PARTITION BY feature) AS n_ref,
            sum(c_new) OVER (PARTITION BY feature) AS n_new, lead(value) OVER (PARTITION BY feature ORDER BY value) AS nv FROM pool
            WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)""",
        "dist": """SELECT feature, max(n_ref)::BIGINT AS n_ref, max(n_new)::BIGINT AS n_new, sum(abs(fr / n_ref - fn / n_new) * coalesce(nv - value, 0)) AS w1,
            max(abs(fr / n_ref - fn / n_new)) AS ks FROM cum GROUP BY feature""",
        "ksp": """SELECT feature, n_ref, n_new, w1, ks, CASE WHEN l2 < 0.04 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE,
            2 * (SELECT sum((CASE WHEN i % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * exp(-2.0::DOUBLE * i * i * l2)) FROM range(1, 101) t(i)))) END AS ks_p
            FROM (SELECT *, n_ref::DOUBLE * n_new / (n_ref + n_new) * ks * ks AS l2 FROM dist)""",
    }


def perm(view: str, n: int = 200) -> dict[str, str]:
    return {
        "nr": f"SELECT feature, count(*) FILTER (WHERE side = 'ref') AS n_ref, count(*) FILTER (WHERE side = 'new') AS n_new FROM {view} GROUP BY feature",
        "coef": f"""SELECT perm, {", ".join(f"('0x' || substring(md5('42|' || perm || '|{j}'), 1, 7))::BIGINT AS k{j}" for j in range(5))} FROM range(0, {n}) t(perm)""",
        "hashed": f"""SELECT feature, seq, value, side, perm,
            (((((k3 * x + k2) % 2147483647) * x + k1) % 2147483647 * x + k0) % 2147483647 + k4 * (seq // 2147483647)) % 2147483647 AS h
            FROM (SELECT *, seq % 2147483647 AS x FROM {view}), coef""",
        "marked": """SELECT feature, perm, value, row_number() OVER (PARTITION BY feature, perm ORDER BY h, seq) <= n_ref AS is_ref FROM hashed JOIN nr USING (feature)""",
        "ppool": "SELECT feature, perm, value, count(*) FILTER (WHERE is_ref) AS cr, count(*) AS ca FROM marked GROUP BY ALL",
        "pcum": """SELECT feature, perm, value, sum(cr) OVER w AS cr, sum(ca) OVER w AS ca, lead(value) OVER (PARTITION BY feature, perm ORDER BY value) AS nv
            FROM ppool WINDOW w AS (PARTITION BY feature, perm ORDER BY value ROWS UNBOUNDED PRECEDING)""",
        "pw": """SELECT feature, perm, sum(abs(cr::DOUBLE / n_ref - (ca - cr)::DOUBLE / n_new) * coalesce(nv - value, 0)) AS perm_w1
            FROM pcum JOIN nr USING (feature) GROUP BY feature, perm""",
        "verdict": f"""SELECT feature, w1, (count(*) FILTER (WHERE round_even(perm_w1, 9) >= round_even(w1, 9)) + 1)::DOUBLE / ({n} + 1) AS p_value
            FROM pw JOIN dist USING (feature) GROUP BY feature, w1""",
    }


def hist(view: str) -> dict[str, str]:
    return {
        "ends": f"""SELECT feature, min(value) AS low, (max(value) - min(value)) / 50 AS step, count(*) FILTER (WHERE side = 'ref') AS n_ref,
            count(*) FILTER (WHERE side = 'new') AS n_new FROM {view} WHERE value IS NOT NULL GROUP BY feature""",
        "hb": f"""SELECT feature, value, side, low, step, n_ref, n_new, least(greatest(len(list_filter(range(1, 50), lambda i: value >= low + i * step)), 0), 49) AS bin
            FROM {view} JOIN ends USING (feature) WHERE value IS NOT NULL""",
        "hc": """SELECT feature, bin, max(step) AS step, max(n_ref) AS n_ref, max(n_new) AS n_new, count(*) FILTER (WHERE side = 'ref') AS c_ref,
            count(*) FILTER (WHERE side = 'new') AS c_new FROM hb GROUP BY feature, bin""",
        "jsds": """SELECT feature, sum(0.5 * p * ln(p / (0.5 * (p + q))) + 0.5 * q * ln(q / (0.5 * (p + q)))) AS jsd FROM (
            SELECT feature, (c_ref::DOUBLE / n_ref / step + 1e-10) / (1 / step + 50 * 1e-10) AS p, (c_new::DOUBLE / n_new / step + 1e-10) / (1 / step + 50 * 1e-10) AS q FROM hc) GROUP BY feature""",
    }


def psi(view: str) -> dict[str, str]:
    return {
        "pe": f"""SELECT feature, list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e,
            count(*) FILTER (WHERE side = 'ref') AS n_ref, count(*) FILTER (WHERE side = 'new') AS n_new FROM {view} WHERE value IS NOT NULL GROUP BY feature""",
        "pc": f"""SELECT feature, len(list_filter(e[2:len(e) - 1], lambda x: value >= x)) AS bin, max(n_ref) AS n_ref, max(n_new) AS n_new,
            count(*) FILTER (WHERE side = 'ref') AS c_ref, count(*) FILTER (WHERE side = 'new') AS c_new FROM {view} JOIN pe USING (feature) GROUP BY ALL""",
        "psis": """SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM (SELECT feature, c_ref::DOUBLE / n_ref + 1e-10 AS e, c_new::DOUBLE / n_new + 1e-10 AS a FROM pc) GROUP BY feature""",
    }


S = "drift_shifted"
BASE = ["drift_long"]
ENS = {**cusum(S), **ecdf(S), **perm(S)}
ENSEMBLE = """SELECT feature, n_drift_points > 0 AS cusum_drift, wd AS wasserstein_drift, n_drift_points > 0 OR wd AS drift_detected, last_statistic, max_statistic, w1, p_value,
    CASE WHEN NOT (n_drift_points > 0 OR wd) THEN 'none' WHEN greatest(last_statistic / 5, w1 / 0.1) >= 2 THEN 'critical'
      WHEN greatest(last_statistic / 5, w1 / 0.1) >= 1.5 THEN 'high' WHEN greatest(last_statistic / 5, w1 / 0.1) >= 1 THEN 'medium' ELSE 'low' END AS severity,
    'Drift detected by: ' || CASE WHEN n_drift_points > 0 AND wd THEN 'CUSUM, Wasserstein' WHEN n_drift_points > 0 THEN 'CUSUM' WHEN wd THEN 'Wasserstein' ELSE 'none' END AS details
    FROM (SELECT cs.*, w1, p_value, w1 >= 0.1 AND p_value < 0.05 AS wd FROM cs JOIN verdict USING (feature))"""
ALERTS = """SELECT md5(feature || '|' || day) AS alert_id, day, feature, CASE WHEN statistic >= 0.5::DOUBLE THEN 'critical' WHEN statistic >= 0.3::DOUBLE THEN 'high'
    WHEN statistic >= 0.15::DOUBLE THEN 'medium' ELSE 'low' END AS severity, statistic AS magnitude FROM drift_records WHERE drift_detected"""
LEVELS = "unnest(['low', 'medium', 'high', 'critical'])"

HALVES = {
    "o": "SELECT o_totalprice, o_custkey, row_number() OVER (ORDER BY o_orderkey) <= (SELECT count(*) FROM orders) // 2 AS first FROM orders",
    "halves": """SELECT 'o_totalprice' AS feature, CASE WHEN first THEN 'ref' ELSE 'new' END AS side, o_totalprice AS value FROM o
        UNION ALL SELECT 'o_custkey', CASE WHEN first THEN 'ref' ELSE 'new' END, o_custkey::DOUBLE FROM o""",
}

ORACLES = {
    "d1_reference_fit": sql(f"SELECT feature, n_ref, round_even(mu, 6) AS mu, round_even(sd, 6) AS sd, CASE WHEN n_ref >= 30 THEN 'fitted' ELSE 'insufficient' END AS status FROM fit", "drift_long", fit=FIT.format(v="drift_long")),
    "d2_cusum": sql("""SELECT feature, seq, value, round_even(g_pos, 6) AS g_pos, round_even(g_neg, 6) AS g_neg, round_even(statistic, 6) AS statistic, drift_detected,
        CASE WHEN statistic >= 5 THEN 'drift' WHEN statistic >= 3 THEN 'warning' ELSE 'none' END AS status,
        CASE WHEN statistic >= 5 THEN CASE WHEN g_pos > g_neg THEN 'upward' ELSE 'downward' END END AS direction, round_even(mu + g_pos * sd, 4) AS mean_estimate FROM scan""", S, **cusum(S)),
    "d3_cusum_summary": sql("""SELECT feature, total_points, n_drift_points, round_even(n_drift_points::DOUBLE / total_points, 6) AS drift_ratio, round_even(max_statistic, 6) AS max_statistic,
        round_even(last_statistic, 6) AS last_statistic, first_drift_seq FROM cs""", S, **cusum(S)),
    "d4_wasserstein": sql("SELECT feature, n_ref, n_new, round_even(w1, 6) AS w1 FROM dist", S, **ecdf(S)),
    "d5_wasserstein_equal": sql("""SELECT count(*) AS n, round_even(avg(abs(a.v - b.v)), 4) AS w1 FROM (SELECT extendedprice AS v, row_number() OVER (ORDER BY extendedprice) AS rn FROM numeric_matrix) a
        JOIN (SELECT charge AS v, row_number() OVER (ORDER BY charge) AS rn FROM numeric_matrix) b USING (rn)""", "numeric_matrix"),
    "d6_permutation_test": sql("SELECT feature, perm, round_even(w1, 6) AS w1, round_even(perm_w1, 6) AS perm_w1 FROM pw JOIN dist USING (feature)", "drift_long", **ecdf("drift_long"), **perm("drift_long")),
    "d7_wasserstein_verdict": sql("""SELECT feature, round_even(w1, 6) AS w1, round_even(p_value, 6) AS p_value, w1 >= 0.1 AND p_value < 0.05 AS drift_detected,
        CASE WHEN w1 >= 0.1 AND p_value < 0.05 THEN 'drift' WHEN w1 >= 0.05 THEN 'warning' ELSE 'none' END AS status FROM verdict""", "drift_long", **ecdf("drift_long"), **perm("drift_long")),
    "d8_sliding_wasserstein": sql("""SELECT feature, window_id, n_rows, round_even(w1, 6) AS w1, round_even(p_value, 6) AS p_value, w1 >= 0.1 AND p_value < 0.05 AS drift_detected,
        CASE WHEN w1 >= 0.1 AND p_value < 0.05 THEN 'drift' WHEN w1 >= 0.05 THEN 'warning' ELSE 'none' END AS status
        FROM (SELECT w.feature, w.window_id, w.nw AS n_rows, w.w1, (count(*) FILTER (WHERE round_even(z.w1, 9) >= round_even(w.w1, 9)) + 1)::DOUBLE / 201 AS p_value
            FROM wdist w JOIN wdist z ON z.feature = w.feature AND z.nw = w.nw AND z.window_id < 0 WHERE w.window_id >= 0 GROUP BY ALL)""", S,
        numbered=f"SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY seq) - 1 AS idx FROM {S} WHERE side = 'new'",
        win="SELECT feature, value, unnest([idx // 50, idx // 50 - 1]) AS window_id FROM numbered",
        kept="SELECT feature, window_id, count(*) AS nw FROM win WHERE window_id >= 0 GROUP BY ALL HAVING count(*) >= 15",
        pooled=f"SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value, side, seq) AS place, count(*) OVER (PARTITION BY feature) AS n FROM {S} WHERE value IS NOT NULL",
        draws="""SELECT k.feature, nw, -1 - perm AS window_id, ('0x' || substring(md5(k.feature || '|' || nw || '|' || perm || '|' || j || '|42'), 1, 13))::BIGINT % n + 1 AS place
            FROM (SELECT DISTINCT feature, nw FROM kept) k JOIN (SELECT DISTINCT feature, n FROM pooled) s ON s.feature = k.feature, range(0, 200) p(perm), range(0, 100) r(j) WHERE j < nw""",
        allwin="""SELECT feature, nw, window_id, value FROM win JOIN kept USING (feature, window_id)
            UNION ALL SELECT d.feature, d.nw, d.window_id, p.value FROM draws d JOIN pooled p ON p.feature = d.feature AND p.place = d.place""",
        wrows="""SELECT feature, nw, window_id, value, 0 AS cr, 1 AS cw FROM allwin
            UNION ALL SELECT r.feature, k.nw, k.window_id, r.value, 1, 0 FROM (SELECT feature, value FROM drift_shifted WHERE side = 'ref') r
            JOIN (SELECT DISTINCT feature, nw, window_id FROM allwin) k ON k.feature = r.feature""",
        wpool="SELECT feature, nw, window_id, value, sum(cr) AS cr, sum(cw) AS cw FROM wrows GROUP BY ALL",
        wcum="""SELECT feature, nw, window_id, value, sum(cr) OVER w::DOUBLE AS fr, sum(cw) OVER w::DOUBLE AS fw, sum(cr) OVER a AS n_ref,
            lead(value) OVER (PARTITION BY feature, nw, window_id ORDER BY value) AS nv FROM wpool
            WINDOW w AS (PARTITION BY feature, nw, window_id ORDER BY value ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY feature, nw, window_id)""",
        wdist="SELECT feature, nw, window_id, sum(abs(fr / n_ref - fw / nw) * (nv - value)) AS w1 FROM wcum WHERE nv IS NOT NULL GROUP BY ALL"),
    "d9_kolmogorov_smirnov": sql("SELECT feature, round_even(ks, 6) AS ks_statistic, round_even(ks_p, 6) AS ks_p FROM ksp", S, **ecdf(S)),
    # Share of the lattice paths that stay within the observed distance, diagonal by diagonal.
    "d9_exact_test": sql("""SELECT feature, n_ref, n_new, round_even(ks, 6) AS ks_statistic, round_even(coalesce(1 - (SELECT share FROM paths p WHERE p.feature = dist.feature AND p.d = n_ref + n_new AND p.i = n_ref), 1), 6) AS p_value,
        'exact' AS p_method FROM dist""", recursive=True,
        daily="""SELECT event_type AS feature, CASE WHEN dayofmonth(ts) < 16 THEN 'ref' ELSE 'new' END AS side, round_even(avg(value), 6) AS value
            FROM events WHERE value IS NOT NULL GROUP BY event_type, dayofmonth(ts)""",
        **{k: v for k, v in ecdf("daily").items() if k != "ksp"},
        paths="""SELECT feature, 0::BIGINT AS d, 0::BIGINT AS i, 1.0::DOUBLE AS share FROM dist UNION ALL
            SELECT feature, d, i, share FROM (SELECT p.feature, p.d + 1 AS d, p.i + s AS i, sum(share * (CASE WHEN s = 1 THEN p.i + 1 ELSE p.d - p.i + 1 END) / (p.d + 1)) AS share
              FROM paths p JOIN dist USING (feature), range(0, 2) t(s)
              WHERE p.i + s <= n_ref AND p.d + 1 - (p.i + s) <= n_new AND abs((p.i + s) * n_new - (p.d + 1 - p.i - s) * n_ref) < round(ks * n_ref * n_new) GROUP BY p.feature, p.d + 1, p.i + s)"""),
    "d10_jensen_shannon": sql("SELECT feature, round_even(jsd, 6) AS jsd FROM jsds", S, **hist(S)),
    "d11_population_stability": sql("SELECT feature, round_even(psi, 6) AS psi FROM psis", S, **psi(S)),
    "d12_compare_report": sql("""SELECT feature, round_even(ks, 6) AS ks_statistic, round_even(ks_p, 6) AS ks_p, round_even(jsd, 6) AS jsd, round_even(psi, 6) AS psi,
        round_even(mn - mr, 6) AS mean_shift, round_even(sn / greatest(sr, 1e-10), 6) AS std_ratio, ks_p < 0.05 OR jsd > 0.1 OR psi > 0.25 AS drift_detected,
        CASE WHEN NOT (ks_p < 0.05 OR jsd > 0.1 OR psi > 0.25) THEN 'No significant drift' ELSE concat_ws('; ',
          CASE WHEN ks_p < 0.05 THEN printf('KS test significant (p=%.4f)', ks_p) END, CASE WHEN jsd > 0.1 THEN printf('JSD elevated (%.4f)', jsd) END,
          CASE WHEN psi > 0.25 THEN printf('PSI %s (%.4f)', CASE WHEN psi > 0.5 THEN 'significant' ELSE 'moderate' END, psi) END) END AS summary
        FROM ksp JOIN jsds USING (feature) JOIN psis USING (feature) JOIN mo USING (feature)""", S, **ecdf(S), **hist(S), **psi(S),
        mo=f"""SELECT feature, avg(value) FILTER (WHERE side = 'new') AS mn, avg(value) FILTER (WHERE side = 'ref') AS mr, stddev_pop(value) FILTER (WHERE side = 'new') AS sn,
            stddev_pop(value) FILTER (WHERE side = 'ref') AS sr FROM {S} GROUP BY feature"""),
    "d13_divergence_entropy": sql("""SELECT feature, round_even(sum(p * ln(p / q)), 6) AS kl, round_even(sum(-p * ln(p)), 6) AS entropy FROM (
        SELECT feature, least(1.0::DOUBLE, greatest(1e-8, c_ref::DOUBLE / n_ref)) AS p, least(1.0::DOUBLE, greatest(1e-8, c_new::DOUBLE / n_new)) AS q FROM hc) GROUP BY feature""", S, **hist(S)),
    "d14_ensemble_verdict": sql("""SELECT feature, cusum_drift, wasserstein_drift, drift_detected, round_even(last_statistic, 6) AS last_statistic, round_even(max_statistic, 6) AS max_statistic,
        round_even(w1, 6) AS w1, round_even(p_value, 6) AS p_value, severity, details FROM ens""", S, **ENS, ens=ENSEMBLE),
    "d15_feature_scores": sql("SELECT feature, round_even(w1, 6) AS route_score, round_even(greatest(last_statistic, w1), 6) AS pipeline_score FROM ens", S, **ENS, ens=ENSEMBLE),
    "d16_drift_monitor": sql("""SELECT n AS n_features, nd AS n_drifted, nd > 0 AS drift_detected, sev AS overall_severity, concat_ws(' | ',
        CASE WHEN sev = 'none' THEN 'No significant drift detected. Continue regular monitoring.' END,
        CASE WHEN sev IN ('critical', 'high') THEN 'CRITICAL/HIGH drift detected. Immediate model retraining is recommended.' END,
        CASE WHEN sev IN ('critical', 'high') THEN 'Investigate upstream data pipeline for distribution changes.' END,
        CASE WHEN sev IN ('critical', 'high') THEN 'Consider rolling back to a previous model version as a safety measure.' END,
        CASE WHEN sev = 'medium' THEN 'Moderate drift detected. Schedule model retraining within 24-48 hours.' END,
        CASE WHEN sev = 'medium' THEN 'Compare reference data timeframe with current data to identify root cause.' END,
        CASE WHEN sev = 'low' THEN 'Minor drift detected. Increase monitoring frequency.' END,
        CASE WHEN sev = 'low' THEN 'No immediate action required, but track trend over next monitoring window.' END,
        CASE WHEN sev <> 'none' AND nd::DOUBLE / n > 0.5 THEN printf('Drift detected in %.0f%% of features. This may indicate a systematic data pipeline issue.', nd::DOUBLE / n * 100) END) AS recommendations
        FROM (SELECT count(*) AS n, count(*) FILTER (WHERE drift_detected) AS nd,
          arg_max(severity, list_position(['none', 'low', 'medium', 'high', 'critical'], severity)) AS sev FROM ens)""", S, **ENS, ens=ENSEMBLE),
    "d17_create_alerts": sql("""SELECT *, CASE severity WHEN 'critical' THEN 'Severe drift detected! Immediate model retraining or pipeline reset recommended.'
        WHEN 'high' THEN 'Significant drift detected. Consider model retraining or threshold adjustment.'
        WHEN 'medium' THEN 'Investigate the source of drift. Consider updating reference data.'
        ELSE 'Continue monitoring. No action required at this time.' END AS recommendation FROM alerts""", "drift_records", alerts=ALERTS),
    "d18_active_alerts": sql("""SELECT alert_id, feature, day, severity, severity IN ('high', 'critical') AS acknowledged FROM alerts a
        WHERE NOT EXISTS (SELECT 1 FROM drift_records r WHERE r.feature = a.feature AND r.day = a.day + 1 AND NOT r.drift_detected)""", "drift_records", alerts=ALERTS),
    "d18_severity_counts": sql(f"SELECT l.severity, count(a.severity) AS cnt FROM (SELECT {LEVELS} AS severity) l LEFT JOIN alerts a USING (severity) GROUP BY l.severity", "drift_records", alerts=ALERTS),
    "d18_latest_alerts": sql("SELECT alert_id, day, feature, severity FROM alerts ORDER BY day DESC, alert_id LIMIT 5", "drift_records", alerts=ALERTS),
    "d19_alert_summary": sql("""SELECT CASE WHEN grouping(severity) = 0 THEN 'by_severity' WHEN grouping(feature) = 0 THEN 'by_feature' ELSE 'total' END AS section,
        coalesce(severity, feature, 'all') AS name, count(*) AS cnt FROM alerts GROUP BY GROUPING SETS ((severity), (feature), ())""", "drift_records", alerts=ALERTS),
    "d20_record_query": sql("SELECT * FROM drift_records WHERE drift_detected ORDER BY record_id DESC LIMIT 10", "drift_records"),
    "d21_severity_summary": sql("""SELECT l.severity, count(r.severity) AS cnt, (SELECT count(*) FROM drift_records) AS total, (SELECT count(*) FROM drift_records WHERE drift_detected) AS drifted
        FROM (SELECT unnest(['none', 'low', 'medium', 'high', 'critical']) AS severity) l LEFT JOIN drift_records r USING (severity) GROUP BY l.severity""", "drift_records"),
    "d22_feature_summary": sql("""SELECT feature, count(*) AS total_checks, count(*) FILTER (WHERE drift_detected) AS n_drift, count(*) FILTER (WHERE NOT drift_detected) AS n_no_drift,
        arg_max(severity, record_id) AS latest_severity, arg_max(statistic, record_id) AS latest_statistic, arg_max(day, record_id) AS latest_day FROM drift_records GROUP BY feature""", "drift_records"),
    "d23_severity_inference": sql("SELECT record_id, severity FROM drift_records", "drift_records"),
    "d24_half_split": sql("""SELECT feature, n_ref, n_new, round_even(w1, 6) AS w1, round_even(ks, 6) AS ks_statistic, round_even(ks_p, 6) AS ks_p FROM ksp""", **HALVES, **ecdf("halves")),
}
