"""SQL for the mitigation operators."""

from fairspark.plans.mitigation_queries import BIAS, COEFFICIENTS, OFFSETS, WEIGHTS
from oracles.fairness import metrics
from oracles.text_bias import BASE, INDEX
from oracles.views import sql


def evaluated(view: str, group: str, offsets: list[float]) -> dict[str, str]:
    cands = ", ".join(f"({i}::INT, {0.5 + o * 0.1!r}::DOUBLE)" for i, o in enumerate(offsets))
    return {
        "cand": f"SELECT * FROM (VALUES {cands}) t(candidate, threshold)",
        "pg": f"""SELECT candidate, threshold, {group} AS grp, avg(hit) AS rate, count(*) AS n, avg(hit) FILTER (WHERE y_true = 1) AS tpr, avg(hit) FILTER (WHERE y_true = 0) AS fpr,
            sum((hit = y_true)::INT) AS correct, sum(abs(y_prob - y_true)) AS ae
            FROM (SELECT *, (y_prob >= threshold)::INT::DOUBLE AS hit FROM {view}, cand) GROUP BY ALL""",
        "ev": """SELECT candidate, threshold, round_even(sum(correct)::DOUBLE / sum(n), 6) AS accuracy, round_even(max(rate) - min(rate), 6) AS dp_gap,
            round_even(greatest(max(coalesce(tpr, 0)) - min(coalesce(tpr, 0)), max(coalesce(fpr, 0)) - min(coalesce(fpr, 0))), 6) AS eo_gap,
            round_even(sum(ae) / sum(n), 6) AS calibration_error FROM pg GROUP BY candidate, threshold""",
    }


def swept(dp: float, eo: float) -> str:
    return f"""SELECT *, candidate = (SELECT candidate FROM comp ORDER BY composite DESC, candidate LIMIT 1) AS is_best FROM comp"""


def comp(dp: float, eo: float) -> str:
    return f"""SELECT *, round_even(accuracy - 0.5::DOUBLE * dp_gap - 0.5::DOUBLE * eo_gap, 6) AS composite, dp_gap <= {dp}::DOUBLE AND eo_gap <= {eo}::DOUBLE AND accuracy >= 0.55::DOUBLE AS target_reached FROM ev"""


Z = f"{BIAS!r}::DOUBLE + f0 * ({COEFFICIENTS[0]!r}::DOUBLE * w0) + f1 * ({COEFFICIENTS[1]!r}::DOUBLE * w1) + f2 * ({COEFFICIENTS[2]!r}::DOUBLE * w2)"
WCAND = ", ".join(f"({i}::INT, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for i, (a, b, c) in enumerate(WEIGHTS))


def dominated(a: str, b: str) -> str:
    """a dominates b"""
    e = "1e-6"
    low = ["dp_gap", "eo_gap", "calibration_error"]
    ok = " AND ".join([f"{a}.accuracy >= {b}.accuracy - {e}"] + [f"{a}.{c} <= {b}.{c} + {e}" for c in low])
    strict = " OR ".join([f"{a}.accuracy > {b}.accuracy + {e}"] + [f"{a}.{c} < {b}.{c} - {e}" for c in low])
    return f"({ok} AND ({strict}))"


def front(view: str) -> str:
    return f"SELECT * FROM {view} b WHERE NOT EXISTS (SELECT 1 FROM {view} a WHERE {dominated('a', 'b')})"


CHANGES = {
    "changes": "SELECT * FROM (SELECT *, lag(accuracy) OVER w AS pa, lag(dp_gap) OVER w AS pd, lag(eo_gap) OVER w AS pe, lag(calibration_error) OVER w AS pc FROM history WINDOW w AS (PARTITION BY run ORDER BY step)) WHERE pa IS NOT NULL",
    "parts": """SELECT run, step, 0.3::DOUBLE * (accuracy - pa) * 100 AS accuracy_reward, 0.25::DOUBLE * (pd - dp_gap) * 10 AS dp_reward, 0.25::DOUBLE * (pe - eo_gap) * 10 AS eo_reward,
        0.2::DOUBLE * (pc - calibration_error) * 10 AS calibration_reward, CASE WHEN accuracy - pa < -0.02::DOUBLE THEN -5.0::DOUBLE * (abs(accuracy - pa) - 0.02::DOUBLE) * 100 ELSE 0.0::DOUBLE END
          - 0.01::DOUBLE * ((accuracy - pa) * (accuracy - pa) + (dp_gap - pd) * (dp_gap - pd)) AS penalty FROM changes""",
    "rewards": "SELECT *, accuracy_reward + dp_reward + eo_reward + calibration_reward + penalty AS total_reward FROM parts",
    "degr": """SELECT run, step, accuracy, (pa - accuracy) / greatest(abs(pa), 1e-8) AS d_accuracy, (dp_gap - pd) / greatest(abs(pd), 1e-8) AS d_dp_gap,
        (eo_gap - pe) / greatest(abs(pe), 1e-8) AS d_eo_gap, (calibration_error - pc) / greatest(abs(pc), 1e-8) AS d_calibration_error FROM changes""",
    "guard": """SELECT run, step, round_even(d_accuracy, 6) AS d_accuracy, round_even(d_dp_gap, 6) AS d_dp_gap, round_even(d_eo_gap, 6) AS d_eo_gap, round_even(d_calibration_error, 6) AS d_calibration_error,
        degraded, CASE WHEN degraded = '' THEN 'safe' WHEN greatest(d_accuracy, d_dp_gap, d_eo_gap, d_calibration_error) > 0.5 OR (accuracy < 0.6 AND 0.6 - accuracy > 0.5) THEN 'unsafe' ELSE 'warning' END AS alert_level
        FROM (SELECT *, concat_ws(',', CASE WHEN d_accuracy > 0.3 THEN 'accuracy' END, CASE WHEN d_dp_gap > 0.3 THEN 'dp_gap' END, CASE WHEN d_eo_gap > 0.3 THEN 'eo_gap' END,
          CASE WHEN d_calibration_error > 0.3 THEN 'calibration_error' END, CASE WHEN accuracy < 0.6 THEN 'accuracy_below_floor' END) AS degraded FROM degr)""",
}


def by_source(which: str) -> str:
    return f"""SELECT source || '_quality' AS metric, round_even(avg(y_true), 6) AS value FROM labels_documents WHERE lang {which} GROUP BY source
        UNION ALL SELECT source || '_error', round_even(avg(abs(y_true - y_pred)), 6) FROM labels_documents WHERE lang {which} GROUP BY source"""


COMPARE = """SELECT metric, before, after, round_even(after - before, 6) AS change, round_even(CASE WHEN abs(before) > 1e-10 THEN (after - before) / abs(before) * 100 WHEN after IS NOT NULL AND before IS NOT NULL THEN 0.0::DOUBLE END, 2) AS pct_change,
    CASE WHEN before IS NULL THEN 'new' WHEN after IS NULL THEN 'removed' WHEN abs(after - before) < 1e-8 THEN 'unchanged'
      WHEN (metric LIKE '%error%' AND after < before) OR (metric NOT LIKE '%error%' AND after > before) THEN 'improved' ELSE 'regressed' END AS direction
    FROM (SELECT metric, value AS before FROM b4) FULL OUTER JOIN (SELECT metric, value AS after FROM af) USING (metric)"""
SUMMARY = f"""SELECT 3::BIGINT AS n_modules, (SELECT round_even(avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) FROM decisions) AS accuracy,
    (SELECT gap FROM results WHERE metric = 'demographic_parity') AS dp_gap, (SELECT gap FROM results WHERE metric = 'equalized_odds') AS eo_gap,
    (SELECT count(*) FILTER (WHERE sev <> 'none') FROM latest) AS n_drifted,
    (SELECT arg_max(sev, list_position(['none', 'low', 'medium', 'high', 'critical'], sev)) FROM latest) AS drift_severity, (SELECT {INDEX} FROM scored) AS bias_index"""
MODULES = {
    **metrics("decisions", ["c_mktsegment"]), **BASE,
    "latest": "SELECT feature, arg_max(severity, record_id) AS sev FROM drift_records GROUP BY feature",
    "base": SUMMARY,
    "summ": "SELECT *, greatest(dp_gap, eo_gap) AS worst_fairness_gap FROM base",
}
GRID = [0.1 + i * 0.05 for i in range(16)]
BEST = {
    "tested": f"""SELECT grp, i, t, count(*) AS n, avg(((y_prob >= t)::INT = y_true)::INT) AS acc FROM decisions_order,
        (VALUES {", ".join(f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(GRID))}) g(i, t) GROUP BY grp, i, t""",
    "best": """SELECT grp, n, round_even(CASE WHEN acc > 0 THEN t ELSE 0.5::DOUBLE END, 3) AS threshold, round_even(acc, 6) AS accuracy FROM (
        SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round_even(acc, 12) DESC, i) AS r FROM tested) WHERE r = 1""",
}
MULT = f"""SELECT run, step, CASE WHEN EXISTS (SELECT 1 FROM fr f WHERE {dominated('h', 'f')}) THEN 1.5::DOUBLE WHEN EXISTS (SELECT 1 FROM fr f WHERE {dominated('f', 'h')}) THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS multiplier FROM history h"""

ORACLES = {
    "m1_evaluate_offsets": sql("SELECT * FROM ev", "decisions", **evaluated("decisions", "l_linestatus", OFFSETS)),
    "m2_threshold_sweep": sql(swept(0.05, 0.05), "decisions", **evaluated("decisions", "l_linestatus", OFFSETS), comp=comp(0.05, 0.05)),
    "u6_sweep_callback": sql(swept(0.1, 0.1), "decisions_order", **evaluated("decisions_order", "grp", [-0.5, -0.25, 0.0, 0.25, 0.5]), comp=comp(0.1, 0.1)),
    "m3_weight_sweep": sql(
        """SELECT candidate, round_even(sum(correct)::DOUBLE / sum(n), 6) AS accuracy, round_even(max(rate) - min(rate), 6) AS dp_gap,
        round_even(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)), 6) AS eo_gap, round_even(sum(ae) / sum(n), 6) AS calibration_error FROM pg GROUP BY candidate""",
        scored=f"""SELECT candidate, l_linestatus AS grp, y_true, {Z} AS z FROM (SELECT (l_returnflag = 'R')::INT::DOUBLE AS y_true, l_linestatus, l_quantity / 50.0::DOUBLE AS f0,
            l_discount * 10.0::DOUBLE AS f1, l_tax * 10.0::DOUBLE AS f2 FROM lineitem), (VALUES {WCAND}) c(candidate, w0, w1, w2)""",
        pg="""SELECT candidate, grp, count(*) AS n, avg((z >= 0)::INT) AS rate, avg((z >= 0)::INT) FILTER (WHERE y_true = 1) AS tpr, avg((z >= 0)::INT) FILTER (WHERE y_true = 0) AS fpr,
            sum(((z >= 0)::INT = y_true)::INT) AS correct, sum(abs(1 / (1 + exp(-z)) - y_true)) AS ae FROM scored GROUP BY candidate, grp"""),
    "m4_pareto_front": sql("""SELECT * FROM fr """, "history", fr=front("history")),
    "m5_pareto_multiplier": sql(MULT, "history", fr=front("history")),
    "m6_rewards": sql("SELECT run, step, " + ", ".join(f"round_even({c}, 9) AS {c}" for c in ("accuracy_reward", "dp_reward", "eo_reward", "calibration_reward", "penalty", "total_reward")) + " FROM rewards", "history", **CHANGES),
    "m7_normalised_rewards": sql("""SELECT run, step, round_even(total_reward, 9) AS total_reward, round_even(CASE WHEN stddev_pop(total_reward) OVER w < 1e-8 THEN 0.0::DOUBLE
        ELSE (total_reward - avg(total_reward) OVER w) / stddev_pop(total_reward) OVER w END, 6) AS normalised FROM rewards WINDOW w AS (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING)""", "history", **CHANGES),
    "m8_goodhart_guard": sql("SELECT * FROM guard", "history", **CHANGES),
    "m8_guarded_reward": sql("""SELECT run, step, alert_level, round_even(total_reward - abs(total_reward) * CASE alert_level WHEN 'warning' THEN 0.3::DOUBLE WHEN 'unsafe' THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END, 9) AS adjusted_reward
        FROM rewards JOIN guard USING (run, step)""", "history", **CHANGES),
    "m9_metric_trend": sql("""SELECT run, step, accuracy, round_even(CASE WHEN count(*) OVER w < 2 THEN 0.0::DOUBLE ELSE regr_slope(accuracy, rn) OVER w END, 9) AS slope, round_even(avg(accuracy) OVER w, 9) AS mean, round_even(stddev_pop(accuracy) OVER w, 9) AS std
        FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS rn FROM history) WINDOW w AS (PARTITION BY run ORDER BY step ROWS 9 PRECEDING)""", "history"),
    "m10_compare_metrics": sql(COMPARE, "labels_documents", b4=by_source("<= 'en'"), af=by_source("> 'en'")),
    "m10_comparison_counts": sql("SELECT " + ", ".join(f"count(*) FILTER (WHERE direction = '{d}') AS n_{d}" for d in ("improved", "regressed", "unchanged", "new", "removed")) + " FROM cmp",
        "labels_documents", b4=by_source("<= 'en'"), af=by_source("> 'en'"), cmp=COMPARE),
    "m11_health": sql("""SELECT CASE WHEN n_drifted > 0 AND drift_severity IN ('high', 'critical') THEN 'degraded' WHEN (n_drifted > 0 AND drift_severity = 'medium') OR dp_gap > 0.2 OR eo_gap > 0.2 THEN 'warning' ELSE 'healthy' END AS status,
        CASE WHEN n_drifted > 0 AND drift_severity IN ('high', 'critical') THEN 'Drift severity: ' || drift_severity ELSE '' END AS issues,
        concat_ws('; ', CASE WHEN n_drifted > 0 AND drift_severity = 'medium' THEN 'Drift severity: medium' END, CASE WHEN dp_gap > 0.2 OR eo_gap > 0.2 THEN printf('High fairness gap: DP=%.3f, EO=%.3f', dp_gap, eo_gap) END) AS warnings FROM summ""",
        "decisions", "drift_records", "pairs", **MODULES),
    "m12_module_summary": sql("SELECT * FROM summ", "decisions", "drift_records", "pairs", **MODULES),
    "m13_oversample": sql("""SELECT row_id, grp, copy FROM (SELECT row_id, grp, unnest(range(1, (mx // n + CASE WHEN r <= mx % n THEN 1 ELSE 0 END + 1)::BIGINT)) AS copy FROM (
        SELECT row_id, grp, n, max(n) OVER () AS mx, r FROM (SELECT row_id, grp, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY md5(row_id || '|42'), row_id) AS r FROM decisions_order)))""", "decisions_order"),
    "m13_resample": sql("""SELECT p.row_id, p.grp, d.copy FROM (SELECT grp, n, mx, unnest(range(1, mx + 1)) AS copy FROM sized WHERE n < mx) d
        JOIN placed p ON p.grp = d.grp AND p.place = ('0x' || substring(md5(d.grp || '|' || d.copy || '|42'), 1, 13))::BIGINT % d.n + 1
        UNION ALL SELECT row_id, grp, 1::BIGINT FROM decisions_order JOIN sized USING (grp) WHERE n = mx""", "decisions_order",
        sized="SELECT grp, count(*) AS n, max(count(*)) OVER () AS mx FROM decisions_order GROUP BY grp",
        placed="SELECT row_id, grp, row_number() OVER (PARTITION BY grp ORDER BY substring(md5(row_id || '|42'), 1, 13), row_id) AS place FROM decisions_order"),
    "m14_group_thresholds": sql("SELECT * FROM best", "decisions_order", **BEST),
    "m15_apply_thresholds": sql("SELECT row_id, d.grp, (y_prob >= threshold)::INT::DOUBLE AS fair_pred FROM decisions_order d JOIN best b ON d.grp = b.grp", "decisions_order", **BEST),
    "m16_fairness_weights": sql("SELECT grp, n, round_even(w / (sum(w * n) OVER () / sum(n) OVER ()), 6) AS weight FROM (SELECT grp, count(*) AS n, max(count(*)) OVER ()::DOUBLE / count(*) AS w FROM decisions_order GROUP BY grp)", "decisions_order"),
    "m16_sample_weights": sql("SELECT row_id, grp, round_even(w / avg(w) OVER (), 6) AS weight FROM (SELECT row_id, grp, max(n) OVER ()::DOUBLE / n AS w FROM (SELECT row_id, grp, count(*) OVER (PARTITION BY grp) AS n FROM decisions_order))", "decisions_order"),
    "m17_choose_fix": sql("""SELECT name, bias_index, CASE WHEN dp > 0.5 THEN CASE WHEN bias_index > 60 THEN 'preprocessing' ELSE 'reweighting' END WHEN eo > 0.3 THEN 'threshold' WHEN bias_index > 50 THEN 'preprocessing' ELSE 'reweighting' END AS fix_type,
        CASE WHEN bias_index > 70 THEN printf('Expected to reduce bias index by 50-70%% (from %.0f to ~%.0f-%.0f)', bias_index, round_even(bias_index * 0.5::DOUBLE, 0), round_even(bias_index * 0.7::DOUBLE, 0))
          WHEN bias_index > 40 THEN printf('Expected to reduce bias index by 40-60%% (from %.0f to ~%.0f-%.0f)', bias_index, round_even(bias_index * 0.6::DOUBLE, 0), round_even(bias_index * 0.8::DOUBLE, 0))
          ELSE printf('Expected to reduce bias index by 30-50%% (from %.0f to ~%.0f-%.0f)', bias_index, round_even(bias_index * 0.7::DOUBLE, 0), round_even(bias_index * 0.9::DOUBLE, 0)) END AS expected
        FROM (SELECT source AS name, round_even(max(rate) - min(rate), 6) AS dp, round_even(max(err) - min(err), 6) AS eo, round_even(avg(err) * 100, 2) AS bias_index FROM (
          SELECT source, lang, avg(y_pred) AS rate, avg(abs(y_true - y_pred)) AS err FROM labels_documents GROUP BY source, lang) GROUP BY source)""", "labels_documents"),
}
