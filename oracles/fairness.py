"""SQL for the fairness operators."""

from oracles.views import sql

R = "round_even({}, 6)".format
ATTRS = ["o_orderpriority", "c_mktsegment", "l_linestatus"]
TP = "count(*) FILTER (WHERE y_pred = 1 AND y_true = 1)"
FP = "count(*) FILTER (WHERE y_pred = 1 AND y_true = 0)"
FN = "count(*) FILTER (WHERE y_pred = 0 AND y_true = 1)"
TN = "count(*) FILTER (WHERE y_pred = 0 AND y_true = 0)"


def long(view: str, attrs: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS attribute, {a} AS grp, y_true, y_pred, {'y_prob' if view != 'labels_documents' else 'NULL AS y_prob'} FROM {view}"
        for a in attrs
    )


def div(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END)"


COUNTED = f"""SELECT attribute, grp, count(*) AS n, sum(y_pred) AS sp, sum(y_true) AS st, {TP} AS tp, {FP} AS fp, {FN} AS fn, {TN} AS tn,
    count(*) FILTER (WHERE y_pred = y_true) AS correct FROM long GROUP BY attribute, grp"""
DP = """SELECT attribute, grp, round_even(sp / n, 6) AS group_value,
    round_even(sum(sp) OVER (PARTITION BY attribute) / sum(n) OVER (PARTITION BY attribute), 6) AS overall_value FROM counted"""
DP_OUT = """SELECT attribute, 'demographic_parity' AS metric, grp, group_value, overall_value,
    round_even(max(group_value) OVER w - min(group_value) OVER w, 6) AS gap, 0.1::DOUBLE AS threshold,
    max(group_value) OVER w - min(group_value) OVER w <= 0.1::DOUBLE AS is_fair FROM dp WINDOW w AS (PARTITION BY attribute)"""
EO = f"""SELECT attribute, grp, {R(div('tp', '(tp + fn)'))} AS tpr, {R(div('fp', '(fp + tn)'))} AS fpr,
    {R(div('fn', '(tp + fn)'))} AS fnr, {R(div('tn', '(fp + tn)'))} AS tnr FROM counted"""
EO_OUT = """SELECT attribute, 'equalized_odds' AS metric, grp, tpr, fpr, fnr, tnr,
    round_even(max(fpr) OVER w - min(fpr) OVER w, 6) AS fpr_gap, round_even(max(fnr) OVER w - min(fnr) OVER w, 6) AS fnr_gap,
    round_even(greatest(max(fpr) OVER w - min(fpr) OVER w, max(fnr) OVER w - min(fnr) OVER w), 6) AS gap, 0.1::DOUBLE AS threshold,
    greatest(max(fpr) OVER w - min(fpr) OVER w, max(fnr) OVER w - min(fnr) OVER w) <= 0.1::DOUBLE AS is_fair
    FROM eo WINDOW w AS (PARTITION BY attribute)"""
EDGES = [i * 0.1 for i in range(10)] + [1.0]


def bin_case(score: str, close: bool = False) -> str:
    arms = [
        f"WHEN {score} >= {EDGES[i]!r}::DOUBLE AND {score} {'<=' if close and i == 9 else '<'} {EDGES[i + 1]!r}::DOUBLE THEN {i}"
        for i in range(10)
    ]
    return "CASE " + " ".join(arms) + " END"


def cal(score: str) -> dict[str, str]:
    return {
        "bins": f"SELECT attribute, grp, {bin_case(score)} AS b, count(*) AS n, sum({score}) AS ss, sum(y_true) AS st FROM long GROUP BY ALL",
        "cal": "SELECT attribute, grp, CASE WHEN sum(n) < 10 THEN 0.0::DOUBLE ELSE round_even(coalesce(avg(CASE WHEN b IS NOT NULL THEN abs(ss / n - st / n) END), 0), 6) END AS group_value FROM bins GROUP BY attribute, grp",
    }


CAL_OUT = """SELECT attribute, 'calibration' AS metric, grp, group_value, round_even(avg(group_value) OVER w, 6) AS overall_value,
    round_even(max(group_value) OVER w - min(group_value) OVER w, 6) AS gap, 0.1::DOUBLE AS threshold,
    max(group_value) OVER w - min(group_value) OVER w <= 0.1::DOUBLE AS is_fair FROM cal WINDOW w AS (PARTITION BY attribute)"""


def metrics(view: str, attrs: list[str], score: str = "y_pred") -> dict[str, str]:
    return {
        "long": long(view, attrs), "counted": COUNTED, "dp": DP, "eo": EO, **cal(score),
        "dp_out": DP_OUT, "eo_out": EO_OUT, "cal_out": CAL_OUT,
        "results": """SELECT attribute, metric, count(*) AS n_groups, max(overall_value) AS overall_value, max(gap) AS gap, bool_and(is_fair) AS is_fair FROM (
            SELECT attribute, metric, overall_value, gap, is_fair FROM dp_out UNION ALL
            SELECT attribute, metric, gap AS overall_value, gap, is_fair FROM eo_out UNION ALL
            SELECT attribute, metric, overall_value, gap, is_fair FROM cal_out) GROUP BY attribute, metric""",
    }


REPORT = """SELECT attribute, nf > 0 AS is_biased, nf AS n_findings, coalesce(wg, 0.0::DOUBLE) AS worst_gap, wm AS worst_metric,
    CASE WHEN nf = 0 THEN 'NONE' WHEN wg > 0.3 THEN 'CRITICAL' WHEN wg > 0.1 THEN 'MODERATE' ELSE 'MILD' END AS severity,
    CASE WHEN nf = 0 THEN 'No significant bias detected. Continue monitoring.'
      WHEN wg > 0.3 THEN 'CRITICAL: ''' || attribute || ''' shows severe bias (gap=' || printf('%.1f%%', wg * 100) || '). Consider removing or carefully re-encoding this attribute.'
      WHEN wg > 0.1 THEN 'MODERATE: ''' || attribute || ''' shows notable bias (gap=' || printf('%.1f%%', wg * 100) || '). Consider reweighting or adversarial debiasing.'
      ELSE 'MILD: ''' || attribute || ''' shows slight bias (gap=' || printf('%.1f%%', wg * 100) || '). Monitor and consider pre-processing adjustments.' END AS recommendation,
    ov AS odds_violated
    FROM (SELECT attribute, count(*) FILTER (WHERE NOT is_fair) AS nf, max(gap) FILTER (WHERE NOT is_fair) AS wg,
        (list(metric ORDER BY gap DESC, metric) FILTER (WHERE NOT is_fair))[1] AS wm,
        bool_or(NOT is_fair AND metric = 'equalized_odds') AS ov FROM results GROUP BY attribute)"""


def inter(view: str, attrs: list[str]) -> dict[str, str]:
    label = " || '_' || ".join(f"'{a}_' || {a}" for a in attrs)
    keys = ", ".join(attrs)
    return {
        "g": f"""SELECT {label} AS subgroup, count(*) AS n, sum(y_pred) AS sp, {TP} AS tp, {FP} AS fp, {FN} AS fn, {TN} AS tn,
            count(*) FILTER (WHERE y_pred = y_true) AS correct FROM {view} GROUP BY {keys}""",
        "t": "SELECT sum(n) AS an, sum(sp) AS asp, sum(tp) AS atp, sum(fp) AS afp, sum(fn) AS afn, sum(tn) AS atn FROM g",
        "subs": f"""SELECT subgroup, n AS sample_size, n < 5 AS skipped, CASE WHEN n < 5 THEN 'Too few samples' END AS reason,
            CASE WHEN n >= 5 THEN {R('correct::DOUBLE / n')} END AS accuracy, CASE WHEN n >= 5 THEN {R('sp / n')} END AS positive_rate,
            CASE WHEN n >= 5 THEN CASE WHEN an = n THEN 0.0::DOUBLE ELSE round_even(abs({R('sp / n')} - {R(div('asp - sp', '(an - n)'))}), 6) END END AS dp_gap,
            CASE WHEN n >= 5 THEN CASE WHEN an = n THEN 0.0::DOUBLE ELSE round_even(greatest(
              abs({R(div('fp', '(fp + tn)'))} - {R(div('afp - fp', '(afp - fp + atn - tn)'))}),
              abs({R(div('fn', '(fn + tp)'))} - {R(div('afn - fn', '(afn - fn + atp - tp)'))})), 6) END END AS eo_gap
            FROM g, t""",
    }


D = metrics("decisions", ATTRS)
L = metrics("labels_documents", ["lang", "source"])
ROC = {
    "s": "SELECT y_prob AS score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM decisions_order GROUP BY y_prob",
    "c": "SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM s",
    "q": "SELECT *, lag(tp, 1, 0) OVER (ORDER BY score DESC) AS tp0, lag(fp, 1, 0) OVER (ORDER BY score DESC) AS fp0 FROM c",
    "t": "SELECT sum(pos) AS p_all, sum(neg) AS n_all FROM s",
}

ORACLES = {
    "f1_demographic_parity": sql("SELECT * FROM dp_out", "decisions", **{k: v for k, v in metrics("decisions", ["c_mktsegment"]).items() if k in ("long", "counted", "dp", "dp_out")}),
    "f2_equalized_odds": sql("SELECT * FROM eo_out", "decisions", **{k: v for k, v in metrics("decisions", ["o_orderpriority"]).items() if k in ("long", "counted", "eo", "eo_out")}),
    "f3_calibration": sql("SELECT * FROM cal_out", "decisions", **{k: v for k, v in metrics("decisions", ["c_mktsegment"], "y_prob").items() if k in ("long", "bins", "cal", "cal_out")}),
    "f4_expected_calibration_error": sql(
        "SELECT (SELECT sum(n) FROM bins)::BIGINT AS n_rows, round_even(sum(n / (SELECT sum(n) FROM bins) * abs(st / n - ss / n)), 6) AS ece FROM bins WHERE b IS NOT NULL",
        "decisions", bins=f"SELECT {bin_case('y_prob', True)} AS b, count(*) AS n, sum(y_prob) AS ss, sum(y_true) AS st FROM decisions GROUP BY ALL"),
    "f5_raw_differences": sql(
        """SELECT attribute, round_even(max(sp / n) - min(sp / n), 9) AS dp_difference,
        round_even(greatest(max(fp::DOUBLE / greatest(fp + tn, 1)) - min(fp::DOUBLE / greatest(fp + tn, 1)),
        max(fn::DOUBLE / greatest(fn + tp, 1)) - min(fn::DOUBLE / greatest(fn + tp, 1))), 9) AS eo_difference FROM counted GROUP BY attribute""",
        "decisions", long=D["long"], counted=COUNTED),
    "f6_parity_ratio": sql(
        "SELECT attribute, round_even(min(sp / n) / max(sp / n), 6) AS dp_ratio, round_even(min(sp / n) / max(sp / n), 6) >= 0.8 AS is_fair FROM counted GROUP BY attribute",
        "decisions", long=D["long"], counted=COUNTED),
    "f7_all_attributes": sql(
        """SELECT attribute, metric, grp, group_value, gap, is_fair FROM dp_out UNION ALL
        SELECT attribute, metric, grp, greatest(fpr, fnr), gap, is_fair FROM eo_out UNION ALL
        SELECT attribute, metric, grp, group_value, gap, is_fair FROM cal_out""", "decisions", **metrics("decisions", ATTRS, "y_prob")),
    "f8_metric_suite": sql("SELECT * FROM results", "decisions", **D),
    "f9_subgroup_metrics": sql(
        f"""SELECT c_mktsegment AS grp, count(*) AS cnt, {R("count(*)::DOUBLE / (SELECT count(*) FROM decisions)")} AS proportion,
        {R("avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS accuracy, {R("avg(y_pred)")} AS selection_rate,
        {R(div(FP, f'({FP} + {TN})'))} AS false_positive_rate FROM decisions GROUP BY c_mktsegment""", "decisions"),
    "f10_subgroup_by_column": sql(
        f"""SELECT lang AS grp, CASE WHEN grouping(source) = 0 THEN 'source' END AS subgroup_column, source AS subgroup_value, count(*) AS cnt,
        CASE WHEN grouping(source) = 1 THEN {R("count(*)::DOUBLE / (SELECT count(*) FROM labels_documents)")} END AS proportion,
        {R("avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS accuracy, {R("avg(y_pred)")} AS selection_rate,
        CASE WHEN grouping(source) = 1 THEN {R(div(FP, f'({FP} + {TN})'))} END AS false_positive_rate
        FROM labels_documents GROUP BY GROUPING SETS ((lang), (lang, source)) HAVING grouping(source) = 1 OR count(*) >= 5""", "labels_documents"),
    "f11_intersectional": sql("SELECT * FROM subs", "labels_documents", **inter("labels_documents", ["lang", "source"])),
    "f11_intersectional_cube": sql(
        f"""SELECT o_orderpriority, c_mktsegment, l_linestatus, count(*) AS sample_size,
        {R("avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS accuracy, {R("avg(y_pred)")} AS positive_rate
        FROM decisions GROUP BY CUBE (o_orderpriority, c_mktsegment, l_linestatus)""", "decisions"),
    "f12_most_biased_subgroup": sql(
        """SELECT 'positive_rate' AS metric, round_even(max(positive_rate) - min(positive_rate), 6) AS max_gap,
        (list(subgroup ORDER BY positive_rate DESC, subgroup))[1] AS highest_group, (list(subgroup ORDER BY positive_rate, subgroup))[1] AS lowest_group
        FROM subs WHERE positive_rate IS NOT NULL""", "decisions", **inter("decisions", ATTRS)),
    "f13_bias_report": sql("SELECT * FROM report", "labels_documents", **L, report=REPORT),
    "f13_bias_report_summary": sql(
        """SELECT count(*) AS total_attributes, count(*) FILTER (WHERE is_biased) AS biased_attributes, count(*) FILTER (WHERE NOT is_biased) AS fair_attributes,
        NOT bool_or(is_biased) AS overall_fair, max(worst_gap) AS worst_gap,
        (list(CASE WHEN is_biased THEN attribute || '/' || worst_metric END ORDER BY worst_gap DESC, attribute))[1] AS worst_metric,
        CASE WHEN bool_or(odds_violated) THEN 'Equalized odds violations detected. Consider running the threshold sweep to optimize fairness constraints.' END AS odds_advice
        FROM report""", "labels_documents", **L, report=REPORT),
    "f14_full_audit": sql(
        f"""SELECT 'metric' AS section, attribute AS subject, metric AS detail, gap AS value, n_groups AS n, is_fair AS ok FROM results
        UNION ALL SELECT 'report', attribute, recommendation, worst_gap, n_findings, NOT is_biased FROM report
        UNION ALL SELECT 'subgroup', subgroup, reason, positive_rate, sample_size, NULL FROM subs
        UNION ALL SELECT 'subgroup_accuracy', subgroup, reason, accuracy, sample_size, NULL FROM subs
        UNION ALL SELECT 'accuracy', 'overall', NULL, {R("avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")}, count(*), NULL FROM decisions""",
        "decisions", **D, report=REPORT, **inter("decisions", ATTRS)),
    "f16_confusion_metrics": sql(
        f"""SELECT tp, fp, fn, tn, {R('(tp + tn)::DOUBLE / (tp + fp + fn + tn)')} AS accuracy, {R(div('tp', '(tp + fp)'))} AS precision,
        {R(div('tp', '(tp + fn)'))} AS recall, {R(div('2 * tp', '(2 * tp + fp + fn)'))} AS f1
        FROM (SELECT {TP} AS tp, {FP} AS fp, {FN} AS fn, {TN} AS tn FROM decisions)""", "decisions"),
    "f17_auc": sql(
        """SELECT max(p_all)::BIGINT AS positives, max(n_all)::BIGINT AS negatives,
        round_even(sum((fp - fp0) / n_all * (tp + tp0) / p_all / 2), 6) AS roc_auc,
        round_even(sum((tp - tp0) / p_all * (tp / (tp + fp) + CASE WHEN tp0 + fp0 > 0 THEN tp0 / (tp0 + fp0) ELSE 1 END) / 2), 6) AS pr_auc FROM q, t""",
        "decisions_order", **ROC),
    "f17_roc_curve": sql("SELECT score AS threshold, round_even(fp / n_all, 6) AS fpr, round_even(tp / p_all, 6) AS tpr FROM c, t", "decisions_order", **ROC),
    "f18_metric_health": sql(
        """SELECT n AS n_metrics, p AS n_passed, round_even(p::DOUBLE / n * 100, 6) AS score,
        CASE WHEN p * 100.0 / n >= 90 THEN 'OPTIMAL' WHEN p * 100.0 / n >= 80 THEN 'STABLE' WHEN p * 100.0 / n >= 60 THEN 'WARNING' ELSE 'CRITICAL' END AS band
        FROM (SELECT count(*) AS n, count(*) FILTER (WHERE is_fair) AS p FROM results)""", "decisions", **D),
}
