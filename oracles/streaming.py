"""SQL for the streaming operators after all batches are drained."""

from oracles.drift import cusum, ecdf
from oracles.views import sql

S = "drift_shifted"
EV = "SELECT event_type AS feature, ts, value FROM events"

TIMED = """SELECT date_trunc('day', o_orderdate) AS d, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y_true,
    CASE WHEN o_totalprice / 500000.0::DOUBLE >= 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y_pred, c_mktsegment, o_orderpriority
    FROM orders JOIN customer ON o_custkey = c_custkey"""


def fairness(days: int) -> str:
    """Gaps per window of so many days sliding by one, of windows that end at the last watermark or before."""
    return sql("""SELECT strftime(d, '%Y-%m-%d') AS day, attribute, count(*) AS n_groups, sum(n)::BIGINT AS n, round_even(max(rate) - min(rate), 6) AS dp_gap, round_even(max(fpr) - min(fpr), 6) AS fpr_gap,
        round_even(max(fnr) - min(fnr), 6) AS fnr_gap, greatest(round_even(max(fpr) - min(fpr), 6), round_even(max(fnr) - min(fnr), 6)) AS eo_gap,
        round_even(max(rate) - min(rate), 6) <= 0.1 AND greatest(round_even(max(fpr) - min(fpr), 6), round_even(max(fnr) - min(fnr), 6)) <= 0.1 AS is_fair
        FROM cells GROUP BY d, attribute""", timed=TIMED,
        spread="SELECT (unnest([" + ", ".join(f"d - INTERVAL {k} DAY" for k in range(days)) + "])) AS d, y_true, y_pred, c_mktsegment, o_orderpriority FROM timed",
        long="SELECT d, 'c_mktsegment' AS attribute, c_mktsegment AS grp, y_true, y_pred FROM spread UNION ALL SELECT d, 'o_orderpriority', o_orderpriority, y_true, y_pred FROM spread",
        cells=f"""SELECT d, attribute, grp, count(*) AS n, round_even(avg(y_pred), 6) AS rate,
            round_even(coalesce(sum((1 - y_true) * y_pred) / nullif(sum(1 - y_true), 0), 0), 6) AS fpr, round_even(coalesce(sum(y_true * (1 - y_pred)) / nullif(sum(y_true), 0), 0), 6) AS fnr
            FROM long WHERE d + INTERVAL {days} DAY <= (SELECT max(o_orderdate) - INTERVAL 10 MINUTE FROM orders) GROUP BY ALL""")


CUSUM_ROWS = sql("""SELECT feature, seq, round_even(g_pos, 6) AS g_pos, round_even(g_neg, 6) AS g_neg, round_even(statistic, 6) AS statistic,
        CASE WHEN statistic >= 5 THEN 'drift' WHEN statistic >= 3 THEN 'warning' ELSE 'none' END AS status FROM scan""", S, **cusum(S))

ORACLES = {
    "t1_state_store_cusum": CUSUM_ROWS,
    "t2_state_store_windows": sql("""SELECT feature, window_id, count(*) AS n_rows, round_even(avg(value), 6) AS mean, min(seq) AS first_seq, max(seq) AS last_seq
        FROM win WHERE window_id >= 0 GROUP BY ALL HAVING count(*) = 100""", S,
        numbered=f"SELECT feature, seq, value, row_number() OVER (PARTITION BY feature ORDER BY seq) - 1 AS idx FROM {S} WHERE side = 'new'",
        win="SELECT feature, seq, value, unnest([idx // 50, idx // 50 - 1]) AS window_id FROM numbered"),
    "t4_fairness_windows": fairness(1),
    "t4_fairness_sliding": fairness(3),
    "t5_stream_cooldown": sql("SELECT feature, t FROM kept WHERE t <= (SELECT floor(epoch(max(date_trunc('second', ts)))) - 600 FROM events)", recursive=True,
        a="SELECT DISTINCT event_type AS feature, epoch(date_trunc('second', ts))::BIGINT AS t FROM events",
        kept="SELECT feature, min(t) AS t FROM a GROUP BY feature UNION ALL SELECT k.feature, min(a.t) AS t FROM kept k JOIN a ON a.feature = k.feature AND a.t >= k.t + 300 GROUP BY k.feature"),
    "t1_streaming_cusum": sql("""SELECT feature, seq, round_even(g_pos, 6) AS g_pos, round_even(g_neg, 6) AS g_neg, round_even(statistic, 6) AS statistic,
        CASE WHEN statistic >= 5 THEN 'drift' WHEN statistic >= 3 THEN 'warning' ELSE 'none' END AS status FROM scan""", S, **cusum(S)),
    "t2_count_windows": sql("""SELECT feature, window_id, n_rows, round_even(mean, 6) AS mean, first_seq, last_seq, ref_rows, round_even(ref_mean, 6) AS ref_mean FROM (
        SELECT feature, window_id, count(*) AS n_rows, avg(value) AS mean, min(seq) AS first_seq, max(seq) AS last_seq FROM win WHERE window_id >= 0 GROUP BY ALL HAVING count(*) = 100)
        JOIN (SELECT feature, count(*) AS ref_rows, avg(value) AS ref_mean FROM refs WHERE r <= 500 GROUP BY feature) USING (feature)""", S,
        numbered=f"SELECT feature, seq, value, row_number() OVER (PARTITION BY feature ORDER BY seq) - 1 AS idx FROM {S} WHERE side = 'new'",
        win="SELECT feature, seq, value, unnest([idx // 50, idx // 50 - 1]) AS window_id FROM numbered",
        refs=f"SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY seq DESC) AS r FROM {S} WHERE side = 'ref'"),
    "t3_batch_monitor": sql("""SELECT split_part(feature, '#', 2)::INT AS batch, split_part(feature, '#', 1) AS feature, n_new AS n_rows, round_even(w1, 6) AS w1,
        round_even(ks, 6) AS ks_statistic, round_even(ks_p, 6) AS ks_p, round_even(max_statistic, 6) AS max_statistic, coalesce(n_drift_points, 0) AS n_drift_points
        FROM ksp LEFT JOIN cs USING (feature) WHERE n_new > 0""", S,
        ends=f"SELECT min(seq) AS lo, (max(seq) - min(seq)) / 3.0::DOUBLE AS step FROM {S} WHERE side = 'new'",
        batched=f"SELECT feature, seq, side, value, (seq >= lo + step)::INT + (seq >= lo + 2 * step)::INT AS b FROM {S}, ends WHERE side = 'new'",
        runs=f"""SELECT feature || '#' || b AS feature, seq, side, value FROM batched
            UNION ALL SELECT feature || '#' || b, seq, side, value FROM {S}, (SELECT unnest([0, 1, 2]) AS b) WHERE side = 'ref'""",
        **ecdf("runs"), **cusum("runs")),
    "t4_event_time_windows": sql("""SELECT strftime(d, '%Y-%m-%d') AS day, feature, count(*) AS n, round_even(avg(value), 6) AS mean, round_even(stddev_pop(value), 6) AS std
        FROM (SELECT date_trunc('day', ts) AS d, feature, value FROM ev) GROUP BY d, feature
        HAVING d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM ev)""", ev=EV),
    "t4_sliding_windows": sql("""SELECT strftime(d, '%Y-%m-%d') AS day, feature, count(*) AS n, round_even(avg(value), 6) AS mean, round_even(stddev_pop(value), 6) AS std
        FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS d, feature, value FROM ev) GROUP BY d, feature""", ev=EV),
    "t5_alert_cooldown": sql("SELECT feature, t FROM kept", recursive=True,
        a="SELECT DISTINCT event_type AS feature, epoch(date_trunc('second', ts))::BIGINT AS t FROM events",
        kept="SELECT feature, min(t) AS t FROM a GROUP BY feature UNION ALL SELECT k.feature, min(a.t) AS t FROM kept k JOIN a ON a.feature = k.feature AND a.t >= k.t + 300 GROUP BY k.feature"),
}
