"""Streaming detectors over the events table, replayed in order as micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairspark.operators import drift as dr
from fairspark.plans import views
from fairspark.session import scratch_path
from fairspark.streaming import detectors as det
from fairspark.streaming import microbatch as mb
from fairspark.streaming import reference as rf
from fairspark.streaming import stateful as st

N_BATCHES = 3


def _instant():
    """The naive event time as an instant whose UTC clock shows it, in any session zone."""
    return F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())


def _day(col):
    return F.date_format(F.to_utc_timestamp(col, F.current_timezone()), "yyyy-MM-dd").alias("day")


def _new_rows(spark, sf):
    return dr.side(views.drift_long(spark, sf, shifted=True), "new")


def _drive(spark, sf, process, root):
    rows = _new_rows(spark, sf)
    source, checkpoint = f"{root}/source", f"{root}/checkpoint"
    mb.replay(rows, "seq", source, N_BATCHES, lambda: mb.run_available(spark, source, rows.schema, process, checkpoint))
    return mb.read_output(spark, root)


def t1(spark, sf):
    root = scratch_path(spark, "cusum")
    fit = f"{root}/fit"
    dr.reference_fit(views.drift_long(spark, sf, shifted=True)).write.parquet(fit)
    out = _drive(spark, sf, det.cusum_process(fit, root), root)
    return out.select(
        "feature", "seq", F.bround("g_pos", 6).alias("g_pos"), F.bround("g_neg", 6).alias("g_neg"), F.bround("statistic", 6).alias("statistic"), "status"
    )


def t2(spark, sf):
    root = scratch_path(spark, "windows")
    out = _drive(spark, sf, det.window_process(root), root)
    ref = det.reference_window(dr.side(views.drift_long(spark, sf, shifted=True), "ref"))
    return out.join(ref, "feature").select(
        "feature", "window_id", "n_rows", F.bround("mean", 6).alias("mean"), "first_seq", "last_seq", "ref_rows", F.bround("ref_mean", 6).alias("ref_mean")
    )


def t3(spark, sf):
    root = scratch_path(spark, "monitor")
    ref = f"{root}/reference"
    rf.write_reference(dr.side(views.drift_long(spark, sf, shifted=True), "ref"), ref)
    out = _drive(spark, sf, det.monitor_process(ref, root), root)
    return out.select("batch", "feature", "n_rows", *[F.bround(c, 6).alias(c) for c in ("w1", "ks_statistic", "ks_p", "max_statistic")], "n_drift_points")


def t4(spark, sf):
    """One-day event-time windows through the streaming engine, in append mode."""
    root = scratch_path(spark, "eventtime")
    events = views.table(spark, sf, "events").select(F.col("event_type").alias("feature"), _instant().alias("ts"), "value")
    events.write.parquet(f"{root}/source")
    stream = spark.readStream.schema(events.schema).parquet(f"{root}/source")
    query = (
        det.event_time_stats(stream)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.select(
        _day("window_start"), "feature", "n", F.bround("mean", 6).alias("mean"), F.bround("std", 6).alias("std")
    )


def t4_sliding(spark, sf):
    """Two-day windows sliding by a day, as a table."""
    events = views.table(spark, sf, "events").select(F.col("event_type").alias("feature"), _instant().alias("ts"), "value")
    out = det.event_time_stats(events, "2 days", "1 day")
    return out.select(
        _day("window_start"), "feature", "n", F.bround("mean", 6).alias("mean"), F.bround("std", 6).alias("std")
    )


def t5(spark, sf):
    events = views.table(spark, sf, "events")
    alerts = events.select(F.col("event_type").alias("feature"), F.unix_seconds(_instant()).alias("t"))
    return det.alert_cooldown(alerts).select("feature", F.col("t").cast("bigint").alias("t"))


def _arriving(spark, rows, order_col, root, stream):
    """Replay a table in parts; after each, the stream is started again from its checkpoint and drained."""
    mb.replay(rows, order_col, f"{root}/source", N_BATCHES, lambda: st.drain(spark, stream(spark.readStream.schema(rows.schema).parquet(f"{root}/source")), root))
    return mb.read_output(spark, root)


def t1_state(spark, sf):
    """CUSUM with the state in the engine's store."""
    root = scratch_path(spark, "cusumstate")
    fit = f"{root}/fit"
    dr.reference_fit(views.drift_long(spark, sf, shifted=True)).write.parquet(fit)
    out = _arriving(spark, _new_rows(spark, sf), "seq", root, lambda s: st.cusum_stream(s, spark.read.parquet(fit)))
    return out.select("feature", "seq", *[F.bround(c, 6).alias(c) for c in ("g_pos", "g_neg", "statistic")], "status")


def t2_state(spark, sf):
    """Count windows with the state in the engine's store."""
    out = _arriving(spark, _new_rows(spark, sf), "seq", scratch_path(spark, "windowstate"), st.window_stream)
    return out.select("feature", "window_id", "n_rows", F.bround("mean", 6).alias("mean"), "first_seq", "last_seq")


def t5_stream(spark, sf):
    """The cooldown as a stream with timers: alerts up to the last watermark."""
    rows = views.table(spark, sf, "events").select(F.col("event_type").alias("feature"), F.date_trunc("second", _instant()).alias("ts"), "event_id")
    out = _arriving(spark, rows, "event_id", scratch_path(spark, "cooldown"), st.cooldown_stream)
    return out.select("feature", F.col("t").cast("bigint").alias("t"))


def _timed_decisions(spark, sf):
    """Decisions per order with their order time."""
    orders = views.table(spark, sf, "orders")
    customer = views.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.from_utc_timestamp(F.col("o_orderdate").cast("timestamp"), F.current_timezone()).alias("ts"),
        (F.col("o_orderstatus") == "F").cast("double").alias("y_true"),
        (F.col("o_totalprice") / F.lit(500000.0) >= 0.5).cast("double").alias("y_pred"),
        "c_mktsegment",
        "o_orderpriority",
    )


def _fairness(spark, sf, window, slide=None):
    root = scratch_path(spark, "fairness")
    rows = _timed_decisions(spark, sf)
    rows.write.parquet(f"{root}/source")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/source")
    st.drain(spark, st.fairness_windows(stream, ["c_mktsegment", "o_orderpriority"], window, slide), root)
    return mb.read_output(spark, root).select(
        _day("window_start"), "attribute", "n_groups", "n", "dp_gap", "fpr_gap", "fnr_gap", "eo_gap", "is_fair"
    )


def t4_fairness(spark, sf):
    """Group fairness per day of the orders, through the streaming engine in append mode."""
    return _fairness(spark, sf, "1 day")


def t4_fairness_sliding(spark, sf):
    """The same over three days, sliding by one."""
    return _fairness(spark, sf, "3 days", "1 day")


QUERIES = {
    "t1_state_store_cusum": t1_state,
    "t2_state_store_windows": t2_state,
    "t4_fairness_windows": t4_fairness,
    "t4_fairness_sliding": t4_fairness_sliding,
    "t5_stream_cooldown": t5_stream,
    "t1_streaming_cusum": t1,
    "t2_count_windows": t2,
    "t3_batch_monitor": t3,
    "t4_event_time_windows": t4,
    "t4_sliding_windows": t4_sliding,
    "t5_alert_cooldown": t5,
}
