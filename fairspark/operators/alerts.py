"""Drift alerts and drift records as append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairspark.functions.numeric import count_if, ladder_label
from fairspark.functions.ordering import attach_row

ALERT_LADDER = [(0.50, "critical"), (0.30, "high"), (0.15, "medium")]
ALERT_LEVELS = ["low", "medium", "high", "critical"]
RECORD_LEVELS = ["none", "low", "medium", "high", "critical"]

# Fixed texts per severity.
ADVICE = {
    "low": "Continue monitoring. No action required at this time.",
    "medium": "Investigate the source of drift. Consider updating reference data.",
    "high": "Significant drift detected. Consider model retraining or threshold adjustment.",
    "critical": "Severe drift detected! Immediate model retraining or pipeline reset recommended.",
}


def alert_severity(magnitude: Column) -> Column:
    return ladder_label(magnitude, ALERT_LADDER, "low")


def record_severity(statistic: Column, drifted: Column) -> Column:
    """Severity of a record that carries none: 'none' unless drifted."""
    return F.when(drifted, alert_severity(statistic)).otherwise("none")


def advice(severity: Column) -> Column:
    out = None
    for level, text in ADVICE.items():
        out = F.when(severity == level, F.lit(text)) if out is None else out.when(severity == level, F.lit(text))
    return out


def create_alerts(checks: DataFrame, run_col: str = "run_id", magnitude: str = "w1") -> DataFrame:
    """One alert per drifted check. The id is a hash of (feature, run), so a re-run
    writes the same alert instead of a second one."""
    severity = alert_severity(F.col(magnitude))
    return checks.where("drift_detected").select(
        F.md5(F.concat_ws("|", F.col("feature"), F.col(run_col).cast("string"))).alias("alert_id"),
        F.col(run_col),
        "feature",
        severity.alias("severity"),
        F.col(magnitude).alias("magnitude"),
        advice(severity).alias("recommendation"),
    )


def active_alerts(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Alerts without a resolve event, with their acknowledged flag."""
    resolved = events.where("status = 'resolved'").select("alert_id").distinct()
    seen = events.where("status = 'acknowledged'").select("alert_id", F.lit(True).alias("acknowledged")).distinct()
    out = alerts.join(resolved, "alert_id", "left_anti").join(seen, "alert_id", "left")
    return out.withColumn("acknowledged", F.coalesce("acknowledged", F.lit(False)))


def severity_counts(rows: DataFrame, levels: list[str]) -> DataFrame:
    """Count per severity level with zeros, in one aggregate."""
    one = rows.agg(*[count_if(F.lower("severity") == lv).alias(lv) for lv in levels])
    return one.select(F.inline(F.array(*[F.struct(F.lit(lv).alias("severity"), F.col(lv).alias("cnt")) for lv in levels])))


def latest(rows: DataFrame, order_col: str, n: int = 5) -> DataFrame:
    return rows.orderBy(F.col(order_col).desc(), F.col("alert_id")).limit(n)


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Totals by severity, by feature and overall.

    The overall row is an aggregate of its own: it stands with 0 where there are no alerts, which
    Spark's empty grouping set does not give.
    """
    cells = alerts.groupBy("severity", "feature").agg(F.count("*").alias("n"))
    parts = cells.groupingSets([["severity"], ["feature"]], "severity", "feature").agg(
        F.sum("n").alias("cnt"), F.grouping("severity").alias("by_feature")
    )
    named = parts.select(
        F.when(F.col("by_feature") == 1, "by_feature").otherwise("by_severity").alias("section"),
        F.coalesce("severity", "feature", F.lit("all")).alias("name"),
        "cnt",
    )
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cnt"))
    return named.unionByName(total.select(F.lit("total").alias("section"), F.lit("all").alias("name"), "cnt"))


def query_records(
    records: DataFrame,
    feature: str | None = None,
    detector: str | None = None,
    drifted: bool | None = None,
    severity: str | None = None,
    limit: int = 100,
) -> DataFrame:
    """Equality filters, then the last ``limit`` records by id (ascending)."""
    out = records
    for column, wanted in (("feature", feature), ("detector_type", detector), ("drift_detected", drifted), ("severity", severity)):
        if wanted is not None:
            out = out.where(F.col(column) == F.lit(wanted))
    return out.orderBy(F.col("record_id").desc()).limit(limit).orderBy("record_id")


def record_totals(records: DataFrame) -> DataFrame:
    levels = severity_counts(records, RECORD_LEVELS)
    total = records.agg(F.count("*").alias("total"), count_if(F.col("drift_detected")).alias("drifted"))
    return attach_row(levels, total)


def feature_summary(records: DataFrame) -> DataFrame:
    hit = F.col("drift_detected")
    return records.groupBy("feature").agg(
        F.count("*").alias("total_checks"),
        count_if(hit).alias("n_drift"),
        count_if(~hit).alias("n_no_drift"),
        F.max_by("severity", "record_id").alias("latest_severity"),
        F.max_by("statistic", "record_id").alias("latest_statistic"),
        F.max_by("day", "record_id").alias("latest_day"),
    )
