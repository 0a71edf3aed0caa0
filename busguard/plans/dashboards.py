"""Dashboard and report queries over the alert table.

Each is one scan with partial aggregation; the time bucket (the dashboard UI's choice in the
reference) is a ``date_trunc`` unit, returned as text ``yyyy-MM-dd HH:mm:ss``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busguard.operators import quantiles
from busguard.operators.evaluate import safe_divide


def bucket(unit: str = "day", column: str = "timestamp") -> Column:
    return F.date_format(F.date_trunc(unit, F.col(column)), "yyyy-MM-dd HH:mm:ss").alias("bucket")


def filtered(alerts: DataFrame, vehicle_id: str | None = None, label: str | None = None,
             phase: str | None = None) -> DataFrame:
    """Dashboard controls: vehicle, label and detector phase filters."""
    out = alerts
    if vehicle_id is not None:
        out = out.filter(F.col("vehicle_id") == vehicle_id)
    if label is not None:
        out = out.filter(F.col("attack_type_label") == label)
    if phase is not None:
        out = out.filter(F.col("detector_phase") == phase)
    return out


def executive_kpis(alerts: DataFrame) -> DataFrame:
    """Totals, anomalies, attack events, false positives, average latency."""
    lab, anom = F.col("attack_type_label"), F.col("is_anomaly")
    return alerts.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(anom).alias("total_anomalies"),
        F.count_if(lab != "normal").alias("attack_events"),
        F.count_if((lab == "normal") & anom).alias("false_positives"),
        F.round(F.avg("pipeline_latency_ms"), 6).alias("avg_latency_ms"),
    )


def events_over_time(alerts: DataFrame, unit: str = "day") -> DataFrame:
    """Counts per bucket and label."""
    return alerts.groupBy(bucket(unit), "attack_type_label").agg(F.count(F.lit(1)).alias("events"))


def anomalies_over_time(alerts: DataFrame, unit: str = "day") -> DataFrame:
    """D3: anomalies per bucket."""
    return alerts.filter(F.col("is_anomaly")).groupBy(bucket(unit)).agg(F.count(F.lit(1)).alias("anomalies"))


def attack_mix(alerts: DataFrame) -> DataFrame:
    """Events per label and share of all events (share from one partial-aggregated total)."""
    counts = alerts.groupBy("attack_type_label").agg(F.count(F.lit(1)).alias("events"))
    from pyspark.sql import Window
    total = F.sum("events").over(Window.partitionBy())  # one row per label
    return counts.withColumn("share", F.round(F.col("events") / total, 6))


def score_by_attack(alerts: DataFrame) -> DataFrame:
    """Anomaly score quartiles, median and mean per label.  The percentiles are exact and come
    from ``quantiles.exact_percentiles``: a label holding most frames is not gathered in one task."""
    scores = alerts.select("attack_type_label", "anomaly_score").filter(F.col("anomaly_score").isNotNull()).persist()
    counts = scores.groupBy("attack_type_label").agg(F.count(F.lit(1)).alias("n"), F.avg("anomaly_score").alias("_m"))
    q = quantiles.exact_percentiles(scores, ["attack_type_label"], "anomaly_score", [0.25, 0.5, 0.75])
    return q.join(counts, "attack_type_label").select(
        "attack_type_label", (F.round("p0", 6) + F.lit(0.0)).alias("q1_score"),
        (F.round("p1", 6) + F.lit(0.0)).alias("median_score"), (F.round("p2", 6) + F.lit(0.0)).alias("q3_score"),
        (F.round("_m", 6) + F.lit(0.0)).alias("avg_score"))


def dos_scope(alerts: DataFrame) -> DataFrame:
    """Dashboard-level filter of the DoS view: label dos or flood id."""
    return alerts.filter((F.col("attack_type_label") == "dos") | (F.col("arbitration_id") == "0x000"))


def dos_kpis(alerts: DataFrame) -> DataFrame:
    """DoS events and DoS detected, inside the DoS scope."""
    scope = dos_scope(alerts)
    dos = F.col("attack_type_label") == "dos"
    return scope.agg(F.count_if(dos).alias("dos_events"), F.count_if(dos & F.col("is_anomaly")).alias("dos_detected"))


def dos_trends(alerts: DataFrame, unit: str = "day") -> DataFrame:
    """Per bucket averages of the flood features."""
    f = lambda c: F.round(F.avg(F.col(f"features.{c}")), 6).alias(f"avg_{c}")
    return dos_scope(alerts).groupBy(bucket(unit)).agg(
        f("dominant_id_ratio"), f("id_entropy_1s"), f("bus_frequency_1s"), f("bus_utilization"),
        f("payload_repeat_ratio"), f("arbitration_priority_score"))


def top_arbitration_ids(alerts: DataFrame, size: int = 10) -> DataFrame:
    """Top ids by frame count inside the DoS scope (ties by id)."""
    return (dos_scope(alerts).groupBy("arbitration_id").agg(F.count(F.lit(1)).alias("frames"))
            .orderBy(F.col("frames").desc(), F.col("arbitration_id")).limit(size))


def replay_scope(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("attack_type_label") == "replay")


def replay_kpis(alerts: DataFrame) -> DataFrame:
    """Replay events and detected."""
    return replay_scope(alerts).agg(F.count(F.lit(1)).alias("replay_events"),
                                    F.count_if(F.col("is_anomaly")).alias("replay_detected"))


def replay_trend(alerts: DataFrame, unit: str = "day") -> DataFrame:
    """Replay frames per bucket split by the anomaly flag."""
    return replay_scope(alerts).groupBy(bucket(unit), "is_anomaly").agg(F.count(F.lit(1)).alias("events"))


def replay_timing_trends(alerts: DataFrame, unit: str = "day") -> DataFrame:
    """Per bucket averages of gap mean, gap std and payload repeat ratio."""
    f = lambda c: F.round(F.avg(F.col(f"features.{c}")), 6).alias(f"avg_{c}")
    return replay_scope(alerts).groupBy(bucket(unit)).agg(
        f("rolling_interarrival_mean"), f("rolling_interarrival_std"), f("payload_repeat_ratio"))


def replay_id_mix(alerts: DataFrame) -> DataFrame:
    """Replay frames per arbitration id."""
    return replay_scope(alerts).groupBy("arbitration_id").agg(F.count(F.lit(1)).alias("frames"))


def score_histogram(alerts: DataFrame, width: float = 0.05) -> DataFrame:
    """Anomaly score histogram with fixed bucket width."""
    b = F.round(F.floor(F.col("anomaly_score") / F.lit(width)) * F.lit(width), 6).alias("score_bucket")
    return alerts.groupBy(b).agg(F.count(F.lit(1)).alias("frames"))


def latency_over_time(alerts: DataFrame, unit: str = "day") -> DataFrame:
    """Average pipeline latency per bucket."""
    return alerts.groupBy(bucket(unit)).agg(F.round(F.avg("pipeline_latency_ms"), 6).alias("avg_latency_ms"))


def kql_detection_rates(alerts: DataFrame) -> DataFrame:
    """Detection rate and false-positive rate as plain count ratios (no scored filter)."""
    lab, anom = F.col("attack_type_label"), F.col("is_anomaly")
    row = alerts.agg(F.count_if((lab != "normal") & anom).alias("attack_detected"),
                     F.count_if(lab != "normal").alias("attack_total"),
                     F.count_if((lab == "normal") & anom).alias("normal_flagged"),
                     F.count_if(lab == "normal").alias("normal_total"))
    return row.withColumns({
        "detection_rate": F.round(safe_divide(F.col("attack_detected"), F.col("attack_total")), 6),
        "false_positive_rate": F.round(safe_divide(F.col("normal_flagged"), F.col("normal_total")), 6),
    })


def latest_alerts(alerts: DataFrame, k: int = 5) -> DataFrame:
    """the latest k records by time (id tiebreak) — a top-k, not a global sort."""
    return alerts.orderBy(F.col("timestamp").desc(), F.col("sequence").desc()).limit(k)
