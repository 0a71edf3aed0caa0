"""Evaluation over alerts.

The reference sends 15 count requests; here one conditional aggregation scans the alerts once
(partial aggregation on every task, one row shuffled), and a ``stack`` turns the row into the
report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busguard.schema import ATTACK_TYPES, REPORT_COLUMNS, REQUIRED_LABELS


def scored_events(alerts: DataFrame) -> DataFrame:
    """F2: frames whose ``benchmark_scored`` is missing or true."""
    return alerts.filter(F.col("benchmark_scored").isNull() | F.col("benchmark_scored"))


def in_time_range(alerts: DataFrame, start=None, end=None, column: str = "timestamp") -> DataFrame:
    """inclusive optional bounds on the timestamp."""
    out = alerts
    if start is not None:
        out = out.filter(F.col(column) >= F.lit(start))
    if end is not None:
        out = out.filter(F.col(column) <= F.lit(end))
    return out


def safe_divide(n: Column, d: Column) -> Column:
    """0 when the denominator is 0."""
    return F.when(d != 0, n.cast("double") / d).otherwise(F.lit(0.0))


def confusion_counts(alerts: DataFrame, start=None, end=None) -> DataFrame:
    """A5: one row, the 15 counts (per label: total, flagged, not flagged) in one scan."""
    scored = in_time_range(scored_events(alerts), start, end)
    lab = F.col("attack_type_label")
    aggs = []
    for name in REQUIRED_LABELS:
        aggs += [F.count_if(lab == name).alias(f"{name}_total"),
                 F.count_if((lab == name) & (F.col("is_anomaly") == True)).alias(f"{name}_pos"),  # noqa: E712
                 F.count_if((lab == name) & (F.col("is_anomaly") == False)).alias(f"{name}_neg")]  # noqa: E712
    return scored.agg(*aggs)


def metrics(tp: Column, tn: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """A6 formulas (precision, recall, f1, FPR, detection rate = recall, accuracy)."""
    precision = safe_divide(tp, tp + fp)
    recall = safe_divide(tp, tp + fn)
    f1 = F.when(precision + recall != 0, safe_divide(F.lit(2.0) * precision * recall, precision + recall)) \
        .otherwise(F.lit(0.0))
    return {
        "detection_rate": recall,
        "precision": precision,
        "recall": recall,
        "f1": f1,
        "false_positive_rate": safe_divide(fp, fp + tn),
        "accuracy": safe_divide(tp + tn, tp + tn + fp + fn),
    }


def detection_report(alerts: DataFrame, start=None, end=None) -> DataFrame:
    """One row per attack type, then ``overall`` (blank total), REPORT_COLUMNS + ``ord``."""
    counts = confusion_counts(alerts, start, end)
    tp_sum = " + ".join(f"{a}_pos" for a in ATTACK_TYPES)
    fn_sum = " + ".join(f"{a}_neg" for a in ATTACK_TYPES)
    items = [f"{i}, '{a}', {a}_total, {a}_pos, {a}_neg" for i, a in enumerate(ATTACK_TYPES)]
    items.append(f"{len(ATTACK_TYPES)}, 'overall', cast(null as bigint), {tp_sum}, {fn_sum}")
    # one aggregation, one stack: every report row comes from the same single scan
    rows = counts.selectExpr(f"stack({len(items)}, {', '.join(items)}) as (ord, attack_type, total, tp, fn)",
                             "normal_neg as tn", "normal_pos as fp")
    rows = rows.withColumns(metrics(F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn")))
    return rows.select("ord", *REPORT_COLUMNS)


def label_counts(alerts: DataFrame, size: int = 20) -> DataFrame:
    """Terms aggregation on the label, top ``size`` by count (ties by label)."""
    return (alerts.groupBy("attack_type_label").agg(F.count(F.lit(1)).alias("doc_count"))
            .orderBy(F.col("doc_count").desc(), F.col("attack_type_label")).limit(size))


def label_by_anomaly(alerts: DataFrame) -> DataFrame:
    """Nested terms label x is_anomaly."""
    return alerts.groupBy("attack_type_label", "is_anomaly").agg(F.count(F.lit(1)).alias("doc_count"))


def missing_labels(alerts: DataFrame) -> DataFrame:
    """Required labels with no alert."""
    spark = alerts.sparkSession
    required = spark.createDataFrame([(x,) for x in REQUIRED_LABELS], "label string")
    present = alerts.groupBy(F.col("attack_type_label").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return required.join(present.filter(F.col("n") > 0), "label", "left_anti")


def zero_totals(report: DataFrame) -> DataFrame:
    """Attack classes without a scored event in the report."""
    return report.filter((F.col("attack_type") != "overall") & (F.coalesce("total", F.lit(0)) <= 0)) \
        .select(F.col("attack_type").alias("label"))


def count_reconciliation(produced: DataFrame, alerts: DataFrame, low: float = 0.98, high: float = 1.02) -> DataFrame:
    """A10: indexed total within [int(expected*low), int(expected*high)] of the produced total."""
    both = produced.select(F.col("frames").cast("bigint").alias("_e"), F.lit(0).cast("bigint").alias("_i")) \
        .unionByName(alerts.select(F.lit(0).cast("bigint").alias("_e"), F.lit(1).cast("bigint").alias("_i")))
    row = both.agg(F.coalesce(F.sum("_e"), F.lit(0)).cast("bigint").alias("expected_total"),
                   F.coalesce(F.sum("_i"), F.lit(0)).cast("bigint").alias("indexed_total"))
    row = row.withColumns({
        "lower_bound": F.floor(F.col("expected_total") * F.lit(low)).cast("bigint"),
        "upper_bound": F.floor(F.col("expected_total") * F.lit(high)).cast("bigint"),
    })
    return row.withColumn("within_bounds", (F.col("indexed_total") >= F.col("lower_bound"))
                          & (F.col("indexed_total") <= F.col("upper_bound")))


def ingest_lag(end_offsets: DataFrame, committed: DataFrame) -> DataFrame:
    """Per partition max(0, end - coalesce(committed, 0)), plus ``total_lag`` over all."""
    j = end_offsets.join(committed, ["topic", "partition"], "left")
    lag = F.greatest(F.lit(0), F.col("end_offset") - F.coalesce(F.col("committed"), F.lit(0)))
    out = j.select("topic", "partition", "end_offset", "committed", lag.cast("bigint").alias("lag"))
    return out.withColumn("total_lag", F.sum("lag").over(Window.partitionBy()))


def quality_gates(report: DataFrame, min_f1: float = 0.99, min_precision: float = 0.99,
                  max_fpr: float = 0.005, min_replay_recall: float = 0.99) -> DataFrame:
    """One row with the gate values and the list of failure messages (empty = pass)."""
    r = report.agg(
        F.max(F.when(F.col("attack_type") == "overall", F.col("f1"))).alias("overall_f1"),
        F.max(F.when(F.col("attack_type") == "overall", F.col("precision"))).alias("overall_precision"),
        F.max(F.when(F.col("attack_type") == "overall", F.col("false_positive_rate"))).alias("overall_fpr"),
        F.max(F.when(F.col("attack_type") == "replay", F.col("recall"))).alias("replay_recall"))

    def msg(name, value, op, bound):
        return F.format_string(f"{name} %.4f%% {op} %.4f%%", F.col(value) * 100.0, F.lit(bound * 100.0))

    fails = F.array(
        F.when(F.col("overall_f1") < min_f1, msg("overall_f1", "overall_f1", "<", min_f1)),
        F.when(F.col("overall_precision") < min_precision, msg("precision", "overall_precision", "<", min_precision)),
        F.when(F.col("overall_fpr") > max_fpr, msg("false_positive_rate", "overall_fpr", ">", max_fpr)),
        F.when(F.col("replay_recall") < min_replay_recall, msg("replay_recall", "replay_recall", "<", min_replay_recall)),
    )
    r = r.withColumn("failures", F.filter(fails, lambda x: x.isNotNull()))
    return r.withColumn("passed", F.size("failures") == 0)
