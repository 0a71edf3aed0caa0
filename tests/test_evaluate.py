"""Evaluation, report sinks and gates on a small labelled alert fixture."""

import csv
import glob
import json
import tempfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from busguard.operators import evaluate as ev
from busguard.plans import dashboards as D
from busguard.sources import alerts as A


def alerts_df(spark, rows):
    return spark.createDataFrame(rows, "sequence long, attack_type_label string, is_anomaly boolean, "
                                       "benchmark_scored boolean, timestamp timestamp, anomaly_score double, "
                                       "pipeline_latency_ms double, arbitration_id string, detector_phase string")


def make(spark, counts):
    """counts: {(label, flagged): n}; one replay frame with benchmark_scored=false is never scored."""
    rows, i = [], 0
    import datetime as dt
    for (label, flagged), n in counts.items():
        for _ in range(n):
            rows.append((i, label, flagged, True if label == "replay" else None,
                         dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), -0.2 if flagged else 0.1, 1.0,
                         "0x000" if label == "dos" else "0x110", "inference"))
            i += 1
    rows.append((i, "replay", False, False, dt.datetime(2024, 1, 1), 0.0, 1.0, "0x330", "inference"))
    return alerts_df(spark, rows)


COUNTS = {("normal", False): 990, ("normal", True): 10, ("fuzz", True): 50, ("replay", True): 99,
          ("replay", False): 1, ("injection", True): 40, ("dos", True): 60, ("dos", False): 0}


def test_report_and_metrics(spark):
    rep = {r["attack_type"]: r for r in ev.detection_report(make(spark, COUNTS)).collect()}
    assert rep["replay"]["total"] == 100 and rep["replay"]["tp"] == 99 and rep["replay"]["fn"] == 1
    assert rep["replay"]["tn"] == 990 and rep["replay"]["fp"] == 10
    o = rep["overall"]
    assert o["total"] is None and o["tp"] == 249 and o["fn"] == 1 and o["fp"] == 10 and o["tn"] == 990
    assert o["precision"] == pytest.approx(249 / 259)
    assert o["recall"] == pytest.approx(249 / 250)
    assert o["false_positive_rate"] == pytest.approx(10 / 1000)
    assert o["accuracy"] == pytest.approx((249 + 990) / 1250)
    assert rep["fuzz"]["detection_rate"] == 1.0


def test_quality_gates(spark):
    g = ev.quality_gates(ev.detection_report(make(spark, COUNTS))).first()
    assert g["passed"] is False
    assert any(m.startswith("precision") for m in g["failures"])
    assert any(m.startswith("false_positive_rate") for m in g["failures"])
    good = dict(COUNTS)
    good[("normal", True)] = 1
    good[("normal", False)] = 999
    g2 = ev.quality_gates(ev.detection_report(make(spark, good))).first()
    assert g2["passed"] is True and g2["failures"] == []


def test_zero_denominators(spark):
    rep = {r["attack_type"]: r for r in ev.detection_report(make(spark, {("normal", False): 3})).collect()}
    assert rep["fuzz"]["precision"] == 0.0 and rep["fuzz"]["f1"] == 0.0 and rep["overall"]["recall"] == 0.0


def test_time_range_and_unknown_labels(spark):
    df = make(spark, {("normal", False): 10, ("weird", True): 5})
    rep = {r["attack_type"]: r for r in ev.detection_report(df).collect()}
    assert rep["overall"]["tp"] == 0  # labels outside the four attack types are ignored
    sub = ev.in_time_range(df, F.lit("2024-01-01 00:02:00").cast("timestamp"), F.lit("2024-01-01 00:04:00").cast("timestamp"))
    assert sub.count() == 3


def test_report_sinks(spark):
    d = tempfile.mkdtemp()
    A.write_report(ev.detection_report(make(spark, COUNTS)), f"{d}/json", f"{d}/csv", "alerts-*", None, "2024-02-01", 1000,
                   datetime(2024, 1, 2, tzinfo=timezone.utc))
    with open(glob.glob(f"{d}/csv/*.csv")[0]) as fh:
        rows = list(csv.DictReader(fh))
    assert [r["attack_type"] for r in rows] == ["fuzz", "replay", "injection", "dos", "overall"]
    assert rows[-1]["total"] == "" and list(rows[0]) == ["attack_type", "total", "tp", "tn", "fp", "fn",
                                                         "detection_rate", "precision", "recall", "f1",
                                                         "false_positive_rate", "accuracy"]
    [document] = [json.loads(x) for f in glob.glob(f"{d}/json/part-*") for x in open(f)]
    assert document["generated_at"] == "2024-01-02T00:00:00+00:00" and document["index"] == "alerts-*"
    assert document["time_range"] == {"gte": None, "lte": "2024-02-01"} and document["normal_total"] == 1000
    assert list(document["per_attack"]) == ["fuzz", "replay", "injection", "dos"]
    assert document["overall"]["tp"] == sum(x["tp"] for x in document["per_attack"].values())
    assert "total" not in document["overall"] and document["per_attack"]["dos"]["total"] == 60


def test_zero_totals_on_the_scored_report(spark):
    report = ev.detection_report(make(spark, COUNTS))
    assert ev.zero_totals(report).collect() == []
    some = make(spark, COUNTS).filter("attack_type_label not in ('fuzz', 'dos')")
    assert sorted(r["label"] for r in ev.zero_totals(ev.detection_report(some)).collect()) == ["dos", "fuzz"]


def test_many_indices_are_one_scan(spark, tmp_path):
    for i in range(12):
        df = spark.range(3).withColumn("is_anomaly", F.lit(i % 2 == 0))
        df = df.withColumn("extra", F.lit(i)) if i == 5 else df
        label = F.when(F.col("id") == 0, "a+b: c/d").when(F.col("id") == 1, "dos")
        df = df.withColumn("event_date", F.lit("2024-01-01")).withColumn("attack_type_label", label) if i >= 8 else df
        writer = df.write.partitionBy("event_date", "attack_type_label") if i >= 8 else df.write
        writer.parquet(f"{tmp_path}/alerts-{i:02d}")
    both = A.read_alerts(spark, f"{tmp_path}/alerts-*")
    assert both.count() == 36 and both.filter("extra = 5").count() == 3 and both.filter("event_date is not null").count() == 12
    assert {r["attack_type_label"]: r["count"] for r in both.filter("event_date = date'2024-01-01'").groupBy(
        "attack_type_label").count().collect()} == {"a+b: c/d": 4, "dos": 4, None: 4}
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2  # one for each layout


def test_reconciliation_lag_missing(spark):
    df = make(spark, COUNTS)
    produced = spark.createDataFrame([("normal", 1000), ("attacks", 251)], "mode string, frames long")
    r = ev.count_reconciliation(produced, df).first()
    assert r["expected_total"] == 1251 and r["indexed_total"] == 1251 and r["within_bounds"]
    short = spark.createDataFrame([("normal", 2000)], "mode string, frames long")
    assert ev.count_reconciliation(short, df).first()["within_bounds"] is False
    ends = spark.createDataFrame([("t", 0, 10), ("t", 1, 5), ("t", 2, 7)], "topic string, partition int, end_offset long")
    com = spark.createDataFrame([("t", 0, 10), ("t", 1, 9)], "topic string, partition int, committed long")
    lag = {r["partition"]: r for r in ev.ingest_lag(ends, com).collect()}
    assert lag[0]["lag"] == 0 and lag[1]["lag"] == 0 and lag[2]["lag"] == 7 and lag[2]["total_lag"] == 7
    assert [r["label"] for r in ev.missing_labels(df).collect()] == []
    only = df.filter(F.col("attack_type_label") != "fuzz")
    assert [r["label"] for r in ev.missing_labels(only).collect()] == ["fuzz"]


def test_dashboards_run(spark):
    df = make(spark, COUNTS).withColumn("features", F.struct(*[F.lit(0.5).alias(c) for c in [
        "dominant_id_ratio", "id_entropy_1s", "bus_frequency_1s", "bus_utilization", "payload_repeat_ratio",
        "arbitration_priority_score", "rolling_interarrival_mean", "rolling_interarrival_std"]]))
    k = D.executive_kpis(df).first()
    assert k["total_events"] == 1251 and k["false_positives"] == 10
    assert D.dos_kpis(df).first()["dos_events"] == 60
    assert D.latest_alerts(df, 5).count() == 5
    assert sum(r["frames"] for r in D.score_histogram(df).collect()) == 1251
    for q in (D.events_over_time, D.anomalies_over_time, D.attack_mix, D.score_by_attack, D.dos_trends,
              D.top_arbitration_ids, D.replay_kpis, D.replay_trend, D.replay_timing_trends, D.replay_id_mix,
              D.latency_over_time, D.kql_detection_rates):
        assert q(df).count() >= 1
