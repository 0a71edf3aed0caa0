"""Command line: the reference's entry points as Spark jobs.

  python -m busguard detect   --frames PATH --alerts OUT [--artifacts OUT] [--quarantine OUT] [--format parquet|json]
  python -m busguard stream   (--frames DIR | --kafka SERVERS) --alerts OUT --artifacts DIR --checkpoint DIR
                              [--lateness T] [--state-ttl-days N] [--state DIR] [--quarantine DIR] [--interval T]
                              [--available-now]
  python -m busguard evaluate --alerts PATTERN [--start-time T] [--end-time T] --json-out P --csv-out P
  python -m busguard gates    --alerts PATTERN [--min-overall-f1 .99 ...]   (exit code 1 on failure)

Detector flags keep the reference's defaults (warm-up 1000, contamination 0.03, 200 trees).
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import functions as F

from busguard.operators import evaluate as ev
from busguard.params import DEFAULT
from busguard.plans import detect
from busguard.session import build_session
from busguard.sources import alerts as A
from busguard.sources.frames import read_frames


def _params(a):
    return DEFAULT.with_(warmup_samples=a.warmup_samples, contamination=a.contamination,
                         min_warmup_bus_frequency=a.min_warmup_bus_frequency,
                         bus_keys=tuple(a.bus_keys), use_model=not a.rules_only)


def _detector_flags(p):
    p.add_argument("--warmup-samples", type=int, default=DEFAULT.warmup_samples)
    p.add_argument("--contamination", type=float, default=DEFAULT.contamination)
    p.add_argument("--min-warmup-bus-frequency", type=float, default=DEFAULT.min_warmup_bus_frequency)
    p.add_argument("--bus-keys", nargs="*", default=list(DEFAULT.bus_keys),
                   help="columns that identify one bus; none = the whole fleet is one bus")
    p.add_argument("--rules-only", action="store_true")


def cmd_detect(a, spark):
    frames = read_frames(spark, a.frames, a.format)
    rejected = a.quarantine or a.alerts.rstrip("/") + "-quarantine"
    detect.quarantine(frames).write.mode("overwrite").parquet(rejected)
    alerts, art = detect.detect(frames, _params(a))
    A.write_alerts(alerts, a.alerts, "overwrite", with_id=True)
    if a.artifacts:
        detect.save_artifacts(art, a.artifacts)
    print(json.dumps({"alerts": spark.read.parquet(a.alerts).count(), "quarantined": spark.read.parquet(rejected).count()}))
    return 0


def _frame_stream(a, spark):
    from busguard.sources.frames import kafka_options, read_kafka, stream_frames
    if not a.kafka:
        return stream_frames(spark, a.frames, a.format, a.max_files)
    password = os.environ.get(a.password_env) if a.username else None
    return read_kafka(spark, kafka_options(a.kafka, a.topic, a.starting_offsets, a.max_offsets, a.username, password,
                                           a.ca_location))


def cmd_stream(a, spark):
    art = detect.load_artifacts(spark, a.artifacts)
    frames, params = _frame_stream(a, spark), _params(a)
    # state and quarantine outlive the session: beside the checkpoint that holds the offsets
    beside = a.checkpoint.rstrip("/")
    if params.bus_keys:
        return _keyed_stream(a, spark, frames, params, art, a.quarantine or f"{beside}-quarantine")
    from busguard.streaming.stream import StreamDetector
    det = StreamDetector(spark, params, art, a.alerts, a.state or f"{beside}-state",
                         a.quarantine or f"{beside}-quarantine")
    q = det.start(frames, a.checkpoint, available_now=a.available_now, processing_time=a.interval,
                  dedupe_watermark=a.dedupe_watermark)
    _until_stopped([q])
    print(json.dumps(dict(det.stats)))
    return 0


def _keyed_stream(a, spark, frames, params, art, quarantine):
    from busguard.streaming import keyed
    alerts = keyed.keyed_alerts(frames, params, art, lateness=a.lateness, ttl_ms=int(a.state_ttl_days * 86_400_000))
    flagged, total = F.count_if("is_anomaly").alias("anomalies"), F.count(F.lit(1)).alias("indexed")
    alerts = alerts.observe("alerts", total, flagged)
    rejects = keyed.rejected(frames).observe("rejects", F.count(F.lit(1)).alias("quarantined"))
    q = keyed.start_keyed(alerts, a.alerts, a.checkpoint, a.available_now, a.interval)
    r = keyed.start_rejects(rejects, quarantine, a.checkpoint.rstrip("/") + "-quarantine-offsets", a.available_now, a.interval)
    _until_stopped([q, r])
    print(json.dumps(keyed.counters(q, r)))
    return 0


def _until_stopped(queries):
    """Wait for the queries; on an interrupt finish what is present, then stop."""
    from busguard.streaming.keyed import drain
    try:
        for q in queries:
            q.awaitTermination()
    except KeyboardInterrupt:
        for q in queries:
            drain(q)


def _report(a, spark):
    alerts = A.read_alerts(spark, a.alerts)
    return alerts, ev.detection_report(alerts, *_range(a)).persist()


def _range(a):
    return [F.lit(x).cast("timestamp_ntz") if x else None for x in (a.start_time, a.end_time)]


def cmd_evaluate(a, spark):
    alerts, report = _report(a, spark)
    normal = ev.confusion_counts(alerts, *_range(a)).first()
    A.write_report(report, a.json_out, a.csv_out, a.alerts, a.start_time, a.end_time,
                   int(normal["normal_total"] or 0))
    overall = report.filter(F.col("attack_type") == "overall").drop("ord", "total").first().asDict()
    print(json.dumps(overall, indent=2))
    return 0


def cmd_gates(a, spark):
    alerts, report = _report(a, spark)
    g = ev.quality_gates(report, a.min_overall_f1, a.min_precision, a.max_false_positive_rate,
                         a.min_replay_recall).first()
    missing = [r["label"] for r in ev.missing_labels(alerts).collect()]  # at most five labels
    failures = list(g["failures"]) + ([f"missing labels: {missing}"] if missing else [])
    zero = [r["label"] for r in ev.zero_totals(report).collect()]  # at most four
    failures += [f"zero totals for attack classes: {zero}"] if zero else []
    if a.produced is not None:
        produced = spark.createDataFrame([(a.produced,)], "frames long")
        r = ev.count_reconciliation(produced, alerts).first()
        if not r["within_bounds"]:
            failures.append(f"indexed {r['indexed_total']} outside {r['lower_bound']}..{r['upper_bound']}")
    print(json.dumps({"passed": not failures, "failures": failures}))
    return 0 if not failures else 1


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="busguard")
    sub = ap.add_subparsers(dest="cmd", required=True)
    d = sub.add_parser("detect")
    d.add_argument("--frames", required=True)
    d.add_argument("--format", default="parquet", choices=["parquet", "json"])
    d.add_argument("--alerts", required=True)
    d.add_argument("--artifacts")
    d.add_argument("--quarantine", help="rejected records; default: beside the alerts")
    _detector_flags(d)
    s = sub.add_parser("stream")
    s.add_argument("--frames", help="folder of frame files; or --kafka")
    s.add_argument("--kafka", help="bootstrap servers of the frame topic (the connector comes with spark-submit)")
    s.add_argument("--topic", default="can-telematics")
    s.add_argument("--starting-offsets", default="latest")
    s.add_argument("--max-offsets", type=int, default=None, help="records per trigger")
    s.add_argument("--username")
    s.add_argument("--password-env", default="BUSGUARD_KAFKA_PASSWORD", help="environment variable with the password")
    s.add_argument("--ca-location")
    s.add_argument("--lateness", default="10 seconds", help="how long frames wait for earlier ones")
    s.add_argument("--state-ttl-days", type=float, default=7, help="forget what was not seen for so long; 0 = never")
    s.add_argument("--format", default="json", choices=["parquet", "json"])
    s.add_argument("--max-files", type=int, default=None)
    s.add_argument("--alerts", required=True)
    s.add_argument("--artifacts", required=True)
    s.add_argument("--checkpoint", required=True)
    s.add_argument("--state", help="look-back state; default: beside the checkpoint")
    s.add_argument("--quarantine", help="rejected and late frames; default: beside the checkpoint")
    s.add_argument("--interval", default="1 second", help="time between micro-batches")
    s.add_argument("--available-now", action="store_true")
    s.add_argument("--dedupe-watermark", default=None)
    _detector_flags(s)
    for name in ("evaluate", "gates"):
        e = sub.add_parser(name)
        e.add_argument("--alerts", required=True, help="alert table or wildcard of tables")
        e.add_argument("--start-time")
        e.add_argument("--end-time")
        if name == "evaluate":
            e.add_argument("--json-out", default="reports/detection-evaluation.json")
            e.add_argument("--csv-out", default="reports/detection-evaluation.csv")
        else:
            e.add_argument("--min-overall-f1", type=float, default=0.99)
            e.add_argument("--min-precision", type=float, default=0.99)
            e.add_argument("--max-false-positive-rate", type=float, default=0.005)
            e.add_argument("--min-replay-recall", type=float, default=0.99)
            e.add_argument("--produced", type=int, help="frames produced: the alerts must be within 2 % of them")
    a = ap.parse_args(argv)
    if a.cmd == "stream" and not a.frames and not a.kafka:
        ap.error("stream needs --frames or --kafka")
    spark = build_session()
    return {"detect": cmd_detect, "stream": cmd_stream, "evaluate": cmd_evaluate, "gates": cmd_gates}[a.cmd](a, spark)


if __name__ == "__main__":
    sys.exit(main())
