"""Streaming: micro-batches give the batch result for every inference frame, also across a restart."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from busguard.params import REFERENCE_BUS
from busguard.plans import detect
from busguard.schema import ALL_FEATURES, FRAME_COLUMNS, FRAME_SCHEMA
from busguard.sources.frames import frames_from_events
from busguard.streaming import stream
from busguard.streaming.stream import StreamDetector, live_alert_counts

P = REFERENCE_BUS.with_(min_warmup_bus_frequency=5.0, warmup_samples=200)
PROC = detect.FIXTURE_PROCESSING_NS


@pytest.fixture(scope="module")
def batch_run(spark):
    frames = frames_from_events(spark, "/root/testdata/sf0.001")
    alerts, art = detect.detect(frames, P, F.lit(PROC), materialize=False)
    alerts = alerts.persist()
    return frames, alerts, art


def _write_slices(frames, root, n, lo=0, hi=None):
    """Time-contiguous slices lo..hi-1 of n, one file each, written in order (the file source
    reads files by modification time)."""
    ordered = frames.select(*[F.col(c).cast(FRAME_SCHEMA[c].dataType).alias(c) for c in FRAME_COLUMNS])
    bounds = ordered.select(F.percentile("simulator_send_time_ns", [i / n for i in range(1, n)])).first()[0]
    edges = [None] + [int(b) for b in bounds] + [None]
    for i in range(lo, n if hi is None else hi):
        part = ordered
        if edges[i] is not None:
            part = part.filter(F.col("simulator_send_time_ns") > edges[i])
        if edges[i + 1] is not None:
            part = part.filter(F.col("simulator_send_time_ns") <= edges[i + 1])
        part.coalesce(1).write.mode("overwrite").parquet(f"{root}/tmp{i}")
        src = [f for f in os.listdir(f"{root}/tmp{i}") if f.endswith(".parquet")][0]
        os.replace(f"{root}/tmp{i}/{src}", f"{root}/in/part-{i:03d}.parquet")


def _run(spark, art, root, ckpt):
    stream = spark.readStream.schema(FRAME_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    det = StreamDetector(spark, P, art, f"{root}/alerts", f"{root}/state", processing_ns=F.lit(PROC))
    q = det.start(stream, ckpt, available_now=True)
    q.awaitTermination(600)
    return det


def _compare(spark, batch_alerts, art, root):
    got = spark.read.parquet(f"{root}/alerts")
    assert got.select("batch_id").distinct().count() >= 3
    want = batch_alerts.filter(F.col("detector_phase") == "inference")
    g = {r["sequence"]: r for r in got.select("sequence", "features", "triggered_rules", "anomaly_score",
                                              "is_anomaly").collect()}
    w = want.select("sequence", "features", "triggered_rules", "anomaly_score", "is_anomaly").collect()
    assert len(w) > 100 and len(g) == 1000
    bad = []
    for r in w:
        s = g[r["sequence"]]
        if list(s["triggered_rules"]) != list(r["triggered_rules"]) or s["is_anomaly"] != r["is_anomaly"] \
                or s["anomaly_score"] != pytest.approx(r["anomaly_score"], abs=1e-12):
            bad.append((r["sequence"], s["triggered_rules"], r["triggered_rules"]))
        fs, fw = s["features"].asDict(), r["features"].asDict()
        for c in ALL_FEATURES:
            if fs[c] != pytest.approx(fw[c], rel=1e-9, abs=1e-9):
                bad.append((r["sequence"], c, fs[c], fw[c]))
    assert not bad, bad[:10]


def test_stream_equals_batch(spark, batch_run):
    frames, alerts, art = batch_run
    root = tempfile.mkdtemp(prefix="bg-stream-")
    os.makedirs(f"{root}/in")
    _write_slices(frames, root, 4)
    det = _run(spark, art, root, f"{root}/ckpt")
    assert det.stats["processed"] == 1000
    _compare(spark, alerts, art, root)
    # Live counts over the alert sink add up to the alerts
    sink = spark.read.parquet(f"{root}/alerts")
    live = live_alert_counts(spark.readStream.schema(sink.schema).parquet(f"{root}/alerts"))
    q = live.writeStream.outputMode("update").format("memory").queryName("bg_live").start()
    q.processAllAvailable()
    q.stop()
    total = spark.sql("select sum(events) from (select window_start, attack_type_label, max(events) events "
                      "from bg_live group by 1, 2)").first()[0]
    assert total == 1000


def test_stream_restart_continues_state(spark, batch_run):
    frames, alerts, art = batch_run
    root = tempfile.mkdtemp(prefix="bg-restart-")
    os.makedirs(f"{root}/in")
    # first run sees two slices, the second run (same checkpoint) the other two
    _write_slices(frames, root, 4, 0, 2)
    _run(spark, art, root, f"{root}/ckpt")
    _write_slices(frames, root, 4, 2, 4)
    _run(spark, art, root, f"{root}/ckpt")
    _compare(spark, alerts, art, root)


def test_arrival_numbers_are_unique_over_topics_partitions_and_offsets(spark):
    rows = [(topic, part, offset) for topic in ("a", "b") for part in (0, 1, 1024, 5000)
            for offset in (5, 6, 5 + (1 << 30), 6 + (1 << 30))]
    df = spark.createDataFrame(rows, "topic string, partition int, offset bigint")
    got = {}
    for batch_id in (3, 4):
        kept = df.select("*", F.col("offset").alias("at"), F.struct("topic", "partition").alias("source"))
        for r in stream.with_arrival(stream.with_source(kept), batch_id).collect():
            got[batch_id, r.source, r["at"]] = r["_ord"]
    assert len(set(got.values())) == len(got) == 64
    by_source = sorted((k, v) for k, v in got.items())
    assert all(a[1] < b[1] for a, b in zip(by_source, by_source[1:]))


def test_arrival_numbers_of_file_rows_are_uncut(spark, monkeypatch):
    df = spark.range(8).select(F.lit("").alias("_topic"), F.floor(F.col("id") / 4).alias("_part"),
                               ((F.col("id") % 2) + F.when(F.col("id") % 4 < 2, 0).otherwise(1 << 24)).alias("_row"))
    assert stream.with_arrival(df, 0).distinct().count() == 8
    read = stream.with_source(spark.range(0, 90, 1, 3).toDF("n")).collect()
    assert sorted((r["_part"], r["_row"], r.n) for r in read) == [(i // 30, i % 30, i) for i in range(90)]
    monkeypatch.setattr(stream, "MAX_BATCH_ROWS", 16)
    with pytest.raises(ValueError, match="arrival numbers"):
        stream.with_arrival(df, 0)
