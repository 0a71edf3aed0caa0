"""Edge cases end to end: malformed payloads, NULL ids, equal timestamps, late stream frames."""

import os
import tempfile

from pyspark.sql import functions as F

from busguard.params import REFERENCE_BUS
from busguard.plans import detect
from busguard.schema import FRAME_SCHEMA
from busguard.streaming.stream import StreamDetector
from tests.framekit import T0, frame, frames_df

P = REFERENCE_BUS.with_(warmup_samples=10_000)


def test_malformed_payload_quarantined(spark):
    rows = [frame(sequence=1), frame(raw_payload="{broken", sequence=2), frame(raw_payload="NaN", sequence=3)]
    df = frames_df(spark, rows)
    alerts, _ = detect.detect(df, P, F.lit(T0), materialize=False)
    assert sorted(r["sequence"] for r in alerts.collect()) == [1]
    assert sorted(r["sequence"] for r in detect.quarantine(df).collect()) == [2, 3]


def test_null_arbitration_id_and_equal_times(spark):
    rows = [frame(None, {"raw_bytes": [1, 2]}, sequence=1), frame("0x110", sequence=2), frame("0x110", sequence=3)]
    feats = detect.neutral_learned(detect.features(frames_df(spark, rows), P, F.lit(T0)), P)
    got = {r["sequence"]: r for r in feats.collect()}
    assert got[1]["arbitration_key"] == "None" and got[1]["arbitration_id_numeric"] == -1.0
    assert got[1]["reserved_id_flag"] == 1.0 and got[1]["arbitration_priority_score"] == 0.0
    # three frames at one time are peers of the 1 s window; the id sequence still orders them
    assert all(r["bus_frequency_1s"] == 3.0 for r in got.values())
    assert got[2]["interarrival_ms"] == 0.0 and got[3]["interarrival_ms"] == 0.0
    assert got[3]["previous_bus_id"] == "0x110"


def test_late_stream_frames_go_to_quarantine(spark):
    root = tempfile.mkdtemp(prefix="bg-late-")
    os.makedirs(f"{root}/in")
    frames = spark.createDataFrame([frame("0x110", send_ns=T0 + i * 100_000_000, sequence=i) for i in range(200)],
                                   FRAME_SCHEMA)
    late = spark.createDataFrame([frame("0x110", send_ns=T0 - 60_000_000_000, sequence=999),
                                  frame("0x110", send_ns=T0 + 30_000_000_000, sequence=998, raw_payload="{oops")],
                                 FRAME_SCHEMA)
    art = detect.Artifacts(None, spark.createDataFrame([], "arbitration_id string, median double, mad double, "
                                                           "mean double, std double, cv double, count double"),
                           spark.createDataFrame([], "prev_id string, next_id string, n long, total long, next_ids long"))
    for i, part in enumerate([frames, late]):
        part.coalesce(1).write.parquet(f"{root}/tmp{i}")
        src = [f for f in os.listdir(f"{root}/tmp{i}") if f.endswith(".parquet")][0]
        os.replace(f"{root}/tmp{i}/{src}", f"{root}/in/part-{i}.parquet")
    stream = spark.readStream.schema(FRAME_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    det = StreamDetector(spark, REFERENCE_BUS.with_(use_model=False), art, f"{root}/alerts", f"{root}/state",
                         f"{root}/quarantine", processing_ns=F.lit(T0))
    det.start(stream, f"{root}/ckpt", available_now=True).awaitTermination(300)
    assert spark.read.parquet(f"{root}/alerts").count() == 200
    q = {r["sequence"]: r["reason"] for r in spark.read.parquet(f"{root}/quarantine").collect()}
    assert q == {999: "late", 998: "malformed_payload"}
    assert det.stats["quarantined"] == 2 and det.stats["processed"] == 200


def test_stream_drops_redelivered_frames(spark):
    root = tempfile.mkdtemp(prefix="bg-dedupe-")
    os.makedirs(f"{root}/in")
    frames = spark.createDataFrame([frame("0x110", send_ns=T0 + i * 100_000_000, sequence=i) for i in range(50)],
                                   FRAME_SCHEMA)
    art = detect.Artifacts(None, spark.createDataFrame([], "arbitration_id string, median double, mad double, "
                                                           "mean double, std double, cv double, count double"),
                           spark.createDataFrame([], "prev_id string, next_id string, n long, total long, next_ids long"))
    for i in range(2):  # the same frames delivered twice
        frames.coalesce(1).write.parquet(f"{root}/tmp{i}")
        src = [f for f in os.listdir(f"{root}/tmp{i}") if f.endswith(".parquet")][0]
        os.replace(f"{root}/tmp{i}/{src}", f"{root}/in/part-{i}.parquet")
    stream = spark.readStream.schema(FRAME_SCHEMA).parquet(f"{root}/in")
    det = StreamDetector(spark, REFERENCE_BUS.with_(use_model=False), art, f"{root}/alerts", f"{root}/state",
                         processing_ns=F.lit(T0))
    det.start(stream, f"{root}/ckpt", available_now=True, dedupe_watermark="1 hour").awaitTermination(300)
    assert spark.read.parquet(f"{root}/alerts").count() == 50
