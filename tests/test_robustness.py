"""Inputs that must not raise, get lost or change values with size: ids, corrupt records, dense buses, restarts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from busguard.__main__ import main
from busguard.functions.decode import parse_arbitration_id
from busguard.params import MEMORY_BOUNDS, REFERENCE_BUS
from busguard.plans import detect
from busguard.schema import FRAME_SCHEMA
from busguard.session import build_session
from busguard.sources import alerts as A
from busguard.sources.frames import frames_from_kafka_value, kafka_options, read_frames
from busguard.streaming.stream import StreamDetector
from tests.framekit import T0, frame, frames_df


@pytest.mark.parametrize("text, value", [
    (None, -1), ("", -1), ("0x110", 0x110), ("0X7aF", 0x7AF), ("0xZZ", -1), ("12", 12), ("-1", -1), ("+5", 5),
    (" 0x110", -1), ("0x110 ", -1), (" 12", -1), ("0x7FFFFFFFFFFFFFFF", 2**63 - 1), ("0x8000000000000000", -1),
    ("0xFFFFFFFFFFFFFFFF", -1), ("0x" + "F" * 400, -1), ("0x" + "0" * 400 + "1A", 0x1A), ("9" * 400, -1), ("0x", -1),
    ("12.0", -1), ("0x-1", -1), ("NaN", -1),
])
def test_no_identifier_raises(spark, text, value):
    df = spark.createDataFrame([(text,)], "a string").repartition(2)
    assert df.select(parse_arbitration_id("a").alias("v")).first()["v"] == value


def good_line(i):
    return json.dumps({"timestamp": "2024-01-01T00:00:00Z", "simulator_send_time_ns": T0 + i, "vehicle_id": "v",
                       "session_id": "s", "sequence": i, "arbitration_id": "0x110", "dlc": 8, "payload": "{\"rpm\": 1}"})


def test_detect_accounts_for_every_record(spark, tmp_path, capsys):
    os.makedirs(f"{tmp_path}/in")
    bad = good_line(9).replace('{\\"rpm\\": 1}', "{broken")
    with open(f"{tmp_path}/in/a.json", "w") as out:
        out.write("\n".join([good_line(1), "{not json at all", good_line(2), bad, "[1, 2", good_line(3)]) + "\n")
    assert main(["detect", "--frames", f"{tmp_path}/in", "--format", "json", "--alerts", f"{tmp_path}/alerts"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"alerts": 3, "quarantined": 3}
    kept = spark.read.parquet(f"{tmp_path}/alerts-quarantine").collect()
    assert sorted((r.reason, r.record) for r in kept if r.record) == [("corrupt_record", "[1, 2"),
                                                                     ("corrupt_record", "{not json at all")]
    assert [r.sequence for r in kept if r.reason == "malformed_payload"] == [9]


def test_topic_values_without_a_frame(spark):
    rows = [(good_line(1).encode(), "t", 0, 5), (b"{oops", "t", 0, 6), (None, "t", 1, 7)]
    got = frames_from_kafka_value(spark.createDataFrame(rows, "value binary, topic string, partition int, offset long"))
    rejected = {r.reason for r in detect.quarantine(got).collect()}
    assert detect.quarantine(got).count() == 2 and rejected == {"corrupt_record"}
    assert detect.decoded_frames(got, REFERENCE_BUS).count() == 1


def test_no_offset_is_lost_by_default():
    options = kafka_options("b", "t")
    assert options["failOnDataLoss"] == "true" and "maxOffsetsPerTrigger" not in options
    assert kafka_options("b", "t", fail_on_data_loss=False, max_offsets=9)["maxOffsetsPerTrigger"] == "9"


def test_dense_bus_keeps_whole_windows(spark):
    """12,000 frames in one second: the window holds them all unless memory bounds are asked for."""
    n = 12_000
    rows = [frame("0x110" if i < n // 2 else "0x220", {"rpm": i % 7}, T0 + i * 80_000, i) for i in range(n)]
    df = frames_df(spark, rows)
    last = lambda p: detect.features(df, p, F.lit(T0)).orderBy(F.col("t").desc()).first()
    whole = last(REFERENCE_BUS)
    assert whole["bus_frequency_1s"] == n and whole["id_frequency_1s"] == n // 2
    assert whole["dominant_id_ratio"] == 0.5 and whole["id_entropy_1s"] == pytest.approx(1.0)
    assert whole["payload_signature_repeats_3s"] > 800
    bounded = last(REFERENCE_BUS.with_(**MEMORY_BOUNDS))
    assert bounded["bus_frequency_1s"] == 10_000 and bounded["id_frequency_1s"] == 3000
    assert bounded["dominant_id_ratio"] == 0.6 and bounded["payload_signature_repeats_3s"] == 199


def test_document_id_by_source_position(spark):
    df = frames_df(spark, [frame(sequence=1)] * 25).withColumn("topic", F.lit("t")).withColumn("partition", F.lit(0))
    df = df.withColumn("offset", F.col("_ord")).withColumn("event_time_ns", F.col("simulator_send_time_ns"))
    whole = A.document_id(df)
    again = A.document_id(df.filter("_ord % 7 = 3"))  # some of them delivered again, alone
    assert whole.unionByName(again).dropDuplicates(["document_id"]).count() == 25
    nulls = spark.createDataFrame([(None, "x", "y"), ("x", None, "y"), ("x", "y", None)], "a string, b string, c string")
    assert nulls.select(A.hashed_id("a", "b", "c").alias("h")).distinct().count() == 3


def test_session_settings_stay(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        assert build_session().conf.get("spark.sql.shuffle.partitions") == "6"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def no_artifacts(spark):
    return detect.Artifacts(None, spark.createDataFrame([], "arbitration_id string, median double, mad double, "
                                                            "mean double, std double, cv double, count double"),
                            spark.createDataFrame([], "prev_id string, next_id string, n long, total long, next_ids long"))


def add_file(spark, rows, folder, name):
    spark.createDataFrame(rows, FRAME_SCHEMA).coalesce(1).write.parquet(f"{folder}/tmp-{name}")
    made = next(f for f in os.listdir(f"{folder}/tmp-{name}") if f.endswith(".parquet"))
    os.makedirs(f"{folder}/in", exist_ok=True)
    os.replace(f"{folder}/tmp-{name}/{made}", f"{folder}/in/{name}.parquet")


def test_frame_within_the_lateness_sees_its_windows(spark, tmp_path):
    rows = [frame("0x110", {"rpm": 1}, T0 + i * 10_000_000, i) for i in range(1000)]
    late_at = T0 + 4_005_000_000  # six seconds before the newest frame
    add_file(spark, rows, tmp_path, "a")
    add_file(spark, [frame("0x220", {"rpm": 2}, late_at, 5000)], tmp_path, "b")
    stream = spark.readStream.schema(FRAME_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    det = StreamDetector(spark, REFERENCE_BUS.with_(use_model=False), no_artifacts(spark), f"{tmp_path}/alerts",
                         f"{tmp_path}/state", f"{tmp_path}/quarantine", processing_ns=F.lit(T0))
    det.start(stream, f"{tmp_path}/ckpt", available_now=True).awaitTermination(300)
    got = spark.read.parquet(f"{tmp_path}/alerts").filter("sequence = 5000").first()["features"]
    assert got["bus_frequency_1s"] == 101.0 and got["id_frequency_1s"] == 1.0


def test_equal_frames_keep_their_arrival_order(spark, tmp_path):
    ids = ["0x110", "0x220", "0x330", "0x440", "0x550", "0x000"]
    add_file(spark, [frame(x, {"rpm": 1}, T0, 1) for x in ids], tmp_path, "a")
    stream = spark.readStream.schema(FRAME_SCHEMA).parquet(f"{tmp_path}/in")
    det = StreamDetector(spark, REFERENCE_BUS.with_(use_model=False), no_artifacts(spark), f"{tmp_path}/alerts",
                         f"{tmp_path}/state", f"{tmp_path}/quarantine", processing_ns=F.lit(T0))
    kept = {}
    real = det._save_state
    det._save_state = lambda batch, tail, *rest: (kept.update(
        order=[r.arbitration_id for r in tail.orderBy("_ord").collect()]), real(batch, tail, *rest))
    det.start(stream, f"{tmp_path}/ckpt", available_now=True).awaitTermination(300)
    assert kept["order"] == ids


def test_stream_command_continues_after_a_restart(spark, tmp_path):
    """Two runs of the command with one checkpoint give the features of one uninterrupted run."""
    detect.save_artifacts(no_artifacts(spark), f"{tmp_path}/art")
    rows = [frame("0x110", {"rpm": i % 5}, T0 + i * 100_000_000, i) for i in range(80)]
    flags = ["--format", "parquet", "--artifacts", f"{tmp_path}/art", "--available-now", "--rules-only", "--bus-keys"]
    for name, part in (("a", rows[:40]), ("b", rows[40:])):
        add_file(spark, part, tmp_path, name)
        assert main(["stream", "--frames", f"{tmp_path}/in", "--alerts", f"{tmp_path}/alerts", "--checkpoint",
                     f"{tmp_path}/ckpt", *flags]) == 0
    assert os.path.isdir(f"{tmp_path}/ckpt-state") and os.path.isdir(f"{tmp_path}/ckpt-quarantine")
    want = detect.features(frames_df(spark, rows), REFERENCE_BUS, F.lit(T0)).collect()
    got = {r.sequence: r.features for r in spark.read.parquet(f"{tmp_path}/alerts").collect()}
    assert len(got) == 80
    for r in want:
        for name in ("interarrival_ms", "bus_frequency_1s", "payload_signature_repeats_3s", "payload_sequence_repeat_count",
                     "replay_signature_repeats_1s", "rolling_interarrival_std"):
            assert got[r.sequence][name] == pytest.approx(r[name]), (r.sequence, name)


def test_json_lines_read_whole(spark, tmp_path):
    os.makedirs(f"{tmp_path}/j")
    with open(f"{tmp_path}/j/a.json", "w") as out:
        out.write(good_line(1) + "\n")
    row = read_frames(spark, f"{tmp_path}/j", "json").first()
    assert row["sequence"] == 1 and row["_corrupt_record"] is None


def test_rows_of_the_warm_up_are_the_same_by_either_path(spark, monkeypatch):
    """The few frames of the warm-up are decoded alone; many go the way of all frames."""
    from busguard.operators import baselines
    params = REFERENCE_BUS.with_(warmup_samples=10, min_warmup_bus_frequency=1.0)
    rows = [frame("0x110", {"rpm": 1000 + i, "raw_bytes": [i]}, T0 + (i // 2) * 100_000_000, sequence=i % 7) for i in range(40)]
    feats = detect.staged_features(frames_df(spark, rows), params, F.lit(T0))
    warm, art = detect.learn(feats, params)
    want = baselines.warmup_set(feats.narrow, params).select("_ord").collect()
    assert sorted(r["_ord"] for r in warm.collect()) == sorted(r["_ord"] for r in want) and len(want) == 10
    few = detect.warmup_rows(feats, art)
    assert "LeftSemi" in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(detect, "FEW_ROWS", 3)
    many = detect.warmup_rows(feats, art)
    assert "LeftSemi" not in many._jdf.queryExecution().optimizedPlan().toString()
    cols = sorted(few.columns)
    got = [sorted(map(str, x.select(*cols).collect())) for x in (few, many)]
    whole = feats.wide.filter(baselines.detector_phase(baselines.FitPoint(art.fit_key)) == "warmup")
    assert got[0] == got[1] == sorted(map(str, whole.select(*cols).collect())) and 10 <= len(got[0]) < 40
