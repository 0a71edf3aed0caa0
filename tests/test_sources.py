"""Sources and sinks: Kafka options, JSON frames, publish form, alert indices, ids."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from busguard.sources import alerts as A
from busguard.sources.frames import frame_key_value, kafka_options, read_frames
from tests.framekit import frame, frames_df


def test_kafka_options():
    o = kafka_options("b1:9093", "can-telematics", "earliest", 500, "u", "p", "/ca.pem")
    assert o["subscribe"] == "can-telematics" and o["startingOffsets"] == "earliest"
    assert o["maxOffsetsPerTrigger"] == "500" and o["kafka.security.protocol"] == "SASL_SSL"
    assert o["kafka.sasl.mechanism"] == "PLAIN" and 'username="u"' in o["kafka.sasl.jaas.config"]
    assert o["kafka.ssl.truststore.location"] == "/ca.pem"
    assert "kafka.security.protocol" not in kafka_options("b", "t")


def test_json_frames_and_key_value(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "f.json"), "w") as fh:
        fh.write(json.dumps({"timestamp": "2024-01-01T00:00:00Z", "simulator_send_time_ns": 5, "vehicle_id": "V1",
                             "session_id": "s", "sequence": 1, "arbitration_id": "0x110", "dlc": 8,
                             "payload": "{\"rpm\": 1}", "attack_type_label": "normal"}) + "\n")
    df = read_frames(spark, d, "json")
    row = df.first()
    assert row["arbitration_id"] == "0x110" and row["benchmark_scored"] is None and "_ord" in df.columns
    kv = frame_key_value(df.drop("_ord")).first()
    assert kv["key"] == "V1:0x110" and json.loads(kv["value"])["sequence"] == 1


def test_alert_indices_union_and_overwrite(spark):
    d = tempfile.mkdtemp()
    base = frames_df(spark, [frame(sequence=i, label="normal" if i % 2 else "dos") for i in range(6)]).drop("_ord") \
        .withColumn("is_anomaly", F.lit(False))
    A.write_alerts(base, f"{d}/can-security-alerts-a", "overwrite")
    A.write_alerts(base.drop("is_anomaly"), f"{d}/can-security-alerts-b", "overwrite")
    got = A.read_alerts(spark, f"{d}/can-security-alerts-*")
    assert got.count() == 12 and got.filter(F.col("is_anomaly").isNull()).count() == 6
    # dynamic overwrite replaces only the partitions written
    A.write_alerts(base.filter(F.col("attack_type_label") == "dos"), f"{d}/can-security-alerts-a", "overwrite")
    assert A.read_alerts(spark, f"{d}/can-security-alerts-a").count() == 6


def test_document_id_dedupe(spark):
    rows = [frame(sequence=1), frame(sequence=1, send_ns=2), frame(sequence=2)]
    df = frames_df(spark, rows).withColumn("event_time_ns", F.col("simulator_send_time_ns"))
    ids = A.document_id(df)
    assert ids.select("document_id").distinct().count() == 3
    again = ids.unionByName(ids).dropDuplicates(["document_id"])
    assert again.count() == 3


def test_filters_of_decoded_frames_stay_above_the_adapter(spark, tmp_path):
    """F2-F16: the filter on valid payloads must not be pushed below the adapter, where it builds the payload again."""
    from busguard.params import REFERENCE_BUS
    from busguard.plans import detect
    from busguard.sources.frames import frames_from_events

    spark.sql("select 1L event_id, timestamp'2024-01-02 03:04:05' ts, 7L user_id, 'view' event_type, 1.0D value, "
              "'{\"k\": 5}' props").write.parquet(f"{tmp_path}/events.parquet")
    decoded = detect.decoded_frames(frames_from_events(spark, str(tmp_path)), REFERENCE_BUS)
    lines = decoded._jdf.queryExecution().optimizedPlan().toString().splitlines()
    filters = [x for x in lines if "Filter" in x]
    assert filters and all("CASE WHEN" not in x for x in filters)
    assert decoded.select("payload", "rpm").first() == ('{"rpm":1100}', 1100.0)


def test_queries_hold_no_wide_table_in_memory(spark, tmp_path):
    """F2-F16: features come from a stage table; learned features and alerts are computed where they are read."""
    from busguard.plans import catalog

    spark.range(300).selectExpr("id event_id", "timestamp'2024-01-02 03:04:05' + make_interval(0, 0, 0, 0, 0, 0, id * 20) ts",
                                "id % 9 user_id", "'view' event_type", "1.0D value", "concat('{\"k\": ', id % 80, '}') props") \
        .write.parquet(f"{tmp_path}/events.parquet")
    sf = str(tmp_path)
    for df in (catalog.feats(spark, sf), catalog.learned_state(spark, sf)[2], catalog.alerts(spark, sf)):
        assert not df.is_cached and not df.storageLevel.useMemory
    assert catalog.alerts(spark, sf).count() == 300
