"""Scalar decode edge cases."""

import json
import math

import pytest
from pyspark.sql import functions as F

from busguard.functions import decode as DC
from busguard.params import REFERENCE_BUS
from busguard.schema import FRAME_SCHEMA
from tests.framekit import frame, frames_df


@pytest.mark.parametrize("arb,expected", [(None, -1), ("0x110", 272), ("0X1a", 26), ("0xZZ", -1), ("12", 12),
                                          ("-1", -1), ("abc", -1), ("0x000", 0), ("0x7FF", 2047)])
def test_parse_arbitration_id(spark, arb, expected):
    got = spark.createDataFrame([(arb,)], "a string").select(DC.parse_arbitration_id("a")).first()[0]
    assert got == expected


@pytest.mark.parametrize("value,expected", [(True, 1.0), (False, 0.0), (12, 12.0), ("12.5", 12.5), ("NaN", 0.0),
                                            ("inf", 0.0), ("abc", 0.0), (None, 0.0), ([1], 0.0), ({"a": 1}, 0.0)])
def test_numeric_signal(spark, value, expected):
    payload = json.dumps({"rpm": value})
    got = spark.createDataFrame([(payload,)], "p string").select(
        DC.numeric_signal(DC.payload_variant("p"), "rpm")).first()[0]
    assert got == expected


@pytest.mark.parametrize("value,expected", [(True, 1.0), (False, 0.0), (0, 0.0), (2, 1.0), ("", 0.0), ("x", 1.0),
                                            ([], 0.0), ([0], 1.0), ({}, 0.0), (None, 0.0)])
def test_bool_signal(spark, value, expected):
    payload = json.dumps({"abs_active": value})
    got = spark.createDataFrame([(payload,)], "p string").select(
        DC.bool_signal(DC.payload_variant("p"), "abs_active")).first()[0]
    assert got == expected


def test_missing_bool_is_false(spark):
    got = spark.createDataFrame([("{}",)], "p string").select(
        DC.bool_signal(DC.payload_variant("p"), "abs_active")).first()[0]
    assert got == 0.0


@pytest.mark.parametrize("raw,mean,std", [(None, 0.0, 0.0), ([], 0.0, 0.0), (["1", None], 0.0, 0.0),
                                          ([1, 2, 3], 2.0, math.sqrt(2 / 3)), ([1, "x", True, 3], 5 / 3, None)])
def test_raw_byte_stats(spark, raw, mean, std):
    rows = [frame("0x000", {"raw_bytes": raw})]
    d = DC.decode_frames(frames_df(spark, rows), REFERENCE_BUS).first()
    assert d["raw_byte_mean"] == pytest.approx(mean)
    if std is not None:
        assert d["raw_byte_std"] == pytest.approx(std)


def test_non_object_payload_is_empty_and_invalid_json_quarantined(spark):
    rows = [frame(raw_payload="[1, 2]"), frame(raw_payload="{not json"), frame(raw_payload="null")]
    d = DC.decode_frames(frames_df(spark, rows), REFERENCE_BUS).orderBy("_ord").collect()
    assert [r["payload_valid"] for r in d] == [True, False, True]
    assert d[0]["rpm"] == 0.0 and d[0]["odometer_km"] == -1.0 and d[0]["payload_signature"] == "{}"
    assert d[0]["has_raw_bytes"] is False


def test_raw_bytes_key_present_even_if_null(spark):
    d = DC.decode_frames(frames_df(spark, [frame("0x7A1", {"raw_bytes": None})]), REFERENCE_BUS).first()
    assert d["has_raw_bytes"] is True


def test_event_time_and_priority(spark):
    df = spark.createDataFrame([(None, 5), (7, 5), (None, None)], "ns long, ms long")
    got = [r[0] for r in df.select(DC.event_time_ns("ns", "ms", F.lit(99))).collect()]
    assert got == [5_000_000, 7, 99]
    pr = spark.createDataFrame([(-1,), (0,), (15,), (16,), (2047,), (4000,)], "i long").select(
        DC.reserved_id_flag("i"), DC.arbitration_priority_score("i")).collect()
    assert [r[0] for r in pr] == [1.0, 1.0, 1.0, 0.0, 0.0, 0.0]
    assert [round(r[1], 6) for r in pr] == [0.0, 1.0, round(1 - 15 / 2047, 6), round(1 - 16 / 2047, 6), 0.0, 0.0]


def test_signature_sorts_keys(spark):
    d = DC.decode_frames(frames_df(spark, [frame(raw_payload='{"b": 1, "a": {"d": 2, "c": 3}}')]), REFERENCE_BUS).first()
    assert d["payload_signature"] == '{"a":{"c":3,"d":2},"b":1}'


def test_a_payload_is_parsed_once_and_once_for_the_filter(spark):
    """Reading the payload's fields took two parses and a third one of its keys for every frame."""
    from busguard.plans import detect
    out = detect.decoded_frames(spark.range(1).select(*[
        F.col("id").cast(FRAME_SCHEMA[c].dataType).alias(c) for c in FRAME_SCHEMA.names
        if FRAME_SCHEMA[c].dataType.simpleString() not in ("boolean", "timestamp", "timestamp_ntz")]), REFERENCE_BUS).select("speed", "abs_active", "has_raw_bytes", "raw_byte_mean", "sig")
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("json_object_keys") == 0 and plan.count("parsejson") <= 2, plan


@pytest.mark.parametrize("payload,has_raw,rpm,lane", [
    (' \n\t{"raw_bytes":[1,2],"rpm":3}', True, 3.0, 0.0), ('{"raw_bytes":null,"lane_assist_active":null}', True, 0.0, 0.0),
    ('[{"raw_bytes":[1],"rpm":3}]', False, 0.0, 0.0), ('"{raw_bytes"', False, 0.0, 0.0), ("null", False, 0.0, 0.0),
    (None, False, 0.0, 0.0), ('{"a":{"raw_bytes":[1]},"rpm":true,"lane_assist_active":"x"}', False, 1.0, 1.0),
    ('{"raw\\u005fbytes":"ab","rpm":"7","lane_assist_active":[]}', True, 7.0, 0.0)])
def test_objects_are_told_by_their_first_character(spark, payload, has_raw, rpm, lane):
    from busguard.plans import detect
    df = frames_df(spark, [frame(sequence=1)]).withColumn("payload", F.lit(payload).cast("string"))
    row = detect.decoded_frames(df, REFERENCE_BUS).first()
    assert (row["has_raw_bytes"], row["rpm"], row["lane_assist_active"]) == (has_raw, rpm, lane)
