"""Each security rule at and just below its threshold, plus the ensemble."""

import pytest
from pyspark.sql import functions as F

from busguard.functions import rules
from busguard.params import REFERENCE_BUS as P
from busguard.schema import ALL_FEATURES, RULE_NAMES

BASE = {c: 0.0 for c in ALL_FEATURES}
BASE.update(transition_probability=1.0, iat_exactness_ratio=1.0, odometer_km=-1.0)


def run(spark, overrides, key="0x110", raw=False, pred=1):
    row = dict(BASE, **overrides)
    cols = list(row)
    df = spark.createDataFrame([tuple(float(row[c]) for c in cols) + (key, raw)],
                               ", ".join(f"{c} double" for c in cols) + ", arbitration_key string, has_raw_bytes boolean")
    return df.select(rules.triggered_rules(P, F.lit(pred)).alias("r")).first()["r"]


CASES = [
    (RULE_NAMES[0], dict(id_frequency_1s=25), dict(id_frequency_1s=24), "0x000"),
    (RULE_NAMES[2], dict(speed=180), dict(speed=179.99), "0x110"),
    (RULE_NAMES[3], dict(acceleration=-7), dict(acceleration=6.99), "0x110"),
    (RULE_NAMES[4], dict(rpm=7000), dict(rpm=6999.9), "0x110"),
    (RULE_NAMES[5], dict(coolant_temp=130), dict(coolant_temp=129.9), "0x110"),
    (RULE_NAMES[6], dict(battery_voltage=11.5), dict(battery_voltage=0.0), "0x110"),
    (RULE_NAMES[7], dict(brake_pressure=0.1, wheel_speed_fr=70, brake_drop_per_second=500.1),
     dict(brake_pressure=0.1, wheel_speed_fr=70, brake_drop_per_second=500), "0x110"),
    (RULE_NAMES[8], dict(payload_signature_repeats_3s=4, payload_timing_replay_score=0.30),
     dict(payload_signature_repeats_3s=3, payload_timing_replay_score=0.9), "0x110"),
    (RULE_NAMES[10], dict(payload_sequence_replay_score=0.45 + 0.25), dict(payload_sequence_replay_score=0.69), "0x110"),
    (RULE_NAMES[14], dict(payload_sequence_repeat_count=3, payload_sequence_tight_timing_flag=1.0),
     dict(payload_sequence_repeat_count=2, payload_sequence_tight_timing_flag=1.0), "0x110"),
    (RULE_NAMES[16], dict(state_transition_violation_score=0.5), dict(state_transition_violation_score=0.45), "0x110"),
]


@pytest.mark.parametrize("name,hit,miss,key", CASES, ids=[c[0] for c in CASES])
def test_rule_threshold(spark, name, hit, miss, key):
    assert name in run(spark, hit, key)
    assert name not in run(spark, miss, key)


def test_unknown_id_raw_payload(spark):
    assert RULE_NAMES[1] in run(spark, {}, "0x7A1", raw=True)
    assert RULE_NAMES[1] not in run(spark, {}, "0x110", raw=True)
    assert RULE_NAMES[1] not in run(spark, {}, "0x7A1", raw=False)


def test_rare_sequence_replay_timing(spark):
    hit = dict(payload_signature_repeats_3s=4, rare_transition_flag=1.0, timing_anomaly_score=0.5,
               payload_timing_replay_score=0.25)
    assert RULE_NAMES[9] in run(spark, hit)
    assert RULE_NAMES[9] not in run(spark, dict(hit, rare_transition_flag=0.0))


def test_replay_chain_first_match_and_model(spark):
    f = dict(payload_sequence_repeat_count=1, payload_signature_repeats_3s=1)
    assert run(spark, f, pred=-1) == [RULE_NAMES[11]]
    assert run(spark, f, pred=1) == []
    g = dict(payload_sequence_repeat_count=1, timing_anomaly_score=0.95)
    assert run(spark, g, pred=-1) == [RULE_NAMES[13]]
    both = dict(payload_sequence_replay_score=0.9, payload_sequence_repeat_count=3, payload_sequence_tight_timing_flag=1.0)
    assert run(spark, both) == [RULE_NAMES[10]]  # only the first match is emitted
    assert run(spark, dict(payload_sequence_repeat_count=2, rare_transition_flag=1.0, timing_anomaly_score=0.5)) \
        == [RULE_NAMES[15]]


def test_order_score_reasons(spark):
    r = run(spark, dict(speed=200, rpm=8000, state_transition_violation_score=1.0, id_frequency_1s=30), "0x000")
    assert r == [RULE_NAMES[0], RULE_NAMES[2], RULE_NAMES[4], RULE_NAMES[16]]
    df = spark.createDataFrame([(-1, -0.2), (-1, -0.1), (1, -0.5)], "p int, s double")
    flags = [x[0] for x in df.select(rules.model_flag(F.col("p"), F.col("s"), P)).collect()]
    assert flags == [True, False, False]
    reasons = spark.createDataFrame([(True, ["impossible_speed"]), (False, [])], "m boolean, r array<string>") \
        .select(rules.decision_reasons(F.col("m"), F.col("r")).alias("x")).collect()
    assert reasons[0]["x"] == ["isolation_forest_severe_anomaly", "impossible_speed"] and reasons[1]["x"] == []
