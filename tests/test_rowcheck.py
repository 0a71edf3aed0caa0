"""Spark pipeline vs the brute-force checker on the driver's events fixture.

Also checks that the chunk / block splitting is invisible: tiny chunks and blocks force every row
through halos and carries, and several buses exercise the bus keys."""

import json

import pytest
from pyspark.sql import functions as F

from busguard.params import REFERENCE_BUS
from busguard.plans import detect
from busguard.sources.frames import frames_from_events
from tests import rowcheck

SF = "/root/testdata/sf0.001"
CHECK = ["interarrival_ms", "id_frequency_1s", "bus_frequency_1s", "id_entropy_1s", "dominant_id_ratio",
         "unique_ids_per_second", "payload_repeat_ratio", "bus_utilization", "repeated_id_ratio",
         "rolling_interarrival_mean", "rolling_interarrival_std", "replay_signature_repeats_1s",
         "payload_signature_repeats_3s", "payload_repeat_score", "payload_sequence_repeat_count",
         "payload_sequence_age_ms", "speed_delta_mps2", "rpm_delta_per_second", "coolant_delta_per_second",
         "brake_drop_per_second", "odometer_rollback_flag", "state_transition_violation_score",
         "transition_probability", "transition_surprise", "rare_transition_flag", "iat_robust_z", "iat_drop_flag",
         "iat_spike_flag", "iat_exactness_ratio", "iat_exactness_flag", "timing_anomaly_score",
         "payload_timing_replay_score", "payload_sequence_tight_timing_flag", "payload_sequence_replay_score"]

CASES = {
    "one_bus": REFERENCE_BUS.with_(min_warmup_bus_frequency=5.0, warmup_samples=200, use_model=False),
    "one_bus_tiny_chunks": REFERENCE_BUS.with_(min_warmup_bus_frequency=5.0, warmup_samples=200, use_model=False,
                                               chunk_ns=4_000_000_000, block_rows=301),
    "one_bus_small_deque_caps": REFERENCE_BUS.with_(min_warmup_bus_frequency=5.0, warmup_samples=200,
                                                    use_model=False, chunk_ns=4_000_000_000, block_rows=301,
                                                    bus_arrival_cap=6, id_arrival_cap=3),
    "one_bus_row_budget": REFERENCE_BUS.with_(min_warmup_bus_frequency=5.0, warmup_samples=200, use_model=False,
                                              chunk_ns=20_000_000_000, chunk_rows=12, block_rows=400),
    "three_buses_row_budget": REFERENCE_BUS.with_(bus_keys=("vehicle_id",), min_warmup_bus_frequency=3.0,
                                                  warmup_samples=150, use_model=False, chunk_ns=3_000_000_000,
                                                  chunk_rows=4, block_rows=305),
    "three_buses_tiny_chunks": REFERENCE_BUS.with_(bus_keys=("vehicle_id",), min_warmup_bus_frequency=3.0,
                                                   warmup_samples=150, use_model=False,
                                                   chunk_ns=3_500_000_000, block_rows=305),
}


@pytest.mark.parametrize("case", list(CASES))
def test_pipeline_matches_row_checker(spark, case):
    p = CASES[case]
    frames = frames_from_events(spark, SF)
    alerts, art = detect.detect(frames, p, F.lit(detect.FIXTURE_PROCESSING_NS), materialize=False)
    got = {r["sequence"]: r for r in alerts.select("sequence", "detector_phase", "triggered_rules", "features").collect()}
    rows = frames.select("sequence", "simulator_send_time_ns", "arbitration_id", "payload", "attack_type_label",
                         "vehicle_id").collect()
    recs = [{"sequence": r[0], "t": r[1], "key": r[2], "payload": json.loads(r[3]), "label": r[4], "vehicle_id": r[5]}
            for r in rows]
    bus_of = (lambda r: r["vehicle_id"]) if p.bus_keys else (lambda r: "")
    want = rowcheck.check(recs, bus_of, p)
    assert len(got) == len(want) == 1000
    assert sum(f["phase"] == "inference" for f in want) > 100, "fixture must reach the inference phase"
    bad = []
    for f in want:
        g = got[f["sequence"]]
        if g["detector_phase"] != f["phase"] or list(g["triggered_rules"]) != f["rules"]:
            bad.append((f["sequence"], "phase/rules", g["detector_phase"], f["phase"], g["triggered_rules"], f["rules"]))
        feats = g["features"].asDict()
        for c in CHECK:
            if feats[c] != pytest.approx(f[c], rel=1e-9, abs=1e-9):
                bad.append((f["sequence"], c, feats[c], f[c]))
    assert not bad, bad[:10]


def test_arrival_order_ties_match_row_checker(spark):
    """Many frames share an event time; with ``arrival_ties`` every window counts only frames that
    arrived before (the reference's order), which the row checker does by construction."""
    from tests.framekit import T0, frame, frames_df
    ids = ["0x110", "0x220", "0x330", "0x000", "0x110", "0x550"]
    payloads = [{"rpm": 1000}, {"rpm": 1100}, {"speed": 40, "acceleration": 0}, {"speed": 41},
                {"brake_pressure": 10, "wheel_speed_fl": 80}, {"coolant_temp": 90, "battery_voltage": 14}]
    rows = []
    for i in range(900):
        t = T0 + (i * 7_000_000 // 20_000_000) * 20_000_000           # about three frames per 20 ms slot
        k = (i * 7) % 6
        pl = {"rpm": 0, "raw_bytes": [0] * 8} if ids[k] == "0x000" else payloads[(i // 3) % 6]
        rows.append(frame(ids[k], pl, t, sequence=i, label="normal" if i % 11 else "replay"))
    assert len({r[2] for r in rows}) < 400  # ties everywhere
    df = frames_df(spark, rows)
    p = REFERENCE_BUS.with_(min_warmup_bus_frequency=5.0, warmup_samples=150, use_model=False, arrival_ties=True,
                            chunk_ns=3_000_000_000, block_rows=301)
    alerts, _ = detect.detect(df, p, F.lit(T0), materialize=False)
    got = {r["sequence"]: r for r in alerts.select("sequence", "detector_phase", "triggered_rules", "features").collect()}
    recs = [{"sequence": r[5], "t": r[2], "key": r[6], "payload": json.loads(r[8]), "label": r[9], "vehicle_id": r[3]}
            for r in rows]
    want = rowcheck.check(recs, lambda r: "", p)
    assert sum(f["phase"] == "inference" for f in want) > 300
    bad = []
    for f in want:
        g = got[f["sequence"]]
        if g["detector_phase"] != f["phase"] or list(g["triggered_rules"]) != f["rules"]:
            bad.append((f["sequence"], "phase/rules", g["triggered_rules"], f["rules"]))
        feats = g["features"].asDict()
        for c in CHECK:
            if feats[c] != pytest.approx(f[c], rel=1e-9, abs=1e-9):
                bad.append((f["sequence"], c, feats[c], f[c]))
    assert not bad, bad[:10]
