"""Schemas and fixed name lists."""

from __future__ import annotations

from pyspark.sql import types as T

FRAME_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("event_time_epoch_ms", T.LongType()),
    T.StructField("simulator_send_time_ns", T.LongType()),
    T.StructField("vehicle_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("sequence", T.LongType()),
    T.StructField("arbitration_id", T.StringType()),
    T.StructField("dlc", T.IntegerType()),
    T.StructField("payload", T.StringType()),
    T.StructField("attack_type_label", T.StringType()),
    T.StructField("attack_phase", T.StringType()),
    T.StructField("benchmark_scored", T.BooleanType()),
    T.StructField("replayed_original_sequence", T.LongType()),
])

FRAME_COLUMNS = [f.name for f in FRAME_SCHEMA.fields]

# Fixed values that must equal the reference detector.
# Model input vector, in this exact order.
FEATURE_COLUMNS = [
    "arbitration_id_numeric",
    "rpm",
    "speed",
    "brake_pressure",
    "coolant_temp",
    "throttle_position",
    "engine_load",
    "gear",
    "abs_active",
    "wheel_speed_fl",
    "wheel_speed_fr",
    "acceleration",
    "steering_angle",
    "yaw_rate",
    "lane_assist_active",
    "battery_voltage",
    "ambient_temp",
    "raw_byte_mean",
    "raw_byte_std",
    "interarrival_ms",
    "id_frequency_1s",
    "bus_frequency_1s",
    "id_entropy_1s",
    "dominant_id_ratio",
    "rolling_interarrival_mean",
    "rolling_interarrival_std",
    "bus_utilization",
    "repeated_id_ratio",
    "reserved_id_flag",
    "arbitration_priority_score",
    "unique_ids_per_second",
    "payload_repeat_ratio",
]

# Payload signals read as numbers (default 0.0) and as truthiness flags.
NUMERIC_SIGNALS = [
    "rpm", "speed", "brake_pressure", "coolant_temp", "throttle_position", "engine_load", "gear",
    "wheel_speed_fl", "wheel_speed_fr", "acceleration", "steering_angle", "yaw_rate",
    "battery_voltage", "ambient_temp",
]
BOOL_SIGNALS = ["abs_active", "lane_assist_active"]

PAYLOAD_FEATURES = [
    "arbitration_id_numeric", "rpm", "speed", "brake_pressure", "coolant_temp", "throttle_position",
    "engine_load", "gear", "abs_active", "wheel_speed_fl", "wheel_speed_fr", "acceleration",
    "steering_angle", "yaw_rate", "lane_assist_active", "battery_voltage", "ambient_temp",
    "odometer_km", "raw_byte_mean", "raw_byte_std",
]
TRAFFIC_FEATURES = [
    "interarrival_ms", "id_frequency_1s", "bus_frequency_1s", "id_entropy_1s", "dominant_id_ratio",
    "rolling_interarrival_mean", "rolling_interarrival_std", "bus_utilization", "repeated_id_ratio",
    "reserved_id_flag", "arbitration_priority_score", "unique_ids_per_second", "payload_repeat_ratio",
    "replay_signature_repeats_1s",
]
TRANSITION_FEATURES = ["transition_probability", "transition_surprise", "rare_transition_flag"]
TIMING_FEATURES = [
    "iat_robust_z", "iat_drop_flag", "iat_spike_flag", "iat_exactness_ratio", "iat_exactness_flag",
    "timing_anomaly_score",
]
REPEAT_FEATURES = ["payload_signature_repeats_3s", "payload_repeat_score", "payload_timing_replay_score"]
SEQUENCE_FEATURES = [
    "payload_sequence_repeat_count", "payload_sequence_age_ms", "payload_sequence_tight_timing_flag",
    "payload_sequence_replay_score",
]
STATE_FEATURES = [
    "state_transition_violation_score", "speed_delta_mps2", "rpm_delta_per_second",
    "coolant_delta_per_second", "brake_drop_per_second", "odometer_rollback_flag",
]
ALL_FEATURES = (PAYLOAD_FEATURES + TRAFFIC_FEATURES + TRANSITION_FEATURES + TIMING_FEATURES
                + REPEAT_FEATURES + SEQUENCE_FEATURES + STATE_FEATURES)

# The known arbitration ids, the flood id, labels and rule names, in output order.
NORMAL_ARBITRATION_IDS = ["0x110", "0x220", "0x330", "0x440", "0x550"]
FLOOD_ARBITRATION_ID = "0x000"
ATTACK_TYPES = ["fuzz", "replay", "injection", "dos"]
REQUIRED_LABELS = ["normal", "fuzz", "replay", "injection", "dos"]
RULE_NAMES = [
    "dominant_low_priority_id_flood",
    "unknown_id_raw_payload",
    "impossible_speed",
    "impossible_acceleration",
    "rpm_redline_violation",
    "thermal_limit_violation",
    "battery_voltage_drop",
    "brake_suppression",
    "replayed_payload_signature_cluster",
    "rare_sequence_replay_timing",
    "payload_ngram_replay_tight_timing",
    "replay_sequence_model_repeat_confluence",
    "replay_sequence_rare_timing_confluence",
    "replay_sequence_model_timing_confluence",
    "repeated_payload_sequence_tight_timing",
    "payload_sequence_rare_transition_replay",
    "physics_state_transition_violation",
]
MODEL_REASON = "isolation_forest_severe_anomaly"

REPORT_COLUMNS = [
    "attack_type", "total", "tp", "tn", "fp", "fn", "detection_rate", "precision", "recall", "f1",
    "false_positive_rate", "accuracy",
]

FEATURES_STRUCT = T.StructType([T.StructField(c, T.DoubleType()) for c in ALL_FEATURES])
