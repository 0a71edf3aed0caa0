"""DuckDB text of the same computations, written the plain way (no chunks, no halos, no markers).

The check runs each ``queries()`` entry on Spark and the matching SQL here on DuckDB over the same
parquet tables.  Fragments are CTE bodies composed with ``with_ctes``.  Computed floating values
are rounded to 6 decimals in both engines where summation order differs.
"""

from __future__ import annotations

import re

from busguard.params import REFERENCE_BUS as P
from busguard.schema import MODEL_REASON, RULE_NAMES
from busguard.sources.frames import FRAMES_SQL, ROUGH_SQL

S = 1_000_000_000
NUM_SIGNALS = ["rpm", "speed", "brake_pressure", "coolant_temp", "throttle_position", "engine_load", "gear",
               "wheel_speed_fl", "wheel_speed_fr", "acceleration", "steering_angle", "yaw_rate",
               "battery_voltage", "ambient_temp"]


def _num(key: str, default: float = 0.0) -> str:
    x = f"TRY_CAST(json_extract_string(payload, '$.{key}') AS DOUBLE)"
    return f"CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN {default} ELSE {x} END"


def _bool(key: str) -> str:
    j = f"json_extract(payload, '$.{key}')"
    return (f"CASE WHEN {j} IS NULL OR json_type({j}) = 'NULL' THEN 0.0 "
            f"WHEN json_type({j}) = 'BOOLEAN' THEN CASE WHEN CAST({j} AS BOOLEAN) THEN 1.0 ELSE 0.0 END "
            f"WHEN json_type({j}) IN ('BIGINT','UBIGINT','DOUBLE') THEN CASE WHEN CAST({j} AS DOUBLE) <> 0 THEN 1.0 ELSE 0.0 END "
            f"WHEN json_type({j}) = 'VARCHAR' THEN CASE WHEN length(json_extract_string(payload, '$.{key}')) > 0 THEN 1.0 ELSE 0.0 END "
            f"WHEN json_type({j}) = 'ARRAY' THEN CASE WHEN json_array_length({j}) > 0 THEN 1.0 ELSE 0.0 END "
            f"ELSE 1.0 END")


_raw = "CAST(json_extract(payload, '$.raw_bytes') AS DOUBLE[])"

DECODED_SQL = f"""
dec AS (
  SELECT *,
    COALESCE(simulator_send_time_ns, event_time_epoch_ms * 1000000) AS t,
    COALESCE(arbitration_id, 'None') AS akey,
    COALESCE(attack_type_label, 'normal') AS label,
    payload AS sig,
    CAST(CASE WHEN arbitration_id IS NULL THEN -1
         WHEN regexp_matches(arbitration_id, '^0[xX][0-9A-Fa-f]+$') THEN
              COALESCE(TRY_CAST(('0x' || substr(arbitration_id, 3)) AS BIGINT), -1)
         WHEN regexp_matches(arbitration_id, '^[+-]?[0-9]+$') THEN COALESCE(TRY_CAST(arbitration_id AS BIGINT), -1)
         ELSE -1 END AS DOUBLE) AS arbitration_id_numeric,
    {', '.join(f'{_num(k)} AS {k}' for k in NUM_SIGNALS)},
    {_bool('abs_active')} AS abs_active,
    {_bool('lane_assist_active')} AS lane_assist_active,
    {_num('odometer_km', -1.0)} AS odometer_km,
    CASE WHEN len({_raw}) > 0 THEN list_avg({_raw}) ELSE 0.0 END AS raw_byte_mean,
    CASE WHEN len({_raw}) > 0 THEN
      sqrt(list_sum(list_transform({_raw}, lambda x: (x - list_avg({_raw})) * (x - list_avg({_raw})))) / len({_raw}))
      ELSE 0.0 END AS raw_byte_std,
    COALESCE(list_contains(json_keys(payload), 'raw_bytes'), false) AS has_raw_bytes
  FROM frames
)"""

# Baseline-free features, one merged bus, plain windows.
FEATS_SQL = f"""
w1 AS (
  SELECT *,
    (t - lag(t) OVER (PARTITION BY akey ORDER BY t, "sequence")) / 1e6 AS gap,
    CAST(t - lag(t) OVER (PARTITION BY akey ORDER BY t, "sequence") AS DECIMAL(38,0)) AS gap_ns,
    lag(t) OVER (PARTITION BY akey, sig ORDER BY t, "sequence") AS prev_sig_t,
    lag(akey) OVER (ORDER BY t, "sequence") AS previous_bus_id,
    lag(sig, 2) OVER (PARTITION BY akey ORDER BY t, "sequence") AS sig2,
    lag(sig, 1) OVER (PARTITION BY akey ORDER BY t, "sequence") AS sig1,
    lag(t) OVER (PARTITION BY akey ORDER BY t, "sequence") AS prev_t,
    lag(speed) OVER (PARTITION BY akey ORDER BY t, "sequence") AS p_speed,
    lag(rpm) OVER (PARTITION BY akey ORDER BY t, "sequence") AS p_rpm,
    lag(coolant_temp) OVER (PARTITION BY akey ORDER BY t, "sequence") AS p_cool,
    lag(brake_pressure) OVER (PARTITION BY akey ORDER BY t, "sequence") AS p_brake,
    lag(odometer_km) OVER (PARTITION BY akey ORDER BY t, "sequence") AS p_odo,
    count(*) OVER (ORDER BY t RANGE BETWEEN {S} PRECEDING AND CURRENT ROW) AS bus_n,
    count(*) OVER (PARTITION BY akey ORDER BY t RANGE BETWEEN {S} PRECEDING AND CURRENT ROW) AS id_n,
    count(*) OVER (PARTITION BY akey, sig ORDER BY t RANGE BETWEEN {P.repeat_window_ns} PRECEDING AND CURRENT ROW) AS sig_n3,
    list(akey) OVER (ORDER BY t RANGE BETWEEN {S} PRECEDING AND CURRENT ROW) AS ids,
    list(sig) OVER (ORDER BY t RANGE BETWEEN {S} PRECEDING AND CURRENT ROW) AS sigs
  FROM dec
), w2 AS (
  SELECT *,
    CASE WHEN sig2 IS NOT NULL THEN sig2 || chr(1) || sig1 || chr(1) || sig END AS ngram,
    CASE WHEN prev_sig_t IS NOT NULL AND t - prev_sig_t > {P.replay_suspicion_age_ns} THEN 1 ELSE 0 END AS suspicious,
    count(gap_ns) OVER r AS n_gaps,
    sum(gap_ns) OVER r AS a_s1, sum(gap_ns * gap_ns) OVER r AS a_s2,
    count(CASE WHEN gap_ns > 0 THEN gap_ns END) OVER r AS p_n,
    sum(CASE WHEN gap_ns > 0 THEN gap_ns END) OVER r AS p_s1, sum(CASE WHEN gap_ns > 0 THEN gap_ns * gap_ns END) OVER r AS p_s2,
    list_transform(list_distinct(ids), lambda x: len(list_filter(ids, lambda y: y = x))) AS id_counts,
    list_max(list_transform(list_distinct(sigs), lambda x: len(list_filter(sigs, lambda y: y = x)))) AS sig_max
  FROM w1
  WINDOW r AS (PARTITION BY akey ORDER BY t, "sequence" ROWS BETWEEN {P.interarrival_rows - 1} PRECEDING AND CURRENT ROW)
), w3 AS (
  SELECT *,
    sum(suspicious) OVER (PARTITION BY akey ORDER BY t RANGE BETWEEN {S} PRECEDING AND CURRENT ROW) AS replay_n,
    CASE WHEN ngram IS NOT NULL THEN row_number() OVER (PARTITION BY akey, ngram ORDER BY t, "sequence") - 1 END AS ng_n,
    CASE WHEN ngram IS NOT NULL THEN lag(t) OVER (PARTITION BY akey, ngram ORDER BY t, "sequence") END AS ng_prev_t,
    greatest(1e-3, (t - prev_t) / 1e9) AS elapsed
  FROM w2
), feats AS (
  SELECT *,
    COALESCE(gap, 0.0) AS interarrival_ms,
    CAST(id_n AS DOUBLE) AS id_frequency_1s,
    CAST(bus_n AS DOUBLE) AS bus_frequency_1s,
    CASE WHEN bus_n <= 1 THEN 0.0 ELSE
      -list_sum(list_transform(id_counts, lambda c: (c / bus_n) * log2(c / bus_n))) / log2(greatest(2, len(id_counts))) END
      AS id_entropy_1s,
    list_max(id_counts) / bus_n AS dominant_id_ratio,
    CAST(len(id_counts) AS DOUBLE) AS unique_ids_per_second,
    least(1.0, bus_n / {P.bus_capacity_per_s}) AS bus_utilization,
    id_n / bus_n AS repeated_id_ratio,
    sig_max / bus_n AS payload_repeat_ratio,
    CAST(replay_n AS DOUBLE) AS replay_signature_repeats_1s,
    CASE WHEN n_gaps > 0 THEN CAST(a_s1 AS DOUBLE) / CAST(n_gaps AS DOUBLE) / 1e6 ELSE 0.0 END AS rolling_interarrival_mean,
    CASE WHEN n_gaps > 0 THEN sqrt(CAST(CAST(n_gaps AS DECIMAL(38,0)) * a_s2 - a_s1 * a_s1 AS DOUBLE)
      / (CAST(n_gaps AS DOUBLE) * CAST(n_gaps AS DOUBLE))) / 1e6 ELSE 0.0 END AS rolling_interarrival_std,
    CASE WHEN p_n > 0 AND CAST(p_s1 AS DOUBLE) / CAST(p_n AS DOUBLE) / 1e6 > 0 THEN
      (sqrt(CAST(CAST(p_n AS DECIMAL(38,0)) * p_s2 - p_s1 * p_s1 AS DOUBLE) / (CAST(p_n AS DOUBLE) * CAST(p_n AS DOUBLE))) / 1e6)
      / (CAST(p_s1 AS DOUBLE) / CAST(p_n AS DOUBLE) / 1e6) ELSE 0.0 END AS rolling_cv,
    CASE WHEN arbitration_id_numeric <= 15 THEN 1.0 ELSE 0.0 END AS reserved_id_flag,
    CASE WHEN arbitration_id_numeric < 0 THEN 0.0 ELSE 1.0 - least(arbitration_id_numeric, 2047) / 2047 END
      AS arbitration_priority_score,
    CAST(sig_n3 - 1 AS DOUBLE) AS payload_signature_repeats_3s,
    least(1.0, (sig_n3 - 1) / 12.0) AS payload_repeat_score,
    CAST(CASE WHEN ng_n IS NULL THEN 0 ELSE ng_n END AS DOUBLE) AS payload_sequence_repeat_count,
    CASE WHEN ng_prev_t IS NOT NULL THEN (t - ng_prev_t) / 1e6 ELSE 0.0 END AS payload_sequence_age_ms,
    CASE WHEN prev_t IS NULL THEN 0.0 ELSE (speed - p_speed) * 0.277778 / elapsed END AS speed_delta_mps2,
    CASE WHEN prev_t IS NULL THEN 0.0 ELSE abs(rpm - p_rpm) / elapsed END AS rpm_delta_per_second,
    CASE WHEN prev_t IS NULL THEN 0.0 ELSE abs(coolant_temp - p_cool) / elapsed END AS coolant_delta_per_second,
    CASE WHEN prev_t IS NULL THEN 0.0 ELSE (p_brake - brake_pressure) / elapsed END AS brake_drop_per_second,
    CASE WHEN prev_t IS NOT NULL AND odometer_km >= 0 AND p_odo >= 0 AND odometer_km + 0.001 < p_odo THEN 1.0 ELSE 0.0 END
      AS odometer_rollback_flag,
    CASE WHEN prev_t IS NULL THEN 0.0 ELSE least(1.0,
        CASE WHEN abs((speed - p_speed) * 0.277778 / elapsed) > 12.0 THEN 0.45 ELSE 0.0 END
      + CASE WHEN abs(rpm - p_rpm) / elapsed > 4500.0 THEN 0.30 ELSE 0.0 END
      + CASE WHEN abs(coolant_temp - p_cool) / elapsed > 8.0 THEN 0.25 ELSE 0.0 END
      + CASE WHEN (p_brake - brake_pressure) / elapsed > 500.0 AND brake_pressure <= 0.1 THEN 0.30 ELSE 0.0 END
      + CASE WHEN odometer_km >= 0 AND p_odo >= 0 AND odometer_km + 0.001 < p_odo THEN 0.50 ELSE 0.0 END) END
      AS state_transition_violation_score
  FROM w3
)"""


_DECIMAL_LITERAL = re.compile(r"(?<![\w.'%])(\d+\.\d+)(?![\w.])")


def doubles(sql: str) -> str:
    """Type decimal literals as DOUBLE: the reference computes in binary floating point (and DuckDB
    would otherwise infer DECIMAL columns for flags and scores)."""
    return _DECIMAL_LITERAL.sub(r"CAST(\1 AS DOUBLE)", sql)


def bigint_counts(sql: str) -> str:
    """``count_if(c)`` -> ``count(*) FILTER (WHERE c)``: a BIGINT like Spark's count_if."""
    out, i, tag = [], 0, "count_if("
    while True:
        j = sql.find(tag, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(tag)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j] + f"count(*) FILTER (WHERE {sql[j + len(tag):k - 1]})")
        i = k


def with_ctes(*bodies: str, select: str) -> str:
    return bigint_counts(doubles("WITH " + ",\n".join(b.strip() for b in bodies) + "\n" + select))


def features_query(select: str) -> str:
    return with_ctes(FRAMES_SQL, DECODED_SQL, FEATS_SQL, select=select)

N = P.warmup_samples

# Warm-up gate, phase, baselines learned from the first N accepted frames, and the features that
# read them (transition W20, timing W21-W24, W13, W17, W18).
LEARNED_SQL = f"""
acc AS (
  SELECT *, (label = 'normal' AND bus_frequency_1s >= {P.min_warmup_bus_frequency}) AS accepted FROM feats
), ph AS (
  SELECT *, COALESCE(sum(CASE WHEN accepted THEN 1 ELSE 0 END)
      OVER (ORDER BY t, "sequence" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS acc_before
  FROM acc
), phased AS (
  SELECT *, CASE WHEN acc_before >= {N} THEN 'inference' ELSE 'warmup' END AS detector_phase FROM ph
), warm AS (
  SELECT * FROM ph WHERE accepted AND acc_before < {N}
), tb_src AS (
  SELECT akey, interarrival_ms AS g,
    row_number() OVER (PARTITION BY akey ORDER BY t DESC, "sequence" DESC) AS r
  FROM warm WHERE interarrival_ms > 0
), tb_pos AS (
  SELECT * FROM tb_src WHERE r <= {P.baseline_sample_cap}
), tb_m AS (
  SELECT akey, quantile_cont(g, 0.5) AS median, avg(g) AS mean, stddev_pop(g) AS std,
    CAST(count(*) AS DOUBLE) AS cnt FROM tb_pos GROUP BY akey
), tb AS (
  SELECT m.akey AS arbitration_id, m.median, quantile_cont(abs(p.g - m.median), 0.5) AS mad, m.mean, m.std,
    CASE WHEN m.mean > 0 THEN m.std / m.mean ELSE 0.0 END AS cv, m.cnt AS "count"
  FROM tb_m m JOIN tb_pos p ON p.akey = m.akey GROUP BY m.akey, m.median, m.mean, m.std, m.cnt
), tm_p AS (
  SELECT lag(akey) OVER (ORDER BY t, "sequence") AS prev_id, akey AS next_id FROM warm
), tm_c AS (
  SELECT prev_id, next_id, count(*) AS n FROM tm_p WHERE prev_id IS NOT NULL AND prev_id <> '' GROUP BY prev_id, next_id
), tm AS (
  SELECT *, CAST(sum(n) OVER (PARTITION BY prev_id) AS BIGINT) AS total, count(*) OVER (PARTITION BY prev_id) AS next_ids FROM tm_c
), tm_tot AS (
  SELECT DISTINCT prev_id, total, next_ids FROM tm
), lj AS (
  SELECT f.*, b.median AS b_median, b.mad AS b_mad, b.cv AS b_cv, b."count" AS b_count,
    p.n AS t_n, u.total AS t_total, u.next_ids AS t_k, (f.detector_phase = 'inference') AS ready
  FROM phased f
  LEFT JOIN tb b ON f.detector_phase = 'inference' AND b.arbitration_id = f.akey
  LEFT JOIN tm p ON f.detector_phase = 'inference' AND p.prev_id = f.previous_bus_id AND p.next_id = f.akey
  LEFT JOIN tm_tot u ON f.detector_phase = 'inference' AND u.prev_id = f.previous_bus_id
), tr AS (
  SELECT *,
    (CAST(COALESCE(t_n, 0) AS DOUBLE) + {P.transition_alpha})
      / (COALESCE(t_total, 0) + {P.transition_alpha} * CASE WHEN COALESCE(t_k, 0) > 1 THEN t_k ELSE 1 END) AS p_tr,
    (NOT ready OR previous_bus_id IS NULL OR previous_bus_id = '' OR COALESCE(t_total, 0) < {P.transition_min_total})
      AS tr_neutral,
    (b_count IS NULL OR b_count < {P.baseline_min_timing_samples} OR interarrival_ms <= 0) AS tm_neutral,
    (interarrival_ms - b_median) / (1.4826 * CASE WHEN b_mad > 0.5 THEN b_mad ELSE 0.5 END) AS z,
    rolling_cv / CASE WHEN b_cv > 0.01 THEN b_cv ELSE 0.01 END AS ratio
  FROM lj
), tr2 AS (
  SELECT *,
    CASE WHEN tr_neutral THEN 1.0 ELSE p_tr END AS transition_probability,
    CASE WHEN tr_neutral THEN 0.0 ELSE -ln(CASE WHEN p_tr > 1e-9 THEN p_tr ELSE 1e-9 END) END AS transition_surprise,
    CASE WHEN tr_neutral THEN 0.0 WHEN p_tr < {P.transition_rare_below} THEN 1.0 ELSE 0.0 END AS rare_transition_flag,
    COALESCE(least(n_gaps, {P.interarrival_rows}) >= {P.baseline_min_timing_samples} AND b_cv >= 0.03
             AND ratio <= {P.exactness_cv_ratio}, false) AS exact
  FROM tr
), tr3 AS (
  SELECT *,
    CASE WHEN tm_neutral THEN 0.0 ELSE z END AS iat_robust_z,
    CASE WHEN tm_neutral THEN 0.0 WHEN z <= -{P.iat_robust_z} THEN 1.0 ELSE 0.0 END AS iat_drop_flag,
    CASE WHEN tm_neutral THEN 0.0 WHEN z >= {P.iat_robust_z} THEN 1.0 ELSE 0.0 END AS iat_spike_flag,
    CASE WHEN tm_neutral THEN 1.0 ELSE ratio END AS iat_exactness_ratio,
    CASE WHEN tm_neutral THEN 0.0 WHEN exact THEN 1.0 ELSE 0.0 END AS iat_exactness_flag,
    CASE WHEN tm_neutral THEN 0.0 ELSE least(1.0, greatest(abs(z) / 8.0,
        CASE WHEN exact THEN 1.0 - least(1.0, ratio) ELSE 0.0 END)) END AS timing_anomaly_score
  FROM tr2
), tr4 AS (
  SELECT *,
    CASE WHEN iat_spike_flag = 1.0 AND timing_anomaly_score < 0.75 THEN 0.75 ELSE timing_anomaly_score END AS boost1
  FROM tr3
), tr5 AS (
  SELECT *,
    payload_repeat_score * CASE WHEN iat_exactness_flag = 1.0 AND boost1 < 0.65 THEN 0.65 ELSE boost1 END
      AS payload_timing_replay_score,
    ((COALESCE(b_median, 0.0) > 0 AND interarrival_ms > 0 AND interarrival_ms <= COALESCE(b_median, 0.0) * {P.ngram_tight_ratio})
      OR iat_drop_flag = 1.0 OR iat_exactness_flag = 1.0) AS tight
  FROM tr4
), lf AS (
  SELECT *,
    CASE WHEN ngram IS NOT NULL AND tight THEN 1.0 ELSE 0.0 END AS payload_sequence_tight_timing_flag,
    CASE WHEN ngram IS NULL THEN 0.0 ELSE least(1.0,
        CASE WHEN payload_sequence_repeat_count >= {P.ngram_min_repeats} THEN 0.45 ELSE 0.0 END
      + CASE WHEN payload_sequence_repeat_count >= {P.ngram_min_repeats} AND tight THEN 0.45 ELSE 0.0 END
      + CASE WHEN payload_sequence_repeat_count >= 1 AND timing_anomaly_score >= 0.65 THEN 0.25 ELSE 0.0 END) END
      AS payload_sequence_replay_score
  FROM tr5
)"""

_KNOWN = ", ".join(f"'{x}'" for x in P.known_ids)


def rules_sql(prediction: str = "1", score: str = "0.0") -> str:
    """Rules and decisions for a model prediction and score given as SQL over a frame's columns.  The default is
    the rules-only detector, where R12 and R14 cannot fire."""
    return f"""
scored AS (
  SELECT *, CASE WHEN detector_phase = 'inference' THEN {prediction} ELSE 1 END AS model_prediction,
    CASE WHEN detector_phase = 'inference' THEN {score} ELSE 0.0 END AS anomaly_score
  FROM lf
), rl AS (
  SELECT *,
    akey = '0x000' AND id_frequency_1s >= 25 AS "{RULE_NAMES[0]}",
    akey NOT IN ({_KNOWN}) AND has_raw_bytes AS "{RULE_NAMES[1]}",
    speed >= 180.0 AS "{RULE_NAMES[2]}",
    abs(acceleration) >= 7.0 AS "{RULE_NAMES[3]}",
    rpm >= 7000.0 AS "{RULE_NAMES[4]}",
    coolant_temp >= 130.0 AS "{RULE_NAMES[5]}",
    battery_voltage <> 0 AND battery_voltage <= 11.5 AS "{RULE_NAMES[6]}",
    brake_pressure <= 0.1 AND greatest(wheel_speed_fl, wheel_speed_fr) >= 70.0 AND brake_drop_per_second > 500.0
      AS "{RULE_NAMES[7]}",
    payload_signature_repeats_3s >= {P.repeat_min_count} AND payload_timing_replay_score >= {P.replay_composite}
      AS "{RULE_NAMES[8]}",
    payload_signature_repeats_3s >= {P.repeat_min_count} AND rare_transition_flag <> 0 AND timing_anomaly_score >= 0.5
      AND payload_timing_replay_score >= {P.rare_replay_floor} AS "{RULE_NAMES[9]}",
    CASE WHEN payload_sequence_replay_score >= 0.70 THEN '{RULE_NAMES[10]}'
         WHEN model_prediction = -1 AND payload_sequence_repeat_count >= 1 AND payload_signature_repeats_3s >= 1
              THEN '{RULE_NAMES[11]}'
         WHEN payload_sequence_repeat_count >= 1 AND rare_transition_flag <> 0 AND payload_signature_repeats_3s >= 1
              AND timing_anomaly_score >= 0.95 THEN '{RULE_NAMES[12]}'
         WHEN model_prediction = -1 AND payload_sequence_repeat_count >= 1 AND timing_anomaly_score >= 0.95
              THEN '{RULE_NAMES[13]}'
         WHEN payload_sequence_repeat_count >= 3 AND payload_sequence_tight_timing_flag <> 0 THEN '{RULE_NAMES[14]}'
         WHEN payload_sequence_repeat_count >= {P.ngram_min_repeats} AND rare_transition_flag <> 0
              AND timing_anomaly_score >= 0.5 THEN '{RULE_NAMES[15]}' END AS replay_rule,
    state_transition_violation_score >= 0.5 AS "{RULE_NAMES[16]}"
  FROM scored
), rl2 AS (
  SELECT *,
    CASE WHEN detector_phase = 'inference' THEN list_filter([
      {', '.join(f'CASE WHEN "{r}" THEN {chr(39)}{r}{chr(39)} END' for r in RULE_NAMES[:10])},
      replay_rule,
      CASE WHEN "{RULE_NAMES[16]}" THEN '{RULE_NAMES[16]}' END], lambda x: x IS NOT NULL)
    ELSE CAST([] AS VARCHAR[]) END AS triggered_rules
  FROM rl
), rl3 AS (
  SELECT *,
    len(triggered_rules) > 0 AS rule_flag,
    detector_phase = 'inference' AND model_prediction = -1 AND anomaly_score <= {P.severe_model_score} AS model_flag
  FROM rl2
), alerts AS (
  SELECT *,
    model_flag OR rule_flag AS is_anomaly,
    least(1.0, len(triggered_rules) / 3.0) AS rule_score,
    CASE WHEN model_flag OR rule_flag THEN -1 ELSE 1 END AS anomaly_prediction,
    list_concat(CASE WHEN model_flag THEN ['{MODEL_REASON}'] ELSE CAST([] AS VARCHAR[]) END, triggered_rules)
      AS decision_reasons,
    CASE WHEN simulator_send_time_ns IS NULL THEN 0.0
         ELSE greatest(0.0, (100000000000 - simulator_send_time_ns) / 1e6) END AS pipeline_latency_ms
  FROM rl3
)"""


RULES_SQL = rules_sql()
# A model stand-in that both engines compute alike: a prediction and a score from the sequence number.
GIVEN_PREDICTION, GIVEN_SCORE = """(CASE WHEN "sequence" % 5 = 0 THEN -1 ELSE 1 END)""", """((("sequence" % 31) - 20) / 100.0)"""


def learned_query(select: str) -> str:
    return with_ctes(FRAMES_SQL, DECODED_SQL, FEATS_SQL, LEARNED_SQL, select=select)


def alerts_query(select: str, rules: str | None = None) -> str:
    return with_ctes(FRAMES_SQL, DECODED_SQL, FEATS_SQL, LEARNED_SQL, rules or RULES_SQL, select=select)


def given_scores_query(select: str) -> str:
    """Over alerts that were decided with the model stand-in."""
    return alerts_query(select, rules_sql(GIVEN_PREDICTION, GIVEN_SCORE))


def rough_query(select: str, scores: bool = False) -> str:
    """Over the frames that are laid anew (``rough_frames``); with ``scores`` decided with the model stand-in."""
    rules = rules_sql(GIVEN_PREDICTION, GIVEN_SCORE) if scores else RULES_SQL
    return with_ctes(ROUGH_SQL, DECODED_SQL, FEATS_SQL, LEARNED_SQL, rules, select=select)
