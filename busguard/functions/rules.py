"""Security rules, model gate, ensemble and decision reasons.

All rules are column expressions evaluated in one projection.  ``model_prediction`` is the raw
Isolation Forest prediction (+1 / -1); rules R12 and R14 read it, not the severe flag.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from busguard.operators.windows import KEY
from busguard.params import DetectorParams
from busguard.schema import FLOOD_ARBITRATION_ID, MODEL_REASON, RULE_NAMES


def _ge(c: str, x: float) -> Column:
    return F.col(c) >= F.lit(float(x))


def base_rules(params: DetectorParams) -> list[tuple[str, Column]]:
    """R1-R10 in output order."""
    wheel = F.greatest(F.col("wheel_speed_fl"), F.col("wheel_speed_fr"))
    rep3 = _ge("payload_signature_repeats_3s", params.repeat_min_count)
    rare = F.col("rare_transition_flag") != 0
    return [
        (RULE_NAMES[0], (F.col(KEY) == FLOOD_ARBITRATION_ID) & _ge("id_frequency_1s", 25)),
        (RULE_NAMES[1], ~F.col(KEY).isin(*params.known_ids) & F.col("has_raw_bytes")),
        (RULE_NAMES[2], _ge("speed", 180)),
        (RULE_NAMES[3], F.abs(F.col("acceleration")) >= F.lit(7.0)),
        (RULE_NAMES[4], _ge("rpm", 7000)),
        (RULE_NAMES[5], _ge("coolant_temp", 130)),
        (RULE_NAMES[6], (F.col("battery_voltage") != 0) & (F.col("battery_voltage") <= F.lit(11.5))),
        (RULE_NAMES[7], (F.col("brake_pressure") <= F.lit(0.1)) & (wheel >= F.lit(70.0))
         & (F.col("brake_drop_per_second") > F.lit(500.0))),
        (RULE_NAMES[8], rep3 & _ge("payload_timing_replay_score", params.replay_composite)),
        (RULE_NAMES[9], rep3 & rare & _ge("timing_anomaly_score", 0.5)
         & _ge("payload_timing_replay_score", params.rare_replay_floor)),
    ]


def replay_rule(params: DetectorParams, model_prediction: Column) -> Column:
    """First match wins; null when none matches."""
    seq = F.col("payload_sequence_repeat_count")
    rep3 = F.col("payload_signature_repeats_3s")
    rare = F.col("rare_transition_flag") != 0
    timing = F.col("timing_anomaly_score")
    model_bad = model_prediction == -1
    return (
        F.when(F.col("payload_sequence_replay_score") >= 0.70, F.lit(RULE_NAMES[10]))
        .when(model_bad & (seq >= 1) & (rep3 >= 1), F.lit(RULE_NAMES[11]))
        .when((seq >= 1) & rare & (rep3 >= 1) & (timing >= 0.95), F.lit(RULE_NAMES[12]))
        .when(model_bad & (seq >= 1) & (timing >= 0.95), F.lit(RULE_NAMES[13]))
        .when((seq >= 3) & (F.col("payload_sequence_tight_timing_flag") != 0), F.lit(RULE_NAMES[14]))
        .when((seq >= params.ngram_min_repeats) & rare & (timing >= 0.5), F.lit(RULE_NAMES[15]))
    )


def physics_rule() -> tuple[str, Column]:
    return RULE_NAMES[16], F.col("state_transition_violation_score") >= F.lit(0.5)


def triggered_rules(params: DetectorParams, model_prediction: Column) -> Column:
    """Names of the triggered rules, in the reference's order (array<string>)."""
    items = [F.when(cond, F.lit(name)) for name, cond in base_rules(params)]
    items.append(replay_rule(params, model_prediction))
    name, cond = physics_rule()
    items.append(F.when(cond, F.lit(name)))
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def rule_flag_columns(params: DetectorParams, model_prediction: Column) -> dict[str, Column]:
    """One boolean column per rule (for checks and dashboards)."""
    out = {name: F.coalesce(cond, F.lit(False)) for name, cond in base_rules(params)}
    rr = replay_rule(params, model_prediction)
    for name in RULE_NAMES[10:16]:
        out[name] = F.coalesce(rr == F.lit(name), F.lit(False))
    name, cond = physics_rule()
    out[name] = F.coalesce(cond, F.lit(False))
    return out


def rule_score(rules: Column) -> Column:
    return F.least(F.lit(1.0), F.size(rules).cast("double") / 3.0)


def model_flag(prediction: Column, score: Column, params: DetectorParams) -> Column:
    """M3: raw prediction -1 and decision score at or below the severe threshold."""
    return (prediction == -1) & (score <= F.lit(params.severe_model_score))


def decision_reasons(model_flag_col: Column, rules: Column) -> Column:
    """The model reason first, then the rules in order."""
    head = F.when(model_flag_col, F.array(F.lit(MODEL_REASON))).otherwise(F.array().cast("array<string>"))
    return F.concat(head, rules)
