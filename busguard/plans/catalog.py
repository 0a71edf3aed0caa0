"""Registered queries: one per operator of SURVEY 2, each with its DuckDB oracle text (or none).

Every query reads the driver's ``events`` table through ``frames_from_events`` and runs over the
whole table with the reference's single merged bus (``bus_keys=()``) and default thresholds.
Computed floating values are rounded to 6 decimals on both sides.  Within one session the shared
features are written once as a stage table; what follows from them (learned features, model, rules, alerts) is
computed where it is read, so a query computes the columns that it returns and nothing wide is held in memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busguard.operators import baselines, evaluate, quantiles
from busguard.operators.windows import KEY
from busguard.params import REFERENCE_BUS
from busguard.plans import dashboards as D
from busguard.plans import detect
from busguard.plans.oracle import alerts_query, features_query, given_scores_query, learned_query, rough_query
from busguard.schema import (ATTACK_TYPES, FEATURE_COLUMNS, NUMERIC_SIGNALS, REQUIRED_LABELS, RULE_NAMES)
from busguard.session import checkpoint_dir
from busguard.sources import alerts as A
from busguard.sources.frames import frame_key_value, frames_from_events, rough_frames

P = REFERENCE_BUS
RULES_ONLY = P.with_(use_model=False)


def proc():
    """Fixed processing time (a column) so latency-dependent outputs are deterministic."""
    return F.lit(detect.FIXTURE_PROCESSING_NS)


RANGE_START, RANGE_END = "2024-01-08 00:00:00", "2024-01-15 23:59:59"
_CACHE: dict = {}


def _memo(spark: SparkSession, sf_dir: str, key: str, build: Callable[[], object]):
    k = (id(spark), spark.sparkContext.applicationId, sf_dir, key)
    if k not in _CACHE:
        _CACHE[k] = build()
    return _CACHE[k]


def frames(spark, sf):
    return frames_from_events(spark, sf)


def decoded(spark, sf):
    return detect.decoded_frames(frames(spark, sf), P, proc())


def features(spark, sf, keep_text: bool = False) -> detect.Features:
    return _memo(spark, sf, f"feats{keep_text}",
                 lambda: detect.staged_features(frames(spark, sf), P, proc(), keep_text=keep_text))


def feats(spark, sf):
    return features(spark, sf).wide


def window_feats(spark, sf, keep_text: bool = False):
    """The columns of ``feats`` that the window stages read or make: nothing is decoded again for them."""
    return features(spark, sf, keep_text).narrow


def learned_state(spark, sf):
    def build():
        warm, art = detect.learn(features(spark, sf), RULES_ONLY)
        decided = detect.score_and_decide(detect.learned(feats(spark, sf), art, RULES_ONLY), art, RULES_ONLY)
        return warm, art, decided
    return _memo(spark, sf, "learned", build)


def learned_window_feats(spark, sf):
    return detect.learned(window_feats(spark, sf), learned_state(spark, sf)[1], RULES_ONLY)


def alerts(spark, sf):
    return _memo(spark, sf, "alerts", lambda: detect.enrich(learned_state(spark, sf)[2], proc()))


def warmup_alerts(spark, sf):
    """``alerts`` of the warm-up phase, without decoding all other frames again."""
    art = learned_state(spark, sf)[1]
    wide = detect.warmup_rows(features(spark, sf), art)
    return detect.enrich(detect.score_and_decide(detect.learned(wide, art, RULES_ONLY), art, RULES_ONLY), proc())


def model_state(spark, sf):
    return _memo(spark, sf, "model", lambda: detect.detect(frames(spark, sf), P, proc(), materialize=True))


def R(c: str, name: str | None = None):
    """Rounded to 6 decimals; adding 0.0 turns -0.0 into 0.0 so both engines print the same."""
    return (F.round(F.col(c), 6) + F.lit(0.0)).alias(name or c.split(".")[-1])


def r(c: str, name: str | None = None) -> str:
    return f"round({c}, 6) + 0.0 AS {name or c}"


def seqsel(df: DataFrame, *cols) -> DataFrame:
    return df.select("sequence", *cols)


# ----------------------------------------------------------------------------- queries
Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def reg(name: str, sql: str | None):
    def deco(fn):
        Q[name] = (fn, sql)
        return fn
    return deco


# 2.A sources and sinks
@reg("frame_scan", features_query("SELECT * FROM frames"))
def q_frame_scan(spark, sf):
    return frames(spark, sf).drop("_ord")


@reg("frame_key_value", features_query(
    "SELECT vehicle_id || ':' || arbitration_id AS key, \"sequence\", payload FROM frames"))
def q_frame_key_value(spark, sf):
    kv = frame_key_value(frames(spark, sf).drop("_ord"))
    return kv.select("key", F.get_json_object("value", "$.sequence").cast("bigint").alias("sequence"),
                     F.get_json_object("value", "$.payload").alias("payload"))


@reg("alert_scan_union", alerts_query(
    "SELECT \"sequence\", attack_type_label, is_anomaly, detector_phase FROM alerts"))
def q_alert_scan_union(spark, sf):
    al = alerts(spark, sf)
    root = f"{checkpoint_dir(spark)}/alert-indices-{uuid.uuid4().hex}"
    # two indices of one family with different columns: the wildcard read merges them
    A.write_alerts(al.filter(F.col("detector_phase") == "inference"), f"{root}/can-security-alerts-inference", "overwrite")
    A.write_alerts(warmup_alerts(spark, sf).drop("features", "decision_reasons"),
                   f"{root}/can-security-alerts-warmup", "overwrite")
    return A.read_alerts(spark, f"{root}/can-security-alerts-*").select(
        "sequence", "attack_type_label", "is_anomaly", "detector_phase")


@reg("alert_document_id", features_query(
    "SELECT \"sequence\", sha256(session_id || ':' || CAST(\"sequence\" AS VARCHAR) || ':' || arbitration_id || ':' || "
    "CAST(row_number() OVER (PARTITION BY session_id, \"sequence\", arbitration_id ORDER BY t) - 1 AS VARCHAR)) "
    "AS document_id FROM dec"))
def q_alert_document_id(spark, sf):
    return A.document_id(alerts(spark, sf)).select("sequence", "document_id")


# 2.B projections
@reg("arbitration_parse", features_query('SELECT "sequence", arbitration_id, arbitration_id_numeric FROM dec'))
def q_arbitration_parse(spark, sf):
    return seqsel(decoded(spark, sf), "arbitration_id", "arbitration_id_numeric")


_SIG_COLS = NUMERIC_SIGNALS + ["abs_active", "lane_assist_active", "odometer_km"]


@reg("signal_decode", features_query(f'SELECT "sequence", {", ".join(_SIG_COLS)} FROM dec'))
def q_signal_decode(spark, sf):
    return seqsel(decoded(spark, sf), *_SIG_COLS)


@reg("raw_byte_stats", features_query(f'SELECT "sequence", {r("raw_byte_mean")}, {r("raw_byte_std")} FROM dec'))
def q_raw_byte_stats(spark, sf):
    return seqsel(decoded(spark, sf), R("raw_byte_mean"), R("raw_byte_std"))


@reg("payload_signature", features_query('SELECT "sequence", payload AS payload_signature FROM dec'))
def q_payload_signature(spark, sf):
    return seqsel(decoded(spark, sf), "payload_signature")


@reg("event_time", features_query('SELECT "sequence", t AS event_time_ns FROM dec'))
def q_event_time(spark, sf):
    return seqsel(decoded(spark, sf), F.col("t").alias("event_time_ns"))


@reg("id_priority", features_query(
    f'SELECT "sequence", reserved_id_flag, {r("arbitration_priority_score")} FROM feats'))
def q_id_priority(spark, sf):
    from busguard.functions.decode import arbitration_priority_score, reserved_id_flag
    d = decoded(spark, sf)
    return d.select("sequence", reserved_id_flag("arbitration_id_numeric").alias("reserved_id_flag"),
                    F.round(arbitration_priority_score("arbitration_id_numeric"), 6).alias("arbitration_priority_score"))


_CHECK = " + ".join(f"{i + 1} * {c}" for i, c in enumerate(FEATURE_COLUMNS))


@reg("feature_vector", features_query(
    f'SELECT "sequence", {len(FEATURE_COLUMNS)} AS vector_size, round({_CHECK}, 4) AS vector_checksum FROM feats'))
def q_feature_vector(spark, sf):
    f = feats(spark, sf).withColumn("_v", F.array(*FEATURE_COLUMNS))
    chk = F.aggregate(F.zip_with(F.col("_v"), F.sequence(F.lit(1), F.size("_v")), lambda x, i: x * i),
                      F.lit(0.0), lambda a, x: a + x)
    return f.select("sequence", F.size("_v").alias("vector_size"), F.round(chk, 4).alias("vector_checksum"))


@reg("pipeline_latency", alerts_query(f'SELECT "sequence", {r("pipeline_latency_ms")} FROM alerts'))
def q_pipeline_latency(spark, sf):
    return seqsel(alerts(spark, sf), R("pipeline_latency_ms"))


@reg("enriched_alerts", None)
def q_enriched_alerts(spark, sf):
    return model_state(spark, sf)[0].drop("features")


@reg("decision_reasons", alerts_query(
    'SELECT "sequence", array_to_string(decision_reasons, \',\') AS reasons FROM alerts'))
def q_decision_reasons(spark, sf):
    return seqsel(alerts(spark, sf), F.array_join("decision_reasons", ",").alias("reasons"))


# 2.C filters
@reg("warmup_gate", learned_query('SELECT "sequence", t AS event_time_ns FROM warm'))
def q_warmup_gate(spark, sf):
    return learned_state(spark, sf)[0].select("sequence", F.col("t").alias("event_time_ns"))


@reg("scored_events", features_query(
    'SELECT "sequence", attack_type_label, benchmark_scored FROM frames WHERE benchmark_scored IS NULL OR benchmark_scored'))
def q_scored_events(spark, sf):
    return evaluate.scored_events(frames(spark, sf)).select("sequence", "attack_type_label", "benchmark_scored")


@reg("alerts_in_range", alerts_query(
    f'SELECT "sequence", attack_type_label, is_anomaly FROM alerts '
    f"WHERE \"timestamp\" >= TIMESTAMP '{RANGE_START}' AND \"timestamp\" <= TIMESTAMP '{RANGE_END}'"))
def q_alerts_in_range(spark, sf):
    start = F.lit(RANGE_START).cast("timestamp_ntz")
    end = F.lit(RANGE_END).cast("timestamp_ntz")
    return evaluate.in_time_range(alerts(spark, sf), start, end).select("sequence", "attack_type_label", "is_anomaly")


@reg("latest_alerts", alerts_query(
    'SELECT "sequence", "timestamp", attack_type_label, is_anomaly FROM alerts '
    'ORDER BY "timestamp" DESC, "sequence" DESC LIMIT 5'))
def q_latest_alerts(spark, sf):
    return D.latest_alerts(alerts(spark, sf)).select("sequence", "timestamp", "attack_type_label", "is_anomaly")


# 2.D windows
def _feat_query(name: str, spec: list[str], source: str = "feats"):
    """Register a per-frame feature query; ``~col`` = rounded to 6 decimals."""
    sql_cols = [r(c[1:]) if c.startswith("~") else c for c in spec]
    sql = (features_query if source == "feats" else learned_query)(
        f'SELECT "sequence", {", ".join(sql_cols)} FROM {"feats" if source == "feats" else "lf"}')

    def fn(spark, sf):
        base = (window_feats if source == "feats" else learned_window_feats)(spark, sf)
        return base.select("sequence", *[R(c[1:]) if c.startswith("~") else F.col(c) for c in spec])
    Q[name] = (fn, sql)


_STATE = ["speed_delta_mps2", "rpm_delta_per_second", "coolant_delta_per_second", "brake_drop_per_second",
          "odometer_rollback_flag"]
_TIMING = ["iat_robust_z", "iat_drop_flag", "iat_spike_flag", "iat_exactness_ratio", "iat_exactness_flag",
           "timing_anomaly_score"]
_feat_query("interarrival", ["~interarrival_ms"])
_feat_query("id_frequency", ["id_frequency_1s", "~repeated_id_ratio"])
_feat_query("bus_frequency", ["bus_frequency_1s", "~bus_utilization"])
_feat_query("id_entropy", ["~id_entropy_1s"])
_feat_query("dominant_id", ["~dominant_id_ratio"])
_feat_query("unique_ids", ["unique_ids_per_second"])
_feat_query("payload_repeat_ratio", ["~payload_repeat_ratio"])
_feat_query("rolling_interarrival", ["~rolling_interarrival_mean", "~rolling_interarrival_std"])
_feat_query("replay_suspicion", ["replay_signature_repeats_1s"])
_feat_query("signature_repeats", ["payload_signature_repeats_3s", "~payload_repeat_score"])
_feat_query("ngram_repeats", ["payload_sequence_repeat_count", "~payload_sequence_age_ms"])
_feat_query("transition_pairs", ["previous_bus_id"])
_feat_query("state_deltas", ["~" + c for c in _STATE])
_feat_query("state_violation", ["~state_transition_violation_score"])
_feat_query("payload_timing_replay", ["~payload_timing_replay_score"], "lf")
_feat_query("ngram_replay_score", ["payload_sequence_tight_timing_flag", "~payload_sequence_replay_score"], "lf")
_feat_query("transition_features", ["~transition_probability", "~transition_surprise", "rare_transition_flag"], "lf")
_feat_query("timing_rhythm", ["~" + c for c in _TIMING], "lf")


@reg("payload_ngrams", features_query(
    'SELECT "sequence", CASE WHEN sig2 IS NOT NULL THEN sig2 END AS ngram_first, '
    'CASE WHEN sig2 IS NOT NULL THEN sig1 END AS ngram_second, CASE WHEN sig2 IS NOT NULL THEN sig END AS ngram_third '
    'FROM feats'))
def q_payload_ngrams(spark, sf):
    f = window_feats(spark, sf, keep_text=True)
    return f.select("sequence", F.col("ngram_text")[0].alias("ngram_first"), F.col("ngram_text")[1].alias("ngram_second"),
                    F.col("ngram_text")[2].alias("ngram_third"))


# 2.E aggregations and baselines
_RS = ["median", "mad", "mean", "std", "cv"]


@reg("robust_stats", features_query(
    "SELECT akey AS arbitration_id, " + ", ".join(r(c) for c in _RS) + ', "count" FROM ('
    "SELECT s.akey, m.median, quantile_cont(abs(s.interarrival_ms - m.median), 0.5) AS mad, m.mean, m.std, "
    "CASE WHEN m.mean > 0 THEN m.std / m.mean ELSE 0.0 END AS cv, m.cnt AS \"count\" "
    "FROM feats s JOIN (SELECT akey, quantile_cont(interarrival_ms, 0.5) AS median, avg(interarrival_ms) AS mean, "
    "stddev_pop(interarrival_ms) AS std, CAST(count(*) AS DOUBLE) AS cnt FROM feats WHERE interarrival_ms > 0 "
    "GROUP BY akey) m ON s.akey = m.akey WHERE s.interarrival_ms > 0 GROUP BY s.akey, m.median, m.mean, m.std, m.cnt)"))
def q_robust_stats(spark, sf):
    st = baselines.robust_stats(window_feats(spark, sf), [KEY], "interarrival_ms")
    return st.select(F.col(KEY).alias("arbitration_id"), *[R(c) for c in _RS], "count")


@reg("timing_baseline", learned_query(
    "SELECT arbitration_id, " + ", ".join(r(c) for c in _RS) + ', "count" FROM tb'))
def q_timing_baseline(spark, sf):
    return learned_state(spark, sf)[1].timing_baseline.select("arbitration_id", *[R(c) for c in _RS], "count")


@reg("transition_matrix", learned_query("SELECT prev_id, next_id, n, total, next_ids FROM tm"))
def q_transition_matrix(spark, sf):
    return learned_state(spark, sf)[1].transitions


_SCALER_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, "
    f"round(CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END, 6) AS std FROM warm"
    for c in FEATURE_COLUMNS)


@reg("feature_scaler", learned_query(f"SELECT * FROM ({_SCALER_SQL})"))
def q_feature_scaler(spark, sf):
    return baselines.feature_scaler(learned_state(spark, sf)[0]).select("feature", R("mean"), R("std"))


_CC = ", ".join(
    f"CAST(count_if(attack_type_label = '{n}') AS BIGINT) AS {n}_total, "
    f"CAST(count_if(attack_type_label = '{n}' AND is_anomaly = true) AS BIGINT) AS {n}_pos, "
    f"CAST(count_if(attack_type_label = '{n}' AND is_anomaly = false) AS BIGINT) AS {n}_neg" for n in REQUIRED_LABELS)
_SCORED = "benchmark_scored IS NULL OR benchmark_scored"


@reg("confusion_counts", alerts_query(f"SELECT {_CC} FROM alerts WHERE {_SCORED}"))
def q_confusion_counts(spark, sf):
    return evaluate.confusion_counts(alerts(spark, sf))


def _metrics_sql(tp, tn, fp, fn, rounded: bool = True) -> str:
    prec = f"CASE WHEN ({tp} + {fp}) <> 0 THEN CAST({tp} AS DOUBLE) / ({tp} + {fp}) ELSE 0.0 END"
    rec = f"CASE WHEN ({tp} + {fn}) <> 0 THEN CAST({tp} AS DOUBLE) / ({tp} + {fn}) ELSE 0.0 END"
    f1 = f"CASE WHEN ({prec}) + ({rec}) <> 0 THEN 2.0 * ({prec}) * ({rec}) / (({prec}) + ({rec})) ELSE 0.0 END"
    fpr = f"CASE WHEN ({fp} + {tn}) <> 0 THEN CAST({fp} AS DOUBLE) / ({fp} + {tn}) ELSE 0.0 END"
    acc = (f"CASE WHEN ({tp} + {tn} + {fp} + {fn}) <> 0 THEN CAST({tp} + {tn} AS DOUBLE) / ({tp} + {tn} + {fp} + {fn}) "
           f"ELSE 0.0 END")
    rd = (lambda x: f"round({x}, 6)") if rounded else (lambda x: x)
    return (f"{rd(rec)} AS detection_rate, {rd(prec)} AS precision, {rd(rec)} AS recall, "
            f"{rd(f1)} AS f1, {rd(fpr)} AS false_positive_rate, {rd(acc)} AS accuracy")


_COUNTS = f"(SELECT {_CC} FROM alerts WHERE {_SCORED}) c"
_ROWS = (
    "(" + " UNION ALL ".join(f"SELECT {i} AS ord, '{a}' AS attack_type, {a}_total AS total, {a}_pos AS tp, "
                             f"normal_neg AS tn, normal_pos AS fp, {a}_neg AS fn FROM {_COUNTS}"
                             for i, a in enumerate(ATTACK_TYPES))
    + f" UNION ALL SELECT {len(ATTACK_TYPES)} AS ord, 'overall' AS attack_type, CAST(NULL AS BIGINT) AS total, "
    + " + ".join(f"{a}_pos" for a in ATTACK_TYPES) + " AS tp, normal_neg AS tn, normal_pos AS fp, "
    + " + ".join(f"{a}_neg" for a in ATTACK_TYPES) + f" AS fn FROM {_COUNTS}) report_rows")
_REPORT_SQL = f"SELECT ord, attack_type, total, tp, tn, fp, fn, {_metrics_sql('tp', 'tn', 'fp', 'fn')} FROM {_ROWS}"


def _rounded_report(report: DataFrame) -> DataFrame:
    return report.select("ord", "attack_type", "total", "tp", "tn", "fp", "fn",
                         *[R(c) for c in ["detection_rate", "precision", "recall", "f1", "false_positive_rate", "accuracy"]])


@reg("detection_metrics", alerts_query(_REPORT_SQL))
def q_detection_metrics(spark, sf):
    return _rounded_report(evaluate.detection_report(alerts(spark, sf)))


@reg("label_counts", alerts_query(
    "SELECT attack_type_label, count(*) AS doc_count FROM alerts GROUP BY attack_type_label "
    "ORDER BY doc_count DESC, attack_type_label LIMIT 20"))
def q_label_counts(spark, sf):
    return evaluate.label_counts(alerts(spark, sf))


@reg("label_by_anomaly", alerts_query(
    "SELECT attack_type_label, is_anomaly, count(*) AS doc_count FROM alerts GROUP BY attack_type_label, is_anomaly"))
def q_label_by_anomaly(spark, sf):
    return evaluate.label_by_anomaly(alerts(spark, sf))


@reg("missing_labels", alerts_query(
    "SELECT label FROM (VALUES " + ", ".join(f"('{x}')" for x in REQUIRED_LABELS) + ") req(label) "
    "WHERE label NOT IN (SELECT attack_type_label FROM alerts WHERE attack_type_label IS NOT NULL)"))
def q_missing_labels(spark, sf):
    return evaluate.missing_labels(alerts(spark, sf))


@reg("count_reconciliation", alerts_query(
    "SELECT e AS expected_total, i AS indexed_total, CAST(floor(e * 0.98) AS BIGINT) AS lower_bound, "
    "CAST(floor(e * 1.02) AS BIGINT) AS upper_bound, "
    "(i >= CAST(floor(e * 0.98) AS BIGINT) AND i <= CAST(floor(e * 1.02) AS BIGINT)) AS within_bounds "
    "FROM (SELECT (SELECT count(*) FROM frames) AS e, (SELECT count(*) FROM alerts) AS i)"))
def q_count_reconciliation(spark, sf):
    produced = frames(spark, sf).groupBy(F.col("attack_type_label").alias("mode")).agg(F.count(F.lit(1)).alias("frames"))
    return evaluate.count_reconciliation(produced, alerts(spark, sf))


_PART = "CAST(substr(vehicle_id, 2) AS INTEGER)"


@reg("ingest_lag", alerts_query(
    "SELECT e.topic, e.partition, e.end_offset, c.committed, "
    "greatest(0, e.end_offset - COALESCE(c.committed, 0)) AS lag, "
    "CAST(sum(greatest(0, e.end_offset - COALESCE(c.committed, 0))) OVER () AS BIGINT) AS total_lag FROM "
    f"(SELECT 'can-telematics' AS topic, {_PART} AS partition, count(*) AS end_offset FROM frames GROUP BY 2) e "
    f"LEFT JOIN (SELECT 'can-telematics' AS topic, {_PART} AS partition, count(*) AS committed FROM alerts "
    "WHERE detector_phase = 'inference' GROUP BY 2) c ON e.topic = c.topic AND e.partition = c.partition"))
def q_ingest_lag(spark, sf):
    part = F.substring("vehicle_id", 2, 10).cast("int").alias("partition")
    topic = F.lit("can-telematics").alias("topic")
    ends = frames(spark, sf).groupBy(topic, part).agg(F.count(F.lit(1)).alias("end_offset"))
    done = alerts(spark, sf).filter(F.col("detector_phase") == "inference").groupBy(topic, part) \
        .agg(F.count(F.lit(1)).alias("committed"))
    return evaluate.ingest_lag(ends, done)


@reg("quality_gates", alerts_query(
    "SELECT round(overall_f1, 6) AS overall_f1, round(overall_precision, 6) AS overall_precision, "
    "round(overall_fpr, 6) AS overall_fpr, round(replay_recall, 6) AS replay_recall, "
    "array_to_string(list_filter(["
    "CASE WHEN overall_f1 < 0.99 THEN printf('overall_f1 %.4f%% < %.4f%%', overall_f1 * 100.0, 99.0) END, "
    "CASE WHEN overall_precision < 0.99 THEN printf('precision %.4f%% < %.4f%%', overall_precision * 100.0, 99.0) END, "
    "CASE WHEN overall_fpr > 0.005 THEN printf('false_positive_rate %.4f%% > %.4f%%', overall_fpr * 100.0, 0.5) END, "
    "CASE WHEN replay_recall < 0.99 THEN printf('replay_recall %.4f%% < %.4f%%', replay_recall * 100.0, 99.0) END"
    "], lambda x: x IS NOT NULL), '; ') AS failures, "
    "(overall_f1 >= 0.99 AND overall_precision >= 0.99 AND overall_fpr <= 0.005 AND replay_recall >= 0.99) AS passed "
    "FROM (SELECT "
    "max(CASE WHEN attack_type = 'overall' THEN f1 END) AS overall_f1, "
    "max(CASE WHEN attack_type = 'overall' THEN precision END) AS overall_precision, "
    "max(CASE WHEN attack_type = 'overall' THEN false_positive_rate END) AS overall_fpr, "
    "max(CASE WHEN attack_type = 'replay' THEN recall END) AS replay_recall FROM "
    f"(SELECT ord, attack_type, total, tp, tn, fp, fn, {_metrics_sql('tp', 'tn', 'fp', 'fn', rounded=False)} "
    f"FROM {_ROWS}) rep) g"))
def q_quality_gates(spark, sf):
    g = evaluate.quality_gates(evaluate.detection_report(alerts(spark, sf)))
    return g.select(R("overall_f1"), R("overall_precision"), R("overall_fpr"), R("replay_recall"),
                    F.array_join("failures", "; ").alias("failures"), "passed")


# 2.F model
@reg("isolation_forest_fit", None)
def q_isolation_forest_fit(spark, sf):
    return model_state(spark, sf)[1].forest_nodes


@reg("isolation_forest_score", None)
def q_isolation_forest_score(spark, sf):
    al = model_state(spark, sf)[0]
    return al.filter(F.col("detector_phase") == "inference").select("sequence", "model_prediction", "anomaly_score")


@reg("model_flag", None)
def q_model_flag(spark, sf):
    return model_state(spark, sf)[0].select("sequence", "model_prediction", "anomaly_score", "model_flag")


@reg("ensemble_decision", alerts_query(
    'SELECT "sequence", model_flag, rule_flag, is_anomaly, anomaly_prediction FROM alerts'))
def q_ensemble_decision(spark, sf):
    return seqsel(alerts(spark, sf), "model_flag", "rule_flag", "is_anomaly", "anomaly_prediction")


@reg("detector_phase", learned_query('SELECT "sequence", detector_phase FROM phased'))
def q_detector_phase(spark, sf):
    return seqsel(learned_window_feats(spark, sf), "detector_phase")


# 2.G rules (inference frames, model prediction +1)
_RULE_SQL = ", ".join(
    [f'COALESCE("{n}", false) AS "{n}"' for n in RULE_NAMES[:10]]
    + [f"COALESCE(replay_rule = '{n}', false) AS \"{n}\"" for n in RULE_NAMES[10:16]]
    + [f'COALESCE("{RULE_NAMES[16]}", false) AS "{RULE_NAMES[16]}"'])


@reg("security_rules", alerts_query(f'SELECT "sequence", {_RULE_SQL} FROM rl WHERE detector_phase = \'inference\''))
def q_security_rules(spark, sf):
    from busguard.functions.rules import rule_flag_columns
    df = learned_state(spark, sf)[2].filter(F.col("detector_phase") == "inference")
    cols = rule_flag_columns(RULES_ONLY, F.lit(1))
    return df.select("sequence", *[c.alias(n) for n, c in cols.items()])


# M3, M4, P14, R12, R14 and the score queries on a model stand-in: every frame has a prediction and a score from
# its sequence number, the same in both engines
def given_alerts(spark, sf):
    def build():
        ready = F.col("detector_phase") == "inference"
        seq = F.col("sequence")
        df = learned_state(spark, sf)[2].withColumns({
            "model_prediction": F.when(ready & (seq % 5 == 0), F.lit(-1)).otherwise(F.lit(1)).cast("int"),
            "anomaly_score": F.when(ready, ((seq % 31) - 20) / F.lit(100.0)).otherwise(F.lit(0.0))})
        return detect.enrich(detect.decide(df, RULES_ONLY), proc())
    return _memo(spark, sf, "given_alerts", build)


@reg("model_gate_given_scores", given_scores_query(
    'SELECT "sequence", model_prediction, round(anomaly_score, 6) AS anomaly_score, model_flag, rule_flag, is_anomaly, '
    'anomaly_prediction, array_to_string(triggered_rules, \',\') AS rules, '
    'array_to_string(decision_reasons, \',\') AS reasons FROM alerts'))
def q_model_gate(spark, sf):
    return given_alerts(spark, sf).select(
        "sequence", "model_prediction", R("anomaly_score"), "model_flag", "rule_flag", "is_anomaly", "anomaly_prediction",
        F.array_join("triggered_rules", ",").alias("rules"), F.array_join("decision_reasons", ",").alias("reasons"))


@reg("score_by_attack_given_scores", given_scores_query(
    "SELECT attack_type_label, round(quantile_cont(anomaly_score, 0.25), 6) AS q1_score, "
    "round(quantile_cont(anomaly_score, 0.5), 6) AS median_score, round(quantile_cont(anomaly_score, 0.75), 6) AS q3_score, "
    "round(avg(anomaly_score), 6) AS avg_score FROM alerts GROUP BY 1"))
def q_score_by_attack_given(spark, sf):
    return D.score_by_attack(given_alerts(spark, sf))


@reg("filtered_alerts", alerts_query(
    "SELECT \"sequence\", is_anomaly FROM alerts WHERE vehicle_id = 'V1' AND attack_type_label = 'normal' "
    "AND detector_phase = 'inference'"))
def q_filtered(spark, sf):
    return D.filtered(alerts(spark, sf), "V1", "normal", "inference").select("sequence", "is_anomaly")


@reg("live_alert_counts", alerts_query(
    'SELECT time_bucket(INTERVAL 1 HOUR, CAST("timestamp" AS TIMESTAMP)) AS window_start, attack_type_label, '
    'count(*) AS events, count(*) FILTER (is_anomaly) AS anomalies FROM alerts GROUP BY 1, 2'))
def q_live_counts(spark, sf):
    from busguard.streaming.stream import live_alert_counts
    return live_alert_counts(alerts(spark, sf), "1 hour", "2 hours").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "attack_type_label", "events", "anomalies")


# 2.I dashboards
def _dash(name: str, fn, sql: str):
    Q[name] = (lambda spark, sf: fn(alerts(spark, sf)), alerts_query(sql))


_B = "strftime(date_trunc('day', \"timestamp\"), '%Y-%m-%d %H:%M:%S') AS bucket"
_dash("executive_kpis", D.executive_kpis,
      "SELECT count(*) AS total_events, count_if(is_anomaly) AS total_anomalies, "
      "count_if(attack_type_label <> 'normal') AS attack_events, "
      "count_if(attack_type_label = 'normal' AND is_anomaly) AS false_positives, "
      "round(avg(pipeline_latency_ms), 6) AS avg_latency_ms FROM alerts")
_dash("events_over_time", D.events_over_time,
      f"SELECT {_B}, attack_type_label, count(*) AS events FROM alerts GROUP BY 1, 2")
_dash("anomalies_over_time", D.anomalies_over_time,
      f"SELECT {_B}, count(*) AS anomalies FROM alerts WHERE is_anomaly GROUP BY 1")
_dash("attack_mix", D.attack_mix,
      "SELECT attack_type_label, count(*) AS events, round(count(*) / sum(count(*)) OVER (), 6) AS share "
      "FROM alerts GROUP BY 1")
_dash("score_by_attack", D.score_by_attack,
      "SELECT attack_type_label, round(quantile_cont(anomaly_score, 0.25), 6) + 0.0 AS q1_score, "
      "round(quantile_cont(anomaly_score, 0.5), 6) + 0.0 AS median_score, "
      "round(quantile_cont(anomaly_score, 0.75), 6) + 0.0 AS q3_score, round(avg(anomaly_score), 6) + 0.0 AS avg_score "
      "FROM alerts GROUP BY 1")
_DOS = "(attack_type_label = 'dos' OR arbitration_id = '0x000')"
_dash("dos_kpis", D.dos_kpis,
      f"SELECT count_if(attack_type_label = 'dos') AS dos_events, "
      f"count_if(attack_type_label = 'dos' AND is_anomaly) AS dos_detected FROM alerts WHERE {_DOS}")
_dash("dos_trends", D.dos_trends,
      f"SELECT {_B}, " + ", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in [
          "dominant_id_ratio", "id_entropy_1s", "bus_frequency_1s", "bus_utilization", "payload_repeat_ratio",
          "arbitration_priority_score"]) + f" FROM alerts WHERE {_DOS} GROUP BY 1")
_dash("top_arbitration_ids", D.top_arbitration_ids,
      f"SELECT arbitration_id, count(*) AS frames FROM alerts WHERE {_DOS} GROUP BY 1 "
      "ORDER BY frames DESC, arbitration_id LIMIT 10")
_dash("replay_kpis", D.replay_kpis,
      "SELECT count(*) AS replay_events, count_if(is_anomaly) AS replay_detected FROM alerts "
      "WHERE attack_type_label = 'replay'")
_dash("replay_trend", D.replay_trend,
      f"SELECT {_B}, is_anomaly, count(*) AS events FROM alerts WHERE attack_type_label = 'replay' GROUP BY 1, 2")
_dash("replay_timing_trends", D.replay_timing_trends,
      f"SELECT {_B}, " + ", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in [
          "rolling_interarrival_mean", "rolling_interarrival_std", "payload_repeat_ratio"])
      + " FROM alerts WHERE attack_type_label = 'replay' GROUP BY 1")
_dash("replay_id_mix", D.replay_id_mix,
      "SELECT arbitration_id, count(*) AS frames FROM alerts WHERE attack_type_label = 'replay' GROUP BY 1")
_dash("score_histogram", D.score_histogram,
      "SELECT round(floor(anomaly_score / 0.05) * 0.05, 6) AS score_bucket, count(*) AS frames FROM alerts GROUP BY 1")
_dash("latency_over_time", D.latency_over_time,
      f"SELECT {_B}, round(avg(pipeline_latency_ms), 6) AS avg_latency_ms FROM alerts GROUP BY 1")
_dash("kql_detection_rates", D.kql_detection_rates,
      "SELECT *, round(CASE WHEN attack_total <> 0 THEN attack_detected / attack_total ELSE 0.0 END, 6) "
      "AS detection_rate, round(CASE WHEN normal_total <> 0 THEN normal_flagged / normal_total ELSE 0.0 END, 6) "
      "AS false_positive_rate FROM (SELECT count_if(attack_type_label <> 'normal' AND is_anomaly) AS attack_detected, "
      "count_if(attack_type_label <> 'normal') AS attack_total, "
      "count_if(attack_type_label = 'normal' AND is_anomaly) AS normal_flagged, "
      "count_if(attack_type_label = 'normal') AS normal_total FROM alerts)")


# D13 over scores that vary
@reg("score_histogram_given_scores", given_scores_query(
    "SELECT round(floor(anomaly_score / 0.05) * 0.05, 6) AS score_bucket, count(*) AS frames FROM alerts GROUP BY 1"))
def q_score_histogram_given(spark, sf):
    return D.score_histogram(given_alerts(spark, sf))


# W22, W23, W25-W27, P3, P5, R10, R13-R17 on frames laid anew so that each of them occurs
def rough_learned(spark, sf) -> tuple[detect.Features, detect.Artifacts]:
    def build():
        f = detect.staged_features(rough_frames(frames(spark, sf)), P, proc())
        return f, detect.learn(f, RULES_ONLY)[1]
    return _memo(spark, sf, "rough", build)


def rough_state(spark, sf, given: bool = False):
    f, art = rough_learned(spark, sf)
    df = detect.learned(f.wide, art, RULES_ONLY)
    prediction = F.when(F.col("sequence") % 5 == 0, F.lit(-1)).otherwise(F.lit(1)) if given else F.lit(1)
    return df.withColumn("model_prediction", prediction.cast("int"))


@reg("rough_payload_signature", rough_query(
    'SELECT "sequence", payload AS payload_signature, abs_active, lane_assist_active, yaw_rate, steering_angle, '
    'throttle_position, engine_load, gear, ambient_temp, odometer_km FROM dec'))
def q_rough_payload(spark, sf):
    df = detect.decoded_frames(rough_frames(frames(spark, sf)), P, proc())
    return df.select("sequence", "payload_signature", "abs_active", "lane_assist_active", "yaw_rate", "steering_angle",
                     "throttle_position", "engine_load", "gear", "ambient_temp", "odometer_km")


@reg("rough_state_deltas", rough_query(
    'SELECT "sequence", ' + ", ".join(r(c) for c in [*_STATE, "state_transition_violation_score"]) + " FROM feats"))
def q_rough_state(spark, sf):
    return rough_learned(spark, sf)[0].narrow.select("sequence", *[R(c) for c in [*_STATE, "state_transition_violation_score"]])


@reg("rough_timing_rhythm", rough_query(
    'SELECT "sequence", detector_phase, ' + ", ".join(r(c) for c in [
        *_TIMING, "rare_transition_flag", "payload_sequence_tight_timing_flag", "payload_sequence_replay_score"]) + " FROM lf"))
def q_rough_timing(spark, sf):
    f, art = rough_learned(spark, sf)
    return detect.learned(f.narrow, art, RULES_ONLY).select("sequence", "detector_phase", *[R(c) for c in [
        *_TIMING, "rare_transition_flag", "payload_sequence_tight_timing_flag", "payload_sequence_replay_score"]])


def _rough_rules(given: bool):
    def fn(spark, sf):
        from busguard.functions.rules import rule_flag_columns
        df = rough_state(spark, sf, given).filter(F.col("detector_phase") == "inference")
        cols = rule_flag_columns(RULES_ONLY, F.col("model_prediction"))
        return df.select("sequence", *[c.alias(n) for n, c in cols.items()])
    return fn


for _name, _given in (("rough_security_rules", False), ("rough_security_rules_given_scores", True)):
    Q[_name] = (_rough_rules(_given),
                rough_query(f'SELECT "sequence", {_RULE_SQL} FROM rl WHERE detector_phase = \'inference\'', _given))


# A9 on the scored report
@reg("zero_totals", alerts_query(
    "SELECT a AS label FROM (SELECT unnest(['fuzz', 'replay', 'injection', 'dos']) AS a) WHERE a NOT IN (SELECT "
    "attack_type_label FROM alerts WHERE (benchmark_scored IS NULL OR benchmark_scored) AND is_anomaly IS NOT NULL)"))
def q_zero_totals(spark, sf):
    return evaluate.zero_totals(evaluate.detection_report(alerts(spark, sf)))


# 2.H streaming: the fixture's frames as three time slices through the stream detector, scored
# with the artifacts of the batch fit (rows-only: equal to the batch alerts after warm-up, which
# tests/test_stream.py checks value by value)
@reg("stream_detect", None)
def q_stream_detect(spark, sf):
    from busguard.schema import FRAME_COLUMNS, FRAME_SCHEMA
    from busguard.streaming.stream import StreamDetector
    art = model_state(spark, sf)[1]
    root = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    fr = frames(spark, sf).select(*[F.col(c).cast(FRAME_SCHEMA[c].dataType).alias(c) for c in FRAME_COLUMNS])
    edges = quantiles.exact_percentiles(fr.withColumn("_all", F.lit(0)), ["_all"], "simulator_send_time_ns", [1 / 3, 2 / 3]).first()
    bounds = [None, int(edges["p0"]), int(edges["p1"]), None]
    for i in range(3):
        part = fr
        if bounds[i] is not None:
            part = part.filter(F.col("simulator_send_time_ns") > bounds[i])
        if bounds[i + 1] is not None:
            part = part.filter(F.col("simulator_send_time_ns") <= bounds[i + 1])
        # four range-partitioned files per slice, slices written one after another: with four files
        # per trigger each micro-batch is exactly one time slice
        part.repartitionByRange(4, "simulator_send_time_ns").write.mode("overwrite").parquet(f"{root}/in/slice={i}")
    stream = spark.readStream.schema(FRAME_SCHEMA).option("maxFilesPerTrigger", 4) \
        .option("recursiveFileLookup", "true").parquet(f"{root}/in")
    det = StreamDetector(spark, P, art, f"{root}/alerts", f"{root}/state", processing_ns=proc())
    q = det.start(stream, f"{root}/ckpt", available_now=True)
    q.awaitTermination()
    return spark.read.parquet(f"{root}/alerts").select(
        "sequence", "batch_id", "detector_phase", "is_anomaly", "anomaly_score",
        F.array_join("triggered_rules", ",").alias("rules"))
